from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from loreloom.operators import actions, corpus, digest, health

NOW = datetime(2024, 6, 30, tzinfo=timezone.utc)
OLD = datetime(2023, 1, 1, tzinfo=timezone.utc).timestamp() * 1000
NEW = datetime(2024, 6, 20, tzinfo=timezone.utc).timestamp() * 1000


@pytest.fixture
def vault(spark):
    big = "x" * 16_100
    notes = [
        ("1-Projects/Done.md", "Done", "b" * 100, "{\"status\": \" DONE \"}", NEW), ("1-Projects/Old.md", "Old", "b" * 100, "broken {", OLD), ("1-Projects/Live.md", "Live", "b" * 100, None, NEW),
        ("2-Areas/Lone.md", "Lone", "b" * 100, "{}", OLD), ("2-Areas/Leaf.md", "Leaf", "b" * 100, "{}", OLD), ("2-Areas/Fresh.md", "Fresh", "b" * 100, "{}", NEW), ("2-Areas/Stub.md", "Stub", "tiny", "{}", NEW),
        ("Journal/J.md", "J", "tiny", "{}", OLD), ("3-Resources/I1.md", "I1", "b" * 100, "{}", NEW), ("3-Resources/I2.md", "I2", "b" * 100, "{}", NEW), ("4-Archives/A1.md", "A1", "b" * 100, "{}", OLD),
        ("4-Archives/A2.md", "A2", "b" * 100, "{}", OLD), ("3-Resources/Big.md", "Big", big, "{}", NEW), ("x/Dup.md", "", "b" * 100, "{}", NEW), ("y/Dup.md", "", "b" * 100, "{}", NEW),
    ]
    links = [
        ("2-Areas/Leaf.md", "Live", "1-Projects/Live.md"), ("1-Projects/Live.md", "Done", "1-Projects/Done.md"), ("1-Projects/Live.md", "Old", "1-Projects/Old.md"), ("1-Projects/Live.md", "Big", "3-Resources/Big.md"),
        ("3-Resources/I1.md", "I2", "3-Resources/I2.md"), ("4-Archives/A1.md", "A2", "4-Archives/A2.md"), ("Journal/J.md", "pic.PNG#x", None), ("Journal/J.md", "2-Areas/", None), ("Journal/J.md", "2-Areas", None),
        ("Journal/J.md", "Dup", None), ("Journal/J.md", "nowhere", None),
    ]
    raw = [("3-Resources/Big.md", "# T\n## A\nx\n## B\ny\n### C\nz\n"), ("2-Areas/Lone.md", "## A\nx\n" * 5)]
    return (
        spark.createDataFrame(notes, "path string, title string, body string, frontmatter string, mtime double"),
        spark.createDataFrame(links, "source_path string, target string, target_path string"),
        spark.createDataFrame(raw, "path string, raw string"),
    )


def test_audit(vault):
    rows = [(r["type"], r["path"]) for r in health.audit(*vault, NOW, report_unresolved=True).collect()]
    assert rows == [
        ("dangling_link", "Journal/J.md"), ("ambiguous_link", "Journal/J.md"), ("para_drift", "1-Projects/Done.md"), ("para_drift", "1-Projects/Old.md"), ("oversized", "3-Resources/Big.md"),
        ("stub", "2-Areas/Stub.md"), ("orphan", "2-Areas/Lone.md"), ("leaf", "2-Areas/Leaf.md"), ("island", "3-Resources/I1.md"),
    ]


def test_details_and_exclusion(vault):
    notes, links, _ = vault
    d = {r["path"]: r["detail"] for r in health.para_drift(notes, NOW, health.HealthConfig()).collect()}
    assert d == {"1-Projects/Done.md": "status: done, still in 1-Projects", "1-Projects/Old.md": "untouched 546 days (threshold 180)"}
    c = health.HealthConfig(exclude_from_graph=("Live",), island_max_size=0)
    assert c.island_max_size == 3
    kinds = {r["path"]: r["type"] for r in health.orphans_and_leaves(notes, links, NOW, c).collect()}
    assert kinds == {"2-Areas/Lone.md": "orphan", "2-Areas/Leaf.md": "orphan"}
    assert health.suppressed_unresolved(links, notes, c).first()[0] == 1
    assert health.findings_json(health.stubs(notes.limit(0), links, c)) == "[]"


def test_digest_window_cutoff_and_document(spark):
    assert digest.window(date(2026, 6, 16)) == (date(2026, 6, 15), "2026-06-15 (Mon)")
    assert digest.window(date(2026, 6, 15)) == (date(2026, 6, 12), "2026-06-12 (Fri) to 2026-06-14 (Sun)")
    day = date(2024, 6, 30)
    meta = digest.advance({}, 5.0, day, 77.0)
    assert digest.cutoff(meta, day) == 5.0 and digest.cutoff(meta, date(2024, 7, 1)) == 77.0
    assert digest.cutoff({}, day) == datetime(2024, 6, 29, tzinfo=timezone.utc).timestamp() * 1000
    rows = [("b/x.md", "X", 9e11, 9e11), ("1-Projects/y.md", "Y", 8e11, 1.0), ("root.md", "R", 7e11, None), ("a/assets/z.md", "Z", 9e11, None), ("2-Areas/_DAILY-DIGEST.md", "D", 9e11, None), ("old.md", "O", 1.0, 1.0), ("n.md", "N", None, None)]
    notes = spark.createDataFrame(rows, "path string, title string, content_changed_at double, first_indexed_at double")
    text = digest.render(digest.changed_since(notes, 5.0), day, "L")
    assert [x for x in text.split("\n") if x.startswith("#")] == ["## 2024-06-30 — activity for L", "### 1-Projects (1)", "### b (1)", "### Vault root (1)"]
    assert "[[b/x|X]] — new, 1998-07-09" in text and "[[1-Projects/y|Y]] — updated" in text
    doc = digest.document(text, "", day)
    again = digest.document(text, doc, day)
    assert again == doc
    for i in range(40):
        doc = digest.document(f"## 2024-08-{i:02d} — x\n\n### g\n- a", doc, date(2024, 7, 1))
    assert doc.count("\n## ") == digest.MAX_SECTIONS
    assert "_No vault activity" in digest.render(digest.changed_since(notes.limit(0), 0.0), day, "L")


REGISTER = """# Open Actions - Team

| Status | Action | Owner | Review / Due | First | Source |
| --- | --- | --- | --- | --- | --- |
| Open | Call | Marrek | 2024-06-30 | 2024-01-01 | [[m]] |
| ✅ Done | Old | Marrek | 2020-01-01 | x | |
| 🔴 Overdue | Late | Ystra / marrek | soon | x | s |
| Waiting | Wait | Marrek | 2030-01-01 | x | s |
| short | row |

| Open | after the table | Marrek | 2020-01-01 | x | s |
"""


def test_registers(spark):
    files = [("2-Areas/T/OPEN-ACTIONS.md", REGISTER), ("4-Archives/OPEN-ACTIONS.md", REGISTER), ("2-Areas/notes.md", REGISTER), ("Z/OPEN-ACTIONS.md", "no table\r\n")]
    rows = actions.parse_registers(actions.registers(spark.createDataFrame(files, "path string, raw string")))
    today = date(2024, 6, 30)
    got = actions.open_actions(rows, today, "MARREK").orderBy(*actions.review_order()).collect()
    assert [r["action"] for r in got] == ["Wait", "Call", "Late"]  # a decorated state ranks with the unknown ones
    assert [r["is_overdue"] for r in got] == [False, True, False]
    assert {r["action"]: r["bucket"] for r in actions.worklist(rows, today, "marrek").collect()} == {"Call": "overdue", "Late": "overdue", "Wait": "waiting"}
    assert actions.counts(rows, today, "marrek").first().asDict() == {"open": 3, "overdue": 2, "waiting": 1, "needs_review": 0, "mine": 3}
    assert actions.counts(rows, today).first()["mine"] == 0
    doc = actions.review_document(rows, today, "Marrek", "## Priority List\n\nkeep me\n\n---\n")
    assert "keep me" in doc and "My Actions (Marrek)" in doc
    assert "3 open (2 overdue, 0 current, 1 waiting)" in actions.worklist_document(rows, today, "marrek")
    assert '"mine": true' in actions.review_json(rows, today, "marrek")
    assert len(got[0]["stable_id"]) == 12


def test_upsert_keeps_and_moves_times(spark):
    cols = "path string, title string, body string, tags string, frontmatter string, mtime double, content_hash string"
    old = spark.createDataFrame([("same", "t", "b", "", "{}", 1.0, "h1", 10.0, 5.0), ("touched", "t", "b", "", "{}", 1.0, "h1", 10.0, 5.0), ("edited", "t", "b", "", "{}", 1.0, "h1", 10.0, 5.0), ("gone", "t", "b", "", "{}", 1.0, "h1", 10.0, 5.0)], corpus.NOTES)
    new = spark.createDataFrame([("same", "t", "b", "", "{}", 1.0, "h1"), ("touched", "t", "b", "", "{}", 2.0, "h1"), ("edited", "t", "c", "", "{}", 2.0, "h2"), ("new", "t", "b", "", "{}", 900.0, "h3")], cols)
    got = {r["path"]: (r["mtime"], r["content_changed_at"], r["first_indexed_at"]) for r in corpus.upsert(old, new, 100.0).collect()}
    assert got == {"same": (1.0, 10.0, 5.0), "touched": (2.0, 10.0, 5.0), "edited": (2.0, 100.0, 5.0), "new": (900.0, 100.0, 100.0)}
    diff = {r["path"]: r["change"] for r in corpus.diff(old, new).collect()}
    assert diff == {"touched": "changed", "edited": "changed", "new": "new", "gone": "deleted"}


def test_orders_of_reports(spark):
    """Review, due and findings order against plain sorts."""
    import random
    from datetime import date

    from loreloom.operators import actions, health

    rng = random.Random(3)
    rows = [(i, rng.choice(["Open", "overdue", "needs review", "Waiting", "🔥 open", "odd", None]), rng.choice(["b", "A", "a", "c"]) + str(i), "kim", rng.choice(["2024-01-02", "2024-07-01", "soon", None]), "", "", "r.md", rng.choice(["T", "S"])) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, status string, action string, owner string, review_due string, first_raised string, latest_source string, register_path string, register_title string")
    today = date(2024, 6, 30)
    due = lambda r: date.fromisoformat(r[4]) if r[4] and r[4][0] == "2" else date.max
    ranks = {"overdue": 0, "needs review": 1, "waiting": 2, "open": 3}
    got = [r["id"] for r in actions.open_actions(df, today).orderBy(*actions.review_order()).collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (ranks.get((r[1] or "").lower(), 5), due(r), r[8], r[2].lower()))]
    got = [r["id"] for r in actions.worklist(df, today, "KIM").collect()]
    bucket = lambda r: 0 if due(r) <= today or r[1] == "overdue" else 2 if r[1] == "Waiting" else 1
    assert got == [r[0] for r in sorted(rows, key=lambda r: (bucket(r), due(r), r[8], r[2].lower()))]

    names = [f"3-Resources/{c}.md" for c in "abcdefg"]
    notes = spark.createDataFrame([(n, n[:-3], "x" * 300, "", "{}", 1.0) for n in names], "path string, title string, body string, tags string, frontmatter string, mtime double")
    pairs = [("a", "b"), ("b", "c"), ("d", "e"), ("f", "g"), ("a", "nothing")]
    links = spark.createDataFrame([(f"3-Resources/{a}.md", b, f"3-Resources/{b}.md" if len(b) == 1 else None) for a, b in pairs] + [("3-Resources/f.md", "z", None)], "source_path string, target string, target_path string")
    big = health.HealthConfig(island_max_size=2)
    rows = health.audit(notes, links, notes.select("path", F.col("body").alias("raw")), datetime(2024, 6, 30), big, True).collect()
    assert [r["type"] for r in rows] == sorted((r["type"] for r in rows), key=health.ORDER.index)
    assert [r["path"] for r in rows if r["type"] == "dangling_link"] == ["3-Resources/a.md", "3-Resources/f.md"]
    assert [r["path"] for r in rows if r["type"] == "island"] == ["3-Resources/d.md", "3-Resources/f.md"]
