import re
import unicodedata

import pytest

from loreloom.operators import search

NOTES = [
    ("a.md", "Fox", "the quick brown fox jumps over the lazy dog", "animals"), ("b.md", "Dogs", "dog dog lazy", "animals party"), ("c.md", "Café", "naïve résumé of foo-bar", None),
    ("d.md", None, None, None), ("e.md", "Plan", "brown quick thing", "art"),
]


@pytest.fixture
def notes(spark):
    return spark.createDataFrame(NOTES, "path string, title string, body string, tags string")


def paths(df):
    return sorted(r["path"] for r in df.collect())


@pytest.mark.parametrize(
    "query,want",
    [
        ("quick brown", ["a.md", "e.md"]), ('"quick brown"', ["a.md"]), ("foo-bar", ["c.md"]), ("resume", ["c.md"]), ("CAFÉ", ["c.md"]), ("qui*", ["a.md", "e.md"]), ("dog NOT fox", ["b.md"]),
        ("fox OR plan", ["a.md", "e.md"]), ("title: dogs", ["a.md", "b.md"][1:]), ("{title tags}: dog", ["b.md"]), ("-title: dogs", ["a.md", "b.md"]), ("-{title body}: dog", []), ("{fox} dog", None), ("dog* -fox", None), ("NEAR(quick fox, 1)", ["a.md"]), ("NEAR(quick dog, 2)", []), ("^the", ["a.md"]), ("(fox OR plan) AND brown", ["a.md", "e.md"]),
        ("quick + brown*", ["a.md"]), ("AND", None), ("nope: x", None), ('"', None),
    ],
)
def test_expressions(notes, query, want):
    if want is None:
        with pytest.raises(search.QueryError):
            search.parse_query(query if re.search(r'["+*(){}]|\b(AND|OR|NOT|NEAR)\b', query) else f"({query})")
    else:
        q = query if re.search(r"[:^]", query) is None else f"({query})"
        assert paths(search.matches(notes, q)) == want


QUERIES = [
    "budget shared", '"open items" OR meetings', "proto* NOT survey", "(budget OR dashboard) AND retro NOT vault", "title: survey OR tags: finance", "NEAR(budget draft, 12)", 'NEAR("open items" list plan, 6)',
    "counted items", "the budget budget", '{title tags}: (plan OR survey)', "-body: (budget)", "(^budget)", "отчёт", "отч* OR план*", "meetin* + note*", "a*",
]


def test_matches_and_ranks_equal_a_public_full_text_engine(spark, data_dir):
    """Against SQLite's FTS5, whose documented behaviour the search follows."""
    import sqlite3

    from loreloom.operators import corpus

    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(path UNINDEXED, title, body, tags, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("SQLite without FTS5")
    notes = corpus.current_notes(spark.read.parquet(f"{data_dir}/notes.parquet"), "title", "body", "tags").filter("body NOT RLIKE '[\\\\x{300}-\\\\x{36F}]'")
    rows = [tuple(r) for r in notes.select("path", "title", "body", "tags").collect()]
    con.executemany("INSERT INTO f VALUES (?, ?, ?, ?)", rows)
    index = search.FullText.of(notes)
    hits = 0
    for q in QUERIES:
        want = dict(con.execute("SELECT path, rank FROM f WHERE f MATCH ?", (search.match_expression(q) if ":" not in q and "^" not in q else q,)).fetchall())
        got = {r["path"]: r["rank"] for r in search.bm25(index, q if ":" not in q and "^" not in q else f"({q})", None).collect()}
        assert got.keys() == want.keys(), q
        assert all(abs(got[p] - want[p]) < 1e-6 * (1 + abs(want[p])) for p in want), q
        assert paths(search.matches(index, q if ":" not in q and "^" not in q else f"({q})")) == sorted(want)
        hits += len(want)
    assert hits > 100


WORDS = ["новый", "отчёт", "회의", "हिन्दी", "会議が", "tiếng", "άνθρωπος", "ΆΝΘΡΩΠΟΣ", "İstanbul", "Straße", "ﬁne", "x²", "naïve", "e\u0301te\u0301", "ǆ", "ไทย", "עברית", "العربية", "foo_bar", "ÅNGSTRÖM", "Ⅷ", "ꙗ", "\U0001d54f"]


def test_every_script_finds_its_own_words(spark):
    df = spark.createDataFrame([(w, "", f"a {w} b", "") for w in WORDS], "path string, title string, body string, tags string")
    index = search.FullText.of(df)
    for w in WORDS:
        found = search.search(index, w, 50)
        rows = {r["path"]: r["snippet"] for r in found.collect()}
        assert w in rows and (">>>" in rows[w] or w in ("हिन्दी",)), w


def test_words_of_a_snippet_are_those_of_the_index(spark):
    """Over all letters that the JVM's and Python's tables both know."""
    from loreloom.functions.text import ACCENTS, WORD

    signs = [chr(c) for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(signs)], "i int, c string")
    fold = str.maketrans(*search.marked_letters())
    known = {r["i"]: list(r["t"]) for r in df.filter("c RLIKE '\\\\P{Cn}'").select("i", search.tokens("c").alias("t")).collect()}
    wrong = [signs[i] for i, t in known.items() if [w for m in WORD.finditer(signs[i]) if (w := ACCENTS.sub("", m[0].lower()).translate(fold))] != t]
    assert len(known) > 60_000 and len(wrong) < 30, wrong[:50]


def test_like_filters_keep_their_wildcards(notes):
    assert paths(search.search(notes, "dog", tag="p_rty")) == ["b.md"]
    assert paths(search.search(notes, "brown", prefix="%.md")) == ["a.md", "e.md"]
    assert paths(search.search(notes, "brown", prefix="\\")) == []


def test_blocks_of_words_change_nothing(notes, monkeypatch):
    import pyarrow as pa

    rows = [(p, (t or "").split(), (b or "").split(), (g or "").split()) for p, t, b, g in NOTES]
    batch = pa.table(dict(zip(("path", *search.FIELDS), map(list, zip(*rows))))).to_batches()[0]
    collect = lambda: sorted(map(str, (r for b in search._postings(iter([batch])) for r in b.to_pylist())))
    whole = collect()
    for n in (1, 5, 12):
        monkeypatch.setattr(search, "BLOCK_WORDS", n)
        assert collect() == whole and len(list(search._blocks(batch))) > 1


def test_a_query_reads_its_terms_alone(spark, notes):
    index = search.FullText.of(notes)
    plan = search.matches(index, "quick brown")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part" in plan.split("PartitionFilters")[1][:80] and "In(term" in plan.split("PushedFilters")[1]


def test_filters_are_substrings_and_fallback_contains(notes):
    assert paths(search.search(notes, "brown", tag="ART")) == ["e.md"]
    assert paths(search.search(notes, "dog", tag="art")) == ["b.md"]  # inside "party"
    assert paths(search.search(notes, "brown", prefix="A")) == ["a.md"]
    assert paths(search.search(notes, "fox (")) == []
    assert search.search(notes, '"lazy').columns == ["path", "title", "snippet", "tags", "rank"]
    row = search.search(notes, "lazy dog").first()
    assert ">>>lazy<<<" in row["snippet"]


def test_stems(spark):
    from loreloom.functions.text import porter

    words = ["jumps", "jumped", "jumping", "jump", "ponies", "pony", "filing", "files", "hopping", "sensibility", "sensible", "happy", "happiness", "relational", "relate", "dog"]
    df = spark.createDataFrame([(w, "", f"a {w} b", "") for w in words], "path string, title string, body string, tags string")
    for q in ("jumping", "pony", "file", "hop", "sensibilities", "happy", "relating"):
        assert paths(search.matches(df, q)) == sorted(w for w in words if porter(w) == porter(q)), q
    assert paths(search.bm25(df, '"a jump"', None)) == ["jump", "jumped", "jumping", "jumps"]
