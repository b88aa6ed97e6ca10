import pytest
from pyspark.sql import functions as F

from loreloom.functions import markdown as md
from loreloom.functions.text import best_window, porter
from loreloom.operators import corpus


def one(spark, expr, raw, path="dir/Note name.md"):
    return spark.createDataFrame([(raw, path)], "raw string, path string").select(expr.alias("x")).first()["x"]


NOTE = "---\ntitle: Front\ntags: [a, '#b', 3]\n---\n# Head\n\ntext #c/d and #a [[T|x]] `[[code]]`\n```\n[[fenced]] #no\n```\nend"


def test_whole_note(spark):
    df = spark.createDataFrame([("n/A.md", NOTE, 5.0), ("n/B.md", "---\n: [bad\n---\nbody\n# Later  \n", 6.0), ("n/C.md", "", 7.0), ("n/D.md", "--- no block", 8.0)], "path string, raw string, mtime double")
    rows = {r["path"]: r for r in corpus.parse(df).collect()}
    a = rows["n/A.md"]
    assert a["title"] == "Front" and a["tag_list"] == ["a", "b", "3", "c/d", "no"]
    assert a["link_targets"] == ["T", "code", "fenced"]
    assert a["body"] == "Head\n\ntext #c/d and #a x \nend"
    assert rows["n/B.md"]["title"] == "Later" and rows["n/B.md"]["frontmatter"] == "{}" and rows["n/B.md"]["body"] == "body\nLater"
    assert rows["n/C.md"]["title"] == "C" and rows["n/C.md"]["body"] == ""
    assert rows["n/D.md"]["body"] == "--- no block"


@pytest.mark.parametrize(
    "raw,title",
    [("# One\n# Two", "One"), ("#\n\n## Next", "## Next"), ("text", "Note name"), ("---\ntitle: ''\n---\n# H", "H"), ("---\ntitle: 7\n---\n# H", "H"), ("x\r\n# Win\r\n", "Win")],
)
def test_titles(spark, raw, title):
    assert one(spark, md.title("raw", "path", md.frontmatter_json("raw")), raw) == title


@pytest.mark.parametrize(
    "raw,body",
    [
        ("a\n```py\nx\n```\nb", "a\nb"), ("```\nopen", ""), ("a\n  ```\nx\n```\n```\ny", "a"), ("**bold** _it_", "bold it"), ("[t](u) ![i](j)", "t"), ("a\n\n\n\nb\n---\nc", "a\n\nb\n\nc"),
        ("[[a|b]] [[c]]", "b c"), ("###### deep\n####### seven", "deep\n####### seven"),
    ],
)
def test_bodies(spark, raw, body):
    assert one(spark, md.strip_markdown("raw"), raw) == body


def test_tags_of_all_forms(spark):
    tags = md.tags("raw", md.frontmatter_json("raw"))
    assert one(spark, tags, "---\ntags: a, b c\n---\n") == ["a", "b", "c"]
    assert one(spark, tags, "---\ntags:\n  - '#x'\n  - x\n---\n#Y#z # w (#q)") == ["x", "Y"]
    assert one(spark, tags, "---\ntags:\n---\nnone") == []


def test_targets_and_keys(spark):
    assert one(spark, md.canonical_target("raw"), " Note #Head ") == "Note"
    assert one(spark, md.canonical_link_target("raw"), "Note^blk") == "Note"
    assert one(spark, md.note_keys("path", F.lit("T")), "", "a/b/C.md") == ["a/b/C.md", "a/b/C", "b/C", "C", "T"]
    assert one(spark, md.basename_no_ext("path"), "", "a/C.MD") == "C.MD"


@pytest.mark.parametrize("raw,n", [("## A\nx\n## B\n\n### C\ny\n# D\nz", 2), ("##\nx", 0), ("#### E\nx", 0), ("## A\n#### deep", 1), ("## A\r\nx\r\n", 1)])
def test_substantial_sections(spark, raw, n):
    assert one(spark, md.substantial_sections("raw"), raw) == n


def test_hash_covers_the_four_texts(spark):
    import hashlib

    df = spark.createDataFrame([("t", "b", None, "{}")], "t string, b string, g string, f string")
    assert df.select(md.content_hash("t", "b", "g", "f")).first()[0] == hashlib.sha256(b"t\0b\0\0{}").hexdigest()


@pytest.mark.parametrize("w,s", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("filing", "file"), ("sky", "sky"), ("happy", "happi"), ("adjustment", "adjust"), ("probate", "probat"), ("controll", "control"), ("at", "at"), ("naïve", "naïve")])
def test_porter(w, s):
    assert porter(w) == s


def test_snippet_window():
    text = " ".join(f"w{i}" for i in range(100)) + " target here"
    s = best_window(text, {("target", False)}, 10)
    assert s.startswith("...") and ">>>target<<<" in s
    assert best_window("short target", {("targ", True)}) == "short >>>target<<<"
    assert best_window("", {("x", False)}) == ""


def test_frontmatter_goes_by_the_top_level_type(spark):
    from loreloom.operators import corpus

    docs = [
        "---\nmeta: {tags: [a], title: no}\ntags: x y\ntitle: T\n---\nb", "---\ntags: [p, q r, 3]\nmeta: {tags: 'z'}\n---\nb #w", "---\ntags: 5\ntitle: 7\n---\n# H",
        "plain", '---\ntitle: ""\n---\nx', "---\ntags: '#a, b'\n---\n", "---\nmeta: {title: 'no'}\ntitle: [x]\n---\n",
    ]
    df = spark.createDataFrame([(f"p{i}.md", d, 1.0) for i, d in enumerate(docs)], "path string, raw string, mtime double")
    got = {r["path"]: (r["title"], r["tag_list"]) for r in corpus.parse(df).collect()}
    want = [("T", ["x", "y"]), ("p1", ["p", "q r", "3", "w"]), ("H", []), ("p3", []), ("p4", []), ("p5", ["a", "b"]), ("p6", [])]
    assert [got[f"p{i}.md"] for i in range(len(docs))] == want
