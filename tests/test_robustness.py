"""Nulls, empty tables, repeated rows and clashing extra columns in the tables that core operators read."""

import pytest

from loreloom.operators import corpus, graph, health, links, search

NOTES = "path string, title string, body string, tags string, frontmatter string, mtime double, content_hash string, content_changed_at double, first_indexed_at double, key string, stage int, rank double, n int"
LINKS = "link_id long, source_path string, target string, target_path string, seen_at double, status string, path string"


@pytest.fixture
def dirty(spark):
    row = lambda p, t, b, m: (p, t, b, None, "{", m, None, None, None, "k", 1, 0.5, 1)
    notes = [row("a.md", "A", "x " * 50_000, 2.0), row("a.md", "A", "x " * 50_000, 2.0), row("a.md", "old", "o", None), row("b.md", None, None, None), row(None, "n", "n", 1.0), row("", "", "", 1.0)]
    ls = [(1, "a.md", "b", "b.md", 1.0, "s", "p"), (1, "a.md", "b", "b.md", 1.0, "s", "p"), (2, "a.md", "b", None, 0.5, "s", "p"), (3, None, "b", "b.md", 1.0, "s", "p"), (4, "a.md", None, "", None, "s", "p"), (5, "b.md", "", "", None, "s", "p")]
    return spark.createDataFrame(notes, NOTES), spark.createDataFrame(ls, LINKS)


def test_current_rows(dirty):
    notes, ls = dirty
    cur = {r["path"]: r["title"] for r in corpus.current_notes(notes).collect()}
    assert cur == {"a.md": "A", "b.md": None, "": ""}
    assert sorted(map(tuple, corpus.current_links(ls).collect())) == [("a.md", "b", "b.md"), ("b.md", "", None)]


def test_operators_accept_them(dirty):
    notes, ls = dirty
    cur, now = corpus.current_notes(notes), __import__("datetime").datetime(2024, 1, 1)
    lk = corpus.current_links(ls)
    assert {r["target"]: r["status"] for r in links.resolve_links(lk, cur).collect()} == {"b": "resolved", "": "dangling"}
    nodes = graph.graph_nodes(cur)
    assert graph.graph_edges(lk, nodes).count() == 1
    assert search.search(cur, "x").count() == 1 and search.search(cur, "").count() == 0
    assert health.audit(cur, lk, cur.selectExpr("path", "body AS raw"), now).columns == ["type", "path", "detail", "severity"]
    assert corpus.migrate(cur, 5.0).filter("content_changed_at > 5").count() == 0


def test_empty_tables(dirty):
    notes, ls = (df.limit(0) for df in dirty)
    now = __import__("datetime").datetime(2024, 1, 1)
    cur, lk = corpus.current_notes(notes), corpus.current_links(ls)
    assert links.resolve_links(lk, cur).collect() == []
    assert search.bm25(cur, "a b").collect() == []
    assert corpus.stats(cur, lk).first().asDict() == {"notes": 0, "links": 0}
    assert health.audit(cur, lk, cur.selectExpr("path", "body AS raw"), now).collect() == []
    assert corpus.freshness(cur, cur).first()["stale"] is False
