import random

import numpy as np
import pytest

from loreloom.operators import context, graph, links

NOTES = [("Alpha.md", "Alpha", "a body", "topic"), ("sub/Beta.md", "Beta", "b", ""), ("x/Dup.md", "D1", "", None), ("y/Dup.md", "D2", "", None), ("z/Gamma.md", "Same", "", None), ("z/Delta.md", "Same", "", None), ("É.md", "Accent", "", None), ("case.md", "c1", "", None), ("Case.md", "c2", "", None)]
TARGETS = {
    "Alpha": ("resolved", "Alpha.md"), "alpha.MD": ("resolved", "Alpha.md"), "Beta": ("resolved", "sub/Beta.md"), "sub/beta#Head": ("resolved", "sub/Beta.md"), "other/Beta": ("dangling", None),
    "Dup": ("ambiguous", None), "x/Dup": ("resolved", "x/Dup.md"), "Same": ("ambiguous", None), "D1": ("resolved", "x/Dup.md"), "é": ("resolved", "É.md"), "case": ("ambiguous", None),
    "": ("dangling", None), "#frag": ("dangling", None), "Alpha^blk": ("dangling", None), "nothing": ("dangling", None),
}


@pytest.fixture
def notes(spark):
    return spark.createDataFrame(NOTES, "path string, title string, body string, tags string")


def test_precedence(spark, notes):
    t = spark.createDataFrame([(x,) for x in [*TARGETS, "Alpha"]] + [(None,)], "target string")
    got = {r["target"]: (r["status"], r["target_path"]) for r in links.resolve_targets(t, notes).collect()}
    assert got == TARGETS


def test_incremental_equals_full(spark, notes):
    typed = [("s.md", t) for t in TARGETS] + [("t.md", "Dup")]
    raw = spark.createDataFrame(typed, "source_path string, target string")
    full = links.resolve_links(raw, notes).select("source_path", "target", "target_path")
    for gone in ("x/Dup.md", "Alpha.md", "z/Delta.md"):
        rest = notes.filter(notes.path != gone)
        touched = notes.filter(notes.path == gone)
        key = lambda df: sorted((tuple(map(str, r)) for r in df.collect()))
        want = links.resolve_links(raw, rest).select("source_path", "target", "target_path")
        assert key(links.re_resolve(full, rest, touched)) == key(want)
        assert key(links.re_resolve(want, notes, touched)) == key(full)  # and back again


def peel(nodes, edges):
    adj = {n: set() for n in nodes}
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    core, k = {}, 0
    while adj:
        n = min(adj, key=lambda x: len(adj[x]))
        k = max(k, len(adj[n]))
        core[n] = k
        for m in adj.pop(n):
            adj[m].discard(n)
    return core


def test_components_cores_and_stats(spark):
    rng = random.Random(7)
    names = [f"n{i:02d}" for i in range(40)]
    pairs = {tuple(sorted(rng.sample(names[:25], 2))) for _ in range(70)} | {("n30", "n31"), ("n31", "n32")}
    nodes = spark.createDataFrame([(n,) for n in names], "path string")
    edges = spark.createDataFrame(sorted(pairs), "a string, b string")
    lead = {n: n for n in names}
    for _ in names:
        for a, b in pairs:
            lead[a] = lead[b] = min(lead[a], lead[b])
    core = peel(names, pairs)
    for most in (graph.LOCAL_EDGES, 0):  # in one task, and in rounds
        assert {r["path"]: r["component"] for r in graph.components(nodes, edges, local_edges=most).collect()} == lead
        assert {r["path"]: r["coreness"] for r in graph.coreness(nodes, edges, local_edges=most).collect()} == core
    assert [r["size"] for r in graph.component_sizes(graph.components(nodes, edges)).collect()] == sorted(list(lead.values()).count(c) for c in set(lead.values()))
    s = graph.graph_stats(nodes, edges).first()
    assert (s["node_count"], s["edge_count"], s["component_count"], s["max_core"]) == (40, len(pairs), len(set(lead.values())), max(core.values()))


def test_cores_of_long_chains(spark):
    chain = [(f"c{i:05d}", f"c{i + 1:05d}") for i in range(2099)]  # settles one node a round from each end
    fan = [(f"d{i:05d}", f"d{i + 1:05d}") for i in range(2099)] + [("d", f"d{i:05d}") for i in range(2100)]
    ring = [(f"r{i:05d}", f"r{(i + 1) % 50:05d}") for i in range(50)] + [("r00000", "t00000")] + [(f"t{i:05d}", f"t{i + 1:05d}") for i in range(299)]
    pairs = {tuple(sorted(e)) for e in chain + fan + ring}
    names = sorted({n for e in pairs for n in e} | {"alone"})
    nodes, edges = spark.createDataFrame([(n,) for n in names], "path string"), spark.createDataFrame(sorted(pairs), "a string, b string")
    core = {n: {"c": 1, "d": 2, "r": 2, "t": 1, "a": 0}[n[0]] for n in names}
    assert {r["path"]: r["coreness"] for r in graph.coreness(nodes, edges).collect()} == core
    assert {r["path"]: r["coreness"] for r in graph.coreness(nodes, edges, wave_every=5, local_edges=0).collect()} == core


def test_walks_of_one_task():
    chain = np.arange(200_000)
    ids, core = graph.core_numbers(chain[:-1], chain[1:])
    assert len(ids) == 200_000 and (core == 1).all()
    mixed = np.random.default_rng(1).permutation(200_000)
    ids, lead = graph.least_reachable(mixed[:-1], mixed[1:])
    assert (lead == 0).all()
    for seed in range(30):
        rng = random.Random(seed)
        pairs = {tuple(sorted(rng.sample(range(50), 2))) for _ in range(rng.randint(1, 120))}
        u, v = np.array(sorted(pairs)).T
        want = peel({n for e in pairs for n in e}, pairs)
        assert dict(zip(*(x.tolist() for x in graph.core_numbers(u, v)))) == want


def test_waves_in_every_round_change_no_core(spark):
    for seed in range(3):
        rng = random.Random(seed)
        names = [f"n{i:02d}" for i in range(60)]
        pairs = {tuple(sorted(rng.sample(names, 2))) for _ in range(60 + 50 * seed)}
        nodes, edges = spark.createDataFrame([(n,) for n in names], "path string"), spark.createDataFrame(sorted(pairs), "a string, b string")
        assert {r["path"]: r["coreness"] for r in graph.coreness(nodes, edges, wave_every=1, local_edges=0).collect()} == peel(names, pairs)


def test_empty_graph(spark):
    nodes, edges = spark.createDataFrame([], "path string"), spark.createDataFrame([], "a string, b string")
    assert graph.graph_stats(nodes, edges).first().asDict() == {"node_count": 0, "edge_count": 0, "component_count": 0, "giant_ratio": 0.0, "max_core": 0}


def test_edges_drop_loops_strangers_and_direction(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "path string")
    ls = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("a", "x"), ("a", None)], "source_path string, target_path string")
    assert [tuple(r) for r in graph.graph_edges(ls, nodes).collect()] == [("a", "b")]


@pytest.mark.parametrize(
    "glob,text,hit",
    [("*.md", "a.md", True), ("*.md", "a/b.md", False), ("Daily/*", "Daily/x", True), ("[a-c]?", "bz", True), ("[^a-c]", "b", False), ("[^a-c]", "d", True), (r"\*", "*", True), ("a[]]b", "a]b", None), ("[]", "", None), ("[a-", "", None), ("x\\", "x", None)],
)
def test_globs(spark, glob, text, hit):
    if hit is None:
        with pytest.raises(ValueError):
            graph.glob_to_regex(glob)
    else:
        assert spark.range(1).selectExpr("1").count() and spark.createDataFrame([(text,)], "t string").filter(f"t RLIKE r'{graph.glob_to_regex(glob)}'").count() == int(hit)


def test_context(spark, notes):
    ls = spark.createDataFrame(
        [("Alpha.md", "Beta", "sub/Beta.md"), ("x/Dup.md", "Alpha", "Alpha.md"), ("sub/Beta.md", "x/D2", "y/Dup.md"), ("Alpha.md", "none", None), ("y/Dup.md", "far/Alpha", None)],
        "source_path string, target string, target_path string",
    )
    got = {r["path"]: r["relationship"] for r in context.expand(notes, ls, "Alpha", 2).collect()}
    assert got == {"sub/Beta.md": "outgoing_link", "x/Dup.md": "incoming_link", "y/Dup.md": "incoming_link"}
    assert [r["relationship"] for r in context.expand(notes, ls, "Dup").collect()] == ["not_found"]
    top = context.topic(notes, ls, "body").collect()
    assert top[0]["path"] == "Alpha.md" and top[0]["relevance"] == "direct_match"
    assert {r["path"]: r["relevance"] for r in top}["sub/Beta.md"] == "linked_from:Alpha.md"


def test_many_folders_with_an_index_note(spark):
    """Two thousand notes of one base name, each linked with its folder: the join's rows grow with the links, not their square."""
    notes = spark.createDataFrame([(f"area/f{i}/index.md", "index") for i in range(2000)], "path string, title string")
    linked = spark.createDataFrame([(f"f{i}/index#part {j}",) for i in range(2000) for j in range(2)] + [("index",), ("f7/INDEX.md",), ("f7/index.MD",), ("7/index",)], "target string")
    got = {r["target"]: (r["status"], r["target_path"]) for r in links.resolve_targets(linked, notes).collect()}
    assert all(got[f"f{i}/index#part {j}"] == ("resolved", f"area/f{i}/index.md") for i in range(2000) for j in range(2))
    assert got["index"][0] == "ambiguous" and got["f7/INDEX.md"][1] == "area/f7/index.md" and got["7/index"][0] == got["f7/index.MD"][0] == "dangling"
    keys = links.index_keys(notes)
    assert keys.count() == keys.select("stage", "key").distinct().count()
