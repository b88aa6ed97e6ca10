"""The undirected note graph: edges, degree, components and cores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..runtime import Scratch, heavy_keys, skew_join


def glob_to_regex(pattern: str) -> str:
    """A shell-style pattern over slash paths as a regular expression; raises on a malformed one.

    ``*`` and ``?`` don't cross a slash, classes may be negated by ^ and hold ranges, a backslash takes the next sign literally.
    """
    out, i, n = [], 0, len(pattern)

    def literal(k: int) -> tuple[str, int]:
        if pattern[k] == "\\":
            k += 1
        if k >= n:
            raise ValueError(f"malformed pattern: {pattern!r}")
        return pattern[k], k + 1

    while i < n:
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            i += 1
            negated = i < n and pattern[i] == "^"
            i += negated
            parts = []
            while True:
                if i >= n or (pattern[i] in "-]" and not (pattern[i] == "]" and parts)):
                    raise ValueError(f"malformed pattern: {pattern!r}")
                if pattern[i] == "]":
                    i += 1
                    break
                low, i = literal(i)
                high = low
                if i < n and pattern[i] == "-":
                    if i + 1 >= n or pattern[i + 1] == "]":
                        raise ValueError(f"malformed pattern: {pattern!r}")
                    high, i = literal(i + 1)
                if low <= high:
                    parts.append(f"\\x{{{ord(low):x}}}-\\x{{{ord(high):x}}}")
                elif not parts:
                    parts.append("")
            body = "".join(parts)
            out.append(("(?s:.)" if negated else "(?!)") if not body else f"[{'^' if negated else ''}{body}]")
        else:
            ch, i = literal(i)
            out.append(f"\\x{{{ord(ch):x}}}")
    return "\\A(?:" + "".join(out) + ")\\z"


def is_excluded(patterns: list[str]) -> Column:
    """Whether any pattern matches a note's title, base name or path."""
    out = F.lit(False)
    for p in patterns:
        r = glob_to_regex(p)
        for c in (F.col("title"), md.basename_no_ext("path"), F.col("path")):
            out = out | F.coalesce(c.rlike(r), F.lit(False))
    return out


def graph_nodes(notes: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """(path) of every note that isn't excluded."""
    return notes.filter(~is_excluded(exclude or [])).select("path").distinct()


def graph_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) with a < b, each pair once; both ends must be nodes and differ."""
    e = links.filter(F.col("target_path").isNotNull() & (F.col("source_path") != F.col("target_path")))
    # deduplicated before the ends are looked up: a hub's repeated links shrink to its distinct neighbours, and
    # the adaptive skew join may split what is left of them, as a semi-join keeps only the split side's rows
    e = e.select(F.least("source_path", "target_path").alias("a"), F.greatest("source_path", "target_path").alias("b")).distinct()
    e = e.join(nodes.select(F.col("path").alias("a")), "a", "left_semi")
    return e.join(nodes.select(F.col("path").alias("b")), "b", "left_semi").select("a", "b")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, degree), 0 included."""
    d = both_ways(edges).groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(d.withColumnRenamed("a", "path"), "path", "left").select("path", F.coalesce("degree", F.lit(0)).alias("degree"))


#: A graph of no more edges than these (64 MB of numbers) is walked by one task; larger ones by rounds of joins. Both give the same.
LOCAL_EDGES = 4_000_000


def _numbered(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(path, id) of the nodes, in the order of paths, and (u, v) of the edges, written once; joins on them move numbers, not paths."""
    ids = scratch.write(nodes.orderBy("path").withColumn("id", F.monotonically_increasing_id()), "ids")
    e = edges.join(ids.select(F.col("path").alias("a"), F.col("id").alias("u")), "a").join(ids.select(F.col("path").alias("b"), F.col("id").alias("v")), "b")
    return ids, scratch.write(e.select("u", "v"), "edges")


def _in_one_task(e: DataFrame, walk, column: str) -> DataFrame:
    """(id, column) by a function of the arrays u and v of a bounded graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            t = pa.Table.from_batches(held)
            ids, values = walk(t["u"].to_numpy(), t["v"].to_numpy())
            yield from pa.table({"id": ids, column: values}).to_batches(100_000)

    return e.select("u", "v").repartition(1).mapInArrow(run, f"id long, {column} long")


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node of each one's component): roots hang on lesser roots, paths are halved, until each edge's ends agree."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    lead = np.arange(len(ids))
    while True:
        x, y = lead[a], lead[b]
        apart = x != y
        if not apart.any():
            return ids, ids[lead]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(lead, np.maximum(x, y), np.minimum(x, y))
        while (lead != (up := lead[lead])).any():
            lead = up


def core_numbers(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, coreness): all nodes of the least degree leave together, level by level."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    src, dst = ends, np.concatenate([ends[len(u) :], ends[: len(u)]])
    degree = np.bincount(src, minlength=len(ids))
    dst = dst[np.argsort(src, kind="stable")]
    first = np.concatenate([[0], np.cumsum(degree)])
    core, alive, k, left = np.zeros(len(ids), np.int64), np.ones(len(ids), bool), 0, len(ids)
    while left:
        k = max(k, int(degree[alive].min()))
        go = np.flatnonzero(alive & (degree <= k))
        while len(go):
            core[go], alive[go] = k, False
            left -= len(go)
            n = first[go + 1] - first[go]
            around = dst[np.repeat(first[go] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            near, lost = np.unique(around[alive[around]], return_counts=True)
            degree[near] -= lost
            go = near[degree[near] <= k]
    return ids, core


def components(nodes: DataFrame, edges: DataFrame, scratch: Scratch | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(path, component): the least path of each node's component."""
    scratch = scratch or Scratch(nodes.sparkSession, "components")
    ids, e = _numbered(nodes, edges, scratch)
    lead = _leads(e, scratch, local_edges)
    labelled = ids.join(lead, "id", "left").select("path", F.coalesce("lead", "id").alias("lead"))
    names = ids.select(F.col("id").alias("lead"), F.col("path").alias("component"))
    return skew_join(labelled, names, "lead").select("path", "component")


def _leads(e: DataFrame, scratch: Scratch, local_edges: int) -> DataFrame:
    """(id, lead): the least id of each component that has an edge.

    In rounds: hang all larger and all smaller neighbours on the least one by turns (large-star and small-star),
    a logarithmic number of them; each round is written to the shared folder.
    """
    n = e.count()
    if n <= local_edges:
        return scratch.write(_in_one_task(e, least_reachable, "lead"), "leads")
    while True:
        # large star: every larger neighbour of u points to the least of u and its neighbours
        sym = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = skew_join(sym.filter("v > u"), low, "u").select(F.col("m").alias("u"), "v").distinct()
        large = scratch.write(large, "large")
        # small star: u and its smaller neighbours point to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = skew_join(down, low, "u").select("m", F.col("v").alias("w")).filter("m <> w").unionByName(low.select("m", F.col("u").alias("w")))
        new = scratch.write(small.select(F.col("m").alias("u"), F.col("w").alias("v")).distinct(), "small")
        before, n = n, new.count()
        same = n == before and not new.join(e, ["u", "v"], "left_anti").take(1)
        scratch.drop(e, large)
        e = new
        if same:
            return e.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("lead"))


def _waves(scratch: Scratch, sym: DataFrame, nxt: DataFrame, hubs: list, local_edges: int) -> DataFrame:
    """(id, h, moved, was) with every fall of the round carried to the end of its chain at once.

    A node at value h with exactly h neighbours that reach h is critical: it falls as soon as one of them does. So
    where nodes of one value that fall or are critical hang together, one that falls takes all of them below it.
    """
    loose = scratch.write(nxt.filter("moved OR support = was").select("id", "was", "moved"), "loose")
    at_a = loose.select(F.col("id").alias("a"), F.col("was").alias("h_a"))
    at_b = loose.select(F.col("id").alias("b"), F.col("was").alias("h_b"))
    ties = skew_join(skew_join(sym.filter("a < b"), at_a, "a", heavy=hubs), at_b, "b", heavy=hubs).filter("h_a = h_b")
    inner = Scratch(scratch.spark, "waves")
    lead = _leads(inner.write(ties.select(F.col("a").alias("u"), F.col("b").alias("v")), "ties"), inner, local_edges)
    group = scratch.write(loose.join(lead, "id", "left").select("id", "moved", F.coalesce("lead", "id").alias("lead")), "groups")
    falls = group.filter("moved").select("lead").distinct()
    taken = group.filter("NOT moved").join(falls, "lead", "left_semi").select("id", F.lit(True).alias("taken"))
    out = nxt.join(taken, "id", "left").select(
        "id", F.when(F.col("taken"), F.col("was") - 1).otherwise(F.col("h")).alias("h"), (F.col("moved") | F.coalesce("taken", F.lit(False))).alias("moved"), "was"
    )
    out = scratch.write(out, "fallen")
    inner.clear()
    scratch.drop(nxt, loose, group)
    return out


#: Rounds of ``coreness`` after which one also follows every chain to its end; no bound on the rounds.
WAVE_EVERY = 32


def coreness(nodes: DataFrame, edges: DataFrame, wave_every: int = WAVE_EVERY, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(path, coreness) of every node."""
    scratch = Scratch(nodes.sparkSession, "cores")
    ids, e = _numbered(nodes, edges, scratch)
    cores = _in_one_task(e, core_numbers, "h") if e.count() <= local_edges else _lowered(e, scratch, wave_every, local_edges)
    return ids.join(cores, "id", "left").select("path", F.coalesce("h", F.lit(0).cast("long")).alias("coreness"))


def _lowered(e: DataFrame, scratch: Scratch, wave_every: int, local_edges: int) -> DataFrame:
    """(id, h) by lowering every node to the h-index of its neighbours until nothing moves.

    A node's h-index needs only how many neighbours reach each value up to its own, so neighbours are
    counted by capped value before the shuffle; no task holds a hub's whole neighbourhood. A round looks only at
    nodes with a neighbour that moved in the last one. Along a chain the values settle one node a round, so every
    ``wave_every`` rounds whole chains are lowered at once; in that round all nodes are looked at.
    """
    sym = scratch.write(e.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(e.select(F.col("v").alias("a"), F.col("u").alias("b"))), "sym")
    hubs = heavy_keys(sym, "a")
    value = scratch.write(sym.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("h")), "h0")
    k, moved, last = 0, True, None
    while moved:
        k += 1
        wave = k % wave_every == 0
        around = sym
        if last is not None and not wave:
            touched = scratch.write(skew_join(sym, last.select(F.col("id").alias("b")), "b", "left_semi", hubs).select("a").distinct(), "touched")
            around = skew_join(sym, touched, "a", "left_semi", hubs)
        own = value.select(F.col("id").alias("a"), F.col("h").alias("own"))
        seen = skew_join(around, value.select(F.col("id").alias("b"), "h"), "b", heavy=hubs).select("a", "h")
        capped = skew_join(seen, own, "a", heavy=hubs).select("a", "own", F.least("h", "own").alias("h"))
        tally = capped.groupBy("a", "own", "h").agg(F.count(F.lit(1)).alias("n"))
        # from high to low: the first value whose cumulated count reaches it
        steps = tally.groupBy("a", "own").agg(
            F.sort_array(F.collect_list(F.struct("h", "n")), asc=False).alias("s"), F.sum(F.when(F.col("h") == F.col("own"), F.col("n"))).alias("support")
        )
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("best"))
        fold = lambda acc, x: F.struct(
            (acc["seen"] + x["n"]).alias("seen"), F.greatest(acc["best"], F.least(x["h"], acc["seen"] + x["n"])).alias("best")
        )
        new = steps.select(F.col("a").alias("id"), F.aggregate("s", start, fold, lambda acc: acc["best"]).alias("new"), "support")
        nxt = value.select("id", "h").join(new, "id", "left").select(
            "id", F.coalesce("new", "h").alias("h"), F.coalesce(F.col("new") != F.col("h"), F.lit(False)).alias("moved"), F.col("h").alias("was"), F.coalesce("support", F.lit(0)).alias("support")
        )
        nxt = scratch.write(nxt, f"h{k}")
        moved = bool(nxt.filter("moved").take(1))
        if moved and wave:
            nxt = _waves(scratch, sym, nxt, hubs, local_edges)
        if last is not None and not wave:
            scratch.drop(touched)
        scratch.drop(value)
        value, last = nxt, nxt.filter("moved")
    return value.select("id", "h")


def core_histogram(cores: DataFrame) -> DataFrame:
    return cores.groupBy("coreness").agg(F.count(F.lit(1)).alias("nodes"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, component_count, giant_ratio, max_core; zeroes for an empty graph."""
    scratch = Scratch(nodes.sparkSession, "graph")
    nodes, edges = scratch.write(nodes, "nodes"), scratch.write(edges, "pairs")
    sizes = component_sizes(components(nodes, edges, scratch))
    out = sizes.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("node_count"), F.count(F.lit(1)).alias("component_count"),
        F.coalesce(F.round(F.max("size") / F.sum("size"), 6), F.lit(0.0)).alias("giant_ratio"),
    )
    n_edges = edges.agg(F.count(F.lit(1))).scalar()
    top = coreness(nodes, edges).agg(F.coalesce(F.max("coreness"), F.lit(0))).scalar()
    return out.select("node_count", n_edges.alias("edge_count"), "component_count", "giant_ratio", top.alias("max_core"))


def component_sizes(comp: DataFrame) -> DataFrame:
    """(component, size), smallest first, then by the first member."""
    return comp.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy("size", "component")
