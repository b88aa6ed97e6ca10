"""Consolidating pairwise matches into groups by seed-tree pruning.

Every round each vertex points its neighbourhood (and itself) to the neighbourhood's minimum.
A vertex that no neighbourhood chose is not minimal anywhere: it leaves the graph for good and
hangs in a propagation forest under the least candidate it saw. Candidates seen together stay
connected and go on, so the graph shrinks geometrically. When no edge is left, each surviving seed
names its group, and the seeds' identifiers flow down the forest, last round first.

Vertices are 64-bit hashes of the keys. Among n keys some n*n/2**65 pairs of hashes meet (eleven of 20 billion
keys); the keys concerned, and only they, are hashed anew until all differ, so no two keys can be mixed up. Hash order also makes the rounds few on long chains of ordered names. Hub
vertices are joined apart from the rest (``runtime.skew_join``).

Defined results: pairs with a null or empty end are ignored; a self-pair makes its vertex appear;
repeated pairs and either direction count once; no pairs give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, is_filled, skew_join


def _hash(c: str, seed: int = 0):
    return F.xxhash64(F.lit(seed), F.col(c))


def _hashed(pairs: DataFrame, scratch: Scratch, hash_of=_hash) -> tuple[DataFrame, DataFrame]:
    """(vertices(id, name), edges(u, v) with u < v). Only names whose hashes meet are hashed anew, until all ids differ."""
    names = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    vertices = scratch.write(names.select(hash_of("name").alias("id"), "name"), "vertices")
    moved = None  # (name, moved): ids of the names that were hashed anew
    seed = 0
    while (meet := vertices.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")).take(1):
        seed += 1
        clash = vertices.join(meet, "id", "left_semi").select("name", hash_of("name", seed).alias("moved"))
        moved = scratch.write(clash if moved is None else moved.join(clash, "name", "left_anti").unionByName(clash), "moved")
        old = vertices
        vertices = scratch.write(old.join(moved, "name", "left").select(F.coalesce("moved", "id").alias("id"), "name"), "vertices")
        scratch.drop(old)
    edges = pairs.select("a", "b", hash_of("a").alias("x"), hash_of("b").alias("y"))
    if moved is not None:
        for name, out in (("a", "x"), ("b", "y")):
            edges = edges.join(moved.withColumnRenamed("name", name), name, "left").withColumn(out, F.coalesce("moved", out)).drop("moved")
    edges = edges.select("x", "y").filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
    return vertices, scratch.write(edges, "edges")


#: A vertex with more than 1/500 of a round's pairs, and over so many, is a hub: 500 of them at most by arithmetic.
HUB_SHARE, HUB_LEAST = 500, 50_000


def _prune(graph: DataFrame, scratch: Scratch, round_no: int) -> tuple[DataFrame, DataFrame]:
    """One round: (edges among the surviving candidates, forest(parent, child) of those that left).

    The degrees that tell the hubs are counted along with the minima.
    """
    both = graph.select("u", "v").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
    minima = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    minima = scratch.write(minima, f"minima{round_no}")
    floor = max(HUB_LEAST, 2 * graph.count() // HUB_SHARE)
    hubs = [r["u"] for r in minima.filter(F.col("n") > floor).select("u").collect()]
    pointed = skew_join(both, minima.select("u", "m"), "u", heavy=hubs).select(F.col("v").alias("u"), "m")
    chosen = scratch.write(pointed.unionByName(minima.select("u", "m")).distinct(), f"chosen{round_no}")
    best = chosen.groupBy("u").agg(F.min("m").alias("least"), F.max(F.col("m") == F.col("u")).alias("stays"), F.count(F.lit(1)).alias("n"))
    best = scratch.write(best, f"best{round_no}")
    floor = max(HUB_LEAST, chosen.count() // HUB_SHARE)
    hubs = [r["u"] for r in best.filter(F.col("n") > floor).select("u").collect()]
    rest = skew_join(chosen, best.select("u", "least"), "u", heavy=hubs).filter("m <> least")
    edges = rest.select(F.col("least").alias("u"), F.col("m").alias("v")).distinct()
    edges = scratch.write(edges, f"edges{round_no}")
    scratch.drop(chosen, minima)
    forest = best.filter(~F.col("stays")).select(F.col("least").alias("parent"), F.col("u").alias("child"))
    forest._scratch_path = best._scratch_path
    return edges, forest


def connected_groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(group, member): every key in a pair, with the least key of its group."""
    scratch = Scratch(pairs.sparkSession, "groups")
    slim = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(is_filled("a") & is_filled("b"))
    vertices, edges = _hashed(slim, scratch)
    forests = []
    while edges.take(1):
        pruned, forest = _prune(edges, scratch, len(forests))
        scratch.drop(edges)
        forests.append(forest)
        edges = pruned
        scratch.release_shuffles()
    # seeds flow down, last round first: parents of a round survive it, so they are labelled by then
    labels = None
    for k, forest in enumerate(reversed(forests)):
        if labels is None:
            new = forest.select(F.col("child").alias("id"), F.col("parent").alias("seed"))
        else:
            known = labels.withColumnRenamed("id", "parent")
            new = skew_join(forest, known, "parent", "left").select(F.col("child").alias("id"), F.coalesce("seed", "parent").alias("seed"))
        new = scratch.write(new, f"labels{k}")
        labels = new if labels is None else labels.unionByName(new)
    if labels is None:
        return vertices.select(F.col("name").alias("group"), F.col("name").alias("member"))
    named = vertices.join(labels, "id", "left").select("name", F.coalesce("seed", "id").alias("seed"))
    named = scratch.write(named, "named")
    scratch.drop(vertices, *forests)
    leads = named.groupBy("seed").agg(F.min("name").alias("group"))
    return skew_join(named, leads, "seed").select("group", F.col("name").alias("member"))


def note_groups(links: DataFrame) -> DataFrame:
    """p1_found: (group_path, path) over links.source_path and links.target_path."""
    groups = connected_groups(links, "source_path", "target_path")
    return groups.select(F.col("group").alias("group_path"), F.col("member").alias("path"))


def group_sizes(links: DataFrame) -> DataFrame:
    """Groups by size: (members, n_groups)."""
    per = note_groups(links).groupBy("group_path").agg(F.count(F.lit(1)).alias("members"))
    return per.groupBy("members").agg(F.count(F.lit(1)).alias("n_groups"))
