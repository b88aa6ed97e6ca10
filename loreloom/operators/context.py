"""Context around a note or a topic: neighbours by link, a second hop, and siblings by tag."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .links import RESOLVED, resolve_one
from .search import FullText, as_index, below, search, with_tag

# Tags that say nothing about a topic: fixed values.
TRIVIAL_TAGS = ("active", "work", "personal")


def _shown(notes: DataFrame) -> DataFrame:
    """(path, title, snippet): bodies are clipped before any join moves them."""
    return notes.select("path", "title", F.substring("body", 1, 200).alias("snippet"))


def outgoing(links: DataFrame, notes: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_path, path, title, snippet) of the notes that the sources (path) link to; unresolved links give none."""
    mine = links.filter("target_path IS NOT NULL").join(sources.select(F.col("path").alias("source_path")).distinct(), "source_path", "left_semi")
    to = mine.groupBy("source_path", F.col("target_path").alias("path")).agg(F.min("target").alias("typed"))
    out = to.join(_shown(notes), "path")
    return out.select("source_path", "path", F.coalesce(F.nullif("title", F.lit("")), "typed").alias("title"), "snippet")


def incoming(links: DataFrame, notes: DataFrame, title: str | Column) -> DataFrame:
    """(path, title, snippet) of the notes whose typed targets are the title or end with it after a slash."""
    t = F.lit(title) if isinstance(title, str) else title
    named = links.filter((t != "") & ((F.col("target") == t) | F.endswith(F.lower("target"), F.lower(F.concat(F.lit("/"), t)))))
    sources = named.select(F.col("source_path").alias("path")).distinct()
    return _shown(notes).join(sources, "path", "left_semi").select("path", "title", "snippet")


def incoming_by_path(links: DataFrame, notes: DataFrame, path: str) -> DataFrame:
    """The same by resolved path instead of typed title."""
    sources = links.filter(F.col("target_path") == path).select(F.col("source_path").alias("path")).distinct()
    return _shown(notes).join(sources, "path", "left_semi").select("path", "title", "snippet")


def _first_of_each(df: DataFrame, key: str, *order: str) -> DataFrame:
    w = W.Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def expand(notes: DataFrame, links: DataFrame, seed: str, depth: int = 1, limit: int = 20) -> DataFrame:
    """(path, title, relationship, snippet) around a note named by path or title.

    Outgoing links first, then incoming ones, then what those link to (depth two or more); a note keeps
    its first relationship and the seed never returns. A seed that isn't one note gives a not_found row.
    """
    spark = notes.sparkSession
    depth, limit = (depth if depth > 0 else 1), (limit if limit > 0 else 20)
    found = [r for r in resolve_one(seed, notes).collect() if r["status"] == RESOLVED]
    schema = "path string, title string, relationship string, snippet string"
    if not found:
        return spark.createDataFrame([(seed, seed, "not_found", "")], schema)
    path = found[0]["target_path"]
    title = notes.filter(F.col("path") == path).select("title").first()["title"] or ""
    here = spark.createDataFrame([(path,)], "path string")
    out1 = outgoing(links, notes, here).select("path", "title", F.lit("outgoing_link").alias("relationship"), "snippet", F.lit(1).alias("phase"))
    in1 = incoming(links, notes, title).select("path", "title", F.lit("incoming_link").alias("relationship"), "snippet", F.lit(2).alias("phase"))
    near = _first_of_each(out1.unionByName(in1).filter(~F.col("path").isin(path, seed)), "path", "phase")
    if depth >= 2:
        hop = outgoing(links, notes, near).select("path", "title", F.lit("2nd_hop").alias("relationship"), "snippet", F.lit(3).alias("phase"))
        near = _first_of_each(near.unionByName(hop.filter(~F.col("path").isin(path, seed))), "path", "phase", "title")
    return near.orderBy("phase", "path").limit(limit).drop("phase")


def topic(index: DataFrame | FullText, links: DataFrame, text: str, limit: int = 15, prefix: str | None = None) -> DataFrame:
    """(path, title, relevance, snippet, tags) for a topic: matches, what the best three link to, and notes that
    share the matches' most frequent telling tag. Every note keeps its first relevance."""
    index = as_index(index)
    notes, spark = index.notes, links.sparkSession
    limit = limit if limit > 0 else 15
    hits = search(index, text, math.ceil(limit * 0.6), None, prefix).collect()  # at most 0.6 of the limit
    rows = [(r["path"], r["title"], "direct_match", r["snippet"], r["tags"], i) for i, r in enumerate(hits)]
    schema = "path string, title string, relevance string, snippet string, tags string, ord int"
    parts = [spark.createDataFrame(rows, schema)]
    for k, r in enumerate(hits[:3]):
        e = expand(notes, links, r["path"], 1, 5).filter("relationship <> 'not_found'")
        order = F.row_number().over(W.Window.orderBy(F.col("relationship").desc(), "path"))
        parts.append(e.select("path", "title", F.lit(f"linked_from:{r['path']}").alias("relevance"), "snippet", F.lit(None).cast("string").alias("tags"), (order + 1000 * (k + 1)).alias("ord")))
    counts: dict[str, int] = {}
    for r in hits:
        for t in (r["tags"] or "").split():
            if t not in TRIVIAL_TAGS and len(t.encode()) > 2:
                counts[t] = counts.get(t, 0) + 1
    if counts:
        tag = min(counts, key=lambda t: (-counts[t], t))
        sib = below(with_tag(notes, tag), prefix).orderBy("path").limit(5)
        order = F.row_number().over(W.Window.orderBy("path"))
        parts.append(sib.select("path", "title", F.lit(f"shared_tag:{tag}").alias("relevance"), F.substring("body", 1, 150).alias("snippet"), "tags", (order + 10_000).alias("ord")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # tag siblings only fill up what the other phases leave open, which the order does
    top = _first_of_each(every, "path", "ord").orderBy("ord").limit(limit)
    own = notes.select("path", F.col("tags").alias("own_tags")).join(F.broadcast(top.select("path")), "path", "left_semi")
    return top.join(own, "path", "left").orderBy("ord").select("path", "title", "relevance", "snippet", F.coalesce(F.nullif("tags", F.lit("")), "own_tags", F.lit("")).alias("tags"))
