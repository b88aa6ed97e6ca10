"""Link resolution by precedence: exact path, then base name, then title; ambiguity is an outcome of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..runtime import skew_join

RESOLVED, AMBIGUOUS, DANGLING = "resolved", "ambiguous", "dangling"


def index_keys(notes: DataFrame) -> DataFrame:
    """(stage, key, one, other) of every way a note may be named, lower case, with the least and greatest path that it names.

    A base name may be typed with the folders it lies below: each trailing part of a path, without extension, is a key.
    Reduced to two paths a key before anything is joined, so a name borne by many notes is one row.
    """
    low = F.lower("path")
    parts = F.split(F.lower(F.regexp_replace("path", r"\.md\z", "")), "/")
    n = F.size(parts)
    # only notes are named with their folders; of other files the base name alone counts
    tails = F.transform(F.sequence(F.when(F.endswith(low, F.lit(".md")), 1).otherwise(n), n), lambda i: F.struct(F.lit(2).alias("stage"), F.array_join(F.slice(parts, i, n), "/").alias("key")))
    whole = F.array(F.struct(F.lit(1).alias("stage"), low.alias("key")), F.struct(F.lit(3).alias("stage"), F.lower(F.nullif("title", F.lit(""))).alias("key")))
    each = notes.select("path", F.explode(F.concat(whole, tails)).alias("k")).filter("k.key IS NOT NULL")
    return each.groupBy("k.stage", "k.key").agg(F.min("path").alias("one"), F.max("path").alias("other"))


def resolve_targets(targets: DataFrame, notes: DataFrame, target: str = "target") -> DataFrame:
    """(target, status, target_path) of each distinct target, by one equality join on what the targets name.

    Targets that differ in fragments alone are resolved once. Every key has one row in the index, so the join
    has at most four rows a name.
    """
    t = targets.select(F.col(target).alias("target")).filter("target IS NOT NULL").distinct()
    t = t.withColumn("canon", md.canonical_target("target"))
    t = t.select("target", F.lower("canon").alias("name"), F.lower(F.regexp_replace("canon", r"\.md\z", "")).alias("bare"))
    names = t.select("name", "bare").filter("name <> ''").distinct()
    keys = F.array(
        F.struct(F.lit(1).alias("stage"), F.col("name").alias("key")),
        F.struct(F.lit(1).alias("stage"), F.concat("name", F.lit(".md")).alias("key")),
        F.struct(F.lit(2).alias("stage"), F.col("bare").alias("key")),
        F.struct(F.lit(3).alias("stage"), F.col("name").alias("key")),
    )
    asked = names.select("name", "bare", F.explode(keys).alias("k")).select("name", "bare", "k.stage", "k.key")
    hits = asked.join(index_keys(notes), ["stage", "key"])
    per_stage = hits.groupBy("name", "bare", "stage").agg(F.min("one").alias("one"), F.max("other").alias("other"))
    first = per_stage.groupBy("name", "bare").agg(F.min(F.struct("stage", "one", "other")).alias("b"))
    single = F.col("b.one") == F.col("b.other")
    # a name typed with many fragments is hot on this side: the adaptive join splits it
    return t.join(first, ["name", "bare"], "left").select(
        "target",
        F.when(F.col("b").isNull(), DANGLING).when(single, RESOLVED).otherwise(AMBIGUOUS).alias("status"),
        F.when(single, F.col("b.one")).alias("target_path"),
    )


def resolve_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(source_path, target, target_path, status) of every link."""
    done = resolve_targets(links, notes)
    return skew_join(links.select("source_path", "target"), done, "target", "left").select("source_path", "target", "target_path", "status")


def resolve_one(target: str, notes: DataFrame) -> DataFrame:
    """(target, status, target_path) of a single target."""
    return resolve_targets(notes.sparkSession.createDataFrame([(target,)], "target string"), notes)


def affected_targets(links: DataFrame, touched: DataFrame) -> DataFrame:
    """Distinct targets that the touched notes (path, title) may change: those naming one of their keys, with or
    without a fragment, and those resolved to one of their paths."""
    keys = touched.select(F.explode(md.note_keys("path", "title")).alias("k")).select(F.lower("k").alias("key"))
    # the exact-path stage also adds the extension
    keys = keys.unionByName(keys.select(F.concat("key", F.lit(".md")).alias("key"))).distinct()
    named = links.select("target", F.lower(md.canonical_target("target")).alias("key")).join(keys, "key", "left_semi").select("target")
    held = links.join(touched.select(F.col("path").alias("target_path")), "target_path", "left_semi").select("target")
    return named.unionByName(held).distinct()


def re_resolve(links: DataFrame, notes: DataFrame, touched: DataFrame) -> DataFrame:
    """Links (source_path, target, target_path) after notes were added, changed or removed; only affected targets are resolved."""
    targets = affected_targets(links, touched)
    done = resolve_targets(targets, notes).select("target", F.col("target_path").alias("new_path"), F.lit(True).alias("redone"))
    out = skew_join(links.select("source_path", "target", "target_path"), done, "target", "left")
    return out.select("source_path", "target", F.when(F.col("redone"), F.col("new_path")).otherwise(F.col("target_path")).alias("target_path"))
