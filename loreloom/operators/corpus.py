"""Notes as tables: current rows, parsing, content-aware upsert, removal and change capture."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..runtime import UNICODE_SPACE

NOTES = (
    "path string, title string, body string, tags string, frontmatter string, mtime double, "
    "content_hash string, content_changed_at double, first_indexed_at double"
)
#: Columns that may be long.
TEXTS = ("body", "raw", "text", "frontmatter")
LINKS = "source_path string, target string, target_path string"


def current_notes(notes: DataFrame, *columns: str) -> DataFrame:
    """(path, columns) of each path's row with the largest mtime; rows that tie are equal, null is oldest.

    Columns that hold texts stay out of the aggregation: the newest rows are found by path and time first, then
    one row of each is kept, so older states' texts are never moved.
    """
    columns = columns or tuple(c for c in notes.columns if c != "path")
    named = notes.filter(F.col("path").isNotNull())
    if not set(columns) & set(TEXTS) or not _has_places(named):
        newest = F.max(F.struct("mtime", *(c for c in columns if c != "mtime"))).alias("r")
        return named.groupBy("path").agg(newest).select("path", *(F.col(f"r.{c}").alias(c) for c in columns))
    # the file and the place in it number a row without a look at its text
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    newest = named.groupBy("path").agg(F.max(F.struct("mtime", place.alias("at"))).alias("n")).select("n.at")
    return named.select("path", *columns, place.alias("at")).join(newest, "at", "left_semi").select("path", *columns)


def _has_places(df: DataFrame) -> bool:
    try:
        return "row_index" in df.select("_metadata").schema[0].dataType.fieldNames()
    except AnalysisException:
        return False


def current_links(links: DataFrame) -> DataFrame:
    """(source_path, target, target_path): one row for each pair of source and typed target, as last seen."""
    last = F.max(F.struct("seen_at", "link_id", "target_path")).alias("r")
    filled = links.filter(F.col("source_path").isNotNull() & F.col("target").isNotNull())
    return filled.groupBy("source_path", "target").agg(last).select("source_path", "target", F.nullif(F.col("r.target_path"), F.lit("")).alias("target_path"))


def parse(files: DataFrame, path: str = "path", raw: str = "raw", mtime: str = "mtime") -> DataFrame:
    """(path, title, body, tags, tag_list, frontmatter, link_targets, mtime, content_hash) of raw markdown files."""
    fm = files.select(F.col(path).alias("path"), F.col(raw).alias("raw"), F.col(mtime).alias("mtime"), md.frontmatter_json(raw).alias("frontmatter"))
    out = fm.select(
        "path",
        md.title("raw", "path", F.col("frontmatter")).alias("title"),
        md.strip_markdown(md.body_text("raw")).alias("body"),
        md.tags("raw", F.col("frontmatter")).alias("tag_list"),
        "frontmatter",
        md.wikilinks("raw").alias("link_targets"),
        "mtime",
        "raw",
    )
    out = out.withColumn("tags", F.array_join("tag_list", " "))
    return out.withColumn("content_hash", md.content_hash("title", "body", "tags", "frontmatter"))


def links_of(parsed: DataFrame) -> DataFrame:
    """(source_path, target): each link of a note once; empty targets are none."""
    each = parsed.select(F.col("path").alias("source_path"), F.explode("link_targets").alias("target"))
    return each.filter("target <> ''").distinct()


def seed_time(mtime: Column | str, now_ms: float) -> Column:
    """The time of a first change: the file's, but never in the future."""
    return F.least(F.col(mtime) if isinstance(mtime, str) else mtime, F.lit(float(now_ms)))


def upsert(old: DataFrame, new: DataFrame, now_ms: float, changed_only: bool = True) -> DataFrame:
    """The next notes table from the stored one and a full listing of parsed files.

    Files missing from the listing are gone. A file with the stored mtime keeps its row unless
    ``changed_only`` is off. ``first_indexed_at`` stays, ``content_changed_at`` moves only with the hash.
    """
    columns = [f.split()[0] for f in NOTES.split(", ")]
    o = old.select(*(F.col(c).alias(f"o_{c}") for c in columns))
    both = new.join(o, new["path"] == o["o_path"], "left")
    known = F.col("o_path").isNotNull()
    same_file = known & (F.col("o_mtime") == F.col("mtime")) & F.lit(changed_only)
    same_content = known & F.coalesce(F.col("o_content_hash") == F.col("content_hash"), F.lit(False))
    seed = seed_time("mtime", now_ms)
    keep = lambda c: F.when(same_file, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(
        "path",
        *(keep(c) for c in ("title", "body", "tags", "frontmatter", "mtime", "content_hash")),
        F.when(same_file | same_content, F.col("o_content_changed_at")).when(known, F.lit(float(now_ms))).otherwise(seed).alias("content_changed_at"),
        F.when(known, F.col("o_first_indexed_at")).otherwise(seed).alias("first_indexed_at"),
    )


def diff(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, mtime, change): new, changed and deleted files by comparing modification times; equal ones are left out."""
    s = stored.select("path", F.col("mtime").alias("stored"))
    ls = listing.select("path", F.col("mtime").alias("listed"))
    change = (
        F.when(F.col("stored").isNull() & F.col("listed").isNotNull(), "new")
        .when(F.col("listed").isNull(), "deleted")
        .when(~F.col("stored").eqNullSafe(F.col("listed")), "changed")
    )
    return s.join(ls, "path", "full_outer").select("path", F.col("listed").alias("mtime"), change.alias("change")).filter("change IS NOT NULL")


def replace_links(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Links after the touched sources' links were replaced; duplicates of (source_path, target) collapse."""
    kept = old.join(touched.select(F.col("path").alias("source_path")).distinct(), "source_path", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True).dropDuplicates(["source_path", "target"])


def migrate(notes: DataFrame, now_ms: float) -> DataFrame:
    """A table of the old schema with the change columns filled in: hash from the stored texts, times from mtime."""
    for c in ("content_hash", "content_changed_at", "first_indexed_at"):
        if c not in notes.columns:
            notes = notes.withColumn(c, F.lit(None).cast("string" if c == "content_hash" else "double"))
    seed = seed_time("mtime", now_ms)
    return (
        notes.withColumn("content_hash", F.coalesce("content_hash", md.content_hash("title", "body", "tags", "frontmatter")))
        .withColumn("content_changed_at", F.coalesce("content_changed_at", seed))
        .withColumn("first_indexed_at", F.coalesce("first_indexed_at", seed))
    )


def stats(notes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: notes, links."""
    n = notes.agg(F.count(F.lit(1)).alias("notes"))
    return n.select("notes", links.agg(F.count(F.lit(1))).scalar().alias("links"))


def tag_counts(notes: DataFrame) -> DataFrame:
    """(tag, n): uses of each tag in the joined tag texts."""
    each = notes.select(F.explode(F.split("tags", f"[{UNICODE_SPACE}]+")).alias("tag"))
    return each.filter("tag <> ''").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def top_tags(notes: DataFrame, k: int = 20) -> DataFrame:
    return tag_counts(notes).orderBy(F.desc("n"), "tag").limit(k)


def freshness(notes: DataFrame, listing: DataFrame) -> DataFrame:
    """One row: newest indexed and newest listed time, and whether the index is stale by more than a millisecond."""
    newest = notes.agg(F.max("mtime")).scalar()
    out = listing.agg(F.max("mtime").alias("newest_listed")).withColumn("newest_indexed", newest)
    return out.withColumn("stale", F.coalesce(F.col("newest_listed") > F.col("newest_indexed") + 1.0, F.col("newest_listed").isNotNull()))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
