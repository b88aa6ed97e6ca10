"""Queries on references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import orphans
from ..runtime import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_links(table(spark, d, "links"), table(spark, d, "notes"), table(spark, d, "removed_notes"))


def p3_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.track(table(spark, d, "links"), table(spark, d, "notes"), table(spark, d, "removed_notes")).snapshot()


def p3_reopened(spark: SparkSession, d: str) -> DataFrame:
    """The open references to notes of one folder after a last batch withdrew them all: settled ones open again."""
    ledger = orphans.track(table(spark, d, "links"), table(spark, d, "notes"), table(spark, d, "removed_notes"))
    gone = table(spark, d, "notes").filter(F.col("path").like(GONE)).select("path", F.lit(WITHDRAWN).alias("removed_at"))
    ledger.apply(parent_events=orphans.withdrawals(gone))
    return ledger.orphans().filter(F.col("path").like(GONE)).select(F.col("ref_id").alias("link_id"), "field", "state")


GONE, WITHDRAWN = "2-Areas/%", 4_102_444_800_000.0
ORPHANS = """
WITH refs AS (
  SELECT link_id, 'source_path' AS field, source_path AS path, seen_at FROM links
  UNION ALL SELECT link_id, 'target_path', target_path, seen_at FROM links
), known AS (
  SELECT path, min(first_indexed_at) AS first_at FROM notes WHERE path IS NOT NULL GROUP BY path
), judged AS (
  SELECT r.*, CASE WHEN k.path IS NOT NULL THEN CASE WHEN k.first_at > r.seen_at THEN 'late' END
    WHEN r.path IN (SELECT path FROM removed_notes WHERE path IS NOT NULL) THEN 'deleted' ELSE 'missing' END AS state
  FROM refs r LEFT JOIN known k ON k.path = r.path WHERE r.path <> ''
)"""

QUERIES = {f.__name__: f for f in (p3_found, p3_orphan_counts, p3_reopened)}
ORACLES = {
    "p3_found": ORPHANS + " SELECT link_id, field, state FROM judged WHERE state IS NOT NULL",
    "p3_reopened": ORPHANS.replace("FROM notes WHERE path IS NOT NULL", f"FROM notes WHERE path NOT LIKE '{GONE}'").replace(
        "r.path IN (SELECT path FROM removed_notes", f"r.path IN (SELECT path FROM notes WHERE path LIKE '{GONE}' UNION ALL SELECT path FROM removed_notes"
    )
    + f" SELECT link_id, field, state FROM judged WHERE state IS NOT NULL AND path LIKE '{GONE}'",
    "p3_orphan_counts": ORPHANS
    + """ SELECT field, state, strftime(make_timestamp(CAST(floor(seen_at) AS BIGINT) * 1000), '%Y-%m') AS month, count(*) AS refs
    FROM judged WHERE state IS NOT NULL GROUP BY ALL""",
}
