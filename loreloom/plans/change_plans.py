"""Queries on statistics, change capture, the digest and event debouncing."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import markdown as md
from ..operators import corpus, digest
from ..runtime import UNICODE_SPACE, table
from ..streaming import debounce
from .link_plans import links_of, notes_of
from .sql import CUR, LNK

CUTOFF = datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp() * 1000
NOW_MS = datetime(2024, 12, 31, tzinfo=timezone.utc).timestamp() * 1000
GONE = "Journal/%"


def vault_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus.stats(notes_of(spark, d, "title"), links_of(spark, d))


def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.tag_counts(notes_of(spark, d, "tags"))


def top_tags(spark: SparkSession, d: str) -> DataFrame:
    return corpus.top_tags(notes_of(spark, d, "tags"))


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    n = notes_of(spark, d, "title", "body", "tags", "frontmatter")
    return n.select("path", md.content_hash("title", "body", "tags", "frontmatter").alias("hash"))


def _oldest(notes: DataFrame) -> DataFrame:
    """Each path's first state, as an earlier index would hold it."""
    w = W.Window.partitionBy("path").orderBy(F.col("mtime").asc_nulls_first(), F.col("content_hash").asc_nulls_first())
    return notes.filter("path IS NOT NULL").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def notes_diff(spark: SparkSession, d: str) -> DataFrame:
    """First states against current ones, with a folder gone from each side."""
    notes = table(spark, d, "notes")
    stored = _oldest(notes).select("path", "mtime").filter(~F.col("path").like("Daily/%"))
    listing = corpus.current_notes(notes, "mtime").filter(~F.col("path").like(GONE))
    return corpus.diff(stored, listing).select("path", "change")


def notes_upsert(spark: SparkSession, d: str) -> DataFrame:
    """First states brought up to the current listing."""
    notes = corpus.migrate(table(spark, d, "notes"), NOW_MS)
    old = _oldest(notes)
    new = corpus.current_notes(notes.drop("content_changed_at", "first_indexed_at")).filter(~F.col("path").like(GONE))
    return corpus.upsert(old, new, NOW_MS).select("path", "mtime", "content_hash", "content_changed_at", "first_indexed_at")


def notes_migrated(spark: SparkSession, d: str) -> DataFrame:
    n = corpus.migrate(corpus.current_notes(table(spark, d, "notes")), NOW_MS)
    return n.select("path", "content_hash", "content_changed_at", "first_indexed_at")


def freshness(spark: SparkSession, d: str) -> DataFrame:
    """The index against the raw documents' times."""
    return corpus.freshness(notes_of(spark, d, "mtime"), table(spark, d, "documents"))


def changed_since(spark: SparkSession, d: str) -> DataFrame:
    return digest.changed_since(corpus.current_notes(table(spark, d, "notes")), CUTOFF)


def digest_groups(spark: SparkSession, d: str) -> DataFrame:
    return digest.groups(changed_since(spark, d))


def digest_lines(spark: SparkSession, d: str) -> DataFrame:
    return digest.lines(changed_since(spark, d)).select("grp", "path", "line")


def debounced_events(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of each user's events, parted by half an hour of quiet."""
    return debounce.bursts(table(spark, d, "events"), "ts", "30 minutes", "user_id").select("user_id", "first_at", "last_at", "n_events")


def quiet_periods(spark: SparkSession, d: str) -> DataFrame:
    """Bursts over all events together, parted by two minutes of quiet."""
    return debounce.quiet_periods(table(spark, d, "events"), "ts", 120)


FUNCTIONS = (
    vault_stats, tag_counts, top_tags, content_hashes, notes_diff, notes_upsert, notes_migrated, freshness, changed_since, digest_groups, digest_lines,
    debounced_events, quiet_periods,
)
QUERIES = {f.__name__: f for f in FUNCTIONS}
WHITE = f"[{UNICODE_SPACE}]+"
TAGS = f"{CUR}, tg AS (SELECT unnest(regexp_split_to_array(tags, '{WHITE}')) AS tag FROM cur), tc AS (SELECT tag, count(*) AS n FROM tg WHERE tag <> '' GROUP BY tag)"
HASH = "sha256(coalesce(title, '') || chr(0) || coalesce(body, '') || chr(0) || coalesce(tags, '') || chr(0) || coalesce(frontmatter, ''))"
CHANGED = f"""{CUR}, ch AS (SELECT path, title, content_changed_at AS changed_at, coalesce(first_indexed_at > {CUTOFF}, false) AS is_new,
  CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'Vault root' END AS grp FROM cur WHERE content_changed_at > {CUTOFF}
  AND NOT regexp_matches(path, '(^|/)(assets(/|$)|\\.)') AND NOT regexp_matches(path, '(^|/)(_DAILY-DIGEST|_ACTION-REVIEW|_INGEST-LOG)\\.md$'))"""
OLD = "old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mtime ASC NULLS FIRST, content_hash ASC NULLS FIRST) AS rn FROM {0} WHERE path IS NOT NULL) WHERE rn = 1)"
MIG = f"""mig AS (SELECT path, mtime, coalesce(content_hash, {HASH}) AS content_hash, coalesce(content_changed_at, least(mtime, {NOW_MS})) AS content_changed_at,
  coalesce(first_indexed_at, least(mtime, {NOW_MS})) AS first_indexed_at FROM notes)"""
ORACLES = {
    "vault_stats": f"WITH {CUR}, {LNK} SELECT (SELECT count(*) FROM cur) AS notes, (SELECT count(*) FROM lnk) AS links",
    "tag_counts": f"WITH {TAGS} SELECT tag, n FROM tc",
    "top_tags": f"WITH {TAGS} SELECT tag, n FROM tc ORDER BY n DESC, tag LIMIT 20",
    "content_hashes": f"WITH {CUR} SELECT path, {HASH} AS hash FROM cur",
    "notes_diff": f"""WITH {CUR}, {OLD.format('notes')}, s AS (SELECT path, mtime FROM old WHERE path NOT LIKE 'Daily/%'), l AS (SELECT path, mtime FROM cur WHERE path NOT LIKE '{GONE}')
      SELECT coalesce(s.path, l.path) AS path, CASE WHEN s.path IS NULL THEN 'new' WHEN l.path IS NULL THEN 'deleted' ELSE 'changed' END AS change
      FROM s FULL JOIN l ON s.path = l.path WHERE s.path IS NULL OR l.path IS NULL OR s.mtime IS DISTINCT FROM l.mtime""",
    "notes_upsert": f"""WITH {MIG}, {OLD.format('mig')}, new AS (SELECT DISTINCT ON (path) * FROM mig WHERE path IS NOT NULL AND path NOT LIKE '{GONE}' ORDER BY path, mtime DESC NULLS LAST)
      SELECT new.path, new.mtime, new.content_hash, CASE WHEN old.mtime = new.mtime OR old.content_hash = new.content_hash THEN old.content_changed_at ELSE {NOW_MS} END AS content_changed_at,
      old.first_indexed_at FROM new JOIN old ON old.path = new.path""",
    "notes_migrated": f"""WITH {CUR} SELECT path, coalesce(content_hash, {HASH}) AS content_hash, coalesce(content_changed_at, least(mtime, {NOW_MS})) AS content_changed_at,
      coalesce(first_indexed_at, least(mtime, {NOW_MS})) AS first_indexed_at FROM cur""",
    "freshness": f"WITH {CUR} SELECT l AS newest_listed, i AS newest_indexed, l > i + 1.0 AS stale FROM (SELECT max(mtime) AS l FROM documents), (SELECT max(mtime) AS i FROM cur)",
    "changed_since": f"WITH {CHANGED} SELECT path, title, changed_at, is_new, grp FROM ch",
    "digest_groups": f"""WITH {CHANGED} SELECT grp, count(*) AS touched, count(*) FILTER (is_new) AS new, CASE grp WHEN '1-Projects' THEN 0 WHEN '2-Areas' THEN 1 WHEN '3-Resources' THEN 2
      WHEN '4-Archives' THEN 3 WHEN 'Vault root' THEN 5 ELSE 4 END AS rank FROM ch GROUP BY grp""",
    "digest_lines": f"""WITH {CHANGED} SELECT grp, path, '- [[' || regexp_replace(path, '\\.md$', '') || '|' || title || ']] — ' || CASE WHEN is_new THEN 'new' ELSE 'updated' END || ', '
      || strftime(make_timestamp(CAST(trunc(changed_at) AS BIGINT) * 1000), '%Y-%m-%d %H:%M') AS line FROM ch""",
    "debounced_events": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      k AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
      SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n_events FROM k GROUP BY user_id, n""",
    "quiet_periods": """WITH g AS (SELECT ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (ORDER BY ts)),
      k AS (SELECT ts, sum(b) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
      SELECT min(ts) AS first_at, max(ts) AS last_at, count(*) AS n_events FROM k GROUP BY n""",
}
