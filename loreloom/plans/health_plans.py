"""Queries of the health detectors, with a fixed clock."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import health
from .link_plans import links_of, notes_of
from .sql import BLANKS, COMPONENTS, CUR, EDGES, LNK, resolved

NOW = datetime(2024, 6, 30, tzinfo=timezone.utc)
CONFIG = health.HealthConfig(size_threshold=500, stub_threshold=60)


def notes(spark: SparkSession, d: str) -> DataFrame:
    return notes_of(spark, d, "title", "body", "tags", "frontmatter", "mtime")


def raw(spark: SparkSession, d: str) -> DataFrame:
    return notes_of(spark, d, "body").select("path", F.col("body").alias("raw"))


def link_classes(spark: SparkSession, d: str) -> DataFrame:
    return health.unresolved_links(links_of(spark, d), notes(spark, d), CONFIG)


def health_links(spark: SparkSession, d: str) -> DataFrame:
    return health.link_findings(links_of(spark, d), notes(spark, d), CONFIG, True)


def health_suppressed(spark: SparkSession, d: str) -> DataFrame:
    return health.suppressed_unresolved(links_of(spark, d), notes(spark, d), CONFIG)


def health_drift(spark: SparkSession, d: str) -> DataFrame:
    return health.para_drift(notes(spark, d), NOW, CONFIG)


def health_oversized(spark: SparkSession, d: str) -> DataFrame:
    return health.oversized(notes(spark, d), raw(spark, d), CONFIG)


def health_stubs(spark: SparkSession, d: str) -> DataFrame:
    return health.stubs(notes(spark, d), links_of(spark, d), CONFIG)


def health_orphans(spark: SparkSession, d: str) -> DataFrame:
    return health.orphans_and_leaves(notes(spark, d), links_of(spark, d), NOW, CONFIG)


def health_islands(spark: SparkSession, d: str) -> DataFrame:
    return health.islands(notes(spark, d), links_of(spark, d), CONFIG)


def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    return health.counts_by_type(health.audit(notes(spark, d), links_of(spark, d), raw(spark, d), NOW, CONFIG, True))


QUERIES = {
    f.__name__: f
    for f in (link_classes, health_links, health_suppressed, health_drift, health_oversized, health_stubs, health_orphans, health_islands, audit_counts)
}
NOW_MS = int(NOW.timestamp() * 1000)
DAY = 86_400_000
EXTENSIONS = ", ".join(f"'{e}'" for e in health.ATTACHMENTS)
LC = f"trim(split_part(split_part(target, '#', 1), '^', 1), {BLANKS})"
CLASSES = f"""{CUR}, open AS (SELECT source_path, target FROM ({LNK.removeprefix('lnk AS ')}) WHERE target_path IS NULL), {resolved('cur', 'open')},
dirs AS (SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS dir FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS i FROM cur)),
cls AS (SELECT o.source_path, o.target, CASE
    WHEN contains({LC}, '.') AND lower(regexp_extract({LC}, '[^.]*$')) IN ({EXTENSIONS}) THEN 'attachment'
    WHEN ends_with(trim(target, {BLANKS}), '/') OR ({LC} <> '' AND regexp_replace({LC}, '^(\\./)+|/+$', '', 'g') IN (SELECT dir FROM dirs)) THEN 'folder'
    WHEN r.status = 'ambiguous' THEN 'ambiguous' ELSE 'dangling' END AS kind FROM open o JOIN res r USING (target))"""
LINK_FINDINGS = """SELECT 'ambiguous_link' AS type, source_path AS path, '[[' || target || ']] is ambiguous (matches multiple notes)' AS detail, 'warn' AS severity FROM cls WHERE kind = 'ambiguous'
  UNION ALL SELECT 'dangling_link', source_path, '[[' || target || ']] resolves to no note', 'warn' FROM cls WHERE kind = 'dangling'"""
STATUS = f"lower(trim(json_extract_string(CASE WHEN json_valid(frontmatter) THEN frontmatter END, '$.status'), {BLANKS}))"
DRIFT = f"""SELECT 'para_drift' AS type, path, CASE WHEN s IN ('done', 'closed', 'complete', 'archived') THEN 'status: ' || s || ', still in 1-Projects'
  ELSE 'untouched ' || CAST(trunc(({NOW_MS} - mtime) / {DAY}) AS BIGINT) || ' days (threshold 180)' END AS detail, 'warn' AS severity
  FROM (SELECT path, mtime, {STATUS} AS s FROM cur WHERE starts_with(lower(path), '1-projects/'))
  WHERE coalesce(s IN ('done', 'closed', 'complete', 'archived'), false) OR mtime < {NOW_MS - 180 * DAY}"""
SECTIONS = f"""(SELECT count(*) FROM (SELECT sec FROM (
    SELECT line, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (ORDER BY i) AS sec, h, k FROM (
      SELECT line, i, regexp_matches(line, '^#{{2,3}}\\s+\\S') OR starts_with(line, '# ') AS h, regexp_matches(line, '^#{{2,3}}\\s+\\S') AS k
      FROM (SELECT unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT string_split(body, chr(10)) AS l)))
  ) GROUP BY sec HAVING bool_or(k) AND bool_or(NOT h AND trim(line, {BLANKS}) <> '')))"""
OVERSIZED = f"""SELECT 'oversized' AS type, path, '~' || (strlen(body) // 4) || ' tokens, ' || n || ' sections - split candidate' AS detail, 'warn' AS severity FROM (
  SELECT path, body, {SECTIONS} AS n
  FROM cur WHERE length(body) // 4 > 500) WHERE n >= 3"""
STUBS = """SELECT 'stub' AS type, path, 'near-empty (~' || (strlen(coalesce(body, '')) // 4) || ' tokens), links nowhere - merge or archive?' AS detail, 'warn' AS severity
  FROM cur WHERE length(coalesce(body, '')) // 4 < 60 AND NOT regexp_matches(path, '^(Journal|Notes|4-Archives)/')
  AND path NOT IN (SELECT source_path FROM lnk WHERE target_path IS NOT NULL)"""
ORPHANS = f"""SELECT CASE degree WHEN 0 THEN 'orphan' ELSE 'leaf' END AS type, path, CASE degree WHEN 0 THEN 'degree 0 (no resolved links), age ' ELSE 'degree 1 (single resolved link), age ' END
  || CAST(trunc(({NOW_MS} - mtime) / {DAY}) AS BIGINT) || ' days' AS detail, 'warn' AS severity FROM cur JOIN deg USING (path)
  WHERE degree <= 1 AND regexp_matches(path, '^(2-Areas|3-Resources)(/|$)') AND mtime < {NOW_MS - 90 * DAY}"""
ISLANDS = """SELECT 'island' AS type, component AS path, 'isolated cluster of ' || n || ': ' || members AS detail, 'warn' AS severity FROM (
  SELECT component, count(*) AS n, string_agg(path, ', ' ORDER BY path) AS members, bool_and(regexp_matches(path, '^4-Archives(/|$)')) AS archived FROM comp GROUP BY component)
  WHERE n BETWEEN 2 AND 3 AND NOT archived AND n < (SELECT max(c) FROM (SELECT count(*) AS c FROM comp GROUP BY component))"""
ORACLES = {
    "parse_sections": f"SELECT doc_id, CAST({SECTIONS} AS INTEGER) AS sections FROM (SELECT doc_id, text AS body FROM documents WHERE text IS NOT NULL)",
    "link_classes": f"WITH {CLASSES} SELECT source_path, target, kind FROM cls",
    "health_links": f"WITH {CLASSES} {LINK_FINDINGS}",
    "health_suppressed": f"WITH {CLASSES} SELECT count(*) AS suppressed FROM cls WHERE kind = 'dangling'",
    "health_drift": f"WITH {CUR} {DRIFT}",
    "health_oversized": f"WITH {CUR} {OVERSIZED}",
    "health_stubs": f"WITH {CUR}, {LNK} {STUBS}",
    "health_orphans": f"WITH {CUR}, {LNK}, {EDGES} {ORPHANS}",
    "health_islands": f"WITH RECURSIVE {CUR}, {LNK}, {EDGES}, {COMPONENTS} {ISLANDS}",
    "audit_counts": f"WITH RECURSIVE {CLASSES}, {LNK}, {EDGES}, {COMPONENTS} SELECT type, count(*) AS n FROM ({LINK_FINDINGS} UNION ALL {DRIFT} UNION ALL {OVERSIZED}"
    + f" UNION ALL {STUBS} UNION ALL {ORPHANS} UNION ALL {ISLANDS}) GROUP BY type",
}
