"""Queries on link resolution and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, corpus, links
from ..runtime import UNICODE_SPACE, table
from .search_plans import index_of, ranked
from .sql import CUR, LNK, resolved

SEED = "00 Home.md"
TITLE = "index"
GONE = "3-Resources/%"


def notes_of(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return corpus.current_notes(table(spark, d, "notes"), *(columns or ("title", "body", "tags")))


def links_of(spark: SparkSession, d: str) -> DataFrame:
    return corpus.current_links(table(spark, d, "links"))


def resolve_links(spark: SparkSession, d: str) -> DataFrame:
    return links.resolve_links(links_of(spark, d), notes_of(spark, d, "title"))


def resolve_counts(spark: SparkSession, d: str) -> DataFrame:
    return resolve_links(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("target").alias("n_targets"))


def re_resolve_removed(spark: SparkSession, d: str) -> DataFrame:
    """Targets after all notes of a folder went away, found by resolving only what they may change."""
    notes = notes_of(spark, d, "title")
    gone = notes.filter(F.col("path").like(GONE))
    stored = links.resolve_links(links_of(spark, d), notes)
    return links.re_resolve(stored, notes.filter(~F.col("path").like(GONE)), gone)


def neighbours_out(spark: SparkSession, d: str) -> DataFrame:
    """What every note links to."""
    notes = notes_of(spark, d, "title", "body")
    return context.outgoing(links_of(spark, d), notes, notes.select("path"))


def neighbours_in(spark: SparkSession, d: str) -> DataFrame:
    """Notes whose typed targets are one title."""
    return context.incoming(links_of(spark, d), notes_of(spark, d, "title", "body"), TITLE)


def expand_context(spark: SparkSession, d: str) -> DataFrame:
    return context.expand(notes_of(spark, d), links_of(spark, d), SEED, 2, 60).select("path", "relationship")


def expand_unknown(spark: SparkSession, d: str) -> DataFrame:
    return context.expand(notes_of(spark, d), links_of(spark, d), "no such note", 1, 20)


def topic_context(spark: SparkSession, d: str) -> DataFrame:
    """What a topic's two words bring together: matches, their neighbours and tag siblings, in order of worth."""
    return context.topic(index_of(spark, d), links_of(spark, d), "energy audit", 15).select("path", "title", "relevance")


QUERIES = {f.__name__: f for f in (resolve_links, resolve_counts, re_resolve_removed, neighbours_out, neighbours_in, expand_context, expand_unknown, topic_context)}
RES = f"WITH {CUR}, {LNK}, {resolved('cur', 'lnk')}"
ORACLES = {
    "resolve_links": RES + " SELECT l.source_path, l.target, r.target_path, r.status FROM lnk l JOIN res r ON r.target = l.target",
    "resolve_counts": RES + " SELECT status, count(*) AS n_links, count(DISTINCT l.target) AS n_targets FROM lnk l JOIN res r ON r.target = l.target GROUP BY status",
    "re_resolve_removed": f"WITH {CUR}, {LNK}, rest AS (SELECT * FROM cur WHERE path NOT LIKE '{GONE}'), {resolved('rest', 'lnk')}"
    + " SELECT l.source_path, l.target, r.target_path FROM lnk l JOIN res r ON r.target = l.target",
    "neighbours_out": f"""WITH {CUR}, {LNK} SELECT source_path, path, coalesce(nullif(title, ''), typed) AS title, substr(body, 1, 200) AS snippet
      FROM (SELECT source_path, target_path, min(target) AS typed FROM lnk WHERE target_path IS NOT NULL GROUP BY ALL) JOIN cur ON path = target_path
      WHERE source_path IN (SELECT path FROM cur)""",
    "neighbours_in": f"""WITH {CUR}, {LNK} SELECT path, title, substr(body, 1, 200) AS snippet FROM cur
      WHERE path IN (SELECT source_path FROM lnk WHERE target = '{TITLE}' OR ends_with(lower(target), lower('/{TITLE}')))""",
    "expand_context": f"""WITH {CUR}, {LNK}, home AS (SELECT title FROM cur WHERE path = '{SEED}'),
      one AS (SELECT DISTINCT target_path AS path, 1 AS phase FROM lnk WHERE source_path = '{SEED}' AND target_path IN (SELECT path FROM cur)
        UNION ALL SELECT DISTINCT source_path, 2 FROM lnk, home WHERE title <> '' AND (target = title OR ends_with(lower(target), lower('/' || title))) AND source_path IN (SELECT path FROM cur)),
      near AS (SELECT path, min(phase) AS phase FROM one WHERE path <> '{SEED}' GROUP BY path),
      two AS (SELECT path, phase FROM near UNION ALL SELECT target_path, 3 FROM lnk WHERE source_path IN (SELECT path FROM near) AND target_path IN (SELECT path FROM cur) AND target_path <> '{SEED}')
      SELECT path, CASE min(phase) WHEN 1 THEN 'outgoing_link' WHEN 2 THEN 'incoming_link' ELSE '2nd_hop' END AS relationship
      FROM two GROUP BY path ORDER BY min(phase), path LIMIT 60""",
    "topic_context": f"""WITH {ranked(("energi", "audit"))}, {LNK},
      h AS (SELECT path, title, tags, row_number() OVER (ORDER BY rank, path) AS k FROM r QUALIFY k <= 9),
      ex AS (SELECT h.k, l.target_path AS path, 1 AS ph FROM h JOIN lnk l ON l.source_path = h.path WHERE h.k <= 3 AND l.target_path IN (SELECT path FROM cur)
        UNION ALL SELECT h.k, l.source_path, 2 FROM h JOIN lnk l ON l.target = h.title OR ends_with(lower(l.target), lower('/' || h.title)) WHERE h.k <= 3 AND h.title <> '' AND l.source_path IN (SELECT path FROM cur)),
      e1 AS (SELECT ex.k, ex.path, min(ph) AS ph FROM ex JOIN h USING (k) WHERE ex.path <> h.path GROUP BY ALL),
      e2 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ph, path) AS n FROM e1),
      tg AS (SELECT t, count(*) AS c FROM (SELECT unnest(regexp_split_to_array(tags, '[{UNICODE_SPACE}]+')) AS t FROM h) WHERE t NOT IN ('active', 'work', 'personal') AND strlen(t) > 2 GROUP BY t ORDER BY c DESC, t LIMIT 1),
      sib AS (SELECT path, 'shared_tag:' || t AS relevance, 10000 + row_number() OVER (ORDER BY path) AS ord FROM cur, tg WHERE tags ILIKE '%' || t || '%' QUALIFY ord <= 10005),
      al AS (SELECT path, 'direct_match' AS relevance, k AS ord FROM h UNION ALL SELECT e2.path, 'linked_from:' || h.path, 1000 * e2.k + n FROM e2 JOIN h USING (k) WHERE n <= 5 UNION ALL SELECT * FROM sib)
      SELECT path, title, relevance FROM (SELECT DISTINCT ON (path) * FROM al ORDER BY path, ord) JOIN cur USING (path) ORDER BY ord LIMIT 15""",
    "expand_unknown": "SELECT 'no such note' AS path, 'no such note' AS title, 'not_found' AS relationship, '' AS snippet",
}
