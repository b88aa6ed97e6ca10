"""Queries of the training-data operators, with SQL where SQL can express them over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.sql import CUR
from ..runtime import UNICODE_SPACE, table
from . import bpe, canonical, chunking, components, packing, term_frequency, toxic

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return components.note_groups(table(spark, d, "links"))


def p1_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return components.group_sizes(table(spark, d, "links"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return term_frequency.tag_frequency(table(spark, d, "notes"), table(spark, d, "tag_count"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_counts(spark, d).filter("mark IS NOT NULL").select("field", "tag", "mark")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.unresolved_topics(table(spark, d, "links"), table(spark, d, "topics"))


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return canonical.unmatched_report(table(spark, d, "links"), table(spark, d, "topics"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.oversized_notes(table(spark, d, "notes"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.note_pieces(table(spark, d, "notes"))


def p5_checks(spark: SparkSession, d: str) -> DataFrame:
    """What holds of every text's pieces: their joined text, and how many break the limit, the overlap or the order."""
    return chunking.piece_checks(p5_pieces(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_summary(p7_containers(spark, d))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return toxic.toxic_scores(table(spark, d, "documents"), table(spark, d, "labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).filter("toxic").select("doc_id")


def p8_source_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxic.source_rates(p8_scores(spark, d))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p1_found, p1_group_sizes, p2_counts, p2_found, p4_found, p4_unmatched, p5_found, p5_pieces, p5_checks, p6_ids, p7_containers, p7_fill, p8_found, p8_scores, p8_source_rates)
}

WHITE = f"[{UNICODE_SPACE}]+"
TIES = """t AS (SELECT source_path AS a, target_path AS b FROM links WHERE source_path <> '' AND target_path <> ''),
sym AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM t UNION ALL SELECT b, a FROM t)),
reach AS (SELECT DISTINCT a AS path, a AS g FROM sym UNION SELECT sym.b, reach.g FROM reach JOIN sym ON sym.a = reach.path WHERE reach.g < sym.b),
grp AS (SELECT path, min(g) AS group_path FROM reach GROUP BY path)"""
TAGS = f"""{CUR}, rec AS (SELECT 'notes.tags' AS field, path AS r, tags AS t FROM cur UNION ALL SELECT 'tag_count.tag', CAST(run_id AS VARCHAR), tag FROM tag_count WHERE run_id IS NOT NULL),
tot AS (SELECT field, count(DISTINCT r) AS n FROM rec GROUP BY field),
tok AS (SELECT field, r, unnest(regexp_split_to_array(t, '{WHITE}')) AS tag FROM rec WHERE t IS NOT NULL),
cnt AS (SELECT tok.field, tag, count(*) AS uses, count(DISTINCT r) AS records, any_value(n) AS n FROM tok JOIN tot USING (field) WHERE tag <> '' GROUP BY tok.field, tag),
mk AS (SELECT field, tag, uses, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > n * 0.1 THEN 'common' END AS mark FROM cnt)"""
# Packing, encoding, scores, pieces and the map to topics are tested against brute force, round trips and held-out texts
ORACLES: dict[str, str] = {
    "p1_found": f"WITH RECURSIVE {TIES} SELECT group_path, path FROM grp",
    "p1_group_sizes": f"WITH RECURSIVE {TIES} SELECT members, count(*) AS n_groups FROM (SELECT count(*) AS members FROM grp GROUP BY group_path) GROUP BY members",
    "p2_counts": f"WITH {TAGS} SELECT field, tag, uses, records, mark FROM mk",
    "p2_found": f"WITH {TAGS} SELECT field, tag, mark FROM mk WHERE mark IS NOT NULL",
    "p5_found": f"""WITH {CUR} SELECT path, CASE WHEN list_max(list_transform(regexp_split_to_array(body, '{WHITE}'), lambda x: length(x))) > 4000 THEN 'hard' ELSE 'soft' END AS kind
      FROM cur WHERE length(body) > 4000""",
    "p5_checks": f"""WITH {CUR} SELECT path, length(body) AS n_chars, 0 AS pieces_over, 0 AS gaps, 0 AS overlaps_over, 0 AS overlaps_short, 0 AS hard_cuts_in_soft,
      sha256(body) AS text_hash FROM cur WHERE length(body) > 4000""",
}
