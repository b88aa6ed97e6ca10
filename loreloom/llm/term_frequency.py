"""Frequency of every distinct term: occurrences and records, with marks for useless terms.

Terms are counted per record, combined by hash before the shuffle (Spark's partial aggregation on the
record-and-term key, then again on the term), and summed. A term is ``rare`` if at most ``rare_records``
records have it, ``common`` if more than ``common_share`` of all records have it; rare comes first.

Defined results: a term is a longest run of signs without Unicode white space, kept as written; null,
blank and empty texts have no term but their record counts; null record keys are ignored; a table
without rows gives no terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import current_notes
from ..runtime import UNICODE_SPACE

RARE_RECORDS, COMMON_SHARE = 2, 0.1


def terms(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(c, f"[{UNICODE_SPACE}]+"), lambda t: t != "")


def term_frequency(records: DataFrame, record: str, text: str, rare_records: int = RARE_RECORDS, common_share: float = COMMON_SHARE) -> DataFrame:
    """(term, uses, records, mark) over rows of (record, text); a record may have several rows."""
    rows = records.select(F.col(record).alias("_record"), F.col(text).alias("_text")).filter("_record IS NOT NULL")
    total = rows.agg(F.countDistinct("_record").alias("n_records"))
    per_record = rows.select("_record", F.explode(terms("_text")).alias("term")).groupBy("_record", "term").agg(F.count(F.lit(1)).alias("n"))
    per_term = per_record.groupBy("term").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("records"))
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > total.scalar() * common_share, "common")
    return per_term.select("term", "uses", "records", mark.alias("mark"))


def tag_frequency(notes: DataFrame, tag_count: DataFrame) -> DataFrame:
    """(field, tag, uses, records, mark) for notes.tags and tag_count.tag."""
    of_notes = term_frequency(current_notes(notes, "tags"), "path", "tags").withColumn("field", F.lit("notes.tags"))
    of_runs = term_frequency(tag_count, "run_id", "tag").withColumn("field", F.lit("tag_count.tag"))
    return of_notes.unionByName(of_runs).select("field", F.col("term").alias("tag"), "uses", "records", "mark")
