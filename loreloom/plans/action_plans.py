"""Queries on action registers, with a fixed date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import actions
from ..runtime import table
from .sql import BLANKS

TODAY, OWNER = date(2024, 6, 30), "marrek"
REGISTER, TITLE = "2-Areas/OPEN-ACTIONS.md", "Open Actions - Areas"


def register(spark: SparkSession, d: str) -> DataFrame:
    """The table's rows as one register would list them."""
    return table(spark, d, "actions").withColumn("register_path", F.lit(REGISTER)).withColumn("register_title", F.lit(TITLE))


def open_actions(spark: SparkSession, d: str) -> DataFrame:
    return actions.open_actions(register(spark, d), TODAY, OWNER).select("action_id", "state", "due", "is_mine", "is_overdue", "stable_id")


def action_sections(spark: SparkSession, d: str) -> DataFrame:
    return actions.sections(register(spark, d), TODAY, OWNER).select("section", "action_id")


def action_counts(spark: SparkSession, d: str) -> DataFrame:
    return actions.counts(register(spark, d), TODAY, OWNER)


def action_worklist(spark: SparkSession, d: str) -> DataFrame:
    return actions.worklist(register(spark, d), TODAY, OWNER).select("action_id", "bucket")


def parsed_registers(spark: SparkSession, d: str) -> DataFrame:
    """Registers of up to fifty actions written as markdown tables and parsed again."""
    a = table(spark, d, "actions")
    cells = F.concat_ws(" | ", *(F.coalesce(f, F.lit("")) for f in actions.FIELDS))
    rows = a.withColumn("line", F.concat(F.lit("| "), cells, F.lit(" |"))).groupBy(F.floor(F.col("action_id") / 50).alias("reg"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("action_id", "line"))), lambda r: r["line"]), "\n")
    head = "# Open Actions - Areas\n\n| Status | Action | Owner | Review / Due | First | Source |\n| --- | --- | --- | --- | --- | --- |\n"
    docs = rows.agg(F.concat(F.lit(head), body, F.lit("\n\n| Done | after the table | x | | | |\n")).alias("raw"))
    docs = docs.select(F.concat(F.lit("areas-"), F.col("reg").cast("string"), F.lit("/OPEN-ACTIONS.md")).alias("path"), "raw")
    return actions.parse_registers(actions.registers(docs)).select("register_path", "register_title", *actions.FIELDS)


QUERIES = {f.__name__: f for f in (open_actions, action_sections, action_counts, action_worklist, parsed_registers)}
A = f"""a AS (SELECT *, trim(regexp_replace(lower(coalesce(status, '')), '(?s)^[^a-z]+', ''), {BLANKS}) AS state,
  CASE WHEN regexp_matches(trim(review_due, {BLANKS}), '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{8}})$')
    THEN CAST(try_strptime(replace(trim(review_due, {BLANKS}), '-', ''), '%Y%m%d') AS DATE) END AS due,
  coalesce(contains(lower(owner), '{OWNER}'), false) AS is_mine FROM actions),
o AS (SELECT *, coalesce(due <= DATE '{TODAY}', false) AND state <> 'done' AS is_overdue,
  substr(sha1('{REGISTER}|' || coalesce(first_raised, '') || '|' || coalesce(lower(action), '') || '|' || coalesce(lower(owner), '')), 1, 12) AS stable_id FROM a WHERE state <> 'done')"""
ORACLES = {
    "parsed_registers": "SELECT 'areas-' || CAST(floor(action_id / 50) AS BIGINT) || '/OPEN-ACTIONS.md' AS register_path, 'Open Actions - Areas' AS register_title, "
    + ", ".join(f"trim(coalesce({f}, ''), {BLANKS}) AS {f}" for f in actions.FIELDS)
    + " FROM actions WHERE NOT regexp_matches(replace(coalesce(status, ''), ' ', ''), '^-*$')",
    "open_actions": f"WITH {A} SELECT action_id, state, due, is_mine, is_overdue, stable_id FROM o",
    "action_sections": f"""WITH {A} SELECT 'overdue' AS section, action_id FROM o WHERE state = 'overdue' OR is_overdue UNION ALL SELECT 'mine', action_id FROM o WHERE is_mine
      UNION ALL SELECT 'needs review', action_id FROM o WHERE state = 'needs review' UNION ALL SELECT 'waiting', action_id FROM o WHERE state = 'waiting'""",
    "action_counts": f"""WITH {A} SELECT count(*) AS open, count(*) FILTER (state = 'overdue' OR is_overdue) AS overdue, count(*) FILTER (state = 'waiting') AS waiting,
      count(*) FILTER (state = 'needs review') AS needs_review, count(*) FILTER (is_mine) AS mine FROM o""",
    "action_worklist": f"WITH {A} SELECT action_id, CASE WHEN is_overdue OR state = 'overdue' THEN 'overdue' WHEN state = 'waiting' THEN 'waiting' ELSE 'current' END AS bucket FROM o WHERE is_mine",
}
