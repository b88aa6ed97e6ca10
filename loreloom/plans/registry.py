"""All core queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import action_plans, change_plans, graph_plans, health_plans, link_plans, parse_plans, quality, search_plans

MODULES = (search_plans, parse_plans, link_plans, graph_plans, health_plans, change_plans, action_plans, quality)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return search_plans.search_bm25(spark, d)
