"""Queries on the note graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators import graph
from .link_plans import links_of, notes_of
from ..runtime import table
from .sql import COMPONENTS, CUR, EDGES, LNK


def parts(spark: SparkSession, d: str, exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    nodes = graph.graph_nodes(notes_of(spark, d, "title"), exclude)
    return nodes, graph.graph_edges(links_of(spark, d), nodes)


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d)[1]


def graph_edges_excluding(spark: SparkSession, d: str) -> DataFrame:
    """Without the home note and the daily notes."""
    return parts(spark, d, ["00 Home", "Daily/*", "*[Ii]nbox*"])[1]


def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(*parts(spark, d))


def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(*parts(spark, d))


def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return graph.component_sizes(graph_components(spark, d))


def coreness(spark: SparkSession, d: str) -> DataFrame:
    return graph.coreness(*parts(spark, d))


def core_histogram(spark: SparkSession, d: str) -> DataFrame:
    return graph.core_histogram(coreness(spark, d))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_stats(*parts(spark, d))


def island_order(spark: SparkSession, d: str) -> DataFrame:
    """Components below the largest in the order of reports: by size, then by first member."""
    sizes = component_sizes(spark, d)
    return sizes.filter(F.col("size") < sizes.agg(F.max("size")).scalar()).select("component", F.row_number().over(W.Window.orderBy("size", "component")).alias("place"))


def dense_cores(spark: SparkSession, d: str) -> DataFrame:
    """Degree and coreness in the dense graph of suppliers and parts: (side, degree, coreness, n)."""
    e = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()
    nodes = graph.both_ways(e).select(F.col("a").alias("path")).distinct()
    both = graph.degrees(nodes, e).join(graph.coreness(nodes, e), "path")
    return both.groupBy(F.substring("path", 1, 1).alias("side"), "degree", "coreness").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (graph_edges, graph_edges_excluding, degrees, graph_components, component_sizes, coreness, core_histogram, graph_stats, island_order, dense_cores)
}
G = f"{CUR}, {LNK}, {EDGES}"
OUT = "(title = '00 Home' OR path = '00 Home.md' OR regexp_matches(path, '^Daily/[^/]*$') OR regexp_matches(title, '^[^/]*[Ii]nbox[^/]*$') OR regexp_matches(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', ''), '^[^/]*[Ii]nbox[^/]*$') OR regexp_matches(path, '^[^/]*[Ii]nbox[^/]*$'))"


def cores(degrees: str, neighbours: str) -> str:
    """CTEs that end in ``core(path, coreness)``: each round every node's value falls to the h-index of its neighbours, until none does."""
    return f"""dg AS ({degrees}), nb AS ({neighbours}), low AS (
      SELECT 0 AS r, path, degree AS h, true AS moved FROM dg UNION ALL
      SELECT r + 1, path, new, bool_or(new <> h) OVER () FROM (
        SELECT l.r, l.path, l.h, l.moved, coalesce(max(least(x.h, x.k)), 0) AS new FROM low l LEFT JOIN (
          SELECT nb.a, o.h, row_number() OVER (PARTITION BY nb.a ORDER BY o.h DESC) AS k FROM nb JOIN low o ON o.path = nb.b) x ON x.a = l.path
        WHERE l.moved GROUP BY ALL)),
    core AS (SELECT path, CAST(h AS BIGINT) AS coreness FROM low WHERE r = (SELECT max(r) FROM low))"""


ORACLES = {
    "graph_edges": f"WITH {G} SELECT a, b FROM e",
    "graph_edges_excluding": f"WITH {G}, gone AS (SELECT path FROM cur WHERE {OUT}) SELECT a, b FROM e WHERE a NOT IN (SELECT path FROM gone) AND b NOT IN (SELECT path FROM gone)",
    "degrees": f"WITH {G} SELECT path, degree FROM deg",
    "graph_components": f"WITH RECURSIVE {G}, {COMPONENTS} SELECT path, component FROM comp",
    "component_sizes": f"WITH RECURSIVE {G}, {COMPONENTS} SELECT component, count(*) AS size FROM comp GROUP BY component",
    "dense_cores": f"""WITH RECURSIVE l AS (SELECT DISTINCT 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem), se AS (SELECT p AS a, s AS b FROM l UNION ALL SELECT s, p FROM l),
      {cores('SELECT a AS path, count(*) AS degree FROM se GROUP BY a', 'SELECT a, b FROM se')}
      SELECT left(path, 1) AS side, degree, coreness, count(*) AS n FROM core JOIN dg USING (path) GROUP BY ALL""",
    "island_order": f"""WITH RECURSIVE {G}, {COMPONENTS}, z AS (SELECT component, count(*) AS size FROM comp GROUP BY component)
      SELECT component, CAST(row_number() OVER (ORDER BY size, component) AS INTEGER) AS place FROM z WHERE size < (SELECT max(size) FROM z)""",
    "coreness": f"WITH RECURSIVE {G}, {cores('SELECT path, degree FROM deg', 'SELECT a, b FROM sym')} SELECT path, coreness FROM core",
    "core_histogram": f"WITH RECURSIVE {G}, {cores('SELECT path, degree FROM deg', 'SELECT a, b FROM sym')} SELECT coreness, count(*) AS nodes FROM core GROUP BY coreness",
    "graph_stats": f"""WITH RECURSIVE {G}, {COMPONENTS}, {cores('SELECT path, degree FROM deg', 'SELECT a, b FROM sym')}, z AS (SELECT count(*) AS size FROM comp GROUP BY component)
      SELECT (SELECT count(*) FROM cur) AS node_count, (SELECT count(*) FROM e) AS edge_count, (SELECT count(*) FROM z) AS component_count,
      (SELECT round(max(size) / sum(size), 6) FROM z) AS giant_ratio, (SELECT max(coreness) FROM core) AS max_core""",
}
