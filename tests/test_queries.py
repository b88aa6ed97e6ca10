import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


def norm(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return tuple(map(norm, v)) if isinstance(v, list) else v


def core():
    from loreloom.plans import registry

    return registry


def test_entry(spark, data_dir):
    assert entry.entry(spark).columns == ["path", "title", "rank"]


def test_every_query_equals_its_sql(spark, data_dir):
    con = duckdb.connect()
    for f in os.listdir(data_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data_dir}/{f}'")
    bad = []
    for name, f in core().QUERIES.items():
        df = f(spark, data_dir)
        cols = sorted(df.columns)
        got = sorted((repr(tuple(norm(v) for v in r)) for r in df.select(cols).collect()))
        if name in core().ORACLES:
            rel = con.sql(core().ORACLES[name])
            assert sorted(rel.columns) == cols, name
            want = sorted(repr(tuple(norm(dict(zip(rel.columns, r))[c]) for c in cols)) for r in rel.fetchall())
            if got != want:
                bad.append(name)
    assert not bad


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_debounce_on_a_stream(spark, tmp_path):
    from loreloom.streaming import debounce

    src = str(tmp_path / "in")
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:00:00"), ("z", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "path string, t string").selectExpr("path", "CAST(t AS timestamp) ts").write.parquet(src)
    stream = spark.readStream.schema("path string, ts timestamp").parquet(src).withWatermark("ts", "1 minute")
    q = debounce.bursts(stream, "ts", "2 seconds", "path").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["path"], r["n_events"]) for r in spark.table("bursts").collect())
    assert got == [("a", 1), ("a", 2), ("b", 1)]
