"""Session, table and scratch-storage helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters Unicode calls white space (property White_Space), as the inside of a regex class.
UNICODE_SPACE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loreloom")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def is_filled(column: Column | str) -> Column:
    """Neither null nor empty."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & (c != "")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where a local session leaves it unset."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="loreloom-")
        sc.setCheckpointDir(root)
    return root


class Scratch:
    """Intermediate tables written as Parquet below the shared checkpoint folder.

    A written table cuts lineage and survives the loss of any executor. ``drop`` deletes tables that
    no later step reads, so a loop holds only its live rounds on disk.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{scratch_root(spark).rstrip('/')}/loreloom-{purpose}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        schema = df.schema
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def partitioned(self, df: DataFrame, name: str, column: str) -> str:
        """Writes a table in folders by a column; returns its path."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.mode("overwrite").partitionBy(column).parquet(path)
        return path

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            self._delete(getattr(t, "_scratch_path", None))

    def clear(self) -> None:
        """Delete every table of this scratch folder."""
        self._delete(self.root)

    def _delete(self, path: str | None) -> None:
        if path:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def release_shuffles(self) -> None:
        """Let the context cleaner drop shuffle files of finished rounds, which it does once their handles are collected."""
        self.spark._jvm.System.gc()


def heavy_keys(df: DataFrame, key: str, share: int = 500, least: int = 50_000) -> list:
    """The keys holding more than 1/share of the rows (and over ``least`` rows): at most ``share`` of them by arithmetic."""
    total = df.count()
    if total <= least:
        return []
    floor = max(least, total // share)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > floor)
    return [r[0] for r in counts.collect() if r[0] is not None]


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", heavy: list | None = None) -> DataFrame:
    """left ⋈ right, right unique on ``key``. Rows of hot keys meet a broadcast of those keys' right rows
    (at most 500), all others are shuffled; so no task receives a hot key's rows."""
    hot = heavy_keys(left, key) if heavy is None else heavy
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    cold = left.filter(~is_hot | F.col(key).isNull()).join(right.filter(~is_hot), key, how)
    return cold.unionByName(left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how))
