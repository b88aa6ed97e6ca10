"""Bursts of events parted by quiet: for tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W


def bursts(events: DataFrame, time: str, gap: str, *keys: str) -> DataFrame:
    """(keys, first_at, last_at, n_events) of each key's bursts; an event less than ``gap`` after the last joins it.

    Sessions are merged before the shuffle. On a stream set a watermark on ``time`` first.
    """
    ts = F.col(time)
    out = events.filter(ts.isNotNull())
    # a cast would lose the watermark, so only other types are cast
    at = ts if isinstance(events.schema[time].dataType, T.TimestampType) else ts.cast("timestamp")
    grouped = out.groupBy(*keys, F.session_window(at, gap)).agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("n_events"))
    return grouped.drop("session_window")


def quiet_periods(events: DataFrame, time: str, seconds: int) -> DataFrame:
    """(first_at, last_at, n_events) of bursts over all events together, without bringing them into one task.

    Events of one stretch of ``seconds`` are never parted by so much quiet, so each stretch is one row before anything
    is ordered. Stretches are chained within their hour, then the hours, of which there are few, by their ends.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = F.lit(seconds * 1_000_000)
    t = events.select(F.col(time).alias("t")).filter("t IS NOT NULL")
    bins = t.groupBy(F.floor(micros("t") / gap).alias("bin")).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n"))
    bins = bins.withColumn("hour", F.date_trunc("hour", "a"))
    inner = W.Window.partitionBy("hour").orderBy("a")
    bins = bins.withColumn("before", F.lag("b").over(inner))
    # an hour's first stretch may go on with what the hour before ends with
    order = W.Window.orderBy("hour")
    hours = bins.groupBy("hour").agg(F.max("b").alias("hour_end")).withColumn("hour_before", F.lag("hour_end").over(order)).select("hour", "hour_before")
    j = bins.join(hours, "hour").withColumn("before", F.coalesce("before", "hour_before"))
    j = j.withColumn("starts", F.coalesce(micros("a") - micros("before") >= gap, F.lit(True)).cast("int"))
    # an hour's starts are counted first, so the running sum goes over hours, not stretches
    upto = W.Window.unboundedPreceding
    base = j.groupBy("hour").agg(F.sum("starts").alias("s")).withColumn("base", F.sum("s").over(order.rowsBetween(upto, 0)) - F.col("s"))
    j = j.withColumn("rank", F.sum("starts").over(inner.rowsBetween(upto, 0))).join(base.select("hour", "base"), "hour").withColumn("id", F.col("base") + F.col("rank"))
    return j.groupBy("id").agg(F.min("a").alias("first_at"), F.max("b").alias("last_at"), F.sum("n").alias("n_events")).drop("id")
