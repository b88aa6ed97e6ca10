"""References to records that do not exist, kept up to date batch by batch.

The ledger is a folder that outlives the session: a parent index (one row for each path: earliest indexing
time, whether it exists, whether it was removed), every reference seen so far with its state, and the counts
taken after batches. A batch brings new references and parent events. New references probe the index; of the
old ones only those are judged again whose parent changed: an arrival settles waiting orphans, a withdrawal
reopens settled references. Both tables lie in buckets by path, and a batch rewrites only those it touches.

Defined results: null and empty paths are no references; a reference whose parent exists is ``late``
if the parent's earliest known indexing time is after the reference was seen (never if either time is
null), else it is settled; without a parent it is ``deleted`` if a removal is known, else ``missing``.
The order and number of batches don't change the final states. Repeated events are harmless.
Hot parents (a home note that a third of all rows name) are joined apart, see ``runtime.skew_join``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch, heavy_keys, is_filled, skew_join
from ..storage import Store

FIELDS = ("source_path", "target_path")
REFS = "ref_id bigint, field string, path string, seen_at double, state string"
PARENTS = "path string, first_indexed_at double, standing struct<seq: double, present: boolean>, removed boolean, changed_in bigint"
SNAPSHOTS = "batch bigint, field string, state string, month string, refs bigint"
FEED = "kind string, ref_id bigint, field string, path string, at double"
SETTLED = "settled"


def references(links: DataFrame) -> DataFrame:
    """(ref_id, field, path, seen_at): one row for each filled path of a link."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("path")) for f in FIELDS)))
    return links.select(F.col("link_id").alias("ref_id"), "seen_at", each.alias("r")).select("ref_id", "r.field", "r.path", "seen_at").filter(is_filled("path"))


def arrivals(notes: DataFrame) -> DataFrame:
    """Parent events of indexed notes."""
    return notes.filter(is_filled("path")).select(
        "path", "first_indexed_at", F.struct(F.coalesce("mtime", F.lit(0.0)).alias("seq"), F.lit(True).alias("present")).alias("standing"), F.lit(False).alias("removed")
    )


def removals(removed: DataFrame) -> DataFrame:
    """Parent events of recorded removals. The record alone doesn't withdraw a note that the index (again) has."""
    nothing = F.lit(None).cast("struct<seq: double, present: boolean>")
    return removed.filter(is_filled("path")).select("path", F.lit(None).cast("double").alias("first_indexed_at"), nothing.alias("standing"), F.lit(True).alias("removed"))


def withdrawals(gone: DataFrame) -> DataFrame:
    """Parent events of notes that left the index at ``removed_at``: references to them open again."""
    return gone.filter(is_filled("path")).select(
        "path", F.lit(None).cast("double").alias("first_indexed_at"), F.struct(F.col("removed_at").alias("seq"), F.lit(False).alias("present")).alias("standing"), F.lit(True).alias("removed")
    )


def _verdict() -> Column:
    present = F.coalesce(F.col("standing.present"), F.lit(False))
    late = F.coalesce(F.col("first_indexed_at") > F.col("seen_at"), F.lit(False))
    return (
        F.when(present & late, "late").when(present, SETTLED).when(F.coalesce("removed", F.lit(False)), "deleted").otherwise("missing")
    )


class OrphanLedger:
    """The state below ``folder``, which another session may go on with; ``hot`` are paths known to be hot."""

    def __init__(self, spark: SparkSession, folder: str, hot: list | None = None, buckets: int = 16):
        self.spark, self.hot = spark, hot
        self.store = Store(spark, folder, {"refs": (REFS, "path"), "parents": (PARENTS, "path")}, {"snapshots": SNAPSHOTS}, buckets)

    def apply(self, new_refs: DataFrame | None = None, parent_events: DataFrame | None = None, epoch: int | None = None, snapshot: bool = False) -> OrphanLedger:
        """One batch: (ref_id, field, path, seen_at) and parent events, either may be absent. A batch that a stream
        brings again, known by its ``epoch``, is left out. ``snapshot`` also takes the counts after it."""
        change = self.store.begin()
        meta = change.manifest["meta"]
        if epoch is not None and int(meta.get("epoch", -1)) >= epoch:
            return self
        batch = change.manifest["n"] + 1
        first = batch == 1
        woken: list[int] = []
        if parent_events is not None:
            # one row for each path of the batch first: repeated states of a note shrink before they meet the index
            events = parent_events.groupBy("path").agg(F.min("first_indexed_at").alias("first_indexed_at"), F.max("standing").alias("standing"), F.max("removed").alias("removed"))
            at = None if first else change.touched(parent_events, "path")
            old = change.read("parents", at).select("path", *(F.col(c).alias(f"old_{c}") for c in ("first_indexed_at", "standing", "removed", "changed_in")))
            both = old.join(events, "path", "full_outer").select(
                "path",
                F.least("old_first_indexed_at", "first_indexed_at").alias("first_indexed_at"),
                F.greatest("old_standing", "standing").alias("standing"),
                (F.coalesce("old_removed", F.lit(False)) | F.coalesce("removed", F.lit(False))).alias("removed"),
                F.struct("old_first_indexed_at", "old_standing.present", F.coalesce("old_removed", F.lit(False))).alias("was"), "old_changed_in",
            )
            same = F.col("was").eqNullSafe(F.struct("first_indexed_at", "standing.present", "removed"))
            change.put("parents", both.withColumn("changed_in", F.when(same, F.col("old_changed_in")).otherwise(F.lit(batch).cast("long"))), at)
            if not first:
                woken = change.touched(change.read("parents", at).filter(F.col("changed_in") == batch), "path")
        at = None if first else sorted({*woken, *(change.touched(new_refs, "path") if new_refs is not None else [])})
        if first or at:
            rows = change.read("refs", at)
            if new_refs is not None:
                rows = rows.unionByName(new_refs.select("ref_id", "field", "path", "seen_at", F.lit(None).cast("string").alias("state")))
            parents = change.read("parents", at).select("path", "first_indexed_at", "standing", "removed", (F.col("changed_in") == batch).alias("changed"))
            judged = skew_join(rows, parents, "path", "left", self.hot)
            asked = F.col("state").isNull() | F.coalesce("changed", F.lit(False))
            change.put("refs", judged.withColumn("state", F.when(asked, _verdict()).otherwise(F.col("state"))), at)
        if snapshot:
            change.add_segment("snapshots", _counts(change.read("refs")).withColumn("batch", F.lit(batch).cast("long")).select("batch", "field", "state", "month", "refs"), F.lit(0))
        change.commit(meta if epoch is None else meta | {"epoch": str(epoch)})
        return self

    def feed(self, snapshot: bool = True):
        """A foreachBatch function for a stream of ``FEED`` rows: references (at: when seen), arrivals (at: when
        indexed), removals and withdrawals (at: when removed)."""

        def run(batch: DataFrame, epoch: int) -> None:
            of = lambda kind: batch.filter(F.col("kind") == kind)
            events = arrivals(of("arrival").select("path", F.col("at").alias("first_indexed_at"), F.col("at").alias("mtime")))
            events = events.unionByName(removals(of("removal"))).unionByName(withdrawals(of("withdrawal").select("path", F.col("at").alias("removed_at"))))
            refs = of("reference").filter(is_filled("path")).select("ref_id", "field", "path", F.col("at").alias("seen_at"))
            self.apply(refs, events, epoch, snapshot)

        return run

    def orphans(self) -> DataFrame:
        """(ref_id, field, path, seen_at, state) of all open references."""
        return self.store.read("refs").filter(F.col("state") != SETTLED)

    def snapshot(self) -> DataFrame:
        """(field, state, month, refs): open references by month of seen_at; a null time has a null month."""
        return _counts(self.store.read("refs"))

    def snapshots(self) -> DataFrame:
        """(batch, field, state, month, refs): the counts taken after batches."""
        return self.store.read_segments("snapshots")


def _counts(refs: DataFrame) -> DataFrame:
    month = F.date_format(F.timestamp_millis(F.floor("seen_at").cast("long")), "yyyy-MM")
    return refs.filter(F.col("state") != SETTLED).groupBy("field", "state", month.alias("month")).agg(F.count(F.lit(1)).alias("refs"))


def track(links: DataFrame, notes: DataFrame, removed: DataFrame, batches: int = 2, folder: str | None = None) -> OrphanLedger:
    """A ledger fed in time order: each batch has the references, notes and removals of one period.

    Rows without a time come first. Periods are cut at quantiles of the links' times. Without a folder the ledger
    is of this session alone.
    """
    spark = links.sparkSession
    refs = references(links)
    ledger = OrphanLedger(spark, folder or Scratch(spark, "orphans").root, heavy_keys(refs, "path"))
    cuts = links.agg(F.percentile_approx("seen_at", [(k + 1) / batches for k in range(batches - 1)], 1000).alias("c")).first()["c"] if batches > 1 else []
    period = lambda c: sum((F.coalesce(c > F.lit(float(x)), F.lit(False)).cast("int") for x in cuts or []), F.lit(0))
    for k in range(len(cuts or []) + 1):
        events = arrivals(notes.filter(period(F.col("first_indexed_at")) == k)).unionByName(removals(removed.filter(period(F.col("removed_at")) == k)))
        ledger.apply(refs.filter(period(F.col("seen_at")) == k), events)
    return ledger


def orphan_links(links: DataFrame, notes: DataFrame, removed: DataFrame, batches: int = 2) -> DataFrame:
    """p3_found: (link_id, field, state)."""
    return track(links, notes, removed, batches).orphans().select(F.col("ref_id").alias("link_id"), "field", "state")
