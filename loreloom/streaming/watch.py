"""Keeping a stored index up to date from a stream of file events."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..index import StoredIndex
from ..runtime import Scratch
from ..sources.vault import DEFAULT_EXCLUDES, stream_vault
from .sync import AfterQuiet


def latest(events: DataFrame) -> DataFrame:
    """Each path's last event of a batch: a write and a deletion in one batch settle as the later one."""
    last = F.max(F.struct("seen_at", (F.col("kind") == "write").alias("w"), "kind", "mtime", "raw")).alias("e")
    return events.groupBy("path").agg(last).select("path", "e.kind", "e.mtime", "e.raw", "e.seen_at")


def apply_events(index: StoredIndex, events: DataFrame, now_ms: float | None = None) -> bool:
    """One micro-batch as one set-based update of the buckets it touches; a batch that is applied twice changes nothing.
    Returns whether there was anything to change."""
    scratch = Scratch(index.spark, "events")
    last = scratch.write(latest(events), "latest")
    stored = index.notes().select("path", "mtime")
    # what the index holds already is not parsed again, and what it lacks need not go
    files = last.filter("kind = 'write'").select("path", "raw", "mtime").join(stored, ["path", "mtime"], "left_anti").select("path", "raw", "mtime")
    gone = last.filter("kind = 'delete'").select("path").join(stored, "path", "left_semi")
    changed = bool(files.select("path").union(gone).take(1))
    if changed:
        index.apply(scratch.write(files, "files"), scratch.write(gone, "gone"), time.time() * 1000 if now_ms is None else now_ms)
    scratch.clear()
    return changed


@dataclass
class WatcherHealth:
    alive: bool = False
    last_event_at: float | None = None
    errors: int = 0
    start_error: str = ""


class HealthListener(StreamingQueryListener):
    """Liveness of the watching query from its progress reports."""

    def __init__(self) -> None:
        self.health = WatcherHealth()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001
        self.health.alive = True

    def onQueryProgress(self, event) -> None:  # noqa: ANN001
        if event.progress.numInputRows:
            self.health.last_event_at = time.time() * 1000

    def onQueryIdle(self, event) -> None:  # noqa: ANN001
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001
        self.health.alive = False
        if event.exception:
            self.health.errors += 1


def watch(
    spark: SparkSession, root: str, index: StoredIndex, checkpoint: str, excludes: tuple[str, ...] = DEFAULT_EXCLUDES, debounce_ms: int = 400, once: bool = False, state: str | None = None,
    after_quiet: Callable[[], object] | None = None, quiet_s: float = 10.0,
) -> StreamingQuery:
    """Starts the query that follows a vault. A written note is taken once it has been quiet for ``debounce_ms``, each
    path by itself; deletions are taken with the next look, of which there are two in that time. The stream's first
    batch is the whole vault; notes that vanished before are removed by a refresh. ``once`` catches up and stops.
    ``state`` is the folder of the listings, beside the checkpoint if that is a folder. ``after_quiet`` is called once
    nothing has changed for ``quiet_s`` seconds after a change, ``sync.git_sync`` of the vault for example."""
    index.refresh(root, excludes)
    if state is None:
        if "://" in checkpoint:
            raise ValueError("give a folder for the listings, which executors write as plain files")
        state = os.path.join(checkpoint.removeprefix("file:"), "listings")
    events = stream_vault(spark, root, state, excludes, 0 if once else debounce_ms)
    step = lambda df, _: apply_events(index, df)
    step = step if after_quiet is None else AfterQuiet(step, after_quiet, quiet_s)
    writer = events.writeStream.foreachBatch(lambda df, epoch: step(df, epoch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(1, debounce_ms // 2)} milliseconds")).start()
