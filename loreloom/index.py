"""A stored index: notes, links and full-text postings of one vault in a ``storage.Store``.

A build writes the buckets that changed notes and links lie in, adds the changed notes' postings as a
segment, and publishes all of it with one manifest. A posting counts only if no later segment has its note
among those it touched; when segments get many, one replaces them all.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import corpus, links as link_ops, search
from .runtime import Scratch
from .sources.vault import DEFAULT_EXCLUDES, read_files, read_vault
from .storage import Change, Store

LAST_FULL = "last_full_reindex_at"
#: Segments of postings beyond which a build makes them one.
MOST_SEGMENTS = 8
NOTES = corpus.NOTES + ", raw string"
FILES = "path string, raw string, mtime double"


@dataclass(frozen=True)
class IndexResult:
    indexed: int
    removed: int


class StoredIndex:
    """Notes (with raw text), links, postings and metadata of one vault.

    ``buckets`` of notes and links, and ``parts`` of postings, are fixed by the first build; choose them so that one
    holds some gigabytes at most.
    """

    def __init__(self, spark: SparkSession, directory: str, buckets: int = 16, parts: int = search.PARTS):
        self.spark, self.buckets, self.parts = spark, buckets, parts
        self.dir = directory

    @property
    def store(self) -> Store:
        tables = {"notes": (NOTES, "path"), "links": (corpus.LINKS, "source_path")}
        return Store(self.spark, self.dir, tables, {"postings": search.POSTINGS + ", gen bigint", "touched": "path string, gen bigint"}, self.buckets)

    def version(self) -> int:
        return self.store.manifest()["n"]

    def notes(self) -> DataFrame:
        return self.store.read("notes")

    def links(self) -> DataFrame:
        """A link's target path; links of an older index that has none are resolved here."""
        return self.store.read("links")

    def meta(self) -> dict[str, str]:
        return self.store.meta

    def write_meta(self, meta: dict[str, str]) -> None:
        """Settings change without a new version of the tables."""
        self.store.begin().commit(meta)

    def full_text(self) -> search.FullText:
        """Postings as they were published last; a query reads the parts of its terms alone."""
        change = self.store.begin()
        return search.FullText(change.read("notes").drop("raw"), lambda parts: self._postings(change, parts), change.manifest.get("parts", self.parts))

    def _postings(self, change: Change, parts: list[int] | None) -> DataFrame:
        rows = change.read_segments("postings", parts)
        if len(change.manifest["segments"].get("postings", [])) > 1:
            # notes touched since the first segment: at most those of ``MOST_SEGMENTS`` builds
            later = change.read_segments("touched").groupBy("path").agg(F.max("gen").alias("last"))
            rows = rows.join(later, "path", "left").filter(F.col("last").isNull() | (F.col("gen") >= F.col("last")))
        return rows.select("term", "path", "dl", "at")

    # --- builds ---

    def reindex(self, root: str, excludes: tuple[str, ...] = DEFAULT_EXCLUDES, force: bool = False, now_ms: float | None = None) -> IndexResult:
        """A full build: every file is listed, changed ones are parsed, vanished ones go, all links are resolved."""
        now_ms = time.time() * 1000 if now_ms is None else now_ms
        out = self._update(root, excludes, now_ms, force)
        self.write_meta(self.meta() | {LAST_FULL: datetime.fromtimestamp(now_ms / 1000, timezone.utc).isoformat()})
        return out

    def refresh(self, root: str, excludes: tuple[str, ...] = DEFAULT_EXCLUDES, now_ms: float | None = None) -> IndexResult:
        """Only what changed since the stored listing; reads no file if nothing did."""
        return self._update(root, excludes, time.time() * 1000 if now_ms is None else now_ms, False)

    def _update(self, root: str, excludes: tuple[str, ...], now_ms: float, force: bool) -> IndexResult:
        scratch = Scratch(self.spark, "refresh")
        listing = read_vault(self.spark, root, excludes, content=False)
        old = self.notes().select("path", "mtime")
        if force:
            todo = listing.select("path", "mtime", F.lit("changed").alias("change"))
            changes = todo.unionByName(old.join(listing, "path", "left_anti").select("path", "mtime", F.lit("deleted").alias("change")))
        else:
            changes = corpus.diff(old, listing)
        changes = scratch.write(changes.select("path", "mtime", "change"), "changes")
        try:
            if self.version() and not changes.take(1):
                return IndexResult(0, 0)
            files = read_files(self.spark, root, changes.filter("change <> 'deleted'"))
            return self.apply(files, changes.filter("change = 'deleted'").select("path"), now_ms, force)
        finally:
            scratch.clear()

    def apply(self, files: DataFrame, gone: DataFrame, now_ms: float, force: bool = False) -> IndexResult:
        """One set-based step for any number of changed files (path, raw, mtime) and removed paths (path)."""
        scratch = Scratch(self.spark, "apply")
        change = self.store.begin()
        parsed = scratch.write(corpus.parse(files), "parsed")
        touched = scratch.write(parsed.select("path").unionByName(gone.select("path")).distinct(), "touched")
        old_names = change.read("notes").select("path", "title").join(touched, "path", "left_semi")
        named = scratch.write(old_names.unionByName(parsed.select("path", "title")), "named")

        buckets = change.touched(touched, "path")
        old = change.read("notes", buckets)
        fresh = corpus.upsert(old.drop("raw"), parsed, now_ms, changed_only=not force).join(parsed.select("path", "raw"), "path")
        change.put("notes", old.join(touched, "path", "left_anti").unionByName(fresh.select(old.columns)), buckets)

        # links of the touched notes, and whatever a new, changed or vanished note may have been called, before and after
        before = change.read("links")
        new_links = corpus.links_of(parsed).withColumn("target_path", F.lit(None).cast("string"))
        targets = link_ops.affected_targets(before, named).unionByName(new_links.select("target")).distinct()
        done = link_ops.resolve_targets(targets, change.read("notes").select("path", "title")).select("target", F.col("target_path").alias("new_path"))
        done = scratch.write(done, "resolved")
        moved = before.join(done, "target").filter(~F.col("target_path").eqNullSafe(F.col("new_path"))).select("source_path")
        buckets = change.touched(moved.unionByName(touched.select(F.col("path").alias("source_path"))), "source_path")
        links = corpus.replace_links(change.read("links", buckets), new_links, touched)
        redone = links.join(done.withColumn("redone", F.lit(True)), "target", "left")
        links = redone.select("source_path", "target", F.when(F.col("redone"), F.col("new_path")).otherwise(F.col("target_path")).alias("target_path"))
        change.put("links", links, buckets)

        self._index_text(change, parsed, touched, whole=force or not change.manifest["n"])
        result = IndexResult(parsed.count(), gone.count())
        change.commit()
        scratch.clear()
        return result

    def _index_text(self, change: Change, parsed: DataFrame, touched: DataFrame, whole: bool) -> None:
        gen = F.lit(change.manifest["n"] + 1).cast("long")
        rows = search.postings_of(parsed).withColumn("gen", gen)
        part = search.part_of("term", change.manifest.setdefault("parts", self.parts))
        change.add_segment("postings", rows, part, "term", replace=whole)
        change.add_segment("touched", touched.withColumn("gen", gen), F.lit(0), replace=whole)
        if len(change.manifest["segments"]["postings"]) > MOST_SEGMENTS:
            change.add_segment("postings", self._postings(change, None).withColumn("gen", gen), part, "term", replace=True)
            change.add_segment("touched", touched.limit(0).withColumn("gen", gen), F.lit(0), replace=True)

    def migrate_links(self, old_links: DataFrame) -> None:
        """Takes over links of an older index: without ``target_path`` they are all resolved, with it they stay."""
        change = self.store.begin()
        if "target_path" not in old_links.columns:
            old_links = link_ops.resolve_links(old_links, change.read("notes").select("path", "title"))
        change.put("links", old_links.select("source_path", "target", "target_path").dropDuplicates(["source_path", "target"]))
        change.commit()
