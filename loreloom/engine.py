"""One object for the questions asked of a vault; every answer is a DataFrame."""

from __future__ import annotations

import os
import time
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from .index import LAST_FULL, IndexResult, StoredIndex
from .operators import actions, context, corpus, digest, graph, health, links, search
from .sources.config import VaultConfig, load_config
from .sources.vault import folders

MAX_WEB_RESULTS, DEFAULT_WEB_RESULTS = 50, 20


class Engine:
    def __init__(self, spark: SparkSession, config: VaultConfig | str):
        self.spark = spark
        self.config = load_config(config) if isinstance(config, str) else config
        self.index = StoredIndex(spark, self.config.index_dir)

    def reindex(self, force: bool = False, now_ms: float | None = None) -> IndexResult:
        return self.index.reindex(self.config.root, self.config.exclude_dirs, force, now_ms)

    def refresh(self, now_ms: float | None = None) -> IndexResult:
        return self.index.refresh(self.config.root, self.config.exclude_dirs, now_ms)

    def _catch_up(self) -> None:
        """Reads see the vault as it is; a failed refresh leaves the last index."""
        if self.config.auto_refresh:
            try:
                self.refresh()
            except OSError:
                pass

    @property
    def notes(self) -> DataFrame:
        return self.index.notes()

    @property
    def links(self) -> DataFrame:
        return self.index.links()

    def search(self, query: str, limit: int = 10, tag: str | None = None, path_prefix: str | None = None) -> DataFrame:
        self._catch_up()
        return search.search(self.index.full_text(), query, limit, tag, path_prefix)

    def web_search(self, query: str, limit: int | None = None) -> DataFrame:
        """As a search box asks: nothing below two characters, at most fifty results."""
        n = min(MAX_WEB_RESULTS, max(1, DEFAULT_WEB_RESULTS if limit is None else limit))
        if len(query.strip()) < 2:
            return search.like_search(self.notes.limit(0), query, n)
        return self.search(query, n)

    def expand(self, note: str, depth: int = 1, limit: int = 20) -> DataFrame:
        self._catch_up()
        return context.expand(self.notes, self.links, note, depth, limit)

    def topic(self, text: str, limit: int = 15, path_prefix: str | None = None) -> DataFrame:
        self._catch_up()
        return context.topic(self.index.full_text(), self.links, text, limit, path_prefix)

    def stats(self) -> DataFrame:
        self._catch_up()
        return corpus.stats(self.notes, self.links)

    def top_tags(self, k: int = 20) -> DataFrame:
        return corpus.top_tags(self.notes, k)

    def last_full_reindex(self) -> datetime | None:
        text = self.index.meta().get(LAST_FULL)
        return datetime.fromisoformat(text) if text else None

    def resolve(self, target: str) -> DataFrame:
        return links.resolve_one(target, self.notes)

    def graph_stats(self) -> DataFrame:
        nodes = graph.graph_nodes(self.notes, list(self.config.health.exclude_from_graph))
        return graph.graph_stats(nodes, graph.graph_edges(self.links, nodes))

    def audit(self, report_unresolved: bool = False, now: datetime | None = None) -> DataFrame:
        self.refresh()  # an audit of an old index would mislead, so a failure is raised
        dirs = self.spark.createDataFrame([(f,) for f in folders(self.config.root, self.config.exclude_dirs)], "path string")
        now = now or datetime.now(timezone.utc)
        return health.audit(self.notes, self.links, self.notes.select("path", "raw"), now, self.config.health, report_unresolved, dirs)

    def digest(self, output: str = "2-Areas/_DAILY-DIGEST.md", now: datetime | None = None) -> str:
        """Writes the rolling digest note and moves the watermark once it is written; returns the section.

        Dates and times are those of the zone of ``now``."""
        now = now or datetime.now(timezone.utc)
        now_ms = now.timestamp() * 1000
        self.reindex(now_ms=now_ms)
        meta, today = self.index.meta(), now.date()
        cut = digest.cutoff(meta, today, now.tzinfo)
        entry = digest.render(digest.changed_since(self.notes, cut), today, digest.window(today)[1], now.tzinfo)
        path = output if os.path.isabs(output) else os.path.join(self.config.root, output)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        existing = open(path, encoding="utf-8").read() if os.path.exists(path) else ""
        with open(path, "w", encoding="utf-8") as f:
            f.write(digest.document(entry, existing, today))
        self.index.write_meta(digest.advance(meta, cut, today, now_ms))
        return entry

    def actions(self, today: date | None = None, owner: str = "") -> DataFrame:
        self._catch_up()
        rows = actions.parse_registers(actions.registers(self.notes.select("path", "raw")))
        return actions.open_actions(rows, today or date.today(), owner)

    def register_paths(self) -> list[str]:
        """Of one vault's action registers."""
        return [r["path"] for r in actions.registers(self.notes.select("path")).orderBy("path").collect()]

    def worklist(self, today: date | None = None, owner: str = "") -> DataFrame:
        rows = actions.parse_registers(actions.registers(self.notes.select("path", "raw")))
        return actions.worklist(rows, today or date.today(), owner)

    def is_stale(self) -> bool:
        """Whether a note on disk is newer than anything indexed, by more than a millisecond."""
        from .sources.vault import read_vault

        row = corpus.freshness(self.notes, read_vault(self.spark, self.config.root, self.config.exclude_dirs, content=False)).first()
        return bool(row["stale"])

    def timed(self, df: DataFrame) -> tuple[list, float]:
        """Collected rows of a small answer and the milliseconds they took, to one decimal."""
        t = time.time()
        return df.collect(), round((time.time() - t) * 1000, 1)
