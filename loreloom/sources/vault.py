"""A folder of markdown notes as a table: a Python data source for batches and streams.

Spark's own file source skips names that begin with a dot or underscore, follows symbolic links and
cuts times to milliseconds; this one lists what a vault holds: all ``*.md`` files, no symbolic links
(neither files nor folders), no folder whose name is excluded, unreadable entries left out.

Executors list and read, a task for each folder of the first two levels (which must be folders that all of
them see); the driver looks at those levels alone.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote, unquote

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

# Folders of note applications, version control and agents: fixed values.
DEFAULT_EXCLUDES = (".obsidian", ".trash", ".git", ".claude", ".loreloom")
LISTING = "path string, mtime double, size bigint"
FILES = "path string, raw string, mtime double"
EVENTS = "path string, kind string, mtime double, raw string, seen_at double"


def walk(root: str, excludes: tuple[str, ...] = DEFAULT_EXCLUDES, start: str = "", deep: bool = True) -> Iterator[tuple[str, float, int]]:
    """(vault-relative path, mtime in milliseconds, size) of every note below a folder, or in it alone."""
    stack = [start]
    while stack:
        rel = stack.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, rel)), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            name = f"{rel}/{e.name}" if rel else e.name
            try:
                if e.is_symlink():
                    continue
                if e.is_dir():
                    if deep and e.name not in excludes:
                        stack.append(name)
                elif e.name.endswith(".md"):
                    st = e.stat()
                    yield name, st.st_mtime_ns / 1e6, st.st_size
            except OSError:
                continue


def _inner(root: str, rel: str, excludes: tuple[str, ...]) -> list[str]:
    try:
        entries = [e.name for e in os.scandir(os.path.join(root, rel)) if e.name not in excludes and not e.is_symlink() and e.is_dir()]
    except OSError:
        return []
    return sorted(f"{rel}/{n}" if rel else n for n in entries)


def shares(root: str, excludes: tuple[str, ...]) -> list[tuple[str, bool]]:
    """(folder, whether all below it is meant) of the tasks: the root's and its folders' own notes, and each folder below those whole."""
    first = _inner(root, "", excludes)
    return [("", False), *((f, False) for f in first), *((g, True) for f in first for g in _inner(root, f, excludes))]


def folders(root: str, excludes: tuple[str, ...] = DEFAULT_EXCLUDES) -> Iterator[str]:
    """Every folder, also those without a note: a link may name one."""
    for here, dirs, _ in os.walk(root):
        dirs[:] = sorted(x for x in dirs if x not in excludes and not os.path.islink(os.path.join(here, x)))
        for x in dirs:
            yield os.path.relpath(os.path.join(here, x), root).replace(os.sep, "/")


def read_text(root: str, rel: str) -> str | None:
    try:
        return Path(root, rel).read_bytes().decode("utf-8", "replace")
    except OSError:
        return None


@dataclass
class Share(InputPartition):
    folder: str
    deep: bool
    start: int = 0
    end: int = 0


def _options(options: dict) -> tuple[str, tuple[str, ...]]:
    root = options.get("path") or options.get("root")
    if not root:
        raise ValueError("give the vault's folder as path")
    excludes = options.get("excludes")
    return root, tuple(json.loads(excludes)) if excludes else DEFAULT_EXCLUDES


class VaultReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.with_text = "raw" in schema.fieldNames()
        self.root, self.excludes = _options(options)

    def partitions(self) -> list[Share]:
        return [Share(f, deep) for f, deep in shares(self.root, self.excludes)]

    def read(self, partition: Share) -> Iterator[tuple]:
        for rel, mtime, size in walk(self.root, self.excludes, partition.folder, partition.deep):
            if not self.with_text:
                yield rel, mtime, size
            elif (text := read_text(self.root, rel)) is not None:
                yield rel, text, mtime


class VaultStream(DataSourceStreamReader):
    """Writes and deletions since the last snapshot; nothing is missed while no one looks.

    An offset is a snapshot's number. Each task lists its share, keeps the listing below ``state`` under the number
    that the batch ends with, and compares it with the one that the batch starts from; a batch that runs again finds its
    listing there and gives the same events. A note written less than ``debounce_ms`` ago waits: its old time stays
    in the listing until it has been quiet for so long. Deletions are told at once.
    """

    def __init__(self, options: dict):
        self.root, self.excludes = _options(options)
        self.state, self.debounce = options["state"], float(options.get("debounce_ms", 0))

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in os.listdir(self.state) if n.isdigit()) if os.path.isdir(self.state) else []

    def latestOffset(self) -> dict:
        return {"n": max([0, *self._numbers()]) + 1}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        now = {(f, deep) for f, deep in shares(self.root, self.excludes)}
        # folders that vanished have deletions to tell
        old = os.path.join(self.state, str(start["n"]))
        before = {(unquote(n[1:].removesuffix(".json")), n[0] == "d") for n in os.listdir(old) if n.endswith(".json")} if os.path.isdir(old) else set()
        return [Share(f, deep, start["n"], end["n"]) for f, deep in sorted(now | before)]

    def _file(self, n: int, share: Share) -> str:
        return os.path.join(self.state, str(n), ("d" if share.deep else "s") + quote(share.folder, safe="") + ".json")

    def _known(self, n: int, share: Share) -> dict[str, float] | None:
        try:
            with open(self._file(n, share), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def _snapshot(self, before: dict[str, float], share: Share) -> dict[str, float]:
        quiet_since, now = time.time() * 1000 - self.debounce, {}
        for rel, mtime, _ in walk(self.root, self.excludes, share.folder, share.deep):
            if before.get(rel) != mtime and quiet_since < mtime <= quiet_since + self.debounce:
                if rel in before:
                    now[rel] = before[rel]
            else:
                now[rel] = mtime
        path = self._file(share.end, share)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        draft = f"{path}.{uuid.uuid4().hex[:8]}"
        with open(draft, "w", encoding="utf-8") as f:
            json.dump(now, f)
        os.replace(draft, path)
        return now

    def read(self, partition: Share) -> Iterator[tuple]:
        before = self._known(partition.start, partition) or {}
        now = self._known(partition.end, partition)
        if now is None:
            now = self._snapshot(before, partition)
        at = time.time() * 1000
        for rel, mtime in sorted(now.items()):
            if before.get(rel) != mtime:
                text = read_text(self.root, rel)
                yield (rel, "write", mtime, text, at) if text is not None else (rel, "delete", None, None, at)
        for rel in sorted(before.keys() - now.keys()):
            yield rel, "delete", None, None, at

    def commit(self, end: dict) -> None:
        for n in self._numbers():
            if n < end["n"] - 1:
                shutil.rmtree(os.path.join(self.state, str(n)), ignore_errors=True)


class VaultDataSource(DataSource):
    """``spark.read.format("vault").load(folder)``: (path, raw, mtime); option content=false lists (path, mtime, size);
    ``spark.readStream``: (path, kind, mtime, raw, seen_at), with option state, a folder for its listings."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        if self.options.get("stream") == "true":
            return EVENTS
        return LISTING if self.options.get("content") == "false" else FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return VaultReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return VaultStream(dict(self.options))


def read_vault(spark: SparkSession, root: str, excludes: tuple[str, ...] = DEFAULT_EXCLUDES, content: bool = True) -> DataFrame:
    spark.dataSource.register(VaultDataSource)
    return spark.read.format("vault").option("excludes", json.dumps(excludes)).option("content", str(content).lower()).load(root)


def read_files(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """(path, raw, mtime) of the notes (path, mtime) named, read where the rows are; unreadable ones are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = pa.array([read_text(root, p) for p in part["path"].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part["path"], texts, part["mtime"]], ["path", "raw", "mtime"])

    return paths.select("path", F.col("mtime").cast("double")).mapInArrow(read, FILES).filter("raw IS NOT NULL")


def stream_vault(spark: SparkSession, root: str, state: str, excludes: tuple[str, ...] = DEFAULT_EXCLUDES, debounce_ms: int = 0) -> DataFrame:
    spark.dataSource.register(VaultDataSource)
    r = spark.readStream.format("vault").option("excludes", json.dumps(excludes)).option("stream", "true")
    return r.option("state", state).option("debounce_ms", str(debounce_ms)).load(root)
