"""Tables in a shared folder, changed by buckets and published by numbered manifests.

A table's rows lie in buckets by the hash of a key; a change writes only the buckets it touches, into new
folders, and then a new manifest that names each bucket's folder. Readers take the newest manifest, so they
see either whole state, and nothing is read and overwritten at once. A table may instead be a list of
segments, to which a change only adds. All files go through Spark's file systems; none is on the driver's disk.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """Small files and folders on whatever file system a path names."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_once(self, path: str, text: str) -> None:
        """A whole file or none; raises if someone else has written it."""
        fs, p = self._at(path)
        draft = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(p) or not fs.rename(draft, p):
            fs.delete(draft, False)
            raise FileExistsError(path)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def state(self, path: str) -> tuple[int, int]:
        """(bytes, time of the last change) of a file or of a folder's files."""
        fs, p = self._at(path)
        files = [s for s in fs.listStatus(p) if s.isFile()]
        return sum(s.getLen() for s in files), max((s.getModificationTime() for s in files), default=0)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class Store:
    """``tables`` maps a name to its schema and key; ``segments`` maps a name to its schema."""

    def __init__(self, spark: SparkSession, directory: str, tables: dict[str, tuple[str, str]], segments: dict[str, str] | None = None, buckets: int = 16):
        self.spark, self.dir, self.tables, self.segments = spark, directory.rstrip("/"), tables, segments or {}
        self.files, self._buckets = Files(spark), buckets

    def manifest(self) -> dict:
        numbers = [n for n in self.files.names(self.dir) if n.startswith("manifest-") and n.endswith(".json")]
        if not numbers:
            return {"n": 0, "buckets": self._buckets, "tables": {}, "segments": {}, "meta": {}}
        return json.loads(self.files.read(f"{self.dir}/{max(numbers)}"))

    def begin(self) -> Change:
        return Change(self, self.manifest())

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        return self.begin().read(name, buckets)

    def read_segments(self, name: str, where: list[int] | None = None) -> DataFrame:
        return self.begin().read_segments(name, where)

    @property
    def meta(self) -> dict[str, str]:
        return self.manifest()["meta"]


class Change:
    """What the next manifest will say; sees its own writes."""

    def __init__(self, store: Store, manifest: dict):
        self.store, self.manifest, self.buckets = store, manifest, manifest["buckets"]
        self.version = f"{manifest['n'] + 1:09d}-{uuid.uuid4().hex[:6]}"
        self._writes = 0

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame, key: str) -> list[int]:
        """The buckets that hold any of the keys: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket(key).alias("b")).distinct().collect())

    def _folder(self, name: str) -> str:
        self._writes += 1
        return f"{name}/{self.version}-{self._writes}"

    def _load(self, schema: str, paths: list[str]) -> DataFrame:
        spark = self.store.spark
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        held = self.manifest["tables"].get(name, {})
        paths = [f"{self.store.dir}/{folder}/b={b}" for b, folder in held.items() if buckets is None or int(b) in buckets]
        return self._load(self.store.tables[name][0], paths)

    def put(self, name: str, rows: DataFrame, buckets: list[int] | None = None) -> None:
        """The new rows of the given buckets (None: of all); other buckets stay as they are. Big buckets become several files."""
        schema, key = self.store.tables[name]
        buckets = list(range(self.buckets)) if buckets is None else buckets
        if not buckets:
            return
        columns = [c.split()[0] for c in _fields(schema)]
        folder = self._folder(name)
        out = rows.select(*columns, self.bucket(key).alias("b")).hint("rebalance", F.col("b"))
        out.write.partitionBy("b").parquet(f"{self.store.dir}/{folder}")
        made = {n.removeprefix("b=") for n in self.store.files.names(f"{self.store.dir}/{folder}") if n.startswith("b=")}
        held = dict(self.manifest["tables"].get(name, {}))
        for b in map(str, buckets):
            held.pop(b, None)
            if b in made:
                held[b] = folder
        self.manifest["tables"][name] = held

    def read_segments(self, name: str, where: list[int] | None = None) -> DataFrame:
        """Rows of all segments, or of their partitions ``where`` alone."""
        segments = self.manifest["segments"].get(name, [])
        paths = [f"{self.store.dir}/{s['folder']}/b={b}" for s in segments for b in s["parts"] if where is None or b in where]
        return self._load(self.store.segments[name], paths)

    def add_segment(self, name: str, rows: DataFrame, part: Column, sort: str | None = None, replace: bool = False) -> None:
        """A further segment, parted by ``part`` and sorted within its files; ``replace`` makes it the only one."""
        folder = self._folder(name)
        out = rows.withColumn("b", part).hint("rebalance", F.col("b"))
        out = out.sortWithinPartitions("b", sort) if sort else out
        out.write.partitionBy("b").parquet(f"{self.store.dir}/{folder}")
        parts = sorted(int(n.removeprefix("b=")) for n in self.store.files.names(f"{self.store.dir}/{folder}") if n.startswith("b="))
        old = [] if replace else self.manifest["segments"].get(name, [])
        self.manifest["segments"][name] = [*old, {"folder": folder, "parts": parts}]

    def commit(self, meta: dict[str, str] | None = None) -> None:
        """Publishes everything at once; raises if another change was published since this one began."""
        store, m = self.store, self.manifest
        before = m["n"]
        m["n"] = before + 1
        if meta is not None:
            m["meta"] = meta
        store.files.write_once(f"{store.dir}/manifest-{m['n']:012d}.json", json.dumps(m))
        self._clean(before)

    def _clean(self, before: int) -> None:
        """Deletes what neither this manifest nor the one before names; readers of that one may still be at work."""
        store = self.store
        kept = _folders(self.manifest)
        last = f"manifest-{before:012d}.json"
        names = store.files.names(store.dir)
        if last in names:
            kept |= _folders(json.loads(store.files.read(f"{store.dir}/{last}")))
        for n in names:
            if n.startswith("manifest-") and n < last:
                store.files.delete(f"{store.dir}/{n}")
        for table in (*store.tables, *store.segments):
            for folder in store.files.names(f"{store.dir}/{table}"):
                if f"{table}/{folder}" not in kept:
                    store.files.delete(f"{store.dir}/{table}/{folder}")


def _folders(manifest: dict) -> set[str]:
    held = {f for t in manifest["tables"].values() for f in t.values()}
    return held | {s["folder"] for t in manifest["segments"].values() for s in t}


def _fields(schema: str) -> list[str]:
    """The top-level fields of a schema text."""
    out, depth, held = [], 0, ""
    for c in schema:
        depth += c in "<(["
        depth -= c in ">)]"
        if c == "," and not depth:
            out.append(held.strip())
            held = ""
        else:
            held += c
    return [*out, held.strip()]
