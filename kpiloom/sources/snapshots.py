"""Stored tables as immutable Parquet files under numbered snapshots.

A snapshot is a small JSON file that names manifests; a manifest is a Parquet table with one row for each data file: its path,
rows, and least and largest key. A change writes new data files and a manifest, then claims the next snapshot number by a rename
that fails if another writer was first. Readers see one snapshot whole; a change that fails leaves the last one as it was.

Keyed tables are cut into files of disjoint key ranges, so an upsert rewrites only the files whose range holds a changed key, a
deletion only the files that hold a deleted row, and a page only reads the files it lies in. Event logs have no key: they are
appended to by batches and streams alike, and a (writer, batch) pair counts once however often it is sent.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from uuid import uuid4

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one data file at most.
FILE_ROWS = 5_000_000
#: An append merges the manifests when a snapshot names this many.
MANIFESTS = 50
ATTEMPTS = 20


class CommitConflict(RuntimeError):
    """Another writer claimed the snapshot number first."""


@dataclass(frozen=True)
class Snapshot:
    """One state of a table. ``writers`` holds the last batch of each writer that numbers its appends."""

    version: int
    manifests: tuple[str, ...]
    schema: str
    writers: dict[str, int]


def _comparable(values) -> tuple:
    return tuple((v is not None, v) for v in values)


class StoredTable:
    """A table of immutable files at ``path``, with the columns of its key if rows are to be replaced or paged by key."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = (), file_rows: int = FILE_ROWS):
        self.spark, self.path, self.keys, self.file_rows = spark, path.rstrip("/"), tuple(keys), file_rows

    @cached_property
    def _files(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        """The numbers of all snapshots, in order."""
        folder = self._at("versions")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot | None:
        """A stated snapshot or the last one; None if the table has none yet."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        stream = self._files.open(self._at(f"versions/{version:012d}.json"))
        try:
            state = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Snapshot(version, tuple(state["manifests"]), state["schema"], state["writers"])

    def _commit(self, base: Snapshot | None, manifests: Sequence[str], schema: str, writers: dict[str, int]) -> Snapshot:
        new = Snapshot(base.version + 1 if base else 0, tuple(manifests), schema, writers)
        draft, final = self._at(f"drafts/{uuid4().hex}"), self._at(f"versions/{new.version:012d}.json")
        out = self._files.create(draft)
        out.write(json.dumps({"manifests": new.manifests, "schema": schema, "writers": writers}).encode())
        out.close()
        self._files.mkdirs(final.getParent())
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(final), plain)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            raise CommitConflict(f"snapshot {new.version} of {self.path} is taken") from None
        return new

    def _schema(self, snapshot: Snapshot) -> T.StructType:
        return T.StructType.fromJson(json.loads(snapshot.schema))

    def manifest(self, snapshot: Snapshot | None = None) -> DataFrame:
        """Path, rows, and least and largest key of each data file."""
        snapshot = snapshot or self._existing()
        return self.spark.read.parquet(*[f"{self.path}/{m}" for m in snapshot.manifests])

    def _existing(self, version: int | None = None) -> Snapshot:
        found = self.snapshot(version)
        if found is None:
            raise LookupError(f"no table at {self.path}")
        return found

    def _rows(self, schema: T.StructType, paths: Sequence[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths]).select(*[f"`{c}`" for c in schema.names])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a snapshot, the last one unless stated."""
        snapshot = self._existing(version)
        return self._rows(self._schema(snapshot), [r.path for r in self.manifest(snapshot).select("path").collect()])

    def read_keys(self, low, high) -> DataFrame:
        """Rows whose first key column lies between two values, read from the files that can hold them."""
        snapshot, first = self._existing(), self.keys[0]
        held = self.manifest(snapshot).filter((F.col("low")[first] <= F.lit(high)) & (F.col("high")[first] >= F.lit(low)))
        return self._rows(self._schema(snapshot), [r.path for r in held.select("path").collect()]).filter(F.col(first).between(low, high))

    def _key(self) -> Column:
        return F.struct(*self.keys) if self.keys else F.struct(F.lit(None).cast("string").alias("none"))

    def _written(self, rows: DataFrame, slot: str | None) -> DataFrame:
        """Write rows as data files, one folder for each slot; return their manifest rows."""
        schema = T.StructType([f for f in rows.schema.fields if f.name != slot])
        folder = f"data/{uuid4().hex}"
        writer = rows.write.option("maxRecordsPerFile", self.file_rows)
        (writer.partitionBy(slot) if slot else writer).parquet(f"{self.path}/{folder}")
        stored = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{folder}")
        path = F.regexp_extract("_metadata.file_path", f"({folder}/.*)$", 1)
        keyed = stored.select(path.alias("path"), self._key().alias("key"))
        return keyed.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))

    def _stored_manifest(self, manifest: DataFrame) -> str:
        name = f"manifests/{uuid4().hex}"
        manifest.coalesce(1).write.parquet(f"{self.path}/{name}")  # one row for each data file
        return name

    def _tried(self, change) -> Snapshot:
        """Run a change against the last snapshot, again on a newer one if another writer was first."""
        for _ in range(ATTEMPTS):
            try:
                return change(self.snapshot())
            except CommitConflict as conflict:
                last = conflict
        raise last

    def _sorted(self, rows: DataFrame, slot: str) -> DataFrame:
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartitionByRange(tasks, slot, *self.keys)

    def create(self, rows: DataFrame) -> Snapshot:
        """First snapshot with all rows, cut into files by key. It fails with ``CommitConflict`` if there is one already."""
        slot = _unused("slot", rows.columns)
        if self.keys:
            cut = self._sorted(rows.withColumn(slot, F.lit(0)), slot).sortWithinPartitions(slot, *self.keys)
            files = self._written(cut, slot)
        else:
            files = self._written(rows, None)
        return self._commit(None, [self._stored_manifest(files)], rows.schema.json(), {})

    def append(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> Snapshot:
        """Add rows to a log, created if need be. A batch number that its writer has reached before is left out."""
        if self.keys:
            raise ValueError("rows of a keyed table are replaced, not appended")
        if writer is not None and (known := self.snapshot()) and known.writers.get(writer, -1) >= batch:
            return known
        added = self._stored_manifest(self._written(rows, None))

        def change(base: Snapshot | None) -> Snapshot:
            writers = dict(base.writers) if base else {}
            if writer is not None:
                if writers.get(writer, -1) >= batch:
                    return base
                writers[writer] = batch
            manifests = [*(base.manifests if base else ()), added]
            if base and len(manifests) > MANIFESTS:
                manifests = [self._stored_manifest(self.manifest(base).unionByName(self.spark.read.parquet(f"{self.path}/{added}")))]
            return self._commit(base, manifests, base.schema if base else rows.schema.json(), writers)

        return self._tried(change)

    def _slots(self, rows: DataFrame, starts: list[tuple], slot: str) -> DataFrame:
        """Number of the file whose range a row's key falls in; ranges reach to the next file's least key."""
        starts = starts[1:]  # all below the second file belong to the first
        shared = self.spark.sparkContext.broadcast(starts)
        numbers = len(self.keys) == 1 and all(isinstance(s[0], int) and not isinstance(s[0], bool) for s in starts)

        def place(*keys: pd.Series) -> pd.Series:
            if numbers and keys[0].dtype.kind == "i":
                return pd.Series(np.searchsorted(np.array([s[0] for s in shared.value], np.int64), keys[0].to_numpy(), side="right"))
            bounds = [_comparable(s) for s in shared.value]
            missing = [(None if pd.isna(v) else v for v in k) for k in keys]
            return pd.Series([bisect_right(bounds, _comparable(t)) for t in zip(*missing, strict=True)])

        if not starts:
            return rows.withColumn(slot, F.lit(0))
        return rows.withColumn(slot, F.pandas_udf(place, "int")(*[F.col(f"`{k}`") for k in self.keys]))

    def _ranges(self, snapshot: Snapshot) -> list:
        return self.manifest(snapshot).orderBy("low").collect()  # one row for each data file

    def upsert(self, incoming: DataFrame, changed_at: str) -> Snapshot:
        """Replace rows by key: the newest wins, an incoming row wins a tie. Only files that a key falls in are rewritten."""
        slot, fresh, rank = (_unused(n, incoming.columns) for n in ("slot", "fresh", "rank"))

        def change(base: Snapshot | None) -> Snapshot:
            if base is None:
                raise LookupError(f"no table at {self.path}")
            files = self._ranges(base)
            starts = [tuple(f.low) for f in files]
            new = self._slots(incoming, starts, slot).withColumn(fresh, F.lit(1))
            touched = {r[0] for r in new.select(slot).distinct().collect()}  # numbers of files
            if not touched:
                return base
            schema = self._schema(base)
            old = self._slots(self._rows(schema, [f.path for i, f in enumerate(files) if i in touched]), starts, slot).withColumn(fresh, F.lit(0))
            first = Window.partitionBy(slot, *self.keys).orderBy(F.desc(changed_at), F.desc(fresh))
            merged = self._sorted(old.unionByName(new), slot).withColumn(rank, F.row_number().over(first)).filter(F.col(rank) == 1)
            written = self._written(merged.drop(fresh, rank), slot)
            untouched = self.spark.createDataFrame([f for i, f in enumerate(files) if i not in touched], self.manifest(base).schema)
            return self._commit(base, [self._stored_manifest(untouched.unionByName(written))], base.schema, base.writers)

        return self._tried(change)

    def delete(self, gone: DataFrame, column: str) -> Snapshot:
        """Remove the rows whose ``column`` is among those of ``gone``. Only files that hold such a row are rewritten."""

        def change(base: Snapshot | None) -> Snapshot:
            if base is None:
                raise LookupError(f"no table at {self.path}")
            schema, files = self._schema(base), self._ranges(base)
            values = gone.select(F.col(column)).distinct()
            held = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f.path}" for f in files]) if files else None
            if held is None:
                return base
            path = F.regexp_extract("_metadata.file_path", "(data/[0-9a-f]{32}/.*)$", 1)
            hit = held.select(F.col(column), path.alias("path")).join(values, column, "left_semi")
            touched = {r.path for r in hit.select("path").distinct().collect()}  # paths of files
            if not touched:
                return base
            slot = _unused("slot", schema.names)
            left = self._rows(schema, [f.path for f in files if f.path in touched]).join(values, column, "left_anti")
            if self.keys:
                cut = self._sorted(self._slots(left, [tuple(f.low) for f in files], slot), slot).sortWithinPartitions(slot, *self.keys)
                written = self._written(cut, slot)
            else:
                written = self._written(left, None)
            untouched = self.spark.createDataFrame([f for f in files if f.path not in touched], self.manifest(base).schema)
            return self._commit(base, [self._stored_manifest(untouched.unionByName(written))], base.schema, base.writers)

        return self._tried(change)

    def page(self, page: int, page_size: int) -> DataFrame:
        """One page of rows in key order. The manifest's row counts tell the files it lies in; no other file is read."""
        snapshot = self._existing()
        first, stop, seen, paths, skipped = (max(1, page) - 1) * page_size, max(1, page) * page_size, 0, [], 0
        for file in self._ranges(snapshot):
            if seen < stop and seen + file.rows > first:
                skipped = skipped if paths else seen
                paths.append(file.path)
            seen += file.rows
        return self._rows(self._schema(snapshot), paths).orderBy(*self.keys).offset(first - skipped).limit(page_size)


def _unused(name: str, columns: Sequence[str]) -> str:
    """A column name that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    return next(n for n in _names(name) if n not in taken)


def _names(name: str) -> Iterator[str]:
    yield f"_{name}"
    n = 0
    while True:
        n += 1
        yield f"_{name}{n}"
