"""A keyed table stored by ranges of its first key, with versions: an upsert rewrites the ranges it touches and nothing else.

    path/data/v3/range=7/part-....parquet   rows of a range, as version 3 wrote them
    path/manifests/v3.json                  where each range of version 3 lies, and where ranges begin
    path/CURRENT                            the version that readers see

A version is complete before CURRENT is switched to it, by one rename, so a crash in between leaves the old one as it was. A range that
isn't touched keeps its files under their names. Manifests are small: a line for each range. Two writers can't make one
version: the second finds its manifest there and fails. A range that a batch could bring over `most_rows` is cut into several
by quantiles of its keys, so tasks that merge and sort a range stay of one size as the table grows. Ranges are dealt to tasks by their
numbers: a hash would lay several on one.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Collection, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..tables import Tables
from .store import insert_or_ignore, upsert

_RANGE, _TASK = "range", "__task"
#: Neighbouring ranges are written by one task where they may hold so many rows together; a larger one is a task of its own.
TASK_ROWS = 250_000


def at_or_below(bounds: Sequence[int], key: Column) -> Column:
    """How many of the ascending bounds are not above the key, 0 for null: a binary search, so that many ranges cost little more than few."""
    if not bounds:
        return F.lit(0)
    listed = F.array(*[F.lit(b).cast("long") for b in bounds])

    def step(at: Column, n: Column) -> Column:
        return F.when((at + n <= len(bounds)) & (F.get(listed, at + n - 1) <= key), at + n).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))]), F.lit(0), step)


class RangedTable:
    """Rows with unique keys, of which the first is a number that ranges are cut by."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], most_rows: int = 1_000_000):
        self.spark, self.path, self.keys, self.most_rows = spark, path.rstrip("/"), list(keys), most_rows

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read_text(self, name: str) -> str | None:
        if not self._files().exists(self._at(name)):
            return None
        stream = self._files().open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write_text(self, name: str, text: str, replace: bool) -> None:
        out = self._files().create(self._at(name), replace)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    @property
    def version(self) -> int:
        """The current version; 0 before the first."""
        found = self._read_text("CURRENT")
        return int(found) if found else 0

    def manifest(self, version: int | None = None) -> dict:
        """`bounds`: the first key of every range but the first; `schema`; `ranges`: folder, rows and digest of each range that has rows."""
        n = self.version if version is None else version
        return json.loads(self._read_text(f"manifests/v{n}.json")) if n else {"bounds": [], "schema": None, "ranges": {}}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the current one."""
        return self._rows(self.manifest(version))

    def _rows(self, manifest: dict, only: Sequence[int] | None = None, own: Sequence[StructField] = ()) -> DataFrame:
        schema = StructType([*(StructType.fromJson(manifest["schema"]).fields if manifest["schema"] else []), *own])
        asked = only if only is None or isinstance(only, range) else set(only)
        folders = [f"{self.path}/{r['folder']}" for k, r in manifest["ranges"].items() if asked is None or int(k) in asked]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def lookup(self, low: int, high: int) -> DataFrame:
        """Rows whose first key lies between two values: only their ranges are listed and read."""
        found = self.manifest()
        only = range(bisect_right(found["bounds"], low), bisect_right(found["bounds"], high) + 1)
        return self._rows(found, only).filter(F.col(self.keys[0]).between(low, high))

    def create(self, rows: DataFrame, ranges: int = 16) -> None:
        """The first version, or a new one with other ranges, of about as many rows each; more than `ranges` where these would hold over `most_rows`."""
        ranges = max(ranges, -(-rows.count() // self.most_rows))
        self._publish(rows, self._cuts(rows, ranges), {}, rows)

    def _cuts(self, rows: DataFrame, ranges: int) -> list[int]:
        share = [k / ranges for k in range(1, ranges)]
        return sorted({int(b) for b in rows.approxQuantile(self.keys[0], share, 0.01 / ranges)}) if share else []

    def upsert(self, new: DataFrame, order: str) -> list[int]:
        """Last write wins; in a batch the last by `order`, which isn't stored. The ranges that were rewritten."""
        return self._merge(new, lambda old, fresh: upsert(old.withColumn(order, F.lit(None).cast(fresh.schema[order].dataType)), fresh, self.keys, order).drop(order))

    def insert_or_ignore(self, new: DataFrame, order: str) -> list[int]:
        """First write wins; in a batch the first by `order`, which isn't stored."""
        return self._merge(new, lambda old, fresh: insert_or_ignore(old, fresh, self.keys, order))

    def _range_of(self, bounds: Sequence[int]) -> Column:
        return at_or_below(bounds, F.col(self.keys[0]).cast("long"))

    def _merge(self, new: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        manifest, tables = self.manifest(), Tables()
        if manifest["schema"] is None:
            raise ValueError(f"no table at {self.path}")
        fresh = tables.stored(new, "batch")  # read for its ranges and for its rows
        come = {r[_RANGE]: r["count"] for r in fresh.groupBy(self._range_of(manifest["bounds"]).alias(_RANGE)).count().collect()}
        if come:
            old = self._rows(manifest, sorted(come))
            sizes = {k: n + manifest["ranges"].get(str(k), {"rows": 0})["rows"] for k, n in come.items()}
            keys = old.select(self.keys[0]).unionByName(fresh.select(self.keys[0]))
            self._replace(manifest, sizes, keys, merged(old, fresh).select(*old.columns), old)
        tables.drop(fresh)
        return sorted(come)

    def _replace(self, manifest: dict, sizes: dict[int, int], keys: DataFrame, rows: DataFrame, like: DataFrame) -> None:
        """`rows` in place of those of the ranges in `sizes`, which may come to hold so many; those that may be too large are cut."""
        bounds = manifest["bounds"]
        full = {k: n for k, n in sizes.items() if n > self.most_rows}
        cut = bounds
        if full:
            inside = keys.filter(self._range_of(bounds).isin(*full))
            cut = sorted({*bounds, *self._cuts(inside, -(-sum(full.values()) // self.most_rows))})
        # A range that stays begins where it did, so its place among all bounds is known.
        kept = {str(bisect_right(cut, bounds[int(k) - 1]) if int(k) else 0): r for k, r in manifest["ranges"].items() if int(k) not in sizes}
        self._publish(rows, cut, kept, like)

    def _dealt(self, rows: DataFrame, bounds: Sequence[int], kept: Collection[str]) -> DataFrame:
        """Rows of the ranges that aren't kept with their task, each range in one and none with more than TASK_ROWS rows and a range."""
        own = [k for k in range(len(bounds) + 1) if str(k) not in kept]
        each = max(1, TASK_ROWS // self.most_rows)
        place = at_or_below(own, F.col(_RANGE)) - 1 if kept else F.col(_RANGE)
        return rows.withColumn(_TASK, F.floor(place / each).cast("int")).repartitionById(max(1, -(-len(own) // each)), _TASK)

    def _laid(self, rows: DataFrame, bounds: Sequence[int]) -> DataFrame:
        """The rows of a task as they are stored."""
        return rows

    @staticmethod
    def _digest(columns: Sequence[str]) -> list[Column]:
        """The number of rows and two sums of hashes, in any order of rows and columns."""
        hashes = [F.xxhash64(F.lit(seed), *[F.col(c) for c in sorted(columns)]).cast("decimal(38,0)") for seed in (1, 2)]
        return [F.count("*").alias("rows"), F.concat_ws(":", *[F.sum(h).cast("string") for h in hashes]).alias("digest")]

    def _publish(self, rows: DataFrame, bounds: list[int], kept: dict, like: DataFrame) -> None:
        version = self.version + 1
        folder = f"data/v{version}"
        dealt = self._dealt(rows.withColumn(_RANGE, self._range_of(bounds)), bounds, kept)
        self._laid(dealt, bounds).drop(_TASK).write.mode("overwrite").partitionBy(_RANGE).parquet(f"{self.path}/{folder}")
        back = self.spark.read.parquet(f"{self.path}/{folder}") if self._has_ranges(folder) else None
        told = back.groupBy(_RANGE).agg(*self._digest(like.columns)).collect() if back is not None else []
        ranges = kept | {str(r[_RANGE]): {"folder": f"{folder}/{_RANGE}={r[_RANGE]}", "rows": r["rows"], "digest": r["digest"]} for r in told}
        found = {"bounds": bounds, "schema": like.schema.jsonValue(), "ranges": dict(sorted(ranges.items(), key=lambda x: int(x[0])))}
        self._write_text(f"manifests/v{version}.json", json.dumps(found), replace=False)
        self._switch(version)

    def sync(self, rows: DataFrame) -> list[int]:
        """Make the table hold exactly these rows, and tell which ranges were rewritten: those whose digest differs from the stored one.

        Where nothing has changed the rows are read once and nothing is written. Columns other than the stored ones make a new table.
        """
        manifest = self.manifest()
        stored = StructType.fromJson(manifest["schema"]) if manifest["schema"] else StructType([])
        if {(f.name, f.dataType) for f in stored} != {(f.name, f.dataType) for f in rows.schema}:
            self.create(rows)
            return [int(k) for k in self.manifest()["ranges"]]
        place = self._range_of(manifest["bounds"])
        found = {r[_RANGE]: (r["rows"], r["digest"]) for r in rows.groupBy(place.alias(_RANGE)).agg(*self._digest(rows.columns)).collect()}
        held = {int(k): (r["rows"], r.get("digest")) for k, r in manifest["ranges"].items()}
        touched = sorted(k for k in {*found, *held} if found.get(k) != held.get(k))
        if touched:
            fresh = rows.filter(place.isin(*touched)).select(*stored.names)
            self._replace(manifest, {k: found.get(k, (0,))[0] for k in touched}, fresh.select(self.keys[0]), fresh, fresh)
        return touched

    def _has_ranges(self, folder: str) -> bool:
        return any(s.isDirectory() for s in self._files().listStatus(self._at(folder)))

    def _switch(self, version: int) -> None:
        """The one step that readers see."""
        jvm = self.spark.sparkContext._jvm
        self._write_text(f"CURRENT.v{version}", str(version), replace=True)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._at(f"CURRENT.v{version}"), self._at("CURRENT"), how)

    def vacuum(self) -> int:
        """Remove folders and manifests that the current version doesn't use; how many folders went."""
        files, now = self._files(), self.version
        used = {r["folder"] for r in self.manifest()["ranges"].values()}
        gone = 0
        for version in files.listStatus(self._at("data")):
            name = f"data/{version.getPath().getName()}"
            for part in files.listStatus(version.getPath()):
                at = f"{name}/{part.getPath().getName()}"
                if part.isDirectory() and at not in used:
                    gone += bool(files.delete(part.getPath(), True))
            if not any(u.startswith(f"{name}/") for u in used):
                files.delete(version.getPath(), True)
        for found in files.listStatus(self._at("manifests")):
            if found.getPath().getName() != f"v{now}.json":
                files.delete(found.getPath(), False)
        return gone
