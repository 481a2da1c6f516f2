"""S7/S8 without rewriting tables: versions of a clinic that share unchanged buckets.

Rows of a table lie in hash buckets of their primary key, each a folder of Parquet
files. A change reads and writes only the buckets that its keys fall in, in a new
folder; a manifest (one row per table and bucket: where the bucket lies) makes all of a
version's tables visible at once. Spark's committer shows a manifest's one file by a
rename when its job ends, so a reader sees a version whole or not at all, and a write
that fails leaves only folders that no manifest names.

One writer works at a time; of two that commit the same version the later one
fails, since its manifest is there. The driver holds the manifest (tables x
buckets), never rows. Choose ``buckets`` so that one fits a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odonto.operators.patch import apply_patch, merge_patches
from odonto.schemas import PRIMARY_KEYS, SCHEMAS
from odonto.sources.tables import conform

#: Per table, the keys a change touches and the rows that replace the touched buckets' rows.
Changes = dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]]
MANIFEST = "table string, bucket int, folder string, buckets int"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(buckets)).cast("int")


class VersionedTables:
    """Tables under ``path``, seen as of ``version`` (the latest by default)."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.schema(f"{MANIFEST}, version int").json(f"{self.path}/manifests")
        self.version = rows.agg(F.max("version")).first()[0] if version is None else version
        found = rows.filter(F.col("version") == self.version).collect()
        if not found:
            raise ValueError(f"no version {version} under {path}")
        self.buckets = {r.table: r.buckets for r in found}
        self.folders = {(r.table, r.bucket): r.folder for r in found}

    @classmethod
    def create(cls, spark: SparkSession, path: str, tables: dict[str, DataFrame], buckets: int = 64) -> "VersionedTables":
        """Version 0: whole tables, dealt into buckets."""
        store = cls.__new__(cls)
        store.spark, store.path, store.version = spark, path.rstrip("/"), -1
        store.buckets, store.folders = dict.fromkeys(tables, buckets), {}
        return store._commit({n: (range(buckets), df) for n, df in tables.items()})

    def table(self, name: str, buckets=None) -> DataFrame:
        """The rows of a table, or of some of its buckets."""
        wanted = range(self.buckets[name]) if buckets is None else buckets
        folders = [f"{self.path}/{self.folders[name, b]}" for b in wanted if self.folders.get((name, b))]
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*folders)

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets that keys of a table fall in: at most ``buckets`` numbers."""
        of = _bucket(PRIMARY_KEYS[name], self.buckets[name]).alias("bucket")
        return sorted(r.bucket for r in keys.select(of).distinct().collect())

    def rows_of(self, name: str, keys: DataFrame) -> DataFrame:
        """The stored rows with these keys, read from their buckets only."""
        key = PRIMARY_KEYS[name]
        return self.table(name, self.touched(name, keys)).join(keys.select(key).distinct(), key, "left_semi")

    def change(self, changes: Changes) -> "VersionedTables":
        """The next version: per table, the touched buckets' rows become what the
        function makes of them. Its rows must keep to those buckets."""
        parts = {}
        for name, (keys, replace) in changes.items():
            if hit := self.touched(name, keys):
                parts[name] = (hit, replace(self.table(name, hit)))
        return self._commit(parts)

    def patch(self, name: str, patches: DataFrame, fields: list[str],
              stamp: tuple[str, Column] | None = None) -> "VersionedTables":
        """Sparse patches by key (``has_<field>``, ``seq``), latest present value wins."""
        key = PRIMARY_KEYS[name]
        return self.change({name: (patches, lambda base: apply_patch(
            base, merge_patches(patches, key, fields), key, fields, stamp=stamp))})

    def upsert(self, name: str, rows: DataFrame) -> "VersionedTables":
        """Whole rows by key replace stored ones or join them."""
        key, new = PRIMARY_KEYS[name], conform(rows, name)
        return self.change({name: (new, lambda base: base.join(new.select(key), key, "left_anti").unionByName(new))})

    def delete(self, name: str, keys: DataFrame) -> "VersionedTables":
        key = PRIMARY_KEYS[name]
        return self.change({name: (keys, lambda base: base.join(keys.select(key).distinct(), key, "left_anti"))})

    def _commit(self, parts: dict) -> "VersionedTables":
        folders = dict(self.folders)
        for name, (hit, rows) in parts.items():
            # A folder of its own per attempt: what a failed one left is in nobody's way.
            data = f"data/{name}/{uuid.uuid4().hex[:16]}"
            key, n = PRIMARY_KEYS[name], self.buckets[name]
            (conform(rows, name).withColumn("_bucket", _bucket(key, n)).repartition(len(hit), "_bucket")
             .sortWithinPartitions("_bucket", key).write.partitionBy("_bucket").parquet(f"{self.path}/{data}"))
            filled = self._filled(f"{self.path}/{data}")
            if strays := filled - set(hit):
                raise ValueError(f"{name}: rows outside of the touched buckets {sorted(strays)[:5]}")
            for b in hit:
                folders[name, b] = f"{data}/_bucket={b}" if b in filled else ""
        entries = [(n, b, f, self.buckets[n]) for (n, b), f in sorted(folders.items())]
        manifest = self.spark.createDataFrame(entries, MANIFEST).coalesce(1)
        manifest.write.json(f"{self.path}/manifests/version={self.version + 1}")
        return VersionedTables(self.spark, self.path, self.version + 1)

    def _filled(self, data: str) -> set[int]:
        """The buckets that a write gave a folder (an empty one has none)."""
        try:
            written = self.spark.read.parquet(data)
        except Exception as e:                      # nothing but _SUCCESS: no schema to infer
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return set()
        return {r[0] for r in written.select("_bucket").distinct().collect()}
