"""Keyed snapshots in hash buckets: a merge rewrites only what it touches.

The manifest names the folder of every bucket.  A merge reads the buckets that
hold a key of the new rows, writes these anew into one version folder and
publishes a manifest in which all others keep their old folders; the snapshot
before stays readable, and a failed merge publishes nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwatch.sources.sinks import SnapshotStore, folder_exists, merge_by_key, rows_frame

BUCKET = "bucket"
_MANIFEST = T.StructType([T.StructField(BUCKET, T.IntegerType()), T.StructField("path", T.StringType())])
_SHAPE = "_shape"


class BucketedSnapshot:
    """The relation ``name`` under ``root``, in ``buckets`` hash buckets of ``key``."""

    def __init__(self, spark: SparkSession, root: str, name: str, key: str, buckets: int = 64):
        self.spark, self.name, self.key, self.buckets = spark, name, key, buckets
        self.root = f"{root.rstrip('/')}/{name}_buckets"
        self.store = SnapshotStore(spark, self.root)
        #: Buckets that the last merge wrote.
        self.written: list[int] = []

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def manifest(self) -> dict[int, str]:
        """Folder of every bucket that has rows (as many rows as buckets)."""
        if not self.store.exists("manifest"):
            return {}
        return {r[BUCKET]: r["path"] for r in self.store.read("manifest").collect()}

    def exists(self) -> bool:
        return self.store.exists("manifest")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        paths = [p for b, p in self.manifest().items() if buckets is None or b in buckets]
        if not paths:
            return self.store.read(_SHAPE)
        return self.spark.read.parquet(*paths)

    def _write(self, rows: DataFrame, touched: list[int], kept: dict[int, str]) -> None:
        path = f"{self.root}/data/v={time.time_ns()}"
        if touched:
            dealt = self._dealt(rows)
            dealt.repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(path)
        new = {b: f"{path}/{BUCKET}={b}" for b in touched if folder_exists(self.spark, f"{path}/{BUCKET}={b}")}
        self.written = sorted(new)
        entries = sorted((kept | new).items())
        self.store.write("manifest", rows_frame(self.spark, _MANIFEST, entries) if entries else self.spark.createDataFrame([], _MANIFEST))

    def replace(self, rows: DataFrame) -> None:
        """The whole relation anew."""
        self.store.write(_SHAPE, rows.limit(0))
        self._write(rows, list(range(self.buckets)), {})

    def merge(self, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> list[int]:
        """Merge ``new`` (default: insert or update by key); the buckets written.
        ``how(old, new)`` sees the touched buckets' rows only and must keep
        every row in its key's bucket."""
        if not self.exists():
            self.replace(how(new.limit(0), new) if how else new)
            return self.written
        touched = sorted(r[0] for r in self._dealt(new.select(self.key)).select(BUCKET).distinct().collect())   # at most all buckets
        old = self.manifest()
        before = self.read([b for b in touched if b in old]) if any(b in old for b in touched) else self.store.read(_SHAPE)
        merged = how(before, new) if how else merge_by_key(before, new, [self.key])
        self._write(merged, touched, {b: p for b, p in old.items() if b not in touched})
        return self.written
