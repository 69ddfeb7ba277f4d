"""Key-merge sinks and versioned snapshots on plain Parquet.

There is no ACID ``MERGE`` on plain files, so a merge builds the whole new
relation as a DataFrame, writes it to a new version folder and only then
publishes the version (a one-row pointer file appended to ``_versions``).
Readers resolve the newest published version; the previous snapshot stays
readable, and a failed write publishes nothing.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwatch.functions.params import utc_literal


def _now() -> datetime:
    return datetime.now(timezone.utc)


def merge_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-or-update: rows of ``new`` replace rows of ``old`` with the same
    key; old keys absent from ``new`` are kept (never deleted)."""
    keys = list(keys)
    kept = old.join(new.select(*keys), on=keys, how="left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def merge_sticky(old: DataFrame, new: DataFrame, keys: Sequence[str], sticky: Sequence[str] = (),
                 untouched: Sequence[str] = (), defaults: dict[str, object] | None = None,
                 as_of: datetime | None = None) -> DataFrame:
    """Upsert where some columns are not overwritten on conflict.

    * ``sticky``: set on insert only; an existing row keeps its value (even
      NULL) when the key is updated;
    * ``untouched``: not in the insert list at all: existing rows keep their
      value, new rows get ``defaults`` (else NULL);
    * every other column of ``new`` overwrites;
    * ``updated_at`` (when ``as_of`` is given) is set on every inserted or
      updated row.
    """
    keys, sticky, untouched = list(keys), list(sticky), list(untouched)
    defaults = defaults or {}
    o = old.select(*[F.col(c).alias("o_" + c) for c in old.columns], F.lit(True).alias("_o"))
    n = new.select(*[F.col(c).alias("n_" + c) for c in new.columns], F.lit(True).alias("_n"))
    cond = None
    for k in keys:
        c = o["o_" + k] == n["n_" + k]
        cond = c if cond is None else cond & c
    j = o.join(n, cond, "full_outer")
    has_o, has_n = F.col("_o").isNotNull(), F.col("_n").isNotNull()
    out: list[Column] = []
    columns = list(dict.fromkeys([*old.columns, *[c for c in new.columns if c not in old.columns]]))
    for c in columns:
        oc = F.col("o_" + c) if c in old.columns else F.lit(None)
        nc = F.col("n_" + c) if c in new.columns else F.lit(None)
        if c in keys:
            v = F.coalesce(oc, nc)
        elif c in sticky:
            v = F.when(has_o, oc).otherwise(nc)
        elif c in untouched:
            v = F.when(has_o, oc).otherwise(F.lit(defaults.get(c)))
        elif c == "updated_at" and as_of is not None:
            v = F.when(has_n, utc_literal(as_of)).otherwise(oc)
        else:
            v = F.when(has_n, nc).otherwise(oc)
        dtype = (old.schema[c].dataType if c in old.columns else new.schema[c].dataType)
        out.append(v.cast(dtype).alias(c))
    return j.select(*out)


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``INSERT … ON CONFLICT DO NOTHING``: add only rows with unseen keys."""
    keys = list(keys)
    return old.unionByName(new.join(old.select(*keys), on=keys, how="left_anti"),
                           allowMissingColumns=True)


def rows_frame(spark: SparkSession, schema: T.StructType, rows: list[tuple]) -> DataFrame:
    """A few literal rows as a DataFrame built on the JVM side (no Python
    serialisation), for small control records such as pointers and logs."""
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, schema.fields)])
               for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


_POINTER_SCHEMA = T.StructType([T.StructField("version", T.LongType()),
                                T.StructField("path", T.StringType()),
                                T.StructField("published_at", T.TimestampType())])


def read_json_log(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame | None:
    """An append-only log, or None if nothing was ever written there.  Any
    other failure is raised: an outage must not look like an empty log."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)


class SnapshotStore:
    """Named relations under ``root``, each a list of immutable versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._known: dict[str, str] = {}     # pointers this store published or resolved

    def _versions_dir(self, name: str) -> str:
        return f"{self.root}/{name}/_versions"

    def current(self, name: str, refresh: bool = False) -> str | None:
        """Path of the newest published version (None if none).

        Resolved once per store object (and updated by its own writes);
        ``refresh=True`` re-reads the published pointers."""
        if name in self._known and not refresh:
            return self._known[name]
        log = read_json_log(self.spark, _POINTER_SCHEMA, self._versions_dir(name))
        if log is None:
            return None
        v = log.orderBy(F.col("version").desc()).select("path").limit(1).collect()
        if v:
            self._known[name] = v[0]["path"]
            return v[0]["path"]
        return None

    def exists(self, name: str) -> bool:
        return self.current(name) is not None

    def read(self, name: str) -> DataFrame:
        path = self.current(name)
        if path is None:
            raise FileNotFoundError(f"no published snapshot {name!r} under {self.root}")
        return self.spark.read.parquet(path)

    def write(self, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> str:
        """Write ``df`` as a new version, then publish it."""
        path = self.stage(name, df, partition_by)
        return self.publish(name, path, int(path.rpartition("=")[2]))

    def stage(self, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> str:
        """Write ``df`` as a new version that nobody sees yet; its path."""
        path = f"{self.root}/{name}/v={time.time_ns()}"
        w = df.write.mode("errorifexists")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        return path

    def publish(self, name: str, path: str, version: int | None = None) -> str:
        """Make the written snapshot at ``path`` the newest version of ``name``."""
        version = time.time_ns() if version is None else version
        pointer = rows_frame(self.spark, _POINTER_SCHEMA, [(version, path, _now())])
        pointer.write.mode("append").json(self._versions_dir(name))
        self._known[name] = path
        return path
