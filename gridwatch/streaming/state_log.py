"""A keyed relation that micro-batches maintain on plain files.

Every micro-batch writes its rows into a folder of its own number, so a batch
that runs again replaces what it wrote.  ``fold`` reduces any rows of the log
to one row per key; every ``compact_every`` batches the log is folded into a new
published base, and the folders that the base before it already held are
removed (a reader that still has that base needs only later ones).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwatch.sources.sinks import SnapshotStore

#: Name of the base's snapshot.
BASE = "meters"


class StateLog:
    """The log at ``path``; ``fold`` takes and gives ``columns`` and
    ``batch_id``, the newest batch that a row comes from."""

    def __init__(self, spark: SparkSession, path: str, columns: list[str], fold: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.columns, self.fold = spark, path.rstrip("/"), columns, fold

    def base(self) -> tuple[str | None, int]:
        """Newest base (path, batch id), if any."""
        path = SnapshotStore(self.spark, f"{self.path}_base").current(BASE)
        if path is None:
            return None, -1
        upto = self.spark.read.parquet(path).agg(F.max("batch_id")).collect()[0][0]
        return path, -1 if upto is None else int(upto)

    def _has_batches(self) -> bool:
        return bool(self._batches())

    def _batches(self) -> list[tuple[int, object]]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(folder):
            return []
        names = [(e.getPath().getName(), e.getPath()) for e in fs.listStatus(folder)]
        return [(int(n.removeprefix("batch_id=")), p) for n, p in names if n.startswith("batch_id=")]

    def rows(self) -> DataFrame:
        """The base and what was written after it."""
        base, upto = self.base()
        columns = [*self.columns, "batch_id"]
        if base is not None and not self._has_batches():
            return self.spark.read.parquet(base).select(*columns)
        log = self.spark.read.option("basePath", self.path).parquet(self.path)
        log = log.filter(F.col("batch_id") > upto).select(*columns)
        return log if base is None else self.spark.read.parquet(base).select(*columns).unionByName(log)

    def read(self) -> DataFrame:
        """One row per key, without ``batch_id``."""
        return self.fold(self.rows()).select(*self.columns)

    def append(self, batch: DataFrame, batch_id: int, compact_every: int = 0) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}"))
        if compact_every and (batch_id + 1) % compact_every == 0:
            self.compact()

    def compact(self) -> str:
        upto = self.base()[1]
        path = SnapshotStore(self.spark, f"{self.path}_base").write(BASE, self.fold(self.rows()))
        self._remove(upto)
        return path

    def seed(self, rows: DataFrame, batch_id: int = -1) -> str:
        """Publish ``rows`` as the base of all batches up to ``batch_id``."""
        rows = rows.withColumn("batch_id", F.lit(batch_id).cast("long"))
        return SnapshotStore(self.spark, f"{self.path}_base").write(BASE, rows.select(*self.columns, "batch_id"))

    def _remove(self, upto: int) -> None:
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        for batch_id, path in self._batches():
            if batch_id <= upto:
                path.getFileSystem(conf).delete(path, True)
