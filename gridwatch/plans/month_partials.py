"""Per-meter event totals kept as one partial relation per event month.

Counts add up and latest events compare, so a month's (meter, count, latest
event) rows stand for all its events.  A manifest names, for every month, the
files that were folded and where the partial rows are.  An update lists the
stored event files, folds only the months whose files differ from the
manifest's, and carries the others over by path: a run costs what has changed,
not the history.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwatch.operators.joins import event_order
from gridwatch.operators.summaries import latest_event_columns
from gridwatch.schemas import EVENT_SCHEMA
from gridwatch.sources.readers import read_events
from gridwatch.sources.sinks import SnapshotStore, rows_frame

_MANIFEST = T.StructType([T.StructField("month", T.StringType()), T.StructField("files", T.StringType()),
                          T.StructField("path", T.StringType())])


def partial_per_meter(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per meter (and ``by``): count ``_n``, latest event ``_le`` and the order
    ``_ord`` in which it is the latest."""
    order = F.struct(*[F.col(c) for c in event_order(events)])
    return events.groupBy(*(by or []), "meter_number").agg(
        F.count(F.lit(1)).alias("_n"), F.max_by(latest_event_columns(), order).alias("_le"), F.max(order).alias("_ord"))


def merge_partials(partials: DataFrame) -> DataFrame:
    """``events_per_meter`` rows from partial rows of any months."""
    return partials.groupBy("meter_number").agg(F.sum("_n").alias("_n"), F.max_by("_le", "_ord").alias("_le"))


class MonthPartials:
    """The partial relation under ``root`` for events stored by month."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = SnapshotStore(spark, self.root)

    def manifest(self) -> dict[str, tuple[str, str | None]]:
        """Folder of every folded month: its files' fingerprint and the path of
        its partial rows (none: a month without rows).  One row per month."""
        if not self.store.exists("manifest"):
            return {}
        return {r["month"]: (r["files"], r["path"]) for r in self.store.read("manifest").collect()}

    def stored_months(self, events_path: str) -> dict[str, str]:
        """Folder of every stored month and a fingerprint of its files (names,
        lengths, times).  The files are listed by Spark, not opened."""
        files = (self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
                 .load(events_path).select("path", "length", "modificationTime"))
        each = F.xxhash64(F.element_at(F.split("path", "/"), -1), "length", "modificationTime").cast("decimal(38,0)")
        rows = (files.groupBy(F.regexp_extract("path", r"/(event_month=[^/]+)/", 1).alias("month"))
                .agg(F.concat_ws("-", F.count("*"), F.sum("length"), F.sum(each)).alias("files")))
        return {r["month"]: r["files"] for r in rows.where("month <> ''").collect()}

    def update(self, events_path: str) -> list[str]:
        """Fold the months that are new or changed; the months that were read.
        Months that are no longer stored leave the manifest."""
        old, now = self.manifest(), self.stored_months(events_path)
        changed = sorted(m for m, files in now.items() if m not in old or old[m][0] != files)
        kept = {m: old[m] for m in now if m not in changed}
        if not changed and len(kept) == len(old):
            return []
        if changed:
            version = time.time_ns()
            path = f"{self.root}/partials/v={version}"
            events = read_events(self.spark, events_path, months=changed)
            (partial_per_meter(events, ["event_month"]).hint("rebalance", "event_month")
             .write.partitionBy("event_month").parquet(path))
            written = set(self._folders(path))
            kept |= {m: (now[m], f"{path}/{m}" if m in written else None) for m in changed}
        self.store.write("manifest", rows_frame(self.spark, _MANIFEST, [(m, *kept[m]) for m in sorted(kept)])
                         if kept else self.spark.createDataFrame([], _MANIFEST))
        return changed

    def _folders(self, path: str) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return [e.getPath().getName() for e in fs.listStatus(folder) if e.isDirectory()]

    def per_meter(self) -> DataFrame:
        """All folded months as ``events_per_meter`` rows."""
        paths = [p for _, p in self.manifest().values() if p]
        if not paths:
            return merge_partials(partial_per_meter(self.spark.createDataFrame([], EVENT_SCHEMA)))
        return merge_partials(self.spark.read.parquet(*paths))
