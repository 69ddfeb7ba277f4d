"""Scans and ingest.

* CSV ingest of customers and events: every column is read as text (codes
  and meter numbers keep their leading zeros; no schema inference), then
  typed with the coercion rules.  Layout assumption (the source's load
  script is not available): a header row whose names are the table's column
  names; columns missing from a file are NULL, extra columns are ignored.
* Events are stored partitioned by ``event_month`` ('yyyy-MM'); queries
  with a time range add the matching month predicate, so Spark prunes
  whole months before reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwatch.functions import coerce as CO
from gridwatch.schemas import CUSTOMER_COLUMNS, EVENT_COLUMNS
from gridwatch.sources.csv_blocks import read_csv_blocks
from gridwatch.sources.sinks import SnapshotStore, folder_exists

_DATE_RE = r"^\d{4}-\d{2}-\d{2}$"

# Columns the API row typing does not carry.
API_SKIPPED = ("createdat", "updatedat", "geolocation")


def coerce_to(c: Column, dtype: T.DataType) -> Column:
    """Text column typed by the coercion rules for ``dtype``."""
    if isinstance(dtype, T.StringType):
        return CO.coerce_text(c)
    if isinstance(dtype, T.DoubleType):
        return CO.coerce_double(c)
    if isinstance(dtype, T.LongType):
        return CO.coerce_long(c)
    if isinstance(dtype, T.DecimalType):
        return CO.coerce_decimal(c, dtype.precision, dtype.scale)
    if isinstance(dtype, T.BooleanType):
        return CO.coerce_bool(c)
    if isinstance(dtype, T.TimestampType):
        return CO.parse_timestamp(c)
    if isinstance(dtype, T.DateType):
        return F.when(c.rlike(_DATE_RE), c.try_cast("date"))
    raise TypeError(f"no coercion for {dtype}")


def _native(c: Column, source: T.DataType, dtype: T.DataType) -> Column:
    """A column that is not text: numbers are true unless 0, else a cast."""
    if isinstance(dtype, T.BooleanType) and isinstance(source, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c.try_cast("boolean"), F.lit(False))
    return c.try_cast(dtype)


def _typed_columns(df: DataFrame, columns: list[tuple[str, T.DataType]]) -> list[Column]:
    out = []
    for name, dtype in columns:
        source = df.schema[name].dataType if name in df.columns else T.StringType()
        c = F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")
        typed = coerce_to(c, dtype) if isinstance(source, T.StringType) else _native(c, source, dtype)
        out.append(typed.alias(name))
    return out


def _typed(df: DataFrame, columns: list[tuple[str, T.DataType]]) -> DataFrame:
    return df.select(*_typed_columns(df, columns))


def typed_customers(df: DataFrame, api: bool = False) -> DataFrame:
    """One ``select`` turning text customer columns into their types.

    ``api=True`` drops the columns the API does not carry."""
    cols = [(n, t) for n, t in CUSTOMER_COLUMNS if not (api and n in API_SKIPPED)]
    return _typed(df, cols)


def typed_events(df: DataFrame) -> DataFrame:
    return _typed(df, EVENT_COLUMNS)


# Column that keeps the text of a record that does not fit the header.
CORRUPT = "_corrupt_record"


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, plus ``CORRUPT``.  Quoted line ends and doubled
    quotes are read as databases export them, one file by many tasks; every
    file's columns are taken by the names in its own header."""
    return read_csv_blocks(spark, path, CORRUPT)


def judged(raw: DataFrame, columns: list[tuple[str, T.DataType]], required: list[str]) -> DataFrame:
    """Typed rows with ``reason``, why a row can't be loaded ('' if it can): its
    record is malformed or a ``required`` column is missing or unreadable; and
    ``record``, the columns of such a row as JSON text."""
    text = F.struct(*[F.col(f"`{n}`").alias(n) for n in raw.columns])
    rows = raw.select(*_typed_columns(raw, columns), text.alias("_text"))

    def blank(n: str) -> Column:
        return F.coalesce(F.col("_text")[n], F.lit("")) == "" if n in raw.columns else F.lit(True)

    why = [F.when(F.col("_text")[CORRUPT].isNotNull(), F.lit("malformed record"))] + [
        F.when(F.col(n).isNull(), F.when(blank(n), F.lit(f"missing {n}")).otherwise(F.lit(f"unreadable {n}"))) for n in required]
    reason = F.concat_ws("; ", *why)
    return rows.withColumn("reason", reason).select(*[n for n, _ in columns], "reason", F.when(F.col("reason") != "", F.to_json("_text")).alias("record"))


def _split(raw: DataFrame, columns: list[tuple[str, T.DataType]], required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejects); every input row is in one of the two."""
    rows = judged(raw, columns, required)
    return (rows.filter(F.col("reason") == "").select(*[n for n, _ in columns]),
            rows.filter(F.col("reason") != "").select("record", "reason"))


# Columns without which a row can't be loaded.
CUSTOMER_REQUIRED = ["ecgkey"]
EVENT_REQUIRED = ["meter_number", "event_time"]


def split_customers_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Loadable customers and rejects (``record``, ``reason``)."""
    return _split(read_text_csv(spark, path), CUSTOMER_COLUMNS, CUSTOMER_REQUIRED)


def split_events_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Loadable tamper events and rejects (``record``, ``reason``)."""
    return _split(read_text_csv(spark, path), EVENT_COLUMNS, EVENT_REQUIRED)


def read_customers_csv(spark: SparkSession, path: str) -> DataFrame:
    """Loadable customer records; the others are in ``split_customers_csv``."""
    return split_customers_csv(spark, path)[0]


def read_events_csv(spark: SparkSession, path: str) -> DataFrame:
    """Loadable tamper events; the others are in ``event_rejects``."""
    return split_events_csv(spark, path)[0]


def event_rejects(spark: SparkSession, path: str) -> DataFrame:
    return split_events_csv(spark, path)[1]


# What a CSV load stages: columns and required columns by relation.
LOADED = {"customer_records": (CUSTOMER_COLUMNS, CUSTOMER_REQUIRED), "tamper_events": (EVENT_COLUMNS, EVENT_REQUIRED)}


def stage_csv(spark: SparkSession, path: str, store: SnapshotStore, name: str) -> str:
    """Parse the CSV files once and stage all rows under ``name``, loadable ones
    and rejects in folders of their own; events by month, clustered by meter.
    Nothing is published."""
    columns, required = LOADED[name]
    rows = judged(read_text_csv(spark, path), columns, required).withColumn("rejected", F.col("reason") != "")
    by = ["rejected"]
    if name == "tamper_events":
        by.append("event_month")
        rows = rows.withColumn("event_month", F.when(~F.col("rejected"), F.date_format("event_time", "yyyy-MM")))
        rows = rows.sortWithinPartitions("rejected", "event_month", "meter_number", "event_time")
    staged = store.stage(name, rows, by)
    for folder in (f"{staged}/rejected=true", f"{staged}/rejected=false"):
        if not folder_exists(spark, folder):          # no such row: an empty relation
            rows.where("false").drop("rejected", "event_month").write.parquet(folder)
    return staged


def staged_rejects(spark: SparkSession, staged: str, source: str) -> DataFrame:
    """``(source, record, reason)`` of what ``stage_csv`` rejected."""
    return spark.read.parquet(f"{staged}/rejected=true").select(F.lit(source).alias("source"), "record", "reason")


def with_event_month(events: DataFrame) -> DataFrame:
    """Month bucket of ``event_time`` as 'yyyy-MM' text (partition column)."""
    return events.withColumn("event_month", F.date_format("event_time", "yyyy-MM"))


def clustered_events(events: DataFrame) -> DataFrame:
    """Events with ``event_month``, each task's rows ordered by (month,
    meter, time) for the partitioned, meter-clustered layout."""
    return with_event_month(events).sortWithinPartitions("event_month", "meter_number", "event_time")


def write_events(events: DataFrame, path: str, mode: str = "overwrite",
                 max_records_per_file: int = 5_000_000) -> None:
    """Store events partitioned by month, clustered by meter.

    No shuffle by month (one month can be a large share of the data and would
    land in one task).  Each task sorts its own rows by (month, meter, time):
    it keeps one open file at a time, and every file's row groups cover a
    narrow meter range, so meter lookups skip row groups by their min/max
    statistics.
    """
    (clustered_events(events)
     .write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
     .partitionBy("event_month").parquet(path))


def read_events(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """Month-partitioned events; ``event_month`` is read back as text.
    ``months``: names of the month folders to read (no other is listed)."""
    paths = [path] if months is None else [f"{path.rstrip('/')}/{m}" for m in months]
    df = spark.read.option("basePath", path).parquet(*paths)
    if "event_month" in df.columns:   # text whatever the partition-type inference says
        df = df.withColumn("event_month", F.col("event_month").cast("string"))
    keep = [n for n in [c for c, _ in EVENT_COLUMNS] + ["event_id", "event_month"] if n in df.columns]
    return df.select(*keep)


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def events_by_month(events: DataFrame) -> DataFrame:
    """Event count and distinct meters per calendar month."""
    return (events.groupBy(F.date_trunc("month", F.col("event_time")).alias("month"))
            .agg(F.count(F.lit(1)).alias("events"),
                 F.count_distinct("meter_number").alias("meters")))
