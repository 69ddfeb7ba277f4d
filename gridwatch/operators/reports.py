"""Operational reports: load summary, table statistics, pipeline status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwatch.functions.text import count_text, size_text

# Refresh steps in run order.
STEPS = ["meter_summary", "coordinate_flags", "geom", "district_summary"]


def load_counts(customers: DataFrame, events: DataFrame, meter_summary_df: DataFrame) -> DataFrame:
    """The five load counts as one row of numbers.

    The three inputs are tagged and unioned, then counted in one global
    aggregate (partial counts per task, one row at the end).
    """
    t, f = F.col("_t"), F.col("_f")
    u = (customers.select(F.lit(0).alias("_t"), F.col("has_any_coordinates").alias("_f"))
         .unionByName(events.select(F.lit(1).alias("_t"), F.lit(None).cast("boolean").alias("_f")))
         .unionByName(meter_summary_df.select(F.lit(2).alias("_t"),
                                              F.lit(None).cast("boolean").alias("_f"))))
    return u.agg(F.count_if(t == 0).alias("total_customers"),
                 F.count_if(t == 1).alias("total_events"),
                 F.count_if(t == 2).alias("meters_with_events"),
                 F.count_if((t == 0) & f).alias("plottable_meters"),
                 F.count_if((t == 0) & ~f).alias("unplottable_meters"))


def load_summary(customers: DataFrame, events: DataFrame, meter_summary_df: DataFrame) -> DataFrame:
    """The load report: counts printed as ``999,999,999``."""
    n = load_counts(customers, events, meter_summary_df)
    return n.select(*[count_text(c).alias(c) for c in n.columns])


def table_stats(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Rows and on-disk bytes per table, largest first.

    Bytes come from the scan's file metadata (``_metadata.file_size``), one
    value per file, summed in Spark; rows from a count.  Index sizes do not
    exist here.
    """
    parts = []
    for name, path in tables.items():
        df = spark.read.parquet(path)
        per_file = (df.select(F.col("_metadata.file_path").alias("f"),
                              F.col("_metadata.file_size").alias("s"))
                    .groupBy("f").agg(F.count(F.lit(1)).alias("rows"), F.max("s").alias("bytes")))
        parts.append(per_file.agg(F.sum("rows").cast("long").alias("row_count"),
                                  F.sum("bytes").cast("long").alias("total_bytes"))
                     .select(F.lit(name).alias("table_name"), "row_count", "total_bytes"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return (out.withColumns({"row_count_text": count_text("row_count"),
                             "total_size": size_text("total_bytes")})
            .orderBy(F.col("total_bytes").desc_nulls_last(), "table_name"))


def pipeline_status(checkpoints: DataFrame, final: bool = False) -> DataFrame:
    """Checkpoint rows in step order with a done/pending mark."""
    rank = F.when(F.col("step") == STEPS[0], 1)
    for i, s in enumerate(STEPS[1:], start=2):
        rank = rank.when(F.col("step") == s, i)
    pending = "✗ pending" if final else "○ pending"
    return (checkpoints.withColumn("_rank", rank)
            .orderBy(F.col("_rank").asc_nulls_last(), "step")
            .select("step", F.when(F.col("completed"), F.lit("✓ done"))
                    .otherwise(F.lit(pending)).alias("status"), "finished_at"))
