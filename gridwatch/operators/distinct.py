"""Exact distinct counts that can be merged.

Counts of distinct meters per district don't add up: a meter with customers in
two districts counts twice in their region.  Bitmaps of meter numbers merge by
OR, so one aggregation per district serves districts, regions, the nation, and
any union of months.  Meters get dense ordinals first; a bitmap is a row of
4 KB per 32,768 ordinals that occur.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwatch.session import checkpoint_dir

ORDINAL, BUCKET, BITS = "ordinal", "bucket", "bits"


def ordinals(keys: DataFrame, key: str) -> DataFrame:
    """``(key, ordinal)``: the distinct non-null keys, numbered from 1 in key order.

    Range partitions are numbered on their own and moved by the sizes of those
    before them (one number per partition)."""
    checkpoint_dir(keys.sparkSession)
    ranged = (keys.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key)
              .withColumn("_pid", F.spark_partition_id()).checkpoint())
    sizes = ranged.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row per partition: small whatever the keys are
    starts = sizes.select("_pid", before.alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_pid").orderBy(key))
    return ranged.withColumn("_nth", nth).join(F.broadcast(starts), "_pid").select(key, (F.col("_start") + F.col("_nth")).alias(ORDINAL))


def distinct_bitmaps(rows: DataFrame, by: Sequence[str], ordinal: Column | str = ORDINAL) -> DataFrame:
    """``(by, bucket, bits)``: the ordinals of every group as bitmaps; built by
    partial aggregation, so a group of many rows is a few rows per task."""
    o = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return (rows.groupBy(*by, F.bitmap_bucket_number(o).alias(BUCKET))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(o)).alias(BITS)))


def merge_bitmaps(bitmaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same relation for coarser groups."""
    return bitmaps.groupBy(*by, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))


def count_distinct(bitmaps: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    return merge_bitmaps(bitmaps, by).groupBy(*by).agg(F.sum(F.bitmap_count(BITS)).alias(name))


def distinct_meters(customers: DataFrame) -> DataFrame:
    """Per district, per region and for all: ``meters``, the distinct meters,
    and ``summed_meters``, the sum of the districts' counts as the dashboards
    show it.  Customers without a district count nowhere, without a meter not;
    a district without a region counts for the nation only."""
    rows = customers.where(F.col("districtcode").isNotNull()).select("regioncode", "districtcode", "meternumber")
    numbered = rows.join(ordinals(rows, "meternumber"), "meternumber")
    bitmaps = distinct_bitmaps(numbered, ["regioncode", "districtcode"])
    # one row per level that a district's bitmaps count for
    levels = F.array(*[F.struct(F.lit(level).alias("level"), code.alias("code")) for level, code in (
        ("district", F.col("districtcode")), ("region", F.col("regioncode")), ("nation", F.lit("")))])
    at = bitmaps.select(F.inline(levels), "districtcode", BUCKET, BITS).where("code is not null")
    exact = count_distinct(at, ["level", "code"], "meters")
    summed = (count_distinct(at, ["level", "code", "districtcode"], "n").groupBy("level", "code").agg(F.sum("n").alias("summed_meters")))
    return exact.join(summed, ["level", "code"])
