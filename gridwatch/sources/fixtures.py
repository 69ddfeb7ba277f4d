"""Customer and tamper-event relations projected from the driver's tables.

The driver ships TPC-H-style ``customer``/``nation``/``region`` tables and an
``events`` stream.  These projections map them onto the meter domain with
fixed, documented rules (see FIXTURES.md).  Everything is a narrow projection
of the scanned files plus two joins to fixed-size dimension tables, so the
work grows linearly with the input and never shuffles the big side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lpad_str(c: Column, width: int) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def customers_from_tpch(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Project TPC-H customers onto customer records (meter domain)."""
    k = F.col("c_custkey")
    nk = F.col("c_nationkey")
    group = nk * 1000000 + k - k % 100          # account / name group
    # nation (25 rows) and region (5 rows) have a fixed size at every scale
    # factor, so broadcasting them is bounded.
    geo = F.broadcast(
        nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "n_name", "r_regionkey", "r_name"))
    c = customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    region_code = _lpad_str(F.col("r_regionkey"), 2)
    return c.select(
        _lpad_str(k, 9).alias("ecgkey"),
        F.when(k % 29 == 28, F.lit(None).cast("string"))
         .when(k % 10 == 9, (k - 1).cast("string"))
         .otherwise(k.cast("string")).alias("meternumber"),
        (F.lit(700000000) + group).cast("string").alias("accountnumber"),
        F.when(k % 53 == 52, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Customer#"), _lpad_str(group, 9))).alias("fullname"),
        F.concat(F.lit("02"), _lpad_str(group % 100000000, 8)).alias("phonenumber"),
        region_code.alias("regioncode"),
        F.col("r_name").alias("regionname"),
        F.when(k % 97 == 96, F.lit(None).cast("string"))
         .otherwise(F.concat(region_code, F.lit("-"), _lpad_str(nk, 2))).alias("districtcode"),
        F.col("n_name").alias("districtname"),
        F.when(k % 3 == 0, "Postpaid").otherwise("Prepaid").alias("servicetype"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Residential")
         .otherwise("NonResidential").alias("serviceclass"),
        F.concat(F.lit("SPN-"), _lpad_str(k, 7)).alias("servicepointnumber"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Commercial")
         .when(F.col("c_mktsegment") == "MACHINERY", "Industrial")
         .otherwise("Domestic").alias("customertype"),
        F.when(F.col("c_acctbal") < 0, "Inactive").otherwise("Active").alias("contractstatus"),
        F.when(k % 5 == 0, "Terminated").otherwise("Live").alias("cmscontractstatus"),
        F.when(k % 3 == 0, "MMS-WASION").when(k % 3 == 1, "Gamma")
         .otherwise("Landis").alias("metermake"),
        F.when(k % 5 == 0, "ZMD410").when(k % 5 == 1, "E650").when(k % 5 == 2, "dds26d")
         .when(k % 5 == 3, "DTSY-100").otherwise(F.lit(None).cast("string")).alias("metermodel"),
        F.when(k % 2 == 0, "Smart").otherwise("Conventional").alias("metertype"),
        F.when(k % 11 == 0, "Government").otherwise("Private").alias("accounttype"),
        F.col("c_mktsegment").alias("tariffclassname"),
        F.concat(F.lit("House "), (k % 200 + 1).cast("string"), F.lit(", "),
                 F.col("n_name")).alias("address"),
        F.when(k % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Street "), (k % 50).cast("string"))).alias("streetname"),
        (k % 200 + 1).cast("string").alias("housenumber"),
        F.when(k % 4 == 0, F.lit(None).cast("double"))
         .otherwise((k * 37 % 420).cast("double") / 100 - 3).alias("latitude"),
        F.when((k % 4).isin(0, 1) & (k % 8 != 1), F.lit(None).cast("double"))
         .otherwise((k * 53 % 600).cast("double") / 100 + 5).alias("longitude"),
        ((k % 1000).cast("double") / 10).alias("lastbillamount"),
        F.col("c_acctbal").alias("currentbalance"),
        F.when(k % 6 == 0, F.lit(None).cast("double"))
         .otherwise((k % 700).cast("double") / 10).alias("lastpaymentamount"),
        F.date_add(F.lit("2023-01-01").cast("date"), (k % 365).cast("int")).alias("lastpaymentdate"),
    )


def events_from_stream(events: DataFrame) -> DataFrame:
    """Project the driver's event stream onto tamper events."""
    kk = F.regexp_extract("props", "[0-9]+", 0).try_cast("int")
    et = F.col("event_type")
    return (events
            .select("event_id", "ts", "user_id", "event_type", kk.alias("_k"))
            .select(
                F.substring(F.col("ts").cast("string"), 1, 19).alias("period"),
                F.col("user_id").cast("string").alias("meter_number"),
                F.concat(F.lit("Customer#"), _lpad_str(F.col("user_id"), 9)).alias("customer_name"),
                F.when(et == "error", "3.26.38.98").when(et == "click", "3.26.38.99")
                 .otherwise("3.12.0.1").alias("event_code"),
                F.concat(F.lit("STDEVT:"), et).alias("event_desc"),
                F.col("ts").alias("event_time"),
                F.when(F.col("_k") < 30, F.lit(None).cast("double"))
                 .otherwise(F.col("_k").cast("double") / 100 - 1).alias("latitude"),
                F.when(F.col("_k") < 20, F.lit(None).cast("double"))
                 .otherwise(F.col("_k").cast("double") / 50 + 5).alias("longitude"),
                F.lit(None).cast("bigint").alias("counting"),
                F.col("event_id"),
            ))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers_from_tpch(_read(spark, sf_dir, "customer"), _read(spark, sf_dir, "nation"),
                               _read(spark, sf_dir, "region"))


def tamper_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_from_stream(_read(spark, sf_dir, "events"))
