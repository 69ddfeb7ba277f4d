"""Dashboard read operators over the district summary (a small relation:
one row per district), plus the account roll-up over customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwatch.operators import summaries as S


def coverage_pct(with_col: str, total_col: str) -> Column:
    """``ROUND(with * 100.0 / NULLIF(total, 0), 2)`` for non-negative counts,
    exact: half-up rounding in integer arithmetic, then shown as a double."""
    hundredths = F.expr(f"(20000 * {with_col} + {total_col}) div (2 * {total_col})")
    return F.when(F.col(total_col) > 0, hundredths.cast("double") / 100)


_SUMMED = ["total_meters", "meters_with_coordinates", "meters_without_coordinates",
           "meters_with_events", "total_events", "prepaid_meters", "postpaid_meters",
           "active_contracts"]


def dashboard_summary(des: DataFrame) -> DataFrame:
    """National totals: one row, also on an empty summary (NULL sums, 0 counts)."""
    aggs = [F.sum(c).cast("long").alias(c) for c in _SUMMED] + [
        F.count_distinct("districtcode").alias("total_districts"),
        F.count_distinct("regioncode").alias("total_regions"),
        F.max("latest_event_time").alias("latest_event_time"),
    ]
    if "updated_at" in des.columns:
        aggs.append(F.max("updated_at").alias("last_refreshed"))
    out = des.agg(*aggs)
    return out.select(
        "total_meters", "meters_with_coordinates", "meters_without_coordinates",
        coverage_pct("meters_with_coordinates", "total_meters").alias("coordinate_coverage_pct"),
        *[c for c in out.columns if c not in ("total_meters", "meters_with_coordinates",
                                               "meters_without_coordinates")])


# District columns shown on the dashboard, API names.
DISTRICT_FIELDS = [("districtcode", "district_code"), ("districtname", "district_name"),
                   ("regioncode", "region_code"), ("regionname", "region_name"),
                   ("total_meters", "total_meters"), ("meters_with_events", "meters_with_events"),
                   ("meters_with_coordinates", "meters_with_coordinates"),
                   ("meters_without_coordinates", "meters_without_coordinates"),
                   ("total_events", "total_events"), ("latest_event_time", "latest_event_time")]


def dashboard_districts(des: DataFrame, region_code: str = "") -> DataFrame:
    """Districts, optionally of one region, most events first then by name."""
    out = des.filter(F.col("regioncode") == F.lit(region_code)) if region_code else des
    return (out.orderBy(F.col("total_events").desc_nulls_first(),
                        F.col("districtname").asc_nulls_last(), F.col("districtcode"))
            .select(*[F.col(s).alias(d) for s, d in DISTRICT_FIELDS]))


def dashboard_regions(des: DataFrame) -> DataFrame:
    """Region roll-up of the district summary, most events first.

    Counts are added up from districts (a meter in two districts counts
    twice), as in the source; not a ROLLUP over raw customers.
    """
    return (des.groupBy("regioncode", "regionname").agg(
        F.count_distinct("districtcode").alias("total_districts"),
        F.sum("total_meters").cast("long").alias("total_meters"),
        F.sum("meters_with_events").cast("long").alias("meters_with_events"),
        F.sum("meters_with_coordinates").cast("long").alias("meters_with_coordinates"),
        F.sum("meters_without_coordinates").cast("long").alias("meters_without_coordinates"),
        F.sum("total_events").cast("long").alias("total_events"),
        F.max("latest_event_time").alias("latest_event_time"))
        .orderBy(F.col("total_events").desc_nulls_first(), F.col("regioncode"))
        .select(F.col("regioncode").alias("region_code"), F.col("regionname").alias("region_name"),
                "total_districts", "total_meters", "meters_with_events", "meters_with_coordinates",
                "meters_without_coordinates", "total_events", "latest_event_time"))


ACCOUNT_KEYS = ["accountnumber", "fullname", "phonenumber", "regionname", "districtname"]


def account_meters(customers: DataFrame, meter_summary_df: DataFrame, account: str | None = None) -> DataFrame:
    """Meters of an account in totals: one row per group (account, name,
    phone, region, district; NULL keys form their own groups), whatever its
    size.  ``account_meter_list`` is the list in long form.

    With ``account``, only that account's groups, and ``meters`` lists the
    meter numbers ascending with NULLs last, duplicates kept (its length is
    ``meter_count``): a single account's list is what the caller asked for,
    so it is built in one row.

    Rows are first reduced to one per (group, meter) with a multiplicity, so a
    meter repeated many times travels as one row; totals are partial
    aggregates over those.
    """
    if account is not None:
        customers = customers.filter(F.col("accountnumber") == F.lit(account))
    j = S.join_meter_summary(customers, meter_summary_df,
                             S.summary_columns(customers, ["event_count", "latest_event_time"]))
    j = S.ensure_flags_and_geom(j).withColumnsRenamed(
        {"ms_event_count": "_ms_events", "ms_latest_event_time": "_ms_latest"})
    per_meter = j.groupBy(*ACCOUNT_KEYS, "meternumber").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.coalesce(F.col("_ms_events"), F.lit(0))).alias("_events"),
        F.max("_ms_latest").alias("_latest"),
        F.max(F.coalesce(F.col("has_any_coordinates"), F.lit(False))).alias("_any"))
    aggs = [F.sum("_n").alias("meter_count"), F.sum("_events").cast("long").alias("total_events"),
            F.max("_latest").alias("latest_event_time"), F.max("_any").alias("any_meter_has_coordinates")]
    extra = []
    if account is not None:
        entry = F.struct(F.col("meternumber").isNull().alias("n"), F.col("meternumber").alias("m"), F.col("_n").alias("k"))
        aggs.append(F.array_sort(F.collect_list(entry)).alias("_list"))
        extra.append(F.flatten(F.transform("_list", lambda e: F.array_repeat(e["m"], e["k"].cast("int")))).alias("meters"))
    return per_meter.groupBy(*ACCOUNT_KEYS).agg(*aggs).select(
        F.col("accountnumber"), F.col("fullname").alias("customer_name"), F.col("phonenumber").alias("phone"),
        "regionname", "districtname", "meter_count", *extra, "total_events", "latest_event_time",
        "any_meter_has_coordinates")


def account_meter_list(customers: DataFrame) -> DataFrame:
    """Long form of ``account_meters.meters``: one row per (group, meter)
    with its multiplicity, never materialising a whole group in one row.
    Sort by the group keys and ``meternumber`` (NULLs last) to read a list."""
    return (customers.groupBy(*ACCOUNT_KEYS, "meternumber")
            .agg(F.count(F.lit(1)).alias("occurrences"))
            .select(F.col("accountnumber"), F.col("fullname").alias("customer_name"),
                    F.col("phonenumber").alias("phone"), "regionname", "districtname",
                    "meternumber", "occurrences"))
