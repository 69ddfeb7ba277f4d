"""Plan properties the scale design relies on, checked on the physical plans."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from gridwatch.functions.params import CustomerFilter, EventFilter, parse_query_time  # noqa: E402
from gridwatch.operators import customers as C  # noqa: E402
from gridwatch.operators import dashboards as D  # noqa: E402
from gridwatch.operators import joins as J  # noqa: E402
from gridwatch.operators import spatial as K  # noqa: E402
from gridwatch.operators import summaries as S  # noqa: E402
from gridwatch.sources import fixtures as X  # noqa: E402

SF = "/root/testdata/sf0.01"
STREAMING = {"stream_meter_summary", "stream_event_flags", "stream_customer_flags",
             "stream_attempt_lockouts", "refresh_pipeline", "refresh_rerun", "pipeline_status", "events_month_pruned",
             "stream_event_changes", "refresh_by_month", "refresh_resumed"}
# The training-data queries have tests of their own.
OTHERS = {n for n in E.queries() if n not in E.QUERIES}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(E.queries()) - STREAMING - OTHERS))
def test_no_cartesian_or_row_udf(spark, name):
    plan = plan_of(E.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, f"{name}: {bad}"


def test_null_key_salt_is_a_shuffle_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cust, ev = X.customers(spark, SF), X.tamper_events(spark, SF)
        right = J.latest_event_per_meter(ev).select(F.col("meter_number").alias("_k"), "event_time")
        plan = plan_of(J.left_join_nullable(cust, right, "meternumber", "_k", ["ecgkey"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(__gw_salt" in plan


def test_building_a_plan_runs_no_job(spark):
    import inspect
    assert "checkpoint" not in inspect.getsource(J)
    cust, ev = X.customers(spark, SF), X.tamper_events(spark, SF)
    group = "plan-time-jobs"
    spark.sparkContext.setJobGroup(group, "")
    try:
        ms = S.meter_summary(ev, cust)
        D.account_meters(cust, ms)
        D.dashboard_summary(S.district_event_summary(cust, ms))
        J.with_latest_event(cust, ev)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_existence_joins_read_keys_only(spark):
    plan = plan_of(E.queries()["customers_with_events"](spark, SF))
    assert "Window" not in plan and "SortAggregate" not in plan


def test_latest_event_is_limited_before_the_shuffle(spark):
    plan = plan_of(J.latest_event_per_meter(X.tamper_events(spark, SF)))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_event_filters_reach_the_scan(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet").select(
        F.col("user_id").cast("string").alias("meter_number"), F.col("ts").alias("event_time"),
        F.lit("x").alias("event_desc"), F.lit("c").alias("event_code"), "event_id")
    ev.write.parquet(str(tmp_path / "ev"))
    stored = spark.read.parquet(str(tmp_path / "ev"))
    f = EventFilter(event_code="c", from_=parse_query_time("2024-01-05"), to=parse_query_time("2024-01-09"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = plan_of(C.filter_events(stored, f, "42"))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):]
    for frag in ("EqualTo(meter_number,42)", "GreaterThanOrEqual(event_time", "LessThanOrEqual(event_time",
                 "EqualTo(event_code,c)"):
        assert frag in pushed, frag


def test_page_reads_only_needed_columns(spark):
    cust, ev = X.customers(spark, SF), X.tamper_events(spark, SF)
    plan = plan_of(C.event_page(ev, "42", EventFilter()))
    assert "value" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_spatial_layer_bbox_reaches_the_scan(spark, tmp_path):
    from gridwatch.operators import spatial as K
    from gridwatch.operators import summaries as S
    cust, ev = X.customers(spark, SF), X.tamper_events(spark, SF)
    layer = K.map_layer(K.customer_map_view(cust, S.meter_summary(ev, cust)))
    path = str(tmp_path / "layer")
    K.write_spatial_layer(layer, path)
    stored = spark.read.parquet(path)
    got = K.tile_features(stored, 7, 63, 61)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = plan_of(got)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):].split("]")[0]
    assert "GreaterThanOrEqual(geom_x" in pushed and "LessThanOrEqual(geom_y" in pushed
    assert got.count() == K.tile_features(layer, 7, 63, 61).count() > 0


def test_page_lookup_pushes_meter_list_into_event_scan(spark, tmp_path):
    from gridwatch.functions.params import CustomerFilter
    from gridwatch.sources.readers import read_events, write_events
    cust, ev = X.customers(spark, SF), X.tamper_events(spark, SF)
    path = str(tmp_path / "events")
    write_events(ev, path)
    stored = read_events(spark, path)
    page = C.customer_page(cust, stored, CustomerFilter(page=1, page_size=20))
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        plan = plan_of(page)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = [ln for ln in plan.split("\n") if "FileScan parquet" in ln and "event_time" in ln][0]
    assert "In(meter_number" in scan or "EqualTo(meter_number" in scan
    assert page.count() == 20


def test_spatial_layer_splits_a_crowded_tile(spark, tmp_path):
    from gridwatch.operators import spatial as K
    pts = spark.range(4000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("ecgkey"),
                                   (F.lit(-0.2) + F.col("id") / 1e7).alias("geom_x"),
                                   (F.lit(5.6) + F.col("id") / 1e7).alias("geom_y"))
    path = str(tmp_path / "crowded")
    K.write_spatial_layer(pts, path, partitions=4)
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(files) >= 3                       # one tile, several tasks
    back = spark.read.parquet(path)
    assert back.select("cluster_x", "cluster_y").distinct().count() == 1 and back.count() == 4000


def test_meter_summary_scans_the_events_once(spark):
    plan = plan_of(S.meter_summary(X.tamper_events(spark, SF), X.customers(spark, SF)))
    assert plan.count("events.parquet") == 1


def test_box_reaches_the_scan_of_a_stored_layer(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        for name in ("bbox_customers", "tile_features"):
            pushed = [x for x in plan_of(E.queries()[name](spark, SF)).splitlines() if "PushedFilters" in x]
            assert any("GreaterThanOrEqual(geom_x" in x and "LessThanOrEqual(geom_y" in x for x in pushed)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_deep_pages_hold_no_offset_in_a_task(spark):
    rows = spark.range(60_000).selectExpr("cast(id % 700 as string) fullname", "lpad(cast(id as string), 9, '0') ecgkey")
    f = CustomerFilter(page=270, page_size=200)
    page = C.page_rows(rows, f)
    assert "offset=53800" not in plan_of(page)
    want = rows.orderBy(*C.customer_order()).offset(53_800).limit(200).collect()
    assert page.collect() == want
    after = C.customers_after(rows, CustomerFilter(page_size=200), want[9]["fullname"], want[9]["ecgkey"]).collect()
    assert after[:190] == want[10:]
    assert C.page_rows(rows, CustomerFilter(page=1_000_000, page_size=200)).count() == 0


def test_tile_sources_are_checked(spark):
    layer = spark.createDataFrame([(0.5, 6.0)], "geom_x double, geom_y double")
    layers = {"customer_map_view": layer, "other": layer}
    for bad in (("other", 7), ("CustomerRecords", 7), ("customer_map_view", 4), ("customer_map_view", 21)):
        with pytest.raises(ValueError):
            K.tile_of_source(bad[0], layers, bad[1], 64, 61)
    assert K.tile_of_source("customer_map_view", layers, 7, 64, 61).count() == 1
