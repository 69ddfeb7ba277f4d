"""Hand-made mini-tables for rules random data cannot pin down."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridwatch.functions.params import CustomerFilter, EventFilter, parse_query_time
from gridwatch.operators import customers as C
from gridwatch.operators import dashboards as D
from gridwatch.operators import joins as J
from gridwatch.operators import spatial as K
from gridwatch.operators import summaries as S
from gridwatch.sources.sinks import merge_by_key, merge_sticky
from tests.helpers import customers, events


def test_shared_meter_fanout(spark):
    cust = customers(spark, [{"ecgkey": "1", "meternumber": "M1"}, {"ecgkey": "2", "meternumber": "M1"}])
    ev = events(spark, [{"meter_number": "M1", "event_time": f"2024-01-0{i} 10:00:00"} for i in (1, 2, 3)])
    ms = S.meter_summary(ev, cust)
    assert ms.collect()[0]["event_count"] == 6           # 3 events x 2 customers
    assert S.meter_summary(ev, cust, fanout=False).collect()[0]["event_count"] == 3
    des = S.district_event_summary(S.with_geom(S.with_coordinate_flags(cust, ms)), ms)
    r = des.collect()[0]
    assert r["total_events"] == 12 and r["total_meters"] == 1


def test_null_meter_not_in_anti_join(spark):
    cust = customers(spark, [{"ecgkey": "1", "meternumber": None}, {"ecgkey": "2", "meternumber": "M2"},
                             {"ecgkey": "3", "meternumber": "M1"}])
    ev = events(spark, [{"meter_number": "M1", "event_time": "2024-01-01 00:00:00"}])
    ms = S.meter_summary(ev, cust)
    without = {r["ecgkey"] for r in S.customers_without_events(cust, ms).collect()}
    assert without == {"2"}
    withe = {r["ecgkey"] for r in S.customers_with_events(cust, ms).collect()}
    assert withe == {"3"}


def test_partial_coords_per_coordinate_fallback(spark):
    cust = customers(spark, [{"ecgkey": "1", "meternumber": "M1", "latitude": -0.2, "longitude": None}])
    ev = events(spark, [{"meter_number": "M1", "event_time": "2024-01-01 00:00:00",
                         "latitude": -0.5, "longitude": 5.5}])
    dto = C.customer_dto(J.with_latest_event(cust, ev)).collect()[0]
    # latitude from own 'longitude' (NULL) -> event 'longitude'; longitude from own 'latitude'
    assert dto["latitude"] == 5.5 and dto["longitude"] == -0.2
    assert dto["latest_tamper_event"]["latitude"] == 5.5
    assert dto["latest_tamper_event"]["longitude"] == -0.5
    g = S.with_geom(cust).collect()[0]
    assert g["geom_x"] is None and g["geom_y"] is None


def test_latest_vs_any_event_flag(spark):
    cust = customers(spark, [{"ecgkey": "1", "meternumber": "M1"}])
    ev = events(spark, [
        {"meter_number": "M1", "event_time": "2024-01-01 00:00:00", "latitude": -0.5, "longitude": 5.5},
        {"meter_number": "M1", "event_time": "2024-01-02 00:00:00"}])
    ms = S.meter_summary(ev, cust)
    latest = S.with_coordinate_flags(cust, ms, "latest").collect()[0]
    anyv = S.with_coordinate_flags(cust, variant="any", events=ev).collect()[0]
    assert latest["has_event_coordinates"] is False
    assert anyv["has_event_coordinates"] is True and anyv["has_any_coordinates"] is True


def test_swap_and_accra_tile(spark):
    cust = customers(spark, [{"ecgkey": "1", "meternumber": "M1", "latitude": -0.0652943,
                              "longitude": 5.6877487}])
    g = S.with_geom(cust)
    t = K.with_tile(g, 7).collect()[0]
    assert (t["geom_x"], t["geom_y"]) == (-0.0652943, 5.6877487)
    assert (t["tile_x"], t["tile_y"]) == (63, 61)
    assert K.tile_features(g, 7, 63, 61).count() == 1
    assert K.tile_features(g, 7, 63, 60).count() == 0
    idx = {(r["tile_z"], r["tile_x"], r["tile_y"]) for r in K.tile_index(g, 6, 8).collect()}
    assert idx == {(6, 31, 30), (7, 63, 61), (8, 127, 123)}


def test_district_rename_is_sticky(spark):
    old = spark.createDataFrame([("01-01", "OLD NAME", "01", 5, 7)],
                                "districtcode string, districtname string, regioncode string, "
                                "total_meters long, prepaid_meters long")
    new = spark.createDataFrame([("01-01", "NEW NAME", "02", 9), ("01-02", "OTHER", "02", 1)],
                                "districtcode string, districtname string, regioncode string, total_meters long")
    out = {r["districtcode"]: r for r in merge_sticky(
        old, new, ["districtcode"], sticky=["districtname", "regioncode"], untouched=["prepaid_meters"],
        defaults={"prepaid_meters": 0}).collect()}
    assert out["01-01"]["districtname"] == "OLD NAME" and out["01-01"]["regioncode"] == "01"
    assert out["01-01"]["total_meters"] == 9 and out["01-01"]["prepaid_meters"] == 7
    assert out["01-02"]["districtname"] == "OTHER" and out["01-02"]["prepaid_meters"] == 0


def test_stale_meter_kept_by_merge(spark):
    old = spark.createDataFrame([("M1", 1), ("M2", 2)], "meternumber string, event_count long")
    new = spark.createDataFrame([("M1", 5)], "meternumber string, event_count long")
    got = {r["meternumber"]: r["event_count"] for r in merge_by_key(old, new, ["meternumber"]).collect()}
    assert got == {"M1": 5, "M2": 2}


def test_null_order_in_pages_and_dashboards(spark):
    cust = customers(spark, [{"ecgkey": "3", "fullname": None}, {"ecgkey": "2", "fullname": "B"},
                             {"ecgkey": "1", "fullname": "B"}, {"ecgkey": "4", "fullname": "A"}])
    ev = events(spark, [{"meter_number": "X", "event_time": "2024-01-01 00:00:00"}])
    page = C.customer_page(cust, ev, CustomerFilter(page=1, page_size=10))
    assert [r["ecgkey"] for r in page.collect()] == ["4", "1", "2", "3"]
    des = spark.createDataFrame([("a", "Z", None), ("b", "Y", 5), ("c", None, 5)],
                                "districtcode string, districtname string, total_events long")
    des = des.selectExpr("*", "'01' regioncode", "'R' regionname", "0L total_meters",
                         "0L meters_with_events", "0L meters_with_coordinates",
                         "0L meters_without_coordinates", "cast(null as timestamp) latest_event_time")
    assert [r["district_code"] for r in D.dashboard_districts(des).collect()] == ["a", "b", "c"]


def test_account_meters_null_last_keeps_duplicates(spark):
    cust = customers(spark, [{"ecgkey": str(i), "accountnumber": "A1", "fullname": "N", "meternumber": m}
                             for i, m in enumerate(["M2", None, "M1", "M2"])])
    cust = S.with_coordinate_flags(cust, variant="any", events=events(spark, [
        {"meter_number": "M9", "event_time": "2024-01-01 00:00:00"}]))
    ms = spark.createDataFrame([("M1", 4, datetime(2024, 1, 3))],
                               "meternumber string, event_count long, latest_event_time timestamp")
    r = D.account_meters(cust, ms, account="A1").collect()[0]
    assert r["meters"] == ["M1", "M2", "M2", None]
    assert r["meter_count"] == 4 and r["total_events"] == 4


@pytest.mark.parametrize("needle,names,expected", [
    ("a%c", ["ABC", "AXXC", "AC", "BAC"], {"ABC", "AXXC", "AC", "BAC"}),
    ("a_c", ["ABC", "AC", "A_C"], {"ABC", "A_C"}),
    ("a\\_c", ["ABC", "A_C"], {"A_C"}),
    ("a\\bc", ["ABC", "A\\BC"], {"ABC"}),
    ("  b  ", ["ABC", "XYZ"], {"ABC"}),
])
def test_like_wildcards_are_not_escaped(spark, needle, names, expected):
    cust = customers(spark, [{"ecgkey": str(i), "fullname": n} for i, n in enumerate(names)])
    got = {r["fullname"] for r in C.filter_customers(cust, CustomerFilter(search=needle)).collect()}
    assert got == expected


def test_search_upper_cases_needle_only(spark):
    cust = customers(spark, [{"ecgkey": "1", "fullname": "x", "accountnumber": "acc1"}])
    assert C.filter_customers(cust, CustomerFilter(search="acc")).count() == 0
    assert C.filter_customers(cust, CustomerFilter(search="X")).count() == 1


def test_to_date_means_midnight(spark):
    ev = events(spark, [{"meter_number": "M1", "event_time": "2024-01-20 00:00:00"},
                        {"meter_number": "M1", "event_time": "2024-01-20 10:00:00"}])
    f = EventFilter(to=parse_query_time("2024-01-20"))
    got = C.filter_events(ev, f, "M1").collect()
    assert [r["event_time"] for r in got] == [datetime(2024, 1, 20)]


def test_query_time_parsing():
    assert parse_query_time("2024-01-10T12:00:00+02:00") == datetime(2024, 1, 10, 10)
    assert parse_query_time("2024-01-10T12:00:00.5Z") == datetime(2024, 1, 10, 12, 0, 0, 500000)
    assert parse_query_time("2024-01-10T12:00:00") == datetime(2024, 1, 10, 12)
    assert parse_query_time("2024-01-10") == datetime(2024, 1, 10)
    with pytest.raises(ValueError):
        parse_query_time("10/01/2024")


def test_coordinate_filter_schema_guard(spark):
    cust = customers(spark, [{"ecgkey": "1"}])
    with pytest.raises(ValueError):
        C.filter_customers(cust, CustomerFilter(has_coordinates=True))


def test_contradictory_coordinate_filters_are_empty(spark):
    cust = S.with_coordinate_flags(customers(spark, [{"ecgkey": "1"}]), variant="any",
                                   events=events(spark, [{"meter_number": "X", "event_time": "2024-01-01 00:00:00"}]))
    assert C.filter_customers(cust, CustomerFilter(has_coordinates=True, no_coordinates=True)).count() == 0


def test_empty_summary_gives_one_row(spark):
    cust = customers(spark, [])
    ev = events(spark, [])
    ms = S.meter_summary(ev, cust)
    des = S.district_event_summary(S.with_geom(S.with_coordinate_flags(cust, ms)), ms)
    rows = D.dashboard_summary(des).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["total_meters"] is None and r["total_districts"] == 0 and r["coordinate_coverage_pct"] is None


def test_coverage_pct_rounds_half_up(spark):
    des = spark.createDataFrame([("d", "01", 1, 8, 0)],
                                "districtcode string, regioncode string, meters_with_coordinates long, "
                                "total_meters long, total_events long")
    for c in ("meters_without_coordinates", "meters_with_events", "prepaid_meters", "postpaid_meters",
              "active_contracts"):
        des = des.withColumn(c, F.lit(0).cast("long"))
    des = des.withColumn("latest_event_time", F.lit(None).cast("timestamp"))
    assert D.dashboard_summary(des).collect()[0]["coordinate_coverage_pct"] == 12.5
    des2 = des.withColumn("total_meters", F.lit(3).cast("long"))
    assert D.dashboard_summary(des2).collect()[0]["coordinate_coverage_pct"] == 33.33


def test_lookup_first_by_ecgkey_and_unknown_account(spark):
    cust = customers(spark, [{"ecgkey": "2", "accountnumber": "A", "meternumber": "M2"},
                             {"ecgkey": "1", "accountnumber": "A", "meternumber": "M1"}])
    ev = events(spark, [{"meter_number": "M1", "event_time": "2024-01-01 00:00:00"},
                        {"meter_number": "M2", "event_time": "2024-01-02 00:00:00"}])
    assert C.customer_by_account(cust, ev, "A").collect()[0]["ecgkey"] == "1"
    got = C.events_by_account(cust, ev, "A", EventFilter()).collect()
    assert [r["meter_number"] for r in got] == ["M1"]
    assert C.events_by_account(cust, ev, "nope", EventFilter()).count() == 0


def test_null_key_salting_keeps_left_join_exact(spark):
    left = spark.createDataFrame([(str(i), None if i % 2 else f"M{i % 4}") for i in range(200)],
                                 "ecgkey string, meternumber string")
    right = spark.createDataFrame([("M0", 1), ("M2", 2)], "k string, v int")
    out = J.left_join_nullable(left, right, "meternumber", "k", ["ecgkey"])
    assert out.count() == 200
    assert out.filter(F.col("meternumber").isNull() & F.col("v").isNotNull()).count() == 0
    assert out.filter(F.col("v").isNotNull()).count() == 100


def test_latest_methods_agree(spark):
    ev = events(spark, [{"meter_number": f"M{i % 3}", "event_time": datetime(2024, 1, 1) + timedelta(hours=i % 5)}
                        for i in range(30)])
    a = J.latest_event_per_meter(ev, "max_by").orderBy("meter_number").collect()
    b = J.latest_event_per_meter(ev, "row_number").select(*J.latest_event_per_meter(ev).columns) \
        .orderBy("meter_number").collect()
    assert a == b


def test_page_size_is_clamped_and_reported(spark):
    from gridwatch.functions.params import normalise_customer_filter, normalise_event_filter
    f = normalise_customer_filter(CustomerFilter(page=0, page_size=1000, search="  x "))
    assert (f.page, f.page_size, f.search) == (1, 200, "x")
    e = normalise_event_filter(EventFilter(page=-3, page_size=0, event_code=" 3.1 "))
    assert (e.page, e.page_size, e.event_code) == (1, 50, "3.1")
    assert normalise_event_filter(EventFilter(page_size=9999)).page_size == 500
    total = spark.createDataFrame([(401,)], "total long")
    m = C.page_meta(total, 0, 1000).collect()[0]
    assert (m["page"], m["page_size"], m["total_pages"]) == (1, 200, 3)


def test_batch_step_orientation_switch(spark):
    cust = customers(spark, [{"ecgkey": "1", "latitude": -0.06, "longitude": 5.69}])
    a = S.with_geom(cust).collect()[0]
    b = S.with_geom(cust, swap=False).collect()[0]
    assert (a["geom_x"], a["geom_y"]) == (-0.06, 5.69)
    assert (b["geom_x"], b["geom_y"]) == (5.69, -0.06)
    ms = spark.createDataFrame([("M1", 0.5, 6.5, 1)], "meternumber string, latest_event_lat double, "
                               "latest_event_lng double, event_count long")
    c2 = customers(spark, [{"ecgkey": "2", "meternumber": "M1"}])
    ms = ms.selectExpr("*", "cast(null as timestamp) latest_event_time", "'c' latest_event_code",
                       "'d' latest_event_desc", "true has_event_coordinates")
    v = K.customer_map_view(c2, ms).collect()[0]
    assert (v["geom_x"], v["geom_y"]) == (6.5, 0.5)          # fallback: x = event lng column
    w = K.customer_map_view(c2, ms, swap=True).collect()[0]
    assert (w["geom_x"], w["geom_y"]) == (0.5, 6.5)


def test_account_group_is_one_row_whatever_its_size(spark):
    n = 100_500
    rows = (spark.range(n).selectExpr("cast(id as string) ecgkey", "'A1' accountnumber", "'N' fullname",
                                      "if(id % 3 = 0, null, concat('M', id % 40000)) meternumber")
            .unionByName(spark.range(2).selectExpr("concat('s', id) ecgkey", "'A2' accountnumber", "'S' fullname", "'X1' meternumber")))
    for c in ("phonenumber", "regionname", "districtname"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    rows = rows.withColumn("has_any_coordinates", F.col("ecgkey") == "7").withColumn("geom_x", F.lit(0.0))
    ms = spark.createDataFrame([("M1", 4, datetime(2024, 1, 3))],
                               "meternumber string, event_count long, latest_event_time timestamp")
    for partitions in ("3", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            out = {r["accountnumber"]: r for r in D.account_meters(rows, ms).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        users = sum(1 for i in range(n) if i % 3 and i % 40000 == 1)
        assert len(out) == 2 and (out["A1"]["meter_count"], out["A1"]["total_events"]) == (n, 4 * users)
        assert out["A1"]["any_meter_has_coordinates"] and out["A2"]["meter_count"] == 2
    listed = D.account_meter_list(rows).groupBy("accountnumber").agg(F.sum("occurrences").alias("n")).collect()
    assert {r["accountnumber"]: r["n"] for r in listed} == {"A1": n, "A2": 2}
