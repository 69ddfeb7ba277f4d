"""Results the fixture documentation records for sf0.01 (FIXTURES.md §3)."""

import pytest
from pyspark.sql import functions as F

from gridwatch.operators import dashboards as D
from gridwatch.operators import spatial as K
from gridwatch.operators import summaries as S
from gridwatch.sources import fixtures as X

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rel(spark):
    cust, ev = X.customers(spark, SF), X.tamper_events(spark, SF)
    ms = S.meter_summary(ev, cust)
    flagged = S.with_geom(S.with_coordinate_flags(cust, ms, "latest"))
    return cust, ev, ms, flagged


def test_fixture_shapes(rel):
    cust, ev, _, _ = rel
    assert cust.count() == 1500 and ev.count() == 10000
    assert cust.filter(F.col("meternumber").isNull()).count() == 51
    assert cust.select("meternumber").distinct().filter(F.col("meternumber").isNotNull()).count() == 1310
    assert cust.filter(F.col("fullname").isNull()).count() == 28
    assert cust.filter(F.col("districtcode").isNull()).count() == 15
    assert cust.select("accountnumber").distinct().count() == 364


def test_meter_summary_numbers(rel):
    _, _, ms, _ = rel
    r = ms.agg(F.count(F.lit(1)).alias("n"), F.count("accountnumber").alias("acct"),
               F.count_if("has_event_coordinates").alias("coords"),
               F.sum("event_count").alias("events")).collect()[0]
    assert (r["n"], r["acct"], r["coords"], r["events"]) == (150, 131, 112, 10932)
    _, ev, _, _ = rel
    assert S.meter_event_counts(ev).agg(F.sum("event_count")).collect()[0][0] == 10000
    assert S.event_coordinate_meters(ev).count() == 150


def test_flag_numbers(rel):
    _, _, _, flagged = rel
    r = flagged.agg(F.count_if("has_own_coordinates").alias("own"),
                    F.count_if("has_event_coordinates").alias("ev"),
                    F.count_if("has_any_coordinates").alias("any")).collect()[0]
    assert (r["own"], r["ev"], r["any"]) == (938, 109, 984)


def test_district_numbers(rel):
    _, _, ms, flagged = rel
    des = S.district_event_summary(flagged, ms)
    r = des.agg(F.count(F.lit(1)).alias("n"), F.sum("total_meters").alias("t"),
                F.sum("meters_with_events").alias("e"), F.sum("meters_with_coordinates").alias("w"),
                F.sum("meters_without_coordinates").alias("wo"), F.sum("total_events").alias("ev")).collect()[0]
    assert (r["n"], r["t"], r["e"], r["w"], r["wo"], r["ev"]) == (25, 1430, 144, 941, 489, 11448)


def test_view_numbers(rel):
    cust, _, ms, flagged = rel
    assert K.customer_map_view(flagged, ms).count() == 984
    assert D.account_meters(flagged, ms).count() == 392
    assert S.customers_without_events(cust, ms).count() == 1304
