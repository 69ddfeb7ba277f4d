"""A refresh that reads changed months only equals one that reads everything."""

import os
from datetime import datetime

from pyspark.sql import functions as F

from gridwatch.operators import summaries as S
from gridwatch.plans.month_partials import MonthPartials
from gridwatch.plans.refresh import Refresh
from gridwatch.sources.readers import read_events, write_events
from tests.helpers import customers, events

NOW = datetime(2024, 5, 1)


def _events(spark, months, meters=5, each=3):
    return events(spark, [{"meter_number": f"M{(k + m) % meters}", "event_time": datetime(2024, m, 1 + k % 27, k % 24),
                           "latitude": float(k) if k % 2 else None, "longitude": 1.0} for m in months for k in range(each * meters)])


def _rows(df):
    return sorted(df.drop("updated_at").collect())


def test_only_changed_months_are_read(spark, scratch):
    path, root = os.path.join(scratch, "events"), os.path.join(scratch, "out")
    cust = customers(spark, [{"ecgkey": str(k), "meternumber": f"M{k % 4}", "districtcode": "d", "latitude": 1.0, "longitude": 2.0} for k in range(6)])

    def run(name):
        r = Refresh(spark, root, run_id=name)
        r.run(cust, path, as_of=NOW)
        whole = S.meter_summary(read_events(spark, path), cust)
        assert _rows(r.table("meter_summary")) == _rows(whole)
        des = S.district_event_summary(cust, whole)
        assert _rows(r.table("district_event_summary").drop("geom_x", "geom_y")) == _rows(des.drop("geom_x", "geom_y"))
        return [m.removeprefix("event_month=") for m in r.months_read]

    write_events(_events(spark, [1, 2, 3]), path)
    assert run("a") == ["2024-01", "2024-02", "2024-03"]
    assert run("b") == []
    before = MonthPartials(spark, f"{root}/meter_months").manifest()
    write_events(_events(spark, [4]), path, mode="append")                 # a new month
    assert run("c") == ["2024-04"]
    after = MonthPartials(spark, f"{root}/meter_months").manifest()
    assert {m: after[m] for m in before} == before and len(after) == 4     # carried over by path
    write_events(_events(spark, [2], meters=7, each=1), path, mode="append")   # late events of an old one
    assert run("d") == ["2024-02"]


def test_a_dropped_month_leaves_the_totals(spark, scratch):
    import shutil
    path = os.path.join(scratch, "events")
    partials = MonthPartials(spark, os.path.join(scratch, "p"))
    write_events(_events(spark, [1, 2]), path)
    assert len(partials.update(path)) == 2
    shutil.rmtree(os.path.join(path, "event_month=2024-01"))
    assert MonthPartials(spark, os.path.join(scratch, "p")).update(path) == []
    got = MonthPartials(spark, os.path.join(scratch, "p")).per_meter()
    assert sorted(got.select("meter_number", "_n").collect()) == sorted(
        S.events_per_meter(read_events(spark, path)).select("meter_number", "_n").collect())


def test_no_events_and_events_without_a_meter(spark, scratch):
    path = os.path.join(scratch, "events")
    partials = MonthPartials(spark, os.path.join(scratch, "p"))
    events(spark, [{"meter_number": "M", "event_time": "2024-01-01 00:00:00"}]).limit(0).withColumn("event_month", F.lit("x")).write.parquet(path)
    assert partials.update(path) == [] and partials.per_meter().count() == 0
    other = os.path.join(scratch, "other")
    write_events(events(spark, [{"meter_number": None, "event_time": "2024-01-01 00:00:00"}] * 2), other)
    assert len(partials.update(other)) == 1
    assert [(r["meter_number"], r["_n"]) for r in partials.per_meter().collect()] == [(None, 2)]
