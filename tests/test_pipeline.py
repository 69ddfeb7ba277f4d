"""Ingest, storage, merge sinks, exports and the resumable refresh."""

import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gridwatch.functions.params import EventFilter, parse_query_time
from gridwatch.operators import customers as C
from gridwatch.operators import lockouts as LO
from gridwatch.operators import reports as R
from gridwatch.plans.refresh import Refresh, load_and_refresh
from gridwatch.sources import exports as X
from gridwatch.sources import readers as RD
from tests.helpers import customers, events


def _write_csv(path, header, rows):
    with open(path, "w") as fh:
        fh.write(",".join(header) + "\n")
        for r in rows:
            fh.write(",".join(r) + "\n")


def test_csv_ingest_keeps_text_and_types(spark, scratch):
    p = os.path.join(scratch, "cust.csv")
    _write_csv(p, ["ecgkey", "meternumber", "districtcode", "address", "latitude", "isamr", "lastpaymentdate",
                   "currentbalance", "unknowncol"],
               [["0001", "0261120549", "01-06", '"12, Ring Road"', "-0.2", "t", "2024-02-03", "12.5", "x"],
                ["0002", "", "01-07", "Plot 4", "abc", "TRUE", "03/02/2024", "", "y"]])
    df = RD.read_customers_csv(spark, p)
    rows = {r["ecgkey"]: r for r in df.collect()}
    assert rows["0001"]["meternumber"] == "0261120549" and rows["0001"]["districtcode"] == "01-06"
    assert rows["0001"]["address"] == "12, Ring Road"
    assert rows["0001"]["latitude"] == -0.2 and rows["0001"]["isamr"] is True
    assert str(rows["0001"]["lastpaymentdate"]) == "2024-02-03"
    assert rows["0002"]["meternumber"] is None and rows["0002"]["latitude"] is None
    assert rows["0002"]["isamr"] is False and rows["0002"]["lastpaymentdate"] is None
    assert "unknowncol" not in df.columns and len(df.columns) == 83


def test_events_csv_rejects_not_null_violations(spark, scratch):
    p = os.path.join(scratch, "ev.csv")
    _write_csv(p, ["meter_number", "event_time", "event_code"],
               [["M1", "2024-01-02 10:00:00", "a"], ["", "2024-01-02 10:00:00", "b"], ["M2", "bad", "c"]])
    assert RD.read_events_csv(spark, p).count() == 1
    assert RD.event_rejects(spark, p).count() == 2


def test_month_partitions_are_pruned(spark, scratch):
    ev = events(spark, [{"meter_number": "M1", "event_time": t} for t in
                        ("2024-01-15 00:00:00", "2024-02-15 00:00:00", "2024-03-15 00:00:00")])
    path = os.path.join(scratch, "events")
    RD.write_events(ev, path)
    assert sorted(d for d in os.listdir(path) if d.startswith("event_month=")) == [
        "event_month=2024-01", "event_month=2024-02", "event_month=2024-03"]
    stored = RD.read_events(spark, path)
    f = EventFilter(from_=parse_query_time("2024-02-01"), to=parse_query_time("2024-02-28"))
    got = C.filter_events(stored, f, "M1")
    assert got.count() == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "event_month" in plan
    months = {r["month"].month: r["events"] for r in RD.events_by_month(stored).collect()}
    assert months == {1: 1, 2: 1, 3: 1}


def test_refresh_skips_completed_steps_until_reset(spark, scratch):
    cust = customers(spark, [{"ecgkey": "1", "meternumber": "M1", "latitude": -0.2, "longitude": 5.6},
                             {"ecgkey": "2", "meternumber": "M2", "districtcode": "01-02"}])
    ev = events(spark, [{"meter_number": "M1", "event_time": "2024-01-01 00:00:00"}])
    r = Refresh(spark, os.path.join(scratch, "root"), run_id="t")
    first = r.run(cust, ev, as_of=datetime(2024, 2, 1))
    status = [(x["step"], x["status"]) for x in r.status().collect()]
    assert status == [("meter_summary", "✓ done"), ("coordinate_flags", "✓ done"),
                      ("geom", "✓ done"), ("district_summary", "✓ done")]
    # second run with new events: completed steps are skipped (nothing changes)
    ev2 = events(spark, [{"meter_number": "M2", "event_time": "2024-01-05 00:00:00"}])
    assert r.run(cust, ev2) == first
    assert r.table("meter_summary").count() == 1
    r.reset()
    assert {x["status"] for x in r.status().collect()} == {"○ pending"}
    r.run(cust, ev2, as_of=datetime(2024, 3, 1))
    ms = {x["meternumber"] for x in r.table("meter_summary").collect()}
    assert ms == {"M1", "M2"}                  # merge keeps the stale meter M1
    des = {x["districtcode"]: x for x in r.table("district_event_summary").collect()}
    assert des["01-02"]["meters_with_events"] == 1


def test_failed_step_records_error(spark, scratch):
    cust = customers(spark, [{"ecgkey": "1", "meternumber": "M1"}])
    bad = spark.createDataFrame([("M1",)], "meter_number string")       # no event_time
    r = Refresh(spark, os.path.join(scratch, "root2"), run_id="t")
    try:
        r.run(cust, bad)
    except Exception:  # noqa: BLE001
        pass
    row = [x for x in r.checkpoints().collect() if x["step"] == "meter_summary"][0]
    assert row["completed"] is False and row["error_msg"]


def test_load_and_refresh_from_csv(spark, scratch):
    cp, ep = os.path.join(scratch, "c.csv"), os.path.join(scratch, "e.csv")
    _write_csv(cp, ["ecgkey", "meternumber", "districtcode", "districtname", "latitude", "longitude"],
               [["1", "M1", "01-01", "A", "-0.2", "5.6"], ["2", "M2", "01-01", "A", "", ""]])
    _write_csv(ep, ["meter_number", "event_time", "latitude", "longitude"],
               [["M2", "2024-01-02T10:00:00Z", "-0.1", "5.5"], ["M2", "2024-02-02 10:00:00", "", ""]])
    paths = load_and_refresh(spark, cp, ep, os.path.join(scratch, "root3"), as_of=datetime(2024, 3, 1))
    des = spark.read.parquet(paths["district_event_summary"]).collect()[0]
    assert des["total_meters"] == 2 and des["total_events"] == 2 and des["meters_with_coordinates"] == 1


def test_geojson_and_envelope(spark):
    cust = customers(spark, [{"ecgkey": "1", "meternumber": "M1", "fullname": "A", "latitude": -0.2,
                              "longitude": 5.6}, {"ecgkey": "2", "meternumber": "M2", "fullname": "B"}])
    ev = events(spark, [{"meter_number": "M1", "event_time": "2024-01-01 00:00:00"}])
    feats = X.geojson_features(C.customer_dto(C.with_latest_event_for(cust, ev, 10))).collect()
    assert len(feats) == 1
    doc = json.loads(feats[0]["feature"])
    assert doc["geometry"]["coordinates"] == [-0.2, 5.6]
    assert doc["properties"]["event_desc"] == "STDEVT:tamper"
    from gridwatch.functions.params import CustomerFilter
    f = CustomerFilter(page=1, page_size=1)
    env = json.loads(X.customer_envelope(C.customer_page(cust, ev, f, with_position=True), C.count_customers(cust, f),
                                         1, 1).collect()[0]["json"])
    assert env["total"] == 2 and env["total_pages"] == 2 and len(env["data"]) == 1
    assert env["data"][0]["latest_tamper_event"]["event_time"].startswith("2024-01-01T00:00:00")


def test_table_stats(spark, scratch):
    p = os.path.join(scratch, "t")
    spark.range(1000).write.parquet(p)
    r = R.table_stats(spark, {"t": p}).collect()[0]
    assert r["row_count"] == 1000 and r["total_bytes"] > 0 and r["total_size"].endswith("bytes")


def _attempts(spark, rows):
    base = datetime(2024, 1, 1)
    data = [("u", base + timedelta(minutes=m), i, ok) for i, (m, ok) in enumerate(rows)]
    return spark.createDataFrame(data, "user string, ts timestamp, attempt_id long, success boolean")


def test_lockout_rules(spark):
    # six failures inside the window: the sixth is locked; success while locked does not reset
    got = [r["result"] for r in LO.attempt_lockouts(_attempts(spark, [(i, False) for i in range(6)] + [(7, True)]))
           .orderBy("attempt_id").collect()]
    assert got == ["failed"] * 5 + ["locked", "locked"]
    # fail, success, fail: the success clears the counter
    got = [r["counter"] for r in LO.attempt_lockouts(_attempts(spark, [(0, False), (1, True), (2, False)]))
           .orderBy("attempt_id").collect()]
    assert got == [1, 2, 1]
    # after the 15-minute expiry the counter restarts at 1
    got = [r["counter"] for r in LO.attempt_lockouts(_attempts(spark, [(0, False), (5, False), (15, False)]))
           .orderBy("attempt_id").collect()]
    assert got == [1, 2, 1]


def test_event_envelope(spark):
    ev = events(spark, [{"meter_number": "M1", "event_time": f"2024-01-0{i} 10:00:00"} for i in (1, 2, 3)])
    f = EventFilter(page=1, page_size=2)
    env = json.loads(X.event_envelope(C.event_page(ev, "M1", f, with_position=True), C.count_events(ev, "M1", f), 1, 2, "M1",
                                      "A1").collect()[0]["json"])
    assert env["meter_number"] == "M1" and env["account_number"] == "A1"
    assert env["total"] == 3 and env["total_pages"] == 2
    assert [e["event_time"][:10] for e in env["events"]] == ["2024-01-03", "2024-01-02"]
    empty = json.loads(X.event_envelope(C.event_page(ev, "M9", f), C.count_events(ev, "M9", f), 1, 2,
                                        "M9").collect()[0]["json"])
    assert empty["events"] == [] and empty["total"] == 0 and "account_number" not in empty


def test_export_records_and_tile_index_write(spark, scratch):
    from gridwatch.operators import joins as J
    from gridwatch.operators import spatial as K
    from gridwatch.operators import summaries as S
    cust = customers(spark, [{"ecgkey": str(i), "meternumber": f"M{i}", "fullname": f"N{i}",
                              "latitude": -0.2 + i / 100, "longitude": 5.6} for i in range(30)])
    ev = events(spark, [{"meter_number": "M1", "event_time": "2024-01-01 00:00:00"}])
    dto = C.customer_dto(J.with_latest_event(cust, ev))
    out = os.path.join(scratch, "export")
    X.export_records(dto, out, "json")
    back = spark.read.json(out)
    assert back.count() == 30 and "latest_tamper_event" in back.columns
    X.export_records(C.flatten_dto(dto), os.path.join(scratch, "export_csv"), "csv")
    assert spark.read.option("header", True).csv(os.path.join(scratch, "export_csv")).count() == 30
    idx = K.tile_index(S.with_geom(cust), 5, 7)
    K.write_tile_index(idx, os.path.join(scratch, "tiles"))
    z6 = spark.read.parquet(os.path.join(scratch, "tiles")).filter(F.col("tile_z") == 6)
    assert z6.agg(F.sum("features")).collect()[0][0] == 30
    X.write_geojson_seq(X.geojson_features(dto), os.path.join(scratch, "geo"))
    assert spark.read.text(os.path.join(scratch, "geo")).count() == 30


def test_sql_views(spark):
    from gridwatch.plans.views import register_views
    from gridwatch.sources import fixtures as FX
    sf = "/root/testdata/sf0.01"
    register_views(FX.customers(spark, sf), FX.tamper_events(spark, sf), prefix="t_")
    assert spark.sql("SELECT COUNT(*) FROM t_customer_map_view").collect()[0][0] == 984
    assert spark.sql("SELECT SUM(total_events) FROM t_district_event_summary").collect()[0][0] == 11448
    top = spark.sql("SELECT meternumber FROM t_meter_summary ORDER BY event_count DESC, meternumber LIMIT 1")
    assert top.count() == 1


def test_refresh_recovers_after_a_failed_step(spark, scratch):
    cust = customers(spark, [{"ecgkey": "1", "meternumber": "M1", "latitude": -0.2, "longitude": 5.6},
                             {"ecgkey": "2", "meternumber": None, "districtcode": "01-02"}])
    ev = events(spark, [{"meter_number": "M1", "event_time": "2024-01-01 00:00:00"}])
    r = Refresh(spark, os.path.join(scratch, "rec"), run_id="t")
    try:
        r.run(cust, spark.createDataFrame([("M1",)], "meter_number string"))
    except Exception:  # noqa: BLE001 - the failed first attempt
        pass
    r.run(cust, ev, as_of=datetime(2024, 2, 1))
    fresh = Refresh(spark, os.path.join(scratch, "fresh"), run_id="t")
    fresh.run(cust, ev, as_of=datetime(2024, 2, 1))
    for name in ("meter_summary", "customers", "district_event_summary"):
        assert sorted(r.table(name).collect()) == sorted(fresh.table(name).collect()), name
    assert {x["status"] for x in r.status().collect()} == {"✓ done"}


def test_cli_load_status_reset_summary(spark, scratch, capsys):
    from gridwatch.plans import cli
    cp, ep = os.path.join(scratch, "c.csv"), os.path.join(scratch, "e.csv")
    _write_csv(cp, ["ecgkey", "meternumber", "districtcode", "latitude", "longitude"],
               [["1", "M1", "01-01", "-0.2", "5.6"], ["2", "M2", "01-01", "", ""]])
    _write_csv(ep, ["meter_number", "event_time"], [["M2", "2024-01-02 10:00:00"]])
    root = os.path.join(scratch, "cli")
    assert cli.main(["load", "--root", root, "--customers-csv", cp, "--events-csv", ep]) == 0
    assert cli.main(["summary", "--root", root]) == 0
    assert cli.main(["reset", "--root", root]) == 0
    assert cli.main(["status", "--root", root]) == 0
    assert cli.main(["stats", "--table", f"customers={root}/customer_records"]) == 0
    out = capsys.readouterr().out
    assert "✓ done" in out and "○ pending" in out and "total_customers" in out and "customers" in out


def test_envelope_keeps_page_order(spark):
    from gridwatch.functions.params import CustomerFilter
    names = [None if i % 7 == 0 else f"N{(i * 37) % 101:03d}" for i in range(60)]
    cust = customers(spark, [{"ecgkey": f"{i:03d}", "meternumber": f"M{i % 5}", "fullname": n}
                             for i, n in enumerate(names)]).repartition(6)
    ev = events(spark, [{"meter_number": f"M{i}", "event_time": "2024-01-01 00:00:00"} for i in range(5)])
    f = CustomerFilter(page=1, page_size=60)
    env = json.loads(X.customer_envelope(C.customer_page(cust, ev, f, with_position=True),
                                         C.count_customers(cust, f), 1, 60).collect()[0]["json"])
    got = [(r["full_name"], r["ecgkey"]) for r in env["data"]]
    want = sorted(((n or "", f"{i:03d}") for i, n in enumerate(names)),
                  key=lambda t: (t[0] == "", t[0], t[1]))
    assert got == want and "page_position" not in env["data"][0]
