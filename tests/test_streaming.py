"""Streaming forms equal their batch forms (available-now triggers)."""

import os
from datetime import datetime, timedelta

from gridwatch.operators import lockouts as LO
from gridwatch.operators import summaries as S
from gridwatch.streaming import incremental as INC
from gridwatch.streaming.lockouts import lockout_stream
from tests.helpers import customers, events


def test_stream_meter_summary_equals_batch(spark, scratch):
    ev = events(spark, [{"meter_number": f"M{i % 4}", "event_time": datetime(2024, 1, 1) + timedelta(hours=i),
                         "latitude": (None if i % 3 else 0.5), "longitude": 5.0} for i in range(40)])
    src = os.path.join(scratch, "src")
    ev.limit(20).write.parquet(src)                     # two files arrive one after the other
    ev.subtract(ev.limit(20)).write.mode("append").parquet(src)
    cust = customers(spark, [{"ecgkey": "1", "meternumber": "M1"}, {"ecgkey": "2", "meternumber": "M1"}])
    stream = INC.read_stream(spark, src, ev.schema, max_files_per_trigger=1)
    q = INC.meter_summary_stream(stream, os.path.join(scratch, "state"), os.path.join(scratch, "chk"))
    q.awaitTermination()
    got = S.finish_meter_summary(INC.read_meter_state(spark, os.path.join(scratch, "state")), cust)
    want = S.meter_summary(spark.read.parquet(src), cust)
    assert sorted(got.collect()) == sorted(want.collect())
    q2 = INC.coordinate_meter_stream(INC.read_stream(spark, src, ev.schema), os.path.join(scratch, "m"),
                                     os.path.join(scratch, "chk2"))
    q2.awaitTermination()
    flags = INC.flags_from_coordinate_meters(cust, spark.read.parquet(os.path.join(scratch, "m")))
    want_flags = S.with_coordinate_flags(cust, variant="any", events=spark.read.parquet(src))
    assert sorted(flags.collect()) == sorted(want_flags.select(*flags.columns).collect())


def test_recompute_touched_meters(spark):
    ev = events(spark, [{"meter_number": "M1", "event_time": "2024-01-01 00:00:00", "latitude": 1.0,
                         "longitude": 2.0}, {"meter_number": "M2", "event_time": "2024-01-01 00:00:00"}])
    touched = spark.createDataFrame([("M1",), ("M2",), ("M3",)], "meternumber string")
    got = {r["meternumber"]: r["has_event_coordinates"] for r in INC.recompute_meters(ev, touched).collect()}
    assert got == {"M1": True, "M2": False, "M3": False}


def test_lockout_stream_equals_batch(spark, scratch):
    base = datetime(2024, 1, 1)
    rows = [(f"u{i % 3}", base + timedelta(minutes=2 * i), i, i % 7 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "user string, ts timestamp, attempt_id long, success boolean")
    src = os.path.join(scratch, "att")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    out = lockout_stream(stream)
    q = (out.writeStream.outputMode("append").format("parquet").option("path", os.path.join(scratch, "lo"))
         .option("checkpointLocation", os.path.join(scratch, "lochk")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r["attempt_id"], r["counter"], r["result"]) for r in spark.read.parquet(
        os.path.join(scratch, "lo")).collect())
    want = sorted((r["attempt_id"], r["counter"], r["result"]) for r in LO.attempt_lockouts(df).collect())
    assert got == want


def test_meter_state_compaction(spark, scratch):
    base = datetime(2024, 1, 1)
    ev = events(spark, [{"meter_number": f"M{i % 3}", "event_time": base + timedelta(hours=i)} for i in range(30)])
    src = os.path.join(scratch, "src")
    state, chk = os.path.join(scratch, "state"), os.path.join(scratch, "chk")
    ev.filter("event_id < 10").write.parquet(src)
    INC.meter_summary_stream(INC.read_stream(spark, src, ev.schema), state, chk).awaitTermination()
    INC.compact_meter_state(spark, state)
    ev.filter("event_id >= 10 AND event_id < 20").write.mode("append").parquet(src)
    INC.meter_summary_stream(INC.read_stream(spark, src, ev.schema), state, chk).awaitTermination()
    INC.compact_meter_state(spark, state)
    ev.filter("event_id >= 20").write.mode("append").parquet(src)
    INC.meter_summary_stream(INC.read_stream(spark, src, ev.schema), state, chk).awaitTermination()
    got = sorted(INC.read_meter_state(spark, state).collect())
    want = sorted(S.events_per_meter(spark.read.parquet(src), "max_by").collect())
    assert got == want and len(got) == 3
    assert sorted(n for n in os.listdir(state) if n.startswith("batch_id=")) == ["batch_id=1", "batch_id=2"]


def test_meter_state_compacts_inside_the_sink(spark, scratch):
    base = datetime(2024, 1, 1)
    ev = events(spark, [{"meter_number": f"M{i % 4}", "event_time": base + timedelta(hours=i)} for i in range(24)])
    src = os.path.join(scratch, "src")
    for k in range(3):
        ev.filter(f"event_id >= {8 * k} AND event_id < {8 * (k + 1)}").write.mode("append").parquet(src)
    state = os.path.join(scratch, "state")
    q = INC.meter_summary_stream(INC.read_stream(spark, src, ev.schema, max_files_per_trigger=1), state,
                                 os.path.join(scratch, "chk"), compact_every=2)
    q.awaitTermination()
    assert INC._base_version(spark, state)[1] >= 1          # a base was published by the sink
    got = sorted(INC.read_meter_state(spark, state).collect())
    want = sorted(S.events_per_meter(spark.read.parquet(src), "max_by").collect())
    assert got == want


def test_event_changes_update_and_clear_flags(spark, scratch):
    from gridwatch.sources.readers import write_events
    stored = os.path.join(scratch, "events")
    changes = os.path.join(scratch, "changes")
    state, chk = os.path.join(scratch, "flags"), os.path.join(scratch, "chk")
    e1 = events(spark, [{"meter_number": "M1", "event_time": "2024-01-01 00:00:00", "latitude": 1.0, "longitude": 2.0},
                        {"meter_number": "M2", "event_time": "2024-01-01 00:00:00"}])
    write_events(e1, stored)
    schema = "meter_number string, op string"
    spark.createDataFrame([("M1", "insert"), ("M2", "insert")], schema).write.mode("append").parquet(changes)
    stream = lambda: spark.readStream.schema(schema).parquet(changes)
    INC.event_change_flag_stream(stream(), stored, state, chk).awaitTermination()
    got = {r["meternumber"]: r["has_event_coordinates"] for r in INC.read_event_flags(spark, state).collect()}
    assert got == {"M1": True, "M2": False}
    # the event with coordinates is deleted, M2 gets one with coordinates
    e2 = events(spark, [{"meter_number": "M1", "event_time": "2024-01-02 00:00:00"},
                        {"meter_number": "M2", "event_time": "2024-01-01 00:00:00", "latitude": 3.0, "longitude": 4.0}])
    write_events(e2, stored)
    spark.createDataFrame([("M1", "delete"), ("M2", "update")], schema).write.mode("append").parquet(changes)
    INC.event_change_flag_stream(stream(), stored, state, chk).awaitTermination()
    got = {r["meternumber"]: r["has_event_coordinates"] for r in INC.read_event_flags(spark, state).collect()}
    assert got == {"M1": False, "M2": True}


def test_lockout_stream_across_micro_batches(spark, scratch):
    base = datetime(2024, 1, 1)
    rows = [(f"u{i % 2}", base + timedelta(minutes=3 * i), i, i % 9 == 0) for i in range(90)]
    df = spark.createDataFrame(rows, "user string, ts timestamp, attempt_id long, success boolean")
    src = os.path.join(scratch, "att")
    for k in range(6):                                     # six files, in time order
        df.filter(f"attempt_id >= {15 * k} AND attempt_id < {15 * (k + 1)}").coalesce(1) \
          .write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = lockout_stream(stream, timedelta(minutes=15), 3)
    q = (out.writeStream.outputMode("append").format("parquet").option("path", os.path.join(scratch, "lo"))
         .option("checkpointLocation", os.path.join(scratch, "lochk")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r["attempt_id"], r["counter"], r["result"]) for r in spark.read.parquet(
        os.path.join(scratch, "lo")).collect())
    want = sorted((r["attempt_id"], r["counter"], r["result"])
                  for r in LO.attempt_lockouts(df, timedelta(minutes=15), 3).collect())
    assert got == want and len(got) == 90


def test_late_attempts_get_an_outcome(spark, scratch):
    base = datetime(2024, 1, 1)
    schema = "user string, ts timestamp, attempt_id long, success boolean"
    src, out_dir = os.path.join(scratch, "att"), os.path.join(scratch, "lo")
    for part in ([("u", base + timedelta(minutes=9), 1, False), (None, base, 2, False)],
                 [("u", base, 3, False), ("u", base + timedelta(minutes=10), 4, False), (None, base + timedelta(minutes=1), 5, False)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        out = lockout_stream(INC.read_stream(spark, src, spark.read.parquet(src).schema), timedelta(minutes=15), 3)
        (out.writeStream.outputMode("append").format("parquet").option("path", out_dir)
         .option("checkpointLocation", os.path.join(scratch, "chk")).trigger(availableNow=True).start().awaitTermination())
    got = {r["attempt_id"]: (r["counter"], r["result"]) for r in spark.read.parquet(out_dir).collect()}
    assert got == {1: (1, "failed"), 2: (1, "failed"), 3: (0, "late"), 4: (2, "failed"), 5: (2, "failed")}


def test_state_is_kept_in_rocksdb_wherever_defaults_are_applied(spark):
    from gridwatch.session import apply_defaults
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.unset(key)
    apply_defaults(spark)
    assert "RocksDB" in spark.conf.get(key)


ATTEMPTS = "user string, ts timestamp, attempt_id long, success boolean"


def test_idle_users_leave_the_store_and_late_attempts_are_reported(spark, scratch):
    base, src, out_dir, chk = datetime(2024, 1, 1), os.path.join(scratch, "in"), os.path.join(scratch, "out"), os.path.join(scratch, "chk")

    def arrive(rows):
        spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.mode("append").parquet(src)
        out = lockout_stream(spark.readStream.schema(ATTEMPTS).parquet(src), timedelta(minutes=15), 3, keep=timedelta(days=2))
        (out.writeStream.outputMode("append").format("parquet").option("path", out_dir).option("checkpointLocation", chk)
         .trigger(availableNow=True).start().awaitTermination(120))

    arrive([("a", base, 1, False), ("b", base + timedelta(minutes=1), 2, False), (None, base, 9, None)])
    arrive([("a", base + timedelta(minutes=5), 3, False), ("b", base - timedelta(days=9), 4, False)])
    arrive([("a", base + timedelta(days=5), 5, False)])
    got = {r["attempt_id"]: (r["user"], r["counter"], r["result"], r["success"]) for r in spark.read.parquet(out_dir).collect()}
    assert got == {1: ("a", 1, "failed", False), 2: ("b", 1, "failed", False), 9: (None, 1, "failed", None), 3: ("a", 2, "failed", False),
                   4: ("b", 0, "late", False), 5: ("a", 1, "failed", False)}
    held = spark.read.format("statestore").option("path", chk).option("stateVarName", "counter").load()
    assert [r["key"]["user"] for r in held.collect()] == ["a"]


def _changes(spark, rows):
    return spark.createDataFrame(rows, "old_meter_number string, old_latitude double, old_longitude double, "
                                       "meter_number string, latitude double, longitude double")


def test_counted_flags_follow_event_changes_without_stored_events(spark, scratch):
    src, state, chk = os.path.join(scratch, "changes"), os.path.join(scratch, "counts"), os.path.join(scratch, "chk")
    none = (None, None, None)

    def arrive(rows, compact_every=100):
        changes = _changes(spark, [(*old, *new) for old, new in rows])
        changes.coalesce(1).write.mode("append").parquet(src)
        INC.event_count_stream(INC.read_stream(spark, src, changes.schema), state, chk, compact_every=compact_every).awaitTermination()
        return {r["meternumber"]: r["has_event_coordinates"] for r in INC.read_counted_flags(spark, state).collect()}

    stored = events(spark, [{"meter_number": "M0", "event_time": "2024-01-01 00:00:00", "latitude": 1.0, "longitude": 1.0},
                            {"meter_number": "M0", "event_time": "2024-01-01 00:00:00", "latitude": 1.0}])
    INC.seed_event_counts(spark, stored, state)
    assert arrive([(none, ("M1", 1.0, 2.0)), (none, ("M1", 3.0, 4.0)), (none, ("M2", None, 2.0)), (none, (None, 1.0, 1.0))]) == {
        "M0": True, "M1": True, "M2": False}
    # one of two goes, one gets its second coordinate
    assert arrive([(("M1", 1.0, 2.0), none), (("M2", None, 2.0), ("M2", 5.0, 2.0))]) == {"M0": True, "M1": True, "M2": True}
    # the last one goes; one moves to another meter; compaction keeps the sums
    assert arrive([(("M1", 3.0, 4.0), ("M1", 3.0, None)), (("M2", 5.0, 2.0), ("M3", 5.0, 2.0))], compact_every=1) == {
        "M0": True, "M1": False, "M2": False, "M3": True}
    assert arrive([(("M0", 1.0, 1.0), none)], compact_every=1) == {"M0": False, "M1": False, "M2": False, "M3": True}
    assert sorted(n for n in os.listdir(state) if n.startswith("batch_id=")) == ["batch_id=3"]


def test_a_batch_that_runs_again_counts_once(spark, scratch):
    log = INC.event_counts(spark, os.path.join(scratch, "counts"))
    delta = INC.coordinate_deltas(_changes(spark, [(None, None, None, "M1", 1.0, 2.0)] * 2))
    for batch in (0, 1, 1):
        log.append(delta, batch)
    assert [tuple(r) for r in log.read().collect()] == [("M1", 4)]
    log.compact()
    log.append(delta, 1)                                    # replayed after the compaction
    assert [tuple(r) for r in log.read().collect()] == [("M1", 4)]
    log.seed(spark.createDataFrame([("M1", 1)], "meternumber string, delta long"), batch_id=1)
    assert [tuple(r) for r in log.read().collect()] == [("M1", 1)]


def test_flag_log_is_compacted(spark, scratch):
    log = INC.event_flags(spark, os.path.join(scratch, "flags"))
    for batch, flag in enumerate([True, False, True, False]):
        log.append(spark.createDataFrame([("M1", flag), (f"M{batch + 2}", True)], "meternumber string, has_event_coordinates boolean"), batch, 2)
    got = {r["meternumber"]: r["has_event_coordinates"] for r in INC.read_event_flags(spark, os.path.join(scratch, "flags")).collect()}
    assert got == {"M1": False, "M2": True, "M3": True, "M4": True, "M5": True}
    assert log.base()[1] == 3 and sorted(os.listdir(os.path.join(scratch, "flags"))) == ["batch_id=2", "batch_id=3"]
