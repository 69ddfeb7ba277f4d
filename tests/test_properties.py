
import re
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridwatch.functions.text import contains_pattern
from gridwatch.operators import joins as J
from gridwatch.operators import lockouts as LO
from gridwatch.operators import spatial as K
from gridwatch.operators import summaries as S
from gridwatch.sources import fixtures as X

SF = "/root/testdata/sf0.01"


def test_summary_invariants(spark):
    cust, ev = X.customers(spark, SF), X.tamper_events(spark, SF)
    ms = S.meter_summary(ev, cust)
    flagged = S.with_geom(S.with_coordinate_flags(cust, ms))
    # one meter-summary row per distinct event meter
    assert ms.count() == ev.select("meter_number").distinct().count()
    # map view rows = customers with any coordinates ('latest' rule)
    assert K.customer_map_view(flagged, ms).count() == flagged.filter("has_any_coordinates").count()
    # with + without >= total per district
    des = S.district_event_summary(flagged, ms)
    bad = des.filter(F.col("meters_with_coordinates") + F.col("meters_without_coordinates") < F.col("total_meters"))
    assert bad.count() == 0
    # latest event is the newest per meter
    latest = J.latest_event_per_meter(ev)
    newest = ev.groupBy("meter_number").agg(F.max("event_time").alias("t"))
    assert latest.join(newest, "meter_number").filter(F.col("event_time") != F.col("t")).count() == 0


def _reference_lockouts(rows, window, limit):
    """Plain sequential rule, written independently of the batch operator."""
    out = {}
    counters = {}
    for user, ts, aid, ok in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        cnt, exp = counters.get(user, (0, None))
        if exp is None or ts >= exp:
            cnt, exp = 0, ts + window
        cnt += 1
        if cnt > limit:
            res = "locked"
            counters[user] = (cnt, exp)
        elif ok:
            res = "success"
            counters.pop(user, None)
        else:
            res = "failed"
            counters[user] = (cnt, exp)
        out[aid] = (cnt, res)
    return out


attempt_lists = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 120), st.booleans()),
                         min_size=1, max_size=60)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(attempt_lists, st.integers(1, 4), st.integers(1, 40))
def test_lockouts_match_brute_force(spark, items, limit, window_min):
    base = datetime(2024, 1, 1)
    rows = [(u, base + timedelta(minutes=m), i, ok) for i, (u, m, ok) in enumerate(items)]
    df = spark.createDataFrame(rows, "user string, ts timestamp, attempt_id long, success boolean")
    got = {r["attempt_id"]: (r["counter"], r["result"])
           for r in LO.attempt_lockouts(df, timedelta(minutes=window_min), limit, partitions=3).collect()}
    assert got == _reference_lockouts(rows, timedelta(minutes=window_min), limit)


keys = st.one_of(st.none(), st.sampled_from(["m1", "m2", "m3", "m4"]))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(keys, max_size=40), st.lists(st.sampled_from(["m1", "m2", "m5"]), unique=True))
def test_salted_left_join_equals_plain_left_join(spark, left_keys, right_keys):
    left = spark.createDataFrame([(str(i), k) for i, k in enumerate(left_keys)], "ecgkey string, meternumber string")
    right = spark.createDataFrame([(k, len(k)) for k in right_keys], "rk string, v int")
    a = sorted(J.left_join_nullable(left, right, "meternumber", "rk", ["ecgkey"]).collect())
    b = sorted(left.join(right, left["meternumber"] == right["rk"], "left").collect())
    assert a == b


def _like_reference(pattern: str, text: str) -> bool:
    """LIKE with backslash escapes, as PostgreSQL reads it."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 2
            continue
        out.append(".*" if ch == "%" else "." if ch == "_" else re.escape(ch))
        i += 1
    return re.fullmatch("".join(out), text, flags=re.S) is not None


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab%_\\", min_size=1, max_size=5), st.lists(st.text(alphabet="AB%_\\", max_size=6),
                                                                    min_size=1, max_size=8))
def test_like_translation_matches_postgres_reading(spark, needle, texts):
    pattern = contains_pattern(needle)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["m"] for r in df.select(F.col("t").like(pattern).alias("m")).collect()]
    raw = "%" + needle.upper() + "%"
    assert got == [_like_reference(raw, t) for t in texts]


def test_lockouts_of_hot_and_missing_users(spark):
    base = datetime(2024, 1, 1)
    rows = [("hot", base + timedelta(minutes=i % 50, seconds=i), i, i % 7 == 0) for i in range(120)]
    rows += [("cold", base + timedelta(minutes=3 * i), 1000 + i, False) for i in range(10)]
    rows += [(None, base + timedelta(minutes=2 * i), 2000 + i, i % 5 == 0) for i in range(20)]
    df = spark.createDataFrame(rows, "user string, ts timestamp, attempt_id long, success boolean")
    out = LO.attempt_lockouts(df, timedelta(minutes=15), 5, partitions=4).collect()
    assert sum(r["user"] is None for r in out) == 20 and len(out) == len(rows)
    assert {r["attempt_id"]: (r["counter"], r["result"]) for r in out} == _reference_lockouts(
        [(u or "~none", *rest) for u, *rest in rows], timedelta(minutes=15), 5)
