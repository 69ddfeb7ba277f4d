"""Reproducible scale/skew check.

Builds enlarged, deliberately skewed copies of the driver's tables in a fresh
scratch folder (a third of the events on one meter, a third of the
customers without a meter), runs the main operators through the ``noop``
sink with Spark's event log enabled in that folder, and prints one JSON line
per operator: wall time, shuffle bytes written, and the largest single
reducer read (the skew indicator).

    python tools/scale_check.py [--sf-dir DIR] [--event-copies 50] [--customer-copies 200]
"""

from __future__ import annotations

import argparse
import collections
import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def _copies(df, n: int):
    """``n`` copies of every row with a copy index ``_c`` (no join)."""
    return df.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def build_inputs(spark, sf: str, out: str, event_copies: int, customer_copies: int) -> None:
    from gridwatch.sources import fixtures as X
    ev = _copies(spark.read.parquet(f"{sf}/events.parquet"), event_copies)
    users = spark.read.parquet(f"{sf}/customer.parquet").count()
    ev = ev.select((F.col("event_id") + F.col("_c") * 100_000_000).alias("event_id"),
                   (F.col("ts") + F.make_interval(secs=F.col("_c"))).alias("ts"),
                   F.when(F.col("event_id") % 3 == 0, F.lit(0))          # one hot meter: a third
                    .otherwise(F.col("user_id") + users * (F.col("_c") % 10)).alias("user_id"),
                   "event_type", "value", "props")
    X.events_from_stream(ev).write.mode("overwrite").parquet(f"{out}/tamper_events")
    c = _copies(spark.read.parquet(f"{sf}/customer.parquet"), customer_copies)
    c = c.select((F.col("c_custkey") + F.col("_c") * users).alias("c_custkey"), "c_name", "c_nationkey",
                 "c_acctbal", "c_mktsegment")
    cust = X.customers_from_tpch(c, spark.read.parquet(f"{sf}/nation.parquet"),
                                 spark.read.parquet(f"{sf}/region.parquet"))
    # a third of the customers lose their meter number (NULL-key skew)
    cust = cust.withColumn("meternumber", F.when(F.xxhash64("ecgkey") % 3 == 0, F.lit(None))
                           .otherwise(F.col("meternumber")))
    cust.write.mode("overwrite").parquet(f"{out}/customers")


def shuffle_metrics(log_dir: str) -> dict[str, dict[str, float]]:
    import zstandard
    group_of_stage: dict[int, str] = {}
    agg: dict[str, dict[str, float]] = collections.defaultdict(lambda: {"shuffle_mb": 0.0, "max_reducer_mb": 0.0})
    for path in glob.glob(f"{log_dir}/**/events_*", recursive=True):
        raw = open(path, "rb")
        lines = (io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
                 if path.endswith(".zstd") else open(path))
        for line in lines:
            e = json.loads(line)
            kind = e.get("Event")
            if kind == "SparkListenerJobStart":
                g = (e.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in e.get("Stage IDs", []):
                    group_of_stage[sid] = g
            elif kind == "SparkListenerTaskEnd":
                g = group_of_stage.get(e["Stage ID"])
                if g is None:
                    continue
                m = e.get("Task Metrics") or {}
                w = m.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
                r = m.get("Shuffle Read Metrics", {})
                read = r.get("Remote Bytes Read", 0) + r.get("Local Bytes Read", 0)
                agg[g]["shuffle_mb"] += w / 1e6
                agg[g]["max_reducer_mb"] = max(agg[g]["max_reducer_mb"], read / 1e6)
    return agg


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    ap.add_argument("--event-copies", type=int, default=50)
    ap.add_argument("--customer-copies", type=int, default=200)
    args = ap.parse_args()
    out = tempfile.mkdtemp(prefix="gridwatch-scale-")
    os.makedirs(f"{out}/eventlog")
    spark = (SparkSession.builder.master("local[8]").appName("gridwatch-scale")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"{out}/eventlog")
             .config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "8g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from gridwatch.functions.params import CustomerFilter
    from gridwatch.operators import customers as C
    from gridwatch.operators import dashboards as D
    from gridwatch.operators import joins as J
    from gridwatch.operators import spatial as K
    from gridwatch.operators import summaries as S
    from gridwatch.session import apply_defaults, checkpoint_dir
    apply_defaults(spark)
    checkpoint_dir(spark)
    build_inputs(spark, args.sf_dir, out, args.event_copies, args.customer_copies)
    cust, ev = spark.read.parquet(f"{out}/customers"), spark.read.parquet(f"{out}/tamper_events")
    S.meter_summary(ev, cust).write.mode("overwrite").parquet(f"{out}/meter_summary")
    ms = spark.read.parquet(f"{out}/meter_summary")
    runs = {
        "latest_event_per_meter": lambda: J.latest_event_per_meter(ev),
        "customers_latest_event": lambda: C.customer_dto(J.with_latest_event(cust, ev)),
        "meter_summary": lambda: S.meter_summary(ev, cust),
        "district_event_summary": lambda: S.district_event_summary(cust, ms),
        "customer_map_view": lambda: K.customer_map_view(cust, ms),
        "tile_index_z5_z12": lambda: K.tile_index(K.customer_map_view(cust, ms), 5, 12),
        "account_meters": lambda: D.account_meters(cust, ms),
        "customer_page": lambda: C.customer_page(cust, ev, CustomerFilter(search="customer#0001")),
        "salted_left_join_no_broadcast": lambda: J.left_join_nullable(
            cust, ms.select(F.col("meternumber").alias("_k"), "event_count"), "meternumber", "_k", ["ecgkey"]),
    }
    times = {}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    for name, build in runs.items():
        spark.sparkContext.setJobGroup(name, name)
        if name == "salted_left_join_no_broadcast":
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        t0 = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 2)
    rows = {"customers": cust.count(), "events": ev.count(),
            "hot_meter_events": ev.filter(F.col("meter_number") == "0").count(),
            "null_meter_customers": cust.filter(F.col("meternumber").isNull()).count()}
    spark.stop()
    metrics = shuffle_metrics(f"{out}/eventlog")
    print(json.dumps({"scratch": out, "rows": rows}))
    for name, sec in times.items():
        m = metrics.get(name, {})
        print(json.dumps({"operator": name, "sec": sec, "shuffle_mb": round(m.get("shuffle_mb", 0.0), 2),
                          "max_reducer_mb": round(m.get("max_reducer_mb", 0.0), 2)}))


if __name__ == "__main__":
    main()
