"""Headline-query benchmark.

/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one JSON line.
Each query is executed to completion through the ``noop`` sink (full plan,
nothing gathered on the driver); after one warm-up pass every query is timed
three times and the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid
from datetime import datetime

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridwatch.plans import catalog  # noqa: E402
from gridwatch.plans.refresh import Refresh  # noqa: E402
from gridwatch.session import checkpoint_dir, local_session  # noqa: E402
from gridwatch.sources import fixtures  # noqa: E402

HEADLINE = {
    "latest_event_per_customer": "customers_latest_event",
    "meter_summary": "meter_summary",
    "district_summary": "district_event_summary",
    "filtered_customer_page": "customer_search_page",
    "tile_index_z5_z12": "tile_index",
    "dashboard_summary": "dashboard_summary",
    "account_meters": "account_meters",
    "customer_map_view": "customer_map_view",
    "streaming_summary_available_now": "stream_meter_summary",
}


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _refresh(spark, sf: str) -> tuple[float, float]:
    root = f"{checkpoint_dir(spark).rstrip('/')}/bench-refresh-{uuid.uuid4().hex[:8]}"
    cust, ev = fixtures.customers(spark, sf), fixtures.tamper_events(spark, sf)
    r = Refresh(spark, root, run_id="bench")
    t0 = time.perf_counter()
    r.run(cust, ev, as_of=datetime(2024, 2, 1))
    fresh = time.perf_counter() - t0
    t0 = time.perf_counter()
    r.run(cust, ev, as_of=datetime(2024, 2, 1))
    return fresh, time.perf_counter() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          app="gridwatch-bench")
    for name in HEADLINE.values():                      # warm-up pass
        _run(catalog.QUERIES[name](spark, sf))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    samples: dict[str, list[float]] = {label: [] for label in HEADLINE}
    samples["full_refresh_fresh"], samples["full_refresh_resumed"] = [], []
    for _ in range(runs):
        for label, name in HEADLINE.items():
            t0 = time.perf_counter()
            _run(catalog.QUERIES[name](spark, sf))
            samples[label].append(time.perf_counter() - t0)
        fresh, resumed = _refresh(spark, sf)
        samples["full_refresh_fresh"].append(fresh)
        samples["full_refresh_resumed"].append(resumed)
    times = {label: round(statistics.median(v), 3) for label, v in samples.items()}
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
