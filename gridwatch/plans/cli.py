"""Command line for the operational jobs: load, refresh, reset, status,
load summary and table statistics.

    python -m gridwatch.plans.cli refresh --root DIR --customers PATH --events PATH [--run-id ID]
    python -m gridwatch.plans.cli load --root DIR --customers-csv PATH --events-csv PATH
    python -m gridwatch.plans.cli reset|status --root DIR [--run-id ID]
    python -m gridwatch.plans.cli summary --root DIR
    python -m gridwatch.plans.cli stats --table NAME=PATH [--table ...]

Inputs of ``refresh`` are Parquet; events may be month-partitioned.  The
session is the active one (``spark-submit``) or a local one.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from gridwatch.session import apply_defaults, checkpoint_dir


def _session() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return apply_defaults(active)
    from gridwatch.session import local_session
    return local_session()


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="gridwatch")
    sub = ap.add_subparsers(dest="cmd", required=True)
    for name in ("refresh", "load", "reset", "status", "summary"):
        p = sub.add_parser(name)
        p.add_argument("--root", required=True)
        p.add_argument("--run-id", default="default")
        if name == "refresh":
            p.add_argument("--customers", required=True)
            p.add_argument("--events", required=True)
        if name == "load":
            p.add_argument("--customers-csv", required=True)
            p.add_argument("--events-csv", required=True)
    st = sub.add_parser("stats")
    st.add_argument("--table", action="append", required=True, help="NAME=PATH")
    args = ap.parse_args(argv)

    spark = _session()
    checkpoint_dir(spark)
    from gridwatch.operators import reports
    from gridwatch.plans.refresh import Refresh, load_and_refresh
    from gridwatch.sources import readers

    if args.cmd == "refresh":
        r = Refresh(spark, args.root, args.run_id)
        r.run(spark.read.parquet(args.customers), readers.read_events(spark, args.events))
        r.status(final=True).show(truncate=False)
    elif args.cmd == "load":
        load_and_refresh(spark, args.customers_csv, args.events_csv, args.root, args.run_id)
        Refresh(spark, args.root, args.run_id).status(final=True).show(truncate=False)
    elif args.cmd == "reset":
        Refresh(spark, args.root, args.run_id).reset()
    elif args.cmd == "status":
        Refresh(spark, args.root, args.run_id).status().show(truncate=False)
    elif args.cmd == "summary":
        r = Refresh(spark, args.root, args.run_id)
        store = r.store
        events = store.read("tamper_events") if store.exists("tamper_events") else None
        if events is None:
            raise SystemExit("summary needs a root written by 'load' (it holds the events)")
        reports.load_summary(r.table("customers"), events, r.table("meter_summary")).show(truncate=False)
    elif args.cmd == "stats":
        tables = dict(t.split("=", 1) for t in args.table)
        reports.table_stats(spark, tables).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
