"""Resumable refresh: meter summary → coordinate flags → geometry →
district summary.

Each step reads the previous step's *published snapshot* (so lineage is cut
at every step and a lost executor only re-runs the current step), writes a
new snapshot version and then records completion in an append-only
checkpoint log.  A completed step is skipped on the next run with the same
``run_id`` until ``reset`` is called; a failed step records its error.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwatch.operators import reports
from gridwatch.operators import summaries as S
from gridwatch.plans.month_partials import MonthPartials
from gridwatch.sources.sinks import SnapshotStore, merge_by_key, merge_sticky, read_json_log, rows_frame


def _now() -> datetime:
    return datetime.now(timezone.utc)

STEPS = reports.STEPS
# District columns an update does not overwrite, and columns
# outside the insert list.
STICKY_DISTRICT = ["districtname", "regioncode", "regionname"]
UNTOUCHED_DISTRICT = ["prepaid_meters", "postpaid_meters", "active_contracts"]

_LOG_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("step", T.StringType()),
    T.StructField("completed", T.BooleanType()), T.StructField("started_at", T.TimestampType()),
    T.StructField("finished_at", T.TimestampType()), T.StructField("error_msg", T.StringType()),
    T.StructField("seq", T.LongType())])


class Refresh:
    """The pipeline over a snapshot root (a shared folder on a cluster)."""

    def __init__(self, spark: SparkSession, root: str, run_id: str = "default", merge: bool = True):
        self.spark, self.root, self.run_id, self.merge = spark, root.rstrip("/"), run_id, merge
        self.store = SnapshotStore(spark, self.root)
        self.partials = MonthPartials(spark, f"{self.root}/meter_months")
        #: Month folders that the last meter summary step over stored events read.
        self.months_read: list[str] = []
        self.log_path = f"{self.root}/_checkpoint"

    # ── checkpoint log ───────────────────────────────────────────────────────
    def _append(self, rows: list[tuple]) -> None:
        rows_frame(self.spark, _LOG_SCHEMA, rows).write.mode("append").json(self.log_path)

    def _log(self) -> DataFrame | None:
        return read_json_log(self.spark, _LOG_SCHEMA, self.log_path)

    def checkpoints(self) -> DataFrame:
        """Current state: the newest log row per step of this run; steps the
        run never logged are pending (insert-if-absent, resolved on read)."""
        steps = rows_frame(self.spark, _LOG_SCHEMA,
                           [(self.run_id, s, False, None, None, None, -1) for s in STEPS])
        log = self._log()
        log = steps if log is None else log.filter(F.col("run_id") == self.run_id).unionByName(steps)
        latest = (log.groupBy("run_id", "step")
                  .agg(F.max_by(F.struct("completed", "started_at", "finished_at", "error_msg"),
                                "seq").alias("s")))
        return latest.select("run_id", "step", "s.*")

    def _state(self) -> dict[str, dict]:
        # at most one row per step (4 rows): bounded
        return {r["step"]: r.asDict() for r in self.checkpoints().collect()}

    def register_steps(self) -> None:
        """Write a pending row for steps this run has not logged yet (do-nothing
        on conflict).  ``checkpoints`` already treats unlogged steps as pending,
        so ``run`` does not need this."""
        log = self._log()
        seen = set() if log is None else {r["step"] for r in log.filter(
            F.col("run_id") == self.run_id).select("step").distinct().collect()}
        missing = [s for s in STEPS if s not in seen]
        if missing:
            base = _now().timestamp()
            self._append([(self.run_id, s, False, None, None, None, int(base * 1e6) + i)
                          for i, s in enumerate(missing)])

    def reset(self) -> None:
        """Force a re-run: clear completion, finish time and error; keep start time."""
        state = self._state()
        seq = int(_now().timestamp() * 1e6)
        self._append([(self.run_id, s, False, (state.get(s) or {}).get("started_at"), None, None, seq + i)
                      for i, s in enumerate(STEPS)])

    def status(self, final: bool = False) -> DataFrame:
        return reports.pipeline_status(self.checkpoints(), final=final)

    # ── steps ────────────────────────────────────────────────────────────────
    def _step_meter_summary(self, customers: DataFrame, events: DataFrame | str, as_of: datetime) -> DataFrame:
        if isinstance(events, str):
            self.months_read = self.partials.update(events)
            new = S.finish_meter_summary(self.partials.per_meter(), customers, as_of=as_of)
        else:
            new = S.meter_summary(events, customers, as_of=as_of)
        if self.merge and self.store.exists("meter_summary"):
            return merge_by_key(self.store.read("meter_summary"), new, ["meternumber"])
        return new

    def _step_flags(self, customers: DataFrame, events: DataFrame | str, as_of: datetime) -> DataFrame:
        # flags and geometry are columns of the same wide rows: written once,
        # the geometry step publishes this snapshot as ``customers``
        return S.with_geom(S.with_coordinate_flags(customers, self.store.read("meter_summary"), "latest"))

    def _step_geom(self, customers: DataFrame, events: DataFrame | str, as_of: datetime) -> str:
        return self.store.current("customers_flagged")

    def _step_district(self, customers: DataFrame, events: DataFrame | str, as_of: datetime) -> DataFrame:
        new = S.district_event_summary(self.store.read("customers"), self.store.read("meter_summary"),
                                       as_of=as_of)
        if self.merge and self.store.exists("district_event_summary"):
            return merge_sticky(self.store.read("district_event_summary"), new, ["districtcode"],
                                sticky=STICKY_DISTRICT, untouched=UNTOUCHED_DISTRICT,
                                defaults={c: 0 for c in UNTOUCHED_DISTRICT}, as_of=as_of)
        return new

    def run(self, customers: DataFrame, events: DataFrame | str, as_of: datetime | None = None) -> dict[str, str]:
        """Run pending steps in order; returns the published snapshot paths.

        ``events``: a relation, read whole, or the folder of events stored by
        month: then the per-meter totals of every month are kept under the
        root, and a run reads only months whose files are new or changed."""
        as_of = as_of or _now()
        plan: list[tuple[str, str, Callable]] = [
            ("meter_summary", "meter_summary", self._step_meter_summary),
            ("coordinate_flags", "customers_flagged", self._step_flags),
            ("geom", "customers", self._step_geom),
            ("district_summary", "district_event_summary", self._step_district),
        ]
        state = self._state()
        for i, (step, output, fn) in enumerate(plan):
            done = (state.get(step) or {}).get("completed") and self.store.exists(output)
            if done:
                continue
            seq = int(_now().timestamp() * 1e6) + 10 * i
            started = _now()
            try:
                made = fn(customers, events, as_of)
                if isinstance(made, str):
                    self.store.publish(output, made)
                else:
                    self.store.write(output, made)
            except Exception as exc:
                msg = "".join(traceback.format_exception_only(type(exc), exc)).strip()
                self._append([(self.run_id, step, False, started, None, msg, seq + 1)])
                raise
            # one log row per outcome: the snapshot is published before the
            # step is marked done, so a crash in between only re-runs the step
            self._append([(self.run_id, step, True, started, _now(), None, seq + 2)])
        return {name: self.store.current(name) for name in
                ("meter_summary", "customers_flagged", "customers", "district_event_summary")}

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)


def backfill_any_flags(customers: DataFrame, events: DataFrame) -> DataFrame:
    """One-off flag back-fill: event flag = *any* event of the meter has both
    coordinates."""
    return S.with_coordinate_flags(customers, variant="any", events=events)


def load_and_refresh(spark: SparkSession, customers_csv: str, events_csv: str, root: str,
                     run_id: str = "default", as_of: datetime | None = None,
                     max_rejects: int | None = None) -> dict[str, str]:
    """CSV load (customers, month-partitioned events) then the refresh.

    Rows that can't be loaded are published as ``rejects`` (source, record,
    reason) before anything else happens; more than ``max_rejects`` of them
    (None: any number) stop the load with an error.
    """
    from gridwatch.sources import readers
    store = SnapshotStore(spark, root)
    staged = {"customer_records": customers_csv, "tamper_events": events_csv}
    staged = {name: readers.stage_csv(spark, path, store, name) for name, path in staged.items()}
    rejects = store.write("rejects", readers.staged_rejects(spark, staged["customer_records"], "customers").unionByName(
        readers.staged_rejects(spark, staged["tamper_events"], "events")))
    if max_rejects is not None and (n := spark.read.parquet(rejects).count()) > max_rejects:
        raise ValueError(f"{n} rows can't be loaded, {max_rejects} allowed; see {rejects}")
    customers, events = (store.publish(name, f"{path}/rejected=false") for name, path in staged.items())
    paths = Refresh(spark, root, run_id).run(spark.read.parquet(customers).drop("reason", "record"), events, as_of)
    return paths | {"rejects": rejects}
