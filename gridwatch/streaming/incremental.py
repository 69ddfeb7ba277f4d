"""Incremental maintenance with Structured Streaming.

* ``meter_summary_stream`` — running count and latest event per meter
  (state: one row per meter; late events are handled by ``max_by``, no
  watermark needed).  Each micro-batch appends only the meters it touched,
  keyed by batch id (idempotent on replay); ``read_meter_state`` resolves
  the newest row per meter.
* ``coordinate_meter_stream`` — meters that have an event with both
  coordinates (the 'any' event flag).  Once true it stays true for an
  append-only source, so a streaming ``dropDuplicates`` (state: one key per
  meter) emits each meter once.
* ``event_count_stream`` — signed counts of events with coordinates per meter
  from records of event changes, so an update or delete needs no stored
  events.
* ``customer_flag_stream`` — stateless flags and geometry for a stream of
  customer changes, event flag looked up in a static table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from gridwatch.functions.geo import both_present
from gridwatch.operators import summaries as S
from gridwatch.operators.joins import left_join_nullable
from gridwatch.streaming.state_log import StateLog


def read_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int = 1000) -> DataFrame:
    """Parquet file source over the table at ``path``, a folder of part files,
    with an explicit schema; a micro-batch takes a bounded number of files."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path))


def meter_summary_stream(events: DataFrame, state_dir: str, checkpoint: str,
                         available_now: bool = True, compact_every: int = 100) -> StreamingQuery:
    """Start the per-meter aggregate; update mode into a batch-keyed log,
    folded into a new base version every ``compact_every`` micro-batches."""
    per_meter = S.events_per_meter(events)

    def sink(batch: DataFrame, batch_id: int) -> None:
        meter_state(batch.sparkSession, state_dir).append(batch, batch_id, compact_every)

    return _start(per_meter.writeStream.outputMode("update").foreachBatch(sink), checkpoint, available_now)


def _start(w: DataStreamWriter, checkpoint: str, available_now: bool) -> StreamingQuery:
    w = w.option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()


def _newest_per_meter(log: DataFrame) -> DataFrame:
    return (log.groupBy("meter_number")
            .agg(F.max_by(F.struct("_n", "_le"), "batch_id").alias("s"), F.max("batch_id").alias("batch_id"))
            .select("meter_number", "s._n", "s._le", "batch_id"))


def meter_state(spark: SparkSession, state_dir: str) -> StateLog:
    return StateLog(spark, state_dir, ["meter_number", "_n", "_le"], _newest_per_meter)


def _base_version(spark: SparkSession, state_dir: str) -> tuple[str | None, int]:
    """Newest compacted base (path, batch id) of a state log, if any."""
    return meter_state(spark, state_dir).base()


def read_meter_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """Newest row per meter (``events_per_meter`` shape): the compacted base,
    if any, plus the micro-batch outputs written after it."""
    return meter_state(spark, state_dir).read()


def compact_meter_state(spark: SparkSession, state_dir: str) -> str:
    """Fold the base and all later micro-batch outputs into a new base
    version (published only when written)."""
    return meter_state(spark, state_dir).compact()


def coordinate_meter_stream(events: DataFrame, out_dir: str, checkpoint: str,
                            available_now: bool = True) -> StreamingQuery:
    """Append each meter once, at its first event with both coordinates."""
    meters = (events.filter(both_present("latitude", "longitude"))
              .select(F.col("meter_number").alias("meternumber"))
              .dropDuplicates(["meternumber"]))
    return _start(meters.writeStream.outputMode("append").format("parquet").option("path", out_dir), checkpoint, available_now)


def flags_from_coordinate_meters(customers: DataFrame, coordinate_meters: DataFrame) -> DataFrame:
    """'any'-variant flags from the streamed meter set."""
    right = coordinate_meters.select(F.col("meternumber").alias("_f_key"), F.lit(True).alias("_f_ev"))
    spread = ["ecgkey"] if "ecgkey" in customers.columns else None
    j = left_join_nullable(customers, right, "meternumber", "_f_key", spread)
    own = both_present("latitude", "longitude")
    ev = F.coalesce(F.col("_f_ev"), F.lit(False))
    return (j.withColumns({"has_own_coordinates": own, "has_event_coordinates": ev,
                           "has_any_coordinates": own | ev}).drop("_f_key", "_f_ev"))


def flags_from_event_flags(customers: DataFrame, event_flags: DataFrame) -> DataFrame:
    """'any'-variant flags of customers from ``read_event_flags``: a meter
    whose last event with coordinates went is listed as false, and clears its
    customers' flag."""
    return flags_from_coordinate_meters(customers, event_flags.filter("has_event_coordinates").select("meternumber"))


def customer_flag_stream(customer_changes: DataFrame, coordinate_meters: DataFrame) -> DataFrame:
    """Flags + geometry for changed customer rows (stream-static join)."""
    return S.with_geom(flags_from_coordinate_meters(customer_changes, coordinate_meters))


def recompute_meters(events: DataFrame, touched: DataFrame) -> DataFrame:
    """For deletes/updates: the 'any' flag of the touched meters recomputed
    from the stored events (a semi join restricts the scan to those meters)."""
    t = touched.select(F.col("meternumber").alias("_t")).distinct()
    ev = events.join(t, events["meter_number"] == t["_t"], "left_semi")
    has = (ev.groupBy("meter_number")
           .agg(F.bool_or(both_present("latitude", "longitude")).alias("has_event_coordinates")))
    return (t.join(has, t["_t"] == has["meter_number"], "left")
            .select(F.col("_t").alias("meternumber"),
                    F.coalesce("has_event_coordinates", F.lit(False)).alias("has_event_coordinates")))


def event_change_flag_stream(changes: DataFrame, events_path: str, state_dir: str, checkpoint: str,
                             available_now: bool = True, compact_every: int = 100) -> StreamingQuery:
    """Any-event coordinate flags under inserts, updates and deletes of events,
    for a feed that names only the touched meters.

    ``changes`` carries ``meter_number`` (one row per changed event);
    ``events_path`` holds the stored events after those changes.  Each
    micro-batch recomputes the flag of the touched meters from the stored
    events and writes it to a log; ``read_event_flags`` resolves the newest
    value per meter.  A feed that carries the events' values needs no stored
    events: ``event_count_stream``.
    """
    from gridwatch.sources.readers import read_events

    def sink(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select(F.col("meter_number").alias("meternumber")).distinct()
        stored = read_events(batch.sparkSession, events_path)
        event_flags(batch.sparkSession, state_dir).append(recompute_meters(stored, touched), batch_id, compact_every)

    return _start(changes.writeStream.foreachBatch(sink), checkpoint, available_now)


def _newest_flags(log: DataFrame) -> DataFrame:
    return log.groupBy("meternumber").agg(F.max_by("has_event_coordinates", "batch_id").alias("has_event_coordinates"),
                                          F.max("batch_id").alias("batch_id"))


def event_flags(spark: SparkSession, state_dir: str) -> StateLog:
    return StateLog(spark, state_dir, ["meternumber", "has_event_coordinates"], _newest_flags)


def read_event_flags(spark: SparkSession, state_dir: str) -> DataFrame:
    """Newest any-event flag per meter from ``event_change_flag_stream``."""
    return event_flags(spark, state_dir).read()


# ── signed counters: no stored events are read ─────────────────────────────

#: What a change record holds: the event before (null for an insert) and after
#: the change (null for a delete).
CHANGE_COLUMNS = ["old_meter_number", "old_latitude", "old_longitude", "meter_number", "latitude", "longitude"]


def coordinate_deltas(changes: DataFrame) -> DataFrame:
    """``(meternumber, delta)`` of change records: an event with both
    coordinates counts 1 for its meter, and -1 for the meter that it had
    before the change.  A change of nothing that counts gives no row; events
    without a meter count for none."""
    def image(prefix: str, sign: int) -> Column:
        counts = both_present(f"{prefix}latitude", f"{prefix}longitude") & F.col(f"{prefix}meter_number").isNotNull()
        return F.struct(F.col(f"{prefix}meter_number").alias("meternumber"), F.when(counts, sign).otherwise(0).alias("delta"))

    return (changes.select(F.inline(F.array(image("old_", -1), image("", 1)))).where("meternumber is not null")
            .groupBy("meternumber").agg(F.sum("delta").alias("delta")))


def _summed(log: DataFrame) -> DataFrame:
    return log.groupBy("meternumber").agg(F.sum("delta").alias("delta"), F.max("batch_id").alias("batch_id"))


def event_counts(spark: SparkSession, state_dir: str) -> StateLog:
    """Events with both coordinates per meter, as signed sums per batch."""
    return StateLog(spark, state_dir, ["meternumber", "delta"], _summed)


def seed_event_counts(spark: SparkSession, events: DataFrame, state_dir: str, batch_id: int = -1) -> str:
    """Start the counters from stored events: the state before the first
    change, or, at a known batch, a fresh count that replaces the log so far."""
    counts = events.where(F.col("meter_number").isNotNull()).groupBy(F.col("meter_number").alias("meternumber")).agg(
        F.count_if(both_present("latitude", "longitude")).alias("delta"))
    return event_counts(spark, state_dir).seed(counts, batch_id)


def event_count_stream(changes: DataFrame, state_dir: str, checkpoint: str, available_now: bool = True,
                       compact_every: int = 100) -> StreamingQuery:
    """Any-event coordinate flags under inserts, updates and deletes of events,
    for a feed with the values before and after each change (``CHANGE_COLUMNS``).

    A micro-batch reads its own records only: it adds up signed counts per
    meter and writes the meters it touched.  Sums are taken once per record;
    a batch that runs again replaces its own rows.  A feed that may repeat a
    record across batches must drop repeats first.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        event_counts(batch.sparkSession, state_dir).append(coordinate_deltas(batch), batch_id, compact_every)

    return _start(changes.writeStream.foreachBatch(sink), checkpoint, available_now)


def read_counted_flags(spark: SparkSession, state_dir: str) -> DataFrame:
    """``(meternumber, has_event_coordinates)`` from ``event_count_stream``;
    a meter whose last event with coordinates went is listed as false."""
    return event_counts(spark, state_dir).read().select("meternumber", (F.col("delta") > 0).alias("has_event_coordinates"))
