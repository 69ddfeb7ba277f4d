"""Registered queries: each builds a DataFrame over a scale-factor folder.

Every query reads the driver's tables (through the fixture projections) in
full; parameters that select one account, meter, page or tile are part of
the operator being exercised, not a way to shrink the input.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwatch.functions.params import CustomerFilter, EventFilter, parse_query_time
from gridwatch.operators import customers as C
from gridwatch.operators import dashboards as D
from gridwatch.operators import joins as J
from gridwatch.operators import reports as R
from gridwatch.operators import spatial as K
from gridwatch.operators import summaries as S
from gridwatch.sources import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the registered queries.
SEARCH = "customer#0000"
EVENT_METER = "42"
EVENT_ACCOUNT = "705000000"
LOOKUP_METER = "12"
EVENT_FILTER = EventFilter(event_desc="stdevt:", from_=parse_query_time("2024-01-05T00:00:00Z"),
                           to=parse_query_time("2024-01-20"))
AS_OF = datetime(2024, 2, 1, 6, 30)
AFTER = ("Customer#000000400", "000000450")
BBOX = (-2.0, 5.0, 0.5, 8.0)
TILE = (7, 63, 61)
CUSTOMER_TILE = (7, 64, 60)
DISTRICT_TILE = (2, 1, 1)


_BASE_CACHE: dict[tuple[int, str, str], tuple[DataFrame, DataFrame]] = {}


def _base(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The two fixture relations; built (and analysed) once per session and
    folder, since DataFrames are immutable plans and can be shared."""
    key = (id(spark), spark.conf.get("spark.app.id", ""), sf)
    if key not in _BASE_CACHE:
        _BASE_CACHE[key] = (X.customers(spark, sf), X.tamper_events(spark, sf))
    return _BASE_CACHE[key]


def _ms(spark: SparkSession, sf: str) -> DataFrame:
    cust, ev = _base(spark, sf)
    return S.meter_summary(ev, cust)


def _enriched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """customers with flags ('latest') and geometry, events, meter summary."""
    cust, ev = _base(spark, sf)
    ms = S.meter_summary(ev, cust)
    enriched = S.with_geom(S.with_coordinate_flags(cust, ms, "latest"))
    return enriched, ev, ms


def _cust_ms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """customers (flags and geometry derived inside each summary's single
    meter-summary join), events, meter summary."""
    cust, ev = _base(spark, sf)
    return cust, ev, S.meter_summary(ev, cust)


def _des(spark: SparkSession, sf: str, service_mix: bool = False) -> DataFrame:
    cust, _, ms = _cust_ms(spark, sf)
    return S.district_event_summary(cust, ms, service_mix=service_mix)


def _round_geom(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({"geom_x": F.round("geom_x", digits), "geom_y": F.round("geom_y", digits)})


def customers_latest_event(spark, sf):
    cust, ev = _base(spark, sf)
    return C.flatten_dto(C.customer_dto(J.with_latest_event(cust, ev)))


def latest_event_per_meter(spark, sf):
    _, ev = _base(spark, sf)
    return J.latest_event_per_meter(ev, method="row_number")


def meter_summary(spark, sf):
    return _ms(spark, sf)


def meter_event_counts(spark, sf):
    _, ev = _base(spark, sf)
    return S.meter_event_counts(ev).withColumnRenamed("meter_number", "meternumber")


def coordinate_flags_latest(spark, sf):
    cust, ev = _base(spark, sf)
    return S.with_coordinate_flags(cust, S.meter_summary(ev, cust), "latest").select(
        "ecgkey", "meternumber", "has_own_coordinates", "has_event_coordinates", "has_any_coordinates")


def coordinate_flags_any(spark, sf):
    cust, ev = _base(spark, sf)
    return S.with_coordinate_flags(cust, variant="any", events=ev).select(
        "ecgkey", "meternumber", "has_own_coordinates", "has_event_coordinates", "has_any_coordinates")


def customers_geom(spark, sf):
    cust, _ = _base(spark, sf)
    return S.with_geom(cust).select("ecgkey", "geom_x", "geom_y")


def customers_with_events(spark, sf):
    cust, ev = _base(spark, sf)
    return S.customers_with_events(cust, S.event_meters(ev)).select("ecgkey", "meternumber")


def customers_without_events(spark, sf):
    cust, ev = _base(spark, sf)
    return S.customers_without_events(cust, S.event_meters(ev)).select("ecgkey", "meternumber")


def event_coordinate_meters(spark, sf):
    _, ev = _base(spark, sf)
    return S.event_coordinate_meters(ev)


def district_event_summary(spark, sf):
    return _round_geom(_des(spark, sf))


def district_service_mix(spark, sf):
    cust, _ = _base(spark, sf)
    return S.district_service_mix(cust)


def dashboard_summary(spark, sf):
    return D.dashboard_summary(_des(spark, sf))


def dashboard_last_refreshed(spark, sf):
    """National totals of a refreshed snapshot, with the time of the refresh."""
    cust, _, ms = _cust_ms(spark, sf)
    out = D.dashboard_summary(S.district_event_summary(cust, ms, as_of=AS_OF))
    return out.select("total_meters", "total_events", F.col("last_refreshed").cast("timestamp_ntz").alias("last_refreshed"))


def dashboard_regions(spark, sf):
    return D.dashboard_regions(_des(spark, sf))


def dashboard_districts(spark, sf):
    return D.dashboard_districts(_des(spark, sf))


def dashboard_districts_region(spark, sf):
    return D.dashboard_districts(_des(spark, sf), region_code="02")


def account_meters(spark, sf):
    cust, _, ms = _cust_ms(spark, sf)
    return D.account_meters(cust, ms)


def account_meters_of(spark, sf):
    """One account's groups with the list of meters."""
    cust, _, ms = _cust_ms(spark, sf)
    out = D.account_meters(cust, ms, account=EVENT_ACCOUNT)
    return out.withColumn("meters", F.array_join("meters", ",", "NULL"))


def account_meter_list(spark, sf):
    cust, _ = _base(spark, sf)
    return D.account_meter_list(cust)


def customer_map_view(spark, sf):
    cust, _, ms = _cust_ms(spark, sf)
    return K.customer_map_view(cust, ms)


def map_layer(spark, sf):
    return K.map_layer(customer_map_view(spark, sf))


def district_layer(spark, sf):
    return _round_geom(K.district_layer(_des(spark, sf)))


def _stored_layer(spark: SparkSession, layer: DataFrame, tie_break: str = "ecgkey") -> DataFrame:
    """The layer as a viewer reads it: stored clustered by tile, so that a box
    reaches the scan."""
    path = _scratch(spark, "layer")
    K.write_spatial_layer(layer, path, tie_break=tie_break)
    return spark.read.parquet(path).drop("cluster_x", "cluster_y")


def bbox_customers(spark, sf):
    stored = _stored_layer(spark, K.map_layer(customer_map_view(spark, sf)))
    return K.in_bbox(stored, *BBOX).select("ecgkey", "geom_x", "geom_y")


def bbox_customers_curve(spark, sf):
    """The box read from a layer stored along a curve: its manifest names the
    files that are opened."""
    from gridwatch.operators import curve
    path = _scratch(spark, "curve")
    curve.write_curve_layer(K.map_layer(customer_map_view(spark, sf)), path)
    return curve.read_box(spark, path, *BBOX).select("ecgkey", "geom_x", "geom_y")


def tile_features(spark, sf):
    layers = {"customer_map_view": _stored_layer(spark, K.map_layer(customer_map_view(spark, sf)))}
    return K.tile_of_source("customer_map_view", layers, *TILE)


def tile_features_customers(spark, sf):
    cust, _ = _base(spark, sf)
    records = S.with_geom(cust).select("ecgkey", "meternumber", "geom_x", "geom_y")
    layers = {"CustomerRecords": _stored_layer(spark, records)}
    return K.tile_of_source("CustomerRecords", layers, *CUSTOMER_TILE)


def tile_features_districts(spark, sf):
    layers = {"district_event_summary": _stored_layer(spark, K.district_layer(_des(spark, sf)), "districtcode")}
    return _round_geom(K.tile_of_source("district_event_summary", layers, *DISTRICT_TILE))


def tile_index(spark, sf):
    return K.tile_index(customer_map_view(spark, sf), 5, 12, weight="event_count")


def tile_leaves(spark, sf):
    """Every feature of the map view in the tile that shows it: tiles of more
    than 40 features are split."""
    return K.tile_leaves(customer_map_view(spark, sf), zmin=5, zmax=12, most=40)


def distinct_meters(spark, sf):
    """True distinct meters of districts, regions and the nation from bitmaps,
    beside the sums of district counts."""
    from gridwatch.operators.distinct import distinct_meters as distinct
    return distinct(_base(spark, sf)[0])


def customer_search_page(spark, sf):
    cust, ev = _base(spark, sf)
    f = CustomerFilter(search=SEARCH, page=2, page_size=20)
    return C.flatten_dto(C.customer_page(cust, ev, f))


def customers_filtered(spark, sf):
    cust, ev = _base(spark, sf)
    f = CustomerFilter(region_name="a", service_type="Prepaid", meter_make="am",
                       contract_status="Active", cms_contract_status="Live",
                       customer_type="Domestic", account_type="Private", has_tamper=True)
    return C.filter_customers(cust, f, S.event_meters(ev)).select("ecgkey", "fullname", "meternumber", "regionname")


def customers_by_codes(spark, sf):
    cust, _ = _base(spark, sf)
    f = CustomerFilter(region_code="02", district_code="02-12", service_class="NonResidential", meter_model="e65")
    return C.filter_customers(cust, f).select("ecgkey", "meternumber", "regioncode", "districtcode", "metermodel")


def customers_by_service_point(spark, sf):
    cust, _ = _base(spark, sf)
    return C.filter_customers(cust, CustomerFilter(service_point_number="SPN-0000077")).select("ecgkey", "servicepointnumber")


def customer_page_clamped(spark, sf):
    """Page 0 of 10,000 rows, a search with blanks around: the first page of
    the largest size."""
    cust, _ = _base(spark, sf)
    f = CustomerFilter(search="  customer#00 ", page=0, page_size=10_000)
    return C.page_rows(cust, f).select("ecgkey", "fullname")


def customers_after(spark, sf):
    """The 50 customers that follow one in the name order."""
    cust, _ = _base(spark, sf)
    name, key = AFTER
    return C.customers_after(cust, CustomerFilter(), name, key).select("ecgkey", "fullname")


def customers_deep_page(spark, sf):
    """A page found by counted ranges, not by a top-K of all rows before it."""
    cust, _ = _base(spark, sf)
    keys = cust.select("fullname", "ecgkey")
    return C.page_rows(keys, CustomerFilter(page=7, page_size=100), shallow=0).select("ecgkey", "fullname")


def _indexed(spark: SparkSession, sf: str) -> str:
    from gridwatch.operators.search_index import write_indexed_customers
    path = _scratch(spark, "indexed")
    write_indexed_customers(_base(spark, sf)[0], path)
    return path


def customers_stored_page(spark, sf):
    """The same page from a snapshot in name order: its ranks name the files."""
    from gridwatch.operators.search_index import stored_page
    return stored_page(spark, _indexed(spark, sf), 7, 100).select("ecgkey", "fullname")


def customer_search_indexed(spark, sf):
    """The searched page from a stored snapshot: trigrams name the files that
    may hold a match."""
    from gridwatch.operators.search_index import search_customers
    cust, ev = _base(spark, sf)
    f = CustomerFilter(search=SEARCH, page=2, page_size=20)
    found = search_customers(spark, _indexed(spark, sf), f)
    return C.flatten_dto(C.customer_page(found, ev, f))


def customers_count(spark, sf):
    cust, _, ms = _enriched(spark, sf)
    return C.count_customers(cust, CustomerFilter(district_name="an", has_coordinates=True), ms)


def customers_no_coordinates(spark, sf):
    cust, ev, ms = _enriched(spark, sf)
    f = CustomerFilter(no_coordinates=True, page=1, page_size=200)
    return C.flatten_dto(C.customer_page(cust, ev, f, ms))


def events_by_meter_page(spark, sf):
    _, ev = _base(spark, sf)
    return C.event_page(ev, EVENT_METER, EventFilter(event_desc=EVENT_FILTER.event_desc,
                                                     from_=EVENT_FILTER.from_, to=EVENT_FILTER.to,
                                                     page=1, page_size=25))


def events_count(spark, sf):
    _, ev = _base(spark, sf)
    return C.count_events(ev, EVENT_METER, EVENT_FILTER)


def events_by_account(spark, sf):
    cust, ev = _base(spark, sf)
    return C.events_by_account(cust, ev, EVENT_ACCOUNT, EventFilter(page=1, page_size=500))


def events_filtered(spark, sf):
    _, ev = _base(spark, sf)
    f = EventFilter(event_code="3.26.38.98", from_=parse_query_time("2024-01-10T12:00:00+02:00"),
                    to=parse_query_time("2024-01-25"))
    return C.event_rows(C.filter_events(ev, f))


def customer_by_account(spark, sf):
    cust, ev = _base(spark, sf)
    return C.flatten_dto(C.customer_by_account(cust, ev, EVENT_ACCOUNT))


def customer_by_meter(spark, sf):
    cust, ev = _base(spark, sf)
    return C.flatten_dto(C.customer_by_meter(cust, ev, LOOKUP_METER))


def load_summary(spark, sf):
    cust, ev, ms = _enriched(spark, sf)
    return R.load_summary(cust, ev, ms)


def load_counts(spark, sf):
    cust, ev, ms = _enriched(spark, sf)
    return R.load_counts(cust, ev, ms)


def table_stats(spark, sf):
    return R.table_stats(spark, {t: f"{sf}/{t}.parquet" for t in ("customer", "events", "nation", "region")})


# ── ingest typing, months, lock-outs, merges, pipeline, streams ──────────────

def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    import uuid

    from gridwatch.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/gridwatch/{name}-{uuid.uuid4().hex[:12]}"


# Dirty boolean spellings cycled through by the typing query.
DIRTY_BOOL = ["", " ", "abc", "1", "t", "true", "TRUE"]


def coerced_customers(spark, sf):
    from gridwatch.sources.readers import typed_customers
    cust, _ = _base(spark, sf)
    k = F.col("ecgkey").cast("long")
    dirty = F.element_at(F.array(*[F.lit(v) for v in DIRTY_BOOL]), (k % 7 + 1).cast("int"))
    text = cust.select(
        "ecgkey", F.coalesce("meternumber", F.lit("")).alias("meternumber"),
        F.col("latitude").cast("string").alias("latitude"),
        F.col("currentbalance").cast("string").alias("currentbalance"),
        F.col("lastpaymentdate").cast("string").alias("lastpaymentdate"),
        dirty.alias("isamr"),
        F.when(k % 5 == 0, F.lit("n/a")).otherwise((k * 10).cast("string")).alias("lastreadingvalue"))
    typed = typed_customers(text, api=True)
    return typed.select("ecgkey", "meternumber", "latitude",
                        F.col("currentbalance").cast("double").alias("currentbalance"),
                        "lastpaymentdate", "isamr", "lastreadingvalue")


def parsed_timestamps(spark, sf):
    from gridwatch.functions.coerce import parse_timestamp
    _, ev = _base(spark, sf)
    m = F.col("event_id") % 8
    t = F.col("event_time")
    text = (F.when(m == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
            .when(m == 1, F.date_format(t + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'"))
            .when(m == 2, F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
            .when(m == 3, F.date_format(t, "yyyy-MM-dd"))
            .when(m == 4, F.lit("2026")).when(m == 5, F.lit("garbage")).when(m == 6, F.lit(""))
            .otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return ev.select("event_id", text.alias("text")).select(
        "event_id", "text", parse_timestamp("text").cast("timestamp_ntz").alias("parsed"))


def events_by_month(spark, sf):
    from gridwatch.sources.readers import events_by_month as by_month
    _, ev = _base(spark, sf)
    return by_month(ev).select(F.date_format("month", "yyyy-MM").alias("month"), "events", "meters")


def events_month_pruned(spark, sf):
    """Events stored by month, read back with a time range: the month
    predicate prunes partitions before the scan."""
    from gridwatch.sources.readers import read_events, write_events
    _, ev = _base(spark, sf)
    path = _scratch(spark, "events_by_month")
    write_events(ev, path)
    stored = read_events(spark, path)
    f = EventFilter(from_=parse_query_time("2024-01-10"), to=parse_query_time("2024-01-20T12:00:00Z"))
    return C.event_rows(C.filter_events(stored, f))


# Lock-out parameters for the registered query: a 3-day window so that the
# driver's event density (a few attempts per user per day) reaches the limit.
LOCKOUT_WINDOW_DAYS = 3
LOCKOUT_MAX = 5


def attempt_lockouts(spark, sf):
    from datetime import timedelta

    from gridwatch.operators.lockouts import attempt_lockouts as lockouts
    from gridwatch.operators.lockouts import attempts_from_events
    events = spark.read.parquet(f"{sf}/events.parquet")
    out = lockouts(attempts_from_events(events), timedelta(days=LOCKOUT_WINDOW_DAYS), LOCKOUT_MAX)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def merge_meter_summary(spark, sf):
    """Snapshot from the first half of January, then an upsert with a summary
    of the second half: meters absent from the second half are kept."""
    from gridwatch.sources.sinks import merge_by_key
    cust, ev = _base(spark, sf)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    old = S.meter_summary(ev.filter(F.col("event_time") < cut), cust)
    new = S.meter_summary(ev.filter(F.col("event_time") >= cut), cust)
    return merge_by_key(old, new, ["meternumber"])


def merge_meter_buckets(spark, sf):
    """The same upsert on a snapshot in hash buckets: buckets without a changed
    meter are carried over."""
    from gridwatch.sources.buckets import BucketedSnapshot
    cust, ev = _base(spark, sf)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    snap = BucketedSnapshot(spark, _scratch(spark, "buckets"), "meter_summary", "meternumber", buckets=16)
    snap.merge(S.meter_summary(ev.filter(F.col("event_time") < cut), cust))
    snap.merge(S.meter_summary(ev.filter(F.col("event_time") >= cut), cust))
    return snap.read()


def merge_district_sticky(spark, sf):
    """A district snapshot from the first load (events of the first half of
    January, names lower-cased, service counters filled) upserted with the
    summary of the full data: names and region stay as first inserted,
    counters move, the columns outside the insert list keep their values."""
    from gridwatch.plans.refresh import STICKY_DISTRICT, UNTOUCHED_DISTRICT
    from gridwatch.sources.sinks import merge_sticky
    cust, ev = _base(spark, sf)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    first_ms = S.meter_summary(ev.filter(F.col("event_time") < cut), cust)
    old = (S.district_event_summary(cust, first_ms, service_mix=True)
           .withColumn("districtname", F.lower("districtname")))
    new = S.district_event_summary(cust, S.meter_summary(ev, cust))
    out = merge_sticky(old, new, ["districtcode"], sticky=STICKY_DISTRICT,
                       untouched=UNTOUCHED_DISTRICT, defaults={c: 0 for c in UNTOUCHED_DISTRICT})
    return _round_geom(out)


def refresh_pipeline(spark, sf):
    """The four-step refresh into a fresh snapshot root; returns the
    published district summary."""
    from gridwatch.plans.refresh import Refresh
    cust, ev = _base(spark, sf)
    r = Refresh(spark, _scratch(spark, "refresh"), run_id="catalog")
    r.run(cust, ev, as_of=AS_OF)
    return _round_geom(r.table("district_event_summary")).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


def refresh_rerun(spark, sf):
    """Run, reset, run again on later events: meters of the first run stay,
    and the flags and geometry of the published customers follow."""
    from gridwatch.plans.refresh import Refresh
    cust, ev = _base(spark, sf)
    r = Refresh(spark, _scratch(spark, "refresh"), run_id="catalog")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    r.run(cust, ev.filter(F.col("event_time") < cut), as_of=AS_OF)
    r.reset()
    r.run(cust, ev.filter(F.col("event_time") >= cut), as_of=AS_OF)
    return r.table("customers").select("ecgkey", "meternumber", "has_own_coordinates", "has_event_coordinates",
                                       "has_any_coordinates", "geom_x", "geom_y")


def refresh_by_month(spark, sf):
    """Events of three months stored by month and refreshed; then a third month
    and some rows of the second arrive, and the next run reads these two only.
    The published meter summary, with the number of months that run read."""
    from gridwatch.plans.refresh import Refresh
    from gridwatch.sources.readers import write_events
    cust, ev = _base(spark, sf)
    root = _scratch(spark, "refresh_months")
    k = F.col("event_id")
    spread = ev.withColumn("event_time", F.expr("event_time + make_interval(0, cast(event_id % 3 as int))"))
    late = (k % 3 == 2) | (k % 30 == 1)
    write_events(spread.filter(~late), f"{root}/events")
    Refresh(spark, f"{root}/out", run_id="first").run(cust, f"{root}/events", as_of=AS_OF)
    write_events(spread.filter(late), f"{root}/events", mode="append")
    r = Refresh(spark, f"{root}/out", run_id="second")
    r.run(cust, f"{root}/events", as_of=AS_OF)
    return r.table("meter_summary").drop("updated_at").withColumn("months_read", F.lit(len(r.months_read)))


def pipeline_status(spark, sf):
    from gridwatch.plans.refresh import Refresh
    cust, ev = _base(spark, sf)
    r = Refresh(spark, _scratch(spark, "refresh"), run_id="catalog")
    r.run(cust, ev, as_of=AS_OF)
    return r.status(final=True).drop("finished_at")


class _Interrupted(Exception):
    pass


def refresh_resumed(spark, sf):
    """A refresh that stops in its third step, and the run that resumes it: the
    steps' states after each, with the rows of the snapshots they published."""
    from gridwatch.plans import refresh as P

    class Stopping(P.Refresh):
        def _step_geom(self, *a):
            raise _Interrupted("stopped for maintenance")

    cust, ev = _base(spark, sf)
    root = _scratch(spark, "refresh")
    outputs = dict(zip(P.STEPS, ("meter_summary", "customers_flagged", "customers", "district_event_summary"), strict=True))
    rows = []
    for phase, kind in (("stopped", Stopping), ("resumed", P.Refresh)):
        run = kind(spark, root, run_id="catalog")
        try:
            run.run(cust, ev, as_of=AS_OF)
        except _Interrupted:
            pass
        # four control rows, as they are now: the log is a folder that grows
        for r in run.checkpoints().collect():
            made = run.table(outputs[r["step"]]).count() if run.store.exists(outputs[r["step"]]) else None
            rows.append((phase, r["step"], bool(r["completed"]), r["error_msg"] is not None, made))
    return spark.createDataFrame(rows, "phase string, step string, completed boolean, failed boolean, rows long")


# Slices in which the stream queries receive their table.
STREAM_SLICES = 3


def _arrivals(spark: SparkSession, sf: str, table: str, order: str, root: str):
    """The table as a folder that fills up slice by slice (ascending
    ``order``); yields after each arrival, so a stream over the folder runs
    several times and carries its state and its place from run to run."""
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    key = F.unix_micros(F.col(order).cast("timestamp")) if dict(df.dtypes)[order].startswith("timestamp") else F.col(order)
    marks = [k / STREAM_SLICES for k in range(1, STREAM_SLICES)]
    bounds = df.agg(F.percentile_approx(key, marks)).first()[0] or []
    nth = sum((F.when(key > b, 1).otherwise(0) for b in bounds), F.lit(0))
    for k in range(STREAM_SLICES):
        df.filter(F.coalesce(nth, F.lit(0)) == k).write.mode("append").parquet(f"{root}/in")
        yield f"{root}/in", df.schema


def stream_meter_summary(spark, sf):
    """Meter summary maintained by a streaming aggregate over the event
    files (available-now trigger), finished with the customer join."""
    from gridwatch.sources.fixtures import events_from_stream
    from gridwatch.streaming.incremental import meter_summary_stream, read_meter_state, read_stream
    root = _scratch(spark, "stream_ms")
    for path, schema in _arrivals(spark, sf, "events", "ts", root):
        raw = read_stream(spark, path, schema)
        meter_summary_stream(events_from_stream(raw), f"{root}/state", f"{root}/_chk", compact_every=2).awaitTermination()
    cust, _ = _base(spark, sf)
    return S.finish_meter_summary(read_meter_state(spark, f"{root}/state"), cust)


def stream_event_flags(spark, sf):
    """'any' coordinate flags from a streaming distinct of coordinate meters."""
    from gridwatch.sources.fixtures import events_from_stream
    from gridwatch.streaming.incremental import (coordinate_meter_stream, flags_from_coordinate_meters,
                                                 read_stream)
    root = _scratch(spark, "stream_flags")
    for path, schema in _arrivals(spark, sf, "events", "ts", root):
        raw = read_stream(spark, path, schema)
        coordinate_meter_stream(events_from_stream(raw), f"{root}/meters", f"{root}/_chk").awaitTermination()
    cust, _ = _base(spark, sf)
    return flags_from_coordinate_meters(cust, spark.read.parquet(f"{root}/meters")).select(
        "ecgkey", "meternumber", "has_own_coordinates", "has_event_coordinates", "has_any_coordinates")


def stream_event_changes(spark, sf):
    """Events arrive, then some are deleted and some lose their coordinates;
    change records carry the values before and after, and the customers' 'any'
    flags follow from signed counts per meter."""
    from gridwatch.streaming.incremental import CHANGE_COLUMNS, event_count_stream, flags_from_event_flags, read_counted_flags, read_stream
    cust, ev = _base(spark, sf)
    root = _scratch(spark, "stream_changes")
    k = F.col("event_id")
    now = [F.col(c) for c in ("meter_number", "latitude", "longitude")]
    before = [c.alias(n) for c, n in zip(now, CHANGE_COLUMNS, strict=False)]
    inserted = ev.select(*[F.when(F.lit(False), c).alias(n) for c, n in zip(now, CHANGE_COLUMNS, strict=False)], *now)
    updated = [F.when(k % 3 == 1, F.lit(None) if n == "latitude" else F.col(n)).cast(ev.schema[n].dataType).alias(n) for n in CHANGE_COLUMNS[3:]]
    for records in (inserted, ev.filter(k % 3 != 2).select(*before, *updated)):
        records.write.mode("append").parquet(f"{root}/changes")
        changes = read_stream(spark, f"{root}/changes", inserted.schema)
        event_count_stream(changes, f"{root}/counts", f"{root}/_chk", compact_every=2).awaitTermination()
    return flags_from_event_flags(cust, read_counted_flags(spark, f"{root}/counts")).select(
        "ecgkey", "meternumber", "has_own_coordinates", "has_event_coordinates", "has_any_coordinates")


def size_texts(spark, sf):
    """Byte counts as the table report prints them."""
    from gridwatch.functions.text import size_text
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    n = F.col("l_orderkey") * F.col("l_orderkey") * F.col("l_linenumber")
    return lines.select(n.alias("bytes")).distinct().select("bytes", size_text("bytes").alias("text"))


def geojson_features(spark, sf):
    from gridwatch.sources.exports import geojson_features as features
    cust, ev = _base(spark, sf)
    return features(C.customer_dto(J.with_latest_event(cust, ev)))


def customers_export(spark, sf):
    """All customers of matching regions, exported as JSON lines in one write and
    read back."""
    from gridwatch.sources.exports import JSON_OPTIONS, export_records
    cust, ev = _base(spark, sf)
    rows = C.flatten_dto(C.customer_dto(J.with_latest_event(C.filter_customers(cust, CustomerFilter(region_name="a")), ev)))
    path = _scratch(spark, "export")
    export_records(rows, path)
    return spark.read.schema(rows.schema).options(**JSON_OPTIONS).json(path)


def customer_page_envelope(spark, sf):
    from gridwatch.sources.exports import customer_envelope
    cust, ev = _base(spark, sf)
    f = CustomerFilter(search=SEARCH, page=2, page_size=20)
    page = C.flatten_dto(C.customer_page(cust, ev, f, with_position=True))
    return customer_envelope(page, C.count_customers(cust, f), f.page, f.page_size)


def customer_page_meta(spark, sf):
    """Paging metadata of the searched customer list (count without the event join)."""
    cust, _ = _base(spark, sf)
    f = CustomerFilter(search=SEARCH, page=2, page_size=20)
    return C.page_meta(C.count_customers(cust, f), f.page, f.page_size)


def stream_customer_flags(spark, sf):
    """Customer records arriving as a stream get flags and geometry from a
    stream-static join with the meters that have coordinate events."""
    from gridwatch.sources.fixtures import customers_from_tpch
    from gridwatch.streaming.incremental import customer_flag_stream, read_stream
    root = _scratch(spark, "stream_customers")
    _, ev = _base(spark, sf)
    for path, schema in _arrivals(spark, sf, "customer", "c_custkey", root):
        changes = customers_from_tpch(read_stream(spark, path, schema), spark.read.parquet(f"{sf}/nation.parquet"),
                                      spark.read.parquet(f"{sf}/region.parquet"))
        out = customer_flag_stream(changes, S.event_coordinate_meters(ev))
        (out.select("ecgkey", "meternumber", "has_own_coordinates", "has_event_coordinates",
                    "has_any_coordinates", "geom_x", "geom_y")
         .writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/_chk").trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{root}/out")


def stream_attempt_lockouts(spark, sf):
    """The lock-out counter as a stateful stream over the event files
    (available-now trigger), written to the shared folder and read back."""
    from datetime import timedelta

    from gridwatch.operators.lockouts import attempts_from_events
    from gridwatch.streaming.incremental import read_stream
    from gridwatch.streaming.lockouts import lockout_stream
    root = _scratch(spark, "stream_lockouts")
    for path, schema in _arrivals(spark, sf, "events", "ts", root):
        attempts = attempts_from_events(read_stream(spark, path, schema))
        out = lockout_stream(attempts, timedelta(days=LOCKOUT_WINDOW_DAYS), LOCKOUT_MAX)
        (out.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/_chk").trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{root}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _write_csv(df: DataFrame, path: str) -> None:
    """As databases export it: quotes doubled, line ends inside quotes."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"').option("quote", '"')
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))


# Added to every third address: a line end, quotes and a comma.
HARD_TEXT = '\nBlock "B", Accra'


def csv_customers(spark, sf):
    """Customer records exported as CSV text and ingested again through the
    typed CSV reader (text read, leading zeros kept, typed by the rules)."""
    from gridwatch.sources.readers import read_customers_csv
    cust, _ = _base(spark, sf)
    path = _scratch(spark, "csv_customers")
    hard = F.when(F.col("ecgkey").cast("long") % 3 == 0, F.concat("address", F.lit(HARD_TEXT))).otherwise(F.col("address"))
    _write_csv(cust.withColumn("address", hard), path)
    back = read_customers_csv(spark, path)
    return back.select("ecgkey", "meternumber", "accountnumber", "fullname", "districtcode", "address",
                       "latitude", "longitude", F.col("currentbalance").cast("double").alias("currentbalance"),
                       "lastpaymentdate", "isamr")


def csv_events(spark, sf):
    """Tamper events exported as CSV and ingested through the typed reader."""
    from gridwatch.sources.readers import read_events_csv
    _, ev = _base(spark, sf)
    path = _scratch(spark, "csv_events")
    zoned = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS'+00'")
    _write_csv(ev.drop("event_id").withColumn("event_time", zoned), path)
    back = read_events_csv(spark, path)
    return back.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


def csv_rejects(spark, sf):
    """Rows of an event export that can't be loaded, counted by reason, and
    the loaded ones; together they are the whole file."""
    from gridwatch.sources.readers import split_events_csv
    _, ev = _base(spark, sf)
    path = _scratch(spark, "csv_rejects")
    k = F.col("event_id")
    _write_csv(ev.withColumn("meter_number", F.when(k % 7 != 0, F.col("meter_number")))
               .withColumn("event_time", F.when(k % 11 == 0, F.lit("yesterday")).otherwise(F.col("event_time").cast("string")))
               .drop("event_id"), path)
    loaded, rejects = split_events_csv(spark, path)
    return (rejects.groupBy("reason").agg(F.count("*").alias("n"))
            .unionByName(loaded.agg(F.lit("loaded").alias("reason"), F.count("*").alias("n"))))


def csv_column_orders(spark, sf):
    """Two event files of one folder with their columns in different orders, one
    with an extra column: every file is read by its own header."""
    from gridwatch.sources.readers import read_events_csv
    _, ev = _base(spark, sf)
    path = _scratch(spark, "csv_orders")
    k = F.col("event_id")
    zoned = ev.withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS'+00'"))
    for part, columns in ((k % 2 == 0, ["meter_number", "event_time", "event_code", "event_desc"]),
                          (k % 2 == 1, ["event_code", "batch", "event_desc", "event_time", "meter_number"])):
        rows = zoned.filter(part).withColumn("batch", F.lit('x,"y"\nz')).select(*columns)
        rows.write.mode("append").option("header", True).option("escape", '"').option("quote", '"').csv(path)
    back = read_events_csv(spark, path)
    return back.select("meter_number", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "event_code", "event_desc")


def csv_load_refresh(spark, sf):
    """CSV load (customers, month-partitioned events) followed by the
    four-step refresh; returns the published district summary."""
    from datetime import datetime

    from gridwatch.plans.refresh import load_and_refresh
    cust, ev = _base(spark, sf)
    root = _scratch(spark, "csv_load")
    _write_csv(cust, f"{root}/in/customers")
    _write_csv(ev.drop("event_id"), f"{root}/in/events")
    paths = load_and_refresh(spark, f"{root}/in/customers", f"{root}/in/events", f"{root}/out",
                             as_of=datetime(2024, 2, 1))
    return _round_geom(spark.read.parquet(paths["district_event_summary"]).drop("updated_at"))



def table_row_counts(spark, sf):
    """The row-count part of the table report (sizes are in ``table_stats``)."""
    return table_stats(spark, sf).select("table_name", "row_count", "row_count_text")


def table_sizes(spark, sf):
    """The byte part of the table report, held against a listing of the files."""
    report = table_stats(spark, sf).select("table_name", "row_count", "total_bytes")
    listed = None
    for name in ("customer", "events", "nation", "region"):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{sf}/{name}.parquet")
        own = files.where(F.col("path").endswith(".parquet")).agg(F.sum("length").alias("listed")).select(F.lit(name).alias("table_name"), "listed")
        listed = own if listed is None else listed.unionByName(own)
    return report.join(listed, "table_name").select("table_name", "row_count", (F.col("total_bytes") == F.col("listed")).alias("bytes_agree"))


def coordinate_filter_guard(spark, sf):
    """What a coordinate filter does on customers without the flag column."""
    cust, _ = _base(spark, sf)
    try:
        C.filter_customers(cust, CustomerFilter(has_coordinates=True))
        outcome = "accepted"
    except ValueError:
        outcome = "flag column needed"
    return cust.agg(F.count("*").alias("customers")).withColumn("outcome", F.lit(outcome))


def event_page_envelope(spark, sf):
    """Events of the account's meter, one page, as the events envelope."""
    from gridwatch.sources.exports import event_envelope
    cust, ev = _base(spark, sf)
    f = EventFilter(page=2, page_size=10)
    meter = C.bounded_keys(C.account_meter(cust, EVENT_ACCOUNT), "meter_number", 1)[0]
    return event_envelope(C.event_page(ev, meter, f, with_position=True), C.count_events(ev, meter, f),
                          f.page, f.page_size, meter, EVENT_ACCOUNT)

# Every public function above, by name.
QUERIES: dict[str, Query] = {name: fn for name, fn in list(globals().items())
                             if callable(fn) and getattr(fn, "__module__", None) == __name__
                             and not name.startswith("_")}
