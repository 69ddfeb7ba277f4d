"""Customer-facing read operators: filters, DTO shaping, paging, lookups.

Paging is planned so the expensive latest-event lookup runs only for the
rows of the requested page: filter → ``TakeOrderedAndProject`` (each task
keeps at most offset+size rows) → latest events of the page's meters only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridwatch.functions.params import (DEFAULT_PAGE_SIZE, MAX_CUSTOMER_PAGE, CustomerFilter,
                                        EventFilter, normalise_customer_filter, normalise_event_filter,
                                        utc_literal)
from gridwatch.functions.text import contains_pattern
from gridwatch.session import checkpoint_dir
from gridwatch.operators.joins import TAMPER_ALIASES, event_order, latest_event_per_meter, semi_join

FLAG = "has_any_coordinates"


# ── filters ──────────────────────────────────────────────────────────────────

def _contains_ci(col: str, needle: str) -> Column:
    return F.upper(F.col(col)).like(contains_pattern(needle))


def customer_predicates(f: CustomerFilter) -> list[Column]:
    """AND-combined optional predicates; empty text means 'not given'."""
    preds: list[Column] = []
    if f.search:
        p = contains_pattern(f.search)   # upper-cased needle, compared as the source does
        preds.append(F.upper(F.col("fullname")).like(p) | F.col("accountnumber").like(p)
                     | F.col("meternumber").like(p))
    equal = [("region_code", "regioncode"), ("district_code", "districtcode"),
             ("service_type", "servicetype"), ("service_class", "serviceclass"),
             ("service_point_number", "servicepointnumber"), ("customer_type", "customertype"),
             ("contract_status", "contractstatus"), ("cms_contract_status", "cmscontractstatus"),
             ("account_type", "accounttype")]
    for attr, col in equal:
        v = getattr(f, attr)
        if v:
            preds.append(F.col(col) == F.lit(v))
    for attr, col in [("region_name", "regionname"), ("district_name", "districtname"),
                      ("meter_make", "metermake"), ("meter_model", "metermodel")]:
        v = getattr(f, attr)
        if v:
            preds.append(_contains_ci(col, v))
    if f.has_coordinates:
        preds.append(F.col(FLAG) == F.lit(True))
    if f.no_coordinates:
        preds.append(F.col(FLAG) == F.lit(False))
    return preds


def filter_customers(customers: DataFrame, f: CustomerFilter,
                     meter_summary_df: DataFrame | None = None) -> DataFrame:
    """Apply a ``CustomerFilter``.

    Coordinate filters need the flag column (schema guard); ``has_tamper``
    keeps customers whose meter is in the meter summary (semi join).
    """
    f = normalise_customer_filter(f)
    if (f.has_coordinates or f.no_coordinates) and FLAG not in customers.columns:
        raise ValueError("coordinate filters need the has_any_coordinates column "
                         "(run the coordinate-flag step first)")
    out = customers
    for p in customer_predicates(f):
        out = out.filter(p)
    if f.has_tamper:
        if meter_summary_df is None:
            raise ValueError("has_tamper needs the meter summary")
        out = semi_join(out, meter_summary_df, "meternumber", "meternumber")
    return out


def event_predicates(f: EventFilter, time_type=None) -> list[Column]:
    preds: list[Column] = []
    if f.event_desc:
        preds.append(_contains_ci("event_desc", f.event_desc))
    if f.event_code:
        preds.append(F.col("event_code") == F.lit(f.event_code))
    if f.from_ is not None:
        preds.append(F.col("event_time") >= utc_literal(f.from_, time_type))
    if f.to is not None:
        preds.append(F.col("event_time") <= utc_literal(f.to, time_type))
    return preds


def month_predicates(events: DataFrame, f: EventFilter) -> list[Column]:
    """Partition predicates on ``event_month`` ('yyyy-MM') derived from the
    time bounds; Spark prunes partitions only on a predicate on the partition
    column itself."""
    if "event_month" not in events.columns:
        return []
    preds = []
    if f.from_ is not None:
        preds.append(F.col("event_month") >= F.lit(f.from_.strftime("%Y-%m")))
    if f.to is not None:
        preds.append(F.col("event_month") <= F.lit(f.to.strftime("%Y-%m")))
    return preds


def _time_type(events: DataFrame):
    return events.schema["event_time"].dataType if "event_time" in events.columns else None


def filter_events(events: DataFrame, f: EventFilter, meter_number: str | None = None) -> DataFrame:
    f = normalise_event_filter(f)
    out = events
    if meter_number is not None:
        out = out.filter(F.col("meter_number") == F.lit(meter_number))
    for p in month_predicates(events, f) + event_predicates(f, _time_type(events)):
        out = out.filter(p)
    return out


# ── DTO shaping ──────────────────────────────────────────────────────────────

def _text(col: str, present: set[str] | None = None) -> Column:
    """Text field that is never NULL in the API (NULL prints as '')."""
    if present is not None and col not in present:
        return F.lit("")
    return F.coalesce(F.col(col), F.lit(""))


def _opt(col: str, present: set[str], dtype: str) -> Column:
    return F.col(col).cast(dtype) if col in present else F.lit(None).cast(dtype)


def with_event_flag_from_latest(df: DataFrame) -> DataFrame:
    """``has_any_coordinates`` for rows that carry ``tamper_*`` but no flags:
    own coordinates, or the latest event has both (the batch 'latest' rule)."""
    if FLAG in df.columns:
        return df
    own = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    ev = F.col("tamper_latitude").isNotNull() & F.col("tamper_longitude").isNotNull()
    return df.withColumn(FLAG, own | ev)


def customer_dto(df: DataFrame) -> DataFrame:
    """API shape of a customer with its latest event.

    The source's coordinate columns are swapped: ``latitude`` is read from
    ``longitude`` and vice versa, each falling back (independently) to the
    latest event's swapped coordinate.  ``latest_tamper_event`` is NULL when
    the customer's meter has no event.
    """
    df = with_event_flag_from_latest(df)
    has_event = F.col("tamper_meter_number").isNotNull()
    event = F.when(has_event, F.struct(
        _text("tamper_event_code").alias("event_code"),
        _text("tamper_event_desc").alias("event_desc"),
        F.col("tamper_event_time").alias("event_time"),
        _text("tamper_period").alias("period"),
        F.col("tamper_longitude").alias("latitude"),
        F.col("tamper_latitude").alias("longitude"),
    ))
    text_fields = [
        ("ecgkey", "ecgkey"), ("accountnumber", "account_number"),
        ("servicepointnumber", "service_point_number"), ("fullname", "full_name"),
        ("phonenumber", "phone_number"), ("servicetype", "service_type"),
        ("serviceclass", "service_class"), ("tariffclassname", "tariff_class"),
        ("contractstatus", "contract_status"), ("meternumber", "meter_number"),
        ("metertype", "meter_type"), ("metermake", "meter_make"), ("metermodel", "meter_model"),
        ("address", "address"), ("streetname", "street_name"), ("housenumber", "house_number"),
        ("regionname", "region_name"), ("districtname", "district_name"),
    ]
    have = set(df.columns)
    return df.select(
        *[_text(src, have).alias(dst) for src, dst in text_fields],
        F.coalesce(F.col("longitude"), F.col("tamper_longitude")).alias("latitude"),
        F.coalesce(F.col("latitude"), F.col("tamper_latitude")).alias("longitude"),
        F.coalesce(F.col(FLAG), F.lit(False)).alias("has_any_coordinates"),
        _opt("lastbillamount", have, "double").alias("last_bill_amount"),
        _opt("currentbalance", have, "double").alias("current_balance"),
        F.date_format(_opt("lastpaymentdate", have, "date"), "yyyy-MM-dd").alias("last_payment_date"),
        _opt("lastpaymentamount", have, "double").alias("last_payment_amount"),
        event.alias("latest_tamper_event"),
        *([F.col(POSITION)] if POSITION in have else []),
    )


def flatten_dto(dto: DataFrame) -> DataFrame:
    """Nested event fields as ``latest_event_*`` columns (for tabular sinks)."""
    e = "latest_tamper_event"
    return dto.select(
        *[c for c in dto.columns if c != e],
        *[F.col(f"{e}.{f}").alias(f"latest_{f}" if f.startswith("event_") else f"latest_event_{f}")
          for f in ("event_code", "event_desc", "event_time", "period", "latitude", "longitude")],
    )


def event_rows(events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Raw event projection as the API returns it (no coordinate swap)."""
    return events.select(
        _text("period").alias("period"), F.col("meter_number"),
        _text("customer_name").alias("customer_name"), _text("event_code").alias("event_code"),
        _text("event_desc").alias("event_desc"), F.col("event_time"),
        F.col("latitude"), F.col("longitude"), F.col("counting"), *(keep or []))


# ── latest event for a bounded set of customers ─────────────────────────────

def bounded_keys(df: DataFrame, column: str, bound: int) -> list:
    """Distinct non-NULL values of ``column`` from a relation of at most
    ``bound`` rows (a page, a lookup) as a Python list.

    The list is a query parameter: used in an ``IN`` predicate it reaches the
    Parquet scan, where row-group statistics skip everything else (events
    are stored clustered by meter).  The bound is enforced, never assumed.
    """
    vals = (df.select(F.col(column).alias("_k")).filter(F.col("_k").isNotNull()).distinct()
            .limit(bound + 1).collect())
    if len(vals) > bound:
        raise ValueError(f"more than {bound} keys: not a bounded lookup")
    return [r["_k"] for r in vals]


def with_latest_event_for(rows: DataFrame, events: DataFrame, bound: int) -> DataFrame:
    """Latest event per meter for a *bounded* set of customer rows.

    ``bound`` is the proven maximum row count of ``rows`` (a page, a lookup).
    Its meters become an ``IN`` filter pushed into the event scan, and only
    those meters' events are aggregated.
    """
    if bound > 10000:
        raise ValueError("with_latest_event_for is for bounded row sets; use with_latest_event")
    # the rows are used twice (key list, output): materialise them once in the
    # shared checkpoint folder instead of re-running the filtered top-K scan
    checkpoint_dir(rows.sparkSession)
    rows = rows.checkpoint(eager=True)
    meters = bounded_keys(rows, "meternumber", bound)
    ev = events.filter(F.col("meter_number").isin(meters)) if meters else events.limit(0)
    latest = latest_event_per_meter(ev)
    right = latest.select(F.col("meter_number").alias("_le_key"),
                          *[F.col(s).alias(d) for s, d in TAMPER_ALIASES])
    # at most ``bound`` rows on each side: broadcasting either is bounded
    return rows.join(F.broadcast(right), rows["meternumber"] == right["_le_key"], "left").drop("_le_key")


# ── paging ───────────────────────────────────────────────────────────────────

def customer_order() -> list[Column]:
    """Name ascending (NULLs last, as PostgreSQL sorts), ``ecgkey`` breaks ties."""
    return [F.col("fullname").asc_nulls_last(), F.col("ecgkey").asc()]


def count_customers(customers: DataFrame, f: CustomerFilter,
                    meter_summary_df: DataFrame | None = None) -> DataFrame:
    """Filtered count for paging; needs no event join."""
    return filter_customers(customers, f, meter_summary_df).agg(F.count(F.lit(1)).alias("total"))


POSITION = "page_position"


def _with_position(page: DataFrame, order: list[Column]) -> DataFrame:
    """1-based position in the page order.  A page holds at most 500 rows, so
    the one-partition window is bounded."""
    return page.withColumn(POSITION, F.row_number().over(Window.orderBy(*order)))


# Rows that a task may hold for a page: beyond, the page is found by counts.
SHALLOW_ROWS = 10_000


def ordered_page(df: DataFrame, order: list[Column], offset: int, size: int, shallow: int | None = None) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` of ``df`` in ``order`` (a total order).

    A task of the plain top-K plan holds offset + size rows.  Deep pages
    therefore range-partition the rows by the order, count each range (one
    number per partition) and sort only the ranges that the page lies in.
    ``shallow``: rows up to which the plain plan is taken (``SHALLOW_ROWS``).
    """
    if offset + size <= (SHALLOW_ROWS if shallow is None else shallow):
        return df.orderBy(*order).offset(offset).limit(size)
    checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    before, inside, skipped = 0, [], 0
    for r in sorted(ranged.groupBy("_range").count().collect()):
        if before + r["count"] > offset and before < offset + size:
            skipped = before if not inside else skipped
            inside.append(r["_range"])
        before += r["count"]
    part = ranged.filter(F.col("_range").isin(inside)).drop("_range")
    return part.orderBy(*order).offset(max(0, offset - skipped)).limit(size)


def page_rows(customers: DataFrame, f: CustomerFilter, meter_summary_df: DataFrame | None = None,
              shallow: int | None = None) -> DataFrame:
    """The filtered customer records of one page.  A deep page is found on the
    keys alone; its at most 200 keys then select the records."""
    f = normalise_customer_filter(f)
    rows, offset = filter_customers(customers, f, meter_summary_df), (f.page - 1) * f.page_size
    if offset + f.page_size <= (SHALLOW_ROWS if shallow is None else shallow):
        return ordered_page(rows, customer_order(), offset, f.page_size, shallow)
    keys = ordered_page(rows.select("fullname", "ecgkey"), customer_order(), offset, f.page_size, shallow)
    return rows.filter(F.col("ecgkey").isin(bounded_keys(keys, "ecgkey", f.page_size))).orderBy(*customer_order())


def customers_after(customers: DataFrame, f: CustomerFilter, fullname: str | None, ecgkey: str,
                    meter_summary_df: DataFrame | None = None) -> DataFrame:
    """The page that follows a customer (its name and key): no rows before it
    are read into a sort, so the cost does not grow with the page number."""
    f = normalise_customer_filter(f)
    name, key = F.col("fullname"), F.col("ecgkey")
    if fullname is None:
        later = name.isNull() & (key > F.lit(ecgkey))
    else:
        later = name.isNull() | (name > F.lit(fullname)) | ((name == F.lit(fullname)) & (key > F.lit(ecgkey)))
    return filter_customers(customers, f, meter_summary_df).filter(later).orderBy(*customer_order()).limit(f.page_size)


def customer_page(customers: DataFrame, events: DataFrame, f: CustomerFilter,
                  meter_summary_df: DataFrame | None = None, with_position: bool = False) -> DataFrame:
    """One page of filtered customers as DTO rows, ordered by name.

    Row order of a DataFrame is not kept by later shuffles; ``with_position``
    adds ``page_position`` so a consumer (the envelope) can restore it."""
    f = normalise_customer_filter(f)
    rows = page_rows(customers, f, meter_summary_df)
    if with_position:
        rows = _with_position(rows, customer_order())
    return customer_dto(with_latest_event_for(rows, events, f.page_size))


def page_meta(total: DataFrame, page: int, page_size: int, max_size: int = MAX_CUSTOMER_PAGE) -> DataFrame:
    """``total, page, page_size, total_pages`` from a one-row count; page and
    size are clamped first, and the clamped size is what is reported."""
    page = page if page >= 1 else 1
    page_size = min(page_size if page_size >= 1 else DEFAULT_PAGE_SIZE, max_size)
    return total.select(
        F.col("total"), F.lit(page).alias("page"), F.lit(page_size).alias("page_size"),
        F.ceil(F.col("total") / F.lit(page_size)).cast("long").alias("total_pages"))


def event_page(events: DataFrame, meter_number: str, f: EventFilter,
               with_position: bool = False) -> DataFrame:
    """Newest-first page of one meter's filtered events (``with_position``
    adds ``page_position``, as for ``customer_page``)."""
    f = normalise_event_filter(f)
    order = [F.col(c).desc() for c in event_order(events)]
    page = ordered_page(filter_events(events, f, meter_number), order, (f.page - 1) * f.page_size, f.page_size)
    if with_position:
        return event_rows(_with_position(page, order), keep=[POSITION])
    return event_rows(page)


def count_events(events: DataFrame, meter_number: str, f: EventFilter) -> DataFrame:
    return filter_events(events, f, meter_number).agg(F.count(F.lit(1)).alias("total"))


# ── lookups ──────────────────────────────────────────────────────────────────

def customer_lookup(customers: DataFrame, events: DataFrame, column: str, value: str) -> DataFrame:
    """First customer (by ``ecgkey``) with ``column = value``, as a DTO row."""
    row = customers.filter(F.col(column) == F.lit(value)).orderBy("ecgkey").limit(1)
    return customer_dto(with_latest_event_for(row, events, 1))


def customer_by_account(customers: DataFrame, events: DataFrame, account: str) -> DataFrame:
    return customer_lookup(customers, events, "accountnumber", account)


def customer_by_meter(customers: DataFrame, events: DataFrame, meter: str) -> DataFrame:
    return customer_lookup(customers, events, "meternumber", meter)


def account_meter(customers: DataFrame, account: str) -> DataFrame:
    """The meter of the account's first customer (by ``ecgkey``): one row
    (NULL meter when the account is unknown or its first customer has none)."""
    return (customers.filter(F.col("accountnumber") == F.lit(account))
            .agg(F.min_by("meternumber", "ecgkey").alias("meter_number")))


def events_by_account(customers: DataFrame, events: DataFrame, account: str,
                      f: EventFilter) -> DataFrame:
    """Events of the account's meter, newest first, one page.

    Two steps, as the lookup is defined: the account's meter (first customer
    by ``ecgkey``; one row), then the events of that meter with the meter as a
    literal predicate that reaches the event scan.
    """
    f = normalise_event_filter(f)
    meters = bounded_keys(account_meter(customers, account), "meter_number", 1)
    meter = meters[0] if meters and meters[0] != "" else None
    if meter is None:
        return event_rows(events.limit(0)).withColumn("account_number", F.lit(account))
    return event_page(events, meter, f).withColumn("account_number", F.lit(account))
