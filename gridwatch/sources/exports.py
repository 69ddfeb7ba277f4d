"""Result envelopes and file exports.

Pages are bounded (at most 200 customers / 500 events), so an envelope may
gather one page into a single JSON document.  Whole-table exports are one
distributed write of newline-delimited records instead of a page loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.functions.params import MAX_EVENT_PAGE
from gridwatch.operators.customers import POSITION

# JSON rendering: keep NULL fields, ISO-8601 times (UTC shown as Z).
JSON_OPTIONS = {"ignoreNullFields": "false",
                "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX",
                "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]'Z'",
                "dateFormat": "yyyy-MM-dd"}


def _page_json(rows: DataFrame, total: DataFrame, page: int, page_size: int, data_field: str,
               extra: dict[str, str] | None = None) -> DataFrame:
    """One JSON document from a bounded page and its one-row total.

    The page rows and the total are tagged, unioned and folded in one global
    aggregate (no join)."""
    if page_size > MAX_EVENT_PAGE:
        raise ValueError("an envelope holds one bounded page")
    fields = [c for c in rows.columns if c != POSITION]
    pos = F.col(POSITION) if POSITION in rows.columns else F.lit(0)
    # position first, so sorting the collected entries restores the page order
    entry = F.struct(pos.cast("long").alias("p"), F.struct(*[F.col(c) for c in fields]).alias("r"))
    etype = rows.select(entry.alias("e")).schema["e"].dataType.simpleString()
    u = (rows.select(entry.alias("_r"), F.lit(None).cast("long").alias("_t"))
         .unionByName(total.select(F.lit(None).cast(etype).alias("_r"),
                                   F.col("total").cast("long").alias("_t"))))
    folded = (u.agg(F.array_sort(F.collect_list("_r")).alias("_sorted"), F.max("_t").alias("total"))
              .withColumn(data_field, F.transform("_sorted", lambda e: e["r"])))
    fields = [F.lit(v).alias(k) for k, v in (extra or {}).items()]
    return folded.select(F.to_json(F.struct(
        *fields, F.col("total"), F.lit(page).alias("page"), F.lit(page_size).alias("page_size"),
        F.ceil(F.col("total") / F.lit(page_size)).cast("long").alias("total_pages"),
        F.col(data_field)), JSON_OPTIONS).alias("json"))


def customer_envelope(page_rows: DataFrame, total: DataFrame, page: int, page_size: int) -> DataFrame:
    """``{"data": [...], "total", "page", "page_size", "total_pages"}``."""
    return _page_json(page_rows, total, page, page_size, "data")


def event_envelope(page_rows: DataFrame, total: DataFrame, page: int, page_size: int,
                   meter_number: str, account_number: str | None = None) -> DataFrame:
    """Event page envelope; ``account_number`` only when looked up by account."""
    extra = {"meter_number": meter_number}
    if account_number:
        extra["account_number"] = account_number
    return _page_json(page_rows, total, page, page_size, "events", extra)


# GeoJSON feature properties of the map client.
GEOJSON_PROPERTIES = ["account_number", "full_name", "meter_number", "service_type",
                      "contract_status", "current_balance"]


def geojson_features(dto: DataFrame) -> DataFrame:
    """One GeoJSON Feature per plottable customer DTO row ([lon, lat] order);
    rows missing either coordinate are left out."""
    ev = "latest_tamper_event"
    has_ev = ev in dto.columns
    props = [F.col(c) for c in GEOJSON_PROPERTIES] + [
        (F.col(f"{ev}.event_desc") if has_ev else F.col("latest_event_desc")).alias("event_desc"),
        (F.col(f"{ev}.event_time") if has_ev else F.col("latest_event_time")).alias("event_time")]
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"),
                 F.array(F.col("longitude"), F.col("latitude")).alias("coordinates")).alias("geometry"),
        F.struct(*props).alias("properties"))
    return (dto.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
            .select(F.col("ecgkey"), F.to_json(feature, JSON_OPTIONS).alias("feature")))


def write_geojson_seq(features: DataFrame, path: str) -> None:
    """Newline-delimited features (GeoJSON text sequence), written in parallel."""
    features.select("feature").write.mode("overwrite").text(path)


def export_records(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Export every matching record in one write (no page loop)."""
    w = df.write.mode("overwrite")
    if fmt == "json":
        w.options(**JSON_OPTIONS).json(path)
    elif fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        w.option("header", True).csv(path)
    else:
        raise ValueError(fmt)
