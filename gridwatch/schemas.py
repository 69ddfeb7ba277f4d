"""Schemas of the base and derived relations.

Column names and declared types below are fixed values: they must equal the
source system's table definitions so that files exported from it load
unchanged.  Numbers without precision are stored as ``decimal(38,10)`` and
turned into doubles at the API edge.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L, B, TS, DT = (T.StringType(), T.DoubleType(), T.LongType(),
                      T.BooleanType(), T.TimestampType(), T.DateType())
NUM = T.DecimalType(38, 10)

# Customer record columns in declared order with their types.
CUSTOMER_COLUMNS: list[tuple[str, T.DataType]] = [
    ("ecgkey", S), ("_id", S), ("regioncode", S), ("regionname", S),
    ("districtcode", S), ("districtname", S), ("servicetype", S),
    ("serviceclass", S), ("tariffclasscode", S), ("tariffclassname", S),
    ("community", S), ("contracteddemand", NUM), ("qrcode", S),
    ("createdat", TS), ("updatedat", TS), ("address", S),
    ("ghanapostaddress", S), ("streetname", S), ("housenumber", S),
    ("geolocationtype", S), ("geolocationid", S), ("latitude", D),
    ("longitude", D), ("emailaddress", S), ("phonenumber", S),
    ("profileimageurl", S), ("fullname", S), ("ghanacardnumber", S),
    ("payerfullname", S), ("payerprimaryphonenumber", S),
    ("payerfirstphone", S), ("payersecondphone", S),
    ("servicepointnumber", S), ("accountnumber", S), ("contractstatus", S),
    ("ismigrateddata", B), ("metertype", S), ("meterlocation", S),
    ("activity", S), ("subactivity", S), ("customertype", S),
    ("isregularized", B), ("lastreadingvalue", L),
    ("geolocationcoordinates", S), ("payerphonenumbers", S),
    ("blockcode", S), ("blockname", S), ("roundcode", S), ("roundname", S),
    ("cmscontractstatus", S), ("code", S), ("geocode", S),
    ("metermake", S), ("metermodel", S), ("meternumber", S),
    ("meterphase", S), ("propertycode", S), ("plotcode", S),
    ("ministry", S), ("mda", S), ("lastreadingdate", TS),
    ("installationdate", TS), ("lastbillamount", NUM),
    ("lastbillconsumption", NUM), ("lastpaymentdate", DT),
    ("lastpaymentamount", NUM), ("currentbalance", NUM), ("nationality", S),
    ("propertyownerfullname", S), ("propertyownerphonenumber", S),
    ("accounttype", S), ("isamr", B), ("offset", S), ("idnumber", S),
    ("ministrycode", S), ("ministryname", S), ("mdacode", S), ("mdaname", S),
    ("extraattributesname", S), ("extraattributesvalue", B),
    ("extraattributesid", S), ("lastbilldate", TS), ("geolocation", S),
]

# Derived flag columns kept on the customer relation.
FLAG_COLUMNS = ["has_own_coordinates", "has_event_coordinates", "has_any_coordinates"]

# The event relation.
EVENT_COLUMNS: list[tuple[str, T.DataType]] = [
    ("period", S), ("meter_number", S), ("customer_name", S),
    ("event_code", S), ("event_desc", S), ("event_time", TS),
    ("latitude", D), ("longitude", D), ("counting", L),
]

# Per-meter summary.
METER_SUMMARY_COLUMNS: list[tuple[str, T.DataType]] = [
    ("meternumber", S), ("accountnumber", S), ("latest_event_time", TS),
    ("latest_event_code", S), ("latest_event_desc", S),
    ("latest_event_lat", D), ("latest_event_lng", D), ("event_count", L),
    ("has_event_coordinates", B), ("updated_at", TS),
]

# Per-district summary (point stored as geom_x / geom_y).
DISTRICT_SUMMARY_COLUMNS: list[tuple[str, T.DataType]] = [
    ("districtcode", S), ("districtname", S), ("regioncode", S),
    ("regionname", S), ("geom_x", D), ("geom_y", D), ("total_meters", L),
    ("meters_with_events", L), ("meters_with_coordinates", L),
    ("meters_without_coordinates", L), ("total_events", L),
    ("prepaid_meters", L), ("postpaid_meters", L), ("active_contracts", L),
    ("latest_event_time", TS), ("updated_at", TS),
]

# The refresh checkpoint relation.
CHECKPOINT_COLUMNS: list[tuple[str, T.DataType]] = [
    ("run_id", S), ("step", S), ("completed", B), ("started_at", TS),
    ("finished_at", TS), ("error_msg", S),
]


def struct(columns: list[tuple[str, T.DataType]], not_null: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(n, t, n not in not_null) for n, t in columns])


CUSTOMER_SCHEMA = struct(CUSTOMER_COLUMNS, not_null=("ecgkey",))
# CSV text form: every column read as text first, typed by ``typed_customers``.
CUSTOMER_TEXT_SCHEMA = struct([(n, S) for n, _ in CUSTOMER_COLUMNS])
EVENT_SCHEMA = struct(EVENT_COLUMNS)
EVENT_TEXT_SCHEMA = struct([(n, S) for n, _ in EVENT_COLUMNS])
METER_SUMMARY_SCHEMA = struct(METER_SUMMARY_COLUMNS)
DISTRICT_SUMMARY_SCHEMA = struct(DISTRICT_SUMMARY_COLUMNS)
CHECKPOINT_SCHEMA = struct(CHECKPOINT_COLUMNS)
