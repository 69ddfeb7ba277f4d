from __future__ import annotations

from datetime import datetime

from pyspark.sql import types as T

CUST_COLS = [
    ("ecgkey", T.StringType()), ("meternumber", T.StringType()), ("accountnumber", T.StringType()),
    ("fullname", T.StringType()), ("phonenumber", T.StringType()), ("regioncode", T.StringType()),
    ("regionname", T.StringType()), ("districtcode", T.StringType()), ("districtname", T.StringType()),
    ("servicetype", T.StringType()), ("contractstatus", T.StringType()),
    ("latitude", T.DoubleType()), ("longitude", T.DoubleType()),
]
EV_COLS = [
    ("period", T.StringType()), ("meter_number", T.StringType()), ("customer_name", T.StringType()),
    ("event_code", T.StringType()), ("event_desc", T.StringType()), ("event_time", T.TimestampNTZType()),
    ("latitude", T.DoubleType()), ("longitude", T.DoubleType()), ("counting", T.LongType()),
    ("event_id", T.LongType()),
]


def customers(spark, rows: list[dict]):
    schema = T.StructType([T.StructField(n, t) for n, t in CUST_COLS])
    defaults = {"regioncode": "01", "regionname": "GREATER ACCRA", "districtcode": "01-01",
                "districtname": "ACCRA EAST", "servicetype": "Prepaid", "contractstatus": "Active"}
    data = [tuple({**defaults, **r}.get(n) for n, _ in CUST_COLS) for r in rows]
    return spark.createDataFrame(data, schema)


def events(spark, rows: list[dict]):
    schema = T.StructType([T.StructField(n, t) for n, t in EV_COLS])
    out = []
    for i, r in enumerate(rows):
        r = {"period": "2024-01", "event_code": "3.26.38.98", "event_desc": "STDEVT:tamper",
             "event_id": i, **r}
        if isinstance(r.get("event_time"), str):
            r["event_time"] = datetime.fromisoformat(r["event_time"])
        out.append(tuple(r.get(n) for n, _ in EV_COLS))
    return spark.createDataFrame(out, schema)
