"""Column helpers: coercion, timestamp layouts, report formatting."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridwatch.functions.coerce import coerce_bool, coerce_double, coerce_text, parse_timestamp
from gridwatch.functions.text import contains_pattern, count_text, size_text


def _one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("r")).collect()[0]["r"]


@pytest.mark.parametrize("text,expected", [("", False), (" ", False), ("abc", False), ("1", True),
                                           ("t", True), ("true", True), ("TRUE", False), (None, False)])
def test_dirty_bools(spark, text, expected):
    assert _one(spark, coerce_bool, text) is expected


def test_text_and_numbers(spark):
    assert _one(spark, coerce_text, "") is None
    assert _one(spark, coerce_double, "1.5") == 1.5
    assert _one(spark, coerce_double, "x1") is None


@pytest.mark.parametrize("text,expected", [
    ("2024-03-01T10:20:30Z", datetime(2024, 3, 1, 10, 20, 30)),
    ("2024-03-01T10:20:30.123456789Z", datetime(2024, 3, 1, 10, 20, 30, 123456)),
    ("2024-03-01T12:20:30+02:00", datetime(2024, 3, 1, 10, 20, 30)),
    ("2024-03-01T10:20:30.000Z", datetime(2024, 3, 1, 10, 20, 30)),
    ("2024-03-01 10:20:30", datetime(2024, 3, 1, 10, 20, 30)),
    ("2024-03-01", datetime(2024, 3, 1)),
    ("2026", None), ("garbage", None), ("", None), ("2024-02-30", None),
])
def test_timestamp_layouts(spark, text, expected):
    got = spark.createDataFrame([(text,)], "v string").select(
        parse_timestamp("v").cast("timestamp_ntz").alias("r")).collect()[0]["r"]
    assert got == expected


@pytest.mark.parametrize("n,text", [(0, "           0"), (1234567, "   1,234,567"),
                                    (999999999, " 999,999,999"), (1000000000, "############")])
def test_count_text(spark, n, text):
    assert _one(spark, count_text, n, "long") == text


@pytest.mark.parametrize("n,text", [(0, "0 bytes"), (10239, "10239 bytes"), (10240, "10 kB"),
                                    (20478 * 512, "10239 kB"), (20479 * 512, "10 MB"), (20480 * 1024, "20 MB"),
                                    (5 * 1024 ** 3, "5120 MB"), (50 * 1024 ** 3, "50 GB")])
def test_size_text(spark, n, text):
    assert _one(spark, size_text, n, "long") == text


def test_contains_pattern():
    assert contains_pattern("ab") == "%AB%"
    assert contains_pattern("a\\b") == "%AB%"
    assert contains_pattern("a\\%") == "%A\\%%"
    assert contains_pattern("a\\") == "%A\\%"


def test_query_string_filters():
    from datetime import datetime

    from gridwatch.functions.params import (customer_filter_from_query, event_filter_from_query,
                                            no_coordinates_filter_from_query)
    q = {"search": "ab", "has_tamper": "TRUE", "has_coordinates": "yes", "page": "x", "page_size": "20",
         "service_point_number": "SP1"}
    f = customer_filter_from_query(q)
    assert f.has_tamper and not f.has_coordinates and f.page == 0 and f.page_size == 20
    assert f.service_point_number == "SP1"
    g = no_coordinates_filter_from_query({**q, "has_coordinates": "true"})
    assert g.no_coordinates and not g.has_coordinates and g.service_point_number == ""
    e = event_filter_from_query({"from": "2024-01-02", "to": "2024-01-03T10:00:00+01:00", "event_code": " x "})
    assert e.from_ == datetime(2024, 1, 2) and e.to == datetime(2024, 1, 3, 9) and e.event_code == " x "
    with pytest.raises(ValueError):
        event_filter_from_query({"from": "02/01/2024"})
