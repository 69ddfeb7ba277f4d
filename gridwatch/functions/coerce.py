"""Typed reads of loosely typed text (customer CSV, driver scan values).

Rules: empty text is NULL; numbers from text, unparsable -> NULL; booleans are
true for ``'true'``, ``'1'``, ``'t'`` (exact), false otherwise; timestamps
try a fixed list of layouts and the first that matches wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_text(c: Column | str) -> Column:
    return F.nullif(_c(c), F.lit(""))


# Strict spellings: no blanks around, no type suffix.
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
INTEGER = r"^[+-]?\d+$"


def coerce_double(c: Column | str) -> Column:
    return F.when(_c(c).rlike(NUMBER), _c(c).try_cast("double"))


def coerce_long(c: Column | str) -> Column:
    return F.when(_c(c).rlike(INTEGER), _c(c).try_cast("bigint"))


def coerce_decimal(c: Column | str, precision: int = 38, scale: int = 10) -> Column:
    return F.when(_c(c).rlike(NUMBER), _c(c).try_cast(T.DecimalType(precision, scale)))


# Text spellings read as true.
TRUE_TEXTS = ("true", "1", "t")


def coerce_bool(c: Column | str) -> Column:
    return F.coalesce(_c(c).isin(*TRUE_TEXTS), F.lit(False))


# Accepted timestamp layouts, tried in this order (RFC 3339
# with optional fraction; date and time with a space, as databases print it, a
# zone of hours or hours and minutes behind it or none; date only).  Each is a
# strict pattern guarding a cast, because Spark's string-to-timestamp cast
# alone also accepts partial text such as ``'2026'``.
TIMESTAMP_LAYOUTS: list[str] = [
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$",
    r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?([+-]\d{2}(:\d{2})?)?$",
    r"^\d{4}-\d{2}-\d{2}$",
]


def parse_timestamp(c: Column | str) -> Column:
    """First matching layout wins; anything else is NULL.  Zone-less text is
    read in the session time zone (UTC)."""
    col = _c(c)
    guard = None
    for pattern in TIMESTAMP_LAYOUTS:
        g = col.rlike(pattern)
        guard = g if guard is None else (guard | g)
    # a zone of hours alone ('+00') is completed before the cast
    full = F.regexp_replace(col, r"(:\d{2}(?:\.\d+)?[+-]\d{2})$", "$1:00")
    return F.when(guard, full.try_cast("timestamp"))
