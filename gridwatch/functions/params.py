"""Request parameters: filters, paging and query-time parsing.

These are plain Python values resolved on the driver before a plan is
built; no data passes through here.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Page size default and limits.
DEFAULT_PAGE_SIZE = 50
MAX_CUSTOMER_PAGE = 200
MAX_EVENT_PAGE = 500


@dataclass(frozen=True)
class CustomerFilter:
    search: str = ""
    region_code: str = ""
    region_name: str = ""
    district_code: str = ""
    district_name: str = ""
    service_type: str = ""
    service_class: str = ""
    service_point_number: str = ""
    customer_type: str = ""
    contract_status: str = ""
    cms_contract_status: str = ""
    meter_make: str = ""
    meter_model: str = ""
    account_type: str = ""
    has_tamper: bool = False
    has_coordinates: bool = False
    no_coordinates: bool = False
    page: int = 1
    page_size: int = DEFAULT_PAGE_SIZE


@dataclass(frozen=True)
class EventFilter:
    event_desc: str = ""
    event_code: str = ""
    from_: datetime | None = None
    to: datetime | None = None
    page: int = 1
    page_size: int = DEFAULT_PAGE_SIZE


def _clamp_page(page: int, size: int, max_size: int) -> tuple[int, int]:
    page = page if page >= 1 else 1
    if size < 1:
        size = DEFAULT_PAGE_SIZE
    return page, min(size, max_size)


def normalise_customer_filter(f: CustomerFilter) -> CustomerFilter:
    page, size = _clamp_page(f.page, f.page_size, MAX_CUSTOMER_PAGE)
    return replace(f, page=page, page_size=size, search=f.search.strip())


def normalise_event_filter(f: EventFilter) -> EventFilter:
    page, size = _clamp_page(f.page, f.page_size, MAX_EVENT_PAGE)
    return replace(f, page=page, page_size=size, event_desc=f.event_desc.strip(),
                   event_code=f.event_code.strip())


def total_pages(total: int, page_size: int) -> int:
    return int(math.ceil(total / page_size)) if page_size else 0


_RFC3339 = re.compile(r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
_LOCAL = re.compile(r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(\.\d+)?$")
_DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def parse_query_time(text: str) -> datetime:
    """RFC 3339, ``YYYY-MM-DDTHH:MM:SS`` (UTC) or ``YYYY-MM-DD`` (midnight UTC).

    Returns a naive UTC datetime; raises ``ValueError`` for anything else.
    """
    m = _RFC3339.match(text)
    if m:
        frac = (m.group(3) or "")[:7].ljust(7, "0") if m.group(3) else ""
        zone = "+00:00" if m.group(4) == "Z" else m.group(4)
        dt = datetime.fromisoformat(f"{m.group(1)}T{m.group(2)}{frac}{zone}")
        return dt.astimezone(timezone.utc).replace(tzinfo=None)
    m = _LOCAL.match(text)
    if m:
        frac = (m.group(3) or "")[:7].ljust(7, "0") if m.group(3) else ""
        return datetime.fromisoformat(f"{m.group(1)}T{m.group(2)}{frac}")
    if _DATE.match(text):
        return datetime.fromisoformat(text)
    raise ValueError(f"invalid time {text!r}: use ISO 8601, e.g. 2026-04-01T00:00:00Z or 2026-04-01")


def utc_literal(value: datetime, dtype: T.DataType | None = None) -> Column:
    """A UTC time (naive means UTC) as a literal: ``timestamp``, or
    ``timestamp_ntz`` where the compared column is one.  The zone travels with
    the value, so the driver's own time zone plays no part."""
    aware = value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(aware.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(aware)


def _int(text: str | None) -> int:
    """Integer parameter; anything unparsable is 0 (then normalised)."""
    try:
        return int(text or "")
    except ValueError:
        return 0


def _flag(text: str | None) -> bool:
    return (text or "").lower() == "true"


# Query parameter names of the customer list and their filter fields.
CUSTOMER_PARAMS = [
    ("search", "search"), ("region_code", "region_code"), ("region_name", "region_name"),
    ("district_code", "district_code"), ("district_name", "district_name"),
    ("service_type", "service_type"), ("service_class", "service_class"),
    ("service_point_number", "service_point_number"), ("customer_type", "customer_type"),
    ("contract_status", "contract_status"), ("cms_contract_status", "cms_contract_status"),
    ("meter_make", "meter_make"), ("meter_model", "meter_model"), ("account_type", "account_type"),
]


def customer_filter_from_query(params: dict[str, str]) -> CustomerFilter:
    """The customer list's query string as a filter (``has_*`` true only for 'true')."""
    return CustomerFilter(
        **{field: params.get(name, "") or "" for name, field in CUSTOMER_PARAMS},
        has_tamper=_flag(params.get("has_tamper")), has_coordinates=_flag(params.get("has_coordinates")),
        no_coordinates=_flag(params.get("no_coordinates")),
        page=_int(params.get("page")), page_size=_int(params.get("page_size")))


def no_coordinates_filter_from_query(params: dict[str, str]) -> CustomerFilter:
    """The no-coordinates route: same parameters, except ``no_coordinates`` is
    always on and ``has_coordinates`` / ``service_point_number`` are not read."""
    f = customer_filter_from_query(params)
    return replace(f, no_coordinates=True, has_coordinates=False, service_point_number="")


def event_filter_from_query(params: dict[str, str]) -> EventFilter:
    """The event routes' query string; a bad ``from``/``to`` raises ``ValueError``."""
    def when(name: str) -> datetime | None:
        raw = params.get(name) or ""
        return parse_query_time(raw) if raw else None
    return EventFilter(event_desc=params.get("event_desc", "") or "", event_code=params.get("event_code", "") or "",
                       from_=when("from"), to=when("to"), page=_int(params.get("page")),
                       page_size=_int(params.get("page_size")))
