"""SQL surface: the derived relations as temporary views.

The source serves its map layer and account roll-up as SQL views; here the
same relations are registered as session views over the DataFrame
operators, so they can be queried with ``spark.sql`` (Catalyst plans both
forms the same way).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridwatch.operators import dashboards as D
from gridwatch.operators import spatial as K
from gridwatch.operators import summaries as S

# View names.
VIEWS = ["customer_records", "tamper_events", "meter_summary", "district_event_summary",
         "customer_map_view", "account_meters"]


def register_views(customers: DataFrame, events: DataFrame, prefix: str = "") -> dict[str, DataFrame]:
    """Register the base and derived relations as temporary views.

    ``customer_records`` carries the coordinate flags and geometry (the
    refresh's 'latest' rule); the summaries and views are built on it.
    """
    ms = S.meter_summary(events, customers)
    records = S.with_geom(S.with_coordinate_flags(customers, ms, "latest"))
    frames = {
        "customer_records": records,
        "tamper_events": events,
        "meter_summary": ms,
        "district_event_summary": S.district_event_summary(records, ms),
        "customer_map_view": K.customer_map_view(records, ms),
        "account_meters": D.account_meters(records, ms),
    }
    for name, df in frames.items():
        df.createOrReplaceTempView(prefix + name)
    return frames
