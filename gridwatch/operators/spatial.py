"""Map layers and web-mercator tiling as Spark jobs.

The tile server of the source answers "which features are in tile z/x/y";
here that is a filter (one tile) or a grouped count (a whole zoom range),
both on native expressions, so tiles for every zoom are computed in one
distributed pass instead of one query per request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.functions.geo import (both_present, in_mercator, tile_bounds, tile_fraction_x,
                                    tile_fraction_y, tile_of_fraction, tile_x, tile_y)
from gridwatch.operators import summaries as S

# Zoom range of the map-view layer.
MAP_MIN_ZOOM, MAP_MAX_ZOOM = 5, 20

# Relations that have tiles.
TILE_SOURCES = ("customer_map_view", "CustomerRecords", "district_event_summary")

# Published properties of the map-view layer.
MAP_LAYER_PROPERTIES = [
    "ecgkey", "meternumber", "accountnumber", "fullname", "servicetype", "serviceclass",
    "contractstatus", "regioncode", "regionname", "districtcode", "districtname", "metermake",
    "metermodel", "has_any_coordinates", "latest_event_time", "latest_event_code",
    "latest_event_desc", "event_count",
]

# Published properties of the district layer.
DISTRICT_LAYER_PROPERTIES = [
    "districtcode", "districtname", "regionname", "total_meters", "meters_with_events",
    "meters_without_coordinates", "latest_event_time",
]


def customer_map_view(customers: DataFrame, meter_summary_df: DataFrame, swap: bool = False) -> DataFrame:
    """Plottable customers with their meter's summary.

    Geometry: the customer's own point, else the latest event's point when it
    has both coordinates.  The source builds the fallback as
    (x = event longitude column, y = event latitude column); ``swap=True``
    gives the orientation used for customer points instead.
    """
    keep = ["ecgkey", "meternumber", "accountnumber", "fullname", "servicetype", "serviceclass",
            "contractstatus", "cmscontractstatus", "regioncode", "regionname", "districtcode",
            "districtname", "metermake", "metermodel", "metertype"]
    carried = [c for c in ("has_any_coordinates", "geom_x", "geom_y", "latitude", "longitude")
               if c in customers.columns]
    have = set(customers.columns)
    base = customers.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in keep],
                            *carried)
    j = S.join_meter_summary(base, meter_summary_df,
                             S.summary_columns(customers, [
                                 "latest_event_time", "latest_event_code", "latest_event_desc",
                                 "latest_event_lat", "latest_event_lng", "event_count"]))
    j = S.ensure_flags_and_geom(j).withColumnsRenamed(
        {f"ms_{c}": c for c in ("latest_event_time", "latest_event_code", "latest_event_desc",
                                "latest_event_lat", "latest_event_lng")}
        | {"ms_event_count": "_ms_events"})
    keep = keep + ["has_any_coordinates"]
    ev_ok = both_present("latest_event_lat", "latest_event_lng")
    ex, ey = ("latest_event_lat", "latest_event_lng") if swap else ("latest_event_lng", "latest_event_lat")
    own = F.col("geom_x").isNotNull()
    return (j.filter(own | ev_ok)
            .select(*[c for c in keep if c not in ("geom_x", "geom_y")],
                    F.when(own, F.col("geom_x")).otherwise(F.when(ev_ok, F.col(ex))).alias("geom_x"),
                    F.when(own, F.col("geom_y")).otherwise(F.when(ev_ok, F.col(ey))).alias("geom_y"),
                    "latest_event_time", "latest_event_code", "latest_event_desc",
                    "latest_event_lat", "latest_event_lng",
                    F.coalesce(F.col("_ms_events"), F.lit(0)).cast("long").alias("event_count")))


def map_layer(view: DataFrame) -> DataFrame:
    """The map-view layer as published: properties plus the point."""
    return view.select(*MAP_LAYER_PROPERTIES, "geom_x", "geom_y")


def district_layer(des: DataFrame) -> DataFrame:
    """The district overview layer: published properties plus the centroid."""
    return des.select(*DISTRICT_LAYER_PROPERTIES, "geom_x", "geom_y")


def in_bbox(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float,
            x: str = "geom_x", y: str = "geom_y") -> DataFrame:
    """Points inside a lon/lat box (inclusive); plain range predicates, so
    Parquet statistics can skip row groups."""
    return df.filter(F.col(x).between(xmin, xmax) & F.col(y).between(ymin, ymax))


def with_tile(df: DataFrame, z: int, x: str = "geom_x", y: str = "geom_y") -> DataFrame:
    return df.withColumns({"tile_z": F.lit(z), "tile_x": tile_x(x, z), "tile_y": tile_y(y, z)})


def tile_features(df: DataFrame, z: int, tx: int, ty: int,
                  x: str = "geom_x", y: str = "geom_y") -> DataFrame:
    """Features of tile z/tx/ty (empty result = empty tile).

    A widened bounding box on the raw coordinates is applied first (it can
    reach the scan), then the exact tile test decides.
    """
    lon0, lat0, lon1, lat1 = tile_bounds(z, tx, ty)
    eps = 1e-9
    pre = in_bbox(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()),
                  lon0 - eps, lat0 - eps, lon1 + eps, lat1 + eps, x, y)
    return (pre.filter(in_mercator(y))
            .filter((tile_x(x, z) == tx) & (tile_y(y, z) == ty)))


def tile_of_source(source: str, layers: dict[str, DataFrame], z: int, tx: int, ty: int) -> DataFrame:
    """Features of a tile of one of the published relations, by its name in
    ``layers``.  Unknown names and, for the map view, zooms outside its range
    are errors."""
    if source not in TILE_SOURCES or source not in layers:
        raise ValueError(f"unknown tile source {source!r}")
    if source == TILE_SOURCES[0] and not MAP_MIN_ZOOM <= z <= MAP_MAX_ZOOM:
        raise ValueError(f"{source} has tiles for zoom {MAP_MIN_ZOOM} to {MAP_MAX_ZOOM}")
    return tile_features(layers[source], z, tx, ty)


def tile_index(df: DataFrame, zmin: int = MAP_MIN_ZOOM, zmax: int = MAP_MAX_ZOOM,
               x: str = "geom_x", y: str = "geom_y", weight: str | None = None) -> DataFrame:
    """Feature count (and optional weight sum) per tile for every zoom in
    [zmin, zmax].

    A tile's parent is its number shifted right, so points are counted once,
    in their tile at zmax; the coarser zooms add up those tiles.  Both counts
    are partially aggregated before the shuffle, so the one tile that holds
    every point at low zoom costs one row per input partition.
    """
    pts = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & in_mercator(y))
    at = [tile_of_fraction(tile_fraction_x(x), F.lit(zmax)).alias("_x"),
          tile_of_fraction(tile_fraction_y(y), F.lit(zmax)).alias("_y")]
    w = F.col(weight) if weight else F.lit(0)
    finest = (pts.select(*at, w.alias("_w")).groupBy("_x", "_y")
              .agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_w")))
    z = F.explode(F.sequence(F.lit(zmin), F.lit(zmax))).alias("tile_z")
    up = finest.select("*", z).select("tile_z", *[
        F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(zmax) - F.col("tile_z"))).cast("int").alias(name)
        for c, name in (("_x", "tile_x"), ("_y", "tile_y"))], "_n", "_w")
    aggs = [F.sum("_n").cast("long").alias("features")]
    if weight:
        aggs.append(F.sum("_w").cast("long").alias("weight"))
    return up.groupBy("tile_z", "tile_x", "tile_y").agg(*aggs)


# Features that a tile shows before it is split.
TILE_FEATURES = 1000


def tile_leaves(df: DataFrame, key: str = "ecgkey", zmin: int = MAP_MIN_ZOOM, zmax: int = MAP_MAX_ZOOM,
                most: int = TILE_FEATURES, x: str = "geom_x", y: str = "geom_y") -> DataFrame:
    """``(tile_z, tile_x, tile_y, key)``: every feature in the one tile that
    shows it.  A tile with more than ``most`` features is split into its four
    children, down to ``zmax``, whose tiles hold what they hold.

    Points are counted once, in their tile at ``zmax``; the counts of all
    coarser tiles are sums of these, and a finest tile's leaf is its first
    ancestor that is small enough.  Features then look up their finest tile's
    leaf: one join, whatever the depth, and a crowded tile stays rows.
    """
    pts = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & in_mercator(y)).select(
        key, tile_of_fraction(tile_fraction_x(x), F.lit(zmax)).alias("_x"), tile_of_fraction(tile_fraction_y(y), F.lit(zmax)).alias("_y"))
    finest = pts.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    up = finest.withColumn("tile_z", F.explode(F.sequence(F.lit(zmin), F.lit(zmax))))
    parent = [F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(zmax) - F.col("tile_z"))).cast("int").alias(n) for c, n in (("_x", "tile_x"), ("_y", "tile_y"))]
    up = up.select("_x", "_y", "_n", "tile_z", *parent)
    counts = up.groupBy("tile_z", "tile_x", "tile_y").agg(F.sum("_n").alias("_all"))
    fits = up.join(counts, ["tile_z", "tile_x", "tile_y"]).filter((F.col("_all") <= most) | (F.col("tile_z") == zmax))
    leaf = fits.groupBy("_x", "_y").agg(F.min(F.struct("tile_z", "tile_x", "tile_y")).alias("_leaf"))
    return pts.join(leaf, ["_x", "_y"]).select("_leaf.*", key)


def write_tile_index(index: DataFrame, path: str) -> None:
    """Persist a tile index partitioned by zoom, so a viewer reads one zoom."""
    index.write.mode("overwrite").partitionBy("tile_z").parquet(path)


# Zoom whose tile numbers cluster stored layers (about 10 km tiles).
CLUSTER_ZOOM = 12


def write_spatial_layer(layer: DataFrame, path: str, zoom: int = CLUSTER_ZOOM,
                        tie_break: str = "ecgkey", partitions: int | None = None) -> None:
    """Store a point layer clustered by tile, so bounding-box and tile reads
    skip row groups through Parquet min/max statistics on ``geom_x/geom_y``.

    Range partitioning on (tile, tie_break) keeps nearby points in the same
    files; the tie-break column lets the sampler split one crowded tile over
    several partitions instead of one task.
    """
    keyed = layer.withColumns({"cluster_x": tile_x("geom_x", zoom), "cluster_y": tile_y("geom_y", zoom)})
    parts = partitions or int(layer.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (keyed.repartitionByRange(parts, "cluster_y", "cluster_x", tie_break)
     .sortWithinPartitions("cluster_y", "cluster_x", "geom_y", "geom_x")
     .write.mode("overwrite").parquet(path))
