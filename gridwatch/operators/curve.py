"""Point layers stored along a space-filling curve, with a manifest of files.

A point's key interleaves the bits of its longitude and latitude cell (Morton
order), so a square of cells at any level is one range of keys.  Files hold
consecutive keys, and the manifest keeps every file's least and greatest key.
A box is cut into a few key ranges; only files whose keys meet one of them are
named to the reader, so the others are not even listed or opened.  Inside the
files, row groups are skipped by their statistics, and the exact predicate
decides.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwatch.operators.spatial import in_bbox

#: Bits per axis of the key: cells of 360 / 2**16 degrees (some 600 m).
BITS = 16
KEY = "curve_key"
#: Ranges that a box is cut into at most.
RANGES = 64
#: Where the manifest lies; readers of the layer skip names that begin so.
MANIFEST = "_manifest"
#: Masks that spread 16 bits to every other place.
_SPREAD = [(8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)]


def _cell(value: Column, low: float, width: float) -> Column:
    """Cell number of a coordinate, clamped to the axis (NaN: the last cell)."""
    n = 1 << BITS
    at = F.greatest(F.least((value - low) / width * n, F.lit(n - 1.0)), F.lit(0.0))
    return F.floor(at).cast("long")


def _spread(c: Column) -> Column:
    for shift, mask in _SPREAD:
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def curve_key(x: Column | str, y: Column | str) -> Column:
    """Morton key of a longitude and latitude; null unless both are present."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    key = _spread(_cell(x, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread(_cell(y, -90.0, 180.0)), 1))
    return F.when(x.isNotNull() & y.isNotNull(), key)


def interleave(cx: int, cy: int) -> int:
    """The key of a cell, as ``curve_key`` computes it."""
    return sum((cx >> b & 1) << 2 * b | (cy >> b & 1) << 2 * b + 1 for b in range(BITS))


def box_ranges(xmin: float, ymin: float, xmax: float, ymax: float, most: int = RANGES) -> list[tuple[int, int]]:
    """Key ranges (inclusive) that hold every point of the box, ``most`` at
    most: squares that the box cuts are quartered, largest first, while the
    number allows.  Some points outside the box may lie in them."""
    n = 1 << BITS

    def cell(v: float, low: float, width: float) -> int:
        return int(max(0.0, min((v - low) / width * n, n - 1.0)))

    if xmin > xmax or ymin > ymax:
        return []
    x0, x1, y0, y1 = cell(xmin, -180, 360), cell(xmax, -180, 360), cell(ymin, -90, 180), cell(ymax, -90, 180)
    done: list[tuple[int, int]] = []
    todo = [(-BITS, 0, 0)]                            # largest square first

    def keys(level: int, cx: int, cy: int) -> tuple[int, int]:
        low = interleave(cx << level, cy << level)
        return low, low + (1 << 2 * level) - 1

    while todo and len(done) + len(todo) + 3 <= most:
        minus, cx, cy = heapq.heappop(todo)
        level = -minus
        left, low, right, up = cx << level, cy << level, (cx + 1 << level) - 1, (cy + 1 << level) - 1
        if x0 <= left and right <= x1 and y0 <= low and up <= y1 or level == 0:
            done.append(keys(level, cx, cy))
            continue
        for kx, ky in ((2 * cx + a, 2 * cy + b) for a in (0, 1) for b in (0, 1)):
            size = level - 1
            if kx << size <= x1 and (kx + 1 << size) - 1 >= x0 and ky << size <= y1 and (ky + 1 << size) - 1 >= y0:
                heapq.heappush(todo, (-size, kx, ky))
    merged: list[tuple[int, int]] = []
    for low, high in sorted(done + [keys(-m, cx, cy) for m, cx, cy in todo]):
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = merged[-1][0], max(high, merged[-1][1])
        else:
            merged.append((low, high))
    return merged


def write_curve_layer(layer: DataFrame, path: str, x: str = "geom_x", y: str = "geom_y", tie_break: str = "ecgkey",
                      files: int | None = None) -> None:
    """Store a point layer in key order and its manifest.  A cell that holds
    very many points is split over files by ``tie_break``.  Points without
    coordinates are stored in the first files and belong to no range."""
    parts = files or int(layer.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (layer.withColumn(KEY, curve_key(x, y)).repartitionByRange(parts, KEY, tie_break)
     .sortWithinPartitions(KEY, tie_break).write.mode("overwrite").parquet(path))
    stored = layer.sparkSession.read.parquet(path)
    (stored.groupBy(F.col("_metadata.file_name").alias("file"))
     .agg(F.min(KEY).alias("low"), F.max(KEY).alias("high"), F.count("*").alias("points"))
     .write.mode("overwrite").parquet(f"{path}/{MANIFEST}"))


def _in_ranges(ranges: list[tuple[int, int]], low: Column, high: Column) -> Column:
    hit = F.lit(False)
    for a, b in ranges:
        hit = hit | ((low <= b) & (high >= a))
    return hit


def files_for(spark: SparkSession, path: str, ranges: list[tuple[int, int]]) -> list[str]:
    """Names of the layer's files that hold keys of the ranges."""
    manifest = spark.read.parquet(f"{path}/{MANIFEST}")
    return [r["file"] for r in manifest.filter(_in_ranges(ranges, F.col("low"), F.col("high"))).select("file").sort("file").collect()]


def read_box(spark: SparkSession, path: str, xmin: float, ymin: float, xmax: float, ymax: float,
             x: str = "geom_x", y: str = "geom_y") -> DataFrame:
    """Points of a stored layer inside a box (inclusive)."""
    ranges = box_ranges(xmin, ymin, xmax, ymax)
    names = files_for(spark, path, ranges)
    if not names:
        return spark.read.parquet(path).drop(KEY).limit(0)
    rows = spark.read.parquet(*[f"{path}/{n}" for n in names])
    rows = rows.filter(_in_ranges(ranges, F.col(KEY), F.col(KEY)))
    return in_bbox(rows, xmin, ymin, xmax, ymax, x, y).drop(KEY)
