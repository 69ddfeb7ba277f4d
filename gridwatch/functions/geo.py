"""Point and web-mercator tile expressions (all native Spark expressions)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: latitude limit of the square web-mercator world.
MERCATOR_MAX_LAT = 85.0511287798066


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def both_present(a: Column | str, b: Column | str) -> Column:
    return _c(a).isNotNull() & _c(b).isNotNull()


def point(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    """A point as two columns; NULL unless both coordinates are present."""
    ok = both_present(x, y)
    return F.when(ok, _c(x)), F.when(ok, _c(y))


def tile_fraction_x(lon: Column | str) -> Column:
    """Position across the web-mercator world, 0 at 180°W to 1 at 180°E."""
    return (_c(lon) + 180.0) / 360.0


def tile_fraction_y(lat: Column | str) -> Column:
    """Position down the web-mercator world, 0 at the north edge to 1 at the south."""
    phi = F.radians(_c(lat))
    merc = F.log(F.tan(phi) + 1.0 / F.cos(phi))
    return (1.0 - merc / math.pi) / 2.0


def tile_of_fraction(frac: Column, z: Column | int) -> Column:
    """Tile number at zoom ``z`` of a world fraction (edges clamp into range)."""
    n = F.pow(F.lit(2.0), z if isinstance(z, Column) else F.lit(z))
    raw = F.floor(frac * n)
    return F.least(F.greatest(raw, F.lit(0)), (n - 1).cast("long")).cast("int")


def tile_x(lon: Column | str, z: Column | int) -> Column:
    return tile_of_fraction(tile_fraction_x(lon), z)


def tile_y(lat: Column | str, z: Column | int) -> Column:
    return tile_of_fraction(tile_fraction_y(lat), z)


def in_mercator(lat: Column | str) -> Column:
    return F.abs(_c(lat)) <= MERCATOR_MAX_LAT


def tile_bounds(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """(lon_min, lat_min, lon_max, lat_max) of tile z/x/y."""
    n = 2.0 ** z

    def lat_of(yy: float) -> float:
        return math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * yy / n))))

    return x / n * 360.0 - 180.0, lat_of(y + 1), (x + 1) / n * 360.0 - 180.0, lat_of(y)
