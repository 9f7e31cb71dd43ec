"""Coordinate algebra as Column expressions: metres (EPSG:3857), common space, mercator, degrees, unit sphere.

Common space is [0, 512] squared with y to the north, mercator [0, 1] squared with y to the south.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEMI_MAJOR = 6378137.0
WORLD = 2 * math.pi * SEMI_MAJOR
EARTH = 40075016.686
MAX_LAT = 85.05112877980659
COMMON = 512.0

Pair = tuple[Column, Column]


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v))


def common_from_metres(x: Column, y: Column) -> Pair:
    return (x / WORLD + 0.5) * COMMON, (clamp(y, -WORLD / 2, WORLD / 2) / WORLD + 0.5) * COMMON


def metres_from_common(x: Column, y: Column) -> Pair:
    return (x / COMMON - 0.5) * WORLD, (y / COMMON - 0.5) * WORLD


def mercator_from_metres(x: Column, y: Column) -> Pair:
    return x / WORLD + 0.5, F.lit(0.5) - clamp(y, -WORLD / 2, WORLD / 2) / WORLD


def metres_from_mercator(x: Column, y: Column) -> Pair:
    return (x - 0.5) * WORLD, (F.lit(0.5) - y) * WORLD


def _log_tan(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(clamp(lat, -MAX_LAT, MAX_LAT)) / 2))


def mercator_from_lnglat(lng: Column, lat: Column) -> Pair:
    return (lng + 180) / 360, F.lit(0.5) - _log_tan(lat) / (2 * math.pi)


def common_from_lnglat(lng: Column, lat: Column) -> Pair:
    return (lng + 180) / 360 * COMMON, (_log_tan(lat) + math.pi) / (2 * math.pi) * COMMON


def metres_from_lnglat(lng: Column, lat: Column) -> Pair:
    return lng / 360 * WORLD, _log_tan(lat) / (2 * math.pi) * WORLD


def lnglat_from_common(x: Column, y: Column) -> Pair:
    return x / COMMON * 360 - 180, F.degrees(2 * F.atan(F.exp(y / COMMON * 2 * math.pi - math.pi)) - math.pi / 2)


def sphere_from_mercator(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Unit sphere: (lng 0, lat 0) at (0, 0, 1), the north pole at y = 1."""
    turn, t = x * (2 * math.pi) + math.pi, F.exp(F.lit(math.pi) - y * (2 * math.pi))
    up, flat = (t * t - 1) / (t * t + 1), 2 * t / (t * t + 1)
    return F.sin(turn) * flat, up, F.cos(turn) * flat


def horizon_plane(plane: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """A clipping plane with a unit normal; a degenerate one is an error."""
    length = math.hypot(*plane[:3])
    if not math.isfinite(length) or length == 0:
        raise ValueError("a clipping plane needs a normal")
    return tuple(v / length for v in plane)


def split_double(v: Column) -> Pair:
    """High and low single-precision parts of a double."""
    high = v.cast("float")
    return high, (v - high.cast("double")).cast("float")


def relative_to_centre(high: Column, low: Column, centre_high: Column, centre_low: Column) -> Column:
    return ((high - centre_high).cast("float") + (low - centre_low).cast("float")).cast("float")


def units_per_metre(lat: Column) -> Column:
    return F.lit(COMMON) / (F.cos(F.radians(clamp(lat, -89, 89))) * EARTH)


def metres_per_pixel(lat: Column, zoom: Column) -> Column:
    return F.lit(EARTH) * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), zoom + 9)


def bilerp(corners: list[Column], u: Column | float, v: Column | float) -> Column:
    """Bilinear blend of top left, top right, bottom left, bottom right."""
    tl, tr, bl, br = corners
    top, low = tl + (tr - tl) * u, bl + (br - bl) * u
    return top + (low - top) * v


def box_of(xs: list[Column], ys: list[Column]) -> tuple[Column, Column, Column, Column]:
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def shift_matrix(m: Column, x: Column, y: Column) -> Column:
    """A column-major 4x4 matrix times a translation by (x, y, 0), in single precision."""
    def at(i: Column) -> Column:
        moved = F.get(m, i - 12) * x + F.get(m, i - 8) * y + F.get(m, i)
        return F.when(i >= 12, moved).otherwise(F.get(m, i)).cast("float")

    return F.transform(F.sequence(F.lit(0), F.lit(15)), at)
