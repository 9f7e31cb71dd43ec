"""Viewports: small matrices and planes on the driver, one row a frame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spaces

SCHEMA = "frame bigint, projection string, zoom double, lng double, lat double, planes array<struct<nx:double,ny:double,nz:double,d:double>>, west double, south double, east double, north double, units_per_meter double, pixel_ratio double, camera array<double>"


def frustum_planes(matrix, sides_only: bool = False) -> list[tuple[float, float, float, float]]:
    """Planes of a column-major 4x4 clip matrix with unit normals that face inward; degenerate ones are left out."""
    m = np.asarray(matrix, float).reshape(4, 4).T
    rows = [m[3] + s * m[i] for i in range(2 if sides_only else 3) for s in (1, -1)]
    out = []
    for r in rows:
        length = float(np.linalg.norm(r[:3]))
        if length > 0 and np.isfinite(length):
            out.append(tuple(float(v) for v in r / length))
    return out


def clip_from_common(mercator_matrix) -> np.ndarray:
    """Clip matrix for common space, given the one for mercator: divide by 512 and turn y over."""
    turn = np.diag([1 / spaces.COMMON, -1 / spaces.COMMON, 1 / spaces.COMMON, 1.0])
    turn[1, 3] = 1.0
    return (np.asarray(mercator_matrix, float).reshape(4, 4).T @ turn).T.ravel()


def pixel_ratio(buffer_width: float, css_width: float) -> float:
    return buffer_width / css_width if css_width else 1.0


def projection_of(variant: str | None) -> str | None:
    """mercator or globe from a shader variant's name."""
    return None if not variant else "globe" if "globe" in variant else "mercator" if "mercator" in variant else None


def viewport(spark: SparkSession, frame: int, projection: str, zoom: float, lng: float, lat: float, planes, bounds, ratio: float = 1.0, units: float | None = None, camera=None) -> DataFrame:
    """One viewport row; a globe's clipping plane is normalised and joins the side planes."""
    import math

    own = [tuple(float(v) for v in p) for p in planes]
    if units is None:
        units = spaces.COMMON / (math.cos(math.radians(max(-89.0, min(89.0, lat)))) * spaces.EARTH)
    row = (frame, projection, float(zoom), float(lng), float(lat), own, *map(float, bounds), float(units), float(ratio), None if camera is None else [float(c) for c in camera])
    return spark.createDataFrame([row], SCHEMA)


def raster_viewport(spark: SparkSession, frame: int, projection: str, mercator_matrix, zoom: float, lng: float, lat: float, bounds, ratio: float = 1.0, clipping_plane=None, camera=None) -> DataFrame:
    """A viewport row from the map's own matrix: six planes in common space, or on a globe the four sides and the horizon."""
    if projection == "globe":
        planes = frustum_planes(mercator_matrix, sides_only=True) + [spaces.horizon_plane(clipping_plane)]
        return viewport(spark, frame, projection, zoom, lng, lat, planes, bounds, ratio, camera=camera)
    if projection != "mercator":
        raise ValueError(f"unknown projection {projection!r}")
    return viewport(spark, frame, projection, zoom, lng, lat, frustum_planes(clip_from_common(mercator_matrix)), bounds, ratio)


def drawing_ratio(buffer_width: Column, css_width: Column) -> Column:
    """Buffer pixels for each CSS pixel; 1 where the width is 0."""
    return F.when(css_width == 0, F.lit(1.0)).otherwise(buffer_width / F.nullif(css_width, F.lit(0)))


def variant_projection(variant: Column) -> Column:
    """mercator or globe from a shader variant's name; NULL for others."""
    return F.when(F.contains(variant, F.lit("globe")), "globe").when(F.contains(variant, F.lit("mercator")), "mercator")


def frame_constants(views: DataFrame, opacity: float = 1.0) -> DataFrame:
    """views with a frame's constants: opacity, and the centre in mercator split into two singles."""
    from .options import check_opacity

    mx, my = spaces.mercator_from_lnglat(F.col("lng"), F.col("lat"))
    (hx, lx), (hy, ly) = spaces.split_double(mx), spaces.split_double(my)
    return views.withColumns({"opacity": F.lit(check_opacity(opacity)), "origin_hi_x": hx, "origin_hi_y": hy, "origin_lo_x": lx, "origin_lo_y": ly})
