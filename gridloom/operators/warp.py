"""Warps by exact inverse projection: which source pixel a target point shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import affine, spaces
from ..functions.barrier import computed
from . import sampling
from .halo import tile_keys


def mercator_of(col: Column, row: Column, px: Column, py: Column, to_metres) -> spaces.Pair:
    """Mercator position of a pixel in a tile: tile to CRS, CRS to metres, metres to mercator."""
    forward, _ = affine.tile_transform(col, row)
    return spaces.mercator_from_metres(*to_metres(*affine.apply(forward, px, py)))


def pixel_of(mx: Column, my: Column, from_lnglat) -> spaces.Pair:
    """Level pixel that a mercator position shows."""
    lng, lat = spaces.lnglat_from_common(mx * spaces.COMMON, (1 - my) * spaces.COMMON)
    return affine.apply(affine.inverse(affine.of()), *from_lnglat(lng, lat))


def corner_latitudes(col: Column, row: Column, to_metres) -> dict[str, Column]:
    """Latitudes of the decoded tile's corners: edge tiles end where the image does."""
    x0, y0 = col * F.col("tile_w"), row * F.col("tile_h")
    x1, y1 = F.least(x0 + F.col("tile_w"), F.col("array_w")), F.least(y0 + F.col("tile_h"), F.col("array_h"))
    out = {}
    for name, x, y in (("lat_tl", x0, y0), ("lat_tr", x1, y0), ("lat_bl", x0, y1), ("lat_br", x1, y1)):
        metres = to_metres(*affine.apply(affine.of(), x, y))
        out[name] = spaces.lnglat_from_common(*spaces.common_from_metres(*metres))[1]
    return out


def located(points: DataFrame, levels: DataFrame, z: int, from_lnglat) -> DataFrame:
    """points (mx, my) with the level's tile (z, x, y) that shows them, and the place in it (u, v in [0, 1]); none outside."""
    at = points.crossJoin(F.broadcast(levels.filter(F.col("z") == z)))  # one level
    px, py = pixel_of(F.col("mx"), F.col("my"), from_lnglat)
    at = computed(at, {"px": px, "py": py})
    at = at.filter((F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") < F.col("array_w")) & (F.col("py") < F.col("array_h")))
    x, y = F.floor(F.col("px") / F.col("tile_w")).cast("int"), F.floor(F.col("py") / F.col("tile_h")).cast("int")
    at = computed(at, {"x": x, "y": y}, [*points.columns, "z", "px", "py", "tile_w", "tile_h", "array_w", "array_h"])
    wide = F.least(F.col("tile_w"), F.col("array_w") - F.col("x") * F.col("tile_w"))
    high = F.least(F.col("tile_h"), F.col("array_h") - F.col("y") * F.col("tile_h"))
    u, v = (F.col("px") - F.col("x") * F.col("tile_w")) / wide, (F.col("py") - F.col("y") * F.col("tile_h")) / high
    return computed(at, {"u": u, "v": v}, [*points.columns, "z", "x", "y"])


def warped(points: DataFrame, levels: DataFrame, tiles: DataFrame, z: int, from_lnglat, how: str = "nearest", nodata: float | None = None) -> DataFrame:
    """points (mx, my) with the value that the raster shows there; an equi-join on tiles. how: nearest, or bilinear over `padded` tiles."""
    found = located(points, levels, z, from_lnglat)
    keys = [k for k in tile_keys(tiles) if k in found.columns]
    both = found.join(tiles, keys)
    if how == "nearest":
        s = sampling.nearest(F.col("plane"), F.col("u"), F.col("v"), F.col("width"), F.col("height"), nodata)
    else:
        s = sampling.bilinear(F.col("padded"), F.col("u"), F.col("v"), F.col("width"), F.col("height"), nodata, halo=1)
    return computed(both, {"value": s["value"]}, points.columns)
