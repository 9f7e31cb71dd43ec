"""Tile selection: which tiles at which level a view needs.

One step a level: filter the frontier by bounds, frustum and level of detail,
keep what is good enough, turn the rest into children on generated keys. Levels are
broadcast, as a dataset has few; views stay distributed, dealt by frame once, and so are the tiles of every
level. What doesn't depend on a view is computed once a tile for levels of up to MOST_TILES tiles, and broadcast; for
others once a tile and view. Results
are sets of (z, x, y). The number of levels is small and known, so the plan has a fixed depth.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import affine, spaces
from ..functions.barrier import computed

MOST_ROOTS = 100
MOST_TILES = 4096
MAX_SPAN, LEAST_FORESHORTENING = 30.0, 0.05
# Reference points of a tile, its centre first.
REFERENCE = [(0.5, 0.5), (0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.5), (0.5, 0.0), (1.0, 0.5), (0.5, 1.0)]
CULL_BOX = ("cx0", "cy0", "cx1", "cy1")

Projection = Callable[[Column, Column], spaces.Pair]


def identity(x: Column, y: Column) -> spaces.Pair:
    return x, y


def pair(p: spaces.Pair) -> Column:
    return F.struct(p[0].alias("x"), p[1].alias("y"))


def with_reference_points(tiles: DataFrame, to_metres: Projection) -> DataFrame:
    """tiles with `metres` and `common`, the reference points in either space, as arrays of (x, y)."""
    df = computed(tiles, {"corners": F.array(*[pair(c) for c in affine.tile_corners(F.col("x"), F.col("y"))])})
    grid = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in REFERENCE])
    at = lambda axis, p: spaces.bilerp([F.col("corners")[i][axis] for i in range(4)], p["u"], p["v"])
    df = computed(df, {"metres": F.transform(grid, lambda p: pair(to_metres(at("x", p), at("y", p))))}).drop("corners")
    return computed(df, {"common": F.transform("metres", lambda m: pair(spaces.common_from_metres(m["x"], m["y"])))})


def with_volume(tiles: DataFrame, globe: bool, to_metres: Projection = identity, low: float = 0.0, high: float = 0.0) -> DataFrame:
    """Common-space box, hull points (NULL: always visible) and the sphere centre of each tile."""
    df = with_reference_points(tiles, to_metres)
    axis = lambda a: F.transform("common", lambda p: p[a])
    df = computed(df, {"cx0": F.array_min(axis("x")), "cy0": F.array_min(axis("y")), "cx1": F.array_max(axis("x")), "cy1": F.array_max(axis("y"))})
    point = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    at_height = lambda h: lambda p: point(p["x"], p["y"], h)
    out_to = lambda r: lambda p: point(p["x"] * r, p["y"] * r, p["z"] * r)
    if not globe:
        heights = [low] if low == high else [low, high]
        hull = F.flatten(F.array(*[F.transform("common", at_height(F.lit(float(h)))) for h in heights]))
        return computed(df, {"hull": hull, "centre": F.lit(None).cast("struct<x:double,y:double,z:double>")}).drop("metres", "common")
    df = computed(df, {"sphere": F.transform("metres", lambda m: point(*spaces.sphere_from_mercator(*spaces.mercator_from_metres(m["x"], m["y"]))))})
    west, south = spaces.lnglat_from_common(F.col("cx0"), F.col("cy0"))
    east, north = spaces.lnglat_from_common(F.col("cx1"), F.col("cy1"))
    df = computed(df, {"span": F.greatest(east - west, north - south)})
    outer = (1 + high) / F.cos(F.radians(F.col("span")) / 4)
    hull = F.flatten(F.array(*[F.transform("sphere", out_to(r)) for r in (F.lit(1.0 + low), outer)]))
    small = F.col("span") <= MAX_SPAN
    return computed(df, {"hull": F.when(small, hull), "centre": F.when(small, F.get("sphere", F.lit(0)))}).drop("span", "sphere", "metres", "common")


def overlaps(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Strict overlap of boxes: touching ones don't."""
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


def in_frustum(hull: Column, planes: Column) -> Column:
    """Not wholly outside any plane; no hull is visible."""
    outside = F.exists(planes, lambda p: F.forall(hull, lambda q: p["nx"] * q["x"] + p["ny"] * q["y"] + p["nz"] * q["z"] + p["d"] < 0))
    return hull.isNull() | ~outside


def metres_per_css_pixel(globe: bool) -> Column:
    """At the tile's centre on a flat map; at the map's centre, foreshortened, on a globe."""
    _, lat = spaces.lnglat_from_common((F.col("cx0") + F.col("cx1")) / 2, (F.col("cy0") + F.col("cy1")) / 2)
    if not globe:
        return spaces.metres_per_pixel(lat, F.col("zoom"))
    cam = F.col("camera")
    facing = F.col("centre.x") * cam[0] + F.col("centre.y") * cam[1] + F.col("centre.z") * cam[2]
    return spaces.metres_per_pixel(F.col("lat"), F.col("zoom")) / F.when(F.col("centre").isNull(), 1.0).otherwise(F.greatest(facing, F.lit(LEAST_FORESHORTENING)))


def fine_enough(mpp: Column, css: Column, pixel_ratio: Column, lod_bias: float = 0.0) -> Column:
    return mpp * pixel_ratio / css <= 2.0**lod_bias


def roots(levels: DataFrame, view: DataFrame, bounds: tuple[float, float, float, float] | None = None, from_lnglat: Projection = spaces.metres_from_lnglat) -> DataFrame:
    """Tiles of level 0: all of a small matrix, else those where the view meets the dataset's bounds (degrees)."""
    top = view.select("frame", "west", "south", "east", "north").crossJoin(F.broadcast(levels.filter("z = 0")))  # a dataset has one level 0
    few = F.col("matrix_w") * F.col("matrix_h") <= MOST_ROOTS
    b = [F.lit(float(v)) for v in (bounds or (-180.0, -spaces.MAX_LAT, 180.0, spaces.MAX_LAT))]
    cut = [F.greatest(b[0], F.col("west")), F.greatest(b[1], F.col("south")), F.least(b[2], F.col("east")), F.least(b[3], F.col("north"))]
    (x0, y0), (x1, y1) = from_lnglat(cut[0], cut[1]), from_lnglat(cut[2], cut[3])
    found = affine.tile_range((x0, y0, x1, y1))
    meets = (cut[0] <= cut[2]) & (cut[1] <= cut[3])
    zero, last = F.lit(0).cast("bigint"), {"max_col": F.col("matrix_w") - 1, "max_row": F.col("matrix_h") - 1}
    ends = {k: F.when(few, last[k].cast("bigint") if k in last else zero).when(meets, v).otherwise(F.lit(-1).cast("bigint") if k in last else zero) for k, v in found.items()}
    return affine.exploded(top.withColumns(ends)).select("frame", "z", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


def children(tiles: DataFrame, levels: DataFrame) -> DataFrame:
    """(frame, z + 1, x, y) of the tiles in the next level that each tile's CRS box meets, as a set."""
    own = tiles.join(F.broadcast(levels), "z")
    corners = affine.tile_corners(F.col("x"), F.col("y"))
    box = spaces.box_of([x for x, _ in corners], [y for _, y in corners])
    boxed = computed(own.withColumn("z", (F.col("z") + 1).cast("int")), dict(zip(("bx0", "by0", "bx1", "by1"), box, strict=True)), ["frame", "z"])
    ranges = boxed.join(F.broadcast(levels), "z")
    ranges = computed(ranges, affine.tile_range(tuple(F.col(n) for n in ("bx0", "by0", "bx1", "by1")))).select("frame", "z", "min_col", "max_col", "min_row", "max_row")
    return affine.exploded(ranges).select("frame", "z", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()


def whole_level(levels: DataFrame, z: int) -> DataFrame:
    """All tiles of a level, with its facts."""
    zero = F.lit(0).cast("bigint")
    ends = {"min_col": zero, "min_row": zero, "max_col": (F.col("matrix_w") - 1).cast("bigint"), "max_row": (F.col("matrix_h") - 1).cast("bigint")}
    return affine.exploded(levels.filter(F.col("z") == z).withColumns(ends)).withColumns({c: F.col(c).cast("int") for c in "xy"})


def select_tiles(levels: DataFrame, view: DataFrame, globe: bool = False, depth: int = 1, max_z: int | None = None, lod_bias: float = 0.0, bounds: tuple[float, ...] | None = None, box: tuple[float, ...] | None = None, to_metres: Projection = identity, from_lnglat: Projection = spaces.metres_from_lnglat, low: float = 0.0, high: float = 0.0) -> DataFrame:
    """(frame, z, x, y) to draw; levels carry level facts (affine.with_level_facts), depth is their number.

    box: common-space bounds that tiles must overlap.
    """
    last = depth - 1 if max_z is None else max_z
    few = {r["z"] for r in levels.filter(F.col("matrix_w").cast("bigint") * F.col("matrix_h") <= MOST_TILES).select("z").collect()}
    view = view.repartition("frame")
    frontier, chosen = roots(levels, view, bounds, from_lnglat), None
    for z in range(depth):
        seen = frontier.join(view, "frame")
        if z in few:
            own = with_volume(whole_level(levels, z), globe, to_metres, low, high).select("z", "x", "y", "mpp", *CULL_BOX, "hull", "centre")
            seen = seen.join(F.broadcast(own), ["z", "x", "y"])
        else:
            seen = with_volume(seen.join(F.broadcast(levels), "z"), globe, to_metres, low, high)
        if box is not None:
            seen = seen.filter(overlaps(tuple(F.lit(float(v)) for v in box), tuple(F.col(c) for c in CULL_BOX)))
        seen = seen.filter(in_frustum(F.col("hull"), F.col("planes")))
        done = F.lit(True) if z >= last else fine_enough(F.col("mpp"), metres_per_css_pixel(globe), F.col("pixel_ratio"), lod_bias)
        seen = computed(seen, {"done": done}, ["frame", "z", "x", "y"])
        part = seen.filter("done").select("frame", "z", "x", "y").distinct()
        chosen = part if chosen is None else chosen.unionByName(part)
        if z >= last or z == depth - 1:
            break
        rest = seen.filter("not done").select("frame", "z", "x", "y")
        frontier = children(rest, levels).repartition("frame")  # rows stay where they are; what reads them twice computes them once
    return chosen


def elevation_range(z_range: tuple[float, float] | None, units: float) -> tuple[float, float]:
    return tuple((v * units) if v else 0.0 for v in (z_range or (0.0, 0.0)))


def elevation_columns(low: Column, high: Column, units: Column) -> spaces.Pair:
    """The same for columns; NULL is 0."""
    return F.coalesce(low * units, F.lit(0.0)), F.coalesce(high * units, F.lit(0.0))


def swept(cache: DataFrame, size: int) -> DataFrame:
    """What stays of a cache (key, touched) beyond its size: the newest floor(size / 2) entries."""
    return cache if cache.count() <= size else cache.orderBy(F.desc("touched"), F.desc("key")).limit(math.floor(size / 2))
