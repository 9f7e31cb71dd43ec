"""Affine tile grids as Column expressions. A level has a..f (X = a col + b row + c, Y = d col + e row + f),
array_w, array_h, tile_w, tile_h and mpu."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spaces

Affine = tuple[Column, Column, Column, Column, Column, Column]


def of(*names: str) -> Affine:
    return tuple(F.col(n) for n in (names or "abcdef"))


def apply(m: Affine, x: Column, y: Column) -> spaces.Pair:
    a, b, c, d, e, f = m
    return a * x + b * y + c, d * x + e * y + f


def inverse(m: Affine) -> Affine:
    a, b, c, d, e, f = m
    det = a * e - b * d
    return e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det


def shifted(m: Affine, x: Column, y: Column) -> Affine:
    a, b, _, d, e, _ = m
    c, f = apply(m, x, y)
    return a, b, c, d, e, f


def with_level_facts(levels: DataFrame) -> DataFrame:
    """matrix_w, matrix_h, mpp, and the level's box min_x..max_y."""
    m, zero = of(), F.lit(0.0)
    corners = [apply(m, x, y) for x in (zero, F.col("array_w")) for y in (zero, F.col("array_h"))]
    box = spaces.box_of([x for x, _ in corners], [y for _, y in corners])
    return levels.withColumns(
        {
            "matrix_w": F.ceil(F.col("array_w") / F.col("tile_w")).cast("int"),
            "matrix_h": F.ceil(F.col("array_h") / F.col("tile_h")).cast("int"),
            "mpp": F.sqrt(F.abs(F.col("a") * F.col("e"))) * F.col("mpu"),
        }
        | dict(zip(("min_x", "min_y", "max_x", "max_y"), box, strict=True))
    )


def tile_corners(col: Column, row: Column, m: Affine | None = None) -> list[spaces.Pair]:
    """Top left, top right, bottom left, bottom right of the nominal tile; edge tiles aren't clipped."""
    w, h = F.col("tile_w"), F.col("tile_h")
    return [apply(m or of(), (col + i) * w, (row + j) * h) for j in (0, 1) for i in (0, 1)]


def tile_transform(col: Column, row: Column, m: Affine | None = None) -> tuple[Affine, Affine]:
    """Pixel in tile -> CRS, and back."""
    forward = shifted(m or of(), col * F.col("tile_w"), row * F.col("tile_h"))
    return forward, inverse(forward)


def tile_range(box: tuple[Column, Column, Column, Column], m: Affine | None = None) -> dict[str, Column]:
    """min_col, max_col, min_row, max_row (both inclusive) of a CRS box in the grid; empty where min > max."""
    back = inverse(m or of())
    pixels = [apply(back, x, y) for x in (box[0], box[2]) for y in (box[1], box[3])]
    out = {}
    for axis, name, size, count in ((0, "col", "tile_w", "matrix_w"), (1, "row", "tile_h", "matrix_h")):
        v = [p[axis] for p in pixels]
        out[f"min_{name}"] = F.greatest(F.lit(0).cast("bigint"), F.floor(F.least(*v) / F.col(size)))
        out[f"max_{name}"] = F.least((F.col(count) - 1).cast("bigint"), F.floor(F.greatest(*v) / F.col(size)))
    return out


def exploded(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """A row for each tile of min_col..max_col, min_row..max_row; none for empty ranges."""
    some = df.filter("min_col <= max_col and min_row <= max_row")
    some = some.withColumn(y, F.explode(F.sequence("min_row", "max_row")))
    return some.withColumn(x, F.explode(F.sequence("min_col", "max_col"))).drop("min_col", "max_col", "min_row", "max_row")
