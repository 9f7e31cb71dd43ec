"""One-texel halos from up to eight neighbour tiles.

Production form: a tile sends each neighbour the line or corner that it needs, on generated keys
(the dataset's too, where there is one), and Column expressions put the padded plane together. A padded texel is the neighbour's
adjacent one; where the neighbour is absent or masked there, the tile's own
edge; a corner then falls back to the padded texel beside it along x if that
neighbour exists, else along y, else to its own corner. `stitch` is the same rule on numpy planes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.barrier import computed

# Neighbour offsets, row by row.
OFFSETS = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]


def slot(dx: int, dy: int) -> int:
    return (dy + 1) * 3 + dx + 1


def neighbour_coordinates(x: int, y: int, w: int, h: int) -> list[tuple[int, int]]:
    return [(x + dx, y + dy) for dx, dy in OFFSETS if 0 <= x + dx < w and 0 <= y + dy < h]


def neighbours(tiles: DataFrame) -> DataFrame:
    """(z, x, y, dx, dy) of the tiles that each tile asks for."""
    offs = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in OFFSETS])
    return tiles.select("z", "x", "y", F.explode(offs).alias("o")).select("z", "x", "y", "o.dx", "o.dy")


def stitch(centre: np.ndarray, near: dict[tuple[int, int], tuple[np.ndarray, np.ndarray | None]]) -> np.ndarray:
    """Padded plane of a (rows, columns) plane; near: offset -> (plane, mask or None)."""
    h, w = centre.shape
    for (dx, dy), (plane, mask) in near.items():
        if (dy == 0 and plane.shape[0] != h) or (dx == 0 and plane.shape[1] != w):
            raise ValueError("a neighbour's edge doesn't fit")
        if mask is not None and mask.shape != plane.shape:
            raise ValueError("a mask doesn't fit its plane")
    out = np.empty((h + 2, w + 2), centre.dtype)
    out[1:-1, 1:-1] = centre

    def edge(key, own, rows, columns):
        if key not in near:
            return own
        plane, mask = near[key]
        line = plane[rows, columns]
        return line if mask is None else np.where(mask[rows, columns] != 0, line, own)

    out[1:-1, 0], out[1:-1, -1] = edge((-1, 0), centre[:, 0], slice(None), -1), edge((1, 0), centre[:, -1], slice(None), 0)
    out[0, 1:-1], out[-1, 1:-1] = edge((0, -1), centre[0], -1, slice(None)), edge((0, 1), centre[-1], 0, slice(None))
    for dx, dy in ((-1, -1), (1, -1), (-1, 1), (1, 1)):
        r, c = (0 if dy < 0 else h + 1), (0 if dx < 0 else w + 1)
        inner_r, inner_c = (1 if dy < 0 else h), (1 if dx < 0 else w)
        if (dx, dy) in near:
            plane, mask = near[dx, dy]
            pr, pc = (-1 if dy < 0 else 0), (-1 if dx < 0 else 0)
            if mask is None or mask[pr, pc] != 0:
                out[r, c] = plane[pr, pc]
                continue
        out[r, c] = out[inner_r, c] if (dx, 0) in near else out[r, inner_c] if (0, dy) in near else centre[inner_r - 1, inner_c - 1]
    return out


def _line(values: Column, dx: int, dy: int, w: Column, h: Column) -> Column:
    """What the tile at offset (dx, dy) has beside the tile that asks: a row, a column or a corner of its plane."""
    if dx == 0:
        return F.slice(values, F.lit(1) if dy > 0 else (h - 1) * w + 1, w)
    first = F.lit(0) if dx > 0 else w - 1
    if dy == 0:
        return F.transform(F.sequence(F.lit(0), h - 1), lambda i: F.get(values, i * w + first))
    return F.array(F.get(values, (F.lit(0) if dy > 0 else (h - 1) * w) + first))


def _checked(value: Column, ok: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def tile_keys(df: DataFrame) -> list[str]:
    return [c for c in ("dataset_id", "z", "x", "y") if c in df.columns]


def with_halo(tiles: DataFrame) -> DataFrame:
    """tiles (z, x, y, width, height, plane array<double>, mask array<tinyint> or NULL; dataset_id if there is one) with
    `padded`, row-major (h+2)(w+2), and `near`, whether each neighbour exists, in the order of OFFSETS.
    """
    keys, w, h = tile_keys(tiles), F.col("width"), F.col("height")
    plane = _checked(F.col("plane"), F.size("plane") == w * h, "a plane's length isn't width x height")
    mask = F.when(F.col("mask").isNotNull(), _checked(F.col("mask"), F.size("mask") == w * h, "a mask doesn't fit its plane"))
    own = computed(tiles.select(*keys, "width", "height", "plane", "mask"), {"plane": plane, "mask": mask})
    lines = [F.struct(F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), _line(F.col("plane"), dx, dy, w, h).alias("v"), F.when(F.col("mask").isNotNull(), _line(F.col("mask"), dx, dy, w, h)).alias("m")) for i, (dx, dy) in enumerate(OFFSETS)]
    sent = own.select(*keys, F.inline(F.array(*lines)))
    sent = sent.withColumns({"x": F.col("x") - F.col("dx"), "y": F.col("y") - F.col("dy")})
    edges = sent.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.struct("v", "m"))).alias(f"n{i}") for i in range(8)])
    names = [c for c in tiles.columns if c not in ("padded", "near")]
    df = tiles.select(*names).join(edges, keys, "left")
    at = {o: F.col(f"n{i}") for i, o in enumerate(OFFSETS)}

    def side(dx: int, dy: int, size: Column) -> Column:
        """A neighbour's line with the own edge where it is masked or absent."""
        edge = _line(F.col("plane"), -dx, -dy, w, h)
        near = at[dx, dy]
        line = _checked(near["v"], F.size(near["v"]) == size, "a neighbour's edge doesn't fit")
        shown = F.when(near["m"].isNull(), line).otherwise(F.zip_with(F.zip_with(line, near["m"], lambda v, m: F.when(m != 0, v)), edge, lambda v, e: F.coalesce(v, e)))
        return F.when(near.isNull(), edge).otherwise(shown)

    df = computed(df, {"__l": side(-1, 0, h), "__r": side(1, 0, h), "__t": side(0, -1, w), "__b": side(0, 1, w)})

    def corner(dx: int, dy: int) -> Column:
        column, row = F.col("__l" if dx < 0 else "__r"), F.col("__t" if dy < 0 else "__b")
        beside, above = F.get(column, F.lit(0) if dy < 0 else h - 1), F.get(row, F.lit(0) if dx < 0 else w - 1)
        near, alone = at[dx, dy], F.get(F.col("plane"), (F.lit(0) if dy < 0 else (h - 1) * w) + (F.lit(0) if dx < 0 else w - 1))
        seen = near.isNotNull() & (near["m"].isNull() | (F.get(near["m"], F.lit(0)) != 0))
        return F.when(seen, F.get(near["v"], F.lit(0))).when(at[dx, 0].isNotNull(), beside).when(at[0, dy].isNotNull(), above).otherwise(alone)

    inner = F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda i: F.concat(F.array(F.get("__l", i)), F.slice("plane", i * w + 1, w), F.array(F.get("__r", i)))))
    whole = F.concat(F.array(corner(-1, -1)), F.col("__t"), F.array(corner(1, -1)), inner, F.array(corner(-1, 1)), F.col("__b"), F.array(corner(1, 1)))
    near = F.array(*[at[o].isNotNull() for o in OFFSETS])
    return computed(df, {"padded": whole.cast("array<double>"), "near": near}, names)


def pixel_neighbour(pixels: DataFrame, dx: int, dy: int, name: str) -> DataFrame:
    """Relational form, for checks: pixels (gx, gy, v) with the sample at an offset, NULL outside the image."""
    other = pixels.select((F.col("gx") - dx).alias("gx"), (F.col("gy") - dy).alias("gy"), F.col("v").alias(name))
    return pixels.join(other, ["gx", "gy"], "left")
