"""Warp meshes: error-bounded triangulations by greedy insertion (Garland and Heckbert, 1995)."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spaces
from ..runtime import ship

MAX_ERROR, LAT_EPSILON, LEAST_SIDE = 0.125, 1e-9, 1 / 16

TRIANGLES = "z int, x int, y int, t int, i0 int, i1 int, i2 int, u0 double, v0 double, u1 double, v1 double, u2 double, v2 double"
VERTICES = "z int, x int, y int, i int, hi_x float, hi_y float, lo_x float, lo_y float, u double, v double, error double"


def clamp_rows(top: Column, bottom: Column, max_lat: float = spaces.MAX_LAT) -> dict[str, Column]:
    """v_top and v_bottom of a tile with iso-latitude rows that leaves the mercator range; NULL where no clamp is needed."""
    span = bottom - top
    inside = (F.abs(top) <= max_lat) & (F.abs(bottom) <= max_lat)
    unit = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    divisor = F.nullif(span, F.lit(0.0))
    north, south = (F.lit(max_lat) - top) / divisor, (F.lit(-max_lat) - top) / divisor
    a, b = unit(F.least(north, south)), unit(F.greatest(north, south))
    needed = (F.abs(span) > LAT_EPSILON) & ~inside & (b - a >= LAT_EPSILON)
    return {"v_top": F.when(needed, a), "v_bottom": F.when(needed, b)}


def refine(width: int, height: int, forward: Callable, inverse: Callable, max_error: float = MAX_ERROR, v_range: tuple[float, float] = (0.0, 1.0)) -> tuple[np.ndarray, np.ndarray, float]:
    """Vertices (u, v) and triangles on a tile's corner grid, split at the worst sample until none is off by max_error source pixels.

    forward maps pixels to the target plane, inverse back; the error is how far the linear blend lands in pixels.
    A warp that jumps is off by the jump however fine the mesh is: a ValueError, once a side is shorter than LEAST_SIDE pixels.
    """
    uv = [(0.0, v_range[0]), (1.0, v_range[0]), (0.0, v_range[1]), (1.0, v_range[1])]
    where = {p: i for i, p in enumerate(uv)}
    target: dict[int, tuple[float, float]] = {}

    def at(i: int) -> tuple[float, float]:
        if i not in target:
            target[i] = tuple(float(np.asarray(c)) for c in forward(uv[i][0] * width, uv[i][1] * height))
        return target[i]

    inner = np.array([(1 / 3, 1 / 3, 1 / 3), (0.5, 0.5, 0.0), (0.5, 0.0, 0.5), (0.0, 0.5, 0.5)])

    def worst(t: tuple[int, int, int]) -> tuple[float, tuple[float, float]]:
        p, q = inner @ np.array([at(i) for i in t]), inner @ np.array([uv[i] for i in t])
        px, py = inverse(p[:, 0], p[:, 1])
        off = np.hypot(px - q[:, 0] * width, py - q[:, 1] * height)
        k = int(np.argmax(off))
        return float(off[k]), k

    heap: list = []
    beside: dict[tuple[int, int], set] = {}  # a side's triangles
    sides = lambda t: [(t[i], t[(i + 1) % 3]) for i in range(3)]
    key = lambda s: (min(s), max(s))
    alive: set = set()

    def push(t):
        e, k = worst(t)
        heapq.heappush(heap, (-e, t, k))
        alive.add(t)
        for s in sides(t):
            beside.setdefault(key(s), set()).add(t)

    def drop(t):
        alive.discard(t)
        for s in sides(t):
            beside[key(s)].discard(t)

    push((0, 1, 2))
    push((1, 3, 2))
    while not -heap[0][0] <= max_error:
        # the longest side in pixels is halved, on both of its triangles, so no crack opens
        t = heap[0][1]
        if t not in alive:
            heapq.heappop(heap)
            continue
        a, b = max(sides(t), key=lambda s: ((uv[s[0]][0] - uv[s[1]][0]) * width) ** 2 + ((uv[s[0]][1] - uv[s[1]][1]) * height) ** 2)
        if np.hypot((uv[a][0] - uv[b][0]) * width, (uv[a][1] - uv[b][1]) * height) < LEAST_SIDE:
            raise ValueError(f"the mesh can't hold an error of {max_error} pixels: the warp jumps near {uv[a]}")
        mid = ((uv[a][0] + uv[b][0]) / 2, (uv[a][1] + uv[b][1]) / 2)
        m = where.setdefault(mid, len(uv))
        if m == len(uv):
            uv.append(mid)
        for x in sorted(beside[key((a, b))]):
            drop(x)
            for old in (a, b):
                push(tuple(m if i == old else i for i in x))
    worst_left = max(-e for e, t, _ in heap if t in alive)
    return np.array(uv), np.array(sorted(alive)), worst_left


def meshes(tiles: DataFrame, forward: Callable, inverse: Callable, max_error: float = MAX_ERROR, triangles: bool = False) -> DataFrame:
    """A row for each vertex, positions in mercator split into two singles; or a row for each triangle, by its vertices. tiles: z, x, y, width, height, a..f, v_top, v_bottom.

    forward (CRS -> mercator) and inverse take and give numpy arrays.
    """
    shape = TRIANGLES if triangles else VERTICES

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            det = r.a * r.e - r.b * r.d
            to = lambda px, py, r=r: forward(r.a * px + r.b * py + r.c, r.d * px + r.e * py + r.f)

            def back(mx, my, r=r, det=det):
                cx, cy = inverse(mx, my)
                return (r.e * (cx - r.c) - r.b * (cy - r.f)) / det, (r.a * (cy - r.f) - r.d * (cx - r.c)) / det

            v = (0.0, 1.0) if pd.isna(r.v_top) else (r.v_top, r.v_bottom)
            uv, faces, error = refine(r.width, r.height, to, back, max_error, v)
            if triangles:
                corner = {f"{n}{k}": uv[faces[:, k], j] for k in range(3) for j, n in enumerate("uv")}
                out.append(pd.DataFrame({"z": r.z, "x": r.x, "y": r.y, "t": np.arange(len(faces)), **{f"i{k}": faces[:, k] for k in range(3)}, **corner}))
                continue
            mx, my = to(uv[:, 0] * r.width, uv[:, 1] * r.height)
            hx, hy = mx.astype(np.float32), my.astype(np.float32)
            out.append(pd.DataFrame({"z": r.z, "x": r.x, "y": r.y, "i": np.arange(len(uv)), "hi_x": hx, "hi_y": hy, "lo_x": (mx - hx).astype(np.float32), "lo_y": (my - hy).astype(np.float32), "u": uv[:, 0], "v": uv[:, 1], "error": error}))
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in shape.split(", ")])

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield build(pdf)

    ship(tiles.sparkSession)
    return tiles.mapInPandas(run, shape)
