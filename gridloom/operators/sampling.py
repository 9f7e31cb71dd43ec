"""Resampling of row-major planes held as arrays, with exact handling of missing data.

All taps of a sample are read, and a missing one makes the sample missing even at weight 0.
NaN is tested first everywhere, since Spark's comparisons take NaN as equal to itself and as the largest value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(v: Column, nodata: Column | float | None = None) -> Column:
    """Whether a raw sample is NaN, NULL or the nodata value."""
    gone = F.isnan(v)
    if nodata is not None:
        same = v == (nodata if isinstance(nodata, Column) else F.lit(float(nodata)))
        gone = gone | F.coalesce(same, F.lit(False))
    return F.coalesce(gone, F.lit(True))


def mix(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def taps(u: Column, size: Column | int, halo: int = 0) -> tuple[Column, Column, Column]:
    """Lower tap, upper tap, and blend, along one axis; both taps stay in the plane, halo included."""
    p = u * size - 0.5 + halo
    low, top = F.floor(p), size + (2 * halo - 1)
    keep = lambda v: F.greatest(F.lit(0).cast("bigint"), F.least(top.cast("bigint") if isinstance(top, Column) else F.lit(top).cast("bigint"), v))
    return keep(low), keep(low + 1), p - low


def bilinear(plane: Column, u: Column, v: Column, w: Column | int, h: Column | int, nodata=None, halo: int = 0) -> dict[str, Column]:
    """value, valid, and the gradient per texel (dx, dy), at (u, v) in [0, 1] squared."""
    x0, x1, fx = taps(u, w, halo)
    y0, y1, fy = taps(v, h, halo)
    stride = w + 2 * halo
    at = lambda x, y: F.get(plane, (y * stride + x).cast("int"))
    return blended(at(x0, y0), at(x1, y0), at(x0, y1), at(x1, y1), fx, fy, nodata)


def blended(v00: Column, v10: Column, v01: Column, v11: Column, fx: Column, fy: Column, nodata=None) -> dict[str, Column]:
    bad = missing(v00, nodata) | missing(v10, nodata) | missing(v01, nodata) | missing(v11, nodata)
    hide = lambda c: F.when(~bad, c)
    return {
        "value": hide(mix(mix(v00, v10, fx), mix(v01, v11, fx), fy)),
        "valid": ~bad,
        "dx": hide(mix(v10 - v00, v11 - v01, fy)),
        "dy": hide(mix(v01 - v00, v11 - v10, fx)),
    }


def nearest(plane: Column, u: Column, v: Column, w: Column | int, h: Column | int, nodata=None, halo: int = 0) -> dict[str, Column]:
    """The tap whose texel holds the point; f < 0.5 is the lower one. Only that tap can be missing."""
    x0, x1, fx = taps(u, w, halo)
    y0, y1, fy = taps(v, h, halo)
    x, y = F.when(fx < 0.5, x0).otherwise(x1), F.when(fy < 0.5, y0).otherwise(y1)
    raw = F.get(plane, (y * (w + 2 * halo) + x).cast("int"))
    bad = missing(raw, nodata)
    return {"value": F.when(~bad, raw), "valid": ~bad, "dx": F.lit(0.0), "dy": F.lit(0.0)}


def scaled(sample: dict[str, Column], scale: float, offset: float, jacobian: tuple[Column, Column, Column, Column] | None = None) -> dict[str, Column]:
    """Values in their unit; with (du/dx, du/dy, dv/dx, dv/dy) in texels a pixel, the gradient per screen pixel."""
    gx, gy = sample["dx"], sample["dy"]
    if jacobian is not None:
        ux, uy, vx, vy = jacobian
        gx, gy = gx * ux + gy * vx, gx * uy + gy * vy
    return {"value": sample["value"] * scale + offset, "valid": sample["valid"], "dx": gx * scale, "dy": gy * scale}


def composite(samples: list[dict[str, Column]], channels: list[int], alpha_max: float) -> tuple[tuple[Column, ...], Column]:
    """Up to four sampled bands as rgba, and whether the pixel stays: a missing colour band drops it, alpha never does."""
    out, stay = [], F.lit(True)
    for i, c in enumerate(channels):
        if c < 0:
            out.append(F.lit(1.0 if i == 3 else 0.0))
        elif i == 3:
            out.append(samples[i]["value"] / alpha_max)
        else:
            out.append(samples[i]["value"])
            stay = stay & samples[i]["valid"]
    return tuple(out), stay


def float32(v: Column) -> Column:
    return v.cast("float")
