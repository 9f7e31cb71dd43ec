"""Isobands, gradients and contour lines over sampled values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.colour import Rgba, unit
from .options import Lines, check_thresholds


def threshold_array(thresholds: list[float], precision: str = "double") -> Column:
    return F.array(*[F.lit(float(t)) for t in check_thresholds(thresholds)]).cast(f"array<{precision}>")


def isoband(value: Column, thresholds: list[float], include_lower: bool = False, include_upper: bool = True, precision: str = "double") -> Column:
    """Index of the band [min, max) that holds the value; NULL for missing values and open bands that aren't shown."""
    v = value.cast(precision)
    k = F.size(F.filter(threshold_array(thresholds, precision), lambda t: v >= t))
    shown = F.coalesce(~F.isnan(v), F.lit(False))
    if not include_lower:
        shown = shown & (k > 0)
    if not include_upper:
        shown = shown & (k < len(thresholds))
    return F.when(shown, k if include_lower else k - 1)


def gradient(value: Column, low: float, high: float, include_lower: bool = False, include_upper: bool = True) -> Column:
    """Position on the ramp in [0, 1]; NULL for missing values and ends that aren't shown."""
    if not high > low:
        raise ValueError("max must exceed min")
    shown = F.coalesce(~F.isnan(value), F.lit(False))
    if not include_lower:
        shown = shown & (value >= low)
    if not include_upper:
        shown = shown & (value < high)
    return F.when(shown, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low))))


def nearest_threshold(value: Column, thresholds: list[float]) -> Column:
    """struct<d, i>: distance to the nearest threshold and its index; ties go to the lower one."""
    t = threshold_array(thresholds)
    each = F.transform(t, lambda x, i: F.struct(F.abs(value - x).alias("d"), i.alias("i")))
    return F.when(F.coalesce(~F.isnan(value), F.lit(False)), F.array_min(each))


def smoothstep(low: Column, high: Column, x: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))
    return t * t * (3 - 2 * t)


def line_alpha(value: Column, dx: Column, dy: Column, thresholds: list[float], lines: Lines, pixel_ratio: float = 1.0) -> Column:
    """Coverage of the line of the nearest threshold, by distance in pixels; 0 where nothing can be drawn."""
    best = nearest_threshold(value, thresholds)
    major = (best["i"] % lines.major_every == 0) if lines.major_every and lines.major_every > 0 else F.lit(False)
    wide = 2 * lines.width if lines.major_width is None else lines.major_width
    half = F.when(major, F.lit(0.5 * pixel_ratio * wide)).otherwise(F.lit(0.5 * pixel_ratio * lines.width))
    steep = F.hypot(dx, dy)
    a = 1 - smoothstep(half - 0.5, half + 0.5, best["d"] / steep)
    return F.when((steep > 0) & best.isNotNull(), a).otherwise(F.lit(0.0))


def over(line: Rgba, a: Column, under: tuple[Column, ...]) -> tuple[Column, ...]:
    """A straight-alpha line of coverage a over a colour."""
    r, g, b, la = unit(line)
    a = a * la
    out = a + under[3] * (1 - a)
    blend = lambda l, u: F.when(out > 0, (l * a + u * under[3] * (1 - a)) / F.nullif(out, F.lit(0.0))).otherwise(u)
    return blend(r, under[0]), blend(g, under[1]), blend(b, under[2]), out


def band_colour(index: Column, colours: list[Rgba]) -> tuple[Column, ...]:
    """Colour of a band index; transparent where it is NULL."""
    out = []
    for c in range(4):
        table = F.array(*[F.lit(unit(x)[c]) for x in colours])
        out.append(F.coalesce(F.get(table, index), F.lit(0.0)))
    return tuple(out)


def ramp_colour(t: Column, ramp: list[Rgba]) -> tuple[Column, ...]:
    """Linear, edge-clamped lookup at t; transparent where it is NULL."""
    from ..functions.colour import ramp_texels

    low, high, f = ramp_texels(t, len(ramp))
    out = []
    for c in range(4):
        table = F.array(*[F.lit(unit(x)[c]) for x in ramp])
        a, b = F.get(table, low), F.get(table, high)
        out.append(F.coalesce(a + (b - a) * f, F.lit(0.0)))
    return tuple(out)
