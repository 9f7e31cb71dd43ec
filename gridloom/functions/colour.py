"""Colours: CSS strings, ramps and lookups on the driver, photometric conversions as Columns."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Rgba = tuple[int, int, int, int]
RAMP_WIDTH, FUNCTION_STOPS = 256, 64


def js_round(v: float) -> int:
    return math.floor(v + 0.5)


def parse_css(text: str) -> Rgba:
    """#rgb, #rgba, #rrggbb, #rrggbbaa, rgb() and rgba(); anything else is an error."""
    s = text.strip().lower()
    if m := re.fullmatch(r"#([0-9a-f]+)", s):
        digits = m[1]
        if len(digits) in (3, 4):
            digits = "".join(c * 2 for c in digits)
        if len(digits) in (6, 8):
            r, g, b, a = (int(x, 16) for x in re.findall("..", digits.ljust(8, "f")))
            return r, g, b, a
    elif m := re.fullmatch(r"rgba?\((.*)\)", s):
        parts = re.split(r"[\s,/]+", m[1].strip())
        if len(parts) in (3, 4):
            def value(p: str, scale: float) -> int:
                n = float(p[:-1]) / 100 * 255 if p.endswith("%") else float(p) * scale
                return js_round(min(255.0, max(0.0, n)))

            try:
                r, g, b = (value(p, 1.0) for p in parts[:3])
                return r, g, b, value(parts[3], 255.0) if len(parts) == 4 else 255
            except ValueError:
                pass
    raise ValueError(f"not a colour: {text!r}")


def css_hex_columns(text: Column) -> dict[str, Column]:
    """The channels of #rrggbb strings."""
    return {c: F.conv(F.substring(text, 2 + 2 * i, 2), 16, 10).cast("int") for i, c in enumerate("rgb")}


def unit(colour: Rgba) -> tuple[float, ...]:
    return tuple(c / 255 for c in colour)


def band_colours(colours: list[str] | Callable[[float, int, int], str], n: int) -> list[Rgba]:
    """A colour for each band: a list of n, or a function of (k / (n - 1), k, n)."""
    if callable(colours):
        colours = [colours(k / (n - 1) if n > 1 else 0.0, k, n) for k in range(n)]
    if len(colours) != n:
        raise ValueError(f"{n} bands need {n} colours, got {len(colours)}")
    return [parse_css(c) for c in colours]


def gradient_stops(colours: list[str] | Callable[[float, int, int], str]) -> list[Rgba]:
    if callable(colours):
        return band_colours(colours, FUNCTION_STOPS)
    if len(colours) < 2:
        raise ValueError("a gradient needs two colours or more")
    return [parse_css(c) for c in colours]


def ramp(stops: list[Rgba], width: int = RAMP_WIDTH) -> list[Rgba]:
    """Straight-alpha blend of evenly spaced stops at x / (width - 1)."""
    out = []
    for x in range(width):
        at = x / (width - 1) * (len(stops) - 1)
        i = min(int(at), len(stops) - 2)
        out.append(tuple(js_round(a + (b - a) * (at - i)) for a, b in zip(stops[i], stops[i + 1], strict=True)))
    return out


def ramp_texels(t: Column, width: int = RAMP_WIDTH) -> tuple[Column, Column, Column]:
    """Lower and upper ramp index and the blend between them, as a linear, edge-clamped lookup reads at t."""
    p = t * width - 0.5
    return (
        F.greatest(F.lit(0), F.least(F.lit(width - 1), F.floor(p).cast("int"))),
        F.greatest(F.lit(0), F.least(F.lit(width - 1), F.floor(p).cast("int") + 1)),
        p - F.floor(p),
    )


def grey(r: Column) -> tuple[Column, ...]:
    return r, r, r, F.lit(1.0)


def inverted_grey(r: Column) -> tuple[Column, ...]:
    v = 1 - r
    return v, v, v, F.lit(1.0)


def cmyk(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, ...]:
    return (1 - c) * (1 - k), (1 - m) * (1 - k), (1 - y) * (1 - k), F.lit(1.0)


# D65 white and XYZ -> linear sRGB.
WHITE = (0.95047, 1.0, 1.08883)
SRGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))


def cielab(l: Column, a: Column, b: Column, as_written: bool = False) -> tuple[Column, ...]:
    """Lab channels in [0, 1] to sRGB. as_written takes the matrix by columns, as a shader constructor would."""
    y = (l * 255 + 16) / 116
    v = ((a - 0.5) * 255 / 500 + y, y, y - (b - 0.5) * 255 / 200)
    xyz = [w * F.when(t * t * t >= 0.008856, t * t * t).otherwise((t - 16 / 116) / 7.787) for w, t in zip(WHITE, v, strict=True)]
    rows = tuple(zip(*SRGB, strict=True)) if as_written else SRGB
    out = []
    for row in rows:
        lin = row[0] * xyz[0] + row[1] * xyz[1] + row[2] * xyz[2]
        s = F.when(lin >= 0.0031308, 1.055 * F.pow(F.greatest(lin, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * lin)
        out.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))
    return *out, F.lit(1.0)


def premultiplied(rgba: tuple[Column, ...], opacity: Column | float) -> tuple[Column, ...]:
    r, g, b, a = rgba
    return tuple(c * a * opacity for c in (r, g, b)) + (a * opacity,)
