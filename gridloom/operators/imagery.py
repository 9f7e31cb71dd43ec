"""The imagery chain: seed, mask, stretch, colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour
from .options import Imagery


def mask_filter(df: DataFrame, mask: str = "mask") -> DataFrame:
    """Drops pixels whose mask is 0; no mask keeps them."""
    return df.filter(F.coalesce(F.col(mask) != 0, F.lit(True)))


def linear_rescale(rgb: tuple[Column, ...], pairs: list[tuple[float, float]]) -> tuple[Column, ...]:
    """Colour channels stretched to [0, 1]; alpha (and CMYK's black) stays."""
    out = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - a) / (b - a))) for c, (a, b) in zip(rgb, pairs, strict=False)]
    return (*out, *rgb[3:])


def deinterleave(data: Column, n: int) -> Column:
    """Planes of an interleaved array of n bands."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.filter(data, lambda v, i: i % n == b))


def palette_lookup(r: Column, colormap: Column, reverse: bool = False) -> Column:
    """Entry of an array of colours for an index in [0, 1], nearest."""
    t = 1 - r if reverse else r
    n = F.size(colormap)
    return F.get(colormap, F.greatest(F.lit(0).cast("bigint"), F.least((n - 1).cast("bigint"), F.floor(t * n))).cast("int"))


def palette_layer(r: Column, colormaps: Column, layer: Column, reverse: bool = False) -> Column:
    """The same from one of several colormaps; NULL for a layer that isn't there."""
    own = F.get(colormaps, layer)
    return F.when(own.isNotNull(), palette_lookup(r, own, reverse))


def coloured(rgba: tuple[Column, ...], how: str) -> tuple[Column, ...]:
    if how == "grey":
        return colour.grey(rgba[0])
    if how == "grey-inverted":
        return colour.inverted_grey(rgba[0])
    if how == "cmyk":
        return colour.cmyk(*rgba)
    if how == "cielab":
        return colour.cielab(*rgba[:3])
    return rgba


def chain(df: DataFrame, options: Imagery, bands: str = "bands", mask: str | None = None, opacity: float = 1.0, colormap: Column | None = None, reverse: bool = False) -> DataFrame:
    """df with r, g, b, a (premultiplied) from an array of sampled bands: seed, mask, stretch, colour; pixels that miss a colour band go.

    A palette's colormap is an array of structs r, g, b, a of 0 to 255.
    """
    from .sampling import composite, missing

    if options.conversion == "palette" and colormap is None:
        raise ValueError("a palette needs a colormap")
    if mask:
        df = mask_filter(df, mask)
    at = lambda i: F.get(F.col(bands), F.lit(options.channels[i])) / options.sampling.denorm
    samples = [{"value": at(i), "valid": ~missing(at(i), options.sampling.nodata)} if options.channels[i] >= 0 else {} for i in range(4)]
    rgba, alive = composite(samples, options.channels, options.sampling.alpha_max)
    if options.rescale:
        rgba = linear_rescale(rgba, options.rescale)
    if options.conversion == "palette":
        entry = palette_lookup(rgba[0], colormap, reverse)
        rgba = tuple(entry[c] / 255.0 for c in "rgba")
    else:
        rgba = coloured(rgba, options.conversion)
    return df.filter(alive).withColumns(dict(zip("rgba", colour.premultiplied(rgba, opacity), strict=True)))
