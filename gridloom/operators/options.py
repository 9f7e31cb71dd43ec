"""Options, resolved and validated on the driver before a plan is built."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from ..functions import colour

MAX_THRESHOLDS = 64

# Sample kinds and widths that have a texture form, by (channels, kind, bits).
SAMPLE_TYPES = {(1, k, b) for k in ("uint", "int") for b in (8, 16, 32)} | {(1, "float", 32), (4, "uint", 8)}
SPARK_TYPES = {("uint", 8): "short", ("uint", 16): "int", ("uint", 32): "bigint", ("int", 8): "tinyint", ("int", 16): "short", ("int", 32): "int", ("float", 32): "float"}
# TIFF photometric codes.
WHITE_IS_ZERO, BLACK_IS_ZERO, RGB, PALETTE, SEPARATED, YCBCR, CIELAB = 0, 1, 2, 3, 5, 6, 8


def sample_type(kinds: list[str], bits: list[int], channels: int = 1) -> str:
    """Spark type of a raster's samples; mixed or unknown formats are errors."""
    if len(set(kinds)) != 1 or len(set(bits)) != 1:
        raise ValueError("bands differ in sample format or width")
    if (channels, kinds[0], bits[0]) not in SAMPLE_TYPES:
        raise ValueError(f"unsupported samples: {channels} x {kinds[0]}{bits[0]}")
    return SPARK_TYPES[kinds[0], bits[0]]


def sample_max(kind: str, bits: int) -> float:
    return {"uint": 2.0**bits - 1, "int": 2.0 ** (bits - 1) - 1}.get(kind, 1.0)


@dataclass(frozen=True)
class Sampling:
    """Units that samples are read in: 8-bit unsigned ones are normalised, others raw."""

    denorm: float
    nodata: float | None
    alpha_max: float


def band_sampling(kind: str, bits: int, nodata: float | None) -> Sampling:
    denorm = 255.0 if (kind, bits) == ("uint", 8) else 1.0
    return Sampling(denorm, None if nodata is None else nodata / denorm, sample_max(kind, bits) / denorm)


def extra_samples(tag) -> list[int] | None:
    return None if tag is None else [int(tag)] if isinstance(tag, (int, float)) else [int(x) for x in tag]


def check_band(band, n_bands: int | None = None) -> None:
    if not isinstance(band, int) or isinstance(band, bool) or band < 0 or (n_bands is not None and band >= n_bands):
        raise ValueError(f"no such band: {band!r}")


def check_bands(bands, n_bands: int | None = None) -> None:
    if len(bands) not in (1, 3, 4):
        raise ValueError("bands must be 1, 3 or 4")
    for b in bands:
        check_band(b, n_bands)


def colour_bands(photometric: int) -> int:
    return {RGB: 3, YCBCR: 3, CIELAB: 3, SEPARATED: 4}.get(photometric, 1)


def alpha_band(photometric: int, extras: list[int] | None) -> int | None:
    """The first extra sample that is alpha (associated or not)."""
    at = next((i for i, x in enumerate(extras or []) if x in (1, 2)), None)
    return None if at is None else colour_bands(photometric) + at


def select_bands(photometric: int, n_bands: int, extras: list[int] | None, bands: list[int] | None = None) -> list[int]:
    """Bands to draw: given ones, or the file's composite."""
    need = colour_bands(photometric)
    if bands is not None:
        check_bands(bands, n_bands)
        if photometric in (SEPARATED, CIELAB):
            raise ValueError("the bands of this colour model have fixed meanings")
        if photometric == PALETTE and len(bands) != 1:
            raise ValueError("a palette takes one band")
        return list(bands)
    if n_bands < need:
        raise ValueError(f"this colour model needs {need} bands, the file has {n_bands}")
    if photometric == PALETTE or (need == 1 and n_bands == 1):
        return [0]
    if need == 4:
        return [0, 1, 2, 3]
    if need == 1 and n_bands not in (3, 4):
        raise ValueError(f"{n_bands} bands have no default composite: pass the bands to draw")
    return [0, 1, 2] + [3] * (alpha_band(photometric, extras) == 3)


def channel_map(bands: list[int]) -> list[int]:
    return [*bands, *[-1] * (4 - len(bands))]


def check_rescale(rescale, channels: int | None = None) -> None:
    if len(rescale) not in (1, 3) or any(not (math.isfinite(a) and math.isfinite(b) and b > a) for a, b in rescale):
        raise ValueError("rescale takes 1 or 3 finite [min, max] pairs")
    if channels is not None and len(rescale) not in (1, channels):
        raise ValueError("rescale must fit the colour channels")


def resolve_rescale(rescale, kind: str, bits: int, channels: int):
    """Pairs in sampled units for three channels; 8-bit unsigned samples may go without."""
    if rescale is None:
        if (kind, bits) != ("uint", 8):
            raise ValueError("samples other than 8-bit unsigned need a rescale")
        return None
    check_rescale(rescale, channels)
    d = band_sampling(kind, bits, None).denorm
    pairs = [(a / d, b / d) for a, b in rescale]
    return pairs * 3 if len(pairs) == 1 else pairs


def colour_conversion(photometric: int, bands: int) -> str:
    """How sampled channels become colour: rgb, grey, grey-inverted, palette, cmyk, cielab."""
    if bands >= 3:
        return {SEPARATED: "cmyk", CIELAB: "cielab"}.get(photometric, "rgb")
    return {WHITE_IS_ZERO: "grey-inverted", PALETTE: "palette"}.get(photometric, "grey")


def check_opacity(opacity: float) -> float:
    if not (math.isfinite(opacity) and 0 <= opacity <= 1):
        raise ValueError("opacity must be in [0, 1]")
    return opacity


@dataclass(frozen=True)
class Imagery:
    bands: list[int]
    channels: list[int]
    rescale: list[tuple[float, float]] | None
    conversion: str
    sampling: Sampling


def resolve_imagery(meta: dict, bands: list[int] | None = None, rescale=None) -> Imagery:
    """meta: photometric, n_bands, kind, bits, extra_samples, nodata."""
    chosen = select_bands(meta["photometric"], meta["n_bands"], extra_samples(meta.get("extra_samples")), bands)
    how = colour_conversion(meta["photometric"], len(chosen))
    if how == "palette" and rescale is not None:
        raise ValueError("a palette isn't rescaled")
    fitted = None if how == "palette" else resolve_rescale(rescale, meta["kind"], meta["bits"], min(3, len(chosen)))
    return Imagery(chosen, channel_map(chosen), fitted, how, band_sampling(meta["kind"], meta["bits"], meta.get("nodata")))


def check_thresholds(t) -> list[float]:
    t = list(t)
    if not t or len(t) > MAX_THRESHOLDS or any(not math.isfinite(x) for x in t) or any(b <= a for a, b in zip(t, t[1:])):  # noqa: B905
        raise ValueError(f"thresholds must be 1 to {MAX_THRESHOLDS}, finite and rising")
    return t


@dataclass(frozen=True)
class Band:
    band: int
    min: float | None
    max: float | None


def contour_bands(thresholds, include_lower: bool = False, include_upper: bool = True) -> list[Band]:
    t = check_thresholds(thresholds)
    edges = ([None] if include_lower else []) + t + ([None] if include_upper else [])
    return [Band(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))]  # noqa: B905


@dataclass(frozen=True)
class Lines:
    width: float = 1.0
    colour: str = "#333333"
    major_every: int | None = None
    major_width: float | None = None
    major_colour: str | None = None

    def __post_init__(self):
        if not (math.isfinite(self.width) and self.width >= 0) or (self.major_width is not None and not (math.isfinite(self.major_width) and self.major_width >= 0)):
            raise ValueError("line widths must be finite and not negative")
        for c in (self.colour, self.major_colour):
            if c is not None:
                colour.parse_css(c)


@dataclass(frozen=True)
class Contour:
    """fill: bands, gradient or none; lines may be drawn over any."""

    thresholds: list[float]
    fill: str = "bands"
    colours: object = None
    include_lower: bool = False
    include_upper: bool = True
    lines: Lines | None = None
    band: int = 0
    bands: list[Band] = field(init=False)

    def __post_init__(self):
        check_thresholds(self.thresholds)
        check_band(self.band)
        if self.fill not in ("bands", "gradient", "none"):
            raise ValueError(f"unknown fill {self.fill!r}")
        if self.fill == "none" and self.lines is None:
            raise ValueError("nothing to draw")
        if self.fill == "gradient" and len(self.thresholds) < 2:
            raise ValueError("a gradient needs two thresholds")
        shown = contour_bands(self.thresholds, self.include_lower, self.include_upper) if self.fill == "bands" else []
        object.__setattr__(self, "bands", shown)
        if self.fill == "bands":
            colour.band_colours(self.colours, len(shown))
        elif self.fill == "gradient":
            colour.gradient_stops(self.colours)

    def legend(self) -> list[tuple[Band, colour.Rgba]]:
        return list(zip(self.bands, colour.band_colours(self.colours, len(self.bands)), strict=True)) if self.bands else []

    def gradient(self) -> tuple[float, float, list[colour.Rgba]] | None:
        return (self.thresholds[0], self.thresholds[-1], colour.gradient_stops(self.colours)) if self.fill == "gradient" else None


def value_scale(sampling: Sampling, scales: list[float] | None, offsets: list[float] | None, band: int) -> tuple[float, float]:
    """Scale and offset from sampled units to values."""
    at = lambda x, d: x[band] if x and band < len(x) and x[band] is not None else d
    return sampling.denorm * at(scales, 1.0), at(offsets, 0.0)


def linspace(a: float, b: float, n: int) -> list[float]:
    return [round(a + (b - a) * i / (n - 1), 6) for i in range(n)] if n > 1 else [round(a, 6)]


def bins(a: float, b: float, count: int, include_lower: bool = False) -> list[float]:
    if not 2 <= count <= MAX_THRESHOLDS:
        raise ValueError("2 to 64 bins")
    return linspace(a, b, count - int(include_lower))


def stretch(value: float, most: float) -> list[tuple[float, float]]:
    if not 0 < value <= most:
        raise ValueError("the stretch must be in (0, max]")
    return [(0.0, value)]


# Named ramps of this library.
SCHEMES = {
    "grey": ["#000000", "#ffffff"], "heat": ["#000000", "#b30000", "#ff9900", "#ffffcc"], "ice": ["#001133", "#3377bb", "#e6f7ff"], "leaf": ["#f7fcf5", "#74c476", "#00441b"],
    "earth": ["#2b6a3f", "#d9c98a", "#8a5a3b", "#ffffff"], "sea": ["#08306b", "#6baed6", "#f7fbff"], "dusk": ["#2d1e4f", "#a4508b", "#f7b267"], "split": ["#2166ac", "#f7f7f7", "#b2182b"],
}


def legend_text(band: Band) -> str:
    f = lambda v: f"{v:g}"
    return f"< {f(band.max)}" if band.min is None else f"≥ {f(band.min)}" if band.max is None else f"{f(band.min)} – {f(band.max)}"


#: Band presets: name -> bands of the common band orders, from 0.
PRESETS = {"grey": [0], "natural": [0, 1, 2], "natural-alpha": [0, 1, 2, 3], "infrared": [3, 0, 1], "vegetation": [3, 2, 1]}


def preset(name: str, n_bands: int) -> list[int]:
    """The bands of a preset; one that the raster can't hold is an error."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}")
    check_bands(PRESETS[name], n_bands)
    return list(PRESETS[name])
