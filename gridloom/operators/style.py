"""Render pipelines as named operators, the contour chain, and restyling without reading tiles again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colour
from ..functions.barrier import computed
from . import classify, imagery, options, sampling


@dataclass(frozen=True)
class RasterOp:
    """A step of a pipeline: its name, what it does to a DataFrame, and the parameters that it was built from."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    bindings: dict = field(default_factory=dict)


def pipeline_key(variant: str, ops: list[RasterOp]) -> str:
    """Label of a plan: the projection's variant and the steps' names, in order."""
    return f"{variant}|{','.join(op.name for op in ops)}"


def collect_bindings(ops: list[RasterOp]) -> dict:
    """All parameters; a later step overrides an earlier one."""
    return {k: v for op in ops for k, v in op.bindings.items()}


def run(df: DataFrame, ops: list[RasterOp]) -> DataFrame:
    for op in ops:
        df = op.apply(df)
    return df


def cleared(df: DataFrame) -> DataFrame:
    """The transparent base that a contour is drawn on."""
    return df.withColumns({c: F.lit(0.0) for c in "rgba"})


def contour_ops(style: options.Contour, pixel_ratio: float = 1.0, mask: str | None = None, nodata: float | None = None) -> list[RasterOp]:
    """Seed, mask, fill, lines, over rows with value, dx and dy; missing values go with the mask."""
    present = lambda df: df.filter(~sampling.missing(F.col("value"), nodata))
    ops = [RasterOp("clear", cleared), RasterOp("valid", present, {"nodata": nodata})]
    if mask:
        ops.append(RasterOp("mask", lambda df: imagery.mask_filter(df, mask), {"mask": mask}))
    if style.fill == "bands":
        colours = [c for _, c in style.legend()]
        index = lambda: classify.isoband(F.col("value"), style.thresholds, style.include_lower, style.include_upper)
        ops.append(RasterOp("bands", lambda df: painted(df, classify.band_colour(index(), colours)), {"thresholds": style.thresholds, "colours": colours}))
    elif style.fill == "gradient":
        low, high, stops = style.gradient()
        ramp = colour.ramp(stops)
        t = lambda: classify.gradient(F.col("value"), low, high, style.include_lower, style.include_upper)
        ops.append(RasterOp("gradient", lambda df: painted(df, classify.ramp_colour(t(), ramp)), {"low": low, "high": high}))
    if style.lines is not None:
        ops.append(RasterOp("lines", lambda df: lined(df, style, pixel_ratio), {"width": style.lines.width}))
    return ops


def painted(df: DataFrame, rgba) -> DataFrame:
    names = [c for c in df.columns if c not in "rgba"]
    return computed(df, dict(zip("rgba", rgba, strict=True)), names)


def lined(df: DataFrame, style: options.Contour, pixel_ratio: float) -> DataFrame:
    """The line of the nearest threshold over the fill, in its major or minor colour."""
    lines, kept = style.lines, df.columns
    near = classify.nearest_threshold(F.col("value"), style.thresholds)["i"]
    alpha = classify.line_alpha(F.col("value"), F.col("dx"), F.col("dy"), style.thresholds, lines, pixel_ratio)
    major = near % lines.major_every == 0 if lines.major_every and lines.major_colour else F.lit(False)
    df = computed(df, {"line_alpha": alpha, "line_major": major})
    under, cover = tuple(F.col(c) for c in "rgba"), F.col("line_alpha")
    rgba = classify.over(colour.parse_css(lines.colour), cover, under)
    if lines.major_every and lines.major_colour:
        wide = classify.over(colour.parse_css(lines.major_colour), cover, under)
        rgba = tuple(F.when(F.col("line_major"), a).otherwise(b) for a, b in zip(wide, rgba, strict=True))
    return painted(df, rgba).select(*kept)


def contour_chain(df: DataFrame, style: options.Contour, pixel_ratio: float = 1.0, mask: str | None = None, nodata: float | None = None) -> DataFrame:
    """df (value, dx, dy) with straight r, g, b, a of the contour style."""
    return run(df, contour_ops(style, pixel_ratio, mask, nodata))


@dataclass
class Restyler:
    """Sampled tiles, persisted by the caller, and the style they are drawn in.

    A change is resolved whole before it takes effect: if it fails, the old style stays, and the
    error is raised to whoever asked. Only the plan is built anew; tiles aren't read again.
    """

    samples: DataFrame
    meta: dict
    bands: list[int] | None = None
    rescale: list | None = None
    contour: options.Contour | None = None
    opacity: float = 1.0
    colormap: object = None
    errors: list[str] = field(default_factory=list)

    def __post_init__(self):
        self._check(self)

    @staticmethod
    def _check(style: Restyler) -> None:
        options.check_opacity(style.opacity)
        if style.contour is None:
            options.resolve_imagery(style.meta, style.bands, style.rescale)
        else:
            options.check_band(style.contour.band, style.meta["n_bands"])

    def _update(self, **change) -> None:
        try:
            replace(self, **change)
        except ValueError as e:
            self.errors.append(str(e))
            raise
        for k, v in change.items():
            setattr(self, k, v)

    def set_bands(self, bands: list[int] | None) -> None:
        """Other bands with the stretch as it is."""
        self._update(bands=bands)

    def set_rescale(self, rescale: list | None) -> None:
        """Another stretch; None clears it."""
        self._update(rescale=rescale)

    def set_contour(self, contour: options.Contour | None) -> None:
        self._update(contour=contour)

    def set_opacity(self, opacity: float) -> None:
        self._update(opacity=opacity)

    def frame(self) -> DataFrame:
        """The samples in the present style: r, g, b, a."""
        if self.contour is not None:
            scale, offset = options.value_scale(options.band_sampling(self.meta["kind"], self.meta["bits"], None), self.meta.get("scales"), self.meta.get("offsets"), self.contour.band)
            denorm = options.band_sampling(self.meta["kind"], self.meta["bits"], None).denorm
            raw = F.get("bands", F.lit(self.contour.band)) / denorm
            nodata = self.meta.get("nodata")
            live = self.samples.filter(~sampling.missing(F.get("bands", F.lit(self.contour.band)), nodata))
            return contour_chain(live.withColumn("value", raw * scale + offset), self.contour)
        return imagery.chain(self.samples, options.resolve_imagery(self.meta, self.bands, self.rescale), opacity=self.opacity, colormap=self.colormap)
