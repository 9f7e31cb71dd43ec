"""Raster datasets as tables: metadata, levels, tiles, and what opening one tells."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import affine, spaces
from ..operators import halo, options, select

META = "dataset_id string, crs string, mpu double, sample_format string, bits int, n_bands int, photometric int, extra_samples array<int>, nodata double, scales array<double>, offsets array<double>, colormap array<struct<r:short,g:short,b:short,a:short>>"
LEVEL = "dataset_id string, z int, a double, b double, c double, d double, e double, f double, array_w int, array_h int, tile_w int, tile_h int, mpu double"
TILE = "dataset_id string, z int, x int, y int, width int, height int, planes array<array<double>>, mask array<tinyint>"

#: CRS name -> (CRS to EPSG:3857 metres, degrees to CRS); `register` adds others.
CRS = {
    "EPSG:3857": (select.identity, spaces.metres_from_lnglat),
    "EPSG:4326": (spaces.metres_from_lnglat, select.identity),
}
# Metres of a unit.
UNITS = {"metre": 1.0, "meter": 1.0, "m": 1.0, "foot": 0.3048, "us survey foot": 1200 / 3937, "degree": spaces.WORLD / 360}


def register(name: str, to_metres, from_lnglat) -> None:
    """Adds a CRS by its two projections, which take and give pairs of Columns; latitudes stop short of the poles."""
    limit = lambda lat: spaces.clamp(lat, -spaces.MAX_LAT, spaces.MAX_LAT)
    CRS[crs_name(name)] = (to_metres, lambda lng, lat: from_lnglat(lng, limit(lat)))


def crs_name(code: int | str) -> str:
    """EPSG:n of a number, of EPSG:n, or of WKT, whose last authority counts; WKT without one goes by its own name."""
    text = str(code).strip()
    if text.isdigit():
        return f"EPSG:{text}"
    if re.fullmatch(r"(?i)epsg:\d+", text):
        return text.upper()
    if found := re.findall(r'(?i)(?:AUTHORITY|ID)\["EPSG"\s*,\s*"?(\d+)"?\]', text):
        return f"EPSG:{found[-1]}"
    if found := re.match(r'\w+\["([^"]+)"', text):
        return found[1]
    return text


def crs(code: int | str):
    name = crs_name(code)
    if name not in CRS:
        raise ValueError(f"unknown CRS {name!r}: register its two projections")
    return CRS[name]


def metres_per_unit(units: str | None) -> float:
    """Of a CRS; one without units can't be measured."""
    if not units or units.lower() not in UNITS:
        raise ValueError(f"a CRS needs known units, not {units!r}")
    return UNITS[units.lower()]


def numbered(overviews: DataFrame) -> DataFrame:
    """Levels with z from the coarsest (0) to the full resolution, by pixel size."""
    w = Window.partitionBy("dataset_id").orderBy(F.desc(F.abs(F.col("a") * F.col("e") - F.col("b") * F.col("d"))))
    return overviews.withColumn("z", (F.row_number().over(w) - 1).cast("int"))


def planar(data: Column, n_bands: int, width: Column, height: Column) -> Column:
    """Planes of interleaved samples; a wrong length raises."""
    from ..operators.imagery import deinterleave

    fits = F.size(data) == width * height * n_bands
    return F.when(fits, deinterleave(data, n_bands)).otherwise(F.raise_error(F.lit("samples don't fill width x height x bands")))


def tile_bytes(width: Column, height: Column, bands: Column | int, sample_bytes: int, masked: Column, padded: int = 0) -> Column:
    return (width + padded) * (height + padded) * bands * sample_bytes + F.when(masked, width * height).otherwise(0)


def geographic_bounds(box: tuple[Column, Column, Column, Column], to_metres, steps: int = 20) -> dict[str, Column]:
    """Degrees of a CRS box, by points along its edges; latitudes are clamped to the mercator range."""
    x0, y0, x1, y1 = box
    edge = [(x0 + (x1 - x0) * (i / steps), y) for i in range(steps + 1) for y in (y0, y1)] + [(x, y0 + (y1 - y0) * (i / steps)) for i in range(steps + 1) for x in (x0, x1)]
    points = [spaces.lnglat_from_common(*spaces.common_from_metres(*to_metres(x, y))) for x, y in edge]
    limit = lambda v: spaces.clamp(v, -spaces.MAX_LAT, spaces.MAX_LAT)
    west, south, east, north = spaces.box_of([p[0] for p in points], [p[1] for p in points])
    return {"west": west, "south": limit(south), "east": east, "north": limit(north)}


@dataclass
class RasterDataset:
    """A raster's tables, opened; nothing runs until an action does."""

    meta: DataFrame
    levels: DataFrame
    tiles: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> RasterDataset:
        """Tables meta, level and tile under a folder; tiles are partitioned by z."""
        return cls(*(spark.read.parquet(f"{folder}/{t}") for t in ("meta", "level", "tile")))

    def save(self, folder: str) -> None:
        self.meta.write.mode("overwrite").parquet(f"{folder}/meta")
        self.levels.write.mode("overwrite").parquet(f"{folder}/level")
        self.tiles.write.mode("overwrite").partitionBy("z").parquet(f"{folder}/tile")

    @cached_property
    def facts(self) -> dict:
        row = self.meta.first()
        if row is None:
            raise ValueError("no metadata")
        found = row.asDict(recursive=True)
        if not found.get("sample_format"):
            raise ValueError("SampleFormat is missing")
        if found["photometric"] == options.PALETTE and not found.get("colormap"):
            raise ValueError("a palette needs a colormap")
        options.sample_type([found["sample_format"]], [found["bits"]])
        return found

    @cached_property
    def level_facts(self) -> DataFrame:
        if not self.levels.take(1):
            raise ValueError("a tileset needs a level")
        return affine.with_level_facts(self.levels)

    def level(self, z: int) -> DataFrame:
        """The facts of a level; a level that isn't there is an error."""
        found = self.level_facts.filter(F.col("z") == z)
        if not found.take(1):
            raise ValueError(f"no level {z}")
        return found

    def describe(self) -> DataFrame:
        """Projection and geographic bounds, of the coarsest level."""
        to_metres, _ = crs(self.facts["crs"])
        box = tuple(F.col(c) for c in ("min_x", "min_y", "max_x", "max_y"))
        return self.level_facts.filter("z = 0").select("dataset_id", F.lit(self.facts["crs"]).alias("crs"), *[c.alias(n) for n, c in geographic_bounds(box, to_metres).items()])

    def fetch(self, wanted: DataFrame) -> DataFrame:
        """Tiles of (z, x, y) keys, of their dataset where the keys name one."""
        keys = [c for c in halo.tile_keys(self.tiles) if c in wanted.columns]
        return self.tiles.join(wanted.select(*keys).distinct(), keys, "left_semi")

    def select(self, view: DataFrame, **how) -> DataFrame:
        to_metres, from_lnglat = crs(self.facts["crs"])
        return select.select_tiles(self.level_facts, view, to_metres=to_metres, from_lnglat=from_lnglat, depth=self.levels.count(), **how)

    def padded(self, band: int) -> DataFrame:
        """Tiles of one band with their halo, in `padded`; persist it to restyle without stitching again."""
        options.check_band(band, self.facts["n_bands"])
        return halo.with_halo(self.tiles.withColumn("plane", F.get("planes", F.lit(band))))

    def imagery(self, bands=None, rescale=None) -> options.Imagery:
        f = self.facts
        return options.resolve_imagery({"photometric": f["photometric"], "n_bands": f["n_bands"], "kind": f["sample_format"], "bits": f["bits"], "extra_samples": f["extra_samples"], "nodata": f["nodata"]}, bands, rescale)
