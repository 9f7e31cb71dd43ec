"""The query catalogue: name -> (spark, sf_dir) -> DataFrame, with its DuckDB twin where SQL can say it."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import affine, colour, spaces
from ..functions.barrier import computed
from ..operators import classify, halo, imagery, mesh, options, sampling, scheduler, select, viewport
from ..sources import raster
from ..streaming import frames
from . import rasters
from .rasters import PIXELS_SQL, POINTS_SQL, PYRAMID_SQL, embedding_pixels, embedding_tiles, points, table

QUERIES: dict = {}
ORACLE: dict = {}

THRESHOLDS = [50.0, 100.0, 200.0]
PI = repr(math.pi)
C = repr(spaces.WORLD)
LAT = repr(spaces.MAX_LAT)
DEM_T = [-0.2, -0.05, 0.0, 0.05, 0.2]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r12(c):
    return F.round(c, 12)


def _bands_sql(v: str, t: list[float]) -> str:
    return "(" + " + ".join(f"CAST({v} >= CAST({x} AS DOUBLE) AS INTEGER)" for x in t) + ")"


# --- classification -------------------------------------------------------


@query(f"SELECT band, count(*) AS n FROM (SELECT {_bands_sql('value', THRESHOLDS)} - 1 AS band FROM events) WHERE band >= 0 GROUP BY band")
def isoband_hist(spark, sf):
    e = table(spark, sf, "events").select(classify.isoband(F.col("value"), THRESHOLDS).alias("band"))
    return e.filter("band is not null").groupBy("band").agg(F.count("*").alias("n"))


@query(f"SELECT k AS band, count(*) AS n, min(value) AS low, max(value) AS high FROM (SELECT value, {_bands_sql('value', THRESHOLDS)} AS k FROM events) WHERE k < 3 GROUP BY k")
def isoband_open_lower(spark, sf):
    e = table(spark, sf, "events").select("value", classify.isoband(F.col("value"), THRESHOLDS, include_lower=True, include_upper=False).alias("band"))
    return e.filter("band is not null").groupBy("band").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("""SELECT least(255, greatest(0, CAST(floor(least(1, greatest(0, (value - 50) / CAST(150 AS DOUBLE))) * 256 - 0.5) AS INTEGER))) AS texel, count(*) AS n
FROM events WHERE value >= 50 GROUP BY 1""")
def gradient_ramp_index(spark, sf):
    e = table(spark, sf, "events").select(classify.gradient(F.col("value"), 50.0, 200.0).alias("t")).filter("t is not null")
    return e.select(colour.ramp_texels(F.col("t"))[0].alias("texel")).groupBy("texel").agg(F.count("*").alias("n"))


@query("SELECT CAST(band AS INTEGER) AS band, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b, CAST(a AS INTEGER) AS a, label FROM (VALUES (0, 100, 200, 0, 0, 0, 255, '100 – 200'), (1, 200, 300, 136, 136, 136, 255, '200 – 300'), (2, 300, NULL, 255, 255, 255, 255, '≥ 300')) AS t(band, low, high, r, g, b, a, label)")
def legend_bands(spark, sf):
    style = options.Contour([100.0, 200.0, 300.0], colours=["#000", "#888", "#fff"])
    rows = [(b.band, b.min, b.max, *c, options.legend_text(b)) for b, c in style.legend()]
    return spark.createDataFrame(rows, "band int, low double, high double, r int, g int, b int, a int, label string")


@query("""SELECT event_id, CAST(i AS INTEGER) AS i, d FROM (SELECT event_id, i, abs(value - t) AS d, row_number() OVER (PARTITION BY event_id ORDER BY abs(value - t), i) AS r
FROM events, (VALUES (0, CAST(50 AS DOUBLE)), (1, CAST(100 AS DOUBLE)), (2, CAST(200 AS DOUBLE))) AS q(i, t)) WHERE r = 1""")
def nearest_threshold(spark, sf):
    near = classify.nearest_threshold(F.col("value"), THRESHOLDS)
    return table(spark, sf, "events").select("event_id", near["i"].alias("i"), near["d"].alias("d"))


_BILINEAR_SQL = f"""WITH p AS ({PIXELS_SQL}), q AS (SELECT a.gx, a.gy, a.v AS v00, b.v AS v10, c.v AS v01, d.v AS v11 FROM p a
JOIN p b ON b.gx = a.gx + 1 AND b.gy = a.gy JOIN p c ON c.gx = a.gx AND c.gy = a.gy + 1 JOIN p d ON d.gx = a.gx + 1 AND d.gy = a.gy + 1)"""


def _quads(spark, sf) -> DataFrame:
    """Every 2 x 2 block of the mosaic's texels, across tile seams: of each padded tile, where the neighbours exist."""
    side, p = rasters.TILE, F.col("p")
    tiles = halo.with_halo(embedding_tiles(spark, sf)).select("x", "y", "padded", "near", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("p"))
    row, column = F.floor(p / side).cast("int"), p % side
    there = lambda dx, dy: F.get("near", F.lit(halo.OFFSETS.index((dx, dy))))
    right, low = column == side - 1, row == side - 1
    whole = (~right | there(1, 0)) & (~low | there(0, 1)) & (~(right & low) | there(1, 1))
    at = lambda dx, dy: F.get("padded", (row + 1 + dy) * (side + 2) + column + 1 + dx)
    return computed(tiles.filter(whole), {"gx": F.col("x") * side + column, "gy": F.col("y") * side + row, "v00": at(0, 0), "v10": at(1, 0), "v01": at(0, 1), "v11": at(1, 1)}, [])


@query(f"{_BILINEAR_SQL} SELECT gx, gy, round(((v00 + (v10 - v00) * 0.25) + ((v01 + (v11 - v01) * 0.25) - (v00 + (v10 - v00) * 0.25)) * 0.75), 12) AS value FROM q")
def bilinear_seam(spark, sf):
    s = sampling.blended(*[F.col(c) for c in ("v00", "v10", "v01", "v11")], F.lit(0.25), F.lit(0.75))
    return _quads(spark, sf).select("gx", "gy", r12(s["value"]).alias("value"))


@query(f"{_BILINEAR_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE round(v00, 2) <> 0.05 AND round(v10, 2) <> 0.05 AND round(v01, 2) <> 0.05 AND round(v11, 2) <> 0.05) AS valid FROM q")
def bilinear_nodata(spark, sf):
    coarse = [F.round(F.col(c), 2) for c in ("v00", "v10", "v01", "v11")]
    s = sampling.blended(*coarse, F.lit(0.0), F.lit(0.0), nodata=0.05)
    return _quads(spark, sf).select(s["valid"].alias("ok")).agg(F.count("*").alias("n"), F.count_if("ok").alias("valid"))


@query(f"{_BILINEAR_SQL} SELECT gx, gy, round((v10 - v00) + ((v11 - v01) - (v10 - v00)) * 0.5, 12) AS dx, round((v01 - v00) + ((v11 - v10) - (v01 - v00)) * 0.5, 12) AS dy FROM q")
def analytic_gradient(spark, sf):
    s = sampling.blended(*[F.col(c) for c in ("v00", "v10", "v01", "v11")], F.lit(0.5), F.lit(0.5))
    return _quads(spark, sf).select("gx", "gy", r12(s["dx"]).alias("dx"), r12(s["dy"]).alias("dy"))


@query("""SELECT vec_id, CAST(k AS INTEGER) AS k, CAST(embedding[1 + least(7, greatest(0, CASE WHEN py - floor(py) < 0.5 THEN floor(py) ELSE floor(py) + 1 END))::INTEGER * 8 + least(7, greatest(0, CASE WHEN px - floor(px) < 0.5 THEN floor(px) ELSE floor(px) + 1 END))::INTEGER] AS DOUBLE) AS value
FROM (SELECT vec_id, embedding, k, k / CAST(8 AS DOUBLE) * 8 - 0.5 + 0.3 AS px, (8 - k) / CAST(8 AS DOUBLE) * 8 - 0.5 + 0.3 AS py FROM embeddings, range(9) AS r(k) WHERE len(embedding) = 64)""")
def nearest_sample(spark, sf):
    e = table(spark, sf, "embeddings").filter("size(embedding) = 64").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8))))
    s = sampling.nearest(F.col("embedding").cast("array<double>"), F.col("k") / 8.0 + 0.3 / 8, (8 - F.col("k")) / 8.0 + 0.3 / 8, 8, 8)
    return e.select("vec_id", "k", s["value"].alias("value"))


@query(f"""{_BILINEAR_SQL}, s AS (SELECT gx, gy, v00 AS value, sqrt((v10 - v00) * (v10 - v00) + (v01 - v00) * (v01 - v00)) AS g FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY abs(value - t), i) AS r, abs(value - t) AS d FROM s, (VALUES {', '.join(f'({i}, CAST({t} AS DOUBLE))' for i, t in enumerate(DEM_T))}) AS q(i, t)),
h AS (SELECT *, CASE WHEN i % 2 = 0 THEN 1.0 ELSE 0.5 END AS half FROM n WHERE r = 1),
x AS (SELECT gx, gy, CASE WHEN g > 0 THEN least(1, greatest(0, d / g - (half - 0.5))) END AS t FROM h)
SELECT gx, gy, round(CASE WHEN t IS NULL THEN 0 ELSE 1 - t * t * (3 - 2 * t) END, 9) AS alpha FROM x""")
def contour_line_alpha(spark, sf):
    q = _quads(spark, sf)
    s = sampling.blended(*[F.col(c) for c in ("v00", "v10", "v01", "v11")], F.lit(0.0), F.lit(0.0))
    q = computed(q, {k: s[k] for k in ("value", "dx", "dy")}, ["gx", "gy"])
    a = classify.line_alpha(F.col("value"), F.col("dx"), F.col("dy"), DEM_T, options.Lines(width=1.0, major_every=2, major_width=2.0))
    return q.select("gx", "gy", F.round(a, 9).alias("alpha"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Per tile and isoband: samples and pixels under a contour line, sampled half-way between texels over a stitched halo."""
    tiles = halo.with_halo(embedding_tiles(spark, sf))
    side = rasters.TILE
    cells = tiles.select("x", "y", "padded", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("p"))
    u, v = (F.col("p") % side + 1) / float(side), (F.floor(F.col("p") / side) + 1) / float(side)
    s = sampling.bilinear(F.col("padded"), u, v, side, side, halo=1)
    rows = computed(cells, {k: s[k] for k in ("value", "dx", "dy")}, ["x", "y"])
    line = classify.line_alpha(F.col("value"), F.col("dx"), F.col("dy"), DEM_T, options.Lines())
    rows = rows.select("x", "y", classify.isoband(F.col("value"), DEM_T, include_lower=True).alias("band"), line.alias("line"))
    return rows.groupBy("x", "y", "band").agg(F.count("*").alias("n"), F.count_if(F.col("line") > 0.5).alias("on_line"))


_SEAM = f"""WITH p AS ({PIXELS_SQL}), t AS (SELECT DISTINCT x, y FROM p),
s AS (SELECT x, y, gx, gy, v,
 coalesce(r.v10, v) AS v10, coalesce(d.v01, v) AS v01, coalesce(c.v11, CASE WHEN gx % 8 = 7 AND gy % 8 = 7 THEN coalesce(CASE WHEN r.v10 IS NOT NULL THEN r.v10 END, CASE WHEN d.v01 IS NOT NULL THEN d.v01 END, v) WHEN gx % 8 = 7 THEN d.v01 ELSE r.v10 END) AS v11
 FROM p LEFT JOIN (SELECT gx - 1 AS gx, gy, v AS v10 FROM p) r USING (gx, gy) LEFT JOIN (SELECT gx, gy - 1 AS gy, v AS v01 FROM p) d USING (gx, gy) LEFT JOIN (SELECT gx - 1 AS gx, gy - 1 AS gy, v AS v11 FROM p) c USING (gx, gy)),
m AS (SELECT x, y, (v + (v10 - v) * 0.5) + ((v01 + (v11 - v01) * 0.5) - (v + (v10 - v) * 0.5)) * 0.5 AS value, (v10 - v) + ((v11 - v01) - (v10 - v)) * 0.5 AS dx, (v01 - v) + ((v11 - v10) - (v01 - v)) * 0.5 AS dy FROM s),
b AS (SELECT x, y, {_bands_sql('value', DEM_T)} AS band, least({', '.join(f'abs(value - CAST({t} AS DOUBLE))' for t in DEM_T)}) AS d, sqrt(dx * dx + dy * dy) AS g FROM m)
SELECT x, y, band, count(*) AS n, count(*) FILTER (WHERE g > 0 AND least(1, greatest(0, d / g)) * least(1, greatest(0, d / g)) * (3 - 2 * least(1, greatest(0, d / g))) < 0.5) AS on_line FROM b GROUP BY x, y, band"""


@query(_SEAM)
def tile_band_counts(spark, sf):
    return flagship(spark, sf)


# --- halo -----------------------------------------------------------------


@query(f"WITH p AS ({PIXELS_SQL}) SELECT a.gx, a.gy, a.v, coalesce(l.v, a.v) AS left_v, coalesce(u.v, a.v) AS upper_v FROM p a LEFT JOIN p l ON l.gx = a.gx - 1 AND l.gy = a.gy LEFT JOIN p u ON u.gx = a.gx AND u.gy = a.gy - 1")
def halo_edges(spark, sf):
    p = embedding_pixels(spark, sf).select("gx", "gy", "v")
    p = halo.pixel_neighbour(halo.pixel_neighbour(p, -1, 0, "l"), 0, -1, "u")
    return p.select("gx", "gy", "v", F.coalesce("l", "v").alias("left_v"), F.coalesce("u", "v").alias("upper_v"))


@query(f"""WITH p AS ({PIXELS_SQL}) SELECT a.x, a.y, a.v AS own, coalesce(d.v, CASE WHEN l.v IS NOT NULL THEN l.v WHEN u.v IS NOT NULL THEN u.v ELSE a.v END) AS corner
FROM (SELECT * FROM p WHERE gx % 8 = 0 AND gy % 8 = 0) a LEFT JOIN p d ON d.gx = a.gx - 1 AND d.gy = a.gy - 1 LEFT JOIN p l ON l.gx = a.gx - 1 AND l.gy = a.gy LEFT JOIN p u ON u.gx = a.gx AND u.gy = a.gy - 1""")
def halo_corners(spark, sf):
    t = halo.with_halo(embedding_tiles(spark, sf))
    return t.select("x", "y", F.get("plane", F.lit(0)).alias("own"), F.get("padded", F.lit(0)).alias("corner"))


@query(f"SELECT x, y, gx, gy, v FROM ({PIXELS_SQL})")
def emb_pixels(spark, sf):
    return embedding_pixels(spark, sf)


@query("SELECT vec_id, CAST(b AS INTEGER) AS b, round(CAST(sum(v) FILTER (WHERE i % 4 = b) AS DOUBLE), 9) AS total FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(64)) AS i FROM embeddings WHERE len(embedding) = 64), range(4) AS q(b) GROUP BY vec_id, b")
def deinterleave(spark, sf):
    e = table(spark, sf, "embeddings").filter("size(embedding) = 64")
    planes = raster.planar(F.col("embedding").cast("array<double>"), 4, F.lit(4), F.lit(4))
    p = e.select("vec_id", F.posexplode(planes).alias("b", "plane"))
    return p.select("vec_id", "b", F.round(F.aggregate("plane", F.lit(0.0), lambda a, x: a + x), 9).alias("total"))


# --- coordinates ----------------------------------------------------------

_PHI = f"(greatest(-{LAT}, least({LAT}, lat)) * {PI} / 180)"
_LOGTAN = f"ln(tan({PI} / 4 + {_PHI} / 2))"


@query(f"SELECT id, round((180 + lng) / 360, 12) + 0.0 AS mx, round(0.5 - {_LOGTAN} / (2 * {PI}), 12) + 0.0 AS my FROM ({POINTS_SQL})")
def mercator_from_lnglat(spark, sf):
    mx, my = spaces.mercator_from_lnglat(F.col("lng"), F.col("lat"))
    return points(spark, sf).select("id", (r12(mx) + 0.0).alias("mx"), (r12(my) + 0.0).alias("my"))


@query(f"SELECT id, round(lng, 9) AS lng, round(greatest(-{LAT}, least({LAT}, lat)), 9) AS lat FROM ({POINTS_SQL})")
def common_roundtrip(spark, sf):
    lng, lat = spaces.lnglat_from_common(*spaces.common_from_lnglat(F.col("lng"), F.col("lat")))
    return points(spark, sf).select("id", F.round(lng, 9).alias("lng"), F.round(lat, 9).alias("lat"))


@query(f"SELECT id, round(sin(lng * {PI} / 180) * cos({_PHI}), 9) + 0.0 AS x, round(sin({_PHI}), 9) + 0.0 AS y, round(cos(lng * {PI} / 180) * cos({_PHI}), 9) + 0.0 AS z FROM ({POINTS_SQL})")
def sphere_points(spark, sf):
    s = spaces.sphere_from_mercator(*spaces.mercator_from_lnglat(F.col("lng"), F.col("lat")))
    return points(spark, sf).select("id", *[(F.round(c, 9) + 0.0).alias(n) for c, n in zip(s, "xyz", strict=True)])


@query(f"SELECT id, CAST(CAST(lng AS FLOAT) AS DOUBLE) AS hi, CAST(CAST(lng - CAST(CAST(lng AS FLOAT) AS DOUBLE) AS FLOAT) AS DOUBLE) AS lo FROM ({POINTS_SQL})")
def fp64_split(spark, sf):
    hi, lo = spaces.split_double(F.col("lng"))
    return points(spark, sf).select("id", hi.cast("double").alias("hi"), lo.cast("double").alias("lo"))


@query(f"SELECT id, round(lng / 360 * {C}, 3) AS x, round(({_LOGTAN}) / (2 * {PI}) * {C}, 3) AS y, round(512 / (cos(greatest(-89, least(89, lat)) * {PI} / 180) * 40075016.686), 15) AS units FROM ({POINTS_SQL})")
def metres_and_units(spark, sf):
    x, y = spaces.metres_from_common(*spaces.common_from_lnglat(F.col("lng"), F.col("lat")))
    return points(spark, sf).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(spaces.units_per_metre(F.col("lat")), 15).alias("units"))


# --- pyramids and selection ----------------------------------------------


@query(f"SELECT z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, x * 256 * a AS left_x, f - y * 256 * a AS top_y, (x + 1) * 256 * a AS right_x, f - (y + 1) * 256 * a AS bottom_y FROM ({PYRAMID_SQL}), range(4) AS i(x), range(4) AS j(y) WHERE x < n AND y < n")
def affine_tile_corners(spark, sf):
    lv = affine.with_level_facts(rasters.pyramid(spark))
    t = lv.withColumns({"min_col": F.lit(0), "min_row": F.lit(0), "max_col": F.col("matrix_w") - 1, "max_row": F.col("matrix_h") - 1})
    c = affine.tile_corners(F.col("x"), F.col("y"))
    return affine.exploded(t).select("z", "x", "y", c[0][0].alias("left_x"), c[0][1].alias("top_y"), c[3][0].alias("right_x"), c[3][1].alias("bottom_y"))


_BOX_SQL = "SELECT o_orderkey AS id, o_orderkey * 37 % 262144 - CAST(1000 AS DOUBLE) AS x0, o_orderkey * 53 % 262144 - CAST(1000 AS DOUBLE) AS y0 FROM orders"


def _boxes(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("id"), (k * 37 % 262144 - 1000.0).alias("x0"), (k * 53 % 262144 - 1000.0).alias("y0"))


@query(f"""SELECT id, z, greatest(0, CAST(floor(x0 / (256 * a)) AS BIGINT)) AS min_col, least(n - 1, CAST(floor((x0 + 70000) / (256 * a)) AS BIGINT)) AS max_col,
greatest(0, CAST(floor((262144 - (y0 + 70000)) / (256 * a)) AS BIGINT)) AS min_row, least(n - 1, CAST(floor((262144 - y0) / (256 * a)) AS BIGINT)) AS max_row FROM ({_BOX_SQL}), ({PYRAMID_SQL})""")
def crs_box_tile_range(spark, sf):
    lv = affine.with_level_facts(rasters.pyramid(spark))
    b = _boxes(spark, sf).crossJoin(F.broadcast(lv))  # three levels
    box = (F.col("x0"), F.col("y0"), F.col("x0") + 70000, F.col("y0") + 70000)
    return b.select("id", "z", *[c.alias(n) for n, c in affine.tile_range(box).items()])


@query(f"""WITH r AS (SELECT id, z, greatest(0, CAST(floor(x0 / (256 * a)) AS BIGINT)) AS c0, least(n - 1, CAST(floor((x0 + 70000) / (256 * a)) AS BIGINT)) AS c1, greatest(0, CAST(floor((262144 - (y0 + 70000)) / (256 * a)) AS BIGINT)) AS r0, least(n - 1, CAST(floor((262144 - y0) / (256 * a)) AS BIGINT)) AS r1 FROM ({_BOX_SQL}), ({PYRAMID_SQL}))
SELECT z, x, y, count(*) AS n FROM (SELECT z, unnest(range(c0, c1 + 1)) AS x, r0, r1 FROM r WHERE c0 <= c1 AND r0 <= r1), range(4) AS q(y) WHERE y BETWEEN r0 AND r1 GROUP BY z, x, y""")
def tiles_of_boxes(spark, sf):
    return affine.exploded(crs_box_tile_range(spark, sf)).groupBy("z", "x", "y").agg(F.count("*").alias("n"))


@query(f"""SELECT p.z, p.x, p.y, CAST(cx AS INTEGER) AS child_x, CAST(cy AS INTEGER) AS child_y FROM (SELECT z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, n FROM ({PYRAMID_SQL}), range(4) AS i(x), range(4) AS j(y) WHERE x < n AND y < n AND z < 2) p, range(4) AS k(cx), range(4) AS l(cy)
WHERE cx BETWEEN 2 * x AND least(2 * n - 1, 2 * x + 2) AND cy BETWEEN 2 * y AND least(2 * n - 1, 2 * y + 2)""")
def child_tiles(spark, sf):
    lv = affine.with_level_facts(rasters.pyramid(spark))
    t = lv.filter("z < 2").withColumns({"min_col": F.lit(0), "min_row": F.lit(0), "max_col": F.col("matrix_w") - 1, "max_row": F.col("matrix_h") - 1})
    every = affine.exploded(t).select("z", "x", "y")
    kids = select.children(every.withColumn("frame", F.col("z") * 100 + F.col("x") * 10 + F.col("y")), lv).withColumnsRenamed({"x": "child_x", "y": "child_y"})
    return kids.select((F.col("z") - 1).alias("z"), F.floor(F.col("frame") % 100 / 10).cast("int").alias("x"), (F.col("frame") % 10).cast("int").alias("y"), "child_x", "child_y")


def _views(spark, sf) -> DataFrame:
    """A flat viewport for each event: zoom by value, culling planes x <= edge and y >= 0 in common space."""
    e = table(spark, sf, "events")
    edge = 256.0 + F.pmod("event_id", F.lit(100)) / 25.0
    plane = lambda x, y, d: F.struct(F.lit(x).alias("nx"), F.lit(y).alias("ny"), F.lit(0.0).alias("nz"), d.alias("d"))
    return e.select(
        F.col("event_id").alias("frame"), (3.0 + F.pmod("event_id", F.lit(9))).alias("zoom"), F.lit(0.0).alias("lng"), F.lit(0.0).alias("lat"),
        F.array(plane(-1.0, 0.0, edge), plane(0.0, 1.0, F.lit(0.0))).alias("planes"),
        F.lit(-180.0).alias("west"), F.lit(-85.0).alias("south"), F.lit(180.0).alias("east"), F.lit(85.0).alias("north"), F.lit(1.0).alias("pixel_ratio"),
    )


_SELECT_SQL = f"""WITH RECURSIVE lv AS ({PYRAMID_SQL}), v AS (SELECT event_id AS frame, CAST(3 + event_id % 9 AS DOUBLE) AS zoom, 256 + (event_id % 100) / CAST(25 AS DOUBLE) AS edge FROM events),
t AS (SELECT lv.z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, a, (x * 256 * a / {C} + 0.5) * 512 AS cx0, ((f - (y + 1) * 256 * a) / {C} + 0.5) * 512 AS cy0, ((f - y * 256 * a) / {C} + 0.5) * 512 AS cy1 FROM lv, range(4) AS i(x), range(4) AS j(y) WHERE x < n AND y < n),
s AS (SELECT frame, zoom, edge, t.*, CASE WHEN z = 2 THEN TRUE ELSE a / (40075016.686 * cos(2 * atan(exp((cy0 + cy1) / 2 / 512 * 2 * {PI} - {PI})) - {PI} / 2) / pow(2, zoom + 9)) <= 1 END AS done FROM v, t WHERE cx0 <= edge),
w AS (SELECT frame, z, x, y, done FROM s WHERE z = 0 UNION SELECT c.frame, c.z, c.x, c.y, c.done FROM w JOIN s c ON c.frame = w.frame AND c.z = w.z + 1 AND c.x BETWEEN 2 * w.x AND 2 * w.x + 2 AND c.y BETWEEN 2 * w.y AND 2 * w.y + 2 WHERE NOT w.done)"""


@query(f"{_SELECT_SQL} SELECT frame, z, x, y FROM w WHERE done")
def pyramid_select(spark, sf):
    return select.select_tiles(affine.with_level_facts(rasters.pyramid(spark)), _views(spark, sf), depth=3)


@query(f"{_SELECT_SQL} SELECT z, count(*) AS tiles, count(DISTINCT frame) AS frames FROM w WHERE done GROUP BY z")
def lod_select(spark, sf):
    return pyramid_select(spark, sf).groupBy("z").agg(F.count("*").alias("tiles"), F.countDistinct("frame").alias("frames"))


@query(f"SELECT event_id AS frame, count(*) AS n FROM events, (SELECT CAST(x AS INTEGER) AS x FROM range(4) AS i(x)) WHERE (x * 65536 / {C} + 0.5) * 512 <= 256 + (event_id % 100) / CAST(25 AS DOUBLE) GROUP BY 1")
def frustum_cull_halfspace(spark, sf):
    x = spaces.common_from_metres(F.col("x") * 65536.0, F.lit(0.0))[0]
    hull = F.array(*[F.struct((x + d).alias("x"), F.lit(1.0).alias("y"), F.lit(0.0).alias("z")) for d in (0.0, 0.5)])
    t = _views(spark, sf).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return t.filter(select.in_frustum(hull, F.col("planes"))).groupBy("frame").agg(F.count("*").alias("n"))


@query("SELECT event_id AS frame, 0 AS z, x, 0 AS y FROM events, (SELECT CAST(x AS INTEGER) AS x FROM range(128) AS i(x)) WHERE x BETWEEN greatest(0, CAST(floor((event_id % 300 - 150 + 180) / 360.0 * 128) AS INTEGER)) AND least(127, CAST(floor((least(180, event_id % 300 - 150 + 20) + 180) / 360.0 * 128) AS INTEGER))")
def root_tiles_culled(spark, sf):
    half = spaces.WORLD / 2
    top = spark.createDataFrame([(0, spaces.WORLD / (128 * 256), 0.0, -half, 0.0, -spaces.WORLD / 256, half, 128 * 256, 256, 256, 256, 1.0)], "z int, a double, b double, c double, d double, e double, f double, array_w int, array_h int, tile_w int, tile_h int, mpu double")
    west = F.pmod("event_id", F.lit(300)) - 150.0
    view = table(spark, sf, "events").select(F.col("event_id").alias("frame"), west.alias("west"), F.lit(-80.0).alias("south"), (west + 20).alias("east"), F.lit(80.0).alias("north"))
    return select.roots(affine.with_level_facts(top), view)


# --- imagery --------------------------------------------------------------

_RGB_SQL = "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS r, CAST(embedding[2] AS DOUBLE) AS g, CAST(embedding[3] AS DOUBLE) AS b, CAST(embedding[4] AS DOUBLE) AS k FROM embeddings"


def _rgb(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate("rgbk")])


@query("SELECT vec_id, CAST(embedding[5] AS DOUBLE) AS r, CAST(embedding[3] AS DOUBLE) AS g, CAST(embedding[2] AS DOUBLE) AS b, CAST(1 AS DOUBLE) AS a FROM embeddings WHERE round(CAST(embedding[5] AS DOUBLE), 2) <> 0.01")
def band_composite(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("bands", F.col("embedding").cast("array<double>"))
    at = lambda i: {"value": F.get("bands", F.lit(i)), "valid": ~sampling.missing(F.round(F.get("bands", F.lit(i)), 2), 0.01) if i == 4 else F.lit(True)}
    rgba, stay = sampling.composite([at(4), at(2), at(1), at(0)], options.channel_map([4, 2, 1]), 1.0)
    return e.filter(stay).select("vec_id", *[c.alias(n) for c, n in zip(rgba, "rgba", strict=True)])


@query(f"SELECT vec_id, round(greatest(0, least(1, (r + 0.2) / 0.4)), 12) AS r, round(greatest(0, least(1, (g + 0.2) / 0.4)), 12) AS g, round(greatest(0, least(1, (b + 0.2) / 0.4)), 12) AS b FROM ({_RGB_SQL})")
def linear_rescale(spark, sf):
    out = imagery.linear_rescale((F.col("r"), F.col("g"), F.col("b")), [(-0.2, 0.2)] * 3)
    return _rgb(spark, sf).select("vec_id", *[r12(c).alias(n) for c, n in zip(out, "rgb", strict=True)])


@query(f"SELECT vec_id, round(1 - r, 12) AS r, round(1 - r, 12) AS g, round(1 - r, 12) AS b, CAST(1 AS DOUBLE) AS a FROM ({_RGB_SQL})")
def gray_invert(spark, sf):
    return _rgb(spark, sf).select("vec_id", *[r12(c).alias(n) for c, n in zip(imagery.coloured((F.col("r"),), "grey-inverted"), "rgba", strict=True)])


@query(f"SELECT vec_id, round((1 - abs(r)) * (1 - abs(k)), 12) AS r, round((1 - abs(g)) * (1 - abs(k)), 12) AS g, round((1 - abs(b)) * (1 - abs(k)), 12) AS b FROM ({_RGB_SQL})")
def cmyk_rgb(spark, sf):
    out = colour.cmyk(*[F.abs(F.col(c)) for c in "rgbk"])
    return _rgb(spark, sf).select("vec_id", *[r12(c).alias(n) for c, n in zip(out[:3], "rgb", strict=True)])


def _lab_sql() -> str:
    v = ["((fy) + a / 500)", "(fy)", "((fy) - b / 200)"]
    xyz = [f"{w} * CASE WHEN {t} * {t} * {t} >= 0.008856 THEN {t} * {t} * {t} ELSE ({t} - 16 / CAST(116 AS DOUBLE)) / 7.787 END" for w, t in zip(colour.WHITE, v, strict=True)]
    lin = [" + ".join(f"({m}) * {c}" for m, c in zip(row, "XYZ", strict=True)) for row in colour.SRGB]
    gam = [f"round(greatest(0, least(1, CASE WHEN {c} >= 0.0031308 THEN 1.055 * pow(greatest({c}, 0), 1 / CAST(2.4 AS DOUBLE)) - 0.055 ELSE 12.92 * {c} END)), 9) AS {n}" for c, n in zip(("lr", "lg", "lb"), "rgb", strict=True)]
    return f"""WITH p AS (SELECT vec_id, (abs(r) * 255 + 16) / 116 AS fy, (abs(g) - 0.5) * 255 AS a, (abs(b) - 0.5) * 255 AS b FROM ({_RGB_SQL})), q AS (SELECT vec_id, {', '.join(f'{e} AS {n}' for e, n in zip(xyz, 'XYZ', strict=True))} FROM p),
l AS (SELECT vec_id, {', '.join(f'{e} AS l{n}' for e, n in zip(lin, 'rgb', strict=True))} FROM q) SELECT vec_id, {', '.join(gam)} FROM l"""


@query(_lab_sql())
def cielab_rgb(spark, sf):
    out = colour.cielab(*[F.abs(F.col(c)) for c in "rgb"])
    return _rgb(spark, sf).select("vec_id", *[F.round(c, 9).alias(n) for c, n in zip(out[:3], "rgb", strict=True)])


@query("SELECT vec_id, CAST(['#111111', '#222222', '#333333', '#444444', '#555555'][1 + label % 5] AS VARCHAR) AS css FROM embeddings")
def palette_lookup(spark, sf):
    e = table(spark, sf, "embeddings")
    colours = F.array(*[F.lit(f"#{d * 6}") for d in "12345"])
    return e.select("vec_id", imagery.palette_lookup((F.col("label") % 5 + 0.5) / 5, colours).alias("css"))


@query("SELECT vec_id, label FROM embeddings WHERE label % 3 <> 0")
def mask_filter(spark, sf):
    return imagery.mask_filter(table(spark, sf, "embeddings").withColumn("mask", F.col("label") % 3)).select("vec_id", "label")


@query(f"SELECT vec_id, round(r * 0.8 * 0.5, 12) AS r, round(g * 0.8 * 0.5, 12) AS g, round(b * 0.8 * 0.5, 12) AS b, round(0.8 * CAST(0.5 AS DOUBLE), 12) AS a FROM ({_RGB_SQL})")
def premultiply(spark, sf):
    out = colour.premultiplied((F.col("r"), F.col("g"), F.col("b"), F.lit(0.8)), 0.5)
    return _rgb(spark, sf).select("vec_id", *[r12(c).alias(n) for c, n in zip(out, "rgba", strict=True)])


@query("SELECT vec_id, CAST(CAST('0x' || substr(h, 1, 2) AS INTEGER) AS INTEGER) AS r, CAST(CAST('0x' || substr(h, 3, 2) AS INTEGER) AS INTEGER) AS g, CAST(CAST('0x' || substr(h, 5, 2) AS INTEGER) AS INTEGER) AS b FROM (SELECT vec_id, printf('%06x', vec_id * 7919 % 16777216) AS h FROM embeddings)")
def css_colour_parse(spark, sf):
    css = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("vec_id") * 7919 % 16777216), 6, "0")))
    return table(spark, sf, "embeddings").select("vec_id", *[c.alias(n) for n, c in colour.css_hex_columns(css).items()])


@query("SELECT CAST(i AS INTEGER) AS i, round(CAST(10 AS DOUBLE) + i * CAST(90 AS DOUBLE) / 6, 6) AS t FROM range(7) AS r(i)")
def linspace_thresholds(spark, sf):
    return spark.createDataFrame(list(enumerate(options.linspace(10, 100, 7))), "i int, t double")


@query("SELECT CAST(x AS INTEGER) AS x, CAST(floor(255 * CAST(x AS DOUBLE) / 4 + 0.5) AS INTEGER) AS r, 0 AS g, 0 AS b, 255 AS a FROM range(5) AS q(x)")
def gradient_ramp(spark, sf):
    return spark.createDataFrame([(i, *c) for i, c in enumerate(colour.ramp(colour.gradient_stops(["#000000", "#ff0000"]), 5))], "x int, r int, g int, b int, a int")


# --- loading and caching --------------------------------------------------

_STATE_SQL = "SELECT o_custkey % 50 AS session, o_orderkey AS seq, CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderstatus = 'O' AS wanted FROM orders"


def _state(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 50).alias("session"), F.col("o_orderkey").alias("seq"), F.floor("o_totalprice").alias("bytes"), (F.col("o_orderstatus") == "O").alias("wanted"))


@query(f"""SELECT session, seq, bytes FROM (SELECT *, coalesce(sum(bytes) OVER w, 0) AS b, coalesce(count(*) OVER w, 0) AS n FROM ({_STATE_SQL}) WINDOW w AS (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE b < 1500000 OR n = 0""")
def upload_budget(spark, sf):
    return scheduler.uploads(_state(spark, sf).drop("wanted"), 1_500_000, ["session"])


@query(f"SELECT session, seq FROM (SELECT *, count(*) OVER (PARTITION BY session) AS n, row_number() OVER (PARTITION BY session, wanted ORDER BY seq) AS r FROM ({_STATE_SQL})) WHERE NOT wanted AND r <= n - 6")
def prune_loads(spark, sf):
    return scheduler.prunes(_state(spark, sf), 6, ["session"], ["seq"]).select("session", "seq")


@query(f"""SELECT session, seq FROM (SELECT *, sum(bytes) OVER w - bytes AS b, count(*) OVER w - 1 AS i FROM (SELECT *, sum(bytes) OVER (PARTITION BY session) AS total, count(*) OVER (PARTITION BY session) AS n FROM ({_STATE_SQL})) WHERE NOT wanted
WINDOW w AS (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE total - b > 20000000 OR n - i > 200""")
def evict_lru(spark, sf):
    return scheduler.evictions(_state(spark, sf).withColumn("evictable", ~F.col("wanted")), 20_000_000, 200, ["session"], ["seq"]).select("session", "seq")


@query("SELECT event_id, CASE WHEN event_id % 5 + 1 <= 3 THEN CAST(event_id * 10 + 1000 * pow(2, event_id % 5) AS BIGINT) END AS retry_at FROM events")
def retry_schedule(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", scheduler.retry_at(F.col("event_id") * 10, F.pmod("event_id", F.lit(5)) + 1).alias("retry_at"))


_TILES_SQL = "SELECT CAST(event_id % 3 AS INTEGER) AS z, CAST((event_id * 7 + user_id) % (1 << (2 + event_id % 3)) AS INTEGER) AS x, CAST((event_id * 13 + user_id * 5) % (1 << (2 + event_id % 3)) AS INTEGER) AS y, event_id % 20 AS session, event_type FROM events"


def _tiles(spark, sf, loaded: bool) -> DataFrame:
    e = table(spark, sf, "events").withColumn("z", F.pmod("event_id", F.lit(3)).cast("int"))
    side = F.expr("shiftleft(4, z)")
    e = e.select("z", F.pmod(F.col("event_id") * 7 + F.col("user_id"), side).cast("int").alias("x"), F.pmod(F.col("event_id") * 13 + F.col("user_id") * 5, side).cast("int").alias("y"), F.pmod("event_id", F.lit(20)).alias("session"), "event_type")
    return e.filter((F.col("event_type") == "click") if loaded else (F.col("event_type") != "click")).drop("event_type").distinct()


def _hits(spark, sf) -> DataFrame:
    """Loaded tiles over each wanted one: keys at every other level, then an equi-join."""
    want, have = _tiles(spark, sf, False), _tiles(spark, sf, True)
    span = lambda c: F.explode(F.expr(f"sequence({c} * shiftleft(1, 2 - z), ({c} + 1) * shiftleft(1, 2 - z) - 1)"))
    cell = lambda df: df.withColumn("gx", span("x")).withColumn("gy", span("y"))
    other = cell(have).select("session", "gx", "gy", F.col("z").alias("hit_z"), F.col("x").alias("hit_x"), F.col("y").alias("hit_y"))
    return cell(want).join(other, ["session", "gx", "gy"]).select("session", "z", "x", "y", "hit_z", "hit_x", "hit_y").distinct()


_HITS_SQL = f"""WITH t AS (SELECT DISTINCT * FROM ({_TILES_SQL})), h AS (SELECT DISTINCT a.session, a.z, a.x, a.y, b.z AS hit_z, b.x AS hit_x, b.y AS hit_y FROM t a JOIN t b ON a.session = b.session AND a.event_type <> 'click' AND b.event_type = 'click'
AND a.x * (1 << (2 - a.z)) < (b.x + 1) * (1 << (2 - b.z)) AND (a.x + 1) * (1 << (2 - a.z)) > b.x * (1 << (2 - b.z)) AND a.y * (1 << (2 - a.z)) < (b.y + 1) * (1 << (2 - b.z)) AND (a.y + 1) * (1 << (2 - a.z)) > b.y * (1 << (2 - b.z)))"""


@query(f"{_HITS_SQL} SELECT * EXCLUDE (r) FROM (SELECT *, rank() OVER (PARTITION BY session, z, x, y ORDER BY hit_z DESC) AS r FROM h WHERE hit_z < z) WHERE r = 1")
def stand_in_ancestor(spark, sf):
    return scheduler.stand_in(_hits(spark, sf), ["session", "z", "x", "y"], finer=False)


@query(f"{_HITS_SQL} SELECT * EXCLUDE (r) FROM (SELECT *, rank() OVER (PARTITION BY session, z, x, y ORDER BY hit_z) AS r FROM h WHERE hit_z > z AND hit_z - z <= 2) WHERE r = 1")
def stand_in_descendant(spark, sf):
    return scheduler.stand_in(_hits(spark, sf), ["session", "z", "x", "y"], finer=True)


@query(f"SELECT DISTINCT session, z, x, y FROM ({_TILES_SQL}) WHERE event_type <> 'click' EXCEPT SELECT session, z, x, y FROM ({_TILES_SQL}) WHERE event_type = 'click'")
def missing_tiles(spark, sf):
    return scheduler.missing(_tiles(spark, sf, False), _tiles(spark, sf, True), ["session", "z", "x", "y"]).select("session", "z", "x", "y")


_BOXED_SQL = f"SELECT z, x * 64.0 / (1 << z) AS x0, y * 64.0 / (1 << z) AS y0, (x + 1) * 64.0 / (1 << z) AS x1, (y + 1) * 64.0 / (1 << z) AS y1, session, event_type FROM (SELECT DISTINCT * FROM ({_TILES_SQL}))"


@query(f"""WITH b AS ({_BOXED_SQL}), t AS (SELECT DISTINCT z, x0 + 56 AS x0, y0, x1 + 56 AS x1, y1 FROM b WHERE event_type <> 'click'), s AS (SELECT DISTINCT z, x0, y0, x1, y1 FROM b WHERE event_type = 'click')
SELECT z, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM t WHERE EXISTS (SELECT 1 FROM s WHERE t.x0 < s.x1 AND t.x1 > s.x0 AND t.y0 < s.y1 AND t.y1 > s.y0 AND t.z - s.z <= 2)""")
def overlap_semi(spark, sf):
    """Tiles of a raster 56 units to the east that a selection still touches."""
    def boxes(df, east):
        f = lambda c, d: ((F.col(c) + d) * 64.0 / F.expr("shiftleft(1, z)")).cast("double")
        return df.select("z", (f("x", 0) + east).alias("x0"), f("y", 0).alias("y0"), (f("x", 1) + east).alias("x1"), f("y", 1).alias("y1")).distinct()

    return scheduler.near_selection(boxes(_tiles(spark, sf, False), 56), boxes(_tiles(spark, sf, True), 0), 16.0)


@query(f"SELECT z, x, y, CAST(row_number() OVER (PARTITION BY z ORDER BY (x - 3) * (x - 3) + (y - 5) * (y - 5), x, y) AS INTEGER) AS r FROM (SELECT DISTINCT z, x, y FROM ({_TILES_SQL}) WHERE event_type = 'click')")
def centre_out_order(spark, sf):
    from pyspark.sql.window import Window

    t = _tiles(spark, sf, True).select("z", "x", "y").distinct()
    w = Window.partitionBy("z").orderBy(scheduler.from_centre(F.col("x"), F.col("y"), F.lit(3), F.lit(5)), "x", "y")
    return t.withColumn("r", F.row_number().over(w))


@query("SELECT c_custkey AS key, c_acctbal AS touched FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey DESC) AS r, count(*) OVER () AS n FROM customer) WHERE n <= 100 OR r <= 50")
def cache_sweep(spark, sf):
    return select.swept(table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("touched")), 100)


@query(f"SELECT session, count(*) AS size, CAST(count(*) FILTER (WHERE wanted) AS BIGINT) AS loading, CAST(0 AS BIGINT) AS pending, CAST(coalesce(sum(bytes) FILTER (WHERE NOT wanted), 0) AS BIGINT) AS byte_size FROM ({_STATE_SQL}) GROUP BY session")
def state_counters(spark, sf):
    s = _state(spark, sf).withColumn("state", F.when(F.col("wanted"), "loading").otherwise("loaded"))
    return scheduler.counters(s, ["session"])


@query(f"""SELECT id, CASE WHEN ok THEN round(greatest(0, least(1, least(({LAT} - top) / (bottom - top), (-{LAT} - top) / (bottom - top)))), 12) END AS v_top, CASE WHEN ok THEN round(greatest(0, least(1, greatest(({LAT} - top) / (bottom - top), (-{LAT} - top) / (bottom - top)))), 12) END AS v_bottom
FROM (SELECT id, lat AS top, lat - 30 AS bottom, NOT (abs(lat) <= {LAT} AND abs(lat - 30) <= {LAT}) AND greatest(0, least(1, greatest(({LAT} - lat) / -30, (-{LAT} - lat) / -30))) - greatest(0, least(1, least(({LAT} - lat) / -30, (-{LAT} - lat) / -30))) >= 1e-9 AS ok FROM ({POINTS_SQL}))""")
def web_mercator_clamp(spark, sf):
    v = mesh.clamp_rows(F.col("lat"), F.col("lat") - 30)
    return points(spark, sf).select("id", *[r12(c).alias(n) for n, c in v.items()])


# --- rows only: iterative or stateful -------------------------------------


def _forward(x, y):
    """Degrees to mercator, on arrays."""
    phi = np.radians(np.clip(y, -spaces.MAX_LAT, spaces.MAX_LAT))
    return (np.asarray(x) + 180) / 360, 0.5 - np.log(np.tan(np.pi / 4 + phi / 2)) / (2 * np.pi)


def _inverse(mx, my):
    return np.asarray(mx) * 360 - 180, np.degrees(2 * np.arctan(np.exp((0.5 - np.asarray(my)) * 2 * np.pi)) - np.pi / 2)


def _mesh_tiles(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation").select(F.lit(0).alias("z"), F.col("n_nationkey").cast("int").alias("x"), F.lit(0).alias("y"), F.lit(256).alias("width"), F.lit(256).alias("height"), F.lit(10.0 / 256).alias("a"), F.lit(0.0).alias("b"), (F.col("n_nationkey") * 10 - 125.0).alias("c"), F.lit(0.0).alias("d"), F.lit(-10.0 / 256).alias("e"), (F.col("n_nationkey") * 6 - 70.0).alias("f"))
    return n.withColumns(mesh.clamp_rows(F.col("f"), F.col("f") - 10)).repartition(8, "x")


@query()
def mesh_triangles(spark, sf):
    """Vertices of warp meshes for degree tiles on a sphere-to-mercator warp."""
    return mesh.meshes(_mesh_tiles(spark, sf), _forward, _inverse)


@query()
def scheduler_fold(spark, sf):
    """The loader over each user's events: a frame an event, three tiles wanted in each."""
    from pyspark.sql.window import Window

    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    keys = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat_ws("/", F.lit("2"), ((F.col("event_id") + i) % 8).cast("string"), (F.col("event_id") % 4).cast("string")))
    f = e.select(F.col("user_id").cast("string").alias("session"), (F.row_number().over(w)).cast("bigint").alias("frame"), F.unix_micros(F.col("ts").cast("timestamp")).alias("now"), keys.alias("keys"), F.lit(65536).cast("bigint").alias("tile_bytes"))
    return frames.fold(f, byte_cap=1 << 20)


@query()
def globe_select(spark, sf):
    """Selection on a globe, horizon plane and foreshortening included."""
    c, y10 = spaces.WORLD, spaces.WORLD / 360 * 10.05115
    rows = [(z, c / (256 * n), 0.0, -c / 2, 0.0, -2 * y10 / 256, y10, 256 * n, 256, 256, 256, 1.0) for z, n in enumerate((2, 24))]
    lv = affine.with_level_facts(spark.createDataFrame(rows, "z int, a double, b double, c double, d double, e double, f double, array_w int, array_h int, tile_w int, tile_h int, mpu double"))
    view = viewport.viewport(spark, 0, "globe", 2, 0, 0, [spaces.horizon_plane((0, 0, 1, -0.3))], (-180, -85, 180, 85), units=1 / 6371008.8, camera=(0, 0, 1))
    return select.select_tiles(lv, view, globe=True, depth=2)


from . import extended  # noqa: E402, F401  adds its queries to these
