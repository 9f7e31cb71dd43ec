"""More of the catalogue: sources, caches, whole render chains, warps, and the frame's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import affine, spaces
from ..functions.barrier import computed
from ..operators import cache, halo, imagery, mesh, options, sampling, scheduler, select, style, viewport, warp
from ..sources import raster
from ..streaming import loader
from . import catalogue as base
from . import rasters
from .catalogue import DEM_T, LAT, _BILINEAR_SQL, _HITS_SQL, _STATE_SQL, _TILES_SQL, C, _bands_sql, _quads, _state, _tiles, _views, query, r12
from .rasters import POINTS_SQL, embedding_tiles, points, table

# --- sources --------------------------------------------------------------

_LEVELS_SQL = """SELECT CAST(n_regionkey AS VARCHAR) AS dataset_id, n_nationkey AS k, CAST(10 + n_nationkey * 7 % 25 AS DOUBLE) AS a, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY 10 + n_nationkey * 7 % 25 DESC) - 1 AS INTEGER) AS z FROM nation"""


def _levels(spark, sf) -> DataFrame:
    """Overviews of five datasets, a nation each, by pixel size."""
    k, a = F.col("n_nationkey"), (10 + F.col("n_nationkey") * 7 % 25).cast("double")
    n = table(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("dataset_id"), k.alias("k"), a.alias("a"), F.lit(0.0).alias("b"), (k * 100.0).alias("c"), F.lit(0.0).alias("d"), (-a).alias("e"), (k * 50.0).alias("f"), (100 + k).cast("int").alias("array_w"), (200 + k).cast("int").alias("array_h"), F.lit(64).alias("tile_w"), F.lit(64).alias("tile_h"), F.lit(1.0).alias("mpu"))
    return raster.numbered(n)


@query(f"SELECT dataset_id, k, z FROM ({_LEVELS_SQL})")
def level_numbers(spark, sf):
    return _levels(spark, sf).select("dataset_id", "k", "z")


@query(f"SELECT dataset_id, k * CAST(100 AS DOUBLE) AS min_x, k * CAST(50 AS DOUBLE) - a * (200 + k) AS min_y, k * CAST(100 AS DOUBLE) + a * (100 + k) AS max_x, k * CAST(50 AS DOUBLE) AS max_y FROM ({_LEVELS_SQL}) WHERE z = 0")
def dataset_bounds(spark, sf):
    return affine.with_level_facts(_levels(spark, sf)).filter("z = 0").select("dataset_id", "min_x", "min_y", "max_x", "max_y")


@query("SELECT o_orderkey AS id, CAST(o_orderkey % 3 AS INTEGER) AS z, CAST(256 * pow(2, o_orderkey % 3) AS INTEGER) AS array_w FROM orders")
def level_images(spark, sf):
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).cast("int").alias("z"))
    return asked.join(F.broadcast(rasters.pyramid(spark).select("z", "array_w")), "z")  # a level a row


@query("SELECT vec_id, 64 * (1 + label % 3) * 4 + CASE WHEN label % 2 = 0 THEN 64 ELSE 0 END AS bytes FROM embeddings")
def tile_bytes(spark, sf):
    size = raster.tile_bytes(F.lit(8), F.lit(8), 1 + F.col("label") % 3, 4, F.col("label") % 2 == 0)
    return table(spark, sf, "embeddings").select("vec_id", size.alias("bytes"))


@query(f"""WITH t AS (SELECT DISTINCT z, x, y FROM ({_TILES_SQL}) WHERE event_type <> 'click'), s AS (SELECT DISTINCT z, x, y FROM ({_TILES_SQL}) WHERE event_type = 'click'), c AS (SELECT z, x, y FROM s WHERE x % 2 = 0)
SELECT t.z, t.x, t.y, c.x IS NOT NULL AS hit, c.x IS NULL AND s.x IS NULL AS failed FROM t LEFT JOIN s USING (z, x, y) LEFT JOIN c USING (z, x, y)""")
def decoded_batch(spark, sf):
    """Wanted tiles of a batch: from the cache, read, or failed alone."""
    source = _tiles(spark, sf, True).select("z", "x", "y").distinct()
    return cache.fetched(_tiles(spark, sf, False).select("z", "x", "y"), source, source.filter("x % 2 = 0")).select("z", "x", "y", "hit", "failed")


@query(f"""SELECT session, seq FROM (SELECT *, sum(bytes) OVER w - bytes AS b FROM (SELECT *, sum(bytes) OVER (PARTITION BY session) AS total FROM ({_STATE_SQL})) WHERE NOT wanted AND seq % 4 <> 0
WINDOW w AS (PARTITION BY session ORDER BY seq % 100, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE total - b > 10000000""")
def decoded_evictions(spark, sf):
    s = _state(spark, sf).withColumns({"state": F.when(F.col("wanted"), "decoding").otherwise("resolved"), "waiters": (F.col("seq") % 4 == 0).cast("int"), "used": F.col("seq") % 100, "key": F.col("seq")})
    return cache.decoded_evictions(s, ["session"], 10_000_000).select("session", "seq")


@query("""SELECT c_custkey, coalesce(c_custkey % 2 = n_nationkey % 2 AND c_custkey % 3 = n_nationkey % 3, FALSE) AS hit, CASE WHEN c_custkey % 2 = n_nationkey % 2 AND c_custkey % 3 = n_nationkey % 3 THEN n_name END AS volume FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20""")
def volume_cache(spark, sf):
    """Cached bounding volumes, which hold for one projection and elevation range only."""
    kind = lambda k: F.when(k % 2 == 0, "mercator").otherwise("globe")
    facts = lambda k: {"projection": kind(k), "z_low": F.lit(0.0), "z_high": (k % 3).cast("double")}
    held = table(spark, sf, "nation").filter("n_nationkey < 20").select((F.col("n_nationkey") % 5).alias("z"), F.col("n_nationkey").alias("x"), F.lit(0).alias("y"), "n_nationkey", F.col("n_name").alias("volume")).withColumns(facts(F.col("n_nationkey")))
    asked = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("z"), F.col("c_nationkey").alias("x"), F.lit(0).alias("y")).withColumns(facts(F.col("c_custkey")))
    return cache.volume_hits(held, asked).select("c_custkey", "hit", "volume")


# --- coordinates and viewports --------------------------------------------


@query(f"SELECT id, round(lng * 200000 / {C} + 0.5, 12) AS mx, round(0.5 - greatest(-{C} / 2, least({C} / 2, lat * 300000)) / {C}, 12) AS my, round(lng * 200000, 3) AS x, round(greatest(-{C} / 2, least({C} / 2, lat * 300000)), 3) AS y FROM ({POINTS_SQL})")
def metres_mercator(spark, sf):
    """Metres to mercator, clamped beyond the world, and back."""
    p = computed(points(spark, sf), dict(zip(("mx", "my"), spaces.mercator_from_metres(F.col("lng") * 200000, F.col("lat") * 300000), strict=True)))
    x, y = spaces.metres_from_mercator(F.col("mx"), F.col("my"))
    return p.select("id", r12(F.col("mx")).alias("mx"), r12(F.col("my")).alias("my"), (F.round(x, 3) + 0.0).alias("x"), (F.round(y, 3) + 0.0).alias("y"))


@query(f"""WITH p AS (SELECT id, CAST(lng AS FLOAT) AS hi, CAST(lng - CAST(CAST(lng AS FLOAT) AS DOUBLE) AS FLOAT) AS lo, CAST(CAST(12.3456789 AS DOUBLE) AS FLOAT) AS chi, CAST(CAST(12.3456789 AS DOUBLE) - CAST(CAST(CAST(12.3456789 AS DOUBLE) AS FLOAT) AS DOUBLE) AS FLOAT) AS clo FROM ({POINTS_SQL}))
SELECT id, CAST(CAST(CAST(hi - chi AS FLOAT) + CAST(lo - clo AS FLOAT) AS FLOAT) AS DOUBLE) AS d FROM p""")
def relative_to_centre(spark, sf):
    hi, lo = spaces.split_double(F.col("lng"))
    chi, clo = spaces.split_double(F.lit(12.3456789))
    return points(spark, sf).select("id", spaces.relative_to_centre(hi, lo, chi, clo).cast("double").alias("d"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(event_id % 11 * 150 AS DOUBLE) / (event_id % 7 * 100) END AS ratio FROM events")
def drawing_ratios(spark, sf):
    ratio = viewport.drawing_ratio(F.col("event_id") % 11 * 150, F.col("event_id") % 7 * 100)
    return table(spark, sf, "events").select("event_id", ratio.cast("double").alias("ratio"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'globe' WHEN event_id % 3 = 1 THEN 'mercator' END AS projection FROM events")
def variant_projections(spark, sf):
    variant = F.concat(F.element_at(F.array(*map(F.lit, ("globe-v2", "plain-mercator", "other"))), (F.col("event_id") % 3 + 1).cast("int")), F.lit("/"), F.col("event_type"))
    return table(spark, sf, "events").select("event_id", viewport.variant_projection(variant).alias("projection"))


@query(f"""WITH p AS (SELECT id, (180 + lng) / 360 AS mx, 0.5 - {base._LOGTAN} / (2 * {base.PI}) AS my FROM ({POINTS_SQL}))
SELECT id, CAST(0.8 AS DOUBLE) AS opacity, round(CAST(CAST(mx AS FLOAT) AS DOUBLE), 9) AS hx, round(CAST(CAST(my AS FLOAT) AS DOUBLE), 9) + 0.0 AS hy, round(CAST(CAST(mx AS FLOAT) AS DOUBLE) + CAST(CAST(mx - CAST(CAST(mx AS FLOAT) AS DOUBLE) AS FLOAT) AS DOUBLE), 10) AS x FROM p""")
def frame_constants(spark, sf):
    p = viewport.frame_constants(points(spark, sf), 0.8)
    hx, hy = F.col("origin_hi_x").cast("double"), F.col("origin_hi_y").cast("double")
    return p.select("id", "opacity", F.round(hx, 9).alias("hx"), (F.round(hy, 9) + 0.0).alias("hy"), F.round(hx + F.col("origin_lo_x").cast("double"), 10).alias("x"))


# --- selection ------------------------------------------------------------

_BOX = (256.9, 256.3, 258.4, 258.1)
_BOXED_SELECT = base._SELECT_SQL.replace("WHERE cx0 <= edge", f"WHERE cx0 <= edge AND cx0 < {_BOX[2]} AND ((x + 1) * 256 * a / {C} + 0.5) * 512 > {_BOX[0]} AND cy0 < {_BOX[3]} AND cy1 > {_BOX[1]}")


@query(f"{_BOXED_SELECT} SELECT z, x, y, count(*) AS frames FROM w WHERE done GROUP BY z, x, y")
def pyramid_select_box(spark, sf):
    found = select.select_tiles(affine.with_level_facts(rasters.pyramid(spark)), _views(spark, sf), depth=3, box=_BOX)
    return found.groupBy("z", "x", "y").agg(F.count("*").alias("frames"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE -abs(c_acctbal) * CAST(2 AS DOUBLE) END AS low, CASE WHEN c_custkey % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE abs(c_acctbal) * CAST(2 AS DOUBLE) END AS high FROM customer")
def elevation_ranges(spark, sf):
    v = F.when(F.col("c_custkey") % 4 != 0, F.abs("c_acctbal").cast("double"))
    low, high = select.elevation_columns(-v, v, F.lit(2.0))
    return table(spark, sf, "customer").select("c_custkey", low.alias("low"), high.alias("high"))


@query("""SELECT t.x, t.y, count(*) AS n FROM (SELECT CAST(vec_id % 25 AS INTEGER) AS x, CAST(vec_id // 25 AS INTEGER) AS y FROM embeddings WHERE vec_id < 500) t, range(-1, 2) AS i(dx), range(-1, 2) AS j(dy)
WHERE NOT (dx = 0 AND dy = 0) AND t.x + dx BETWEEN 0 AND 24 AND t.y + dy BETWEEN 0 AND 19 GROUP BY t.x, t.y""")
def halo_neighbours(spark, sf):
    n = halo.neighbours(embedding_tiles(spark, sf).filter("y < 20"))
    inside = n.filter("x + dx between 0 and 24 and y + dy between 0 and 19")
    return inside.groupBy("x", "y").agg(F.count("*").alias("n"))


# --- render chains --------------------------------------------------------


@query(f"""WITH s AS (SELECT gx, gy, (v00 + (v10 - v00) * 0.5) + ((v01 + (v11 - v01) * 0.5) - (v00 + (v10 - v00) * 0.5)) * 0.5 AS v, (v10 - v00) + ((v11 - v01) - (v10 - v00)) * 0.5 AS dx, (v01 - v00) + ((v11 - v10) - (v01 - v00)) * 0.5 AS dy FROM ({_BILINEAR_SQL} SELECT * FROM q))
SELECT gx, gy, round(v * 0.1 + 5, 10) AS value, round((dx * 2 - dy * 0.25) * 0.1, 10) + 0.0 AS dx, round((dx * 0.5 + dy * 3) * 0.1, 10) + 0.0 AS dy FROM s""")
def value_texture(spark, sf):
    s = sampling.blended(*[F.col(c) for c in ("v00", "v10", "v01", "v11")], F.lit(0.5), F.lit(0.5))
    s = sampling.scaled(s, 0.1, 5.0, tuple(map(F.lit, (2.0, 0.5, -0.25, 3.0))))
    return _quads(spark, sf).select("gx", "gy", F.round(s["value"], 10).alias("value"), *[(F.round(s[c], 10) + 0.0).alias(c) for c in ("dx", "dy")])


@query("SELECT vec_id, CASE WHEN label % 3 < 2 THEN CAST(label % 3 AS VARCHAR) || '-' || CAST(4 - label % 5 AS VARCHAR) END AS entry FROM embeddings")
def palette_layers(spark, sf):
    maps = F.array(*[F.array(*[F.lit(f"{m}-{i}") for i in range(5)]) for m in range(2)])
    entry = imagery.palette_layer((F.col("label") % 5 + 0.5) / 5, maps, F.col("label") % 3, reverse=True)
    return table(spark, sf, "embeddings").select("vec_id", entry.alias("entry"))


def _raw(spark, sf, most: int) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.transform(F.slice("embedding", 1, 4), lambda v: F.floor(F.abs(v.cast("double")) * most).cast("double")).alias("bands"))


def _raw_sql(most: int) -> str:
    return "SELECT vec_id, label, " + ", ".join(f"floor(abs(CAST(embedding[{i}] AS DOUBLE)) * {most}) AS b{i}" for i in range(1, 5)) + " FROM embeddings"


@query(f"SELECT vec_id, round(b1 / 65535 * (b4 / 65535) * 0.5, 12) AS r, round(b2 / 65535 * (b4 / 65535) * 0.5, 12) AS g, round(b3 / 65535 * (b4 / 65535) * 0.5, 12) AS b, round(b4 / 65535 * 0.5, 12) AS a FROM ({_raw_sql(65535)}) WHERE label % 3 <> 0 AND b1 <> 7000 AND b2 <> 7000 AND b3 <> 7000")
def chain_rgba16(spark, sf):
    """16-bit colour with alpha: mask, nodata, stretch, opacity."""
    how = options.resolve_imagery({"photometric": options.RGB, "n_bands": 4, "kind": "uint", "bits": 16, "extra_samples": [2], "nodata": 7000}, rescale=[(0, 65535)])
    df = imagery.chain(_raw(spark, sf, 65535).withColumn("mask", F.col("label") % 3), how, mask="mask", opacity=0.5)
    return df.select("vec_id", *[r12(F.col(c)).alias(c) for c in "rgba"])


@query("SELECT vec_id, round(i / CAST(255 AS DOUBLE), 12) AS r, round((255 - i) / CAST(255 AS DOUBLE), 12) AS g, round(i * 7 % 256 / CAST(255 AS DOUBLE), 12) AS b, CAST(1 AS DOUBLE) AS a FROM (SELECT vec_id, label * 5 % 256 AS i FROM embeddings WHERE label % 3 <> 0)")
def chain_palette(spark, sf):
    how = options.resolve_imagery({"photometric": options.PALETTE, "n_bands": 1, "kind": "uint", "bits": 8})
    colormap = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.struct(i.alias("r"), (255 - i).alias("g"), (i * 7 % 256).alias("b"), F.lit(255).alias("a")))
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 3).alias("mask"), F.array((F.col("label") * 5 % 256).cast("double")).alias("bands"))
    return imagery.chain(e, how, mask="mask", colormap=colormap).select("vec_id", *[r12(F.col(c)).alias(c) for c in "rgba"])


@query(f"SELECT vec_id, round((1 - b1 / 255) * (1 - b4 / 255), 12) AS r, round((1 - b2 / 255) * (1 - b4 / 255), 12) AS g, round((1 - b3 / 255) * (1 - b4 / 255), 12) AS b, CAST(1 AS DOUBLE) AS a FROM ({_raw_sql(255)})")
def chain_cmyk(spark, sf):
    how = options.resolve_imagery({"photometric": options.SEPARATED, "n_bands": 4, "kind": "uint", "bits": 8})
    return imagery.chain(_raw(spark, sf, 255), how).select("vec_id", *[r12(F.col(c)).alias(c) for c in "rgba"])


@query(f"SELECT vec_id, round(1 - greatest(0, least(1, (b2 - 10) / CAST(190 AS DOUBLE))), 12) AS r, CAST(1 AS DOUBLE) AS a FROM ({_raw_sql(255)})")
def chain_grey_inverted(spark, sf):
    how = options.resolve_imagery({"photometric": options.WHITE_IS_ZERO, "n_bands": 4, "kind": "uint", "bits": 8}, bands=[1], rescale=[(10, 200)])
    return imagery.chain(_raw(spark, sf, 255), how).select("vec_id", r12(F.col("r")).alias("r"), "a")


@query(f"SELECT vec_id, round(least(1, b3 / 200), 12) AS r, round(least(1, b2 / 200), 12) AS g, round(least(1, b1 / 200), 12) AS b FROM ({_raw_sql(255)})")
def restyled(spark, sf):
    """Bands, then a change that fails and leaves all as it was, then a stretch."""
    s = style.Restyler(_raw(spark, sf, 255), {"photometric": options.RGB, "n_bands": 4, "kind": "uint", "bits": 8})
    s.set_bands([2, 1, 0])
    for wrong in (lambda: s.set_bands([9, 1, 0]), lambda: s.set_rescale([(5, 5)])):
        try:
            wrong()
        except ValueError:
            continue
        raise AssertionError("a wrong style was taken")
    s.set_rescale([(0, 200)])
    return s.frame().select("vec_id", *[r12(F.col(c)).alias(c) for c in "rgb"])


_FILL = ["#102030", "#405060", "#708090", "#a0b0c0", "#d0e0f0"]
_RED = [int(c[1:3], 16) for c in _FILL]
_CHAIN_SQL = f"""{_BILINEAR_SQL}, s AS (SELECT gx, gy, v00 AS value, sqrt((v10 - v00) * (v10 - v00) + (v01 - v00) * (v01 - v00)) AS g FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY abs(value - t), i) AS rank, abs(value - t) AS d FROM s, (VALUES {', '.join(f'({i}, CAST({t} AS DOUBLE))' for i, t in enumerate(DEM_T))}) AS q(i, t)),
h AS (SELECT *, CASE WHEN i % 2 = 0 THEN 1.0 ELSE 0.5 END AS half, CASE WHEN i % 2 = 0 THEN 255 ELSE 51 END AS line FROM n WHERE rank = 1),
x AS (SELECT gx, gy, value, line, CASE WHEN g > 0 THEN least(1, greatest(0, d / g - (half - 0.5))) END AS t FROM h), l AS (SELECT gx, gy, value, line, CASE WHEN t IS NULL THEN 0 ELSE 1 - t * t * (3 - 2 * t) END AS c FROM x)"""
_LINES = options.Lines(width=1.0, colour="#333333", major_every=2, major_width=2.0, major_colour="#ff0000")


def _samples(spark, sf) -> DataFrame:
    s = sampling.blended(*[F.col(c) for c in ("v00", "v10", "v01", "v11")], F.lit(0.0), F.lit(0.0))
    return computed(_quads(spark, sf), {k: s[k] for k in ("value", "dx", "dy")}, ["gx", "gy"])


@query(f"""{_CHAIN_SQL}, f AS (SELECT *, {_bands_sql('value', DEM_T)} AS k, CASE WHEN {_bands_sql('value', DEM_T)} < 5 THEN 1 ELSE 0 END AS ua FROM l), o AS (SELECT *, ([{', '.join(map(str, _RED))}, 0])[k + 1] / CAST(255 AS DOUBLE) * ua AS u, c + ua * (1 - c) AS a FROM f)
SELECT gx, gy, round(CASE WHEN a > 0 THEN (line / CAST(255 AS DOUBLE) * c + u * ua * (1 - c)) / a ELSE u END, 9) AS r, round(a, 9) AS a FROM o""")
def contour_chain_bands(spark, sf):
    """Clear, mask, bands with an open lower end and none above, and lines in two colours."""
    how = options.Contour(DEM_T, colours=_FILL, include_lower=True, include_upper=False, lines=_LINES)
    return style.contour_chain(_samples(spark, sf), how).select("gx", "gy", F.round("r", 9).alias("r"), F.round("a", 9).alias("a"))


@query(f"""{_CHAIN_SQL} SELECT gx, gy, round(CASE WHEN c > 0 THEN line / CAST(255 AS DOUBLE) ELSE 0 END, 9) AS r, round(c, 9) AS a FROM l""")
def contour_chain_lines(spark, sf):
    how = options.Contour(DEM_T, fill="none", lines=_LINES)
    return style.contour_chain(_samples(spark, sf), how).select("gx", "gy", F.round("r", 9).alias("r"), F.round("a", 9).alias("a"))


@query(f"""{_BILINEAR_SQL} SELECT gx, gy, v00 >= -0.2 AS shown FROM q""")
def contour_chain_gradient(spark, sf):
    how = options.Contour([-0.2, 0.2], fill="gradient", colours=["#000000", "#ffffff"])
    return style.contour_chain(_samples(spark, sf), how).select("gx", "gy", (F.col("a") > 0).alias("shown"))


# --- warps ----------------------------------------------------------------


def _degrees(spark) -> DataFrame:
    row = [(0, 1.8, 0.0, -180.003, 0.0, -1.0625, 85.0013, 200, 160, 8, 8, 1.0)]
    return affine.with_level_facts(spark.createDataFrame(row, "z int, a double, b double, c double, d double, e double, f double, array_w int, array_h int, tile_w int, tile_h int, mpu double"))


@query(f"""WITH p AS (SELECT id, (lng + 180.003) / 1.8 AS px, (85.0013 - greatest(-{LAT}, least({LAT}, lat))) / 1.0625 AS py FROM ({POINTS_SQL})), t AS (SELECT id, CAST(floor(px) AS BIGINT) AS c, CAST(floor(py) AS BIGINT) AS r FROM p WHERE px >= 0 AND px < 200 AND py >= 0 AND py < 160)
SELECT id, CAST(embedding[1 + r % 8 * 8 + c % 8] AS DOUBLE) AS value FROM t JOIN embeddings ON vec_id = r // 8 * 25 + c // 8 WHERE len(embedding) = 64""")
def warp_nearest(spark, sf):
    """The mosaic as a raster in degrees, seen from mercator: exact inverse projection of every target point."""
    p = points(spark, sf)
    mx, my = spaces.mercator_from_lnglat(F.col("lng"), F.col("lat"))
    _, from_lnglat = raster.crs(4326)
    return warp.warped(computed(p, {"mx": mx, "my": my}, ["id"]), _degrees(spark), embedding_tiles(spark, sf), 0, from_lnglat).select("id", "value")


@query(f"""SELECT n_nationkey AS k, round(greatest(-{LAT}, least({LAT}, CAST(85.0013 - 1.0625 * (n_nationkey * 8) AS DOUBLE))), 9) AS lat_tl, round(greatest(-{LAT}, least({LAT}, CAST(85.0013 - 1.0625 * least(n_nationkey * 8 + 8, 160) AS DOUBLE))), 9) AS lat_br FROM nation WHERE n_nationkey < 20""")
def corner_latitudes(spark, sf):
    to_metres, _ = raster.crs("EPSG:4326")
    n = table(spark, sf, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("k")).crossJoin(F.broadcast(_degrees(spark)))  # one level
    c = warp.corner_latitudes(F.lit(0), F.col("k"), to_metres)
    return n.select("k", *[F.round(c[x], 9).alias(x) for x in ("lat_tl", "lat_br")])


@query(f"""WITH p AS (SELECT n_nationkey AS k, -180.003 + 1.8 * (n_nationkey * 8 + 3) AS lng, 85.0013 - 1.0625 * (n_nationkey % 20 * 8 + 5) AS lat FROM nation)
SELECT k, round((180 + lng) / 360, 10) AS mx, round(0.5 - {base._LOGTAN} / (2 * {base.PI}), 10) AS my FROM p""")
def pixel_mercator(spark, sf):
    """Tile pixel to CRS, metres and mercator."""
    to_metres, _ = raster.crs(4326)
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).crossJoin(F.broadcast(_degrees(spark)))  # one level
    mx, my = warp.mercator_of(F.col("k"), F.col("k") % 20, F.lit(3), F.lit(5), to_metres)
    return n.select("k", F.round(mx, 10).alias("mx"), F.round(my, 10).alias("my"))


@query("SELECT CAST(n_nationkey AS INTEGER) AS x, CAST(65536 AS DOUBLE) AS area, CAST(1 AS BIGINT) AS euler FROM nation")
def mesh_area(spark, sf):
    """Triangles of every tile's mesh cover it once: their area, and vertices - edges + triangles."""
    shapes = mesh.meshes(base._mesh_tiles(spark, sf), base._forward, base._inverse, triangles=True)
    area = F.abs((F.col("u1") - F.col("u0")) * (F.col("v2") - F.col("v0")) - (F.col("u2") - F.col("u0")) * (F.col("v1") - F.col("v0"))) / 2 * 65536
    sides = F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("i0", "i1"), ("i1", "i2"), ("i2", "i0"))])
    corners = shapes.groupBy("x").agg(F.round(F.sum(area), 6).alias("area"), F.count("*").alias("t"))
    lines = shapes.select("x", F.explode(sides).alias("s")).groupBy("x").agg(F.countDistinct("s").alias("e"))
    vertices = shapes.select("x", F.explode(F.array("i0", "i1", "i2")).alias("i")).groupBy("x").agg(F.countDistinct("i").alias("v"))
    return corners.join(lines, "x").join(vertices, "x").select("x", "area", (F.col("v") - F.col("e") + F.col("t")).alias("euler"))


# --- the frame's rules ----------------------------------------------------


@query(f"""SELECT t.session, t.z, t.x, t.y, t.session * 10 AS used FROM (SELECT DISTINCT session, z, x, y FROM ({_TILES_SQL}) WHERE event_type = 'click') t WHERE z = 2 AND x BETWEEN session % 8 AND session % 8 + 3 AND y BETWEEN session % 5 AND session % 5 + 2""")
def loaded_covering(spark, sf):
    have = _tiles(spark, sf, True).withColumn("used", F.lit(0))
    s = F.col("session")
    asked = have.select("session").distinct().select("session", F.lit(2).alias("z"), (s % 8).cast("int").alias("x0"), (s % 5).cast("int").alias("y0"), (s % 8 + 3).cast("int").alias("x1"), (s % 5 + 2).cast("int").alias("y1"), (s * 10).alias("now"))
    return scheduler.loaded_covering(asked, have, ["session"])


@query(f"""{_HITS_SQL} SELECT DISTINCT session, hit_z AS z, hit_x AS x, hit_y AS y FROM h WHERE hit_z < z""")
def protected_ancestors(spark, sf):
    return scheduler.protected_ancestors(_tiles(spark, sf, False), _tiles(spark, sf, True), ["session"], 2)


@query(f"SELECT session, z, x, y, CAST(row_number() OVER (PARTITION BY session ORDER BY z, x, y) AS INTEGER) AS paint FROM (SELECT DISTINCT session, z, x, y FROM ({_TILES_SQL}) WHERE event_type = 'click')")
def painter_order(spark, sf):
    return scheduler.painter_order(_tiles(spark, sf, True), ["session"])


@query("SELECT o_orderkey AS key, CAST(o_custkey % 3 AS INTEGER) AS attempt FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 3 = o_orderkey % 3")
def live_results(spark, sf):
    """Results of loads, without those of an attempt that was given up."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "O", "loading").otherwise("loaded").alias("state"), (F.col("o_orderkey") % 3).cast("int").alias("attempt"), (F.col("o_custkey") % 3).cast("int").alias("of"))
    return scheduler.live_results(o.select("key", F.col("of").alias("attempt")), o.drop("of"), ["key"])


@query(f"SELECT session, CASE WHEN wanted THEN 'abort' ELSE 'free' END AS action, count(*) AS n, CAST(sum(CASE WHEN wanted THEN 0 ELSE bytes END) AS BIGINT) AS bytes FROM ({_STATE_SQL}) GROUP BY session, wanted")
def destroyed(spark, sf):
    s = _state(spark, sf).withColumn("state", F.when(F.col("wanted"), "loading").otherwise("loaded"))
    return scheduler.destroyed(s, ["session"]).groupBy("session", "action").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'ok' WHEN event_id % 4 = 1 THEN 'empty' WHEN event_id % 4 = 3 AND event_id % 5 < 3 THEN 'retry' ELSE 'lost' END AS state, CASE WHEN event_id % 4 = 3 AND event_id % 5 < 3 THEN CAST(event_id + 1000 * pow(2, event_id % 5) AS BIGINT) END AS retry_at FROM events""")
def source_opening(spark, sf):
    result = F.element_at(F.array(*map(F.lit, ("ok", "empty", "lost", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    found = scheduler.open_outcome(F.col("event_id"), F.pmod("event_id", F.lit(5)) + 1, result)
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in found.items()])


@query()
def loader_fold(spark, sf):
    """The whole loader over each user's events: clicks are frames of nine tiles, purchases uploads, the rest results of the first loads."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "click", "frame").when(F.col("event_type") == "purchase", "upload").otherwise("result")
    key = lambda i: F.concat_ws("/", F.lit("3"), ((F.col("event_id") + i % 3) % 8).cast("string"), ((F.col("event_id") * 3 + F.floor(i / 3)) % 8).cast("string"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(8)), key)
    f = e.select((F.col("user_id") % 20).cast("string").alias("session"), F.col("event_id").cast("bigint").alias("seq"), kind.alias("kind"), F.col("event_id").cast("bigint").alias("now"), keys.alias("keys"), key(F.lit(0)).alias("key"), (F.col("event_id") % 9 + 1).cast("int").alias("attempt"), F.lit(4096).cast("bigint").alias("bytes"))
    return loader.fold(f, byte_cap=1 << 18)
