"""Golden values of single operators.

The numbers are fixed values of FIXTURES.md, which results must equal; they stand as they are there.
"""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import affine, colour, spaces
from gridloom.operators import classify, halo, mesh, options, sampling, scheduler, select, viewport
from gridloom.plans import rasters
from gridloom.streaming import frames


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_sphere(spark):
    s = lambda lng, lat: one(spark, *spaces.sphere_from_mercator(*spaces.mercator_from_lnglat(F.lit(lng), F.lit(lat))))
    assert s(0.0, 0.0) == pytest.approx((0, 0, 1), abs=1e-12)
    assert s(90.0, 0.0) == pytest.approx((1, 0, 0), abs=1e-12)
    assert s(0.0, 85.0)[1] == pytest.approx(math.sin(math.radians(85)))


def test_horizon():
    assert spaces.horizon_plane((0, 0, 2, -0.6)) == pytest.approx((0, 0, 1, -0.3))
    with pytest.raises(ValueError):
        spaces.horizon_plane((0, 0, 0, 1))


@pytest.mark.parametrize("v", [0.5231234567890123, 0.123456789012345, 1e-9, 0.9999999999, 0.5])
def test_split(spark, v):
    hi, lo = one(spark, *spaces.split_double(F.lit(v)))
    assert abs(hi + lo - v) <= abs(v) * 2**-46


def test_matrix_shift(spark):
    m = [2.0, 0, 0, 0, 0, 2.0, 0, 0, 0, 0, 2.0, 0, 10.0, 20.0, 0, 1.0]
    out = one(spark, spaces.shift_matrix(F.array(*map(F.lit, map(float, m))), F.lit(3.0), F.lit(4.0)))[0]
    assert out[12] == 16 and out[13] == 28 and out[15] == 1


def test_units(spark):
    u = lambda lat: one(spark, spaces.units_per_metre(F.lit(lat)))[0]
    assert u(0.0) == pytest.approx(512 / 40075016.686)
    assert u(60.0) == pytest.approx(2 * u(0.0))
    assert u(90.0) == u(89.0) and math.isfinite(u(90.0))


def test_planes():
    ident = np.eye(4)
    planes = viewport.frustum_planes(ident)
    assert len(planes) == 6 and all(math.hypot(*p[:3]) == pytest.approx(1) for p in planes)
    assert viewport.frustum_planes(np.zeros((4, 4))) == [] and len(viewport.frustum_planes(ident, sides_only=True)) == 4


def test_tile_transform_round_trip(spark):
    lv = affine.with_level_facts(rasters.pyramid(spark)).filter("z = 1")
    there, back = affine.tile_transform(F.lit(1), F.lit(1))
    x, y = affine.apply(there, F.lit(3.0), F.lit(5.0))
    assert lv.select(*affine.apply(back, x, y)).first() == pytest.approx((3.0, 5.0))


@pytest.mark.parametrize(
    ("zoom", "bias", "want"),
    [(4, 0, {(0, 0, 0)}), (11, 0, {(1, x, y) for x in (0, 1) for y in (0, 1)}), (11, 5, {(0, 0, 0)})],
)
def test_selection(spark, zoom, bias, want):
    lv = affine.with_level_facts(rasters.pyramid(spark).filter("z < 2"))
    far = [(1, 0, 0, 1e9), (-1, 0, 0, 1e9), (0, 1, 0, 1e9), (0, -1, 0, 1e9), (0, 0, 1, 1e9), (0, 0, -1, 1e9)]
    view = viewport.viewport(spark, 0, "mercator", zoom, 0, 0, far, (-180, -85, 180, 85))
    got = select.select_tiles(lv, view, depth=2, lod_bias=bias)
    assert {(r["z"], r["x"], r["y"]) for r in got.collect()} == want


def as_plane(rows, w):
    return np.array(rows, float).reshape(-1, w)


def test_halo_golden():
    c = as_plane([1, 2, 3, 4], 2)
    assert halo.stitch(c, {}).ravel().tolist() == [1, 1, 2, 2, 1, 1, 2, 2, 3, 3, 4, 4, 3, 3, 4, 4]
    near = {(1, 0): (as_plane([20, 21, 99, 100], 2), as_plane([255, 255, 0, 255], 2)), (1, 1): (as_plane([77, 0, 0, 0], 2), as_plane([0, 1, 1, 1], 2))}
    assert halo.stitch(c, near).ravel().tolist() == [1, 1, 2, 20, 1, 1, 2, 20, 3, 3, 4, 4, 3, 3, 4, 4]
    zero = as_plane([0, 0], 2)
    p = lambda *v: (as_plane(v, 2), None)
    near = {(-1, 0): p(10, 11), (1, 0): p(20, 21), (0, 1): p(30, 31), (-1, 1): p(40, 41), (1, 1): p(51, 52)}
    assert halo.stitch(zero, near).ravel().tolist() == [11, 0, 0, 20, 11, 0, 0, 20, 41, 30, 31, 51]
    with pytest.raises(ValueError):
        halo.stitch(c, {(1, 0): (as_plane([1, 2], 2), None)})


def test_halo_tiles(spark):
    rows = [(0, x, y, 2, 2, [10.0 * x + y] * 4, None) for x in (0, 1) for y in (0, 1)]
    t = spark.createDataFrame(rows, "z int, x int, y int, width int, height int, plane array<double>, mask array<tinyint>")
    padded = lambda df: df.filter("x = 0 and y = 0").first()["padded"]
    assert padded(halo.with_halo(t)) == [0, 0, 0, 10, 0, 0, 0, 10, 0, 0, 0, 10, 1, 1, 1, 11]
    assert padded(halo.with_halo(t.filter("not (x = 1 and y = 0)"))) == [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 11]


def test_missing_spreads_at_weight_zero(spark):
    v = [F.lit(1.0), F.lit(float("nan")), F.lit(3.0), F.lit(4.0)]
    s = sampling.blended(*v, F.lit(0.0), F.lit(0.0))
    assert one(spark, s["valid"], s["value"]) == (False, None)
    s = sampling.blended(*[F.lit(x) for x in (1.0, 2.0, 3.0, 7.0)], F.lit(0.0), F.lit(0.0), nodata=7)
    assert one(spark, s["valid"])[0] is False


def test_bands_and_colours():
    b = options.contour_bands([100, 200])
    assert [(x.min, x.max) for x in b] == [(100, 200), (200, None)]
    b = options.contour_bands([100, 200], True, False)
    assert [(x.min, x.max) for x in b] == [(None, 100), (100, 200)]
    for bad in ([], [2, 1], [1, math.nan]):
        with pytest.raises(ValueError):
            options.contour_bands(bad)
    assert colour.parse_css("#f008") == (255, 0, 0, 136) and colour.parse_css("#1a2B3c") == (26, 43, 60, 255)
    assert colour.parse_css("rgba(86,139,84,0.5)") == (86, 139, 84, 128) and colour.parse_css("rgb(50% 0% 100% / 25%)") == (128, 0, 255, 64)
    assert colour.parse_css(" RGB(1 2 3) ") == (1, 2, 3, 255)
    for bad in ("red", "hsl(0 0% 0%)", "#12", "rgb(1,2)", "", "#ggg"):
        with pytest.raises(ValueError):
            colour.parse_css(bad)
    assert [c[0] for c in colour.ramp(colour.gradient_stops(["#000000", "#ff0000"]), 5)] == [0, 64, 128, 191, 255]


def test_band_selection():
    s = options.select_bands
    assert s(1, 1, None) == [0] and s(3, 1, None) == [0]
    assert s(2, 4, [0]) == [0, 1, 2] and s(2, 4, None) == [0, 1, 2] and s(2, 4, [1]) == [0, 1, 2, 3] and s(2, 4, [2]) == [0, 1, 2, 3]
    assert s(1, 4, [0, 0, 2]) == [0, 1, 2, 3] and s(1, 4, [2, 0, 0]) == [0, 1, 2] and s(2, 5, [2, 0]) == [0, 1, 2, 3]
    for args in ((1, 2, None), (1, 8, None), (2, 2, None), (5, 4, None, [3, 2, 1, 0]), (8, 3, None, [0, 1, 2]), (3, 1, None, [0, 0, 0])):
        with pytest.raises(ValueError):
            s(*args)
    for bands in ([4, 2, 1], [6], [6, 4, 2, 7], [0, 0, 0]):
        assert s(1, 8, None, bands) == bands


def test_sample_types_and_rescale():
    assert options.sample_type(["uint"], [8], 4) == "short" and options.sample_type(["float"], [32]) == "float"
    for bad in ((["uint", "int"], [8, 8]), (["uint", "uint"], [8, 16]), (["float"], [64]), (["uint"], [16], 4)):
        with pytest.raises(ValueError):
            options.sample_type(*bad)
    assert options.resolve_rescale([(51, 204)], "uint", 8, 1)[0] == (51 / 255, 204 / 255)
    assert options.resolve_rescale(None, "uint", 8, 3) is None
    with pytest.raises(ValueError):
        options.resolve_rescale(None, "uint", 16, 3)
    assert [options.sample_max(*x) for x in (("uint", 8), ("uint", 16), ("int", 16), ("float", 32))] == [255, 65535, 32767, 1]
    assert options.value_scale(options.band_sampling("uint", 8, 255), [0.5], [10], 0) == (127.5, 10)


def test_line_of_width_zero(spark):
    a = classify.line_alpha(F.lit(1.0), F.lit(1.0), F.lit(0.0), [1.0], options.Lines(width=0))
    assert one(spark, a)[0] == 0.5


def test_nan_has_no_band(spark):
    assert one(spark, classify.isoband(F.lit(float("nan")), [1.0]))[0] is None


def test_eviction_is_the_loop(spark):
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for s in range(40):
        sizes, may = rng.integers(1, 9, 12).tolist(), (rng.random(12) < 0.7).tolist()
        total, n = sum(sizes), 12
        for i in range(12):
            if may[i] and (total > 30 or n > 7):
                total, n = total - sizes[i], n - 1
                want.add((s, i))
        rows += [(s, i, sizes[i], may[i]) for i in range(12)]
    df = spark.createDataFrame(rows, "session int, seq int, bytes int, evictable boolean")
    got = scheduler.evictions(df, 30, 7, ["session"], ["seq"]).collect()
    assert {(r["session"], r["seq"]) for r in got} == want


def test_mesh_error_bound():
    warp = lambda x, y: (np.asarray(x), np.exp(np.asarray(y) / 100))
    back = lambda x, y: (np.asarray(x), 100 * np.log(np.asarray(y)))
    uv, triangles, error = mesh.refine(256, 256, warp, back)
    assert error <= 0.125 and len(triangles) > 2
    area = 0.0
    for a, b, c in uv[triangles]:
        area += abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2
    assert area == pytest.approx(1.0)


def test_mesh_of_a_warp_that_jumps():
    same = lambda x, y: (np.asarray(x), np.asarray(y))
    jump = lambda x, y: (np.asarray(x) + 5 * (np.asarray(x) + np.asarray(y) > 5.3), np.asarray(y))
    with pytest.raises(ValueError, match="jumps"):
        mesh.refine(8, 8, same, jump)


def test_retry_and_fold():
    tiles, fails = {}, frozenset({"a"})
    log = [frames.step(tiles, f, now, ["a"], {}, 6, 1 << 30, 100, fails=fails)["loads"] for f, now in enumerate([0, 500, 1000, 1500, 2900, 3000, 9000])]
    assert log == [1, 0, 0, 1, 0, 0, 1]


def test_fold_stream(spark, tmp_path):
    shape = "session string, frame bigint, now bigint, keys array<string>, tile_bytes bigint"
    rows = [("s", f, f * 10, [f"0/{f % 3}/0"], 100) for f in range(6)]
    want = {tuple(r) for r in frames.fold(spark.createDataFrame(rows, shape)).collect()}
    for i in (0, 3):
        spark.createDataFrame(rows[i : i + 3], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = frames.fold_stream(spark.readStream.schema(shape).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("folded").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("folded").collect()} == want


def test_dataset(spark, tmp_path):
    from gridloom.sources.raster import LEVEL, META, TILE, RasterDataset

    meta = spark.createDataFrame([("d", "EPSG:3857", 1.0, "float", 32, 1, 1, None, None, None, None, None)], META)
    level = rasters.pyramid(spark).filter("z < 2").withColumn("dataset_id", F.lit("d"))
    tile = spark.createDataFrame([("d", 1, x, y, 2, 2, [[float(x + y)] * 4], None) for x in (0, 1) for y in (0, 1)], TILE)
    RasterDataset(meta, level.select(*[c.split()[0] for c in LEVEL.split(", ")]), tile).save(str(tmp_path / "r"))
    ds = RasterDataset.open(spark, str(tmp_path / "r"))
    view = viewport.viewport(spark, 0, "mercator", 11, 0, 0, [], (-180, -85, 180, 85))
    assert ds.fetch(ds.select(view)).count() == 4
    assert ds.padded(0).filter("x = 0 and y = 0").first()["padded"][-1] == 2.0
    d = ds.describe().first()
    assert d["west"] == pytest.approx(0) and d["north"] == pytest.approx(2.354, abs=0.01)
