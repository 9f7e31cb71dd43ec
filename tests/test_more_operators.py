"""Styles, pipelines, warps, caches, CRS names, viewports, and halos of several datasets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import spaces
from gridloom.operators import halo, imagery, mesh, options, select, style, viewport
from gridloom.sources import raster

RGB16 = {"photometric": options.RGB, "n_bands": 4, "kind": "uint", "bits": 16, "extra_samples": [2]}


def test_alpha_of_16_bits(spark):
    df = spark.createDataFrame([([65535.0] * 4,), ([0.0, 0.0, 0.0, 32768.0],)], "bands array<double>")
    out = imagery.chain(df, options.resolve_imagery(RGB16, rescale=[(0, 65535)])).collect()
    assert tuple(out[0][1:]) == (1.0, 1.0, 1.0, 1.0)
    assert out[1]["a"] == pytest.approx(32768 / 65535) and out[1]["r"] == 0


def test_palette_needs_its_colormap(spark):
    how = options.resolve_imagery({"photometric": options.PALETTE, "n_bands": 1, "kind": "uint", "bits": 8})
    with pytest.raises(ValueError):
        imagery.chain(spark.range(1), how)


def test_a_failed_style_leaves_the_old_one(spark):
    df = spark.createDataFrame([([10.0, 20.0, 30.0, 40.0],)], "bands array<double>")
    s = style.Restyler(df, RGB16 | {"extra_samples": None}, rescale=[(0, 100)])
    s.set_bands([2, 1, 0])
    for wrong in (lambda: s.set_bands([7]), lambda: s.set_rescale(None), lambda: s.set_opacity(2.0), lambda: s.set_contour(options.Contour([1.0, 2.0], colours=["#000", "#fff"], band=9))):
        with pytest.raises(ValueError):
            wrong()
    assert len(s.errors) == 4 and s.bands == [2, 1, 0] and s.rescale == [(0, 100)] and s.contour is None
    assert s.frame().first()["r"] == pytest.approx(0.3)
    flat = style.Restyler(df.withColumns({"dx": F.lit(0.0), "dy": F.lit(0.0)}), RGB16, rescale=[(0, 100)])
    flat.set_contour(options.Contour([5.0, 15.0, 25.0], colours=["#000000", "#ff0000", "#00ff00"], band=1))
    assert tuple(flat.frame().first()[c] for c in "rgba") == (1.0, 0.0, 0.0, 1.0)


def test_pipelines():
    ops = style.contour_ops(options.Contour([0.0, 1.0], colours=["#000000", "#ffffff"], lines=options.Lines()), mask="m")
    assert style.pipeline_key("mercator", ops) == "mercator|clear,valid,mask,bands,lines"
    twice = [*ops, style.RasterOp("lines", lambda df: df, {"width": 7})]
    assert style.collect_bindings(twice)["width"] == 7 and style.collect_bindings(ops)["mask"] == "m"


def test_halos_of_two_datasets(spark):
    rows = [(d, 0, x, 0, 2, 1, [v, v], None) for d, v in (("a", 1.0), ("b", 2.0)) for x in range(2)]
    t = spark.createDataFrame(rows, "dataset_id string, z int, x int, y int, width int, height int, plane array<double>, mask array<tinyint>")
    for r in halo.with_halo(t).collect():
        assert set(r["padded"]) == {1.0 if r["dataset_id"] == "a" else 2.0} and r["near"].count(True) == 1


@pytest.mark.parametrize("seed", range(3))
def test_halo_is_the_stitched_one(spark, seed):
    rng = np.random.default_rng(seed)
    w, h = 3, 2
    sent, tiles = {}, []
    for x in range(4):
        for y in range(4):
            if rng.random() < 0.8:
                wide, high = (2 if x == 3 else w), (1 if y == 3 else h)
                plane = rng.integers(0, 100, (high, wide)).astype(float)
                mask = rng.integers(0, 2, (high, wide)) if rng.random() < 0.5 else None
                sent[x, y] = plane, mask
                tiles.append((0, x, y, wide, high, plane.ravel().tolist(), None if mask is None else mask.ravel().tolist()))
    t = spark.createDataFrame(tiles, "z int, x int, y int, width int, height int, plane array<double>, mask array<tinyint>")
    for r in halo.with_halo(t).collect():
        near = {o: sent[r["x"] + o[0], r["y"] + o[1]] for o in halo.OFFSETS if (r["x"] + o[0], r["y"] + o[1]) in sent}
        assert r["padded"] == halo.stitch(sent[r["x"], r["y"]][0], near).ravel().tolist()
        assert r["near"] == [(r["x"] + dx, r["y"] + dy) in sent for dx, dy in halo.OFFSETS]


def test_edges_that_do_not_fit(spark):
    t = spark.createDataFrame([(0, 0, 0, 2, 2, [1.0] * 4, None), (0, 1, 0, 2, 1, [1.0] * 2, None)], "z int, x int, y int, width int, height int, plane array<double>, mask array<tinyint>")
    with pytest.raises(Exception, match="doesn't fit"):
        halo.with_halo(t).collect()


def test_crs_names(spark):
    assert raster.crs_name(3857) == raster.crs_name("epsg:3857") == "EPSG:3857"
    assert raster.crs_name('PROJCS["x",GEOGCS["y",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","3857"]]') == "EPSG:3857"
    assert raster.crs_name('PROJCRS["Own grid",ID["X",1]]') == "Own grid"
    with pytest.raises(ValueError):
        raster.crs("EPSG:9999")
    raster.register("Own grid", select.identity, lambda lng, lat: (lng, lat))
    _, back = raster.crs('PROJCRS["Own grid"]')
    assert spark.range(1).select(back(F.lit(0.0), F.lit(90.0))[1]).first()[0] == pytest.approx(spaces.MAX_LAT)
    assert raster.metres_per_unit("Foot") == 0.3048
    with pytest.raises(ValueError):
        raster.metres_per_unit(None)


def test_viewports_from_a_matrix(spark):
    flat = viewport.raster_viewport(spark, 1, "mercator", np.eye(4).ravel(), 3, 0, 0, (-180, -85, 180, 85)).first()
    assert len(flat["planes"]) == 6 and flat["camera"] is None
    globe = viewport.raster_viewport(spark, 1, "globe", np.eye(4).ravel(), 3, 0, 0, (-180, -85, 180, 85), clipping_plane=(0, 0, 2, -0.6), camera=(0, 0, 1)).first()
    assert len(globe["planes"]) == 5 and globe["planes"][-1]["d"] == pytest.approx(-0.3)
    with pytest.raises(ValueError):
        viewport.raster_viewport(spark, 1, "cone", np.eye(4), 3, 0, 0, (0, 0, 1, 1))


def test_presets_and_bins():
    assert options.preset("infrared", 4) == [3, 0, 1]
    for wrong in (lambda: options.preset("infrared", 3), lambda: options.preset("none", 4), lambda: options.bins(0, 1, 65), lambda: options.stretch(0, 5)):
        with pytest.raises(ValueError):
            wrong()
    assert options.bins(0, 10, 6, include_lower=True) == [0, 2.5, 5, 7.5, 10] and options.stretch(3, 5) == [(0.0, 3)]


def test_levels(spark):
    ds = raster.RasterDataset(spark.range(0), spark.createDataFrame([(0, 2.0, 0.0, 0.0, 0.0, -2.0, 0.0, 4, 4, 2, 2, 1.0)], "z int, a double, b double, c double, d double, e double, f double, array_w int, array_h int, tile_w int, tile_h int, mpu double"), spark.range(0))
    assert ds.level(0).first()["matrix_w"] == 2
    with pytest.raises(ValueError):
        ds.level(1)


def test_mesh_covers_its_tile():
    uv, faces, error = mesh.refine(64, 32, lambda x, y: (x + 0.0005 * x * x, y + 0.001 * x * y), lambda x, y: (np.asarray(x) * 0 + (np.sqrt(1 + 0.002 * np.asarray(x)) - 1) / 0.001, np.asarray(y) / (1 + (np.sqrt(1 + 0.002 * np.asarray(x)) - 1))))
    p = uv[faces]
    area = np.abs((p[:, 1, 0] - p[:, 0, 0]) * (p[:, 2, 1] - p[:, 0, 1]) - (p[:, 2, 0] - p[:, 0, 0]) * (p[:, 1, 1] - p[:, 0, 1])) / 2
    assert error <= 0.125 and area.sum() == pytest.approx(1) and (area > 0).all()
    sides = {tuple(sorted((int(t[i]), int(t[(i + 1) % 3])))) for t in faces for i in range(3)}
    assert len(uv) - len(sides) + len(faces) == 1
