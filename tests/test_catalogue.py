"""Every query against its DuckDB twin on the smallest tables."""

import re

import duckdb
import pytest

from gridloom.operators import select
from gridloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_sql(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = duck.execute(catalogue.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_rows_only_queries(spark, sf):
    mesh = catalogue.QUERIES["mesh_triangles"](spark, sf)
    assert mesh.filter("error > 0.125").count() == 0 and mesh.count() >= 4 * 25
    fold = catalogue.QUERIES["scheduler_fold"](spark, sf)
    assert fold.count() == 1000 and fold.filter("bytes > 1048576 + 3 * 65536").count() == 0


def test_globe_selection(spark, sf):
    got = {(r["z"], r["x"]) for r in catalogue.QUERIES["globe_select"](spark, sf).collect()}
    assert got == {(1, x) for x in range(7, 17)}


@pytest.mark.parametrize("name", ["pyramid_select", "lod_select", "pyramid_select_box"])
@pytest.mark.parametrize("most", [0, 1, 4096])
def test_selection_by_levels(spark, sf, duck, monkeypatch, name, most):
    """Levels with a table of their tiles and those without give the same; with one, geometry is computed for it, not for views."""
    monkeypatch.setattr(select, "MOST_TILES", most, raising=False)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = catalogue.QUERIES[name](spark, sf)
        plan = got._jdf.queryExecution().executedPlan().toString()
        above, inside = [], []  # of each step that computes geometry: whether a table to broadcast is made of it
        for line in plan.splitlines():
            at = re.search("[A-Z]", line).start()
            above = [x for x in above if x[0] < at] + [(at, line)]
            if "inline(array(struct(metres" in line:
                inside.append(any("BroadcastExchange" in x for _, x in above))
        assert inside and all(inside) == (most == 4096)
        want = duck.execute(catalogue.ORACLE[name])
        assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([d[0] for d in want.description], want.fetchall())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
