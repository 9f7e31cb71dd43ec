"""Approximate nearest neighbours by shifted Hilbert orderings.

Every vector is projected at random to DIMS dimensions, shifted, and placed on a Hilbert curve; that is
done CURVES times. Each ordering is range-partitioned into cells, by quantiles of a
bounded sample. A query goes to its own cell and the two beside it; a cell sorts its
rows by key, and the query meets the `window` rows before and after its place. What it meets is reranked by
exact Euclidean distance in double precision, and the orderings' results are merged.

The window is measured, not set: PROBES rows are searched by brute force, the number of rows that lie
between a probe and each of its true neighbours is counted in every ordering, and the window is the
least that holds TARGET of the neighbours in some ordering. Data of few dimensions gets a small
window at any size; isotropic data needs a share of the table for any recall.

Keys end in bits of a hash, so equal curve positions are cut too and no cell has to
hold them all. Equal vectors are indexed once, and expanded to their smallest ids in the end:
a query needs no more than k + 1 of them, so that is exact.

Defined cases: null, zero vectors, and those with null or non-finite components
take no part, nor do those of another length than the commonest. A row that repeats
(id and vector) counts once. With fewer than k others, all are returned. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import hilbert
from . import textcore as core

CURVES, DIMS, BITS = 24, 8, 7
#: The sample that cuts are fitted on, rows of a cell at least, cells of an ordering at most.
SAMPLE, CELL_ROWS, MOST_CELLS = 20_000, 2000, 4096
#: Rows searched by brute force to find the window, and the share of their neighbours that it must hold.
PROBES, TARGET = 64, 0.95
SALT = 64
_SUB = np.uint64(0xD1B54A32D192ED03)


def valid(column: str):
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(x, lambda v: v != 0)


class Orderings:
    """Projections and shifts of all curves, fitted on a sample; with cuts they deal rows to cells."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, seed: int = 7):
        rng, width = np.random.default_rng(seed), sample.shape[1]
        dims = min(DIMS, width)
        self.maps, self.cuts = [], None
        while len(self.maps) < curves:
            turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
            for k in range(width // dims):  # curves of one turn look at different dimensions
                own = turn[:, k * dims : (k + 1) * dims]
                y = sample @ own
                self.maps.append((own, y.mean(axis=0), np.maximum(y.std(axis=0), 1e-300), (rng.random(dims) - 0.5) / (1 << BITS)))
        del self.maps[curves:]

    def keys(self, x: np.ndarray, rep: np.ndarray) -> list[np.ndarray]:
        """Of each row in every ordering: its place on the curve, then bits of a hash of its id."""
        sub = core.mix64(rep.astype(np.uint64) * _SUB) >> np.uint64(56)
        out = []
        for turn, mean, deviation, shift in self.maps:
            unit = 1 / (1 + np.exp(-1.7 * np.clip((x @ turn - mean) / deviation, -40, 40))) + shift
            grid = (np.clip(unit, 0, 1 - 1e-9) * (1 << BITS)).astype(np.int64)
            out.append((hilbert.positions(grid, BITS) << np.uint64(8)) | sub)
        return out

    def cut(self, sample: np.ndarray, rep: np.ndarray, cells: int) -> None:
        keys = [np.sort(k) for k in self.keys(sample, rep)]
        self.cuts = [k[(np.arange(1, cells) * len(k)) // cells] for k in keys]


def nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of the k rows of x nearest to q, by distance, then id."""
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    at = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
    at = at[np.lexsort((ids[at], d[at]))[:k]]
    return at, d[at]


def measured_window(distinct: DataFrame, orders: Orderings, matrix, n: int, k: int, probes: int = PROBES, target: float = TARGET) -> int:
    """The least window that holds `target` of the true neighbours of `probes` rows in some ordering."""
    spark = distinct.sparkSession
    asked = distinct.orderBy(F.xxhash64("rep"), "rep").limit(probes).select("v", "rep").collect()
    x, own = np.array([r["v"] for r in asked], float), np.array([r["rep"] for r in asked])
    bag = spark.sparkContext.broadcast((orders, x, own))  # at most `probes` vectors

    def search(batches):
        _, x, own = bag.value
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, x.shape[1])))] * len(own)
        for b in batches:
            y, rep = matrix(b.column(0)), np.asarray(b.column(1))
            for i in range(len(own)):
                at, d = nearest(y, rep, x[i], k + 1)
                d, r, v = (np.concatenate(z) for z in zip(best[i], (d, rep[at], y[at]), strict=True))
                order = np.lexsort((r, d))[: k + 1]
                best[i] = d[order], r[order], v[order]
        for i, (d, r, v) in enumerate(best):
            at = np.flatnonzero(r != own[i])
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.full(len(at), i)), "d": d[at], "rep": r[at], "v": pa.array(list(v[at]), pa.list_(pa.float64()))})

    w = Window.partitionBy("i").orderBy("d", "rep")
    found = distinct.select("v", "rep").mapInArrow(search, "i bigint, d double, rep bigint, v array<double>")
    true = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("i", "rep", "v").collect()  # at most k * probes
    if not true:
        return k + 1
    theirs = orders.keys(np.array([r["v"] for r in true], float), np.array([r["rep"] for r in true]))
    mine = [m[[r["i"] for r in true]] for m in orders.keys(x, own)]
    ends = spark.sparkContext.broadcast([(np.minimum(a, b), np.maximum(a, b)) for a, b in zip(mine, theirs, strict=True)])

    def count(batches):
        total = np.zeros((len(ends.value), len(ends.value[0][0])), np.int64)
        for b in batches:
            for c, key in enumerate(bag.value[0].keys(matrix(b.column(0)), np.asarray(b.column(1)))):
                key = np.sort(key)
                total[c] += np.searchsorted(key, ends.value[c][1], side="right") - np.searchsorted(key, ends.value[c][0])
        c, pair = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"c": pa.array(c), "pair": pa.array(pair), "n": pa.array(total[c, pair])})

    gaps = distinct.select("v", "rep").mapInArrow(count, "c bigint, pair bigint, n bigint").groupBy("c", "pair").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.min("n").alias("n"))
    least = np.sort([r["n"] for r in gaps.collect()])
    return int(max(k + 1, least[min(len(least) - 1, int(np.ceil(target * len(least))) - 1)]))


def search(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", curves: int = CURVES, window: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that were found for each row that is_query (a Column) marks."""
    spark = vectors.sparkSession
    core.ship(spark)
    every = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter(F.col("id").isNotNull() & valid("v"))
    sizes = every.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    shape = "query_id bigint, rank int, vec_id bigint, score double"
    if sizes is None:
        return spark.createDataFrame([], shape)
    width = sizes["w"]
    rows = every.filter(F.size("v") == width)
    digest = F.sha2(F.concat(*[F.array_join(F.transform("v", lambda x: (x + 0.0).cast("string")), ",")]), 256)
    named = core.materialise(rows.select("id", "q", "v", digest.alias("h")), "vectors")
    distinct = core.materialise(named.groupBy("h").agg(F.min("id").alias("rep"), F.max("q").alias("q"), F.first("v").alias("v")), "distinct")
    ids = named.groupBy("h", "id").agg(F.max("q").alias("q")).join(distinct.select("h", "rep"), "h").select("id", "rep", "q")
    n = distinct.count()
    picked = core.bounded_sample(distinct, "rep", SAMPLE).select("v", "rep").limit(2 * SAMPLE).collect() or distinct.select("v", "rep").limit(1).collect()
    sample, own = np.array([r["v"] for r in picked], float), np.array([r["rep"] for r in picked])

    def matrix(column) -> np.ndarray:
        return np.asarray(column.flatten(), dtype=float).reshape(-1, width)

    orders = Orderings(sample, curves)
    reach = window or measured_window(distinct, orders, matrix, n, k)
    cells = max(1, min(MOST_CELLS, n // max(cell_rows, 4 * reach)))
    orders.cut(sample, own, cells)
    bag = spark.sparkContext.broadcast(orders)  # MOST_CELLS cuts a curve at most
    narrow = "float" in vectors.schema[vector].dataType.simpleString()
    kind = np.float32 if narrow else float

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, rep, q = matrix(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(2))
            asked = np.flatnonzero(q)
            blob = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
            for c, keys in enumerate(bag.value.keys(x, rep)):
                cell = np.searchsorted(bag.value.cuts[c], keys, side="right")
                at, cells_of, role = [np.arange(len(rep))], [cell], [np.zeros(len(rep), bool)]
                for step in (-1, 0, 1):
                    near = cell[asked] + step
                    ok = (near >= 0) & (near < cells)
                    at.append(asked[ok])
                    cells_of.append(near[ok])
                    role.append(np.ones(int(ok.sum()), bool))
                at, cells_of, role = np.concatenate(at), np.concatenate(cells_of), np.concatenate(role)
                yield pa.RecordBatch.from_arrays([pa.array(c * cells + cells_of, pa.int64()), pa.array(rep[at], pa.int64()), pa.array(role), pa.array(keys[at].view(np.int64)), blob.take(pa.array(at))], names=["g", "rep", "asks", "key", "x"])

    def meet(group):
        rep, asks, keys = (np.asarray(group.column(c)) for c in ("rep", "asks", "key"))
        x = np.frombuffer(b"".join(group.column("x").to_pylist()), kind).reshape(-1, width)
        keys = keys.view(np.uint64)
        own, who = np.flatnonzero(~asks), np.flatnonzero(asks)
        own = own[np.lexsort((rep[own], keys[own]))]
        own_keys, own_rep, out = keys[own], rep[own], [[], [], []]
        for i in who if len(own) else []:
            low, high = np.searchsorted(own_keys, keys[i]), np.searchsorted(own_keys, keys[i], side="right")
            low, high = max(0, low - reach), min(len(own), high + reach)
            at, d = nearest(x[own[low:high]].astype(float), own_rep[low:high], x[i].astype(float), k + 1)
            out[0].append(np.full(len(at), rep[i]))
            out[1].append(own_rep[low:high][at])
            out[2].append(d)
        flat = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query": pa.array(flat[0].astype(np.int64)), "rep": pa.array(flat[1].astype(np.int64)), "score": pa.array(flat[2].astype(float))})

    met = distinct.select("v", "rep", "q").mapInArrow(deal, "g bigint, rep bigint, asks boolean, key bigint, x binary").groupBy("g").applyInArrow(meet, "query bigint, rep bigint, score double").distinct()
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "rep"))).filter(F.col("r") <= k + 1).drop("r")
    salted = ids.withColumn("r", F.row_number().over(Window.partitionBy("rep", F.pmod("id", F.lit(SALT))).orderBy("id"))).filter(F.col("r") <= k + 1)
    few = salted.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("r") <= k + 1).select("rep", F.col("id").alias("vec_id"))
    lists = best.join(few, "rep").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).filter(F.col("r") <= k + 1)
    asked = ids.filter("q").select(F.col("id").alias("query_id"), F.col("rep").alias("query"))
    packed = lists.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found"))  # at most k + 1
    out = asked.join(packed, "query").select("query_id", F.slice(F.filter("found", lambda s: s["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return out.select("query_id", F.posexplode("found").alias("at", "s")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("s.vec_id").alias("vec_id"), F.col("s.score").alias("score"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(core.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op6_nearest_neighbours": op6_nearest_neighbours}
