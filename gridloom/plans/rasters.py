"""Rasters derived from tables that aren't rasters, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE, ACROSS = 8, 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 64-value embedding is one 8 x 8 tile of a mosaic 25 tiles wide."""
    e = table(spark, sf_dir, "embeddings").filter(F.size("embedding") == TILE * TILE)
    return e.select(
        F.lit(0).alias("z"),
        F.pmod("vec_id", F.lit(ACROSS)).cast("int").alias("x"),
        F.floor(F.col("vec_id") / ACROSS).cast("int").alias("y"),
        F.lit(TILE).alias("width"),
        F.lit(TILE).alias("height"),
        F.col("embedding").cast("array<double>").alias("plane"),
        F.lit(None).cast("array<tinyint>").alias("mask"),
        "label",
    )


def embedding_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mosaic as (x, y, gx, gy, v), gx and gy counted over the whole image."""
    p = embedding_tiles(spark, sf_dir).select("x", "y", F.posexplode("plane").alias("p", "v"))
    return p.select("x", "y", (F.col("x") * TILE + F.col("p") % TILE).alias("gx"), (F.col("y") * TILE + F.floor(F.col("p") / TILE).cast("int")).alias("gy"), "v")


PIXELS_SQL = """SELECT x, y, x * 8 + p % 8 AS gx, y * 8 + p // 8 AS gy, v FROM (SELECT CAST(vec_id % 25 AS INTEGER) AS x, CAST(vec_id // 25 AS INTEGER) AS y,
 CAST(unnest(range(64)) AS INTEGER) AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE len(embedding) = 64)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers spread over the globe by their key, beyond the mercator range too."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (F.pmod(k * 7919, F.lit(36000)) / 100.0 - 180).alias("lng"), (F.pmod(k * 104729, F.lit(18000)) / 100.0 - 90).alias("lat"))


POINTS_SQL = "SELECT c_custkey AS id, (c_custkey * 7919 % 36000) / CAST(100 AS DOUBLE) - 180 AS lng, (c_custkey * 104729 % 18000) / CAST(100 AS DOUBLE) - 90 AS lat FROM customer"

#: Identity-CRS pyramid of three levels: z, a, c, e, f, array_w, array_h.
PYRAMID = [(0, 1024.0, 0.0, -1024.0, 262144.0, 256, 256), (1, 512.0, 0.0, -512.0, 262144.0, 512, 512), (2, 256.0, 0.0, -256.0, 262144.0, 1024, 1024)]


def pyramid(spark: SparkSession) -> DataFrame:
    rows = [(z, a, 0.0, c, 0.0, e, f, w, h, 256, 256, 1.0) for z, a, c, e, f, w, h in PYRAMID]
    return spark.createDataFrame(rows, "z int, a double, b double, c double, d double, e double, f double, array_w int, array_h int, tile_w int, tile_h int, mpu double")


PYRAMID_SQL = "SELECT CAST(z AS INTEGER) AS z, CAST(a AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS c, -CAST(a AS DOUBLE) AS e, CAST(262144 AS DOUBLE) AS f, CAST(n AS INTEGER) AS n FROM (VALUES (0, 1024, 1), (1, 512, 2), (2, 256, 4)) AS t(z, a, n)"
