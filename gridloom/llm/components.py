"""Connected components of an edge list, by alternating stars.

Large-star points every larger neighbour of a node at the smallest node it
knows; small-star does so for the smaller ones. Edges never grow in number, and
a component of n nodes is a star after about log n rounds. Each round aggregates
before it shuffles and is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as core


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that isn't its component's smallest; edges: (a, b), bigint."""
    now = core.materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = core.materialise(small, "edges")
    raise RuntimeError(f"no star after {rounds} rounds")
