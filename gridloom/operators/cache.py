"""Caches as tables: decoded tiles with failures of their own, and bounding volumes with their validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scheduler
from .halo import tile_keys

DECODED_BYTES = 64 << 20


def fetched(wanted: DataFrame, source: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """Every wanted tile once, with its columns of the source, `hit` (it was cached) and `failed` (the source has none).

    Requests for one tile share one read; a tile that fails doesn't fail its batch.
    """
    keys = tile_keys(wanted)
    once = wanted.select(*keys).distinct()
    if cached is None:
        return once.join(source.withColumn("__there", F.lit(True)), keys, "left").withColumns({"hit": F.lit(False), "failed": F.col("__there").isNull()}).drop("__there")
    held = once.join(cached, keys).withColumns({"hit": F.lit(True), "failed": F.lit(False)})
    read = fetched(once.join(cached, keys, "left_anti"), source)
    return held.unionByName(read.select(*held.columns))


def decoded_evictions(cache: DataFrame, partition: list[str], cap: int = DECODED_BYTES, count_cap: int = 1 << 30) -> DataFrame:
    """Decoded tiles to drop: those resolved that nobody waits for, oldest use first, until the cap holds."""
    may = cache.withColumn("evictable", (F.col("state") == "resolved") & (F.col("waiters") == 0))
    return scheduler.evictions(may, cap, count_cap, partition, ["used", "key"])


def volume_hits(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted tiles (z, x, y, projection, z_low, z_high) with the cached volume's columns and `hit`.

    A volume counts only for the projection and elevation range that it was made for.
    """
    keys = tile_keys(wanted)
    own = cache.select(*keys, *[F.col(c).alias(f"__{c}") for c in ("projection", "z_low", "z_high")], "volume")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("projection", "z_low", "z_high")]
    joined = wanted.join(own, keys, "left")
    hit: Column = F.col("volume").isNotNull() & same[0] & same[1] & same[2]
    return joined.withColumn("hit", hit).withColumn("volume", F.when(F.col("hit"), F.col("volume"))).drop("__projection", "__z_low", "__z_high")
