"""Loading and caching rules, each as a query over tile state.

Budgets are prefix sums in a partition (a session or dataset), so any number of
sessions run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STAND_IN_DEPTH, RETRY_BASE, MAX_RETRIES = 2, 1000, 3


def _before(partition: list[str], order: list, value: Column) -> Column:
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def uploads(decoded: DataFrame, cap: int, partition: list[str], order: str = "seq", size: str = "bytes") -> DataFrame:
    """Decoded tiles to upload in one frame: in order until the cap is reached, the one that crosses it included, one at least."""
    df = decoded.withColumn("__before", _before(partition, [order], F.col(size))).withColumn("__n", _before(partition, [order], F.lit(1)))
    return df.filter((F.col("__before") < cap) | (F.col("__n") == 0)).drop("__before", "__n")


def prunes(loading: DataFrame, cap: int, partition: list[str], order: list[str]) -> DataFrame:
    """Loads to abort: the least recently used candidates (not wanted), until cap are in flight. `wanted` marks the others."""
    every = Window.partitionBy(*partition)
    rank = Window.partitionBy(*partition, "wanted").orderBy(*order)
    df = loading.withColumn("__n", F.count("*").over(every)).withColumn("__r", F.row_number().over(rank))
    return df.filter(~F.col("wanted") & (F.col("__r") <= F.col("__n") - cap)).drop("__n", "__r")


def evictions(state: DataFrame, byte_cap: int, count_cap: int, partition: list[str], order: list[str], size: str = "bytes") -> DataFrame:
    """Tiles to evict: least recently used ones that may go (`evictable`), until both caps hold for all."""
    every = Window.partitionBy(*partition)
    df = state.withColumn("__bytes", F.sum(size).over(every)).withColumn("__n", F.count("*").over(every)).filter("evictable")
    df = df.withColumn("__b", _before(partition, order, F.col(size))).withColumn("__i", _before(partition, order, F.lit(1)))
    return df.filter((F.col("__bytes") - F.col("__b") > byte_cap) | (F.col("__n") - F.col("__i") > count_cap)).drop("__bytes", "__n", "__b", "__i")


def retry_at(now: Column, attempts: Column, base: int = RETRY_BASE, most: int = MAX_RETRIES) -> Column:
    """When a load that failed its attempts-th time may start again; NULL for never."""
    return F.when(attempts <= most, now + (base * F.pow(F.lit(2.0), attempts - 1)).cast("bigint"))


def missing(selected: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    return selected.join(state, keys, "left_anti")


def stand_in(loaded_hits: DataFrame, keys: list[str], finer: bool) -> DataFrame:
    """Of the loaded tiles that cover each missing tile (hit_z), those of the nearest coarser or finer level."""
    w = Window.partitionBy(*keys)
    own = loaded_hits.filter(F.col("hit_z") > F.col("z") if finer else F.col("hit_z") < F.col("z"))
    if finer:
        own = own.filter(F.col("hit_z") - F.col("z") <= STAND_IN_DEPTH)
    best = F.min("hit_z") if finer else F.max("hit_z")
    return own.withColumn("__b", best.over(w)).filter(F.col("hit_z") == F.col("__b")).drop("__b")


def near_selection(tiles: DataFrame, selected: DataFrame, cell: float) -> DataFrame:
    """Tiles (x0, y0, x1, y1, z) that overlap a selected one at most STAND_IN_DEPTH levels coarser; any coarser tile qualifies.

    Boxes meet on the grid cells they touch, an equi-join, and are then compared strictly.
    """
    def cells(df: DataFrame) -> DataFrame:
        span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
        return df.withColumn("gx", span("x0", "x1")).withColumn("gy", span("y0", "y1"))

    other = cells(selected.select(*[F.col(c).alias(c) for c in ("x0", "y0", "x1", "y1", "z")])).select("gx", "gy", *[F.col(c).alias(f"s_{c}") for c in ("x0", "y0", "x1", "y1", "z")])
    on = (F.col("t.gx") == F.col("s.gx")) & (F.col("t.gy") == F.col("s.gy")) & (F.col("t.x0") < F.col("s_x1")) & (F.col("t.x1") > F.col("s_x0")) & (F.col("t.y0") < F.col("s_y1")) & (F.col("t.y1") > F.col("s_y0")) & (F.col("t.z") - F.col("s_z") <= STAND_IN_DEPTH)
    return cells(tiles).alias("t").join(other.alias("s"), on, "left_semi").drop("gx", "gy").distinct()


def from_centre(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """Squared distance, for loading from the centre out."""
    return (x - cx) * (x - cx) + (y - cy) * (y - cy)


def counters(state: DataFrame, partition: list[str]) -> DataFrame:
    return state.groupBy(*partition).agg(F.count("*").alias("size"), F.count_if(F.col("state") == "loading").alias("loading"), F.count_if(F.col("state") == "decoded").alias("pending"), F.sum(F.when(F.col("state") == "loaded", F.col("bytes")).otherwise(0)).alias("byte_size"))


def covering_range(z: Column, tile_range: tuple[Column, Column, Column, Column]) -> Column:
    """Tiles (z, x, y) of an inclusive range x0, y0, x1, y1; none if it is empty."""
    x0, y0, x1, y1 = tile_range
    cells = F.flatten(F.transform(F.sequence(y0, y1), lambda y: F.transform(F.sequence(x0, x1), lambda x: F.struct(z.alias("z"), x.alias("x"), y.alias("y")))))
    return F.when((x0 <= x1) & (y0 <= y1), cells).otherwise(F.slice(cells, 1, 0))


def loaded_covering(asked: DataFrame, loaded: DataFrame, keys: list[str], now: str = "now") -> DataFrame:
    """Loaded tiles in the ranges (z, x0, y0, x1, y1) that are asked for, touched: `used` becomes the asking time."""
    some = asked.filter("x0 <= x1 and y0 <= y1")
    cells = some.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "y0", "x1", "y1")
    return cells.join(loaded.drop("used"), [*keys, "z", "x", "y"]).withColumnRenamed(now, "used")


def protected_ancestors(shown: DataFrame, loaded: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """Loaded tiles at any coarser level over a shown tile, which eviction must spare; levels halve, keys are generated."""
    up = shown.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(depth)))).filter("d <= z")
    over = up.select(*keys, (F.col("z") - F.col("d")).alias("z"), F.expr("shiftright(x, d)").alias("x"), F.expr("shiftright(y, d)").alias("y")).distinct()
    return loaded.join(over, [*keys, "z", "x", "y"], "left_semi")


def painter_order(tiles: DataFrame, partition: list[str]) -> DataFrame:
    """Tiles with `paint`, their place in drawing order: coarser levels first, so finer ones cover them."""
    w = Window.partitionBy(*partition).orderBy("z", "x", "y")
    return tiles.withColumn("paint", F.row_number().over(w))


def live_results(results: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Results (keys, attempt) whose attempt is the tile's present one; late ones of an earlier attempt, or of a tile that went, are dropped."""
    return results.join(state.filter("state = 'loading'").select(*keys, "attempt"), [*keys, "attempt"], "left_semi")


def destroyed(state: DataFrame, keys: list[str]) -> DataFrame:
    """What ending a session does to each tile: loads are aborted, loaded ones freed; nothing stays."""
    return state.select(*keys, F.when(F.col("state") == "loading", "abort").when(F.col("state").isin("loaded", "decoded"), "free").otherwise("forget").alias("action"), F.when(F.col("state").isin("loaded", "decoded"), F.col("bytes")).otherwise(0).alias("bytes"))


def open_outcome(now: Column, attempts: Column, result: Column) -> dict[str, Column]:
    """What becomes of opening a source. result: ok, empty (a source of nothing, on purpose), lost (can't recover) or failed."""
    again = retry_at(now, attempts)
    state = F.when(result.isin("ok", "empty"), result).when((result == "failed") & again.isNotNull(), "retry").otherwise("lost")
    return {"state": state, "retry_at": F.when(result == "failed", again)}
