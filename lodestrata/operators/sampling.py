"""Background samples matched to the terrain of the deposits, and spatial folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.grid import percentiles


def edges(rows: DataFrame, column: str, bins: int = 8) -> list[float]:
    """The distinct inner quantiles of a column."""
    return sorted({x for x in percentiles(rows, column, [i / bins for i in range(1, bins)]) if x is not None})


def bin_of(v: Column, e: Column) -> Column:
    """How many edges are at most v."""
    return F.size(F.filter(e, lambda x: x <= v))


def terrain_bins(rows: DataFrame, columns: tuple[str, ...] = ("elevation", "slope"), bins: int = 8) -> DataFrame:
    """rows with `bin`, the joint quantile bin of the columns by mixed radix; edges come from the candidates (positive = 0)."""
    joint, pool = F.lit(0), rows.filter("positive = 0")
    for c in columns:
        e = edges(pool, c, bins)
        joint = joint * (len(e) + 1) + bin_of(F.col(c), F.array(*[F.lit(x) for x in e]) if e else F.array().cast("array<double>"))
    return rows.withColumn("bin", joint)


def terrain_weights(binned: DataFrame) -> DataFrame:
    """(bin, n_pos, n_cand, weight): each candidate's share of the draw, nearly all of it matched to the positives' bins."""
    by = binned.groupBy("bin").agg(F.sum("positive").cast("double").alias("n_pos"), F.sum(1 - F.col("positive")).cast("double").alias("n_cand"))
    every = Window.partitionBy()
    ratio = F.when(F.col("n_cand") > 0, (F.col("n_pos") / F.sum("n_pos").over(every)) / (F.col("n_cand") / F.sum("n_cand").over(every))).otherwise(0.0)
    by = by.withColumn("ratio", ratio).withColumn("_s", F.sum(F.col("ratio") * F.col("n_cand")).over(every)).withColumn("_n", F.sum("n_cand").over(every))
    return by.select("bin", "n_pos", "n_cand", (0.999 * F.col("ratio") / F.nullif(F.col("_s"), F.lit(0.0)) + 0.001 / F.col("_n")).alias("weight"))


def draw(seed: int, *keys: str) -> Column:
    """A hash of keys and a seed as text: an order that is the same for any partitioning, and in any engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *keys))


def uniform(seed: int, *keys: str) -> Column:
    """A number in (0, 1) from a hash of keys: its first 13 digits."""
    return (F.conv(F.substring(draw(seed, *keys), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def weighted_sample(rows: DataFrame, n: int, weight: str = "weight", seed: int = 42, keys: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """n rows without replacement, likelier by weight: the smallest of exponential draws."""
    draw = -F.log(uniform(seed, *keys)) / F.col(weight)
    return rows.filter(F.col(weight) > 0).withColumn("_d", draw).orderBy("_d", *keys).limit(n).drop("_d")


def tile(r: Column, c: Column, h: int, w: int, k: int = 5) -> Column:
    """The block of a cell in a checkerboard of at least 2k blocks."""
    n = math.ceil(math.sqrt(2 * k))
    at = lambda v, size: F.least(F.floor(v / max(size, 1) * n), F.lit(n - 1)).cast("int")
    return at(r, h) * n + at(c, w)


def folds(rows: DataFrame, h: int, w: int, k: int = 5, seed: int = 42) -> DataFrame:
    """rows with block and fold: whole blocks, in a hashed order, are dealt to k folds."""
    blocks = rows.select(tile(F.col("r"), F.col("c"), h, w, k).alias("block")).distinct()
    order = Window.orderBy(draw(seed, "block"), "block")  # a few dozen blocks
    dealt = blocks.withColumn("fold", F.pmod(F.row_number().over(order) - 1, F.lit(k)))
    return rows.withColumn("block", tile(F.col("r"), F.col("c"), h, w, k)).join(F.broadcast(dealt), "block")


def negatives(grid: DataFrame, deposits: DataFrame, distances: DataFrame, buffer_m: float, pixel_m: float, ratio: int = 2, seed: int = 42) -> DataFrame:
    """ratio background cells for each deposit, outside a buffer that shrinks to a third while too few are left.

    distances (r, c, d) should be cached or stored: it is counted once for each buffer tried."""
    need = ratio * deposits.count()
    far = grid.filter("v IS NOT NULL").join(distances, ["r", "c"])
    while True:
        pool = far.filter(F.col("d") >= buffer_m)
        n = pool.count()
        if n >= need or buffer_m <= pixel_m:
            break
        buffer_m = max(buffer_m / 3, pixel_m)
    if not n:
        raise ValueError("no cell lies outside the buffer")
    return pool.orderBy(uniform(seed, "r", "c"), "r", "c").limit(need)
