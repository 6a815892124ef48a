"""Rasters as relations: one row (r, c, v) for each cell; a missing row or a NULL is a masked cell."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import crs
from lodestrata.operators.ranks import quantiles

#: Values beyond this are treated as nodata whatever the header says.
SENTINEL = 1e30
METRES_PER_DEGREE = 111_320.0


@dataclass(frozen=True)
class Meta:
    """Size, origin (upper left corner) and cell size of a grid; dy is negative."""

    h: int
    w: int
    x0: float = 0.0
    y0: float = 0.0
    dx: float = 100.0
    dy: float = -100.0
    crs: str = ""
    geographic: bool = False

    def metres(self) -> tuple[float, float]:
        """Cell width and height in metres; degrees shrink by the cosine of the central latitude."""
        if not self.geographic:
            return abs(self.dx), abs(self.dy)
        lat = self.y0 + self.dy * self.h / 2
        return abs(self.dx) * METRES_PER_DEGREE * max(math.cos(math.radians(lat)), 1e-6), abs(self.dy) * METRES_PER_DEGREE

    def code(self) -> str:
        """EPSG code, where there is one."""
        return "EPSG:4326" if self.geographic else self.crs

    def bounds(self) -> tuple[float, float, float, float]:
        x, y = self.x0 + self.w * self.dx, self.y0 + self.h * self.dy
        return min(self.x0, x), min(self.y0, y), max(self.x0, x), max(self.y0, y)


def world_to_pixel(meta: Meta, x: Column, y: Column) -> tuple[Column, Column]:
    """Row and column of a point, truncated towards zero."""
    return ((y - meta.y0) / meta.dy).cast("int"), ((x - meta.x0) / meta.dx).cast("int")


def pixel_to_world(meta: Meta, r: Column, c: Column) -> tuple[Column, Column]:
    """x and y of a cell's centre."""
    return meta.x0 + (c + 0.5) * meta.dx, meta.y0 + (r + 0.5) * meta.dy


def mask(grid: DataFrame, nodata: float | None = None) -> DataFrame:
    """v is NULL where it is nodata, NaN or beyond the sentinel."""
    bad = F.isnan("v") | (F.abs("v") >= SENTINEL)
    if nodata is not None:
        bad |= F.col("v") == nodata
    return grid.withColumn("v", F.when(~bad, F.col("v")))


def decimate(grid: DataFrame, meta: Meta, rows: int, cols: int) -> tuple[DataFrame, Meta]:
    """Average over each cell of a rows x cols grid of the same extent, by the area that it shares with the valid cells of grid.

    A cell goes to those that it overlaps: one where the ratio is whole, four at most where cells only get larger."""
    if rows > meta.h or cols > meta.w:
        raise ValueError("decimation cannot make cells smaller")

    def overlaps(at: Column, n: int, m: int) -> Column:
        low, high = at * (m / n), (at + 1) * (m / n)
        first, last = F.floor(low + 1e-9), F.least(F.ceil(high - 1e-9) - 1, F.lit(m - 1))
        return F.transform(F.sequence(first, last), lambda k: F.struct(k.cast("int").alias("at"), (F.least(high, k + 1) - F.greatest(low, k)).alias("share")))

    valid = grid.filter("v IS NOT NULL").select("v", F.explode(overlaps(F.col("r"), meta.h, rows)).alias("a"), "c")
    both = valid.select("v", "a", F.explode(overlaps(F.col("c"), meta.w, cols)).alias("b"))
    w = F.col("a.share") * F.col("b.share")
    out = both.groupBy(F.col("a.at").alias("r"), F.col("b.at").alias("c")).agg((F.sum(w * F.col("v")) / F.sum(w)).alias("v"))
    return out, replace(meta, h=rows, w=cols, dx=meta.dx * meta.w / cols, dy=meta.dy * meta.h / rows)


def limited(grid: DataFrame, meta: Meta, most: int) -> tuple[DataFrame, Meta]:
    """grid, decimated so that its longest side has `most` cells if it has more (0: as it is)."""
    longest = max(meta.h, meta.w)
    if not most or longest <= most:
        return grid, meta
    return decimate(grid, meta, max(1, round(meta.h * most / longest)), max(1, round(meta.w * most / longest)))


def center_crop(grid: DataFrame, meta: Meta) -> tuple[DataFrame, Meta]:
    """The middle half of each side."""
    r0, c0, h, w = meta.h // 4, meta.w // 4, meta.h // 2, meta.w // 2
    inside = F.col("r").between(r0, r0 + h - 1) & F.col("c").between(c0, c0 + w - 1)
    out = grid.filter(inside).withColumns({"r": F.col("r") - r0, "c": F.col("c") - c0})
    return out, replace(meta, h=h, w=w, x0=meta.x0 + c0 * meta.dx, y0=meta.y0 + r0 * meta.dy)


def cells(spark: SparkSession, meta: Meta) -> DataFrame:
    """Every (r, c) of the grid."""
    return spark.range(meta.h * meta.w).select((F.col("id") / meta.w).cast("int").alias("r"), (F.col("id") % meta.w).cast("int").alias("c"))


def densify(grid: DataFrame, meta: Meta) -> DataFrame:
    """A row for every cell; v is NULL where there was none."""
    return cells(grid.sparkSession, meta).join(grid, ["r", "c"], "left")


def stack(base: DataFrame, layers: dict[str, DataFrame], meta: Meta | None = None) -> DataFrame:
    """base's cells with a column for each layer, by (r, c). With the grid's size, a layer with cells outside it is an error."""
    if meta is not None and layers:
        ends = [x.select(F.lit(n).alias("layer"), "r", "c") for n, x in layers.items()]
        outside = reduce(DataFrame.unionByName, ends).filter(~(F.col("r").between(0, meta.h - 1) & F.col("c").between(0, meta.w - 1)))
        if wrong := outside.select("layer").first():
            raise ValueError(f"layer {wrong['layer']} has another shape than the grid's {meta.h} x {meta.w}")
    out = base
    for name, layer in layers.items():
        if name in out.columns:
            raise ValueError(f"layer {name} is there already")
        out = out.join(layer.select("r", "c", F.col("v").alias(name)), ["r", "c"], "left")
    return out


def percentiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles, interpolated linearly; None without values."""
    return quantiles(rows, [column], shares)[column]


def median(rows: DataFrame, column: str = "v") -> float:
    """The exact median, 0 without values."""
    return percentiles(rows, column, [0.5])[0] or 0.0


def median_fill(wide: DataFrame, names: list[str]) -> DataFrame:
    """NULLs of each layer become the exact median of its cells, or 0 where it has none; all medians are found at once."""
    middle = quantiles(wide, names, [0.5])
    return wide.withColumns({n: F.coalesce(n, F.lit(middle[n][0] or 0.0)) for n in names})


def layer_stats(wide: DataFrame, names: list[str], least: float = 0.05) -> DataFrame:
    """One row per layer: valid cells, share, mean, population deviation, extremes, and whether it tells nothing."""
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).alias("v")) for n in names])))
    out = long.groupBy("layer").agg(F.count("v").alias("n_valid"), (F.count("v") / F.count("*")).alias("valid"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))
    return out.withColumn("sparse", F.col("valid") < least).withColumn("flat", (F.col("n_valid") == 0) | (F.col("std") < 1e-12))


def align(grid: DataFrame, meta: Meta, target: Meta) -> DataFrame:
    """grid resampled bilinearly at the centres of target's cells; NULL where none of the four neighbours is valid.

    An equi-join of target cells with their neighbours: nothing is compared with everything."""
    x, y = crs.convert(*pixel_to_world(target, F.col("r"), F.col("c")), target.code(), meta.code())
    fr, fc = (y - meta.y0) / meta.dy - 0.5, (x - meta.x0) / meta.dx - 0.5
    at = cells(grid.sparkSession, target).select("r", "c", fr.alias("fr"), fc.alias("fc"))
    inside = F.col("fr").between(-0.5, meta.h - 0.5) & F.col("fc").between(-0.5, meta.w - 0.5)
    near = at.filter(inside).select("r", "c", "fr", "fc", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("k"))
    a, b = F.floor("fr"), F.floor("fc")
    wr, wc = F.col("fr") - a, F.col("fc") - b
    weight = F.when(F.col("k.a") == 1, wr).otherwise(1 - wr) * F.when(F.col("k.b") == 1, wc).otherwise(1 - wc)
    clip = lambda v, n: F.greatest(F.lit(0), F.least(v, F.lit(n - 1))).cast("int")
    near = near.select("r", "c", weight.alias("weight"), clip(a + F.col("k.a"), meta.h).alias("_r"), clip(b + F.col("k.b"), meta.w).alias("_c"))
    src = grid.filter(F.col("v").isNotNull()).select(F.col("r").alias("_r"), F.col("c").alias("_c"), "v")
    out = near.filter("weight > 0").join(src, ["_r", "_c"]).groupBy("r", "c").agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("v"))
    return out


def stride(grid: DataFrame, step: int) -> DataFrame:
    """Every step-th row and column."""
    return grid.filter((F.col("r") % step == 0) & (F.col("c") % step == 0)).withColumns({"r": (F.col("r") / step).cast("int"), "c": (F.col("c") / step).cast("int")})
