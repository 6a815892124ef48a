"""Moving windows over grids, tile by tile: one shuffle of blocks for each operator, or for a chain of them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata import store
from lodestrata.operators import tiles
from lodestrata.operators.grid import Meta, densify, median
from lodestrata.operators.tiles import Block


def odd_window(scale_m: float, pixel_m: float) -> int:
    """The odd number of cells that spans a scale: half-even rounding, then one more if even."""
    n = max(1, round(scale_m / pixel_m))
    return n + 1 if n % 2 == 0 else n


def sliding(a: np.ndarray, k: int, axis: int) -> np.ndarray:
    """Sums of the 2k + 1 values about each; ends, where they are not all there, count what is."""
    a = np.moveaxis(a, axis, 0)
    sums = np.concatenate([np.zeros((1, *a.shape[1:])), a.cumsum(axis=0)])
    n = len(a)
    i = np.arange(n)
    out = sums[np.minimum(i + k + 1, n)] - sums[np.maximum(i - k, 0)]
    return np.moveaxis(out, 0, axis)


def mean_of(block: Block, k: int, border: int = 0) -> np.ndarray:
    """The box means of a tile, and of a border about it: of the valid cells, mirrored at the grid's borders; NaN without any."""
    v = block.mirrored(block.v[0])
    ok = np.isfinite(v)
    base = v[ok].mean() if ok.any() else 0.0
    s, n = np.where(ok, v - base, 0.0), ok.astype(float)
    for axis in (0, 1):
        s, n = sliding(s, k, axis), sliding(n, k, axis)
    if border:
        cut = slice(block.reach - border, len(s) - block.reach + border)
        s, n = s[cut, cut], np.round(n[cut, cut])
    else:
        s, n = block.inner(s), np.round(block.inner(n))
    return np.where(n > 0, base + s / np.maximum(n, 1), np.nan)


def box_mean(grid: DataFrame, meta: Meta, window: int) -> DataFrame:
    """v of every cell: the mean of the valid cells in its window, reflected at borders; NULL if there are none.

    Windows up to a tile are summed within tiles; wider ones are four places of a summed-area table."""
    k = window // 2
    if k <= tiles.SIZE // 2:
        return tiles.stencil(grid, meta, k, lambda b: {"v": mean_of(b, k)}, ["v"])
    base = grid.agg(F.avg("v")).first()[0] or 0.0  # keeps the sums small
    rows = grid.select("r", "c", (F.col("v") - base).alias("s"), F.when(F.col("v").isNotNull(), 1.0).alias("n"))
    sums = tiles.box_sums(rows, meta, k, ["s", "n"], True)
    n = F.round("n")
    return sums.select("r", "c", F.when(n > 0, base + F.col("s") / n).alias("v"))


def tpi(grid: DataFrame, meta: Meta, window: int) -> DataFrame:
    """Each valid cell less its box mean."""
    k = window // 2
    if k <= tiles.SIZE // 2:
        return tiles.stencil(grid, meta, k, lambda b: {"v": b.inner(b.v[0]) - mean_of(b, k)}, ["v"], present=True)
    mean = box_mean(grid, meta, window).withColumnRenamed("v", "m")
    return grid.join(mean, ["r", "c"]).select("r", "c", (F.col("v") - F.col("m")).alias("v"))


def max_filter(grid: DataFrame, meta: Meta, size: int) -> DataFrame:
    """The largest value within the window, cut off at borders (which equals reflection)."""
    k = size // 2

    def kernel(block: Block) -> dict[str, np.ndarray]:
        a = np.nan_to_num(block.v[0], nan=-np.inf)
        for axis in (0, 1):
            a = np.moveaxis(a, axis, 0)
            wide, reach = a, 1  # the largest of `reach` values from each on: doubled until they are 2 k + 1
            while reach < 2 * k + 1:
                step = min(reach, 2 * k + 1 - reach)
                wide = np.maximum(wide[:-step], wide[step:])
                reach += step
            a = np.moveaxis(wide, 0, axis)
        h, w = block.shape
        a = a[:h, :w]
        return {"v": np.where(np.isinf(a), np.nan, a)}

    return tiles.stencil(grid, meta, k, kernel, ["v"])


def faces(block: Block, dx: float, dy: float, k: int | None = None) -> dict[str, np.ndarray]:
    """gx, gy and curvature of a tile from a border of two cells and, with k, its box mean subtracted (tpi) from k."""
    v = block.v[0]
    gx, gy = block.gradient(v, 1, dx), block.gradient(v, 0, dy)
    out = {"gx": gx, "gy": gy, "curvature": block.gradient(gx, 1, dx) + block.gradient(gy, 0, dy)}
    out = {n: block.inner(a) for n, a in out.items()}
    if k is not None:
        out["tpi"] = block.inner(v) - mean_of(block, k)
    return out


def slopes(grid: DataFrame, meta: Meta, metric: bool = True) -> DataFrame:
    """v, gx, gy of every cell, by metres or by cells."""
    dx, dy = meta.metres() if metric else (1.0, 1.0)
    return tiles.stencil(grid, meta, 1, lambda b: {"v": b.inner(b.v[0]), "gx": b.inner(b.gradient(b.v[0], 1, dx)), "gy": b.inner(b.gradient(b.v[0], 0, dy))}, ["v", "gx", "gy"])


def slope(grid: DataFrame, meta: Meta, metric: bool = True) -> DataFrame:
    return slopes(grid, meta, metric).select("r", "c", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2).alias("v"))


def aspect(grid: DataFrame, meta: Meta, metric: bool = True) -> DataFrame:
    """aspect = atan2(gy, gx), with its sine and cosine."""
    a = F.atan2(F.col("gy"), F.col("gx"))
    return slopes(grid, meta, metric).select("r", "c", a.alias("aspect"), F.sin(a).alias("aspect_sin"), F.cos(a).alias("aspect_cos"))


def curvature(grid: DataFrame, meta: Meta, metric: bool = True) -> DataFrame:
    """The gradient of gx along x and of gy along y, added."""
    dx, dy = meta.metres() if metric else (1.0, 1.0)
    return tiles.stencil(grid, meta, 2, lambda b: {"v": faces(b, dx, dy)["curvature"]}, ["v"])


def derivatives(grid: DataFrame, meta: Meta, window: int | None = None) -> DataFrame:
    """(r, c, slope, aspect_sin, aspect_cos, curvature) of every cell, and with a window tpi: all from one shuffle."""
    dx, dy = meta.metres()
    k = None if window is None else window // 2
    names = ["gx", "gy", "curvature", *(["tpi"] if window else [])]
    g = tiles.stencil(grid, meta, max(2, k or 0), lambda b: faces(b, dx, dy, k), names)
    a = F.atan2(F.col("gy"), F.col("gx"))
    return g.select("r", "c", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2).alias("slope"), F.sin(a).alias("aspect_sin"), F.cos(a).alias("aspect_cos"), *names[2:])


def surface(grid: DataFrame, meta: Meta, window: int) -> DataFrame:
    """(r, c, tpi, slope, aspect_sin, aspect_cos, curvature) of every cell: the grid less its box mean, and the faces of the box
    mean. Mean and gradients of both orders are one chain in each tile, from one shuffle."""
    dx, dy = meta.metres()
    k = window // 2
    if k > tiles.SIZE // 2:
        smooth = store.stored(box_mean(grid, meta, window), "smooth")
        tpi = grid.join(smooth.withColumnRenamed("v", "m"), ["r", "c"]).select("r", "c", (F.col("v") - F.col("m")).alias("tpi"))
        return derivatives(smooth, meta).join(tpi, ["r", "c"], "left")

    def kernel(block: Block) -> dict[str, np.ndarray]:
        mean = mean_of(block, k, 2)
        inner = Block(mean[None], np.ones(mean.shape, bool), block.r0 + k, block.c0 + k, 2, block.size, block.meta)
        return {"tpi": block.inner(block.v[0]) - inner.inner(mean), **faces(inner, dx, dy)}

    g = tiles.stencil(grid, meta, k + 2, kernel, ["tpi", "gx", "gy", "curvature"])
    a = F.atan2(F.col("gy"), F.col("gx"))
    return g.select("r", "c", "tpi", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2).alias("slope"), F.sin(a).alias("aspect_sin"), F.cos(a).alias("aspect_cos"), "curvature")


def hillshade(grid: DataFrame, meta: Meta, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Shade of 0 to 1 by slope and aspect; masked cells take the median first."""
    full = densify(grid, meta).withColumn("v", F.coalesce("v", F.lit(median(grid))))
    az, alt = math.radians(360.0 - azimuth + 90.0), math.radians(altitude)
    steep = F.atan(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2))
    facing = F.cos(F.lit(az) - F.atan2(-F.col("gx"), F.col("gy")))
    shade = math.sin(alt) * F.cos(steep) + math.cos(alt) * F.sin(steep) * facing
    return slopes(full, meta).select("r", "c", F.greatest(F.lit(0.0), F.least(F.lit(1.0), shade)).alias("v"))


def dilate(marks: DataFrame, meta: Meta, n: int) -> DataFrame:
    """The cells within n steps up, down, left or right of a mark: of a tile and the marks about it, a minimum that runs down and
    up the columns, then along the rows and back. Only marks are shuffled."""
    def kernel(block: Block) -> pa.Table:
        steps = np.where(block.there, 0.0, np.inf)
        for axis in (0, 1):
            at = np.arange(len(steps), dtype=float)
            at = at[:, None] if axis == 0 else at[None, :]
            back = np.flip(np.minimum.accumulate(np.flip(steps + at, axis), axis), axis) - at
            steps = np.minimum(np.minimum.accumulate(steps - at, axis) + at, back)
        inside = block.inner(steps) <= n
        r, c = np.nonzero(inside)
        return pa.table({"r": (r + block.r0 + block.reach).astype(np.int32), "c": (c + block.c0 + block.reach).astype(np.int32)})

    return tiles.gather(tiles.pieces(marks, meta, n, [], every=False), meta, n, 0, kernel, "r int, c int")
