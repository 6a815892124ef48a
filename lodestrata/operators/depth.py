"""Depth to sources from potential fields: detrending, spectra by ring, derivatives and Euler deconvolution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata import store
from lodestrata.operators import spectra, terrain, tiles
from lodestrata.operators.grid import Meta, densify, median, percentiles
from lodestrata.operators.tiles import Block


def plane(grid: DataFrame) -> DataFrame:
    """One row: the least-squares plane a*c + b*r + k, from the sums of the normal equations."""
    x, y, v = (F.col(n).cast("double") for n in ("c", "r", "v"))
    s = grid.filter("v IS NOT NULL").agg(*[F.sum(e).alias(n) for n, e in {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y, "v": v, "xv": x * v, "yv": y * v}.items()])
    sxx, syy, sxy = F.col("xx") - F.col("x") * F.col("x") / F.col("n"), F.col("yy") - F.col("y") * F.col("y") / F.col("n"), F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    sxv, syv = F.col("xv") - F.col("x") * F.col("v") / F.col("n"), F.col("yv") - F.col("y") * F.col("v") / F.col("n")
    det = F.nullif(sxx * syy - sxy * sxy, F.lit(0.0))
    a, b = (sxv * syy - syv * sxy) / det, (syv * sxx - sxv * sxy) / det
    return s.select(a.alias("a"), b.alias("b"), ((F.col("v") - a * F.col("x") - b * F.col("y")) / F.col("n")).alias("k"))


def detrend(grid: DataFrame) -> DataFrame:
    """grid less its plane; masked cells take the median first."""
    full = grid.select("r", "c", F.coalesce("v", F.lit(median(grid))).alias("v"))
    p = plane(full)
    return full.crossJoin(F.broadcast(p)).select("r", "c", (F.col("v") - F.col("a") * F.col("c") - F.col("b") * F.col("r") - F.col("k")).alias("v"))


def ring_means(spectrum: DataFrame, rings: int) -> DataFrame:
    """(win, ring, power, n) of the rings 1 to rings with three samples or more; spectrum has win, ring, p."""
    return spectrum.filter(F.col("ring").between(1, rings)).groupBy("win", "ring").agg(F.avg("p").alias("power"), F.count("*").alias("n")).filter("n >= 3 AND power > 0")


def ring_fit(rings: DataFrame, fundamental: float) -> DataFrame:
    """(win, depth, r2): half the falling slope of log power over wavenumber.

    The noise floor is the median of the last quarter of the rings, three at least. The contiguous rings that are over
    floor + 2 from the first on are fitted, or all that are over it if these are fewer than 4."""
    order = Window.partitionBy("win").orderBy("ring")
    r = rings.select("win", (F.col("ring") * fundamental).alias("k"), F.log("power").alias("lp"), F.row_number().over(order).alias("i"), F.count("*").over(Window.partitionBy("win")).alias("m"))
    floor_ = r.filter(F.col("i") > F.col("m") - F.greatest(F.lit(3), F.floor(F.col("m") / 4))).groupBy("win").agg(F.percentile("lp", F.lit(0.5)).alias("floor"))
    r = r.join(floor_, "win").filter("m >= 6").withColumn("above", F.col("lp") > F.col("floor") + 2)
    prefix = F.min(F.col("above").cast("int")).over(Window.partitionBy("win").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("prefix", prefix == 1)
    r = r.withColumn("long", F.sum(F.col("prefix").cast("int")).over(Window.partitionBy("win")) >= 4)
    used = r.filter(F.when(F.col("long"), F.col("prefix")).otherwise(F.col("above")))
    fit = used.groupBy("win").agg(F.count("*").alias("n"), F.regr_slope("lp", "k").alias("slope"), F.regr_r2("lp", "k").alias("r2")).filter("n >= 4")
    return fit.select("win", F.when(F.col("slope") < 0, -F.col("slope") / 2).alias("depth"), "r2")


def windows(grid: DataFrame, meta: Meta, size: int, step: int, last: bool) -> DataFrame:
    """grid's cells once for each window that covers them: win_r, win_c are a window's first row and column.

    Each cell lists its windows by arithmetic; last says whether a window may end at the border."""
    def starts(v: Column, n: int) -> Column:
        top = n - size if last else n - size - 1
        low = F.greatest(F.lit(0), F.ceil((v - size + 1) / step))
        high = F.least(F.floor(v / step), F.lit(top // step))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    rows = grid.withColumn("win_r", F.explode(starts(F.col("r"), meta.h)))
    return rows.withColumn("win_c", F.explode(starts(F.col("c"), meta.w))).withColumns({"win_r": (F.col("win_r") * step).cast("int"), "win_c": (F.col("win_c") * step).cast("int")})


def taper(meta: Meta, alpha: float = 0.2) -> Column:
    """The product of a cosine-tapered window along each axis."""
    def side(v: Column, n: int) -> Column:
        edge = alpha * (n - 1) / 2
        near = F.least(v, F.lit(n - 1) - v)
        return F.when(near < edge, 0.5 * (1 + F.cos(np.pi * (near / edge - 1)))).otherwise(1.0)

    return side(F.col("r"), meta.h) * side(F.col("c"), meta.w)


def vertical_derivative(grid: DataFrame, meta: Meta, tapered: bool = True) -> DataFrame:
    """The vertical derivative of a field: its spectrum times the wavenumber, transformed back."""
    flat = detrend(densify(grid, meta))
    if tapered:
        flat = flat.withColumn("v", F.col("v") * taper(meta))
    dx, dy = meta.metres()

    def times_wavenumber(z: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        ky, kx = 2 * np.pi / (meta.h * dy) * spectra.signed(rows, meta.h), 2 * np.pi / (meta.w * dx) * spectra.signed(cols, meta.w)
        return z * np.hypot(ky[:, None], kx[None, :])

    return spectra.filtered(flat, meta.h, meta.w, ["v"], times_wavenumber, ["v"])


def spectral_depth(grid: DataFrame, meta: Meta, size: int) -> DataFrame:
    """(win_r, win_c, depth, r2) of windows at least half valid: detrended and Hann-tapered, power by ring, then a line.

    A window is size x size cells, one group of a grouped map; rings and fits are plain aggregates."""
    dx, dy = meta.metres()
    step = max(size // 2, 8)

    def power(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.full((size, size), np.nan)
        z[pdf["r"] - pdf["win_r"], pdf["c"] - pdf["win_c"]] = pdf["v"]
        z = np.where(np.isfinite(z), z, np.nanmedian(z))
        yy, xx = np.mgrid[0:size, 0:size]
        a = np.column_stack([xx.ravel(), yy.ravel(), np.ones(size * size)])
        z = z - (a @ np.linalg.lstsq(a, z.ravel(), rcond=None)[0]).reshape(size, size)
        p = np.abs(np.fft.fft2(z * np.outer(np.hanning(size), np.hanning(size)))) ** 2
        k = np.hypot(*np.meshgrid(2 * np.pi * np.fft.fftfreq(size, dx), 2 * np.pi * np.fft.fftfreq(size, dy)))
        ring = np.round(k / fundamental).astype(int).ravel()
        return pd.DataFrame({"win_r": pdf["win_r"].iloc[0], "win_c": pdf["win_c"].iloc[0], "ring": ring, "p": p.ravel()})

    fundamental = 2 * np.pi / (size * max(dx, dy))
    rings = int(0.6 * np.pi / max(dx, dy) / fundamental)
    dealt = windows(grid.filter("v IS NOT NULL"), meta, size, step, True)
    enough = dealt.groupBy("win_r", "win_c").count().filter(F.col("count") >= 0.5 * size * size).drop("count")
    spec = dealt.join(enough, ["win_r", "win_c"]).groupBy("win_r", "win_c").applyInPandas(power, "win_r int, win_c int, ring int, p double")
    fit = ring_fit(ring_means(spec.withColumn("win", F.struct("win_r", "win_c")), rings), fundamental)
    return fit.select("win.win_r", "win.win_c", "depth", "r2")


#: The sums of a window's normal equations, in order.
_SUMS = ["s_xx", "s_xy", "s_xz", "s_xn", "s_yy", "s_yz", "s_yn", "s_zz", "s_zn", "s_nn", "b_x", "b_y", "b_z", "b_n"]


def euler_sums(fields: DataFrame, meta: Meta, size: int | tuple[int, ...], index: float = 2.0) -> DataFrame:
    """The sums of each window's normal equations, for one size of windows or for several, with `size`; fields has r, c, t, gx,
    gy, gz, and cells without one of them do not count. Coordinates are about the window's centre.

    The products are summed up once for each tile, about the tile's centre; a window of any size is four places of each sum
    and is then moved to its own centre. All sizes share one shuffle and one table of sums."""
    dx, dy = meta.metres()
    sizes = size if isinstance(size, tuple) else (size,)
    reach = max(sizes)

    def kernel(block: Block) -> pa.Table:
        ok = np.isfinite(block.v).all(axis=0)
        t, gx, gy, gz = np.where(ok, block.v, 0.0)
        mid = len(t) // 2
        at = (np.arange(len(t)) - mid).astype(float)
        q = at[None, :] * dx * gx + at[:, None] * dy * gy + index * t
        level = t[ok].mean() if ok.any() else 0.0
        apart = np.where(ok, t - level, 0.0)
        # A window is flat if no two neighbours in it differ: counted, so that it is exact.
        right, below = np.zeros_like(t), np.zeros_like(t)
        right[:, 1:] = ok[:, 1:] & ok[:, :-1] & (t[:, 1:] != t[:, :-1])
        below[1:] = ok[1:] & ok[:-1] & (t[1:] != t[:-1])
        planes = [ok, gx, gy, gz, q, gx * gx, gx * gy, gx * gz, gy * gy, gy * gz, gz * gz, q * gx, q * gy, q * gz, q * q, apart, apart * apart, right, below]
        table = np.zeros((len(planes), len(t) + 1, len(t) + 1))
        np.cumsum(np.cumsum(planes, axis=1), axis=2, out=table[:, 1:, 1:])
        out = []
        h, w = block.shape
        for n in sizes:
            step = max(n // 2, 2)
            first = lambda start, side, most: np.arange(-(-start // step) * step, min(start + side, most - n), step)
            rows, cols = first(block.r0 + reach, h, meta.h), first(block.c0 + reach, w, meta.w)
            if not len(rows) or not len(cols):
                continue
            r, c = (x.ravel() for x in np.meshgrid(rows, cols, indexing="ij"))
            i, j = r - block.r0, c - block.c0
            box = lambda k, r0, c0, i=i, j=j, n=n: table[k][i + n, j + n] - table[k][i + r0, j + n] - table[k][i + n, j + c0] + table[k][i + r0, j + c0]
            m, x, y, z, sq, xx, xy, xz, yy, yz, zz, qx, qy, qz, qq, a, aa = (box(k, 0, 0) for k in range(17))
            m = np.round(m)
            ox, oy = (j + n // 2 - mid) * dx, (i + n // 2 - mid) * dy
            b = sq - ox * x - oy * y
            bb = qq - 2 * ox * qx - 2 * oy * qy + ox * ox * xx + 2 * ox * oy * xy + oy * oy * yy
            flat = box(17, 0, 1) + box(18, 1, 0) == 0
            sd = np.where(flat, 0.0, np.sqrt(np.maximum(aa / np.maximum(m, 1) - (a / np.maximum(m, 1)) ** 2, 0)))
            sums = [xx, xy, xz, index * x, yy, yz, index * y, zz, index * z, index * index * m, qx - ox * xx - oy * xy, qy - ox * xy - oy * yy, qz - ox * xz - oy * yz, index * b]
            made = pa.table({"size": np.full(len(r), n, np.int32), "win_r": r.astype(np.int32), "win_c": c.astype(np.int32), "m": m.astype(np.int64), "b": b, "bb": bb, "sd": sd, **dict(zip(_SUMS, sums, strict=True))})
            out.append(made.filter(pa.array(m > 0)))
        return pa.concat_tables(out) if out else pa.table({f.name: pa.array([], f.type) for f in _sums_schema()})

    schema = "size int, win_r int, win_c int, m long, b double, bb double, sd double" + "".join(f", {n} double" for n in _SUMS)
    columns = ["t", "gx", "gy", "gz"]
    out = tiles.gather(tiles.pieces(fields, meta, reach, columns, every=False), meta, reach, len(columns), kernel, schema)
    return out if isinstance(size, tuple) else out.drop("size")


def _sums_schema() -> pa.Schema:
    return pa.schema([*[(n, pa.int32()) for n in ("size", "win_r", "win_c")], ("m", pa.int64()), *[(n, pa.float64()) for n in ("b", "bb", "sd", *_SUMS)]])


def euler_solutions(sums: DataFrame, meta: Meta, size: int, index: float = 2.0, max_depth: float = 10_000.0) -> DataFrame:
    """(win_r, win_c, x, y, depth, reliability) of the windows whose 4 x 4 system is solved well: depth in range, its
    error at most 0.3 of it, a fit of 0.95 or more, and within two windows of the centre."""
    dx, dy = meta.metres()
    x0, y0, step_x, step_y = meta.x0, meta.y0, meta.dx, meta.dy
    names = ["x", "y", "z", "n"]
    at = {frozenset((a, b)) if a != b else frozenset((a,)): f"s_{a}{b}" for i, a in enumerate(names) for b in names[i:]}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            d = d[(d["sd"] >= 1e-10) & (d["m"] > 4)].reset_index(drop=True)
            if d.empty:
                continue
            a = np.stack([np.stack([d[at[frozenset((p, q))]] for q in names], 1) for p in names], 1)
            b = np.stack([d[f"b_{p}"] for p in names], 1)
            scale = np.sqrt(np.maximum(np.einsum("kii->ki", a), 1e-300))
            unit = a / scale[:, :, None] / scale[:, None, :]
            ok = np.linalg.cond(unit) < 1e12
            d, unit, b, scale = d[ok].reset_index(drop=True), unit[ok], b[ok], scale[ok]
            if d.empty:
                continue
            inv = np.linalg.inv(unit) / scale[:, :, None] / scale[:, None, :]
            sol = np.einsum("kij,kj->ki", inv, b)
            res = np.maximum(d["bb"].to_numpy() - np.einsum("ki,ki->k", sol, b), 0)
            dz = np.sqrt(np.maximum(res / (d["m"] - 4).to_numpy() * inv[:, 2, 2], 0))
            tot = d["bb"].to_numpy() - d["b"].to_numpy() ** 2 / d["m"].to_numpy()
            depth, off = sol[:, 2], 2 * size * max(dx, dy)
            with np.errstate(divide="ignore", invalid="ignore"):
                good = (depth > 0) & (depth < max_depth) & (dz <= 0.3 * depth) & (tot > 0) & (1 - res / tot >= 0.95) & (np.abs(sol[:, 0]) <= off) & (np.abs(sol[:, 1]) <= off)
            cx, cy = (d["win_c"] + size // 2 + 0.5) * dx, (d["win_r"] + size // 2 + 0.5) * dy
            out = pd.DataFrame({"win_r": d["win_r"], "win_c": d["win_c"], "x": x0 + (sol[:, 0] + cx) / dx * step_x, "y": y0 + (sol[:, 1] + cy) / dy * step_y, "depth": depth, "reliability": depth / np.maximum(dz, 1e-6)})
            yield out[good]

    return sums.mapInPandas(solve, "win_r int, win_c int, x double, y double, depth double, reliability double")


def euler(grid: DataFrame, meta: Meta, sizes: tuple[int, ...] = (10, 16, 24, 32), cap: int = 4_000, index: float = 2.0) -> DataFrame:
    """Solutions of all window sizes that fit a third of the grid, each capped in row-major order of the windows."""
    third = min(meta.h, meta.w) / 3
    sizes = tuple(s for s in sizes if s <= third) or (max(6, int(third)),)
    flat = detrend(densify(grid, meta))
    gz = vertical_derivative(grid, meta).withColumnRenamed("v", "gz")
    # Stored: every window size reads the fields, none computes them anew.
    fields = store.stored(terrain.slopes(flat, meta).join(gz, ["r", "c"]).select("r", "c", F.col("v").alias("t"), "gx", "gy", "gz"), "euler-fields")
    sums = store.stored(euler_sums(fields, meta, sizes, index), "euler-sums")
    out = None
    for s in sizes:
        found = euler_solutions(sums.filter(F.col("size") == s).drop("size"), meta, s, index).orderBy("win_r", "win_c").limit(cap).withColumn("size", F.lit(s))
        out = found if out is None else out.unionByName(found)
    return out


def box_depth(solutions: DataFrame, meta: Meta, radius: int = 12) -> DataFrame:
    """(r, c, v): the reliability-weighted mean depth of the solutions within radius rows and columns. solutions has r, c."""
    at = solutions.filter(F.col("r").between(0, meta.h - 1) & F.col("c").between(0, meta.w - 1)).groupBy("r", "c").agg(F.sum(F.col("reliability") * F.col("depth")).alias("wd"), F.sum("reliability").alias("w"), F.lit(1.0).alias("n"))
    if radius <= tiles.SIZE // 2:
        def kernel(block: Block) -> pa.Table:
            wd, w, n = np.nan_to_num(block.v)
            for axis in (0, 1):
                wd, w, n = (terrain.sliding(a, radius, axis) for a in (wd, w, n))
            wd, w, n = (block.inner(a) for a in (wd, w, n))
            found = tiles.rows_of(block, {"v": np.where(n > 0.5, wd / np.where(n > 0.5, w, 1), np.nan)})
            return found.filter(pc.is_valid(found["v"]))

        return tiles.gather(tiles.pieces(at, meta, radius, ["wd", "w", "n"], every=False), meta, radius, 3, kernel, "r int, c int, v double")
    sums = tiles.box_sums(at, meta, radius, ["wd", "w", "n"], False)
    return sums.filter(F.round("n") > 0).select("r", "c", (F.col("wd") / F.col("w")).alias("v"))


def depth_error(known: DataFrame, depths: DataFrame) -> DataFrame:
    """One row: the median relative error and the number of known sources (r, c, depth) that have an estimate (r, c, v)."""
    both = known.join(depths.filter("v IS NOT NULL"), ["r", "c"])
    error = store.stored(both.select((F.abs(F.col("v") - F.col("depth")) / F.col("depth")).alias("e")), "depth-error")
    n, middle = error.count(), percentiles(error, "e", [0.5])[0]
    return known.sparkSession.createDataFrame([(middle, n)], "median_error double, n long")
