"""Tiles: windows across their borders, chains, summed-area tables, wide distances and dilations."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import depth, spatial, terrain, tiles
from lodestrata.operators.grid import Meta
from tests.test_grid import array, cells

RNG = np.random.default_rng(5)


def gappy(h, w):
    a = RNG.normal(50, 9, (h, w))
    a[RNG.random((h, w)) < 0.1] = np.nan
    a[3:9, 4:12] = np.nan
    return a


def box(a, k, mirrored=True):
    padded = np.pad(a, k, "symmetric") if mirrored else np.pad(a, k, constant_values=np.nan)
    win = np.lib.stride_tricks.sliding_window_view(padded, (2 * k + 1, 2 * k + 1))
    return np.nansum(win, axis=(2, 3)), np.isfinite(win).sum(axis=(2, 3))


@pytest.mark.parametrize("size", [7, 16, 64])
def test_windows_do_not_see_the_tiles(spark, monkeypatch, size):
    monkeypatch.setattr(tiles, "SIZE", size)
    for f in (tiles.pieces, tiles.gather, tiles.stencil, tiles.assemble):
        monkeypatch.setattr(f, "__defaults__", tuple(size if d == 256 else d for d in f.__defaults__))
    a, meta = gappy(45, 38), Meta(45, 38)
    g = cells(spark, a)
    s, n = box(a, 3)
    mean = np.where(n > 0, s / np.maximum(n, 1), np.nan)
    assert np.allclose(array(terrain.box_mean(g, meta, 7), a.shape), mean, equal_nan=True)
    gy, gx = np.gradient(a, 100.0)
    curve = np.gradient(gx, 100.0, axis=1) + np.gradient(gy, 100.0, axis=0)
    got = terrain.derivatives(g, meta, 7)
    assert np.allclose(array(got.select("r", "c", F.col("slope").alias("v")), a.shape), np.hypot(gx, gy), equal_nan=True)
    assert np.allclose(array(got.select("r", "c", F.col("curvature").alias("v")), a.shape), curve, equal_nan=True)
    assert np.allclose(array(got.select("r", "c", F.col("tpi").alias("v")), a.shape), a - mean, equal_nan=True)
    sy, sx = np.gradient(mean, 100.0)
    whole = terrain.surface(g, meta, 7)
    assert np.allclose(array(whole.select("r", "c", F.col("slope").alias("v")), a.shape), np.hypot(sx, sy), equal_nan=True)
    assert np.allclose(array(whole.select("r", "c", F.col("tpi").alias("v")), a.shape), a - mean, equal_nan=True)


def test_a_chain_is_one_exchange(spark):
    g = cells(spark, gappy(20, 20))
    plan = terrain.derivatives(g, Meta(20, 20), 5)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Window" not in plan and "Join" not in plan


def test_chains_of_stored_tiles(spark):
    meta = Meta(70, 55)
    made = tiles.made(spark, meta, lambda r, c: np.sin(r / 3) * c, 16)
    k = 4

    def kernel(block):
        return {"mean": terrain.mean_of(block, k), "gx": block.inner(block.gradient(block.v[0], 1, 1.0))}

    out = tiles.untiled(tiles.chain(made, meta, k, kernel, size=16), meta, ["mean", "gx"], 16)
    r, c = np.mgrid[0:70, 0:55]
    a = np.sin(r / 3) * c
    s, n = box(a, k)
    assert np.allclose(array(out.select("r", "c", F.col("mean").alias("v")), a.shape), s / n)
    assert np.allclose(array(out.select("r", "c", F.col("gx").alias("v")), a.shape), np.gradient(a, axis=1))
    back = tiles.untiled(tiles.tiled(cells(spark, a), meta, size=32), meta, ["v"], 32)
    assert np.allclose(array(back, a.shape), a)


@pytest.mark.parametrize("k,mirrored", [(2, True), (11, True), (23, False), (40, False)])
def test_summed_area_tables(spark, k, mirrored):
    a, meta = gappy(47, 61), Meta(47, 61)
    rows = cells(spark, a).select("r", "c", "v", F.when(F.col("v").isNotNull(), 1.0).alias("n"))
    got = tiles.box_sums(rows, meta, k, ["v", "n"], mirrored, size=16)
    s, n = box(a, k, mirrored)
    assert np.allclose(array(got.select("r", "c", "v"), a.shape), s) and np.allclose(array(got.select("r", "c", F.col("n").alias("v")), a.shape), n)


def test_wide_means_are_summed_up(spark, monkeypatch):
    a, meta = gappy(60, 50), Meta(60, 50)
    s, n = box(a, 20)
    monkeypatch.setattr(tiles, "SIZE", 16)
    assert np.allclose(array(terrain.box_mean(cells(spark, a), meta, 41), a.shape), s / n)
    marks = spark.createDataFrame([(5, 7, 2.0, 10.0), (5, 7, 1.0, 40.0), (50, 44, 3.0, 20.0)], "r int, c int, reliability double, depth double")
    near = array(depth.box_depth(marks, meta, 12), a.shape)
    assert np.isclose(near[17, 19], 20.0) and np.isnan(near[18, 7]) and np.isclose(near[38, 32], 20.0)


def test_euler_sums_of_all_sizes(spark):
    n, meta = 300, Meta(300, 300)
    f = {k: RNG.normal(0, 1, (n, n)) for k in ("t", "gx", "gy", "gz")}
    f["t"][:40, :40] = 7.0
    gone = RNG.random((n, n)) < 0.02
    r, c = np.nonzero(~gone)
    rows = spark.createDataFrame([(int(a), int(b), *(float(f[k][a, b]) for k in ("t", "gx", "gy", "gz"))) for a, b in zip(r, c)], "r int, c int, t double, gx double, gy double, gz double")
    got = {(x["size"], x["win_r"], x["win_c"]): x for x in depth.euler_sums(rows, meta, (10, 32)).collect()}
    assert {k[0] for k in got} == {10, 32} and max(k[1] for k in got if k[0] == 10) == 285
    for size, a, b in ((10, 0, 0), (10, 250, 255), (32, 240, 16), (32, 256, 256), (10, 120, 45)):
        i, j = np.mgrid[a : a + size, b : b + size]
        ok = ~gone[a : a + size, b : b + size]
        t, gx, gy, gz = (f[k][a : a + size, b : b + size][ok] for k in ("t", "gx", "gy", "gz"))
        rhs = (j[ok] - b - size // 2) * 100.0 * gx + (i[ok] - a - size // 2) * 100.0 * gy + 2 * t
        x = got[size, a, b]
        want = {"m": len(t), "b": rhs.sum(), "bb": (rhs**2).sum(), "sd": t.std(), "s_xx": (gx * gx).sum(), "s_yz": (gy * gz).sum(), "s_xn": 2 * gx.sum(), "b_x": (gx * rhs).sum(), "b_y": (gy * rhs).sum(), "b_z": (gz * rhs).sum(), "b_n": 2 * rhs.sum()}
        assert all(np.isclose(x[k], v, rtol=1e-8, atol=1e-5) for k, v in want.items()), (size, a, b)
    assert got[10, 0, 0]["sd"] == 0.0


def test_distances_of_many_strips(spark, monkeypatch):
    monkeypatch.setattr(spatial, "STRIP", 400)
    meta = Meta(57, 83)
    marks = {(int(r), int(c)): int(k) for r, c, k in zip(RNG.integers(0, 57, 40), RNG.integers(0, 83, 40), RNG.integers(0, 5, 40))}
    got = spatial.nearest_marks(spark.createDataFrame([(r, c, k) for (r, c), k in marks.items()], "r int, c int, ord long"), meta).collect()
    assert len(got) == 57 * 83
    for x in got[::7]:
        d, k = min((np.hypot(x["r"] - r, x["c"] - c) * 100, k) for (r, c), k in marks.items())
        assert np.isclose(x["d"], d) and x["ord"] == k and marks[x["mr"], x["mc"]] == k
    none = spark.createDataFrame([], "r int, c int, ord long")
    assert spatial.nearest_marks(none, meta).count() == 0


@pytest.mark.parametrize("n", [0, 3, 90])
def test_dilation(spark, n):
    meta = Meta(130, 150)
    marks = [(5, 6), (100, 149), (64, 70)]
    got = {(x["r"], x["c"]) for x in terrain.dilate(spark.createDataFrame(marks, "r int, c int"), meta, n).collect()}
    r, c = np.mgrid[0:130, 0:150]
    want = np.min([abs(r - a) + abs(c - b) for a, b in marks], axis=0) <= n
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(want))}
