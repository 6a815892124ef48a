"""Every registered query with SQL against DuckDB; the others by brute force or what must hold of them."""

from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import metrics
from lodestrata.plans import queries as q
from tests.test_grid import array


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_against_sql(name, spark, sf, duck, same):
    same(q.QUERIES[name](spark, sf), duck, q.ORACLES[name])


def dft_derivative(a):
    """The vertical derivative by plain transforms of the tapered, detrended field."""
    h, w = a.shape
    yy, xx = np.mgrid[0:h, 0:w]
    m = np.column_stack([xx.ravel(), yy.ravel(), np.ones(h * w)])
    z = a - (m @ np.linalg.lstsq(m, a.ravel(), rcond=None)[0]).reshape(h, w)
    side = lambda n: np.array([0.5 * (1 + np.cos(np.pi * (min(i, n - 1 - i) / (0.1 * (n - 1)) - 1))) if min(i, n - 1 - i) < 0.1 * (n - 1) else 1.0 for i in range(n)])
    k = np.hypot(*np.meshgrid(2 * np.pi * np.fft.fftfreq(w, 100), 2 * np.pi * np.fft.fftfreq(h, 100)))
    return np.fft.ifft2(np.fft.fft2(z * np.outer(side(h), side(w))) * k).real


@pytest.fixture(scope="module")
def pole_field(spark, sf):
    return array(q._field(spark, sf, 400.0), (q.N, q.N))


def test_fft_vertical_derivative(spark, sf, pole_field):
    got = array(q.QUERIES["fft_vertical_derivative"](spark, sf), (q.N, q.N))
    assert np.allclose(got, dft_derivative(pole_field), atol=1e-6, rtol=1e-6)


def test_euler_solutions(spark, sf, pole_field):
    """Every accepted window by a plain least-squares solution, and no other."""
    yy, xx = np.mgrid[0 : q.N, 0 : q.N]
    m = np.column_stack([xx.ravel(), yy.ravel(), np.ones(q.N**2)])
    t = pole_field - (m @ np.linalg.lstsq(m, pole_field.ravel(), rcond=None)[0]).reshape(q.N, q.N)
    gy, gx = np.gradient(t, 100.0)
    gz = dft_derivative(pole_field)
    want = {}
    for size in (10, 16):
        step = size // 2
        for r in range(0, q.N - size, step):
            for c in range(0, q.N - size, step):
                own = (slice(r, r + size), slice(c, c + size))
                x, y = (xx[own] - c - size // 2) * 100.0, (yy[own] - r - size // 2) * 100.0
                a = np.column_stack([v.ravel() for v in (gx[own], gy[own], gz[own], 2 * np.ones((size, size)))])
                b = (x * gx[own] + y * gy[own] + 2 * t[own]).ravel()
                if t[own].std() < 1e-10:
                    continue
                sol = np.linalg.lstsq(a, b, rcond=None)[0]
                res = ((a @ sol - b) ** 2).sum()
                dz = np.sqrt(res / (size * size - 4) * np.linalg.inv(a.T @ a)[2, 2])
                if 0 < sol[2] < 10_000 and dz <= 0.3 * sol[2] and 1 - res / ((b - b.mean()) ** 2).sum() >= 0.95 and np.abs(sol[:2]).max() <= 200 * size:
                    want[size, r, c] = sol[2]
    got = {(r["size"], r["win_r"], r["win_c"]): r["depth"] for r in q.QUERIES["euler_solutions"](spark, sf).collect()}
    assert set(got) == set(want) and got and all(abs(got[k] - want[k]) <= 0.02 + 1e-4 * want[k] for k in want)


def test_spectral_depth_map(spark, sf):
    """Each window's depth by a plain transform, ring means and line fit."""
    a = array(q._field(spark, sf, 150.0), (q.N, q.N))
    size, got = 24, {(r["win_r"], r["win_c"]): (r["depth"], r["r2"]) for r in q.QUERIES["spectral_depth_map"](spark, sf).collect()}
    yy, xx = np.mgrid[0:size, 0:size]
    m = np.column_stack([xx.ravel(), yy.ravel(), np.ones(size * size)])
    base = 2 * np.pi / (size * 100)
    k = np.hypot(*np.meshgrid(2 * np.pi * np.fft.fftfreq(size, 100), 2 * np.pi * np.fft.fftfreq(size, 100)))
    ring, top = np.round(k / base).astype(int), int(0.6 * np.pi / 100 / base)
    want = {}
    for r in range(0, q.N - size + 1, 12):
        for c in range(0, q.N - size + 1, 12):
            z = a[r : r + size, c : c + size]
            z = z - (m @ np.linalg.lstsq(m, z.ravel(), rcond=None)[0]).reshape(size, size)
            p = np.abs(np.fft.fft2(z * np.outer(np.hanning(size), np.hanning(size)))) ** 2
            x, y = map(np.array, zip(*[(i * base, np.log(p[ring == i].mean())) for i in range(1, top + 1) if (ring == i).sum() >= 3]))
            above = y > np.median(y[-max(3, len(y) // 4) :]) + 2
            first = np.argmin(above) if not above.all() else len(above)
            use = np.arange(len(y)) < first if first >= 4 else above
            if use.sum() < 4:
                continue
            s, i = np.polyfit(x[use], y[use], 1)
            want[r, c] = (-s / 2 if s < 0 else None, 1 - ((y[use] - s * x[use] - i) ** 2).sum() / ((y[use] - y[use].mean()) ** 2).sum())
    assert set(got) == set(want) and want
    for w, (d, r2) in want.items():
        assert (got[w][0] is None) == (d is None) and (d is None or abs(got[w][0] - d) < 0.01 + 1e-4 * d) and abs(got[w][1] - r2) < 1e-4


@pytest.mark.parametrize("name, column", [("rf_probability", "probability"), ("rf_uncertainty", "uncertainty")])
def test_forests_cover_every_cell(spark, sf, name, column):
    cells, samples = q._samples(spark, sf)
    got = q.QUERIES[name](spark, sf).join(samples.select("r", "c", "label"), ["r", "c"])
    assert got.count() == cells.count() and got.filter(f"{column} NOT BETWEEN 0 AND 1").count() == 0
    if column == "probability":  # the labels follow from two of the features
        assert metrics.roc_auc(got.select("label", F.col(column).alias("score"))).first()[0] > 0.9


def test_spatial_cv(spark, sf):
    rows = q.QUERIES["spatial_cv"](spark, sf).collect()
    assert sum(r["n"] for r in rows) == q._samples(spark, sf)[1].count() and all(r["auc"] > 0.8 for r in rows)


def test_pipeline_targets(spark, sf):
    rows = q.QUERIES["pipeline_targets"](spark, sf).orderBy("rank").collect()
    p = [r["probability"] for r in rows]
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and p == sorted(p, reverse=True) and min(p) >= 0.5
    assert all((a["r"] - b["r"]) ** 2 + (a["c"] - b["c"]) ** 2 >= 9 for a in rows for b in rows if a["rank"] < b["rank"])


@pytest.fixture(scope="module")
def even(sf, tmp_path_factory):
    """The tables with prices close together, as averages over many lineitems are."""
    out = tmp_path_factory.mktemp("even")
    for p in Path(sf).glob("*.parquet"):
        if p.stem != "lineitem":
            (out / p.name).symlink_to(p)
    duckdb.sql(f"SELECT * REPLACE (50000 + (l_extendedprice - 50000) / 20 AS l_extendedprice) FROM '{sf}/lineitem.parquet'").write_parquet(str(out / "lineitem.parquet"))
    return str(out)


def test_pipeline_targets_of_an_even_field(spark, even):
    """The deposits follow the field's own spread: a fixed height found none in larger tables."""
    rows = q.QUERIES["pipeline_targets"](spark, even).collect()
    assert rows and min(r["probability"] for r in rows) >= 0.5


def test_block_split_of_an_even_field(spark, even, same):
    """The draw by blocks where no value is low: labels of one kind alone had rows drawn instead."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{even}/lineitem.parquet'")
    same(q.QUERIES["block_split"](spark, even), con, q.ORACLES["block_split"])


def test_every_query_without_sql_is_tested_here():
    import tests.test_queries as own

    text = open(own.__file__).read()
    assert [n for n in set(q.QUERIES) - set(q.ORACLES) if f"test_{n}" not in text and f'"{n}"' not in text] == []


def test_entry_has_every_query(spark):
    import __spark_entry__ as e

    assert set(q.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
