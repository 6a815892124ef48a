"""Ranks of many columns, transforms over strips, inverse distances by convolution, and nearest places off the grid."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata import store
from lodestrata.operators import grid, ranks, spatial, spectra
from lodestrata.operators.grid import Meta
from lodestrata.plans import fixtures, queries
from tests.test_grid import array, cells

RNG = np.random.default_rng(8)


def test_quantiles_of_all_columns(spark, monkeypatch):
    n = 3_000
    a = {"a": RNG.normal(size=n), "b": -np.exp(RNG.normal(size=n) * 9), "c": np.round(RNG.normal(size=n), 1), "d": np.full(n, -2.5), "e": RNG.choice([-0.0, 1e300, -1e-300, 7.0], n)}
    hole = RNG.random(n) < 0.1
    rows = spark.createDataFrame([tuple(None if h and k == "a" else float(v[i]) for k, v in a.items()) + (None,) for i, h in enumerate(hole)], ", ".join(f"{k} double" for k in [*a, "f"]))
    shares = [0, 0.02, 0.5, 0.95, 1]
    calls = []
    plain = ranks._counts
    monkeypatch.setattr(ranks, "_counts", lambda base, marks: (calls.append(marks), plain(base, marks))[1])
    got = ranks.quantiles(rows, [*a, "f"], shares)
    for k, v in a.items():
        assert np.allclose(got[k], np.quantile(v[~hole] if k == "a" else v, shares)), k
    assert got["f"] == [None] * 5
    many = len(calls)
    calls.clear()
    ranks.quantiles(rows, ["a"], shares)
    assert many <= len(calls) + 6  # rounds do not add up over columns
    assert ranks.quantiles(rows.limit(0), ["a"], [0.5]) == {"a": [None]}


@pytest.mark.parametrize("shape,size,strip", [((30, 41), None, 100), ((17, 24), (40, 51), 64), ((64, 64), None, 2_000_000)])
def test_transforms_over_strips(spark, monkeypatch, shape, size, strip):
    monkeypatch.setattr(spectra, "STRIP", strip)
    a = RNG.normal(size=shape)
    tall, wide = size or shape
    halves = lambda z, r, c: z / (1.0 + spectra.signed(r, tall)[:, None] ** 2 + spectra.signed(c, wide)[None, :] ** 2)
    got = array(spectra.filtered(cells(spark, a), *shape, ["v"], halves, ["v"], size), shape)
    padded = np.zeros((tall, wide))
    padded[: shape[0], : shape[1]] = a
    k = spectra.signed(np.arange(tall), tall)[:, None] ** 2 + spectra.signed(np.arange(wide), wide)[None, :] ** 2
    assert np.allclose(got, np.fft.ifft2(np.fft.fft2(padded) / (1.0 + k)).real[: shape[0], : shape[1]])


@pytest.mark.parametrize("power", [2.0, 3.0])
def test_inverse_distances_by_convolution(spark, power):
    meta = Meta(40, 55, 0, 0, 50.0, -100.0)
    points = spark.createDataFrame([(int(r), int(c), float(v)) for r, c, v in zip(RNG.integers(0, 40, 25), RNG.integers(0, 55, 25), RNG.normal(100, 30, 25))] + [(3, 3, None)], "r int, c int, v double")
    got = array(spatial.idw_grid(points, meta, power), (40, 55))
    want = array(spatial.idw(grid.cells(spark, meta), points.filter("v IS NOT NULL"), power, 50.0, 100.0), (40, 55))
    assert np.allclose(got, want, rtol=1e-10)
    plan = spatial.idw_grid(points, meta)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert spatial.idw_grid(points.limit(0), meta).count() == 0


def test_nearest_off_the_grid(spark):
    places = [(int(a), int(b)) for a, b in RNG.integers(-400, 400, (300, 2))] + [(100_000, -5), (0, 0), (0, 0), (None, 1)]
    points = [(int(a), int(b), i % 40, f"n{i}") for i, (a, b) in enumerate(RNG.integers(0, 60, (200, 2)))] + [(390, -390, 7, "far"), (None, None, 1, "none")]
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id int, r int, c int")
    right = spark.createDataFrame(points, "r int, c int, ord long, name string")
    got = {r["id"]: r for r in spatial.nearest(left, right, 3.0, 2.0, keys=("id",)).collect()}
    assert len(got) == len(places) - 1
    for i, (r, c) in enumerate(places):
        if r is None:
            continue
        d = lambda p: np.hypot((p[0] - r) * 2.0, (p[1] - c) * 3.0)  # noqa: B023, E731
        known = [p for p in points if p[0] is not None]
        least = min(d(p) for p in known)
        assert np.isclose(got[i]["dist"], least) and got[i]["p_ord"] == min(p[2] for p in known if np.isclose(d(p), least, rtol=1e-12))
    assert spatial.nearest(left, right.limit(0), keys=("id",)).count() == 0 and spatial.nearest(left.limit(0), right, keys=("id",)).count() == 0
    assert set(spatial.nearest(left, right, keys=("id",)).columns) == {"id", "dist", "p_ord", "p_r", "p_c", "p_name"}


@pytest.mark.parametrize(("n_places", "n_points"), [(300, 90), (90, 300)])
def test_nearest_in_crowds(spark, monkeypatch, n_places, n_points):
    """Nine of ten in a corner, lists of four points: all are found, and pairs are no rows."""
    monkeypatch.setattr(spatial, "LIST", 4, raising=False)
    monkeypatch.setattr(spatial, "CROWD", 8, raising=False)
    plans, stored = [], store.stored

    def seen(df, tag):
        if tag == "nearest-round":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, tag)

    monkeypatch.setattr(store, "stored", seen)
    lay = lambda n: np.where(np.arange(n)[:, None] % 10 > 0, RNG.integers(0, 25, (n, 2)), RNG.integers(0, 1_000, (n, 2)))
    places, points = lay(n_places), lay(n_points)
    left = spark.createDataFrame([(i, int(r), int(c)) for i, (r, c) in enumerate(places)], "id int, r int, c int")
    right = spark.createDataFrame([(int(r), int(c), i) for i, (r, c) in enumerate(points)], "r int, c int, ord long")
    got = {r["id"]: (r["dist"], r["p_ord"]) for r in spatial.nearest(left, right, keys=("id",)).collect()}
    assert plans and all("collect_list" in p for p in plans)
    d2 = ((places[:, None] - points[None]) ** 2).sum(axis=2)
    assert got == {i: (float(np.sqrt(row.min())), int(row.argmin())) for i, row in enumerate(d2)}


def _kept_rows(monkeypatch):
    """The sizes of all tables that are stored from here on."""
    kept, stored = {}, store.stored

    def count(df, tag):
        out = stored(df, tag)
        kept[tag] = out.count()
        return out

    monkeypatch.setattr(store, "stored", count)
    return kept


@pytest.mark.parametrize("few", [10, 50_000])
def test_points_of_one_cell_are_not_copied(spark, monkeypatch, few):
    """Of 3,000 points on 30 cells the 30 first are left, whether they are broadcast or joined."""
    meta = Meta(30, 30, dx=1.0, dy=-1.0)
    points = spark.range(3_000).select((F.col("id") % 30).cast("int").alias("r"), (F.col("id") * 7 % 30).cast("int").alias("c"), (F.col("id") * 11 % 3_001).alias("ord"), F.concat(F.lit("p"), F.col("id")).alias("name"))
    first = {}
    for p in points.collect():
        first[p["r"], p["c"]] = min(first.get((p["r"], p["c"]), (9_999, "")), (p["ord"], p["name"]))
    kept = _kept_rows(monkeypatch)
    for limit in (None, 3):
        monkeypatch.setattr(spatial, "FEW", few)
        if limit:
            monkeypatch.setattr(spatial, "WIDE", limit)
        out = spatial.nearest_on_grid(points, meta)
        assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {(r["r"], r["c"]): r for r in out.collect()}
        assert len(got) == 900 and kept["nearest-points"] == len(first) == 30
        for (r, c), x in got.items():
            least = min((r - a) ** 2 + (c - b) ** 2 for a, b in first)
            assert np.isclose(x["dist"] ** 2, least) and (x["p_ord"], x["p_name"]) == min(v for (a, b), v in first.items() if (r - a) ** 2 + (c - b) ** 2 == least)


@pytest.mark.parametrize("name", ["nearest_deposit", "nearest_value"])
def test_nearest_orders_by_cell(spark, sf, monkeypatch, name):
    """Of all orders the first of each cell is kept."""
    used = fixtures.deposits(spark, sf).select("r", "c").distinct().count()
    kept = _kept_rows(monkeypatch)
    assert queries.QUERIES[name](spark, sf).count() > 0 and kept["nearest-points"] == used


def _shuffled(spark, run):
    """Bytes that run shuffles, spills and writes, by the stages that it starts."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return [found.apply(i) for i in range(found.size())]

    last = max((x.stageId() for x in stages()), default=-1)
    run()
    own = [x for x in stages() if x.stageId() > last]
    assert own
    return sum(x.shuffleWriteBytes() + x.memoryBytesSpilled() + x.diskBytesSpilled() + x.outputBytes() for x in own)


@pytest.mark.parametrize("name", ["nearest_deposit", "nearest_value"])
def test_more_orders_shuffle_no_more(spark, sf, tmp_path, same, name):
    """Of 40 times the orders no more is shuffled, and the rows are those of the SQL."""
    orders = fixtures.table(spark, sf, "orders")
    step = orders.agg(F.max("o_orderkey")).first()[0] + 1
    size = {}
    for n in (1, 40):
        at = tmp_path / str(n)
        copies = orders.crossJoin(spark.range(n).withColumnRenamed("id", "i")).withColumn("o_orderkey", F.col("o_orderkey") + F.col("i") * step).drop("i")
        copies.coalesce(1).sortWithinPartitions(F.desc("o_orderkey")).write.parquet(f"{at}/orders.parquet")
        fixtures.table(spark, sf, "lineitem").coalesce(1).write.parquet(f"{at}/lineitem.parquet")
        con = duckdb.connect()
        for t in ("orders", "lineitem"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
        size[n] = _shuffled(spark, lambda: same(queries.QUERIES[name](spark, str(at)), con, queries.ORACLES[name]))  # noqa: B023
    assert size[40] < 2 * size[1]


def test_many_marks_are_dealt(spark, monkeypatch):
    meta = Meta(30, 30)
    points = spark.createDataFrame([(i, 29 - i, i, f"p{i}") for i in range(30)], "r int, c int, ord long, name string")
    few = sorted(map(tuple, spatial.nearest_on_grid(points, meta).select("r", "c", "p_name").collect()))
    monkeypatch.setattr(spatial, "FEW", 10)
    assert few == sorted(map(tuple, spatial.nearest_on_grid(points, meta).select("r", "c", "p_name").collect()))
