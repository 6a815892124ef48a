"""The registered queries of the engine's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata import store
from lodestrata.functions import crs, scalar
from lodestrata.operators import deposits as dep
from lodestrata.operators import depth, grid, metrics, sampling, spatial, targets, terrain
from lodestrata.plans import catalog
from lodestrata.plans import fixtures as fx
from lodestrata.plans.fixtures import CELLS_SQL, DEM_SQL, DEPOSIT_CELLS_SQL, DEPOSITS_SQL, FULL_SQL, MASKED, META, N, SCORES_SQL, grid_sql

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def _v(rows: DataFrame, digits: int = 6) -> DataFrame:
    return rows.select("r", "c", r6("v", digits).alias("v"))


# Grids


@query(f"WITH {DEM_SQL} SELECT CAST(floor((r + 0.5) * 12 / 48) AS INTEGER) AS r, CAST(floor((c + 0.5) * 12 / 48) AS INTEGER) AS c, round(avg(v), 8) + 0.0 AS v FROM dem WHERE v IS NOT NULL GROUP BY 1, 2")
def grid_decimate_avg(spark, sf):
    return _v(grid.decimate(fx.dem(spark, sf), META, 12, 12)[0], 8)


@query(f"""WITH {DEM_SQL}, k AS (SELECT r, c, v, r * 5 AS r0, c * 5 AS c0 FROM dem WHERE v IS NOT NULL),
-- A cell is 5 x 5 parts, a cell of the 15 x 15 grid 16 x 16 of them: 48 * 5 = 15 * 16.
o AS (SELECT (r0 + a.i) // 16 AS r, (c0 + b.i) // 16 AS c, v FROM k, range(5) a(i), range(5) b(i))
SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, round(avg(v), 8) + 0.0 AS v FROM o GROUP BY 1, 2""")
def decimate_fraction(spark, sf):
    """A ratio that is not whole: cells count by the area that they share."""
    return _v(grid.decimate(fx.dem(spark, sf), META, 15, 15)[0], 8)


@query(f"WITH {DEM_SQL} SELECT CAST(r - 12 AS INTEGER) AS r, CAST(c - 12 AS INTEGER) AS c, round(v, 9) + 0.0 AS v FROM dem WHERE r BETWEEN 12 AND 35 AND c BETWEEN 12 AND 35")
def center_crop(spark, sf):
    return _v(grid.center_crop(fx.dem(spark, sf), META)[0], 9)


@query(f"WITH {grid_sql()} SELECT r, c, CASE WHEN (r * 7 + c * 3) % 29 <> 0 AND (r + c) % 31 <> 0 THEN round(v, 9) + 0.0 END AS v FROM g")
def nodata_mask(spark, sf):
    raw = fx.grid(spark, sf).withColumn("v", F.expr("CASE WHEN (r * 7 + c * 3) % 29 = 0 THEN -9999D WHEN (r + c) % 31 = 0 THEN 1e38D ELSE v END"))
    return _v(grid.mask(raw, -9999.0), 9)


@query(f"WITH {grid_sql()}, {grid_sql('a', flag='A')}, {grid_sql('n', flag='N')} SELECT g.r, g.c, round(g.v, 9) + 0.0 AS v, round(a.v, 9) + 0.0 AS a, round(n.v, 9) + 0.0 AS n FROM g LEFT JOIN a USING (r, c) LEFT JOIN n USING (r, c)")
def layer_stack_join(spark, sf):
    out = grid.stack(fx.grid(spark, sf), {"a": fx.grid(spark, sf, flag="A"), "n": fx.grid(spark, sf, flag="N")})
    return out.select("r", "c", *[r6(x, 9).alias(x) for x in ("v", "a", "n")])


@query(f"WITH {grid_sql()}, {grid_sql('a', flag='A')}, w AS (SELECT g.r, g.c, CASE WHEN a.v NOT BETWEEN 37.0 AND 37.3 THEN a.v END AS a FROM g LEFT JOIN a USING (r, c)) SELECT r, c, round(coalesce(a, (SELECT coalesce(quantile_cont(a, 0.5), 0) FROM w)), 9) + 0.0 AS a FROM w")
def median_fill(spark, sf):
    wide = grid.stack(fx.grid(spark, sf), {"a": fx.grid(spark, sf, flag="A").withColumn("v", F.expr(MASKED))})
    return grid.median_fill(wide, ["a"]).select("r", "c", r6("a", 9).alias("a"))


@query(
    f"WITH {grid_sql()}, {grid_sql('a', flag='A')}, w AS (SELECT g.v, a.v AS a, 1.5::DOUBLE AS k FROM g LEFT JOIN a USING (r, c)), "
    "l AS (SELECT 'v' AS layer, v AS x FROM w UNION ALL SELECT 'a', a FROM w UNION ALL SELECT 'k', k FROM w) "
    "SELECT layer, count(x) AS n_valid, round(count(x) / count(*), 6) AS valid, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS std, round(min(x), 6) + 0.0 AS low, round(max(x), 6) + 0.0 AS high, count(x) / count(*) < 0.05 AS sparse, count(x) = 0 OR stddev_pop(x) < 1e-12 AS flat FROM l GROUP BY layer"
)
def layer_rejection_stats(spark, sf):
    wide = grid.stack(fx.grid(spark, sf), {"a": fx.grid(spark, sf, flag="A")}).withColumn("k", F.lit(1.5))
    out = grid.layer_stats(wide, ["v", "a", "k"])
    return out.select("layer", "n_valid", F.round("valid", 6).alias("valid"), *[r6(x).alias(x) for x in ("mean", "std", "low", "high")], "sparse", "flat")


@query(f"""WITH {DEM_SQL}, t AS (SELECT CAST(a.i AS INTEGER) AS r, CAST(b.i AS INTEGER) AS c, (a.i + 0.5) * 48.0 / 30 - 0.5 AS fr, (b.i + 0.5) * 48.0 / 30 - 0.5 AS fc FROM range(30) a(i), range(30) b(i)),
k AS (SELECT r, c, fr, fc, p.i AS a, q.i AS b FROM t, range(2) p(i), range(2) q(i)),
n AS (SELECT r, c, (CASE WHEN a = 1 THEN fr - floor(fr) ELSE 1 - fr + floor(fr) END) * (CASE WHEN b = 1 THEN fc - floor(fc) ELSE 1 - fc + floor(fc) END) AS w, greatest(0, least(47, floor(fr) + a)) AS sr, greatest(0, least(47, floor(fc) + b)) AS s_c FROM k)
SELECT n.r, n.c, round(sum(w * v) / sum(w), 8) + 0.0 AS v FROM n JOIN dem ON dem.r = sr AND dem.c = s_c WHERE w > 1e-12 AND v IS NOT NULL GROUP BY 1, 2""")
def bilinear_align(spark, sf):
    target = grid.Meta(30, 30, META.x0, META.y0, 160.0, -160.0)
    return _v(grid.align(fx.dem(spark, sf), META, target), 8)


@query(f"WITH {FULL_SQL} SELECT CAST(r // 5 AS INTEGER) AS r, CAST(c // 5 AS INTEGER) AS c, round(v, 9) + 0.0 AS v FROM f WHERE r % 5 = 0 AND c % 5 = 0 AND v IS NOT NULL")
def stride_downsample(spark, sf):
    return _v(grid.stride(fx.dem(spark, sf), 5), 9).filter("v IS NOT NULL")


# Windows

_PAD = f"ax AS (SELECT CAST(i AS INTEGER) AS at, CAST(CASE WHEN i < 0 THEN -1 - i WHEN i >= {N} THEN {2 * N - 1} - i ELSE i END AS INTEGER) AS src FROM range(-6, {N + 6}) t(i)), pad AS (SELECT a.at AS r, b.at AS c, v FROM ax a, ax b, dem WHERE dem.r = a.src AND dem.c = b.src)"
_BOX = f"WITH {FULL_SQL}, {_PAD}, m AS (SELECT cells.r, cells.c, avg(pad.v) AS m FROM cells LEFT JOIN pad ON pad.r BETWEEN cells.r - K AND cells.r + K AND pad.c BETWEEN cells.c - K AND cells.c + K GROUP BY 1, 2) "


def _box(k: int) -> str:
    return _BOX.replace(" K ", f" {k} ")


@query(_box(3) + "SELECT r, c, round(m, 6) + 0.0 AS v FROM m")
def box_mean(spark, sf):
    return _v(terrain.box_mean(fx.dem(spark, sf), META, 7))


@query(_box(3) + "SELECT r, c, round(v - m, 6) + 0.0 AS v FROM dem JOIN m USING (r, c)")
def tpi(spark, sf):
    return _v(terrain.tpi(fx.dem(spark, sf), META, 7))


@query(_box(5) + "SELECT r, c, round(v - m, 6) + 0.0 AS v FROM dem JOIN m USING (r, c)")
def tpi_fixed_11(spark, sf):
    return _v(terrain.tpi(fx.dem(spark, sf), META, 11))


def _grad(s: str) -> str:
    d = lambda e, a, p: f"CASE WHEN {a} = 0 THEN (lead({e}) OVER {p} - {e}) / {s} WHEN {a} = {N - 1} THEN ({e} - lag({e}) OVER {p}) / {s} ELSE (lead({e}) OVER {p} - lag({e}) OVER {p}) / (2 * {s}) END"
    return (
        f"WITH {FULL_SQL}, s AS (SELECT r, c, v, {d('v', 'c', 'x')} AS gx, {d('v', 'r', 'y')} AS gy FROM f WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r)), "
        f"q AS (SELECT r, c, {d('gx', 'c', 'x')} AS gxx, {d('gy', 'r', 'y')} AS gyy FROM s WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r)) "
    )


@query(_grad("100.0") + "SELECT r, c, round(sqrt(gx * gx + gy * gy), 6) + 0.0 AS v FROM s")
def slope(spark, sf):
    return _v(terrain.slope(fx.dem(spark, sf), META))


@query(_grad("100.0") + "SELECT r, c, round(sin(atan2(gy, gx)), 6) + 0.0 AS aspect_sin, round(cos(atan2(gy, gx)), 6) + 0.0 AS aspect_cos FROM s")
def aspect_sincos(spark, sf):
    return terrain.aspect(fx.dem(spark, sf), META).select("r", "c", r6("aspect_sin").alias("aspect_sin"), r6("aspect_cos").alias("aspect_cos"))


@query(_grad("100.0") + "SELECT r, c, round(gxx + gyy, 9) + 0.0 AS v FROM q")
def curvature(spark, sf):
    return _v(terrain.curvature(fx.dem(spark, sf), META), 9)


@query(_grad("1.0") + "SELECT r, c, round(sqrt(gx * gx + gy * gy), 6) + 0.0 AS slope, round(atan2(gy, gx), 6) + 0.0 AS aspect, round(gxx + gyy, 6) + 0.0 AS curvature FROM s JOIN q USING (r, c)")
def terrain_pixel_units(spark, sf):
    d = fx.dem(spark, sf)
    out = terrain.slope(d, META, False).withColumnRenamed("v", "slope").join(terrain.aspect(d, META, False), ["r", "c"]).join(terrain.curvature(d, META, False).withColumnRenamed("v", "curvature"), ["r", "c"])
    return out.select("r", "c", *[r6(x).alias(x) for x in ("slope", "aspect", "curvature")])


@query(
    _grad("100.0").replace("f AS (SELECT r, c, v FROM cells LEFT JOIN dem USING (r, c))", "f AS (SELECT r, c, coalesce(v, (SELECT quantile_cont(v, 0.5) FROM dem)) AS v FROM cells LEFT JOIN dem USING (r, c))")
    + "SELECT r, c, round(greatest(0.0, least(1.0, sin(radians(45)) * cos(atan(sqrt(gx * gx + gy * gy))) + cos(radians(45)) * sin(atan(sqrt(gx * gx + gy * gy))) * cos(radians(135) - atan2(-gx, gy)))), 6) + 0.0 AS v FROM s"
)
def hillshade(spark, sf):
    return _v(terrain.hillshade(fx.dem(spark, sf), META))


@query(f"WITH {FULL_SQL} SELECT cells.r, cells.c, round(max(dem.v), 9) + 0.0 AS v FROM cells LEFT JOIN dem ON dem.r BETWEEN cells.r - 2 AND cells.r + 2 AND dem.c BETWEEN cells.c - 2 AND cells.c + 2 GROUP BY 1, 2")
def max_filter(spark, sf):
    return _v(terrain.max_filter(fx.dem(spark, sf), META, 5), 9)


@query(f"WITH {DEPOSIT_CELLS_SQL}, {CELLS_SQL} SELECT DISTINCT cells.r, cells.c FROM cells JOIN dc ON abs(cells.r - dc.r) + abs(cells.c - dc.c) <= 3")
def binary_dilation(spark, sf):
    return terrain.dilate(fx.deposits(spark, sf), META, 3)


# Coordinates


@query("SELECT o_orderkey, CAST(trunc((4000000 - o_totalprice / 50 - 4000000.0) / -100.0) AS INTEGER) AS r, CAST(trunc((500000 + o_custkey * 0.7 - 500000.0) / 100.0) AS INTEGER) AS c FROM orders")
def world_to_pixel(spark, sf):
    r, c = grid.world_to_pixel(META, 500_000 + F.col("o_custkey") * 0.7, 4_000_000 - F.col("o_totalprice") / 50)
    return fx.table(spark, sf, "orders").select("o_orderkey", r.alias("r"), c.alias("c"))


@query(f"WITH {DEM_SQL} SELECT r, c, CAST(500000 + (c + 0.5) * 100 AS DOUBLE) AS x, CAST(4000000 - (r + 0.5) * 100 AS DOUBLE) AS y FROM dem")
def pixel_to_world(spark, sf):
    x, y = grid.pixel_to_world(META, F.col("r"), F.col("c"))
    return fx.dem(spark, sf).select("r", "c", x.alias("x"), y.alias("y"))


def _utm_sql(x: str, y: str) -> str:
    """Krueger's series back from UTM zone 12 N, written out for the ellipsoid's third flattening n."""
    n = 1 / 298.257223563 / (2 - 1 / 298.257223563)
    k = f"(0.9996 * 6378137.0 / (1 + {n!r}) * (1 + {n!r}::DOUBLE ** 2 / 4 + {n!r}::DOUBLE ** 4 / 64))"
    b = [n / 2 - 2 * n * n / 3 + 37 * n**3 / 96, n * n / 48 + n**3 / 15, 17 * n**3 / 480]
    d = [2 * n - 2 * n * n / 3 - 2 * n**3, 7 * n * n / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    a_ = "xi" + "".join(f" - {v!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, v in enumerate(b, 1))
    b_ = "eta" + "".join(f" - {v!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, v in enumerate(b, 1))
    lat = "chi" + "".join(f" + {v!r} * sin({2 * j} * chi)" for j, v in enumerate(d, 1))
    return f"u1 AS (SELECT *, {y} / {k} AS xi, ({x} - 500000) / {k} AS eta FROM cells), u2 AS (SELECT *, {a_} AS a, {b_} AS b FROM u1), u3 AS (SELECT *, asin(sin(a) / cosh(b)) AS chi FROM u2), u4 AS (SELECT r, c, -111 + degrees(atan2(sinh(b), cos(a))) AS lon, degrees({lat}) AS lat FROM u3) "


@query(f"WITH {CELLS_SQL}, {_utm_sql('(500000 + (c + 0.5) * 100)::DOUBLE', '(4000000 - (r + 0.5) * 100)::DOUBLE')}, {grid_sql()} SELECT r, c, round(lon, 6) + 0.0 AS lon, round(lat, 6) + 0.0 AS lat FROM u4 JOIN g USING (r, c)")
def utm_to_wgs84(spark, sf):
    x, y = grid.pixel_to_world(META, F.col("r"), F.col("c"))
    lon, lat = crs.to_wgs84(x, y, 32612)
    return fx.grid(spark, sf).select("r", "c", r6(lon).alias("lon"), r6(lat).alias("lat"))


@query("SELECT o_orderkey, CASE WHEN u BETWEEN -0.02 AND 1.02 THEN round(greatest(0.0, least(1.0, u)), 9) + 0.0 END AS u FROM (SELECT o_orderkey, o_totalprice / 400000.0::DOUBLE AS u FROM orders)")
def fractional_position(spark, sf):
    u = F.col("o_totalprice") / 400_000.0
    return fx.table(spark, sf, "orders").select("o_orderkey", F.when(u.between(-0.02, 1.02), r6(scalar.clip(u), 9)).alias("u"))


# Deposits

# Commodity names given to parts in turn.
_NAMES = ["copper", "gold, copper", "Porphyry Copper", "mercury", "ree", "rare earth, monazite", "skarn, copper, occurrence", "chalcopyrite, vein", "iron", "carbonatite, REE", "silver, cu", "phosphate, thorium"]
_NAMED = f"p AS (SELECT p_partkey, [{', '.join(repr(x) for x in _NAMES)}][CAST(p_partkey % 12 AS INTEGER) + 1] AS commod FROM part), q AS (SELECT *, lower(commod) AS b, string_split(lower(commod), ', ') AS t FROM p)"


def _named(spark, sf) -> DataFrame:
    commod = F.get(F.array(*[F.lit(x) for x in _NAMES]), (F.col("p_partkey") % 12).cast("int"))
    return fx.table(spark, sf, "part").select("p_partkey", commod.alias("commod"))


@query(f"WITH {_NAMED} SELECT p_partkey, contains(b, 'cu') OR contains(b, 'copper') AS copper, regexp_matches(b, 'ree|rare earth|rare-earth|lanthanum|cerium|neodymium|yttrium|monazite|bastnaesite|bastnasite') AS ree FROM q")
def commodity_filter(spark, sf):
    return _named(spark, sf).select("p_partkey", dep.is_commodity(F.col("commod"), "copper").alias("copper"), dep.is_commodity(F.col("commod"), "ree").alias("ree"))


@query(f"WITH {DEPOSITS_SQL}, x AS (SELECT *, CASE lower(trim(status)) WHEN '1-urgent' THEN 4 WHEN '2-high' THEN 3 WHEN '3-medium' THEN 2 ELSE 1 END AS rank FROM dep) SELECT ord, rank FROM x WHERE rank >= 2")
def status_rank_filter(spark, sf):
    ranks = {"1-urgent": 4, "2-high": 3, "3-medium": 2}
    return fx.deposits(spark, sf).select("ord", dep.status_rank(F.col("status"), ranks).alias("rank")).filter("rank >= 2")


@query(f"WITH {DEM_SQL}, {DEPOSITS_SQL} SELECT dep.r, dep.c, ord, round(dem.v, 9) + 0.0 AS v FROM dep JOIN dem USING (r, c) WHERE dep.r BETWEEN 10 AND 40 AND dep.c BETWEEN 5 AND 30")
def aoi_filter(spark, sf):
    d = fx.deposits(spark, sf).filter(F.col("r").between(10, 40) & F.col("c").between(5, 30)).select("r", "c", "ord")
    return fx.dem(spark, sf).join(d, ["r", "c"]).select("r", "c", "ord", r6("v", 9).alias("v"))


_IF = lambda test, w: f"CASE WHEN {test} THEN {w}::DOUBLE ELSE 0 END"
_COPPER = " + ".join([_IF("list_has_any(t, ['copper', 'cu'])", 3), _IF("contains(b, 'porphyry')", 4), _IF("regexp_matches(b, 'chalcopyrite|bornite|molybdenite|potassic|phyllic|argillic')", 1.5), _IF("list_has_any(t, ['molybdenum', 'gold', 'silver'])", 0.75), _IF("contains(b, 'skarn') OR contains(b, 'vein')", -1), _IF("contains(b, 'occurrence')", -0.5)])
_REE = " + ".join([_IF("list_contains(t, 'ree') OR contains(b, 'rare earth')", 4), _IF("regexp_matches(b, 'monazite|bastnaesite|xenotime|allanite|parisite|synchysite|eudialyte|loparite|apatite|pyrochlore')", 2.5), _IF("regexp_matches(b, 'carbonatite|alkaline|peralkaline|fenite|fenit|alkalic')", 2), _IF("list_has_any(t, ['thorium', 'niobium (columbium)', 'niobium', 'tantalum', 'uranium'])", 0.8), _IF("list_contains(t, 'phosphorus-phosphates') OR contains(b, 'phosphate') OR contains(b, 'apatite')", 0.8), _IF("contains(b, 'occurrence')", -0.5)])


@query(f"WITH {_NAMED} SELECT p_partkey, round({_COPPER}, 6) AS copper, round({_REE}, 6) AS ree FROM q")
def deposit_score(spark, sf):
    blob = F.lower("commod")
    tokens = F.split(blob, ", ")
    return _named(spark, sf).select("p_partkey", F.round(dep.score(blob, tokens, "copper"), 6).alias("copper"), F.round(dep.score(blob, tokens, "ree"), 6).alias("ree"))


@query(f"WITH {DEPOSITS_SQL}, x AS (SELECT *, CASE WHEN status LIKE '1%' THEN 4 WHEN status LIKE '2%' THEN 3 ELSE 1 END AS rank FROM dep) SELECT r, c, ord, rank FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY rank DESC, ord) AS n FROM x) WHERE n = 1")
def pixel_dedupe(spark, sf):
    rank = F.expr("CASE WHEN status LIKE '1%' THEN 4 WHEN status LIKE '2%' THEN 3 ELSE 1 END")
    return dep.dedupe(fx.deposits(spark, sf).withColumn("rank", rank)).select("r", "c", "ord", "rank")


_QUAD = "(CASE WHEN r >= %s THEN 2 ELSE 0 END + CASE WHEN c >= %s THEN 1 ELSE 0 END)"


@query(
    f"WITH {DEPOSITS_SQL}, q AS (SELECT *, {_QUAD % (24, 24)} AS q FROM dep), k AS (SELECT q, count(*) AS n, sum(count(*)) OVER () AS total FROM q GROUP BY q), "
    "p AS (SELECT q AS pq, total >= 10 AND n <= floor(total / 2) AS ok FROM k ORDER BY abs(n - 0.25 * total), q LIMIT 1) SELECT ord, q, ok AND q = pq AS held FROM q, p"
)
def quadrant_holdout(spark, sf):
    return dep.holdout(fx.deposits(spark, sf), N, N).select("ord", "q", "held")


@query(
    f"WITH {DEPOSITS_SQL}, m AS (SELECT quantile_cont(r, 0.5) AS mr, quantile_cont(c, 0.5) AS mc, count(*) AS total FROM dep), q AS (SELECT dep.*, total, {_QUAD % ('mr', 'mc')} AS q FROM dep, m), "
    "p AS (SELECT q AS pq, total >= 8 AND count(*) >= greatest(2, floor(0.15 * total)) AS ok FROM q GROUP BY q, total ORDER BY count(*) DESC, q LIMIT 1) SELECT ord, q, ok AND q = pq AS held FROM q, p"
)
def median_holdout(spark, sf):
    return dep.holdout_median(fx.deposits(spark, sf)).select("ord", "q", "held")


@query(f"WITH {DEPOSITS_SQL}, {DEM_SQL} SELECT 1 AS label, dep.r, dep.c FROM dep JOIN dem USING (r, c) UNION ALL SELECT 0, r, c FROM dem")
def samples_union(spark, sf):
    d = fx.dem(spark, sf)
    pos = d.join(fx.deposits(spark, sf).select("r", "c"), ["r", "c"]).select(F.lit(1).alias("label"), "r", "c")
    return pos.unionByName(d.select(F.lit(0).alias("label"), "r", "c"))


# Distances and interpolation

_DIST = f"WITH {DEM_SQL}, {CELLS_SQL}, {DEPOSIT_CELLS_SQL}, d AS (SELECT cells.r, cells.c, sqrt(min((cells.r - dc.r) * 100.0::DOUBLE * (cells.r - dc.r) * 100 + (cells.c - dc.c) * 100.0::DOUBLE * (cells.c - dc.c) * 100)) AS d FROM cells, dc GROUP BY 1, 2) "


@query(_DIST + "SELECT r, c, round(d, 6) + 0.0 AS d FROM d")
def distance_transform(spark, sf):
    return spatial.distance(fx.deposits(spark, sf), META).select("r", "c", r6("d").alias("d"))


@query(_DIST + "SELECT r, c, round(greatest(0.0, least(1.0, 1 - d / 1000)), 6) + 0.0 AS v FROM d")
def proximity_linear(spark, sf):
    return _v(spatial.distance(fx.deposits(spark, sf), META).withColumn("v", spatial.proximity_linear(F.col("d"), 1000.0)))


@query(_DIST + "SELECT r, c, round(exp(-d / 2500), 6) + 0.0 AS v FROM d")
def proximity_exp(spark, sf):
    return _v(spatial.distance(fx.deposits(spark, sf), META).withColumn("v", spatial.proximity_exp(F.col("d"))))


@query(_DIST + "SELECT r, c, round(v, 9) + 0.0 AS v FROM dem JOIN d USING (r, c) WHERE d >= 300")
def buffer_antijoin(spark, sf):
    return _v(spatial.outside(fx.dem(spark, sf), fx.deposits(spark, sf), META, 300.0), 9)


@query(f"WITH {CELLS_SQL}, {DEPOSIT_CELLS_SQL}, w AS (SELECT cells.r, cells.c, cents / 100.0::DOUBLE AS v, n, 1 / greatest(((cells.r - dc.r) * 100.0::DOUBLE) ** 2 + ((cells.c - dc.c) * 100.0::DOUBLE) ** 2, 1.0) AS w FROM cells, dc) SELECT r, c, round(sum(w * v) / sum(w * n), 4) + 0.0 AS v FROM w GROUP BY 1, 2")
def idw(spark, sf):
    return _v(spatial.idw_grid(fx.deposits(spark, sf), META), 4)


_NEAR = f"WITH {DEM_SQL}, {DEPOSIT_CELLS_SQL}, b AS (SELECT * FROM (SELECT dem.r, dem.c, dc.ord, sqrt(((dem.r - dc.r) * 100.0::DOUBLE) ** 2 + ((dem.c - dc.c) * 100.0::DOUBLE) ** 2) AS d FROM dem, dc) QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY d, ord) = 1) "


@query(_NEAR + "SELECT b.r, b.c, name, round(d / 1000, 2) AS km FROM b JOIN dep USING (ord)")
def nearest_deposit(spark, sf):
    out = fx.dem(spark, sf).select("r", "c").join(spatial.nearest_on_grid(fx.deposits(spark, sf).select("r", "c", "ord", "name"), META), ["r", "c"])
    return out.select("r", "c", F.col("p_name").alias("name"), F.round(F.col("dist") / 1000, 2).alias("km"))


@query(_NEAR + "SELECT b.r, b.c, round(dep.v, 4) AS v FROM b JOIN dep USING (ord)")
def nearest_value(spark, sf):
    out = fx.dem(spark, sf).select("r", "c").join(spatial.nearest_on_grid(fx.deposits(spark, sf).select("r", "c", "ord", "v"), META), ["r", "c"])
    return out.select("r", "c", F.round("p_v", 4).alias("v"))


_RING = [(500_450.0, 3_999_350.0), (503_950.0, 3_998_850.0), (503_050.0, 3_996_250.0), (501_250.0, 3_997_450.0)]
_CROSS = " + ".join(f"CAST((({b[1]} > y) <> ({a[1]} > y)) AND x < ({b[0]} - {a[0]})::DOUBLE * (y - {a[1]}) / ({b[1]} - {a[1]})::DOUBLE + {a[0]} AS INTEGER)" for a, b in zip(_RING, _RING[1:] + _RING[:1], strict=True))


@query(f"WITH {grid_sql()}, p AS (SELECT r, c, v, CAST(500000 + (c + 0.5) * 100 AS DOUBLE) AS x, CAST(4000000 - (r + 0.5) * 100 AS DOUBLE) AS y FROM g) SELECT r, c, round(v, 9) + 0.0 AS v FROM p WHERE ({_CROSS}) % 2 = 1")
def polygon_burn(spark, sf):
    """The grid's cells in a polygon, with their values."""
    x, y = grid.pixel_to_world(META, F.col("r"), F.col("c"))
    return _v(fx.grid(spark, sf).filter(spatial.inside_ring(x, y, _RING)), 9)


# Sampling

_TB = f"WITH {_grad('100.0')[5:]}, t AS (SELECT s.r, s.c, s.v AS elevation, sqrt(gx * gx + gy * gy) AS slope, CASE WHEN (s.r * 13 + s.c * 7) % 10 = 0 THEN 1 ELSE 0 END AS positive FROM s WHERE s.v IS NOT NULL AND gx IS NOT NULL AND gy IS NOT NULL), " "e AS (SELECT list_sort(list_distinct(quantile_cont(elevation, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]))) AS ee, list_sort(list_distinct(quantile_cont(slope, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]))) AS es FROM t WHERE positive = 0), " "b AS (SELECT r, c, positive, CAST(len(list_filter(ee, lambda x: x <= elevation)) * (len(es) + 1) + len(list_filter(es, lambda x: x <= slope)) AS INTEGER) AS bin FROM t, e) "


def _terrain(spark, sf) -> DataFrame:
    d = fx.dem(spark, sf)
    t = d.withColumnRenamed("v", "elevation").join(terrain.slope(d, META).withColumnRenamed("v", "slope"), ["r", "c"])
    return t.filter("elevation IS NOT NULL AND slope IS NOT NULL").withColumn("positive", F.expr("CASE WHEN (r * 13 + c * 7) % 10 = 0 THEN 1 ELSE 0 END"))


@query(f"WITH {DEM_SQL} SELECT CAST(i AS INTEGER) AS i, round(q[i], 6) + 0.0 AS edge FROM (SELECT list_sort(list_distinct(quantile_cont(v, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]))) AS q FROM dem), range(1, 8) t(i)")
def quantile_edges(spark, sf):
    e = sampling.edges(fx.dem(spark, sf), "v")
    return spark.createDataFrame(list(enumerate(e, 1)), "i int, edge double").select("i", r6("edge").alias("edge"))


@query(_TB + "SELECT r, c, bin FROM b")
def terrain_bins(spark, sf):
    return sampling.terrain_bins(_terrain(spark, sf)).select("r", "c", F.col("bin").cast("int").alias("bin"))


@query(
    _TB + ", k AS (SELECT bin, sum(positive)::DOUBLE AS n_pos, sum(1 - positive)::DOUBLE AS n_cand FROM b GROUP BY bin), a AS (SELECT *, CASE WHEN n_cand > 0 THEN (n_pos / sum(n_pos) OVER ()) / (n_cand / sum(n_cand) OVER ()) ELSE 0 END AS ratio FROM k) "
    "SELECT bin, n_pos, n_cand, round(0.999 * ratio / sum(ratio * n_cand) OVER () + 0.001 / sum(n_cand) OVER (), 9) AS weight FROM a"
)
def terrain_weights(spark, sf):
    w = sampling.terrain_weights(sampling.terrain_bins(_terrain(spark, sf)))
    return w.select(F.col("bin").cast("int").alias("bin"), "n_pos", "n_cand", F.round("weight", 9).alias("weight"))


_WEIGHTS = "k AS (SELECT bin, sum(positive)::DOUBLE AS n_pos, sum(1 - positive)::DOUBLE AS n_cand FROM b GROUP BY bin), a AS (SELECT *, CASE WHEN n_cand > 0 THEN (n_pos / sum(n_pos) OVER ()) / (n_cand / sum(n_cand) OVER ()) ELSE 0 END AS ratio FROM k), wt AS (SELECT bin, 0.999 * ratio / sum(ratio * n_cand) OVER () + 0.001 / sum(n_cand) OVER () AS weight FROM a)"
_DRAW = "(('0x' || substr(md5(concat_ws('|', 42, r, c)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"


@query(_TB + f", {_WEIGHTS} SELECT r, c FROM b JOIN wt USING (bin) WHERE positive = 0 ORDER BY -ln({_DRAW}) / weight, r, c LIMIT 200")
def weighted_background(spark, sf):
    binned = sampling.terrain_bins(_terrain(spark, sf))
    w = sampling.terrain_weights(binned)
    pool = binned.filter("positive = 0").join(F.broadcast(w.select("bin", "weight")), "bin")
    return sampling.weighted_sample(pool, 200).select("r", "c")


@query(f"WITH {DEM_SQL} SELECT r, c, CAST(least(floor(r / 48.0 * 4), 3) * 4 + least(floor(c / 48.0 * 4), 3) AS INTEGER) AS block FROM dem")
def block_tiles(spark, sf):
    return fx.dem(spark, sf).select("r", "c", sampling.tile(F.col("r"), F.col("c"), N, N).cast("int").alias("block"))


@query(f"WITH {grid_sql()}, t AS (SELECT r, c, CAST(least(floor(r / 48.0 * 4), 3) * 4 + least(floor(c / 48.0 * 4), 3) AS INTEGER) AS block FROM g), o AS (SELECT block, CAST((row_number() OVER (ORDER BY md5(concat_ws('|', 42, block)), block) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT block FROM t)) SELECT r, c, block, fold FROM t JOIN o USING (block)")
def block_folds(spark, sf):
    return sampling.folds(fx.grid(spark, sf), N, N).select("r", "c", "block", F.col("fold").cast("int").alias("fold"))


# Metrics


@query(f"WITH {SCORES_SQL}, k AS (SELECT score, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM sc GROUP BY score), s AS (SELECT p, n, p * (coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) AS u FROM k) SELECT round(sum(u) / (sum(p) * sum(n)), 9) AS auc FROM s")
def roc_auc(spark, sf):
    return metrics.roc_auc(fx.scores(spark, sf)).select(F.round("auc", 9).alias("auc"))


@query(f"WITH {SCORES_SQL}, k AS (SELECT score, sum(label)::DOUBLE AS p, count(*)::DOUBLE AS n FROM sc GROUP BY score), s AS (SELECT p, sum(p) OVER w / sum(n) OVER w AS q FROM k WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(p * q) / sum(p), 9) AS ap FROM s")
def average_precision(spark, sf):
    return metrics.average_precision(fx.scores(spark, sf)).select(F.round("ap", 9).alias("ap"))


@query(f"WITH {SCORES_SQL} SELECT count(*) AS n, round(avg(least(score * 4, 1)), 9) AS mean, round(quantile_cont(least(score * 4, 1), 0.5), 9) AS median, round(quantile_cont(least(score * 4, 1), 0.75), 9) AS p75, round(avg(CAST(least(score * 4, 1) >= 0.5 AS INTEGER)), 9) AS hit_050, round(avg(CAST(least(score * 4, 1) >= 0.7 AS INTEGER)), 9) AS hit_070 FROM sc WHERE label = 1")
def holdout_stats(spark, sf):
    p = fx.scores(spark, sf).filter("label = 1").select(F.least(F.col("score") * 4, F.lit(1.0)).alias("p"))
    out = metrics.holdout_stats(p)
    return out.select("n", *[F.round(x, 9).alias(x) for x in ("mean", "median", "p75", "hit_050", "hit_070")])


@query(
    f"WITH {SCORES_SQL}, p AS (SELECT label, CASE WHEN score > 0.05 THEN 1 ELSE 0 END AS pred FROM sc), k AS (SELECT unnest([0, 1]) AS class), s AS (SELECT class, count(*) FILTER (WHERE label = class AND pred = class)::DOUBLE AS tp, count(*) FILTER (WHERE label = class) AS support, count(*) FILTER (WHERE pred = class) AS said FROM k, p GROUP BY class), "
    "m AS (SELECT class, coalesce(tp / nullif(said, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r, support FROM s) SELECT CAST(class AS INTEGER) AS class, round(p, 9) AS precision, round(r, 9) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1, support FROM m"
)
def classification_report(spark, sf):
    p = fx.scores(spark, sf).select("label", F.when(F.col("score") > 0.05, 1).otherwise(0).alias("pred"))
    return metrics.classification_report(p).select(F.col("class").cast("int").alias("class"), *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")], F.col("support").cast("long").alias("support"))


@query(f"WITH {SCORES_SQL}, a AS (SELECT doc_id % 5 AS fold, avg(score) AS auc FROM sc GROUP BY 1) SELECT count(auc) AS n_folds, round(avg(auc), 9) AS auc_mean, round(stddev_pop(auc), 9) AS auc_std FROM a")
def cv_summary(spark, sf):
    a = fx.scores(spark, sf).groupBy((F.col("doc_id") % 5).alias("fold")).agg(F.avg("score").alias("auc"))
    return metrics.cv_summary(a).select("n_folds", F.round("auc_mean", 9).alias("auc_mean"), F.round("auc_std", 9).alias("auc_std"))


_VERDICT_IN = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN 0.5 + (o_orderkey % 50) / 100.0 END AS cv, CASE WHEN o_orderkey % 3 <> 0 THEN 0.5 + (o_custkey % 50) / 100.0 END AS m, 0.4 + (o_custkey % 60) / 100.0 AS u, (o_orderkey % 11) / 10.0 AS hit, o_orderkey % 5 <> 0 AS has FROM orders"


@query(
    f"WITH x AS ({_VERDICT_IN}) SELECT o_orderkey, CASE WHEN cv < 0.60 THEN 'NO_SIGNAL' WHEN has AND coalesce(m, u) >= 0.70 AND hit >= 0.50 AND coalesce(cv, 0) >= 0.70 THEN 'VALIDATED' WHEN has AND coalesce(cv, 0) >= 0.70 THEN 'ARTIFACT' WHEN has OR coalesce(cv, 0) >= 0.70 THEN 'WEAK' ELSE 'NO_SIGNAL' END AS verdict, coalesce(u - m > 0.15, false) AS artifact FROM x"
)
def verdict(spark, sf):
    fx.table(spark, sf, "orders").createOrReplaceTempView("lodestrata_orders")
    x = spark.sql(_VERDICT_IN.replace("FROM orders", "FROM lodestrata_orders"))
    return x.select("o_orderkey", metrics.verdict(F.col("cv"), F.col("m"), F.col("u"), F.col("hit"), F.col("has")).alias("verdict"), metrics.artifact_note(F.col("m"), F.col("u")).alias("artifact"))


# Scalars


@query(f"WITH {FULL_SQL}, p AS (SELECT r, c, v / 100 AS p FROM f) SELECT r, c, CASE WHEN p >= 0.7 THEN 2 WHEN p >= 0.5 THEN 1 WHEN p IS NOT NULL THEN 0 END AS class, CASE WHEN p > 0.7 THEN 'HIGH' WHEN p > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM p")
def prospectivity_classes(spark, sf):
    p = F.col("v") / 100
    return grid.densify(fx.dem(spark, sf), META).select("r", "c", scalar.prospectivity_class(p).alias("class"), scalar.probability_label(p).alias("label"))


_AB = f"WITH {grid_sql()}, {grid_sql('a', flag='A')}, {grid_sql('n', flag='R')}, x AS (SELECT g.r, g.c, a.v AS s, CASE WHEN (g.r + g.c) % 5 <> 0 THEN n.v END AS e FROM g LEFT JOIN a USING (r, c) LEFT JOIN n USING (r, c)) "


@query(_AB + "SELECT r, c, CASE WHEN abs(s - e) / greatest((s + e) / 2, 1e-6) <= 0.35 THEN 'corroborated' WHEN s IS NOT NULL AND e IS NOT NULL THEN 'discrepant' WHEN s IS NOT NULL OR e IS NOT NULL THEN 'single-method' END AS status FROM x")
def depth_status(spark, sf):
    x = grid.stack(fx.grid(spark, sf), {"s": fx.grid(spark, sf, flag="A"), "e": fx.grid(spark, sf, flag="R").withColumn("v", F.expr("CASE WHEN (r + c) % 5 <> 0 THEN v END"))})
    return x.select("r", "c", scalar.depth_status(F.col("s"), F.col("e")).alias("status"))


@query("SELECT o_orderkey, name, grade FROM orders JOIN (VALUES (0, 'P10', 0.225::DOUBLE), (1, 'P25', 0.309), (2, 'P50', 0.44), (3, 'P75', 0.625), (4, 'P90', 0.859)) t(i, name, grade) ON o_orderkey % 5 = i")
def grade_percentiles(spark, sf):
    """The grade of every order's percentile, one of five."""
    p = F.get(F.array(*[F.lit(x) for x in (10, 25, 50, 75, 90)]), (F.col("o_orderkey") % 5).cast("int"))
    rows = fx.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("P"), p.cast("string")).alias("name"), (p / 100).alias("p"))
    return rows.select("o_orderkey", "name", F.round(scalar.grade_at(F.col("p")), 3).alias("grade"))


_LAYERS = f"WITH {grid_sql()}, {grid_sql('a', flag='A')}, {grid_sql('n', flag='R')}, x AS (SELECT g.r, g.c, g.v / 100 AS f, coalesce(a.v / 100, 0) AS m, coalesce(n.v / 100, 0) AS k FROM g LEFT JOIN a USING (r, c) LEFT JOIN n USING (r, c)), "
_LAYERS += "y AS (SELECT *, greatest(0, least(1, 0.65 * f + 0.2 * m + 0.15 * k)) AS st, greatest(0, least(1, 0.7 * k + 0.3 * greatest(f, m, 0))) AS hy, greatest(0, least(1, 0.55 * f + 0.25 * m + 0.20 * k)) AS s2, greatest(0, least(1, 0.60 * greatest(m, k, 0) + 0.25 * f + 0.15 * m)) AS tr FROM x), z AS (SELECT r, c, f, greatest(0, least(1, 0.45 * st + 0.45 * hy + 0.10 * m)) AS cu, greatest(0, least(1, 0.45 * s2 + 0.55 * tr)) AS ree FROM y) "


def _layers(spark, sf) -> DataFrame:
    x = grid.stack(fx.grid(spark, sf), {"a": fx.grid(spark, sf, flag="A"), "n": fx.grid(spark, sf, flag="R")})
    zero = F.lit(0.0)
    x = x.select("r", "c", (F.col("v") / 100).alias("f"), F.coalesce(F.col("a") / 100, zero).alias("m"), F.coalesce(F.col("n") / 100, zero).alias("k"))
    f, m, k = F.col("f"), F.col("m"), F.col("k")
    return x.withColumn("cu", scalar.copper_prior(f, m, k, m, F.greatest(f, m, zero), k)).withColumn("ree", scalar.ree_prior(f, m, k, m, F.greatest(m, k, zero), f))


@query(_LAYERS + "SELECT r, c, round(cu, 6) + 0.0 AS cu, round(ree, 6) + 0.0 AS ree FROM z")
def system_prior(spark, sf):
    return _layers(spark, sf).select("r", "c", r6("cu").alias("cu"), r6("ree").alias("ree"))


@query(_LAYERS + "SELECT r, c, round(greatest(0, least(1, 0.82 * f + 0.18 * cu)), 6) + 0.0 AS v FROM z")
def prior_blend(spark, sf):
    return _layers(spark, sf).select("r", "c", r6(scalar.blend(F.col("f"), F.col("cu"), 0.18)).alias("v"))


def _ppf_sql(p: str) -> str:
    """Acklam's approximation; p lies between its two tails."""
    poly = lambda k, x: " + ".join(f"{v!r} * ({x}) ** {len(k) - 1 - i}" for i, v in enumerate(k))
    q = f"({p} - 0.5)"
    return f"({poly(scalar._A, q + ' * ' + q)}) * {q} / ({poly(scalar._B, q + ' * ' + q)})"


@query(
    f"WITH {grid_sql()}, {grid_sql('a', flag='A')}, x AS (SELECT g.r, g.c, g.v / 100 AS p, coalesce(a.v, 0) AS chem, (SELECT quantile_cont(v, 0.95) FROM a) AS p95 FROM g LEFT JOIN a USING (r, c)), "
    f"m AS (SELECT *, 10 ** (-0.357 + 0.227 * ({_ppf_sql('greatest(0.05, least(0.95, p))')})) AS model FROM x), y AS (SELECT r, c, CASE WHEN p < 0.20 THEN 0 ELSE greatest(0, least(1.5, CASE WHEN chem > 0 THEN 0.7 * model + 0.3 * (0.15 + least(1, chem / p95) * 1.35) ELSE model END)) END AS v FROM m) "
    "SELECT r, c, round(v, 6) + 0.0 AS v, CASE WHEN v >= 1.0 THEN 'high' WHEN v >= 0.5 THEN 'medium' WHEN v >= 0.3 THEN 'low' ELSE 'sub-economic' END AS band FROM y"
)
def reference_grade_map(spark, sf):
    p95 = grid.percentiles(fx.grid(spark, sf, flag="A"), "v", [0.95])[0]
    x = grid.stack(fx.grid(spark, sf), {"a": fx.grid(spark, sf, flag="A")})
    g = scalar.copper_grade_map(F.col("v") / 100, F.coalesce("a", F.lit(0.0)), F.lit(p95))
    return x.select("r", "c", r6(g).alias("v"), scalar.grade_band(g, "copper").alias("band"))


# Feature names given to brands in turn, and the family of each.
_FAMILY = {"slope": "terrain", "curvature": "terrain", "alteration_silica": "alteration", "magnetics": "geophysics", "gravity": "geophysics", "streams": "other"}


@query(
    f"WITH i AS (SELECT [{', '.join(repr(x) for x in _FAMILY.values())}][CAST(p_partkey % 6 AS INTEGER) + 1] AS family, sum(p_retailprice) AS w FROM part GROUP BY 1) SELECT family, round(100 * w / (SELECT sum(w) FROM i), 6) AS pct, CASE WHEN family = 'terrain' THEN 100 * w / (SELECT sum(w) FROM i) > 70 ELSE 100 * w / (SELECT sum(w) FROM i) > 30 END AS dominant FROM i"
)
def importance_shares(spark, sf):
    name = F.get(F.array(*[F.lit(x) for x in _FAMILY]), (F.col("p_partkey") % 6).cast("int"))
    weights = fx.table(spark, sf, "part").groupBy(name.alias("feature")).agg(F.sum("p_retailprice").alias("weight"))
    s = scalar.family_shares(weights, _FAMILY)
    return s.select("family", F.round("pct", 6).alias("pct"), "dominant")


@query("SELECT p_brand, substr(sha256(string_agg(p_name, '|' ORDER BY p_partkey)), 1, 16) AS hash FROM part GROUP BY p_brand")
def feature_hash(spark, sf):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"])
    return fx.table(spark, sf, "part").groupBy("p_brand").agg(listed.alias("names")).select("p_brand", scalar.feature_hash(F.col("names")).alias("hash"))


@query("SELECT o_orderkey, strftime(to_timestamp(1700000000 + o_orderkey * 61) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS started FROM orders")
def epoch_to_minutes(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_orderkey", (1_700_000_000 + F.col("o_orderkey") * 61).alias("at"))
    return o.select("o_orderkey", catalog.started("at").alias("started"))


@query("SELECT event_id, TRY_CAST(nullif(regexp_extract('AUC: ' || CAST(round(value, 3) AS VARCHAR) || ' n=4', 'AUC\\s*[:=]\\s*(-?[0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS auc FROM events")
def report_metric(spark, sf):
    from lodestrata.sources.tables import report_metric as parse

    text = F.concat(F.lit("AUC: "), F.round("value", 3).cast("string"), F.lit(" n=4"))
    return fx.table(spark, sf, "events").select("event_id", parse(text, "AUC").alias("auc"))


# Depth


@query(
    f"WITH {FULL_SQL}, z AS (SELECT r, c, coalesce(v, (SELECT quantile_cont(v, 0.5) FROM f)) AS v FROM f), s AS (SELECT count(*)::DOUBLE AS n, avg(c) AS mx, avg(r) AS my, avg(v) AS mv, var_pop(c) AS xx, var_pop(r) AS yy, covar_pop(c, r) AS xy, covar_pop(c, v) AS xv, covar_pop(r, v) AS yv FROM z), "
    "p AS (SELECT *, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS a, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS b FROM s) SELECT r, c, round(v - mv - a * (c - mx) - b * (r - my), 6) + 0.0 AS v FROM z, p"
)
def plane_detrend(spark, sf):
    return _v(depth.detrend(grid.densify(fx.dem(spark, sf), META)))


_RINGS = f"WITH {grid_sql()}, s AS (SELECT 0 AS win, CAST(floor(sqrt((r - 24) * (r - 24) + (c - 24) * (c - 24)) + 0.5) AS INTEGER) AS ring, exp(8 - 0.2 * sqrt((r - 24) * (r - 24) + (c - 24) * (c - 24)) + v / 1000) AS p FROM g), m AS (SELECT win, ring, avg(p) AS power, count(*) AS n FROM s WHERE ring BETWEEN 1 AND 22 GROUP BY 1, 2 HAVING count(*) >= 3 AND avg(p) > 0) "


def _rings(spark, sf) -> DataFrame:
    s = fx.grid(spark, sf).selectExpr("0 AS win", "CAST(floor(sqrt((r - 24) * (r - 24) + (c - 24) * (c - 24)) + 0.5) AS INT) AS ring", "exp(8 - 0.2 * sqrt((r - 24) * (r - 24) + (c - 24) * (c - 24)) + v / 1000) AS p")
    return depth.ring_means(s, 22)


@query(_RINGS + "SELECT win, ring, round(power, 6) AS power, n FROM m")
def ring_power_mean(spark, sf):
    return _rings(spark, sf).select("win", "ring", F.round("power", 6).alias("power"), "n")


@query(
    _RINGS + ", l AS (SELECT win, ring * 0.01 AS k, ln(power) AS lp, row_number() OVER (PARTITION BY win ORDER BY ring) AS i, count(*) OVER (PARTITION BY win) AS m FROM m), q AS (SELECT win, quantile_cont(lp, 0.5) AS fl FROM l WHERE i > m - greatest(3, floor(m / 4)) GROUP BY win), "
    "b AS (SELECT l.*, lp > fl + 2 AS above, min(CAST(lp > fl + 2 AS INTEGER)) OVER (PARTITION BY win ORDER BY i) = 1 AS pre FROM l JOIN q USING (win) WHERE m >= 6), u AS (SELECT *, sum(CAST(pre AS INTEGER)) OVER (PARTITION BY win) >= 4 AS lng FROM b), "
    "t AS (SELECT win, regr_slope(lp, k) AS s, regr_r2(lp, k) AS r2, count(*) AS n FROM u WHERE CASE WHEN lng THEN pre ELSE above END GROUP BY win) SELECT win, round(CASE WHEN s < 0 THEN -s / 2 END, 6) AS depth, round(r2, 6) AS r2 FROM t WHERE n >= 4"
)
def prefix_fit(spark, sf):
    return depth.ring_fit(_rings(spark, sf), 0.01).select("win", F.round("depth", 6).alias("depth"), F.round("r2", 6).alias("r2"))


_EULER = f"WITH {_grad('100.0')[5:]}, e AS (SELECT r, c, v AS t, gx, gy, v / 500 AS gz FROM s WHERE gx IS NOT NULL AND gy IS NOT NULL AND v IS NOT NULL), w AS (SELECT a.i * 5 AS win_r, b.i * 5 AS win_c FROM range(8) a(i), range(8) b(i)), x AS (SELECT win_r, win_c, gx, gy, gz, t, (c - win_c - 5) * 100.0::DOUBLE * gx + (r - win_r - 5) * 100.0::DOUBLE * gy + 2 * t AS rhs FROM w JOIN e ON r BETWEEN win_r AND win_r + 9 AND c BETWEEN win_c AND win_c + 9) "


@query(_EULER + "SELECT CAST(win_r AS INTEGER) AS win_r, CAST(win_c AS INTEGER) AS win_c, count(*) AS m, round(sum(rhs), 4) + 0.0 AS b, round(sum(gx * gx), 6) AS s_xx, round(sum(gx * gy), 6) + 0.0 AS s_xy, round(sum(gx * gz), 6) + 0.0 AS s_xz, round(sum(gz * 2), 6) AS s_zn, round(sum(gz * rhs), 4) + 0.0 AS b_z FROM x GROUP BY 1, 2")
def euler_normal_sums(spark, sf):
    f = terrain.slopes(fx.dem(spark, sf), META).select("r", "c", F.col("v").alias("t"), "gx", "gy", (F.col("v") / 500).alias("gz")).filter("gx IS NOT NULL AND gy IS NOT NULL AND t IS NOT NULL")
    s = depth.euler_sums(f, META, 10)
    return s.select("win_r", "win_c", "m", r6("b", 4).alias("b"), *[r6(n).alias(n) for n in ("s_xx", "s_xy", "s_xz", "s_zn")], r6("b_z", 4).alias("b_z"))


@query(f"WITH {CELLS_SQL}, {DEPOSITS_SQL}, s AS (SELECT r, c, sum((ord % 9 + 1) * CAST(round(v * 100) AS BIGINT)) AS wv, sum(ord % 9 + 1) AS w FROM dep GROUP BY 1, 2) SELECT cells.r, cells.c, round(sum(wv)::DOUBLE / sum(w), 4) AS v FROM cells JOIN s ON abs(cells.r - s.r) <= 4 AND abs(cells.c - s.c) <= 4 GROUP BY 1, 2")
def weighted_box_depth(spark, sf):
    s = fx.deposits(spark, sf).select("r", "c", F.round(F.col("v") * 100).alias("depth"), (F.col("ord") % 9 + 1).cast("double").alias("reliability"))
    return depth.box_depth(s, META, 4).select("r", "c", F.round("v", 4).alias("v"))


def _field(spark, sf, h: float) -> DataFrame:
    """The field of a pole h metres under every deposit; those of one cell add up, so a pole is broadcast once a cell."""
    poles = fx.deposits(spark, sf).groupBy(F.col("r").alias("a"), F.col("c").alias("b")).agg(F.count("*").alias("n"))
    d2 = ((F.col("r") - F.col("a")) ** 2 + (F.col("c") - F.col("b")) ** 2) * 10_000.0
    one = F.col("n") * 1e8 * h / F.pow(d2 + h * h, 1.5)
    return grid.cells(spark, META).crossJoin(F.broadcast(poles)).groupBy("r", "c").agg(F.sum(one).alias("v"))


@query()
def fft_vertical_derivative(spark, sf):
    return _v(depth.vertical_derivative(_field(spark, sf, 400.0), META))


@query()
def spectral_depth_map(spark, sf):
    return depth.spectral_depth(_field(spark, sf, 150.0), META, 24).select("win_r", "win_c", F.round("depth", 4).alias("depth"), F.round("r2", 6).alias("r2"))


@query()
def euler_solutions(spark, sf):
    return depth.euler(_field(spark, sf, 400.0), META).select("size", "win_r", "win_c", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round("depth", 2).alias("depth"), F.round("reliability", 4).alias("reliability"))


# Targets


@query(f"WITH {FULL_SQL}, m AS (SELECT cells.r, cells.c, max(dem.v) AS m FROM cells JOIN dem ON dem.r BETWEEN cells.r - 3 AND cells.r + 3 AND dem.c BETWEEN cells.c - 3 AND cells.c + 3 GROUP BY 1, 2) SELECT r, c, round(v, 9) AS v FROM dem JOIN m USING (r, c) WHERE v = m AND v >= 30")
def target_maxima(spark, sf):
    return _v(targets.maxima(fx.dem(spark, sf), META, 3, 30.0), 9)


@query(
    f"""WITH RECURSIVE {FULL_SQL}, m AS (SELECT cells.r, cells.c, max(dem.v) AS m FROM cells JOIN dem ON dem.r BETWEEN cells.r - 3 AND cells.r + 3 AND dem.c BETWEEN cells.c - 3 AND cells.c + 3 GROUP BY 1, 2),
x AS (SELECT r, c, v, row_number() OVER (ORDER BY v DESC, r DESC, c DESC) AS i FROM dem JOIN m USING (r, c) WHERE v = m AND v >= 30),
k AS (SELECT 1::BIGINT AS i, (SELECT [{{'r': r, 'c': c, 'v': v}}] FROM x WHERE i = 1) AS kept UNION ALL
  SELECT k.i + 1, CASE WHEN len(kept) < 25 AND len(list_filter(kept, lambda t: (t.r - x.r) * (t.r - x.r) + (t.c - x.c) * (t.c - x.c) < 9)) = 0 THEN list_append(kept, {{'r': x.r, 'c': x.c, 'v': x.v}}) ELSE kept END FROM k JOIN x ON x.i = k.i + 1),
l AS (SELECT kept FROM k ORDER BY i DESC LIMIT 1)
SELECT CAST(j AS INTEGER) AS rank, kept[j].r AS r, kept[j].c AS c, round(kept[j].v, 9) AS v FROM l, range(1, 26) t(j) WHERE j <= len(kept)"""
)
def targets_topk(spark, sf):
    return targets.suppress(targets.maxima(fx.dem(spark, sf), META, 3, 30.0), 3).select("rank", "r", "c", F.round("v", 9).alias("v"))


_PCT = f"WITH {grid_sql()}, {grid_sql('a', flag='A')}, w AS (SELECT g.r, g.c, g.v AS f1, a.v AS f2 FROM g LEFT JOIN a USING (r, c)), top AS ({ORACLES['targets_topk']}), t AS (SELECT rank, f1, f2 FROM top JOIN w USING (r, c)) "


@query(
    _PCT + "SELECT CAST(rank AS INTEGER) AS rank, 'f1' AS feature, CAST(round_even(100 * avg(CAST(w.f1 < t.f1 AS INTEGER)), 0) AS INTEGER) AS percentile FROM w, t WHERE w.f1 IS NOT NULL AND t.f1 IS NOT NULL GROUP BY 1 UNION ALL "
    "SELECT CAST(rank AS INTEGER), 'f2', CAST(round_even(100 * avg(CAST(w.f2 < t.f2 AS INTEGER)), 0) AS INTEGER) FROM w, t WHERE w.f2 IS NOT NULL AND t.f2 IS NOT NULL GROUP BY 1"
)
def target_percentile(spark, sf):
    w = grid.stack(fx.grid(spark, sf).withColumnRenamed("v", "f1"), {"f2": fx.grid(spark, sf, flag="A")})
    t = store.stored(targets_topk(spark, sf).select("rank", "r", "c").join(w, ["r", "c"]).select("rank", "f1", "f2"), "targets")
    return targets.percentile_of(w, t, ["f1", "f2"])


# Project store

@query("SELECT run, key, round(value, 6) AS value FROM (SELECT user_id AS run, event_type AS key, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS n FROM events) WHERE n = 1")
def metric_upsert(spark, sf):
    log = fx.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("key"), "value", "ts")
    return catalog.latest(log, ["run", "key"], ["ts"]).select("run", "key", F.round("value", 6).alias("value"))


def _store(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    n, c = fx.table(spark, sf, "nation"), fx.table(spark, sf, "customer")
    key = next(x for x in n.columns if x.endswith("nationkey"))
    name = next(x for x in n.columns if x.endswith("_name"))
    projects = n.select(F.col(key).alias("id"), F.col(name).alias("name"))
    runs = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"), F.lit("done").alias("status"), (F.col("c_custkey") * 60).cast("double").alias("started_at"))
    log = fx.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("key"), "value", "ts")
    return projects, runs, catalog.latest(log, ["run_id", "key"], ["ts"])


_LATEST = "m AS (SELECT run_id, key, value FROM (SELECT user_id AS run_id, event_type AS key, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS n FROM events) WHERE n = 1)"


@query(f"WITH {_LATEST}, k AS (SELECT min(key) AS key FROM m) SELECT c_custkey AS id, n_name AS project, 'done' AS status, CAST(c_custkey * 60 AS DOUBLE) AS started_at, CASE WHEN value IS NULL THEN '' ELSE printf('%.3f', value) END AS metric FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT run_id, value FROM m WHERE key = (SELECT key FROM k)) x ON run_id = c_custkey")
def list_runs(spark, sf):
    projects, runs, m = _store(spark, sf)
    key = m.agg(F.min("key")).first()[0]
    return catalog.list_runs(runs, projects, m, key)


@query(f"WITH {_LATEST} SELECT c_custkey AS id, coalesce(string_agg(key || '=' || printf('%.3f', value), ';' ORDER BY key), '') AS metrics FROM customer LEFT JOIN m ON run_id = c_custkey GROUP BY 1")
def run_summary(spark, sf):
    _, runs, m = _store(spark, sf)
    none = m.limit(0).select("run_id", F.col("key").alias("kind"), F.lit("").alias("path"))
    s = catalog.summary(runs, m, none)
    entries = F.transform(F.array_sort(F.map_entries(F.coalesce("value", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))))), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.3f", e["value"])))
    return s.select("id", F.array_join(entries, ";").alias("metrics"))


# Models


def _samples(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Every cell, and every cell with its label: all of them are trained on."""
    d = fx.grid(spark, sf)
    wide = grid.stack(d.withColumnRenamed("v", "f0"), {"f1": terrain.slope(d, META), "f2": fx.grid(spark, sf, flag="A"), "f3": terrain.tpi(d, META, 7)})
    filled = grid.median_fill(wide, ["f1", "f2", "f3"])
    return filled, filled.withColumn("label", F.expr("CASE WHEN f0 + f3 > 50 THEN 1 ELSE 0 END"))


FEATURES = ["f0", "f1", "f2", "f3"]


@query()
def rf_probability(spark, sf):
    from lodestrata.operators import model

    cells, samples = _samples(spark, sf)
    return model.train(samples, FEATURES, trees=10, folds=2).predict(cells).select("r", "c", F.round("probability", 6).alias("probability"))


@query()
def rf_uncertainty(spark, sf):
    from lodestrata.operators import model

    cells, samples = _samples(spark, sf)
    return model.train(samples, FEATURES, trees=20, folds=0).uncertainty(cells).select("r", "c", F.round("uncertainty", 6).alias("uncertainty"))


@query()
def spatial_cv(spark, sf):
    from lodestrata.operators import model

    return model.spatial_cv(_samples(spark, sf)[1], FEATURES, N, N, trees=10)


@query()
def pipeline_targets(spark, sf):
    """The whole prospectivity pipeline over the fixture grid, with deposits where the field is high: by its own spread, as a
    cell's average varies the less the more lineitems it has."""
    from lodestrata.plans import pipeline

    d = fx.grid(spark, sf)
    above = terrain.tpi(d, META, 7)
    spread = above.agg(F.stddev("v")).first()[0]
    spots = above.filter(F.col("v") > 0.6 * F.lit(spread).cast("double")).select("r", "c", (F.col("r") * N + F.col("c")).cast("long").alias("ord"), F.concat(F.lit("d"), F.col("r")).alias("name"), F.lit(1).alias("rank"))
    layers = {"a": fx.grid(spark, sf, flag="A"), "magnetics": _field(spark, sf, 400.0)}
    config = pipeline.Config(terrain_scale_m=300.0, trees=5, folds=2, threshold=0.5, separation=3, depth_window=16)
    result = pipeline.run(spark, d, META, spots, layers, store.fresh_path(spark, "prospect"), config, "magnetics")
    return result.targets.select("rank", "r", "c", F.round("probability", 6).alias("probability"), "target_class", "nearest_deposit_km", "depth_status")


# Queries of viewers, screening and shapes register themselves.
from lodestrata.plans import product_queries, projection_queries  # noqa: E402, F401
