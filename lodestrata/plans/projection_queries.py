"""Registered queries of projections, datums and tables of deposits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata import store
from lodestrata.functions import crs
from lodestrata.operators import deposits as dep
from lodestrata.operators import spatial
from lodestrata.plans import fixtures as fx
from lodestrata.plans import viewer
from lodestrata.plans.queries import query, r6
from lodestrata.sources import tables

# A place for every order: longitudes and latitudes about a middle, in hundredths of degrees.
_PLACES = "p AS (SELECT o_orderkey, {lon} + (o_custkey % 2000) / 100.0::DOUBLE AS lon, {lat} + (o_orderkey % 1500) / 100.0::DOUBLE AS lat FROM orders), a AS (SELECT *, radians(lon) AS l, radians(lat) AS f, sin(radians(lat)) AS s FROM p)"


def _places(spark, sf, lon: float, lat: float) -> DataFrame:
    o = fx.table(spark, sf, "orders")
    return o.select("o_orderkey", (lon + (F.col("o_custkey") % 2000) / 100.0).alias("lon"), (lat + (F.col("o_orderkey") % 1500) / 100.0).alias("lat"))


def _forward(spark, sf, lon: float, lat: float, target: str) -> DataFrame:
    x, y = crs.convert(F.col("lon"), F.col("lat"), "EPSG:4326", target)
    return _places(spark, sf, lon, lat).select("o_orderkey", r6(x, 3).alias("x"), r6(y, 3).alias("y"))


# Numbers of an ellipsoid, and the functions of a latitude (or its sine) that the textbooks' formulas are made of.
_GRS = "sqrt(2 / 298.257222101::DOUBLE - 1 / 298.257222101::DOUBLE ** 2)"
_WGS = "sqrt(2 / 298.257223563::DOUBLE - 1 / 298.257223563::DOUBLE ** 2)"
_m = lambda d: f"(cos(radians({d}::DOUBLE)) / sqrt(1 - e * e * sin(radians({d}::DOUBLE)) ** 2))"
_iso = lambda rad: f"(tan(pi() / 4 - ({rad}) / 2) * pow((1 + e * sin({rad})) / (1 - e * sin({rad})), e / 2))"
_auth = lambda s: f"((1 - e * e) * ({s} / (1 - e * e * {s} * {s}) + ln((1 + e * {s}) / (1 - e * {s})) / (2 * e)))"
_deg = lambda d: f"radians({d}::DOUBLE)"


@query(f"""WITH {_PLACES.format(lon=-105, lat=50)}, k0 AS (SELECT {_GRS} AS e), k1 AS (SELECT e, ln({_m(49)} / {_m(77)}) / ln({_iso(_deg(49))} / {_iso(_deg(77))}) AS n FROM k0),
k AS (SELECT *, 6378137.0::DOUBLE * {_m(49)} / n / pow({_iso(_deg(49))}, n) AS big FROM k1),
r AS (SELECT o_orderkey, big * pow({_iso('f')}, n) AS r, big * pow({_iso(_deg(63.390675))}, n) AS r0, n * (l - {_deg(-91.8666666666667)}) AS t FROM a, k)
SELECT o_orderkey, round(6200000 + r * sin(t), 3) + 0.0 AS x, round(3000000 + r0 - r * cos(t), 3) + 0.0 AS y FROM r""")
def lambert_conic(spark, sf):
    """Lambert's conformal cone of Canada, two standard parallels."""
    return _forward(spark, sf, -105.0, 50.0, "EPSG:3347")


@query(f"""WITH {_PLACES.format(lon=-105, lat=30)}, k0 AS (SELECT {_GRS} AS e), k1 AS (SELECT e, ({_m(29.5)} ** 2 - {_m(45.5)} ** 2) / ({_auth('sin(radians(45.5::DOUBLE))')} - {_auth('sin(radians(29.5::DOUBLE))')}) AS n FROM k0),
k AS (SELECT *, {_m(29.5)} ** 2 + n * {_auth('sin(radians(29.5::DOUBLE))')} AS c FROM k1),
r AS (SELECT o_orderkey, 6378137.0::DOUBLE * sqrt(c - n * {_auth('s')}) / n AS r, 6378137.0::DOUBLE * sqrt(c - n * {_auth('sin(radians(23::DOUBLE))')}) / n AS r0, n * (l - {_deg(-96)}) AS t FROM a, k)
SELECT o_orderkey, round(r * sin(t), 3) + 0.0 AS x, round(r0 - r * cos(t), 3) + 0.0 AS y FROM r""")
def albers_equal_area(spark, sf):
    return _forward(spark, sf, -105.0, 30.0, "EPSG:5070")


@query(f"""WITH {_PLACES.format(lon=-60, lat=68)}, k AS (SELECT {_WGS} AS e), r AS (SELECT o_orderkey, 6378137.0::DOUBLE * {_m(70)} * {_iso('f')} / {_iso(_deg(70))} AS r, l + {_deg(45)} AS t FROM a, k)
SELECT o_orderkey, round(r * sin(t), 3) + 0.0 AS x, round(-r * cos(t), 3) + 0.0 AS y FROM r""")
def polar_stereographic(spark, sf):
    return _forward(spark, sf, -60.0, 68.0, "EPSG:3413")


@query(f"WITH {_PLACES.format(lon=-10, lat=40)} SELECT o_orderkey, round(6378137.0::DOUBLE * l, 3) + 0.0 AS x, round(6378137.0::DOUBLE * atanh(s), 3) + 0.0 AS y FROM a")
def web_mercator(spark, sf):
    return _forward(spark, sf, -10.0, 40.0, "EPSG:3857")


_OSGB = 'GEOGCS["OSGB 1936",DATUM["OSGB_1936",SPHEROID["Airy 1830",6377563.396,299.3249646],TOWGS84[446.448,-125.157,542.06,0.15,0.247,0.842,-20.489]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'


@query(f"""WITH {_PLACES.format(lon=-12, lat=46)}, k AS (SELECT 2 / 299.3249646::DOUBLE - 1 / 299.3249646::DOUBLE ** 2 AS q, radians(0.15::DOUBLE / 3600) AS rx, radians(0.247::DOUBLE / 3600) AS ry, radians(0.842::DOUBLE / 3600) AS rz, 1 - 20.489::DOUBLE / 1000000 AS m),
g AS (SELECT o_orderkey, k.*, 6377563.396::DOUBLE / sqrt(1 - q * s * s) AS v, l, f, s FROM a, k),
c AS (SELECT *, v * cos(f) * cos(l) AS x, v * cos(f) * sin(l) AS y, v * (1 - q) * s AS z FROM g),
t AS (SELECT o_orderkey, 446.448 + m * (x - rz * y + ry * z) AS x, -125.157 + m * (rz * x + y - rx * z) AS y, 542.06 + m * (-ry * x + rx * y + z) AS z FROM c),
w AS (SELECT *, 2 / 298.257223563::DOUBLE - 1 / 298.257223563::DOUBLE ** 2 AS q, sqrt(x * x + y * y) AS p FROM t),
-- The latitude by three rounds of the plain iteration.
i1 AS (SELECT *, atan2(z, p * (1 - q)) AS f1 FROM w), i2 AS (SELECT *, atan2(z + q * 6378137.0::DOUBLE / sqrt(1 - q * sin(f1) ** 2) * sin(f1), p) AS f2 FROM i1),
i3 AS (SELECT *, atan2(z + q * 6378137.0::DOUBLE / sqrt(1 - q * sin(f2) ** 2) * sin(f2), p) AS f3 FROM i2), i4 AS (SELECT *, atan2(z + q * 6378137.0::DOUBLE / sqrt(1 - q * sin(f3) ** 2) * sin(f3), p) AS f4 FROM i3)
SELECT o_orderkey, round(degrees(atan2(y, x)), 7) + 0.0 AS lon, round(degrees(f4), 7) + 0.0 AS lat FROM i4""")
def datum_shift(spark, sf):
    """Longitudes and latitudes of an older datum on WGS84, by its seven parameters."""
    lon, lat = crs.convert(F.col("lon"), F.col("lat"), _OSGB, "EPSG:4326")
    return _places(spark, sf, -12.0, 46.0).select("o_orderkey", r6(lon, 7).alias("lon"), r6(lat, 7).alias("lat"))


# Tables of deposits as text, with quotes, commas and line breaks in their fields


@query("""WITH d AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p, CASE o_orderkey % 4 WHEN 0 THEN 'Past Producer' WHEN 1 THEN 'Prospect' WHEN 2 THEN 'mine' ELSE '' END AS s FROM orders)
SELECT 'The "Big" one, no. ' || k || CASE WHEN k % 3 = 0 THEN chr(10) || 'second line' ELSE '' END AS name, round((c % 360)::DOUBLE - 180, 6) + 0.0 AS x, round((k % 180)::DOUBLE - 90, 6) + 0.0 AS y,
CASE WHEN k % 5 < 2 THEN true ELSE false END AS copper, CASE lower(s) WHEN 'past producer' THEN 4 WHEN 'mine' THEN 3 WHEN 'prospect' THEN 2 ELSE 1 END AS rank FROM d WHERE k % 7 <> 0""")
def deposit_table(spark, sf):
    """Every order as a line of a deposit table: written as text, read back by the loader. Places that are no numbers go."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit('The "Big" one, no. '), k.cast("string"), F.when(k % 3 == 0, "\nsecond line").otherwise(""))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    status = F.when(k % 4 == 0, "Past Producer").when(k % 4 == 1, "Prospect").when(k % 4 == 2, "mine").otherwise("")
    commodity = F.when(k % 5 == 0, "gold, COPPER").when(k % 5 == 1, "Cu").otherwise("iron")
    lon = F.when(k % 7 == 0, "n/a").otherwise((F.col("o_custkey") % 360 - 180).cast("string"))
    line = F.concat_ws(",", quoted(name), lon, (k % 180 - 90).cast("string"), quoted(commodity), status)
    path = store.fresh_path(spark, "deposit-table")
    # The header is the first line of every file: a file for each partition.
    rows = fx.table(spark, sf, "orders").select(F.spark_partition_id().alias("part"), F.lit(1).alias("place"), line.alias("value"))
    head = rows.select("part").distinct().select("part", F.lit(0).alias("place"), F.lit(" Site_Name,Longitude,LATITUDE,Code_List,Dev_Status").alias("value"))
    rows.unionByName(head).repartition(8, "part").sortWithinPartitions("part", "place").drop("place").write.partitionBy("part").text(path)
    out = tables.csv_deposits(spark, f"{path}/*")
    return out.select("name", r6("x").alias("x"), r6("y").alias("y"), dep.is_commodity(F.col("commodity"), "copper").alias("copper"), dep.status_rank(F.col("status")).alias("rank"))


@query("""WITH d AS (SELECT o_orderkey AS k, o_custkey % 5200 + 499800.0071::DOUBLE AS x, 4000050.0123::DOUBLE - o_orderkey % 5100 AS y FROM orders), f AS (SELECT k, (x - 500000) / 4800.0::DOUBLE AS u, (4000000 - y) / 4800.0::DOUBLE AS v FROM d WHERE k % 6 <> 0)
SELECT CASE WHEN k % 4 = 0 THEN 'deposit' ELSE 'site ' || k END AS name, round(greatest(0.0, least(1.0, u)), 5) + 0.0 AS u, round(greatest(0.0, least(1.0, v)), 5) + 0.0 AS v FROM f WHERE u BETWEEN -0.02 AND 1.02 AND v BETWEEN -0.02 AND 1.02""")
def viewer_deposits(spark, sf):
    """Every order as a line of a deposit table, read for a viewer: places on the map, its border and outside."""
    k = F.col("o_orderkey")
    x = F.when(k % 6 == 0, "?").otherwise((F.col("o_custkey") % 5200 + 499_800.0071).cast("string"))
    rows = fx.table(spark, sf, "orders").select(F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("site "), k.cast("string"))).alias("name"), x.alias("east"), (4_000_050.0123 - k % 5100).cast("string").alias("north"))
    path = store.fresh_path(spark, "viewer-deposits")
    rows.write.option("header", True).csv(path)
    return viewer.run_deposits(spark, path, fx.META, None).select("name", r6("u", 5).alias("u"), r6("v", 5).alias("v"))


# Nearest places off the grid

_CLICKS = "q AS (SELECT o_orderkey, (o_orderkey * 7919 + o_custkey) % 10007 AS r, (o_custkey * 104729 + o_orderkey) % 9973 AS c FROM orders), t AS (SELECT c_custkey AS ord, (c_custkey * 6113) % 10007 AS r, (c_custkey * c_custkey) % 9973 AS c FROM customer)"


@query(f"""WITH {_CLICKS}, d AS (SELECT o_orderkey, ord, sqrt(((q.r - t.r) * 30.0::DOUBLE) ** 2 + ((q.c - t.c) * 20.0::DOUBLE) ** 2) AS d FROM q, t)
SELECT o_orderkey, min(ord) AS target, round(dist, 6) AS dist FROM (SELECT o_orderkey, min(d) AS dist FROM d GROUP BY 1) JOIN d USING (o_orderkey) WHERE d = dist GROUP BY 1, dist""")
def nearest_targets(spark, sf):
    """Every order as a click, against every customer as a target."""
    o, t = fx.table(spark, sf, "orders"), fx.table(spark, sf, "customer")
    clicks = o.select("o_orderkey", ((F.col("o_orderkey") * 7919 + F.col("o_custkey")) % 10007).alias("r"), ((F.col("o_custkey") * 104729 + F.col("o_orderkey")) % 9973).alias("c"))
    targets = t.select(F.col("c_custkey").alias("ord"), ((F.col("c_custkey") * 6113) % 10007).alias("r"), ((F.col("c_custkey") * F.col("c_custkey")) % 9973).alias("c"))
    out = spatial.nearest(clicks, targets, 20.0, 30.0, keys=("o_orderkey",))
    return out.select("o_orderkey", F.col("p_ord").alias("target"), F.round("dist", 6).alias("dist"))
