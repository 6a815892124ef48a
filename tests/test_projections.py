"""Projections against published worked examples, well-known text of several writers, and what is refused."""

import math

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import crs
from lodestrata.functions import projections as P
from lodestrata.plans import layers
from tests.test_layers import META, write_shapes

FOOT = 0.304800609601219
CLARKE = (6378206.4, 294.9786982)
# Examples of the EPSG's guidance note and of Snyder's manual: system, longitude, latitude, x, y.
EXAMPLES = [
    (P.System("lcc", *CLARKE, lat0=27 + 50 / 60, lon0=-99, sp1=28 + 23 / 60, sp2=30 + 17 / 60, east=2_000_000 * FOOT, unit=FOOT), -96, 28.5, 2963503.91, 254759.80),
    (P.System("lcc", *CLARKE, lat0=18, lon0=-77, east=250_000, north=150_000), -(76 + 56 / 60 + 37.26 / 3600), 17 + 55 / 60 + 55.80 / 3600, 255966.58, 142493.51),
    (P.System("polar", lat0=90, k0=0.994, east=2e6, north=2e6), 44, 73, 3320416.75, 632668.43),
    (P.System("polar", lat0=-90, lon0=70, sp1=-71, east=6e6, north=6e6), 120, -75, 7255380.79, 7053389.56),
    (P.System("albers", *CLARKE, lat0=23, lon0=-96, sp1=29.5, sp2=45.5), -75, 35, 1885472.73, 1535925.00),
    (P.System("tm", 6377563.396, 299.3249646, lat0=49, lon0=-2, k0=0.9996012717, east=400_000, north=-100_000), 0.5, 50.5, 577274.99, 69740.50),
    (P.System("mercator", 6377397.155, 299.1528128, lon0=110, k0=0.997, east=3_900_000, north=900_000), 120, -3, 5009726.58, 569150.82),
    (P.System("web"), -(100 + 20 / 60), 24 + 22 / 60 + 54.433 / 3600, -11169055.58, 2800000.00),
]


@pytest.mark.parametrize("system,lon,lat,x,y", EXAMPLES, ids=[f"{e[0].kind}{i}" for i, e in enumerate(EXAMPLES)])
def test_worked_examples(spark, system, lon, lat, x, y):
    row = spark.createDataFrame([(math.radians(lon), math.radians(lat), x, y)], "lon double, lat double, x double, y double")
    there = P._run(P._project(system), F.col("lon"), F.col("lat"))
    back = P._run(P._unproject(system), F.col("x"), F.col("y"))
    got = row.select(*there, *[F.degrees(c) for c in back]).first()
    assert abs(got[0] - x) < 0.011 and abs(got[1] - y) < 0.011 and abs(got[2] - lon) < 2e-7 and abs(got[3] - lat) < 2e-7


NAD83 = 'GEOGCS["GCS_North_American_1983",DATUM["D_North_American_1983",SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
ALBERS = f'PROJCS["USA_Contiguous_Albers",{NAD83},PROJECTION["Albers"],PARAMETER["False_Easting",0.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-96.0],PARAMETER["Standard_Parallel_1",29.5],PARAMETER["Standard_Parallel_2",45.5],PARAMETER["Latitude_Of_Origin",23.0],UNIT["Meter",1.0]]'
PLANE = f'PROJCS["NAD_1983_StatePlane_Arizona_Central_FIPS_0202_Feet",{NAD83},PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",699998.6],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-111.9166666666667],PARAMETER["Scale_Factor",0.9999],PARAMETER["Latitude_Of_Origin",31.0],UNIT["Foot_US",0.3048006096012192]]'
WKT2 = 'PROJCRS["x",BASEGEOGCRS["RGF93",DATUM["Reseau Geodesique Francais 1993",ELLIPSOID["GRS 1980",6378137,298.257222101,LENGTHUNIT["metre",1]]],PRIMEM["Greenwich",0,ANGLEUNIT["degree",0.0174532925199433]]],CONVERSION["Lambert-93",METHOD["Lambert Conic Conformal (2SP)",ID["EPSG",9802]],PARAMETER["Latitude of false origin",46.5,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Longitude of false origin",3,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Latitude of 1st standard parallel",49,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Latitude of 2nd standard parallel",44,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Easting at false origin",700000,LENGTHUNIT["metre",1]],PARAMETER["Northing at false origin",6600000,LENGTHUNIT["metre",1]]],CS[Cartesian,2],AXIS["easting (X)",east],LENGTHUNIT["metre",1]]'
POLAR = 'PROJCS["WGS 84 / NSIDC",GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Polar_Stereographic"],PARAMETER["latitude_of_origin",70],PARAMETER["central_meridian",-45],PARAMETER["scale_factor",1],PARAMETER["false_easting",0],PARAMETER["false_northing",0],UNIT["metre",1]]'


def near(a, b):
    return all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(vars(a).values(), vars(b).values()))


def test_texts_are_read():
    assert near(P.parse(ALBERS), P.of_code(5070)) and near(P.parse(WKT2), P.of_code(2154)) and near(P.parse(POLAR), P.of_code(3413))
    plane = P.parse(PLANE)
    assert plane.kind == "tm" and math.isclose(plane.east, 213_360.0, abs_tol=0.1) and math.isclose(plane.unit, FOOT, rel_tol=1e-6) and plane.k0 == 0.9999
    assert crs.of_wkt(NAD83) == NAD83 and crs.of_wkt("") is None and crs.of_wkt(ALBERS) == ALBERS
    utm = 'PROJCS["WGS_1984_UTM_Zone_12N",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-111.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'
    assert crs.of_wkt(utm) == "EPSG:32612"


def test_what_is_not_known_is_refused():
    odd = ALBERS.replace('PROJECTION["Albers"]', 'PROJECTION["Krovak"]'), ALBERS.replace("D_North_American_1983", "D_Nowhere"), "EPSG:9999", 'LOCAL_CS["x"]'
    for text in odd:
        with pytest.raises(ValueError):
            P.parse(text)


@pytest.mark.parametrize("text", [ALBERS, PLANE], ids=["albers", "state plane"])
def test_shapes_in_other_projections(spark, tmp_path, text):
    lonlat = [(-111.0 + 0.01 * i, 36.1 + 0.004 * i) for i in range(6)]
    rows = spark.createDataFrame(lonlat, "lon double, lat double")
    at = [tuple(r) for r in rows.select(*crs.convert(F.col("lon"), F.col("lat"), "EPSG:4326", text)).collect()]
    path = write_shapes(tmp_path / "p.shp", 8, [[[p]] for p in at])
    (tmp_path / "p.prj").write_text(text)
    _, shapes = layers.read_shapes(spark, path, META)
    got = sorted((p["x"], p["y"]) for r in shapes.collect() for p in r["parts"][0])
    want = sorted(tuple(r) for r in rows.select(*crs.to_utm(F.col("lon"), F.col("lat"), 32612)).collect())
    assert all(abs(a - c) < 0.01 and abs(b - d) < 0.01 for (a, b), (c, d) in zip(got, want))
