"""Evidence layers from shapes and point tables."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import crs, scalar
from lodestrata.operators import deposits as dep
from lodestrata.operators import grid, sampling, spatial
from lodestrata.operators.grid import Meta

#: Points that an inverse-distance layer uses at most; more are drawn by hash.
IDW_POINTS = 2_000
# Words that name a value column of a shapefile.
VALUE_WORDS = ("value", "ppm", "ppb", "grade", "conc", "pct")
#: Shapes, and points of each, by which shapes without a projection are judged.
PROBE_SHAPES, PROBE_POINTS, PROBED = 200, 5, 200


def to_grid_crs(points: DataFrame, meta: Meta) -> DataFrame:
    """points (x, y, ...) in the grid's projection: on a projected grid those that look geographic are taken for WGS84."""
    if meta.geographic or not meta.crs:
        return points
    x, y = crs.convert(F.col("x"), F.col("y"), "EPSG:4326", meta.crs)
    degrees = crs.looks_geographic(F.col("x"), F.col("y"))
    return points.withColumns({"x": F.when(degrees, x).otherwise(F.col("x")), "y": F.when(degrees, y).otherwise(F.col("y"))})


def read_shapes(spark: SparkSession, path: str, meta: Meta) -> tuple[str, DataFrame]:
    """The family (point, line or polygon) and the shapes (file, no, parts, attributes) of a shapefile, in the grid's
    projection. The .prj file tells theirs; without one, shapes on a projected grid are taken for WGS84 if the first points
    of the first shapes all look geographic, else for the grid's."""
    from lodestrata.sources import shapefile

    shapefile.register(spark)
    shapes = spark.read.format("shapefile").load(path)
    kinds = [r["gtype"] for r in shapes.select("gtype").distinct().collect()]
    if len(kinds) != 1:
        raise ValueError(f"{PurePosixPath(path).name} holds {sorted(kinds)}")
    source = crs.of_wkt(shapes.select("crs").first()[0])
    if source is None and not meta.geographic and meta.crs:
        first = shapes.orderBy("file", "no").limit(PROBE_SHAPES).select("file", "no", F.slice(F.flatten("parts"), 1, PROBE_POINTS).alias("p")).orderBy("file", "no").collect()
        probe = [p for r in first for p in r["p"]][:PROBED]
        if probe and all(abs(p["x"]) <= 360 and abs(p["y"]) <= 90 for p in probe):
            source = "EPSG:4326"
    return kinds[0], shapes_to(shapes, source, meta)


def shapes_to(shapes: DataFrame, source: str | None, meta: Meta) -> DataFrame:
    """shapes with parts converted from an EPSG code to the grid's."""
    if source is None or source == meta.code():
        return shapes

    def moved(p: Column) -> Column:
        x, y = crs.convert(p["x"], p["y"], source, meta.code())
        return F.struct(x.alias("x"), y.alias("y"))

    return shapes.withColumn("parts", F.transform("parts", lambda part: F.transform(part, moved)))


def on_grid(points: DataFrame, meta: Meta) -> DataFrame:
    """points with r, c, those outside the grid dropped."""
    r, c = grid.world_to_pixel(meta, F.col("x"), F.col("y"))
    return points.withColumns({"r": r, "c": c}).filter(F.col("r").between(0, meta.h - 1) & F.col("c").between(0, meta.w - 1))


def point_layer(points: DataFrame, meta: Meta, valued: bool, decay: float = 5_000.0) -> DataFrame:
    """Inverse-distance values of five valued points or more, else linear proximity; zero everywhere without points."""
    spark = points.sparkSession
    p = on_grid(points, meta)
    if valued and p.filter("v IS NOT NULL").count() >= 5:
        some = p.filter("v IS NOT NULL").orderBy(sampling.uniform(0, "x", "y"), "x", "y", "v").limit(IDW_POINTS)
        return spatial.idw_grid(some, meta)
    d = spatial.distance(p, meta)
    v = F.when(F.col("d").isNull(), 0.0).otherwise(spatial.proximity_linear(F.col("d"), decay))
    return grid.cells(spark, meta).join(d, ["r", "c"], "left").select("r", "c", v.alias("v"))


def _parts(shapes: list[list[tuple[float, float]]], spark: SparkSession) -> DataFrame:
    rows = [(i, [(float(x), float(y)) for x, y in p]) for i, p in enumerate(shapes)]
    return spark.createDataFrame(rows, "part long, p array<struct<x:double,y:double>>")


def _decay(marks: DataFrame, meta: Meta, decay: float) -> DataFrame:
    """exp(-d / decay) of every cell; zeros without marks."""
    v = F.coalesce(spatial.proximity_exp(F.col("d"), decay), F.lit(0.0))
    return grid.cells(marks.sparkSession, meta).join(spatial.distance(marks, meta), ["r", "c"], "left").select("r", "c", v.alias("v"))


def line_layer(lines: list[list[tuple[float, float]]] | DataFrame, meta: Meta, spark: SparkSession, decay: float = 2_500.0) -> DataFrame:
    """exp(-d / decay) from the cells that any line touches, zeros if none does; lines may be a table (part, p)."""
    parts = lines if isinstance(lines, DataFrame) else _parts(lines, spark)
    return _decay(spatial.burn_segments(spatial.segments(parts, False), meta), meta, decay)


def polygon_layer(rings: list[list[tuple[float, float]]] | DataFrame, meta: Meta, spark: SparkSession, decay: float = 2_500.0) -> DataFrame:
    """1 inside a polygon or where its border passes, falling off outside; zeros if none touches the grid. A list holds
    polygons of one ring; of a table (part, p) the rows of one part are one polygon's rings, and what lies in an even
    number of them is a hole."""
    parts = rings if isinstance(rings, DataFrame) else _parts(rings, spark)
    sides = spatial.segments(parts.filter(F.size("p") >= 3), True)
    return _decay(spatial.fill_rings(sides, meta).unionByName(spatial.burn_segments(sides, meta)), meta, decay)


def shapefile_layer(spark: SparkSession, path: str, meta: Meta, value_field: str | None = None) -> DataFrame:
    """A layer of a shapefile by its family of shapes."""
    kind, shapes = read_shapes(spark, path, meta)
    if kind == "point":
        first = shapes.orderBy("file", "no").select("attributes").first()[0]
        name = value_field or value_column(first or {})
        v = F.expr("try_cast(attributes['" + name + "'] AS DOUBLE)") if name else F.lit(None).cast("double")
        p = shapes.select(F.explode("parts").alias("part"), v.alias("v")).select(F.get("part", F.lit(0)).alias("p"), "v").select("p.x", "p.y", "v")
        return point_layer(p, meta, name is not None)
    parts = shapes.select(F.struct("file", "no").alias("part"), F.explode("parts").alias("p")).filter(F.size("p") >= (2 if kind == "line" else 3))
    if parts.isEmpty():
        raise ValueError(f"{PurePosixPath(path).name} has no {kind} of enough points")
    return line_layer(parts, meta, spark) if kind == "line" else polygon_layer(parts, meta, spark)


def value_column(first: dict[str, str]) -> str | None:
    """The first field, in order, with a value word in its name and a number in the first record."""
    def number(text: str) -> bool:
        try:
            float(text)
        except ValueError:
            return False
        return True

    return next((n for n, v in first.items() if any(w in n.lower() for w in VALUE_WORDS) and number(v)), None)


def load_deposits(spark: SparkSession, path: str, meta: Meta, commodity: str, valid: DataFrame, least_rank: int = 1, aoi: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(r, c, ord, x, y, name, rank) of the deposits of a CSV table or point shapefile that name the commodity, have at least
    that status, lie in the area (both ends included; the grid's bounds) and on a cell of valid (r, c).

    A table without commodity columns passes whole; in a shapefile an empty commodity passes. Nothing is cast out twice:
    cells with several deposits keep them all (`deposits.dedupe`)."""
    from lodestrata.sources import tables

    if path.lower().endswith(".shp"):
        kind, shapes = read_shapes(spark, path, meta)
        if kind != "point":
            raise ValueError(f"{PurePosixPath(path).name}: deposits must be points, not a {kind}")
        fields = [k.lower() for k in (shapes.orderBy("file", "no").select(F.map_keys("attributes")).first()[0] or [])]
        low = F.transform_keys("attributes", lambda k, v: F.lower(k))
        pick = lambda names, other: F.coalesce(F.try_element_at(low, F.lit(n)), F.lit(other)) if (n := tables.first_of(fields, names)) else F.lit(other)
        rows = shapes.select(F.xxhash64("file").alias("_f"), "no", F.explode("parts").alias("part"), pick(tables.SITE_NAMES, "deposit").alias("name"), pick(tables.COMMODITY_NAMES, "").alias("commodity"), F.lit("").alias("status"))
        rows = rows.select(F.col("no").alias("ord"), F.get("part", F.lit(0)).alias("p"), "name", "commodity", "status").select("ord", "p.x", "p.y", "name", "commodity", "status")
        test = dep.is_commodity(F.col("commodity"), commodity, True)
    else:
        rows = to_grid_crs(tables.csv_deposits(spark, path).withColumn("ord", F.monotonically_increasing_id()), meta)
        test = F.col("commodity").isNull() | dep.is_commodity(F.col("commodity"), commodity)
    x0, y0, x1, y1 = aoi or meta.bounds()
    rank = dep.status_rank(F.col("status"))
    kept = rows.filter(test & F.col("x").between(x0, x1) & F.col("y").between(y0, y1) & (rank >= least_rank))
    return on_grid(kept, meta).join(valid.select("r", "c"), ["r", "c"], "left_semi").select("r", "c", "ord", "x", "y", "name", rank.alias("rank"))


def nearest_layer(points: DataFrame, meta: Meta) -> DataFrame:
    """The nearest positive value, over the values' 95th percentile and clipped to 1; at least three points."""
    p = on_grid(points, meta).filter("v > 0")
    if p.count() < 3:
        raise ValueError("fewer than three positive points")
    ranked = p.withColumn("ord", F.xxhash64("x", "y", "v")).select("r", "c", "ord", "v")
    near = spatial.nearest_on_grid(ranked, meta).select("r", "c", F.col("p_v").alias("v"))
    return near.select("r", "c", scalar.clip(F.col("v") / grid.percentiles(near, "v", [0.95])[0]).alias("v"))


def wgs84_bounds(spark: SparkSession, meta: Meta) -> tuple[float, float, float, float]:
    """West, south, east, north of the grid's corners."""
    x0, y0, x1, y1 = meta.bounds()
    if meta.geographic:
        return x0, y0, x1, y1
    corners = spark.createDataFrame([(x, y) for x in (float(x0), float(x1)) for y in (float(y0), float(y1))], "x double, y double")
    lon, lat = crs.convert(F.col("x"), F.col("y"), meta.crs, "EPSG:4326")
    return tuple(corners.select(lon.alias("lon"), lat.alias("lat")).agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first())


def fill_and_stretch(coarse: DataFrame, small: Meta, target: Meta) -> DataFrame:
    """A coarse map with its gaps filled by the nearest valid cell, then interpolated to the target grid: the corner cells of
    both lie on one another."""
    known = coarse.filter("v IS NOT NULL").withColumn("ord", (F.col("r") * small.w + F.col("c")).cast("long")).select("r", "c", "ord", "v")
    full = spatial.nearest_on_grid(known, Meta(small.h, small.w, 0, 0, 1, -1)).select("r", "c", F.col("p_v").alias("v"))
    # Places as indices of the target: the coarse cell j lies at j * (n - 1) / (m - 1).
    sy, sx = ((n - 1) / (m - 1) if m > 1 else 2.0 * n for n, m in ((target.h, small.h), (target.w, small.w)))
    return grid.align(full, Meta(small.h, small.w, -sx / 2, -sy / 2, sx, sy), Meta(target.h, target.w, -0.5, -0.5, 1.0, 1.0))


def ree_grade_map(maps: DataFrame) -> DataFrame:
    """maps (r, c, probability, th) with v: a linear reference grade, 40 % from positive thorium; 0 under 0.20."""
    low, high = scalar.REE_RANGE
    p95 = grid.percentiles(maps.filter("th > 0"), "th", [0.95])[0]
    model = low + F.col("probability") * (high - low)
    measured = low + scalar.clip(F.col("th") / F.lit(p95)) * (high - low)
    v = F.when(F.col("th") > 0, 0.6 * model + 0.4 * measured).otherwise(model)
    return maps.select("r", "c", F.when(F.col("probability") < 0.20, 0.0).otherwise(scalar.clip(v, 0.0, high)).alias("v"))
