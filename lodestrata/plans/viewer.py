"""What a viewer needs, as tables: extents, thinned grids, stretches, colours, samples at points, payloads and project files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import crs, scalar
from lodestrata.operators import grid
from lodestrata.operators.grid import METRES_PER_DEGREE, Meta
from lodestrata.sources import tables

# A run's layers with their short names, ranges (None: stretched) and units.
LAYERS = (
    ("probability", "prob", 0.0, 1.0, ""),
    ("uncertainty", "unc", None, None, ""),
    ("classes", "cls", 0.0, 2.0, ""),
    ("depth_spectral_m", "dsp", None, None, " m"),
    ("depth_euler_m", "deu", None, None, " m"),
)
# Cells a side of thinned grids, and grades that a full probability stands for where there is no grade map.
MESH, IMAGE, VOLUME = 220, 1_400, 300
# How far outside the map a place may lie, how many deposits are shown, and the names of their columns.
MARGIN, SHOWN = 0.02, 4_000
SHOWN_X, SHOWN_Y = ("longitude", "lon", "x", "east", "easting", "dec_long"), ("latitude", "lat", "y", "north", "northing", "dec_lat")
GRADE_OF_ONE = {"copper": 2.5, "ree": 10.0}


def extents(x0: Column, y0: Column, x1: Column, y1: Column, geographic: bool) -> tuple[Column, Column]:
    """Width and height in metres of a box; degrees are taken at its central latitude."""
    w, h = F.abs(x1 - x0), F.abs(y1 - y0)
    if not geographic:
        return w, h
    return w * METRES_PER_DEGREE * F.greatest(F.cos(F.radians((y0 + y1) / 2)), F.lit(1e-6)), h * METRES_PER_DEGREE


def clicked(u: Column, v: Column, west: Column, south: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude at a fraction of the width from the west and of the height from the north."""
    return west + u * (east - west), north - v * (north - south)


def at_fraction(u: Column, v: Column, meta: Meta) -> tuple[Column, Column]:
    """The cell at a fraction of the height and width, kept within the grid."""
    inside = lambda x, n: F.greatest(F.lit(0), F.least(F.floor(x * n).cast("int"), F.lit(n - 1)))
    return inside(v, meta.h), inside(u, meta.w)


def fractional(meta: Meta, x: Column, y: Column) -> tuple[Column, Column]:
    """Where a point lies from the west and from the north, 0 to 1; points up to MARGIN outside are moved to the border, others are
    NULL."""
    u, v = (x - meta.x0) / (meta.w * meta.dx), (y - meta.y0) / (meta.h * meta.dy)
    near = u.between(-MARGIN, 1 + MARGIN) & v.between(-MARGIN, 1 + MARGIN)
    return F.when(near, scalar.clip(u)), F.when(near, scalar.clip(v))


def shown_at(meta: Meta, x: Column, y: Column) -> tuple[Column, Column]:
    """`fractional` of points that may be longitudes and latitudes, by their size, or coordinates of the grid."""
    if meta.geographic or not meta.crs:
        return fractional(meta, x, y)
    gx, gy = crs.convert(x, y, "EPSG:4326", meta.crs)
    degrees = crs.looks_geographic(x, y)
    return fractional(meta, F.when(degrees, gx).otherwise(x), F.when(degrees, gy).otherwise(y))


def _placed(rows: DataFrame, meta: Meta) -> DataFrame:
    """rows (x, y, ...) with u and v of five decimals instead; those that lie too far outside go."""
    u, v = shown_at(meta, F.col("x"), F.col("y"))
    return rows.withColumns({"u": F.round(u, 5), "v": F.round(v, 5)}).filter("u IS NOT NULL AND v IS NOT NULL").drop("x", "y")


def run_targets(spark: SparkSession, path: str, meta: Meta) -> DataFrame:
    """A run's table of targets for a viewer; rows without a place or a probability, such as notes, go."""
    rows = tables.lenient_csv(spark, path)
    number = lambda n: F.expr(f"try_cast(`{n}` AS DOUBLE)") if n in rows.columns else F.lit(None).cast("double")
    text = lambda n: F.nullif(F.trim(n), F.lit("")) if n in rows.columns else F.lit(None).cast("string")
    named = [number(n).alias(n) for n in ("uncertainty", "depth_spectral_m", "depth_euler_m", "nearest_deposit_km", "driver_1_percentile")] + [text(n).alias(n) for n in ("depth_status", "nearest_deposit_name", "driver_1")]
    read = rows.select(number("longitude").alias("x"), number("latitude").alias("y"), number("rank").cast("int").alias("rank"), F.round(number("probability"), 3).alias("probability"), *named)
    return _placed(read.filter("x IS NOT NULL AND y IS NOT NULL AND probability IS NOT NULL"), meta)


def run_deposits(spark: SparkSession, path: str, meta: Meta, most: int | None = SHOWN) -> DataFrame:
    """(name, u, v) of a table of deposits for a viewer: the first `most` rows that lie on the map (None: all)."""
    rows = tables.lenient_csv(spark, path)
    x, y, name = (tables.first_of(rows.columns, n) for n in (SHOWN_X, SHOWN_Y, tables.TABLE_SITE_NAMES))
    if x is None or y is None:
        return spark.createDataFrame([], "name string, u double, v double")
    label = F.coalesce(F.nullif(F.col(f"`{name}`"), F.lit("")), F.lit("deposit")) if name else F.lit("deposit")
    read = rows.select(F.monotonically_increasing_id().alias("at"), F.expr(f"try_cast(`{x}` AS DOUBLE)").alias("x"), F.expr(f"try_cast(`{y}` AS DOUBLE)").alias("y"), label.alias("name"))
    found = _placed(read.filter("x IS NOT NULL AND y IS NOT NULL"), meta)
    return (found if most is None else found.orderBy("at").limit(most)).drop("at")


def scene(dem: DataFrame, layers: dict[str, DataFrame], meta: Meta, targets: DataFrame, deposits: DataFrame, title: str = "Targets") -> DataFrame:
    """One row with the json of all that a viewer of the relief shows: size in metres, bounds, heights, layers, targets and deposits.
    Every part is bounded: thinned grids, ranked targets, the deposits that are shown."""
    z, rows, cols = heightfield(dem, meta)
    heights = z.agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "z"))), lambda x: x["z"]).alias("z"))
    span = dem.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    x0, y0, x1, y1 = (F.lit(float(v)) for v in meta.bounds())
    width, height = extents(x0, y0, x1, y1, meta.geographic)
    every = lambda df, order: df.agg(F.array_sort(F.collect_list(F.struct(*[F.col(order)], *[c for c in df.columns if c != order]))).alias("all"))
    found = payload(layers, meta).select("id", "title", "json") if layers else dem.sparkSession.createDataFrame([], "id string, title string, json string")
    both = heights.crossJoin(span).crossJoin(every(targets, "rank").select(F.col("all").alias("targets"))).crossJoin(every(deposits, "name").select(F.col("all").alias("deposits"))).crossJoin(every(found, "id").select(F.col("all").alias("layers")))  # one row each
    west, south, east, north = wgs84(dem.sparkSession, meta)
    low, high = F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.lit(1.0))
    body = F.struct(F.lit(title).alias("title"), width.alias("width_m"), height.alias("height_m"), low.alias("low"), F.when(high > low, high).otherwise(low + 1).alias("high"), F.lit(meta.geographic).alias("geographic"), F.array(*[F.lit(v) for v in (west, south, east, north)]).alias("bounds"), F.struct(F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), "z").alias("relief"), "layers", "targets", "deposits")
    return both.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def wgs84(spark: SparkSession, meta: Meta) -> tuple[float, float, float, float]:
    from lodestrata.plans import layers

    return layers.wgs84_bounds(spark, meta) if meta.geographic or meta.crs else meta.bounds()


def heights_at(cells: DataFrame, meta: Meta, points: DataFrame) -> DataFrame:
    """points (id, fr, fc: rows and columns with fractions) with v, bilinear between four cells and kept within the grid;
    NULL where one of them is masked. An equi-join of the four neighbours."""
    clip = lambda x, n: F.greatest(F.lit(0.0), F.least(x, F.lit(n - 1.0)))
    p = points.select("id", clip(F.col("fr"), meta.h).alias("fr"), clip(F.col("fc"), meta.w).alias("fc"))
    corner = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]
    near = p.select("id", "fr", "fc", F.inline(F.array(*corner)))
    wr, wc = F.col("fr") - F.floor("fr"), F.col("fc") - F.floor("fc")
    w = F.when(F.col("a") == 1, wr).otherwise(1 - wr) * F.when(F.col("b") == 1, wc).otherwise(1 - wc)
    near = near.select("id", w.alias("w"), (F.floor("fr") + F.col("a")).cast("int").alias("r"), (F.floor("fc") + F.col("b")).cast("int").alias("c")).filter("w > 0")
    found = near.join(cells.select("r", "c", "v"), ["r", "c"], "left").groupBy("id").agg(F.sum(F.col("w") * F.col("v")).alias("v"), F.count("v").alias("k"), F.count("*").alias("n"))
    return found.select("id", F.when(F.col("k") == F.col("n"), F.col("v")).alias("v"))


def stretched(cells: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """v from 0 to 1 between low and high; without them between its 2nd and 98th percentile."""
    a, b = (low, high) if low is not None else grid.percentiles(cells, "v", [0.02, 0.98])
    if a is None or b is None:
        return cells.select("r", "c", F.lit(None).cast("double").alias("v"))
    return cells.select("r", "c", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - a) / max(b - a, 1e-12))).alias("v"))


def heightfield(cells: DataFrame, meta: Meta, most: int = MESH) -> tuple[DataFrame, int, int]:
    """Rows of a thinned grid (r, z: an array of heights with two digits, NULL where masked), and its size."""
    step = max(1, -(-max(meta.h, meta.w) // most))
    rows, cols = -(-meta.h // step), -(-meta.w // step)
    thin = grid.densify(grid.stride(cells, step), Meta(rows, cols))
    z = thin.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("c", F.round("v", 2).alias("z")))).alias("z"))  # most cells a row
    return z.select("r", F.transform("z", lambda x: x["z"]).alias("z")), rows, cols


def colour(p: Column) -> Column:
    """red, green and blue (0 to 1) of a probability: grey under 0.60, then blue, cyan, green, yellow, orange and red at 0.85."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (p - 0.6) / 0.25))
    # The ramp's colours and where they stand; between two of them colours are mixed.
    stops = [(0.0, (0.0, 0.0, 1.0)), (0.2, (0.0, 1.0, 1.0)), (0.4, (0.0, 1.0, 0.0)), (0.6, (1.0, 1.0, 0.0)), (0.8, (1.0, 0.5, 0.0)), (1.0, (1.0, 0.0, 0.0))]

    def channel(k: int) -> Column:
        out = F.lit(stops[-1][1][k])
        for (a, x), (b, y) in reversed(list(zip(stops, stops[1:], strict=False))):
            out = F.when(t < b, x[k] + (t - a) / (b - a) * (y[k] - x[k])).otherwise(out)
        return F.when(p < 0.6, 0.3).otherwise(out)

    return F.struct(channel(0).alias("red"), channel(1).alias("green"), channel(2).alias("blue"))


def cropped_alike(a: DataFrame, b: DataFrame, meta_a: Meta, meta_b: Meta) -> tuple[DataFrame, DataFrame, int, int]:
    """Two grids cut to the rows and columns that both have, and the size."""
    h, w = min(meta_a.h, meta_b.h), min(meta_a.w, meta_b.w)
    inside = (F.col("r") < h) & (F.col("c") < w)
    return a.filter(inside), b.filter(inside), h, w


def shown_grade(grade: Column, p: Column, commodity: str) -> Column:
    """The grade, or where there is none a rough figure by the probability: a reference, no assay."""
    return F.coalesce(grade, p * GRADE_OF_ONE[commodity])


def payload(layers: dict[str, DataFrame], meta: Meta, most: int = MESH) -> DataFrame:
    """(layer, id, title, json) of the layers that there are: range, unit and thinned values, row by row."""
    out = None
    for name, short, low, high, unit in LAYERS:
        if name not in layers:
            continue
        z, rows, cols = heightfield(layers[name], meta, most)
        a, b = (low, high) if low is not None else grid.percentiles(layers[name], "v", [0.02, 0.98])
        values = z.agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "z"))), lambda x: x["z"]).alias("z"))  # most rows of most cells
        body = F.to_json(F.struct(F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), F.lit(a).cast("double").alias("low"), F.lit(b).cast("double").alias("high"), F.lit(unit).alias("unit"), "z"), {"ignoreNullFields": "false"})
        one = values.select(F.lit(name).alias("layer"), F.lit(short).alias("id"), F.lit(name.removesuffix("_m").replace("_", " ")).alias("title"), body.alias("json"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("none of the layers is known")
    return out


def project_text(engine: str, config: dict) -> str:
    """A project file's text: the engine and its configuration."""
    return json.dumps({"engine": engine, "config": config}, indent=2, sort_keys=True)


def read_project(text: str) -> tuple[str, dict]:
    data = json.loads(text)
    return data["engine"], data["config"]
