"""First-look operators: scored scans of deposit records, negatives outside dilated buffers, block splits, proximity of sampled
shapes, choice of value columns, and stretches of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators import deposits as dep
from lodestrata.operators import grid, sampling, spatial, terrain
from lodestrata.operators.grid import Meta

# Header names of coordinates, evidence a record needs, buffers and what a class of deposits is trained with.
X_NAMES, Y_NAMES = ("longitude", "lon", "long", "x", "lng", "long_dd"), ("latitude", "lat", "y", "lat_dd")
LEAST_SCORE = {"copper": 3.0, "ree": 3.5}
BUFFER_M, FALLBACK_M = {"copper": 300.0, "ree": 5_000.0}, 200.0
RATIO, FEWER = 3, 2
# File names of deposit shapefiles.
DEPOSIT_FILES = ("mrds*.shp", "porcu*.shp", "sedcu*.shp", "usmin*.shp", "main.shp")
# For layers by name the words that their value column has, in order; columns that never hold values.
VALUE_NAMES = {
    "radiometric_th": ("y_mean_ppm", "quan_ppm", "eth_ppm", "eth_pred", "eth_prediction", "eth", "thorium", "th232", "th"),
    "radiometric_k": ("y_mean_per", "quan_per", "k_pct", "k_percent", "k_pred", "k_prediction", "potassium", "k40", "k"),
    "radiometric_u": ("y_mean_ppm", "quan_ppm", "eu_ppm", "eu_pred", "eu_prediction", "uranium", "u238", "eu", "u"),
    "nure_th": ("th_ppm", "thorium", "th", "eth", "y_mean_ppm"),
    "nure_p": ("p_ppm", "p2o5", "phosphorus", "p"),
    "nure_nb": ("nb_ppm", "niobium", "nb"),
}
NO_VALUES = ("fid", "objectid", "id", "gid", "index", "easting", "northing", "x", "y", "lat", "latitude", "lon", "long", "longitude", "prob", "quantile")
ELEMENTS = ("CU", "Cu", "cu", "ZN", "Zn", "PB", "Pb", "MO", "Mo", "AS")


def scored(records: DataFrame, meta: Meta, commodity: str) -> DataFrame:
    """records (x, y, blob, tokens, ...) within the grid's bounds whose evidence reaches the commodity's least score, with
    score, r and c."""
    x0, y0, x1, y1 = meta.bounds()
    r, c = grid.world_to_pixel(meta, F.col("x"), F.col("y"))
    out = records.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).withColumn("score", dep.score(F.col("blob"), F.col("tokens"), commodity))
    out = out.filter(F.col("score") >= LEAST_SCORE[commodity]).withColumns({"r": r, "c": c})
    return out.filter(F.col("r").between(0, meta.h - 1) & F.col("c").between(0, meta.w - 1))


def scan_diagnostics(records: DataFrame, meta: Meta, commodity: str) -> DataFrame:
    """One row: records scanned, within bounds, selected, and the mean score of these (0 without any)."""
    x0, y0, x1, y1 = meta.bounds()
    inside = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    score = dep.score(F.col("blob"), F.col("tokens"), commodity)
    r, c = grid.world_to_pixel(meta, F.col("x"), F.col("y"))
    chosen = F.coalesce(inside & (score >= LEAST_SCORE[commodity]) & r.between(0, meta.h - 1) & c.between(0, meta.w - 1), F.lit(False))
    return records.agg(F.count("*").alias("scanned"), F.count_if(inside).alias("in_bounds"), F.count_if(chosen).alias("selected"), F.coalesce(F.avg(F.when(chosen, score)), F.lit(0.0)).alias("mean_score"))


def evidence_csv(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, blob, tokens) of a table of records: all its text, and its commodity names."""
    from lodestrata.sources.tables import first_of, lenient_csv

    rows = lenient_csv(spark, path)
    x, y = first_of(rows.columns, X_NAMES), first_of(rows.columns, Y_NAMES)
    if x is None or y is None:
        raise ValueError(f"no coordinate columns among {rows.columns}")
    words = [F.col(f"`{c}`") for c in rows.columns if c not in (x, y)]
    names = [F.col(f"`{c}`") for c in rows.columns if c.startswith("commod")]
    tokens = F.filter(F.transform(F.split(F.lower(F.concat_ws(",", *names)), "[,;]"), lambda t: F.trim(t)), lambda t: t != "")
    out = rows.select(F.expr(f"try_cast(`{x}` AS DOUBLE)").alias("x"), F.expr(f"try_cast(`{y}` AS DOUBLE)").alias("y"), F.lower(F.concat_ws(" | ", *words)).alias("blob"), tokens.alias("tokens"))
    return out.filter("x IS NOT NULL AND y IS NOT NULL")


def deposit_files(spark: SparkSession, folder: str) -> list[str]:
    """Shapefiles of deposits anywhere under a folder, by their names."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(DEPOSIT_FILES) + "}").load(folder)
    return sorted(r["path"] for r in found.select("path").collect())  # a few files


def first_vertices(shapes: DataFrame, meta: Meta) -> DataFrame:
    """(r, c, x, y) of the first vertex of each shape (parts) within the grid's bounds."""
    x0, y0, x1, y1 = meta.bounds()
    p = shapes.select(F.get(F.flatten("parts"), F.lit(0)).alias("p")).select("p.x", "p.y").filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    r, c = grid.world_to_pixel(meta, F.col("x"), F.col("y"))
    return p.select(r.alias("r"), c.alias("c"), "x", "y").filter(F.col("r").between(0, meta.h - 1) & F.col("c").between(0, meta.w - 1))


def zero_filled(cells: DataFrame, meta: Meta) -> DataFrame:
    """A full grid with 0 for masked cells."""
    return grid.densify(cells, meta).select("r", "c", F.coalesce("v", F.lit(0.0)).alias("v"))


def background(dem: DataFrame, marks: DataFrame, meta: Meta, buffer_m: float) -> DataFrame:
    """The cells of dem above 0 that a dilation of the marks by the buffer does not reach."""
    steps = max(1, int(buffer_m / max(1.0, sum(meta.metres()) / 2)))
    return dem.filter("v > 0").join(terrain.dilate(marks.select("r", "c").distinct(), meta, steps), ["r", "c"], "left_anti")


def negatives(dem: DataFrame, marks: DataFrame, meta: Meta, commodity: str, seed: int = 42) -> DataFrame:
    """Background cells (r, c): RATIO for each mark outside the commodity's buffer; FEWER at most where there are less; with
    the fallback buffer where there are none; and from all cells but the marks' where that leaves none either."""
    n = marks.count()
    pool = background(dem, marks, meta, BUFFER_M[commodity])
    have = pool.count()
    need = RATIO * n if have >= RATIO * n else min(have, FEWER * n)
    if not need:
        pool = background(dem, marks, meta, FALLBACK_M)
        need = min(pool.count(), FEWER * n)
    if not need:
        pool = dem.filter("v > 0").join(marks.select("r", "c").distinct(), ["r", "c"], "left_anti")
        need = FEWER * n
        if pool.count() <= need:
            raise ValueError("there are not enough cells for a background")
    return pool.select("r", "c").orderBy(sampling.uniform(seed, "r", "c"), "r", "c").limit(need)


def block_draw(samples: DataFrame, h: int, w: int, side: int = 4, seed: int = 42) -> DataFrame:
    """samples (r, c, ...) with block and test: a quarter of the blocks that have samples, drawn by hash, one at least."""
    at = lambda v, n: F.least(F.floor(v / max(1, n) * side), F.lit(side - 1)).cast("int")
    rows = samples.withColumn("block", at(F.col("c"), w) * side + at(F.col("r"), h))
    order = Window.orderBy(sampling.draw(seed, "block"), "block")  # side * side blocks
    dealt = rows.select("block").distinct().withColumn("_n", F.row_number().over(order)).withColumn("_k", F.count("*").over(Window.partitionBy()))
    return rows.join(F.broadcast(dealt), "block").withColumn("test", F.col("_n") <= F.greatest(F.lit(1), F.floor(F.col("_k") / 4))).drop("_n", "_k")


def block_split(samples: DataFrame, h: int, w: int, side: int = 4, seed: int = 42) -> DataFrame:
    """samples (r, c, label) with block and test, as block_draw has them.

    Where that leaves a side without one of the labels, or fewer than five test rows, a quarter of each label's rows is
    drawn instead."""
    split = block_draw(samples, h, w, side, seed)
    seen = {(r["test"], r["label"]): r["n"] for r in split.groupBy("test", "label").agg(F.count("*").alias("n")).collect()}  # four rows
    if all(seen.get((t, y)) for t in (True, False) for y in (0, 1)) and seen[True, 0] + seen[True, 1] >= 5:
        return split
    share = F.percent_rank().over(Window.partitionBy("label").orderBy(sampling.draw(seed, "r", "c"), "r", "c"))
    return split.withColumn("test", share < 0.25)


def trees_for(n_pos: int) -> int:
    """Trees of a forest by the number of positives."""
    return 100 if n_pos < 30 else 150 if n_pos < 100 else 200


def train_or_transfer(samples: DataFrame, cells: DataFrame, names: list[str], least: int, saved: str | None, spark: SparkSession, seed: int = 42) -> tuple[str, DataFrame, list[str]]:
    """("trained" or "transferred", cells with probability, warnings). With fewer positives than `least` a saved model is
    applied to the features that the cells share with it, zeros for the others; without one that is an error."""
    from lodestrata.operators import model

    n = samples.filter("label = 1").count()
    if n >= least:
        return "trained", model.train(samples, names, trees_for(n), seed).predict(cells), []
    if not saved:
        raise ValueError(f"{n} deposits are fewer than {least}, and there is no saved model")
    old = model.load(saved, spark)
    have = [x for x in old.names if x in cells.columns]
    warnings = [f"only {len(have)} of the model's {len(old.names)} features are there"] if len(have) < 2 else []
    filled = cells.withColumns({x: F.coalesce(F.col(x), F.lit(0.0)) if x in have else F.lit(0.0) for x in old.names})
    return "transferred", old.predict(filled), warnings


def sampled_proximity(shapes: DataFrame, meta: Meta, decay_cells: float = 500.0, reach: int = 2) -> DataFrame:
    """(r, c, v): 1 about a shape, falling to 0 at decay_cells cells. shapes has gtype and parts; of points each counts, of
    others the centre of the vertices and some 20 of them; a place marks the cells within reach. Zeros without any."""
    every = F.flatten("parts")
    step = F.greatest(F.lit(1), F.floor(F.size(every) / 20).cast("int"))
    mean = lambda k: F.aggregate(every, F.lit(0.0), lambda a, p: a + p[k]) / F.size(every)
    some = F.concat(F.array(F.struct(mean("x").alias("x"), mean("y").alias("y"))), F.filter(every, lambda p, i: i % step == 0))
    p = shapes.filter(F.size(every) > 0).select(F.inline(F.when(F.col("gtype") == "point", every).otherwise(some)))
    x0, y0, x1, y1 = meta.bounds()
    r, c = grid.world_to_pixel(meta, F.col("x"), F.col("y"))
    at = p.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).select(r.alias("r"), c.alias("c")).distinct().filter(F.col("r").between(0, meta.h - 1) & F.col("c").between(0, meta.w - 1))
    around = lambda k, n: F.explode(F.sequence(F.greatest(F.col(k) - reach, F.lit(0)), F.least(F.col(k) + reach, F.lit(n - 1))))
    marks = at.select(around("r", meta.h).alias("r"), "c").select("r", around("c", meta.w).alias("c")).distinct()
    unit = Meta(meta.h, meta.w, dx=1.0, dy=-1.0)
    v = F.when(F.col("d").isNull(), 0.0).otherwise(spatial.proximity_linear(F.col("d"), decay_cells))
    return grid.cells(shapes.sparkSession, meta).join(spatial.distance(marks, unit), ["r", "c"], "left").select("r", "c", v.alias("v"))


def value_column(layer: str, first: dict[str, str]) -> str | None:
    """The value column of a layer's table (names, in order, with the first row's texts): by the layer's words, then by its
    own name, else the first number that is no coordinate or key."""
    words = [*VALUE_NAMES.get(layer.lower(), ()), layer.replace("radiometric_", "").replace("nure_", "")]
    clean = {n: n.replace("﻿", "").strip().lower() for n in first}
    for w in words:
        for n, low in clean.items():
            if low not in NO_VALUES and w and w.lower().strip() in low:
                return n
    return next((n for n, v in first.items() if clean[n] not in NO_VALUES and clean[n] != "rastervalu" and _number(v)), None)


def element_field(fields: list[str]) -> str | None:
    """The field of a shapefile that holds an element's concentration: by element, else the first that is no coordinate or
    key, else the first."""
    for e in ELEMENTS:
        for f in fields:
            if e in f and f.lower() not in NO_VALUES:
                return f
    return next((f for f in fields if f.lower() not in NO_VALUES), fields[0] if fields else None)


def _number(text: str | None) -> bool:
    try:
        float(text or "")
    except ValueError:
        return False
    return True


def stretch_positive(cells: DataFrame) -> DataFrame:
    """v over the 95th percentile of its positive values, clipped to 0 and 1; zeros without any, 0 for masked cells."""
    p95 = grid.percentiles(cells.filter("v > 0"), "v", [0.95])[0]
    v = F.coalesce("v", F.lit(0.0))
    return cells.select("r", "c", (F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / p95)) if p95 else F.lit(0.0)).alias("v"))


def stretch_symmetric(cells: DataFrame) -> DataFrame:
    """v over the 95th percentile of its size, clipped to -1 and 1; masked cells count as 0."""
    full = cells.select("r", "c", F.coalesce("v", F.lit(0.0)).alias("v"))
    p95 = grid.percentiles(full.withColumn("v", F.abs("v")), "v", [0.95])[0]
    return full.select("r", "c", (F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("v") / p95)) if p95 else F.lit(0.0)).alias("v"))


def area_km(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column]:
    """Width, height and area, in kilometres, of a box of degrees."""
    width = F.abs(x1 - x0) * 111.32 * F.cos(F.radians((y0 + y1) / 2))
    height = F.abs(y1 - y0) * 111.32
    return width, height, width * height


def text_report(facts: dict[str, object], importances: list[tuple[str, float]], classes: DataFrame | None = None, transferred_from: str | None = None) -> str:
    """A plain report of a run: what was trained or transferred, importances, and precision and recall by class."""
    out = ["Transferred model: exploratory" if transferred_from else "Model validation", "=" * 40]
    out += [f"Model: {transferred_from}"] if transferred_from else []
    out += [f"{k}: {v:.4f}" if isinstance(v, float) else f"{k}: {v}" for k, v in facts.items()]
    out += ["", "Feature importance:"] + [f"  {n}: {w:.4f}" for n, w in importances]
    if classes is not None:
        out += ["", "Class, precision, recall, f1, support:"] + [f"  {r['class']}: {r['precision']:.3f}, {r['recall']:.3f}, {r['f1']:.3f}, {r['support']}" for r in classes.orderBy("class").collect()]  # two rows
    return "\n".join([*out, "", "Grades are figures of the population, no assay; only drilling establishes them.", ""])
