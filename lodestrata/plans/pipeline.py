"""The prospectivity pipeline: layers and deposits in; model, maps, depths, ranked targets, verdict and reports out."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field
from statistics import NormalDist

from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import crs, scalar
from lodestrata.operators import deposits as dep
from lodestrata.operators import depth, grid, metrics, model, sampling, spatial, targets, terrain
from lodestrata.operators.grid import Meta
from lodestrata.plans import layers as evidence
from lodestrata.plans.catalog import Store
from lodestrata.sources import geotiff, tables

# What the deposit models ask for, and where their grades come from.
COMMODITIES = {
    "copper": {"label": "Copper (Cu)", "type": "porphyry copper", "least": 20, "buffer_m": 1_500.0, "unit": "% Cu", "log10": scalar.COPPER_LOG10, "reference": "Singer and others (2008)"},
    "ree": {"label": "Rare Earth Elements (REE)", "type": "carbonatite REE", "least": 5, "buffer_m": 5_000.0, "unit": "% TREO", "range": scalar.REE_RANGE, "reference": "Verplanck and others (2014)"},
}
VERSION = "1.1"


@dataclass
class Config:
    """What an analysis is run with. Paths name files that all machines read; vectors are .shp or .csv files."""

    project: str = "default"
    dem: str = ""
    deposits: str = ""
    rasters: dict[str, str] = field(default_factory=dict)
    vectors: dict[str, str] = field(default_factory=dict)
    value_fields: dict[str, str] = field(default_factory=dict)
    magnetics: str = "magnetics"
    crop: str = "full"
    max_px: int = 1_200
    commodity: str = "copper"
    terrain_scale_m: float = 1_000.0
    holdout_fraction: float = 0.2
    negative_ratio: int = 2
    trees: int = 300
    folds: int = 5
    seed: int = 42
    threshold: float = 0.7
    separation: int = 8
    top: int = 25
    least_valid: float = 0.05
    blend: float = 0.0
    depth_window: int = 64
    structural_index: float = 2.0
    depths: bool = True

    def problems(self) -> list[str]:
        """What is wrong with it; files that are named must be there."""
        out = []
        for what, path in {"dem": self.dem, "deposits": self.deposits, **self.rasters, **self.vectors}.items():
            if path and not _exists(path):
                out.append(f"{what} not found: {path}")
        if self.commodity not in COMMODITIES:
            out.append(f"unknown commodity {self.commodity}")
        if self.crop not in ("full", "center"):
            out.append(f"unknown crop {self.crop}")
        if not 0 <= self.blend <= 0.5:
            out.append("blend is not in 0 to 0.5")
        if self.depth_window & (self.depth_window - 1) or self.depth_window < 8:
            out.append("depth_window is not a power of two")
        return out

    def check(self) -> None:
        if out := self.problems():
            raise ValueError("; ".join(out))

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls(**json.loads(text))


def _exists(path: str) -> bool:
    fs, name = geotiff.place(path)
    return fs.get_file_info(name).type != FileType.NotFound


@dataclass
class Result:
    """Tables and small numbers of a run; depth rasters are there where a magnetic layer was given."""

    cells: DataFrame
    targets: DataFrame
    cv: dict
    holdout: dict
    verdict: str
    reasons: list
    importances: list
    n_train: int
    n_held: int
    n_euler: int = 0
    depth_spectral: DataFrame | None = None
    depth_euler: DataFrame | None = None
    warnings: list = field(default_factory=list)


def run_files(spark: SparkSession, config: Config, out: str, store: Store | None = None) -> Result:
    """The analysis from files to artifacts: elevation, rasters in any known projection, shapefiles and tables of points in;
    maps, targets, model, reports and the configuration out."""
    config.check()
    if not config.dem:
        raise ValueError("an elevation raster is required")
    if not config.deposits:
        raise ValueError("a table or shapefile of deposits is required for training")
    meta, dem = geotiff.load(spark, config.dem, config.crop, config.max_px)
    dem = _kept(spark, dem, f"{out}/dem")
    layers, warnings = {}, []
    for name, path in config.rasters.items():
        layer = geotiff.load_aligned(spark, path, meta)
        if layer is None:
            warnings.append(f"raster {name} was left out: it does not overlap the area")
        else:
            layers[name] = _kept(spark, layer, f"{out}/layer-{name}")
    for name, path in config.vectors.items():
        try:
            layers[name] = _kept(spark, _vector(spark, path, meta, config.value_fields.get(name)), f"{out}/layer-{name}")
        except ValueError as e:
            warnings.append(f"vector {name} was left out: {e}")
    spots = evidence.load_deposits(spark, config.deposits, meta, config.commodity, dem)
    result = run(spark, dem, meta, spots, layers, out, config, config.magnetics, store, warnings)
    write_artifacts(spark, result, dem, meta, config, out)
    return result


def _vector(spark: SparkSession, path: str, meta: Meta, value_field: str | None) -> DataFrame:
    if path.lower().endswith(".shp"):
        return evidence.shapefile_layer(spark, path, meta, value_field)
    points = evidence.to_grid_crs(tables.csv_points(spark, path, value_field), meta)
    if points.isEmpty():
        raise ValueError("no usable points")
    valued = not points.filter(F.abs(F.col("v") - 1) > 1e-9).isEmpty()
    return evidence.point_layer(points, meta, valued)


def run(spark: SparkSession, dem: DataFrame, meta: Meta, deposits: DataFrame, layers: dict[str, DataFrame], out: str, config: Config | None = None, magnetics: str | None = None, store: Store | None = None, warnings: list[str] | None = None) -> Result:
    """All stages; wide tables are written under out as they are made, so each stage reads what the last one stored.

    deposits has r, c, ord, name, rank; layers have r, c, v on the dem's grid."""
    config = config or Config()
    config.check()
    spec, warnings, run_id = COMMODITIES[config.commodity], warnings or [], uuid.uuid4().hex[:12]
    if store:
        project = store.project(config.project, config.commodity)
        store.append("runs", [(run_id, project, time.time(), None, "running", config.to_json(), VERSION)])
    try:
        result = _stages(spark, dem, meta, deposits, layers, out, config, magnetics, spec, warnings)
    except Exception:
        if store:
            store.append("runs", [(run_id, project, time.time(), time.time(), "failed", config.to_json(), VERSION)])
        raise
    if store:
        now = time.time()
        store.append("runs", [(run_id, project, now, now, "done", config.to_json(), VERSION)])
        store.append("metrics", [(run_id, k, float(v), now) for k, v in {**result.cv, **result.holdout}.items() if v is not None])
        store.append("artifacts", [(run_id, k, f"{out}/{k}", now) for k in ("features", "maps", "targets", "model", "report.md", "summary.md", "run_config.json")])
    return result


def _kept(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _terrain(spark, dem, meta, config, out) -> dict[str, DataFrame]:
    """The terrain layers, all from one chain of windows."""
    dx, dy = meta.metres()
    window = terrain.odd_window(config.terrain_scale_m, (dx + dy) / 2)
    faces = _kept(spark, terrain.surface(dem, meta, window), f"{out}/terrain")
    return {n: faces.select("r", "c", F.col(n).alias("v")) for n in ("tpi", "slope", "curvature", "aspect_sin", "aspect_cos")}


def _stages(spark, dem, meta, deposits, layers, out, config, magnetics, spec, warnings) -> Result:
    dx, dy = meta.metres()
    found = {**_terrain(spark, dem, meta, config, out), **layers}
    wide = _kept(spark, grid.stack(dem.filter("v IS NOT NULL").withColumnRenamed("v", "elevation"), found, meta), f"{out}/stack")
    names = []
    for s in grid.layer_stats(wide, list(found), config.least_valid).collect():  # one row for each layer
        if s["flat"] or s["sparse"] and s["layer"] in layers:
            warnings.append(f"layer {s['layer']} was left out: {s['n_valid']} valid cells")
        else:
            names.append(s["layer"])
    names = [n for n in found if n in names]
    if len(names) < 3:
        raise ValueError(f"{len(names)} usable layers are too few")
    features = _kept(spark, grid.median_fill(wide, names).select("r", "c", "elevation", *names), f"{out}/features")

    spots = dep.dedupe(deposits.join(features.select("r", "c"), ["r", "c"], "left_semi"))
    split = _kept(spark, dep.holdout(spots, meta.h, meta.w, config.holdout_fraction), f"{out}/deposits")
    train_spots, held = split.filter("NOT held"), split.filter("held")
    total = split.count()
    if total < spec["least"]:
        raise ValueError(f"{total} deposits are fewer than the {spec['least']} that {spec['label']} asks for")
    n = train_spots.count()

    near = _kept(spark, spatial.distance(split, meta), f"{out}/distance")
    pool = features.join(near, ["r", "c"])
    reach, need = spec["buffer_m"], config.negative_ratio * n
    while pool.filter(F.col("d") >= reach).count() < need and reach > max(dx, dy):
        reach = max(reach / 3, max(dx, dy))
    background = pool.filter(F.col("d") >= reach).drop("d")
    at = features.join(train_spots.select("r", "c"), ["r", "c"])
    weighed = _weighed(background, at)
    drawn = weighed if n >= 5 else background.withColumn("weight", F.lit(1.0))
    negatives = sampling.weighted_sample(drawn, need, seed=config.seed).select("r", "c", *names)
    samples = _kept(spark, at.select("r", "c", *names).withColumn("label", F.lit(1)).unionByName(negatives.withColumn("label", F.lit(0))), f"{out}/samples")

    folds = model.spatial_cv(samples, names, meta.h, meta.w, config.folds, max(20, config.trees // 4), config.seed)
    cv = {**metrics.cv_summary(folds).first().asDict(), "ap_mean": folds.agg(F.avg("ap")).first()[0]}
    trained = model.train(samples, names, config.trees, config.seed)
    trained.save(f"{out}/model", spark)
    p = trained.predict(features)
    if config.blend:
        warnings.append("blend is noted but not applied: priors are reported beside the probability")
    u = trained.uncertainty(features.select("r", "c", *names)).select("r", "c", "uncertainty")
    maps = p.join(u, ["r", "c"]).withColumn("class", scalar.prospectivity_class(F.col("probability")))
    cells = _kept(spark, maps, f"{out}/maps")

    holdout = _holdout(cells, held, weighed, config)
    row = spark.createDataFrame([(cv["auc_mean"], holdout.get("contrast_matched"), holdout.get("contrast"), holdout.get("hit_050"), bool(holdout))], "cv double, m double, u double, hit double, has boolean")
    inputs = [F.col(c) for c in ("cv", "m", "u", "hit", "has")]
    verdict, artifact = row.select(metrics.verdict(*inputs), metrics.artifact_note(F.col("m"), F.col("u"))).first()

    result = Result(cells, cells, cv, holdout, verdict, reasons(cv, holdout, artifact), trained.importances(), n, total - n, warnings=warnings)
    _depths(spark, result, layers.get(magnetics), meta, config, out)
    top = targets.suppress(targets.maxima(cells.select("r", "c", F.col("probability").alias("v")), meta, config.separation, config.threshold), config.separation, config.top)
    result.targets = _kept(spark, _describe(top, result, meta, split, features, names), f"{out}/targets")
    _text(f"{out}/report.md", report(result, config))
    _text(f"{out}/summary.md", summary(result, config))
    _text(f"{out}/run_config.json", config.to_json())
    return result


def _depths(spark, result: Result, field_: DataFrame | None, meta: Meta, config: Config, out: str) -> None:
    """The two depth rasters of a magnetic layer: spectra by window, filled and stretched over the grid, and Euler solutions."""
    if not config.depths:
        return
    if field_ is None:
        result.warnings.append("depths were not estimated: there is no magnetic layer")
        return
    size = min(config.depth_window, 1 << (min(meta.h, meta.w).bit_length() - 1))
    step = max(size // 2, 8)
    good = depth.spectral_depth(field_, meta, size).filter("r2 >= 0.5 AND depth IS NOT NULL")
    coarse = _kept(spark, good.select((F.col("win_r") / step).cast("int").alias("r"), (F.col("win_c") / step).cast("int").alias("c"), F.col("depth").alias("v")), f"{out}/depth-windows")
    if not coarse.isEmpty():
        small = Meta((meta.h - size) // step + 1, (meta.w - size) // step + 1)
        result.depth_spectral = _kept(spark, evidence.fill_and_stretch(coarse, small, meta), f"{out}/depth_spectral")
    solutions = _kept(spark, depth.euler(field_, meta, index=config.structural_index), f"{out}/euler")
    result.n_euler = solutions.count()
    if result.n_euler:
        row, col = grid.world_to_pixel(meta, F.col("x"), F.col("y"))
        result.depth_euler = _kept(spark, depth.box_depth(solutions.withColumns({"r": row, "c": col}), meta), f"{out}/depth_euler")


def _weighed(background: DataFrame, positives: DataFrame) -> DataFrame:
    both = background.withColumn("positive", F.lit(0)).unionByName(positives.withColumn("positive", F.lit(1)))
    binned = sampling.terrain_bins(both)
    return binned.filter("positive = 0").join(F.broadcast(sampling.terrain_weights(binned).select("bin", "weight")), "bin")


def _holdout(cells: DataFrame, held: DataFrame, weighed: DataFrame, config: Config) -> dict:
    """Hit rates of held-out deposits and their contrast with uniform and terrain-matched background; empty without any."""
    if held.isEmpty():
        return {}
    at = cells.join(held.select("r", "c"), ["r", "c"]).select(F.col("probability").alias("p"))
    out = metrics.holdout_stats(at).first().asDict()
    out = {"holdout_n": out["n"], "holdout_mean": out["mean"], "holdout_median": out["median"], "hit_050": out["hit_050"], "hit_070": out["hit_070"]}
    for name, pool in (("contrast", weighed.withColumn("weight", F.lit(1.0))), ("contrast_matched", weighed)):
        some = sampling.weighted_sample(pool, 5_000, seed=config.seed + 1).select("r", "c")
        scored = at.select(F.lit(1).alias("label"), F.col("p").alias("score")).unionByName(cells.join(some, ["r", "c"]).select(F.lit(0).alias("label"), F.col("probability").alias("score")))
        out[name] = metrics.roc_auc(scored).first()[0]
    return out


def _describe(top: DataFrame, result: Result, meta: Meta, split: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    x, y = grid.pixel_to_world(meta, F.col("r"), F.col("c"))
    lon, lat = crs.convert(x, y, meta.code(), "EPSG:4326")
    t = top.join(result.cells.select("r", "c", "probability", "uncertainty", "class"), ["r", "c"]).select("rank", "r", "c", x.alias("x"), y.alias("y"), lon.alias("longitude"), lat.alias("latitude"), "probability", "uncertainty", F.col("class").alias("target_class"))
    near = spatial.nearest(top, split.select("r", "c", "ord", "name"), *meta.metres(), keys=("rank",))
    t = t.join(near.select("rank", F.round(F.col("dist") / 1000, 2).alias("nearest_deposit_km"), F.coalesce("p_name", F.lit("deposit")).alias("nearest_deposit_name")), "rank", "left")
    pct = targets.percentile_of(features, top.select("rank", "r", "c").join(features, ["r", "c"]), names)
    t = t.join(targets.why(pct, dict(result.importances)), "rank", "left")
    for name, raster in (("depth_spectral_m", result.depth_spectral), ("depth_euler_m", result.depth_euler)):
        t = t.withColumn(name, F.lit(None).cast("double")) if raster is None else t.join(raster.withColumnRenamed("v", name), ["r", "c"], "left")
    return t.withColumn("depth_status", scalar.depth_status(F.col("depth_spectral_m"), F.col("depth_euler_m")))


def reasons(cv: dict, holdout: dict, artifact: bool) -> list[str]:
    """What the verdict rests on, in words."""
    out = ["no usable folds" if cv["auc_mean"] is None else f"block cross-validation AUC {cv['auc_mean']:.2f} over {cv['n_folds']} folds"]
    if holdout:
        matched = holdout.get("contrast_matched")
        out.append(f"held-out contrast AUC {holdout['contrast']:.2f}" + (f", {matched:.2f} against matched terrain" if matched is not None else "") + f"; {100 * holdout['hit_050']:.0f} % of held-out deposits at 0.50 or more")
    else:
        out.append("too few deposits to hold some out")
    if artifact:
        out.append("the contrast falls by more than 0.15 when the background's terrain is matched: the map may follow terrain")
    return out


def grade_statement(commodity: str) -> tuple[str, dict[str, float]]:
    """What is known of the grades of such deposits, with the figures: a reference for the population, never for a site."""
    spec = COMMODITIES[commodity]
    if "log10" in spec:
        mean, deviation = spec["log10"]
        figures = {f"P{p}": 10 ** (mean + deviation * NormalDist().inv_cdf(p / 100)) for p in (10, 25, 50, 75, 90)}
        told = f"{spec['type']} deposits are known with grades of {figures['P10']:.2f} (P10), {figures['P50']:.2f} (P50) and {figures['P90']:.2f} (P90) {spec['unit']}"
    else:
        low, high = spec["range"]
        figures = {"min": low, "max": high, "typical": (low + high) / 4}
        told = f"economic {spec['type']} deposits are known with grades from {low} to {high} {spec['unit']}"
    return f"If there is a deposit: {told} ({spec['reference']}). These are figures of the population, not of this site; drilling and assays alone establish grade.", figures


def _table(head: list[str], rows: list[list]) -> list[str]:
    return [f"| {' | '.join(map(str, r))} |" for r in (head, ["---"] * len(head), *rows)]


def _metres(v: float | None) -> str:
    return "-" if v is None else f"{v:.0f} m"


def report(result: Result, config: Config) -> str:
    """The validation report in Markdown, from small results."""
    spec, cv, held = COMMODITIES[config.commodity], result.cv, result.holdout
    lines = [f"# {spec['label']}: validation report", "", f"{result.n_train} deposits trained on, {result.n_held} held out. Deposit model: {spec['type']}.", "", "## Verdict", "", f"**{result.verdict}**", "", *[f"* {r}" for r in result.reasons]]
    lines += ["", "## Spatial cross-validation", "", "Folds are blocks of neighbouring cells; positives and negatives are dealt by their place.", ""]
    lines += [f"* AUC {cv['auc_mean']:.3f} +/- {cv['auc_std']:.3f}, average precision {cv['ap_mean']:.3f}, {cv['n_folds']} folds"] if cv["auc_mean"] is not None else ["* The samples lie too close together for block folds: treat the run as exploratory."]
    lines += ["", "## Held-out deposits", ""] + ([f"* {k}: {v if v is None else round(v, 4)}" for k, v in held.items()] or ["* Too few deposits."])
    lines += ["", "## Features", ""] + [f"* {n}: {100 * w:.1f} %" for n, w in result.importances[:10]]
    lines += ["", "## Depths", "", f"{result.n_euler} Euler solutions at structural index {config.structural_index}. Depths are those of magnetic sources under the sensor's datum, not of ore." if result.n_euler or result.depth_spectral is not None else "Not estimated."]
    lines += ["", "## Grades", "", grade_statement(config.commodity)[0], "No grade map is made: a probability of prospectivity says nothing of grade."]
    rows = result.targets.orderBy("rank").collect()  # config.top at most
    shown = [[r["rank"], f"{r['latitude']:.5f}", f"{r['longitude']:.5f}", f"{r['probability']:.3f}", "-" if r["uncertainty"] is None else f"{r['uncertainty']:.2f}", _metres(r["depth_spectral_m"]), _metres(r["depth_euler_m"]), f"{r['why'][0]['feature']} (P{r['why'][0]['percentile']})" if r["why"] else "-"] for r in rows[:15]]
    lines += ["", "## Targets", "", *_table(["rank", "latitude", "longitude", "probability", "uncertainty", "spectral", "Euler", "first driver"], shown)]
    tally = depth_tally([r["depth_status"] for r in rows])
    if any(tally.values()):
        lines += ["", "Depths of all targets: " + ", ".join(f"{n} {k}" for k, n in tally.items()) + "."]
    lines += ["", "## Limits", "", "* Deposits come from public records of mixed quality; negatives are cells without a record, not barren ground.", "* Well-explored ground has more records, so the map follows exploration as well as geology.", "* Ranks say where to look first. Only drilling finds a deposit."]
    if result.warnings:
        lines += ["", "## Warnings", "", *[f"* {w}" for w in result.warnings]]
    return "\n".join(lines) + "\n"


def depth_tally(status: list[str | None]) -> dict[str, int]:
    return {k: sum(s == k for s in status) for k in ("corroborated", "single-method", "discrepant")}


def summary(result: Result, config: Config) -> str:
    """One page for readers who are no specialists."""
    spec, auc = COMMODITIES[config.commodity], result.cv["auc_mean"]
    lines = [f"# {spec['label']}: where to look first", "", f"Terrain and survey data were compared with {result.n_train + result.n_held} known occurrences. Every cell has a score from 0 to 1 that tells how much it is like ground that holds them.", "", "## How far to trust it", ""]
    lines += [f"With known occurrences hidden, the score tells one of them from empty ground {100 * auc:.0f} times in 100; chance gives 50." if auc is not None else "The data did not allow a test."]
    if result.holdout:
        lines += [f"In a region that the model had not seen it scored {result.holdout['contrast']:.2f} of 1."]
    rows = result.targets.orderBy("rank").limit(10).collect()
    lines += ["", "## First targets", ""] + (_table(["rank", "latitude, longitude", "score", "source depth"], [[r["rank"], f"{r['latitude']:.4f}, {r['longitude']:.4f}", f"{r['probability']:.2f}", _metres(r["depth_spectral_m"] if r["depth_spectral_m"] is not None else r["depth_euler_m"])] for r in rows]) if rows else ["No cell reached the threshold."])
    lines += ["", "## What it does not say", "", "* A high score is a reason for a visit, not a discovery.", "* Depths are those of magnetic rock.", f"* {grade_statement(config.commodity)[0]}", "", "## Next", "", "1. Visit and sample the first five targets.", "2. Survey on the ground those that still look good.", "3. Drill the best."]
    return "\n".join(lines) + "\n"


def _text(path: str, text: str) -> None:
    fs, name = geotiff.place(path)
    fs.create_dir(name.rsplit("/", 1)[0])
    with fs.open_output_stream(name, compression=None) as f:
        f.write(text.encode())


def write_artifacts(spark: SparkSession, result: Result, dem: DataFrame, meta: Meta, config: Config, out: str) -> None:
    """Rasters as GeoTIFF and the targets as one CSV file beside the tables that the stages wrote."""
    epsg = int(meta.code()[5:] or 0)
    rasters = {"probability": result.cells.select("r", "c", F.col("probability").alias("v")), "uncertainty": result.cells.select("r", "c", F.col("uncertainty").alias("v")), "classes": result.cells.select("r", "c", F.col("class").alias("v")), "dem": dem}
    rasters |= {k: v for k, v in (("depth_spectral_m", result.depth_spectral), ("depth_euler_m", result.depth_euler)) if v is not None}
    for name, cells in rasters.items():
        geotiff.write(cells, meta, f"{out}/{name}.tif", epsg)
    targets.write_csv(result.targets, f"{out}/targets.csv", grade_statement(config.commodity)[0])


def value_grid(layer: DataFrame, meta: Meta, most: int = 220) -> DataFrame:
    """A layer thinned to at most `most` cells a side, for a viewer."""
    return grid.stride(layer, max(1, -(-max(meta.h, meta.w) // most)))


def query_point(layers: dict[str, DataFrame], top: DataFrame, meta: Meta, x: float, y: float) -> DataFrame:
    """One row: the cell under a point, its value in each layer and the nearest target."""
    spark = top.sparkSession
    at = spark.createDataFrame([(x, y)], "x double, y double")
    r, c = grid.world_to_pixel(meta, F.col("x"), F.col("y"))
    out = at.select(F.greatest(F.lit(0), F.least(r, F.lit(meta.h - 1))).alias("r"), F.greatest(F.lit(0), F.least(c, F.lit(meta.w - 1))).alias("c"))
    near = spatial.nearest(out, top.select("r", "c", F.col("rank").alias("ord"), "rank"), *meta.metres())
    for name, layer in layers.items():
        out = out.join(layer.select("r", "c", F.col("v").alias(name)), ["r", "c"], "left")
    return out.join(near.select("r", "c", F.col("p_rank").alias("target"), F.col("dist").alias("target_m")), ["r", "c"], "left")
