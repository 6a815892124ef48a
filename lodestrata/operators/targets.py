"""Ranked exploration targets: local maxima, greedy suppression, explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.grid import Meta
from lodestrata.operators.terrain import max_filter

#: Candidates that one round looks at.
BATCH = 10_000


def maxima(p: DataFrame, meta: Meta, separation: int, threshold: float) -> DataFrame:
    """The cells at least threshold that no cell of their window exceeds."""
    top = max_filter(p, meta, max(3, 2 * separation + 1)).withColumnRenamed("v", "top")
    return p.join(top, ["r", "c"]).filter((F.col("v") >= threshold) & (F.col("v") == F.col("top"))).select("r", "c", "v")


def suppress(candidates: DataFrame, separation: int, k: int = 25) -> DataFrame:
    """rank, r, c, v of up to k candidates, the best first (ties: larger r, then c), each at least separation from all kept.

    k rounds at most, each of the best BATCH rows: the first of them is kept, as what is too near the kept goes before a round."""
    held = candidates.select(F.col("r").cast("int"), F.col("c").cast("int"), F.col("v").cast("double")).persist()
    left, kept = held, []
    best = F.struct("v", "r", "c")
    try:
        while len(kept) < k:
            rows = left.orderBy(F.desc("v"), F.desc("r"), F.desc("c")).limit(BATCH).collect()
            done = len(kept)
            for row in rows:
                if all((row["r"] - a) ** 2 + (row["c"] - b) ** 2 >= separation**2 for a, b, _ in kept):
                    kept.append((row["r"], row["c"], row["v"]))
                    if len(kept) == k:
                        break
            if len(rows) < BATCH:
                break
            for a, b, _ in kept[done:]:
                left = left.filter((F.col("r") - a) ** 2 + (F.col("c") - b) ** 2 >= separation**2)
            last = rows[-1]
            left = left.filter(best < F.struct(F.lit(last["v"]), F.lit(last["r"]), F.lit(last["c"])))
        schema = "rank int, r int, c int, v double"
        return candidates.sparkSession.createDataFrame([(i + 1, int(a), int(b), float(v)) for i, (a, b, v) in enumerate(kept)], schema)
    finally:
        held.unpersist()


def percentile_of(values: DataFrame, targets: DataFrame, names: list[str]) -> DataFrame:
    """(rank, feature, percentile): the share of all cells under the target's value, in whole percent, half to even.

    One pass over the cells against the broadcast targets (25 rows)."""
    unpivot = lambda d, keys: d.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names])))
    t = unpivot(targets, ["rank"]).filter("x IS NOT NULL").withColumnRenamed("x", "t")
    v = unpivot(values, []).filter("x IS NOT NULL")
    under = F.avg((F.col("x") < F.col("t")).cast("double"))
    return v.join(F.broadcast(t), "feature").groupBy("rank", "feature").agg(F.bround(100 * under).cast("int").alias("percentile"))


def why(percentiles: DataFrame, importance: dict[str, float], k: int = 3) -> DataFrame:
    """(rank, why): a target's k most important features, with their percentiles."""
    weights = F.create_map(*[x for n, w in importance.items() for x in (F.lit(n), F.lit(float(w)))])
    w = Window.partitionBy("rank").orderBy(F.desc(weights[F.col("feature")]), "feature")
    top = percentiles.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k)
    listed = F.array_sort(F.collect_list(F.struct("i", "feature", "percentile")))
    return top.groupBy("rank").agg(F.transform(listed, lambda x: F.struct(x["feature"].alias("feature"), x["percentile"].alias("percentile"))).alias("why"))


def csv_rows(targets: DataFrame, drivers: int = 3) -> DataFrame:
    """The table of targets as fixed-format text, ready to be written."""
    fixed = lambda c, n: F.when(F.col(c).isNotNull(), F.format_string(f"%.{n}f", F.col(c).cast("double"))).otherwise("")
    out: list[Column] = [F.col("rank"), fixed("latitude", 6).alias("latitude"), fixed("longitude", 6).alias("longitude"), fixed("probability", 3).alias("probability"), fixed("uncertainty", 3).alias("uncertainty"), F.col("target_class"), fixed("depth_spectral_m", 0).alias("depth_spectral_m"), fixed("depth_euler_m", 0).alias("depth_euler_m"), F.coalesce("depth_status", F.lit("")).alias("depth_status"), fixed("nearest_deposit_km", 2).alias("nearest_deposit_km"), F.coalesce("nearest_deposit_name", F.lit("")).alias("nearest_deposit_name")]
    for i in range(drivers):
        d = F.get("why", F.lit(i))
        out += [F.coalesce(d["feature"], F.lit("")).alias(f"driver_{i + 1}"), F.coalesce(d["percentile"].cast("string"), F.lit("")).alias(f"driver_{i + 1}_percentile")]
    return targets.select(*out).orderBy("rank")


# The notes' names in the table of targets.
NOTES = ("GRADE CONTEXT", "NOTE")


def write_csv(targets: DataFrame, path: str, statement: str = "", drivers: int = 3) -> None:
    """One CSV file of the ranked targets, with what to know of grades and of the figures below them."""
    import csv
    import io

    from lodestrata.sources.geotiff import place

    rows = csv_rows(targets, drivers)
    text = io.StringIO()
    out = csv.writer(text)
    out.writerow(rows.columns)
    out.writerows([list(r) for r in rows.collect()])  # some 25 rows
    if statement:
        out.writerow([])
        out.writerow([NOTES[0], statement])
        out.writerow([NOTES[1], "Probabilities rank ground for follow-up and promise no discovery; depths are those of magnetic sources; only drilling measures grade."])
    fs, name = place(path)
    fs.create_dir(name.rsplit("/", 1)[0])
    with fs.open_output_stream(name, compression=None) as f:
        f.write(text.getvalue().encode())


def recovery(targets: DataFrame, truth: DataFrame, radius: int = 8, top: int = 15) -> DataFrame:
    """One row: how many of the first targets (rank, r, c) lie within radius cells of a true place (r, c), and of how many.

    A target asks the squares of radius cells that its circle meets, nine at most, so places are joined by square."""
    square = lambda at: F.floor(at / radius)
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    t = targets.filter(F.col("rank") <= top).select("rank", "r", "c", F.explode(steps).alias("a")).select("rank", "r", "c", "a", F.explode(steps).alias("b"))
    t = t.select("rank", F.col("r").alias("tr"), F.col("c").alias("tc"), (square(F.col("r")) + F.col("a")).alias("i"), (square(F.col("c")) + F.col("b")).alias("j"))
    w = truth.select("r", "c", square(F.col("r")).alias("i"), square(F.col("c")).alias("j"))
    near = F.min((F.col("tr") - F.col("r")) ** 2 + (F.col("tc") - F.col("c")) ** 2)
    by = F.broadcast(t).join(w, ["i", "j"]).groupBy("rank").agg(near.alias("d"))
    hits = by.filter(F.col("d") <= radius**2).agg(F.count("*").alias("hits"))
    return hits.crossJoin(targets.filter(F.col("rank") <= top).agg(F.count("*").alias("n")))  # one row each
