"""The prospectivity model: an adaptive random forest with calibration, uncertainty, spatial validation and transfer."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import metrics, sampling

VERSION = 2


def tier(n_pos: int) -> tuple[int, int]:
    """Depth and least leaf by the number of positives."""
    return (5, max(3, n_pos // 5)) if n_pos < 30 else (8, 4) if n_pos < 100 else (15, 5)


def balanced(samples: DataFrame) -> DataFrame:
    """samples with the weight n / (2 * rows of the label)."""
    n = {r["label"]: r["n"] for r in samples.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    total = sum(n.values())
    weights = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(total / (2 * v)))])
    return samples.withColumn("weight", weights[F.col("label")])


def _forest(names: list[str], n_pos: int, trees: int, seed: int) -> Pipeline:
    depth, leaf = tier(n_pos)
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=names, outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
            RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed, probabilityCol="probs", rawPredictionCol="votes"),
        ]
    )


def _positive(column: str) -> Column:
    return vector_to_array(F.col(column))[1]


@dataclass
class Trained:
    """The base forest, and for each calibration fold a forest with its sigmoid."""

    names: list[str]
    base: PipelineModel
    folds: list[tuple[PipelineModel, LogisticRegressionModel]]

    def importances(self) -> list[tuple[str, float]]:
        v = self.base.stages[-1].featureImportances.toArray()
        return sorted(zip(self.names, v.tolist(), strict=True), key=lambda x: (-x[1], x[0]))

    def predict(self, cells: DataFrame) -> DataFrame:
        """cells with probability: the mean of the calibrated forests; rows with a NULL feature get NULL."""
        whole = F.lit(True)
        for n in self.names:
            whole &= F.col(n).isNotNull()
        keys = cells.columns
        out, used = cells.filter(whole), []
        for i, (forest, sigmoid) in enumerate(self.folds):
            out = forest.transform(out).withColumn("_s", _positive("probs")).drop("raw", "features", "votes", "probs", "prediction")
            z = sigmoid.coefficients[0] * F.col("_s") + sigmoid.intercept
            out = out.withColumn(f"_p{i}", 1 / (1 + F.exp(-z))).drop("_s")
            used.append(F.col(f"_p{i}"))
        mean = sum(used[1:], used[0]) / len(used)
        return out.select(*keys, mean.alias("probability")).unionByName(cells.filter(~whole).withColumn("probability", F.lit(None).cast("double")))

    def uncertainty(self, cells: DataFrame, most: int = 25, every: int | None = None) -> DataFrame:
        """cells with the population deviation of single trees' probabilities, over every n-th tree: `every`, or as many as
        leave some `most` of them."""
        forest = self.base.stages[-1]
        trees = forest.trees[:: every or max(1, len(forest.trees) // most)]
        out = PipelineModel(self.base.stages[:-1]).transform(cells)
        keys, used = cells.columns, []
        for i, t in enumerate(trees):
            t = t.copy({t.featuresCol: "features", t.probabilityCol: f"_t{i}", t.rawPredictionCol: f"_r{i}", t.predictionCol: f"_q{i}"})
            out = t.transform(out).withColumn(f"_t{i}", _positive(f"_t{i}")).drop(f"_r{i}", f"_q{i}")
            used.append(F.col(f"_t{i}"))
        a = F.array(*used)
        mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / len(used)
        var = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / len(used)
        return out.select(*keys, F.sqrt(var).alias("uncertainty"))

    def save(self, path: str, spark: SparkSession) -> None:
        self.base.write().overwrite().save(f"{path}/base")
        for i, (forest, sigmoid) in enumerate(self.folds):
            forest.write().overwrite().save(f"{path}/forest{i}")
            sigmoid.write().overwrite().save(f"{path}/sigmoid{i}")
        note = json.dumps({"version": VERSION, "names": self.names, "folds": len(self.folds)})
        spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/note")


def load(path: str, spark: SparkSession) -> Trained:
    """A saved model; another schema version is an error."""
    note = json.loads(spark.read.text(f"{path}/note").first()[0])
    if note.get("version") != VERSION:
        raise ValueError(f"model schema {note.get('version')} is not {VERSION}")
    folds = [(PipelineModel.load(f"{path}/forest{i}"), LogisticRegressionModel.load(f"{path}/sigmoid{i}")) for i in range(note["folds"])]
    return Trained(note["names"], PipelineModel.load(f"{path}/base"), folds)


def train(samples: DataFrame, names: list[str], trees: int = 200, seed: int = 42, folds: int = 5) -> Trained:
    """A model of (r, c, label, names): each calibration fold fits a forest on the other folds and a sigmoid on its own.

    There are as many folds as rows of the rarer label allow, 2 to `folds`; with 0 the forest is not calibrated."""
    weighted = balanced(samples).persist()
    counts = {r["label"]: r["n"] for r in weighted.groupBy("label").agg(F.count("*").alias("n")).collect()}
    k = max(2, min(folds, min(counts.values())))
    part = F.pmod(F.xxhash64(F.lit(seed), "label", "r", "c"), F.lit(k))
    dealt = weighted.withColumn("_f", part)
    base = _forest(names, counts.get(1, 0), trees, seed).fit(weighted)
    fitted = []
    for i in range(k if folds else 0):
        rest, own = dealt.filter(F.col("_f") != i), dealt.filter(F.col("_f") == i)
        if own.select("label").distinct().count() < 2 or rest.select("label").distinct().count() < 2:
            continue
        forest = _forest(names, counts.get(1, 0), trees, seed + i).fit(rest)
        scored = forest.transform(own).select("label", _positive("probs").alias("s"))
        fitted.append((forest, _sigmoid(scored)))
    if folds and not fitted:
        fitted = [(base, _sigmoid(base.transform(weighted).select("label", _positive("probs").alias("s"))))]
    weighted.unpersist()
    return Trained(names, base, fitted)


def _sigmoid(scored: DataFrame) -> LogisticRegressionModel:
    """Platt's fit: each row counts for its smoothed target and, with the rest of its weight, against it."""
    n = {r["label"]: r["n"] for r in scored.groupBy("label").agg(F.count("*").alias("n")).collect()}
    high, low = (n.get(1, 0) + 1) / (n.get(1, 0) + 2), 1 / (n.get(0, 0) + 2)
    target = F.when(F.col("label") == 1, high).otherwise(low)
    both = scored.select("s", F.inline(F.array(F.struct(F.lit(1).alias("y"), target.alias("w")), F.struct(F.lit(0).alias("y"), (1 - target).alias("w")))))
    rows = VectorAssembler(inputCols=["s"], outputCol="x").transform(both)
    return LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", standardization=False).fit(rows)


def spatial_cv(samples: DataFrame, names: list[str], h: int, w: int, k: int = 5, trees: int = 50, seed: int = 42) -> DataFrame:
    """(fold, n, auc, ap) of the folds that have both labels on either side and five test rows or more."""
    dealt = sampling.folds(samples, h, w, k, seed).persist()
    rows = []
    for i in range(k):
        rest, own = dealt.filter(F.col("fold") != i), dealt.filter(F.col("fold") == i)
        seen = [d.agg(F.count_if(F.col("label") == 1), F.count("*")).first() for d in (rest, own)]
        if any(p == 0 or p == n for p, n in seen) or seen[1][1] < 5:
            continue
        scored = _forest(names, seen[0][0], trees, seed).fit(balanced(rest)).transform(own).select("label", _positive("probs").alias("score"))
        rows.append((i, seen[1][1], metrics.roc_auc(scored).first()[0], metrics.average_precision(scored).first()[0]))
    dealt.unpersist()
    return samples.sparkSession.createDataFrame(rows, "fold int, n long, auc double, ap double")


def aligned(cells: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """cells with exactly the model's features: those they lack are 0. Too few in common is an error."""
    have = [n for n in names if n in cells.columns]
    if len(have) < max(2, int(0.6 * len(names))):
        raise ValueError(f"only {len(have)} of the model's {len(names)} features are there")
    keys = [c for c in ("r", "c") if c in cells.columns]
    return cells.select(*keys, *[F.col(n) if n in have else F.lit(0.0).alias(n) for n in names]), have
