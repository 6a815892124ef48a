"""Validation metrics by exact ranks and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata import store
from lodestrata.operators.ranks import quantiles

def _running(by: DataFrame, names: list[str]) -> DataFrame:
    """by (a row for each distinct score) with the sums of names over all lower scores, as below_NAME.

    Scores are dealt to tasks by ranges and stored once, so no task sorts them all and what is above is computed once; the
    totals of the lower ranges, a row for each task, are added."""
    by = store.stored(by.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "scores")
    totals = by.groupBy("part").agg(*[F.sum(n).alias(n) for n in names])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    lower = totals.select("part", *[F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(f"lower_{n}") for n in names])
    within = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    sums = [(F.coalesce(F.sum(n).over(within), F.lit(0.0)) + F.col(f"lower_{n}")).alias(f"below_{n}") for n in names]
    return by.join(F.broadcast(lower), "part").select("score", *names, *sums)


def roc_auc(scored: DataFrame) -> DataFrame:
    """auc of (label, score): the Mann-Whitney statistic with ties counted half. Counts by distinct score, then running sums
    by range of scores, so rows are aggregated before they meet."""
    by = scored.groupBy("score").agg(F.sum("label").cast("double").alias("p"), F.sum(1 - F.col("label")).cast("double").alias("n"))
    s = _running(by, ["p", "n"]).select("p", "n", (F.col("p") * (F.col("below_n") + F.col("n") / 2)).alias("u"))
    return s.agg((F.sum("u") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0.0))).alias("auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """ap of (label, score): precision summed over the steps of recall, by falling distinct score."""
    by = scored.groupBy("score").agg(F.sum("label").cast("double").alias("p"), F.count("*").cast("double").alias("k"))
    total = by.agg(F.sum("p").alias("all_p"), F.sum("k").alias("all_k"))
    s = _running(by, ["p", "k"]).crossJoin(F.broadcast(total))  # one row
    precision = (F.col("all_p") - F.col("below_p")) / (F.col("all_k") - F.col("below_k"))
    return s.agg((F.sum(F.col("p") * precision) / F.nullif(F.sum("p"), F.lit(0.0))).alias("ap"))


def holdout_stats(p: DataFrame) -> DataFrame:
    """One row: count, mean, median, third quartile and hit rates of p."""
    p = store.stored(p.select("p"), "holdout")
    middle, third = quantiles(p, ["p"], [0.5, 0.75])["p"]
    rate = lambda t: F.avg((F.col("p") >= t).cast("double"))
    return p.agg(F.count("p").alias("n"), F.avg("p").alias("mean"), F.lit(middle).cast("double").alias("median"), F.lit(third).cast("double").alias("p75"), rate(0.5).alias("hit_050"), rate(0.7).alias("hit_070"))


def classification_report(labelled: DataFrame) -> DataFrame:
    """precision, recall, f1 and support of each label against pred."""
    by = labelled.groupBy("label", "pred").agg(F.count("*").alias("n"))
    role = lambda c, had, said: F.struct(F.col(c).alias("class"), F.lit(had).alias("had"), F.lit(said).alias("said_"))
    c = by.select("label", "pred", "n", F.inline(F.array(role("label", 1, 0), role("pred", 0, 1))))
    both = F.sum(F.when((F.col("had") == 1) & (F.col("label") == F.col("pred")), F.col("n")).otherwise(0))
    had, said = F.sum(F.col("had") * F.col("n")), F.sum(F.col("said_") * F.col("n"))
    div = lambda a, b: F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
    s = c.groupBy("class").agg(both.alias("tp"), had.alias("support"), said.alias("said"))
    s = s.select("class", div(F.col("tp"), F.col("said")).alias("precision"), div(F.col("tp"), F.col("support")).alias("recall"), "support")
    return s.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of auc over folds; NULL without folds."""
    return folds.agg(F.count("auc").alias("n_folds"), F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"))


def verdict(cv: Column, matched: Column, naive: Column, hit: Column, has_holdout: Column) -> Column:
    """The headline verdict: cv is NULL without folds."""
    chosen = F.coalesce(matched, naive)
    skilled = F.coalesce(cv >= 0.70, F.lit(False))
    carried = F.coalesce(chosen >= 0.70, F.lit(False)) & (F.coalesce(hit, F.lit(0.0)) >= 0.50)
    return (
        F.when(cv < 0.60, "NO_SIGNAL")
        .when(has_holdout & carried & skilled, "VALIDATED")
        .when(has_holdout & skilled, "ARTIFACT")
        .when(has_holdout | skilled, "WEAK")
        .otherwise("NO_SIGNAL")
    )


def artifact_note(matched: Column, naive: Column) -> Column:
    return F.coalesce(naive - matched > 0.15, F.lit(False))
