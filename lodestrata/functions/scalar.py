"""Scalar expressions: classes, labels, priors, grades and the inverse normal distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Coefficients of Acklam's rational approximation of the inverse normal distribution.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
#: log10 of the copper grade: mean and deviation (Singer and others, 2008); grade ranges for maps.
COPPER_LOG10 = (-0.357, 0.227)
COPPER_RANGE, REE_RANGE = (0.15, 1.5), (0.5, 10.0)


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for k in coefficients[1:]:
        out = out * x + k
    return out


def ppf(p: Column) -> Column:
    """The standard normal's inverse distribution, to about 1e-9; NULL outside (0, 1)."""
    tail = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    low = _poly(_C, tail) / _poly(_D, tail)
    q = p - 0.5
    middle = _poly(_A, q * q) * q / _poly(_B, q * q)
    return F.when((p > 0) & (p < 1), F.when(p < 0.02425, low).when(p > 1 - 0.02425, -low).otherwise(middle))


def clip(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def grade_at(p: Column, mean: float = COPPER_LOG10[0], deviation: float = COPPER_LOG10[1]) -> Column:
    """The grade of a population percentile: a reference figure, not an assay."""
    return F.pow(F.lit(10.0), mean + deviation * ppf(p))


def prospectivity_class(p: Column) -> Column:
    """0, 1 or 2 at 0.5 and 0.7; NULL stays."""
    return F.when(p >= 0.7, 2).when(p >= 0.5, 1).when(p.isNotNull(), 0)


def depth_status(spectral: Column, euler: Column) -> Column:
    apart = F.abs(spectral - euler) / F.greatest((spectral + euler) / 2, F.lit(1e-6))
    return F.when(apart <= 0.35, "corroborated").when(apart.isNotNull(), "discrepant").when(spectral.isNotNull() | euler.isNotNull(), "single-method")


def copper_prior(fault: Column, magnetics: Column, gravity: Column, streams: Column, geochem: Column, alteration: Column) -> Column:
    structural = clip(0.65 * fault + 0.2 * magnetics + 0.15 * gravity)
    hydrothermal = clip(0.7 * alteration + 0.3 * geochem)
    return clip(0.45 * structural + 0.45 * hydrothermal + 0.10 * streams)


def ree_prior(fault: Column, magnetics: Column, gravity: Column, streams: Column, pathfinder: Column, alkaline: Column) -> Column:
    structural = clip(0.55 * fault + 0.25 * magnetics + 0.20 * gravity)
    trap = clip(0.60 * pathfinder + 0.25 * alkaline + 0.15 * streams)
    return clip(0.45 * structural + 0.55 * trap)


def blend(p: Column, prior: Column, weight: float) -> Column:
    return clip((1 - weight) * p + weight * prior)


def copper_grade_map(p: Column, geochem: Column, p95: Column) -> Column:
    """A reference grade per cell, with 30 % from geochemistry where it is positive; 0 where p is under 0.20."""
    low, high = COPPER_RANGE
    model = grade_at(clip(p, 0.05, 0.95))
    measured = low + clip(geochem / p95) * (high - low)
    mixed = F.when(geochem > 0, 0.7 * model + 0.3 * measured).otherwise(model)
    return F.when(p < 0.20, 0.0).otherwise(clip(mixed, 0.0, high))


def auc_word(auc: Column) -> Column:
    return F.when(auc >= 0.90, "excellent").when(auc >= 0.80, "good").when(auc >= 0.70, "moderate").otherwise("limited")


def probability_label(p: Column) -> Column:
    return F.when(p > 0.7, "HIGH").when(p > 0.4, "MEDIUM").otherwise("LOW")


def grade_band(grade: Column, commodity: str) -> Column:
    high, middle, low = (1.0, 0.5, 0.3) if commodity == "copper" else (5.0, 2.0, 1.0)
    return F.when(grade >= high, "high").when(grade >= middle, "medium").when(grade >= low, "low").otherwise("sub-economic")


def feature_hash(names: Column) -> Column:
    return F.substring(F.sha2(F.array_join(names, "|"), 256), 1, 16)


def family_shares(weights: DataFrame, families: dict[str, str]) -> DataFrame:
    """(family, pct, dominant) of feature weights: terrain dominates above 70 %, any other family above 30 %."""
    named = F.create_map(*[F.lit(x) for k, v in families.items() for x in (k, v)])
    by = weights.groupBy(F.coalesce(F.try_element_at(named, F.col("feature")), F.lit("other")).alias("family")).agg(F.sum("weight").alias("w"))
    pct = 100 * F.col("w") / F.sum("w").over(Window.partitionBy())
    return by.withColumn("pct", pct).select("family", "pct", F.when(F.col("family") == "terrain", F.col("pct") > 70).otherwise(F.col("pct") > 30).alias("dominant"))
