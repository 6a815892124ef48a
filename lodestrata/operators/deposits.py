"""Labelled points: filters, scores, duplicates and spatial holdouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.ranks import quantiles

# Words that name a commodity, and the confidence of a development status.
COMMODITY = {
    "copper": ("cu", "copper"),
    "ree": ("ree", "rare earth", "rare-earth", "lanthanum", "cerium", "neodymium", "yttrium", "monazite", "bastnaesite", "bastnasite"),
}
STATUS = {"producer": 4, "past producer": 4, "past-producer": 4, "plant": 3, "mine": 3, "prospect": 2, "occurrence": 1, "": 1}


def is_commodity(text: Column, commodity: str, empty_passes: bool = False) -> Column:
    """Whether a commodity's word occurs anywhere in text, in any case (substrings count)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for w in COMMODITY[commodity]:
        hit |= F.contains(low, F.lit(w))
    return hit | (F.trim(low) == "") if empty_passes else hit


def status_rank(status: Column, ranks: dict[str, int] | None = None) -> Column:
    """Confidence of a status; an unknown one counts 1."""
    ranks = ranks or STATUS
    known = F.create_map(*[F.lit(x) for k, v in ranks.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(F.coalesce(status, F.lit(""))))), F.lit(1))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit |= F.contains(text, F.lit(w))
    return hit


def _token(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))


def score(blob: Column, tokens: Column, commodity: str) -> Column:
    """Additive evidence of a record: blob is all its text, tokens its commodity names, both in lower case."""
    # The evidence words and their weights.
    if commodity == "copper":
        rules = [
            (_token(tokens, ("copper", "cu")), 3.0),
            (_any(blob, ("porphyry",)), 4.0),
            (_any(blob, ("chalcopyrite", "bornite", "molybdenite", "potassic", "phyllic", "argillic")), 1.5),
            (_token(tokens, ("molybdenum", "gold", "silver")), 0.75),
            (_any(blob, ("skarn", "vein")), -1.0),
            (_any(blob, ("occurrence",)), -0.5),
        ]
    else:
        rules = [
            (_token(tokens, ("ree",)) | _any(blob, ("rare earth",)), 4.0),
            (_any(blob, ("monazite", "bastnaesite", "xenotime", "allanite", "parisite", "synchysite", "eudialyte", "loparite", "apatite", "pyrochlore")), 2.5),
            (_any(blob, ("carbonatite", "alkaline", "peralkaline", "fenite", "fenit", "alkalic")), 2.0),
            (_token(tokens, ("thorium", "niobium (columbium)", "niobium", "tantalum", "uranium")), 0.8),
            (_token(tokens, ("phosphorus-phosphates",)) | _any(blob, ("phosphate", "apatite")), 0.8),
            (_any(blob, ("occurrence",)), -0.5),
        ]
    total = F.lit(0.0)
    for test, weight in rules:
        total = total + F.when(test, F.lit(weight)).otherwise(0.0)
    return total


def dedupe(deposits: DataFrame) -> DataFrame:
    """One deposit for each cell: the highest rank, then the first by ord."""
    w = Window.partitionBy("r", "c").orderBy(F.desc("rank"), "ord")
    return deposits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def quadrant(r: Column, c: Column, mid_r: Column | float, mid_c: Column | float) -> Column:
    return F.when(r >= mid_r, 2).otherwise(0) + F.when(c >= mid_c, 1).otherwise(0)


def holdout(deposits: DataFrame, h: int, w: int, fraction: float = 0.25, least: int = 10) -> DataFrame:
    """deposits with `held`: those of the quadrant whose count is nearest to fraction of all, or none where there are too few."""
    q = deposits.withColumn("q", quadrant(F.col("r"), F.col("c"), h // 2, w // 2))
    counts = q.groupBy("q").agg(F.count("*").alias("n"))  # four rows at most
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy()))
    diff = F.abs(F.col("n") - fraction * F.col("total"))
    pick = counts.orderBy(diff, "q").limit(1).select(F.col("q").alias("_q"), ((F.col("total") >= least) & (F.col("n") <= F.floor(F.col("total") / 2)) & F.lit(fraction > 0)).alias("_ok"))
    return q.crossJoin(F.broadcast(pick)).select(*deposits.columns, "q", (F.col("_ok") & (F.col("q") == F.col("_q"))).alias("held"))


def holdout_median(deposits: DataFrame, least: int = 8, share: float = 0.15) -> DataFrame:
    """deposits with `held`: the fullest quadrant about the median point (ties: the lowest), if it holds share of all."""
    middle = quantiles(deposits, ["r", "c"], [0.5])
    q = deposits.withColumn("q", quadrant(F.col("r"), F.col("c"), middle["r"][0] or 0.0, middle["c"][0] or 0.0)).crossJoin(F.broadcast(deposits.agg(F.count("*").alias("_n"))))
    pick = q.groupBy("q", "_n").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "q").limit(1)
    ok = (F.col("_n") >= least) & (F.col("k") >= F.greatest(F.lit(2), F.floor(share * F.col("_n"))))
    return q.drop("_n").crossJoin(F.broadcast(pick.select(F.col("q").alias("_q"), ok.alias("_ok")))).select(*deposits.columns, "q", (F.col("_ok") & (F.col("q") == F.col("_q"))).alias("held"))
