"""Mixing sources to target weights by pivotal dependent rounding.

Sources in order of code point, null last, weigh WEIGHTS in turn and share SHARE of all words; a target stops at CAP
times its source's size and the excess is reshared by weight until none is above. A document's copies have the mean
target / source size: the whole part is certain, the fraction is a probability.

The fractions are rounded in pairs: mass, in words, moves at random from one document of a pair to the other until one
has a whole number of copies, in such a way that each keeps its mean and the pair its words. The other goes on to the
next pair. A source's words are therefore met but for its last document, which goes to the nearer side.

Scale: documents are narrow rows (key, size) in groups by source and hash, about GROUP each, whatever the input splits;
each group is paired by itself and leaves one residual, and residuals meet FAN groups at a time in a reduction tree. A
source with a third of all rows is many groups. Draws are hashes of keys and a seed, so reruns agree.

Defined cases: a null text has size 0; documents of size 0 are rounded one by one by their hash; a null source is a
source of its own, and its documents mix like others; rows that share doc_id, source and size are one unit that gets the
same number of copies each; a source of size 0 has target 0; an empty table gives no rows; a very long text is one
document of its size; an input column named copy is replaced, other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
GROUP = 2_000
FAN = 64
SEED = 42
EPS = 1e-9


def size(text: Column) -> Column:
    """Words of a text: each begins where a word character follows none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(common.WORD)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target. Sources are numbered by ranges and their water level is found by sums over all of them, so
    that there may be as many sources as documents."""
    by = common.stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    place = F.pmod(F.col("_at"), F.lit(len(weights))).cast("int")
    by = common.numbered(by, "_at", F.asc_nulls_last("source"), tag="mix-ordered")
    by = by.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), place)).withColumn("most", cap * F.col("source_size")).drop("_at")
    whole = share * (by.agg(F.sum("source_size")).first()[0] or 0)
    # Water level: what full sources leave, by the weight of the others. Each round more sources are full, until none is added.
    level, full = 0.0, -1
    while True:
        is_full = F.col("most") <= F.col("w") * F.lit(level)
        n, held, rest = by.agg(F.count_if(is_full), F.sum(F.when(is_full, F.col("most"))), F.sum(F.when(~is_full, F.col("w")))).first()
        if rest is None:  # all are full, or there are none
            return by.select("source", "source_size", F.col("most").alias("target"))
        if n == full:
            return by.select("source", "source_size", F.least("most", F.col("w") * F.lit(level)).alias("target"))
        level, full = (whole - (held or 0.0)) / rest, n


def _draw(a: int, b: int) -> float:
    """A number in [0, 1) from two hashes."""
    m = (1 << 64) - 1
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + SEED) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def round_group(keys: list[int], mass: list[float], p: list[float]) -> tuple[list[int], int, float]:
    """0 or 1 for each, but for the place of a residual (-1: none) with its probability."""
    out = [0] * len(keys)
    held, q = -1, 0.0
    for i, x in enumerate(p):
        if x <= EPS or x >= 1 - EPS:
            out[i] = int(x > 0.5)
        elif mass[i] <= 0:
            out[i] = int(_draw(keys[i], 0) < x)
        elif held < 0:
            held, q = i, x
        else:
            a, b = mass[held], mass[i]
            up = min((1 - q) * a, x * b)  # words that may move to the held one
            down = min(q * a, (1 - x) * b)
            if _draw(keys[held], keys[i]) < down / (up + down):
                q, x = q + up / a, x - up / b
            else:
                q, x = q - down / a, x + down / b
            whole_i, whole_h = x <= EPS or x >= 1 - EPS, q <= EPS or q >= 1 - EPS
            if whole_h:
                out[held] = int(q > 0.5)
                held = -1
            if whole_i:
                out[i] = int(x > 0.5)
            elif held < 0:
                held, q = i, x
    return out, held, q


def _level(rows: DataFrame, last: bool) -> DataFrame:
    """One level of the tree: rows of each (src, grp) are rounded; q is null where copies are settled."""
    common.ship(rows.sparkSession)
    columns = ["doc_id", "source", "size", "m", "src", "grp", "key", "whole", "q"]
    ordered = rows.select(*columns).repartition("src", "grp").sortWithinPartitions("src", "grp", F.desc("size"), "key", "doc_id")

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, m, key, q = (batch.column(i).to_numpy() for i in (2, 3, 6, 8))
        whole = batch.column(7).to_numpy().copy()
        taken, held, left = round_group(key.view(np.uint64).tolist(), (size * m).astype(float).tolist(), q.tolist())
        if held >= 0 and last:
            taken[held], held = int(left >= 0.5), -1  # the root's residual: the nearer side keeps its source closest to the target
        rest = np.arange(len(q)) == held
        whole += np.where(rest, 0, np.array(taken, whole.dtype))
        return pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(whole), pa.array(np.full(len(q), left), mask=~rest)], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            ids = list(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True))
            at = 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or ids[i] != ids[at]:
                    if parts and ids[at] != now:
                        yield settle(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])
                        parts = []
                    now = ids[at]
                    parts.append(batch.slice(at, i - at))
                    at = i
        if parts:
            yield settle(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.select(*columns).schema])
    return ordered.mapInArrow(run, schema)


def units(sized: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, m (rows), source_size, target and copies of each unit."""
    goal = common.stored(targets(sized, **how).withColumn("src", F.xxhash64("source")), "mix-targets")
    unit = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))
    joined = unit.join(common.maybe_broadcast(goal), unit["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.xxhash64("doc_id", "source", "size", F.lit(SEED))
    rows = joined.select("doc_id", "source", "size", "m", "src", key.alias("key"), F.floor(mean + EPS).cast("long").alias("whole"), F.greatest(mean - F.floor(mean + EPS), F.lit(0.0)).alias("q"))
    n = unit.count()
    groups = max(1, -(-n // GROUP))
    rows = rows.withColumn("grp", F.pmod("key", F.lit(groups)))
    settled, last = None, False
    while not last:
        last = groups == 1
        done = common.stored(_level(rows, last), "mix-level")
        part = done.filter(F.col("q").isNull())
        settled = part if settled is None else settled.unionByName(part)
        groups = -(-groups // FAN)
        rows = done.filter(F.col("q").isNotNull()).withColumn("grp", (F.col("grp") / FAN).cast("long"))
    out = settled.join(common.maybe_broadcast(goal.select("src", "source_size", "target")), "src")
    return out.select("doc_id", "source", "size", "m", "source_size", "target", F.col("whole").alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs, each row repeated as often as the mix takes it, with copy (1, 2, ...)."""
    base = common.without(docs, "copy")
    sized = common.stored(base.select("doc_id", "source", size(F.col("text")).alias("size")), "mix-sizes")
    u = common.stored(units(sized, **how).filter("copies > 0").select("doc_id", "source", "size", "copies"), "mix-units")
    rows = base.select("doc_id", "source", size(F.col("text")).alias("size"), F.struct(*base.columns).alias("row")).alias("d")
    same = F.expr("d.doc_id <=> u.doc_id AND d.source <=> u.source AND d.size = u.size")
    joined = rows.join(common.maybe_broadcast(u).alias("u"), same)
    return joined.select("d.row.*", F.explode(F.sequence(F.lit(1), F.col("u.copies").cast("int"))).alias("copy"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    sized = common.stored(docs.select("doc_id", "source", size(F.col("text")).alias("size")), "mix-sizes")
    out = units(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("_k"))
    return out.drop("_k")
