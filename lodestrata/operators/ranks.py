"""Exact order statistics of many columns at once, by counts between marks that close in."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata import store
from lodestrata.deploy import ship

#: Parts into which a round splits each range that holds a rank.
PARTS = 64
_SIGN = np.int64(0x7FFFFFFFFFFFFFFF)


def _keys(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of doubles."""
    k = np.ascontiguousarray(v, np.float64).view(np.int64)
    return np.where(k < 0, k ^ _SIGN, k)


def _value(key: int) -> float:
    k = np.int64(key)
    return float((k ^ _SIGN if k < 0 else k).view(np.float64))


def _counter(marks: dict[int, list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, own in marks.items():
                v = batch.column(i).drop_null().to_numpy()
                if len(v):
                    k = _keys(v)
                    bucket = np.searchsorted(np.array(own, np.int64), k)
                    n = np.bincount(bucket, minlength=len(own) + 1)
                    low, high = np.full(len(n), np.iinfo(np.int64).max), np.full(len(n), np.iinfo(np.int64).min)
                    np.minimum.at(low, bucket, k)
                    np.maximum.at(high, bucket, k)
                    out += [(i, b, int(n[b]), int(low[b]), int(high[b])) for b in np.flatnonzero(n).tolist()]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.int64()] * 4), strict=True)], names=["i", "bucket", "n", "low", "high"])

    return run


def _counts(base: DataFrame, marks: dict[int, list[int]]) -> dict[int, list[tuple[int, int, int]]]:
    """Of each column, count, least and largest key between its marks: one job, a row for each range."""
    seen = base.mapInArrow(_counter(marks), "i int, bucket long, n long, low long, high long")
    out = defaultdict(list)
    for r in seen.groupBy("i", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).sort("i", "bucket").collect():
        out[r["i"]].append((r["n"], r["low"], r["high"]))
    return out


def quantiles(rows: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact percentiles of each column, interpolated linearly; None without values. NULLs do not count.

    The columns are stored once. Each round counts them all between marks; the ranges that hold a rank are split on until they
    hold one value. Rounds do not grow with the columns and hardly with the rows, and no buffer holds the values."""
    ship(rows.sparkSession)
    base = store.stored(rows.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]), "quantiles")
    counts = _counts(base, {i: [] for i in range(len(columns))})
    sizes = {i: sum(n for n, _, _ in counts.get(i, [])) for i in range(len(columns))}
    at = {i: [p * (n - 1) for p in shares] for i, n in sizes.items() if n}
    ranges: dict[tuple[int, int], tuple[int, int]] = {}
    while True:
        for i, places in at.items():
            for rank in {int(f(x)) for x in places for f in (math.floor, math.ceil)}:
                if (i, rank) in ranges and ranges[i, rank][0] == ranges[i, rank][1]:
                    continue
                below = 0
                for n, low, high in counts[i]:
                    if rank < below + n:
                        ranges[i, rank] = low, high
                        break
                    below += n
        marks = defaultdict(set)
        for (i, _), (low, high) in ranges.items():
            if low < high:
                marks[i] |= {low - 1, high, *(low + (high - low) * j // PARTS for j in range(1, PARTS))}
        if not marks:
            break
        counts = _counts(base, {i: sorted(m) for i, m in marks.items()})
    store.release(base)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        ends = [(_value(ranges[i, math.floor(x)][0]), _value(ranges[i, math.ceil(x)][0]), x - math.floor(x)) for x in at.get(i, [])]
        out[c] = [a if w == 0 else a * (1 - w) + b * w for a, b, w in ends] if ends else [None] * len(shares)
    return out
