"""Multidimensional clustered layout: coordinates by exact cut values, Z-order, files of equal size, cell queries.

A value's coordinate is the number of cuts that are smaller; the cuts of n rows and `cells` cells are the cells - 1 order
statistics at the ranks ceil(k * n / cells) - 1, so the coordinate is floor(cells * smaller / n). They are found by counting
bisection: each round is one distributed count of all dimensions by the middles of all open ranges, and ranges close in on
values that occur, so a round count does not grow with the rows. Strings are bisected seven bytes at a time; only ranks whose
seven bytes are not yet a whole string go on to the next seven. Coordinates are then a binary search in an expression.

Scale: rows are narrow and are stored once; a round brings a row for each range of each dimension to the driver, a number that
the cells bound. Rows are sorted by ranges of (z, key), so that a cell with a third of all rows is many tasks; a place in the
order is the place in its task and the sizes of the tasks before. Files have equally many rows. What queries touch is counted by
cell, of which there are cells ** dimensions at most, from each file's bounds and from the distinct cells of each file.

Defined cases: null is smaller than all values; ties share a coordinate and are ordered by key, then by the dimensions, and
whole repeats are interchangeable; a null key is the smallest; a dimension of one value has coordinate 0 everywhere; empty and
very long strings are values like others; an empty table gives no rows; input columns named like the results are replaced,
other columns pass.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm import common

CELLS = 8
FILE = 1_000
#: Parts into which a round splits a range.
WAYS = 16
#: Bytes of a string that are bisected at once.
STEP = 7
#: Stands for a null number while numbers are bisected; numbers are larger.
NULL = -(1 << 62)
#: Cells of a grid whose counts may be broadcast.
GRID = 65_536


def _bytes(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def _chunk(raw: Column, level: int) -> Column:
    """The bytes of a level as a number that orders like them: the bytes, zero behind the end, then how many they are."""
    part = F.substring(raw, level * STEP + 1, STEP)
    number = F.conv(F.rpad(F.hex(part), 2 * STEP, "0"), 16, 10).cast("long") * 8 + F.length(part)
    return F.when(raw.isNull(), F.lit(-1)).otherwise(number)


def _search(value: Column, cuts: list, at: int = 0) -> Column:
    """How many of the sorted literals are smaller than value: a binary search. A null literal is smaller than all but null."""
    if not cuts:
        return F.lit(at)
    mid = len(cuts) // 2
    smaller = value.isNotNull() if cuts[mid] is None else F.coalesce(value > F.lit(cuts[mid]), F.lit(False))
    return F.when(smaller, _search(value, cuts[mid + 1 :], at + mid + 1)).otherwise(_search(value, cuts[:mid], at))


class _Cut:
    """An order statistic that is being sought: its rank among the rows that begin with prefix, and the range that holds it."""

    def __init__(self, rank: int, prefix: bytes = b""):
        self.rank, self.prefix, self.low, self.high, self.below = rank, prefix, None, None, 0

    @property
    def closed(self) -> bool:
        return self.low is not None and self.low == self.high

    def middles(self) -> set[int]:
        """Ends and inner points of the range."""
        if self.low is None or self.closed:
            return set()
        return {self.low - 1, self.high, *(self.low + (self.high - self.low) * j // WAYS for j in range(1, WAYS))}


def order_statistics(rows: DataFrame, dims: list[str], ranks: list[int]) -> dict[str, list]:
    """The values at the ranks (from 0, null first) of each dimension, by counting bisection over stored rows. Dimensions are
    strings or whole numbers."""
    common.ship(rows.sparkSession)
    text = {d for d in dims if rows.schema[d].dataType.typeName() == "string"}
    open_ = {d: [_Cut(r) for r in ranks] for d in dims}
    found: dict[str, dict[int, object]] = {d: {} for d in dims}
    cuts = {d: list(zip(ranks, open_[d], strict=True)) for d in dims}
    level = 0
    while any(cuts.values()):
        later = defaultdict(list)
        for rank, cut, value, below in _level(rows, cuts, text, level):
            d = cut.dim
            if d not in text:
                found[d][rank] = value
            elif value == -1:
                found[d][rank] = None
            else:
                size = value % 8
                prefix = cut.prefix + (value // 8).to_bytes(STEP, "big")[:size]
                if size < STEP:
                    found[d][rank] = prefix.decode()
                else:
                    later[d].append((rank, _Cut(cut.rank - below, prefix)))
        cuts, level = later, level + 1
    return {d: [found[d][r] for r in ranks] for d in dims}


def _level(rows: DataFrame, cuts: dict, text: set[str], level: int):
    """Bisects the open cuts of a level to one value each: (rank, cut, value, rows of its prefix that are smaller)."""
    own, columns, prefixes = [], [], {}
    for d, some in cuts.items():
        for _, cut in some:
            cut.dim = d
        own += some
        if some:
            prefixes[d] = list(dict.fromkeys(cut.prefix for _, cut in some))
            raw = _bytes(F.col(d))
            columns.append((_chunk(raw, level) if d in text else F.coalesce(F.col(d).cast("long"), F.lit(NULL))).alias(f"v_{d}"))
            group = F.lit(0 if level == 0 else -1)
            for k, prefix in enumerate(prefixes[d] if level else []):
                group = F.when(F.substring(raw, 1, level * STEP) == F.lit(prefix), F.lit(k)).otherwise(group)
            columns.append(group.alias(f"g_{d}"))
    numbers = common.stored(rows.select(*columns), "layout-numbers")
    while True:
        bounds = {(d, k): sorted({m for _, c in cuts[d] if c.prefix == p for m in c.middles()}) for d, own_ in prefixes.items() for k, p in enumerate(own_)}
        seen = numbers.mapInArrow(_counter(bounds), "dim string, grp int, bucket long, n long, low long, high long")
        counts = defaultdict(list)
        for r in seen.groupBy("dim", "grp", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).sort("dim", "grp", "bucket").collect():
            counts[r["dim"], prefixes[r["dim"]][r["grp"]]].append((r["n"], r["low"], r["high"]))
        for _, cut in own:
            if cut.closed:
                continue
            cut.below = 0
            for n, low, high in counts[cut.dim, cut.prefix]:
                if cut.rank < cut.below + n:
                    cut.low, cut.high = low, high
                    break
                cut.below += n
        if all(cut.closed for _, cut in own):
            common.release(numbers)
            return [(rank, cut, None if cut.dim not in text and cut.low == NULL else cut.low, cut.below) for rank, cut in own]


def _counter(bounds: dict[tuple[str, int], list[int]]):
    """Counts, least and largest values between bounds, of a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for (d, k), marks in bounds.items():
                v = batch.column(f"v_{d}").to_numpy()[batch.column(f"g_{d}").to_numpy() == k]
                bucket = np.searchsorted(np.array(marks, np.int64), v)
                n = np.bincount(bucket, minlength=len(marks) + 1)
                low, high = np.full(len(n), np.iinfo(np.int64).max), np.full(len(n), np.iinfo(np.int64).min)
                np.minimum.at(low, bucket, v)
                np.maximum.at(high, bucket, v)
                out += [(d, k, i, int(n[i]), int(low[i]), int(high[i])) for i in np.flatnonzero(n).tolist()]
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), *[pa.int64()] * 4), strict=True)], names=["dim", "grp", "bucket", "n", "low", "high"])

    return run


def cut_ranks(n: int, cells: int = CELLS) -> list[int]:
    return [-(-k * n // cells) - 1 for k in range(1, cells)]


def coordinates(rows: DataFrame, dims: list[str], cells: int = CELLS) -> DataFrame:
    """Stored rows with a coordinate c_<dimension> from 0 to cells - 1 of each dimension."""
    n = rows.count()
    ranks = sorted({r for r in cut_ranks(n, cells) if r >= 0}) if n else []
    cuts = order_statistics(rows, dims, ranks) if ranks else {d: [] for d in dims}
    at = {r: i for i, r in enumerate(ranks)}
    # Of few rows several cuts may share a rank; rank -1 is no row, so its cut is smaller than every value.
    wanted = [at.get(r) for r in cut_ranks(n, cells)]
    below = sum(i is None for i in wanted)
    base = common.without(rows, *[f"c_{d}" for d in dims])
    return base.select(*base.columns, *[_search(F.col(d), [cuts[d][i] for i in wanted if i is not None], below).cast("long").alias(f"c_{d}") for d in dims])


def interleaved(dims: list[Column], cells: int = CELLS) -> Column:
    """The binary digits of the coordinates, highest first, in turn."""
    out = F.lit(0).cast("long")
    for bit in reversed(range(max(1, (cells - 1).bit_length()))):
        for c in dims:
            out = out * 2 + F.shiftright(c.cast("long"), bit).bitwiseAND(F.lit(1))
    return out


def layout(rows: DataFrame, key: str, dims: list[str], cells: int = CELLS, file: int = FILE) -> DataFrame:
    """Rows (key, dims and other columns) with c_<dimension>, z, position and file. They are read several times: let them be narrow and stored."""
    taken = ["z", "position", "file", *[f"c_{d}" for d in dims]]
    placed = coordinates(common.without(rows, *taken), dims, cells).withColumn("z", interleaved([F.col(f"c_{d}") for d in dims], cells))
    others = [c for c in placed.columns if c not in (key, "z", *dims) and not c.startswith("c_")]
    laid = common.numbered(placed, "position", "z", key, *dims, *others, tag="layout-sorted")
    return laid.withColumn("file", F.floor(F.col("position") / file).cast("long"))


def with_bounds(laid: DataFrame, dims: list[str]) -> DataFrame:
    """Laid rows with low_<dimension> and high_<dimension> of their file."""
    by = Window.partitionBy("file")
    return laid.select("*", *[x for d in dims for x in (F.min(f"c_{d}").over(by).alias(f"low_{d}"), F.max(f"c_{d}").over(by).alias(f"high_{d}"))])


def _around(low: Column, high: Column, reach: int, cells: int) -> Column:
    return F.sequence(F.greatest(low - reach, F.lit(0)), F.least(high + reach, F.lit(cells - 1)))


def _spread(rows: DataFrame, low: dict[str, Column], high: dict[str, Column], reach: dict[str, int], cells: int) -> DataFrame:
    """A row for each cell whose query meets the ranges low to high: file and c_<dimension>. A query reaches as far as it is
    reached."""
    out = rows.select("file", *[_around(low[d], high[d], r, cells).alias(f"c_{d}") for d, r in reach.items()])
    for d in reach:
        out = out.withColumn(f"c_{d}", F.explode(f"c_{d}"))
    return out


def query_counts(bounded: DataFrame, reach: dict[str, int], cells: int = CELLS) -> DataFrame:
    """Of each cell, the query of all cells at most reach[d] away in each dimension d: files_touched, whose bounds meet the query,
    and files_matching, which hold a row inside it. bounded: rows with file, c_*, low_* and high_*, stored."""
    own = [f"c_{d}" for d in reach]
    files = bounded.select("file", *[f"{side}_{d}" for d in reach for side in ("low", "high")]).distinct()
    cut = lambda side: {d: F.col(f"{side}_{d}") for d in reach}
    touched = _spread(files, cut("low"), cut("high"), reach, cells).groupBy(*own).agg(F.count("*").alias("files_touched"))
    held = bounded.select("file", *own).distinct()
    here = {d: F.col(f"c_{d}") for d in reach}
    matching = _spread(held, here, here, reach, cells).distinct().groupBy(*own).agg(F.count("*").alias("files_matching"))
    return touched.join(matching, own)


def write(laid: DataFrame, path: str) -> None:
    """The rows as files, a folder for each file, with a table of the files' bounds beside them."""
    dims = [c[2:] for c in laid.columns if c.startswith("c_")]
    laid.repartition("file").sortWithinPartitions("file", "position").write.partitionBy("file").parquet(f"{path}/rows")
    bounds = laid.groupBy("file").agg(F.count("*").alias("n"), *[x for d in dims for x in (F.min(f"c_{d}").alias(f"low_{d}"), F.max(f"c_{d}").alias(f"high_{d}"))])
    bounds.write.parquet(f"{path}/bounds")


def search(spark: SparkSession, path: str, box: dict[str, tuple[int, int]]) -> DataFrame:
    """The written rows whose coordinates lie in the box (dimension: lowest, highest). Only files whose bounds meet it are read."""
    meets, inside = F.lit(True), F.lit(True)
    for d, (low, high) in box.items():
        meets &= (F.col(f"low_{d}") <= high) & (F.col(f"high_{d}") >= low)
        inside &= F.col(f"c_{d}").between(low, high)
    files = spark.read.parquet(f"{path}/bounds").filter(meets).select("file")
    return spark.read.parquet(f"{path}/rows").filter(inside).join(files, "file", "left_semi")


DIMS = ["source", "lang", "length", "date"]
REACH = {"source": 0, "lang": 0, "length": 1, "date": 1}


def op13_clustered_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    length = F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long")
    rows = common.stored(docs.select("doc_id", "source", "lang", length.alias("length"), common.doc_mod(365).cast("long").alias("date")), "layout-rows")
    bounded = common.stored(with_bounds(layout(rows, "doc_id", DIMS), DIMS), "layout-files")
    counts = query_counts(bounded, REACH)
    if CELLS ** len(DIMS) <= GRID:
        counts = F.broadcast(counts)
    text = F.concat_ws(",", *[F.col(f"{side}_{d}") for d in DIMS for side in ("low", "high")])
    return bounded.join(counts, [f"c_{d}" for d in DIMS]).select("doc_id", "z", "position", "file", "files_touched", "files_matching", text.alias("file_bounds"))


_Z = " + ".join(f"(({d} >> {b}) & 1) * {1 << (4 * b + 3 - i)}" for b in (2, 1, 0) for i, d in enumerate(DIMS))
_MEET = "f.s0 <= q.source AND f.s1 >= q.source AND f.l0 <= q.lang AND f.l1 >= q.lang AND f.n0 <= q.length + 1 AND f.n1 >= q.length - 1 AND f.d0 <= q.date + 1 AND f.d1 >= q.date - 1"
ORACLE_SQL = f"""
WITH RECURSIVE {common.crc32_sql("SELECT coalesce(doc_id::VARCHAR, '') AS t FROM documents")}, base AS (
    SELECT doc_id, source AS vs, lang AS vl, coalesce(octet_length(encode(text)), -1) AS vn, h % 365 AS vd FROM documents JOIN crc ON t = coalesce(doc_id::VARCHAR, '')
), placed AS (
    SELECT doc_id, {", ".join(f"(({CELLS} * (rank() OVER (ORDER BY {v} NULLS FIRST) - 1)) // count(*) OVER ())::BIGINT AS {d}" for v, d in zip(("vs", "vl", "vn", "vd"), DIMS))} FROM base
), ordered AS (
    SELECT *, ({_Z})::BIGINT AS z FROM placed
), numbered AS (
    SELECT *, (row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1)::BIGINT AS position FROM ordered
), laid AS (
    SELECT *, position // {FILE} AS file FROM numbered
), files AS (
    SELECT file, min(source) AS s0, max(source) AS s1, min(lang) AS l0, max(lang) AS l1, min(length) AS n0, max(length) AS n1, min(date) AS d0, max(date) AS d1 FROM laid GROUP BY file
), cells AS (
    SELECT DISTINCT source, lang, length, date FROM laid
), held AS (
    SELECT DISTINCT file, source, lang, length, date FROM laid
), touched AS (
    SELECT q.*, count(*) AS files_touched FROM cells q JOIN files f ON {_MEET} GROUP BY ALL
), matching AS (
    SELECT q.*, count(DISTINCT h.file) AS files_matching FROM cells q JOIN held h ON h.source = q.source AND h.lang = q.lang AND abs(h.length - q.length) <= 1 AND abs(h.date - q.date) <= 1 GROUP BY ALL
)
SELECT doc_id, z, position, file, files_touched, files_matching, concat_ws(',', s0, s1, l0, l1, n0, n1, d0, d1) AS file_bounds
FROM laid JOIN files USING (file) JOIN touched USING (source, lang, length, date) JOIN matching USING (source, lang, length, date)
"""
