"""Rasters as tiles: squares of SIZE cells with a border of their neighbours' cells, for windows of any kind.

Every cell goes to its own tile and to those whose border holds it, as blocks of places and values, not cell by cell: one
shuffle for a chain of windows whose reaches add up to the border's width. A kernel then sees one tile with its border as
arrays. What a task holds is one tile, whatever the grid's size.

Wide windows are sums of four places of a summed-area table. Its tiles are summed within; the sums of the tiles before in the
same line, and of all lines above, are carried in by two passes over the tiles' edges, 2 / SIZE of the cells. Then each tile
sends every box its corners: as much is shuffled for a window of ten cells as for one of a thousand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata import store
from lodestrata.deploy import ship
from lodestrata.operators.grid import Meta

SIZE = 256
#: Cells that a task gathers before it deals them to tiles.
GATHER = 500_000

_PIECE = "tr int, tc int, top int, left int, height int, width int, at binary, data binary"
_PIECE_NAMES = ["tr", "tc", "top", "left", "height", "width", "at", "data"]
_PIECE_TYPES = [*[pa.int32()] * 6, pa.binary(), pa.binary()]


@dataclass
class Block:
    """A tile with its border: planes of values (NaN: masked or not there), where cells are there, and its place in the grid."""

    v: np.ndarray
    there: np.ndarray
    r0: int
    c0: int
    reach: int
    size: int
    meta: Meta

    @property
    def shape(self) -> tuple[int, int]:
        """Rows and columns of the tile itself, cut off at the grid's end."""
        return min(self.size, self.meta.h - self.r0 - self.reach), min(self.size, self.meta.w - self.c0 - self.reach)

    def inner(self, a: np.ndarray) -> np.ndarray:
        h, w = self.shape
        k = self.reach
        return a[..., k : k + h, k : k + w]

    def mirrored(self, a: np.ndarray) -> np.ndarray:
        """a with the grid's cells repeated beyond its borders, the border cell first."""
        def places(start: int, n: int, most: int) -> np.ndarray:
            g = np.arange(start, start + n)
            g = np.where(g < 0, -1 - g, np.where(g >= most, 2 * most - 1 - g, g)) - start
            return np.clip(g, 0, n - 1)

        n = a.shape[-1]
        return a[..., places(self.r0, n, self.meta.h)[:, None], places(self.c0, n, self.meta.w)[None, :]]

    def gradient(self, a: np.ndarray, axis: int, spacing: float) -> np.ndarray:
        """Central differences along an axis (0: rows), one-sided at the grid's borders; NaN next to NaN."""
        a = np.moveaxis(a, axis, 0)
        out = np.full_like(a, np.nan)
        out[1:-1] = (a[2:] - a[:-2]) / (2 * spacing)
        first = -(self.r0 if axis == 0 else self.c0)
        last = first + (self.meta.h if axis == 0 else self.meta.w) - 1
        if 0 <= first < len(a) - 1:
            out[first] = (a[first + 1] - a[first]) / spacing
        if 0 < last < len(a):
            out[last] = (a[last] - a[last - 1]) / spacing
        return np.moveaxis(out, 0, axis)


def tile_count(meta: Meta, size: int) -> tuple[int, int]:
    return -(-meta.h // size), -(-meta.w // size)


def _dealer(meta: Meta, reach: int, size: int, planes: int):
    """Cells (r, c, planes) to pieces of tiles."""
    rows, cols = tile_count(meta, size)
    side = size + 2 * reach

    def deal(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        r, c = (table[i].to_numpy().astype(np.int64) for i in (0, 1))
        v = np.array([table[2 + i].to_numpy() for i in range(planes)]).reshape(planes, len(r))
        steps = range(2 * reach // size + 2)
        ids, who = [], []
        for a in steps:
            i = (r - reach) // size + a
            for b in steps:
                j = (c - reach) // size + b
                ok = (i * size <= r + reach) & (j * size <= c + reach) & (i >= 0) & (i < rows) & (j >= 0) & (j < cols)
                ids.append((i * cols + j)[ok])
                who.append(np.flatnonzero(ok))
        ids, who = np.concatenate(ids), np.concatenate(who)
        order = np.argsort(ids, kind="stable")
        ids, who = ids[order], who[order]
        edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        made = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo < hi:
                i, j = divmod(int(ids[lo]), cols)
                w = who[lo:hi]
                at = (r[w] - i * size + reach) * side + c[w] - j * size + reach
                made.append((i, j, 0, 0, 0, 0, at.astype(np.int32).tobytes(), np.ascontiguousarray(v[:, w]).tobytes()))
        if made:
            yield _batch(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            parts.append(batch)
            held += len(batch)
            if held >= GATHER:
                yield from deal(parts)
                parts, held = [], 0
        if held:
            yield from deal(parts)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _PIECE_TYPES, strict=True)], names=_PIECE_NAMES)


def pieces(grid: DataFrame, meta: Meta, reach: int, columns: list[str], size: int = SIZE, every: bool = True) -> DataFrame:
    """The cells of grid (r, c, columns) as pieces for tiles with a border of `reach`; with every, all tiles get one."""
    ship(grid.sparkSession)
    dealt = grid.select(F.col("r").cast("int"), F.col("c").cast("int"), *[F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))).alias(n) for n in columns]).mapInArrow(_dealer(meta, reach, size, len(columns)), _PIECE)
    if not every:
        return dealt
    rows, cols = tile_count(meta, size)
    none = F.lit(b"")
    empty = grid.sparkSession.range(rows * cols).select((F.col("id") / cols).cast("int").alias("tr"), (F.col("id") % cols).cast("int").alias("tc"), *[F.lit(0).alias(n) for n in _PIECE_NAMES[2:6]], none.alias("at"), none.alias("data"))
    return dealt.unionByName(empty)


def spread(tiles: DataFrame, meta: Meta, reach: int, planes: int, size: int = SIZE) -> DataFrame:
    """Stored tiles (tr, tc, data: their planes as bytes) as pieces: each sends its neighbours the strips of their borders."""
    rows, cols = tile_count(meta, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data in zip(*(batch.column(n).to_pylist() for n in ("tr", "tc", "data")), strict=True):
                h, w = min(size, meta.h - i * size), min(size, meta.w - j * size)
                own = np.frombuffer(data).reshape(planes, h, w)
                made = []
                near = -(-reach // size)
                for a in range(max(0, i - near), min(rows, i + near + 1)):
                    for b in range(max(0, j - near), min(cols, j + near + 1)):
                        top, bottom = max(i * size, a * size - reach), min(i * size + h, (a + 1) * size + reach)
                        left, right = max(j * size, b * size - reach), min(j * size + w, (b + 1) * size + reach)
                        if top < bottom and left < right:
                            part = own[:, top - i * size : bottom - i * size, left - j * size : right - j * size]
                            made.append((a, b, top - a * size + reach, left - b * size + reach, bottom - top, right - left, None, np.ascontiguousarray(part).tobytes()))
                yield _batch(made)

    ship(tiles.sparkSession)
    return tiles.select("tr", "tc", "data").mapInArrow(run, _PIECE)


def assemble(table: pa.Table, key: tuple, meta: Meta, reach: int, planes: int, size: int = SIZE, add: bool = False) -> Block:
    """The tile that its pieces make; with add, pieces that lie on one another add up."""
    side = size + 2 * reach
    v = np.zeros((planes, side, side)) if add else np.full((planes, side, side), np.nan)
    there = np.zeros((side, side), bool)
    flat, flags = v.reshape(planes, side * side), there.reshape(-1)
    for top, left, h, w, at, data in zip(*(table[n].to_pylist() for n in _PIECE_NAMES[2:]), strict=True):
        if at is not None:
            if at:
                place = np.frombuffer(at, np.int32)
                flags[place] = True
                if planes:
                    flat[:, place] = np.frombuffer(data).reshape(planes, len(place))
        elif add:
            v[:, top : top + h, left : left + w] += np.frombuffer(data).reshape(planes, h, w)
        else:
            v[:, top : top + h, left : left + w] = np.frombuffer(data).reshape(planes, h, w)
            there[top : top + h, left : left + w] = True
    i, j = (k.as_py() for k in key)
    return Block(v, there, i * size - reach, j * size - reach, reach, size, meta)


def gather(dealt: DataFrame, meta: Meta, reach: int, planes: int, kernel: Callable[[Block], pa.Table], schema: str, size: int = SIZE, add: bool = False) -> DataFrame:
    """kernel's rows of each tile: the one shuffle."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        return kernel(assemble(table, key, meta, reach, planes, size, add))

    return dealt.groupBy("tr", "tc").applyInArrow(run, schema)


def rows_of(block: Block, values: dict[str, np.ndarray], present: bool = False) -> pa.Table:
    """A tile's cells (r, c and values, NaN as NULL), or only those that were there."""
    h, w = block.shape
    r, c = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
    table = pa.table({"r": r + np.int32(block.r0 + block.reach), "c": c + np.int32(block.c0 + block.reach), **{n: pa.array(x.ravel(), mask=np.isnan(x.ravel())) for n, x in values.items()}})
    return table.filter(pa.array(block.inner(block.there).ravel())) if present else table


def stencil(grid: DataFrame, meta: Meta, reach: int, kernel: Callable[[Block], dict[str, np.ndarray]], names: list[str], columns: tuple[str, ...] = ("v",), size: int = SIZE, present: bool = False) -> DataFrame:
    """(r, c, names) of every cell (present: of grid's rows): kernel gives each name's values of a tile from the tile with its
    border."""
    def run(block: Block) -> pa.Table:
        return rows_of(block, kernel(block), present)

    schema = "r int, c int" + "".join(f", {n} double" for n in names)
    return gather(pieces(grid, meta, reach, list(columns), size, not present), meta, reach, len(columns), run, schema, size)


def tiled(grid: DataFrame, meta: Meta, columns: tuple[str, ...] = ("v",), size: int = SIZE) -> DataFrame:
    """grid as tiles (tr, tc, data); cells that are not there are NaN."""
    return gather(pieces(grid, meta, 0, list(columns), size), meta, 0, len(columns), lambda b: tile_row(b, b.v), "tr int, tc int, data binary", size)


def tile_row(block: Block, planes: np.ndarray) -> pa.Table:
    k = block.reach
    return pa.table({"tr": pa.array([(block.r0 + k) // block.size], pa.int32()), "tc": pa.array([(block.c0 + k) // block.size], pa.int32()), "data": pa.array([np.ascontiguousarray(block.inner(planes)).tobytes()], pa.binary())})


def chain(tiles: DataFrame, meta: Meta, reach: int, kernel: Callable[[Block], dict[str, np.ndarray]], planes: int = 1, size: int = SIZE) -> DataFrame:
    """Tiles (tr, tc, data) to tiles of the kernel's values, one plane a name, with one shuffle."""
    def run(block: Block) -> pa.Table:
        out = np.stack(list(kernel(block).values()))
        k = block.reach
        return pa.table({"tr": pa.array([(block.r0 + k) // size], pa.int32()), "tc": pa.array([(block.c0 + k) // size], pa.int32()), "data": pa.array([np.ascontiguousarray(out).tobytes()], pa.binary())})

    return gather(spread(tiles, meta, reach, planes, size), meta, reach, planes, run, "tr int, tc int, data binary", size)


def untiled(tiles: DataFrame, meta: Meta, names: list[str], size: int = SIZE) -> DataFrame:
    """Tiles as cells (r, c, names), without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data in zip(*(batch.column(n).to_pylist() for n in ("tr", "tc", "data")), strict=True):
                h, w = min(size, meta.h - i * size), min(size, meta.w - j * size)
                own = np.frombuffer(data).reshape(len(names), h, w)
                block = Block(own, np.ones((h, w), bool), i * size, j * size, 0, size, meta)
                yield from rows_of(block, dict(zip(names, own, strict=True))).to_batches()

    ship(tiles.sparkSession)
    return tiles.select("tr", "tc", "data").mapInArrow(run, "r int, c int" + "".join(f", {n} double" for n in names))


def made(spark: SparkSession, meta: Meta, values: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int = SIZE) -> DataFrame:
    """Tiles (tr, tc, data) of a function of rows and columns."""
    rows, cols = tile_count(meta, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                i, j = divmod(k, cols)
                r, c = np.mgrid[i * size : min((i + 1) * size, meta.h), j * size : min((j + 1) * size, meta.w)]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([values(r, c).astype(float).tobytes()], pa.binary())], names=["tr", "tc", "data"])

    ship(spark)
    return spark.range(rows * cols).mapInArrow(run, "tr int, tc int, data binary")


# Summed-area tables


def prefix_sums(dealt: DataFrame, meta: Meta, planes: int, size: int = SIZE) -> DataFrame:
    """Tiles (tr, tc, data) of the sums of all cells up to each cell's row and column; dealt are pieces without a border.
    Cells that are NaN or not there count 0."""
    def within(block: Block) -> pa.Table:
        a = block.inner(np.nan_to_num(block.v))
        i, j = block.r0 // size, block.c0 // size
        sums = a.cumsum(axis=1).cumsum(axis=2)
        return pa.table({"tr": pa.array([i], pa.int32()), "tc": pa.array([j], pa.int32()), "data": pa.array([sums.tobytes()], pa.binary()), "right": pa.array([a.sum(axis=2).tobytes()], pa.binary()), "below": pa.array([a.sum(axis=1).tobytes()], pa.binary())})

    schema = "tr int, tc int, data binary, right binary, below binary"
    local = store.stored(gather(dealt, meta, 0, planes, within, schema, size), "tile-sums")

    def down(table: pa.Table) -> pa.Table:
        """What lies above each tile, by column."""
        table = table.sort_by("tr")
        each = np.stack([np.frombuffer(x) for x in table["below"].to_pylist()])
        above = np.cumsum(each, axis=0) - each
        return pa.table({"tr": table["tr"], "tc": table["tc"], "above": pa.array([x.tobytes() for x in above], pa.binary())})

    def along(table: pa.Table) -> pa.Table:
        """What lies before each tile, by row, and the sum of all that is above and before."""
        table = table.sort_by("tc")
        each = np.stack([np.frombuffer(x) for x in table["right"].to_pylist()])
        before = np.cumsum(each, axis=0) - each
        total = np.stack([np.frombuffer(x).reshape(planes, -1).sum(axis=1) for x in table["above"].to_pylist()])
        corner = np.cumsum(total, axis=0) - total
        return pa.table({"tr": table["tr"], "tc": table["tc"], "before": pa.array([x.tobytes() for x in before], pa.binary()), "above": table["above"], "corner": pa.array([x.tobytes() for x in corner], pa.binary())})

    above = local.select("tr", "tc", "below").groupBy("tc").applyInArrow(down, "tr int, tc int, above binary")
    carried = local.select("tr", "tc", "right").join(above, ["tr", "tc"]).groupBy("tr").applyInArrow(along, "tr int, tc int, before binary, above binary, corner binary")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, before, up, corner in zip(*(batch.column(n).to_pylist() for n in ("data", "before", "above", "corner")), strict=True):
                b, a = np.frombuffer(before).reshape(planes, -1), np.frombuffer(up).reshape(planes, -1)
                sums = np.frombuffer(data).reshape(planes, b.shape[1], a.shape[1]) + b.cumsum(axis=1)[:, :, None] + a.cumsum(axis=1)[:, None, :] + np.frombuffer(corner)[:, None, None]
                out.append(sums.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("tr"), batch.column("tc"), pa.array(out, pa.binary())], names=["tr", "tc", "data"])

    return local.select("tr", "tc", "data").join(carried, ["tr", "tc"]).mapInArrow(carry, "tr int, tc int, data binary")


def box_sums(grid: DataFrame, meta: Meta, k: int, columns: list[str], mirrored: bool, size: int = SIZE) -> DataFrame:
    """(r, c, columns) of every cell: the sums over the cells at most k rows and columns away, masked cells counting 0; beyond
    the borders the grid is mirrored, or there is nothing."""
    wide = replace(meta, h=meta.h + 2 * k, w=meta.w + 2 * k)
    planes = len(columns)

    def copies(axis: str, n: int):
        a = F.col(axis)
        return F.explode(F.array_compact(F.array(a, F.when(a < k, -1 - a), F.when(a >= n - k, 2 * n - 1 - a))))

    rows = grid.select("r", "c", *columns)
    if mirrored:
        rows = rows.withColumn("r", copies("r", meta.h)).withColumn("c", copies("c", meta.w))
    shifted = rows.withColumns({"r": F.col("r") + k, "c": F.col("c") + k})
    sums = prefix_sums(pieces(shifted, wide, 0, columns, size), wide, planes, size)
    rows_, cols_ = tile_count(meta, size)

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A box begins at its cell's own place in the wide grid: its corners are 2 k further, or one before."""
        for batch in batches:
            for i, j, data in zip(*(batch.column(n).to_pylist() for n in ("tr", "tc", "data")), strict=True):
                h, w = min(size, wide.h - i * size), min(size, wide.w - j * size)
                own = np.frombuffer(data).reshape(planes, h, w)
                made = []
                for dr, sr in ((-2 * k, 1), (1, -1)):
                    for dc, sc in ((-2 * k, 1), (1, -1)):
                        r0, c0 = i * size + dr, j * size + dc
                        for a in range(max(0, r0 // size), min(rows_ - 1, (r0 + h - 1) // size) + 1):
                            for b in range(max(0, c0 // size), min(cols_ - 1, (c0 + w - 1) // size) + 1):
                                top, bottom = max(r0, a * size), min(r0 + h, (a + 1) * size, meta.h)
                                left, right = max(c0, b * size), min(c0 + w, (b + 1) * size, meta.w)
                                if top < bottom and left < right:
                                    part = own[:, top - r0 : bottom - r0, left - c0 : right - c0] * (sr * sc)
                                    made.append((a, b, top - a * size, left - b * size, bottom - top, right - left, None, part.tobytes()))
                if made:
                    yield _batch(made)

    def run(block: Block) -> pa.Table:
        return rows_of(block, dict(zip(columns, block.inner(block.v), strict=True)))

    schema = "r int, c int" + "".join(f", {n} double" for n in columns)
    return gather(sums.mapInArrow(corners, _PIECE), meta, 0, planes, run, schema, size, add=True)
