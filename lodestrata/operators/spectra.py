"""Two-dimensional Fourier transforms of grids, over strips of lines as arrays.

Cells are dealt to strips of rows as blocks of places and values. A strip's rows are transformed in one call and cut into blocks
by strips of columns; there the columns are transformed, the spectra combined, and transformed back; blocks go back to the strips
of rows. Three shuffles of blocks, and a strip is the largest thing in a task. Fields are real, so half the columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.deploy import ship

#: Numbers of a strip.
STRIP = 2_000_000


def _lines(length: int) -> int:
    return max(1, min(256, STRIP // length))


def filtered(grid: DataFrame, h: int, w: int, columns: list[str], combine: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], names: list[str], size: tuple[int, int] | None = None, extra: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(r, c, names) of every cell of an h x w grid (r, c, columns): its columns' spectra, combined and transformed back.

    size: rows and columns to which the grid is padded with zeros. extra(rows, cols) gives further fields of the padded grid, as
    (fields, rows, cols), which are not shuffled as cells. combine(spectra, rows, cols) takes (fields, rows, cols) of some
    columns of the spectrum, and gives one for each name; it must be that of a real field. Cells that are not there are 0."""
    ship(grid.sparkSession)
    tall, wide = size or (h, w)
    planes, half = len(columns), wide // 2 + 1
    down, across = _lines(wide), _lines(tall)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, c = (batch.column(i).to_numpy() for i in (0, 1))
            v = np.array([batch.column(2 + i).to_numpy() for i in range(planes)])
            order = np.argsort(r // down, kind="stable")
            r, c, v = r[order], c[order], v[:, order]
            strip = r // down
            cut = [0, *(np.flatnonzero(np.diff(strip)) + 1).tolist(), len(r)]
            spans = [(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array([int(strip[a]) for a, _ in spans], pa.int32()), pa.array([((r[a:b].astype(np.int64) - strip[a] * down) * wide + c[a:b]).tobytes() for a, b in spans], pa.binary()), pa.array([np.ascontiguousarray(v[:, a:b]).tobytes() for a, b in spans], pa.binary())], names=["strip", "at", "data"])

    def rows(key: tuple, table: pa.Table) -> pa.Table:
        first = key[0].as_py() * down
        n = min(down, (tall if extra else h) - first)
        a = np.zeros((planes, n * wide))
        for at, data in zip(table["at"].to_pylist(), table["data"].to_pylist(), strict=True):
            if at:
                place = np.frombuffer(at, np.int64)
                a[:, place] = np.frombuffer(data).reshape(planes, -1)
        a = a.reshape(planes, n, wide)
        if extra:
            a = np.concatenate([a, extra(np.arange(first, first + n), np.arange(wide))])
        z = np.fft.rfft(a, axis=2)
        starts = range(0, half, across)
        return pa.table({"strip": pa.array([s // across for s in starts], pa.int32()), "place": pa.array([first] * len(starts), pa.int32()), "data": pa.array([np.ascontiguousarray(z[:, :, s : s + across]).tobytes() for s in starts], pa.binary())})

    def cols(key: tuple, table: pa.Table) -> pa.Table:
        first = key[0].as_py() * across
        n = min(across, half - first)
        z = None
        for place, data in zip(table["place"].to_pylist(), table["data"].to_pylist(), strict=True):
            part = np.frombuffer(data, complex)
            fields = planes + (z.shape[0] - planes if z is not None else len(part) // (n * min(down, (tall if extra else h) - place)) - planes)
            part = part.reshape(fields, -1, n)
            if z is None:
                z = np.zeros((fields, tall, n), complex)
            z[:, place : place + part.shape[1]] = part
        out = np.fft.ifft(combine(np.fft.fft(z, axis=1), np.arange(tall), np.arange(first, first + n)), axis=1)[:, :h]
        starts = range(0, h, down)
        return pa.table({"strip": pa.array([s // down for s in starts], pa.int32()), "place": pa.array([first] * len(starts), pa.int32()), "data": pa.array([np.ascontiguousarray(out[:, s : s + down]).tobytes() for s in starts], pa.binary())})

    def back(key: tuple, table: pa.Table) -> pa.Table:
        first = key[0].as_py() * down
        n = min(down, h - first)
        z = np.zeros((len(names), n, half), complex)
        for place, data in zip(table["place"].to_pylist(), table["data"].to_pylist(), strict=True):
            part = np.frombuffer(data, complex).reshape(len(names), n, -1)
            z[:, :, place : place + part.shape[2]] = part
        out = np.fft.irfft(z, wide, axis=2)[:, :, :w]
        r = np.repeat(np.arange(first, first + n, dtype=np.int32), w)
        return pa.table({"r": r, "c": np.tile(np.arange(w, dtype=np.int32), n), **{name: a.ravel() for name, a in zip(names, out, strict=True)}})

    dealt = grid.select(F.col("r").cast("int"), F.col("c").cast("int"), *[F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in columns]).mapInArrow(deal, "strip int, at binary, data binary")
    every = grid.sparkSession.range(-(-(tall if extra else h) // down)).select(F.col("id").cast("int").alias("strip"), F.lit(b"").alias("at"), F.lit(b"").alias("data"))
    block = "strip int, place int, data binary"
    spectra = dealt.unionByName(every).groupBy("strip").applyInArrow(rows, block)
    done = spectra.groupBy("strip").applyInArrow(cols, block)
    return done.groupBy("strip").applyInArrow(back, "r int, c int" + "".join(f", {x} double" for x in names))


def signed(k: np.ndarray, n: int) -> np.ndarray:
    """Places in a spectrum of n as frequencies of either sign; places in a padded field as steps of either sign."""
    return np.where(k < (n + 1) // 2, k, k - n)
