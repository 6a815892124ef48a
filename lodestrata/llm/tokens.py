"""Words of Arrow text columns as NumPy arrays: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
_C1, _C2, _G = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
#: Bytes of text that are worked on at once; a longer text is a block by itself.
BLOCK = 1 << 20
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> U(30))) * _C1
    x = (x ^ (x >> U(27))) * _C2
    return x ^ (x >> U(31))


def folding(separators: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it belongs to words, and what it is folded to (A-Z to a-z)."""
    word = np.ones(256, bool)
    word[list(separators)] = False
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    return word, fold


SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: After folding, words of letters, digits and anything outside ASCII.
PUNCTUATION = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


class Block:
    """The words of some rows. ends[d]:ends[d+1] are the words of row d; start, stop are byte positions in data, which is folded."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, word: np.ndarray, fold: np.ndarray):
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        self.data = np.zeros(n + 8, np.uint8)
        self.data[:n] = fold[raw]
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = word[raw]
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        first[edge] |= inside[1:-1][edge]
        last[edge - 1] |= inside[1:-1][edge - 1]
        self.start, self.stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.ends = np.searchsorted(self.start, offsets)
        self.rows = len(offsets) - 1
        self.counts = np.diff(self.ends)
        self.row = np.repeat(np.arange(self.rows), self.counts)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j, joined by blanks."""
        return b" ".join(bytes(self.data[a:b]) for a, b in zip(self.start[i:j], self.stop[i:j], strict=True))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        length = self.stop - self.start
        eights = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
        h = mix(length.astype(U) * _G)
        live, at, left = np.arange(len(length)), self.start, length
        far = length > LONG_WORD
        if far.any():
            live, at, left = live[~far], at[~far], left[~far]
        while len(live):
            h[live] = mix(h[live] ^ (eights[at] & masks[np.minimum(left, 8)])) * _G
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(far):
            h[i] = U(xxhash.xxh3_64_intdigest(bytes(self.data[self.start[i] : self.stop[i]])))
        return mix(h)

    def windows(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k consecutive words of a row, and where they begin."""
        if len(h) < k:
            return np.zeros(0, U), np.zeros(0, np.int64)
        w = _weights(k)
        out = h[: len(h) - k + 1] * w[0]
        for j in range(1, k):
            out += h[j : len(h) - k + 1 + j] * w[j]
        at = np.flatnonzero(self.row[: len(h) - k + 1] == self.row[k - 1 :])
        return mix(out[at] + w[k]), at


def _weights(k: int) -> np.ndarray:
    """k odd multipliers and an addend that differs with k."""
    seed = np.arange(1, k + 2, dtype=U) * _G
    w = mix(seed) | U(1)
    w[k] = mix(np.array([k], U) * _C1)[0]
    return w


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def blocks(column: pa.Array, folds: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, Block]]:
    raw, offsets = buffers(column)
    for lo, hi in spans(offsets):
        yield lo, hi, Block(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], *folds)


def by_row(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of values by row."""
    return np.bincount(row, values, rows)
