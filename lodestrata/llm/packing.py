"""Best-fit packing of token sequences: bounded-space online best-fit.

A document is its token ids and an end id. One that is longer than a sequence is cut into whole sequences from its end, so
that its first piece alone may be shorter; no other document is cut. A whole piece is a sequence by itself. All others
arrive in groups at a packer with OPEN bins at most: the free spaces that open bins have are the set bits of one number, so
the bin that fits best is the lowest set bit from the piece's length on. Where none fits a bin is opened, and if OPEN are open
the fullest, the lowest set bit of all, closes first. Pieces arrive by hash and, WINDOW at a time, longest first.

Scale: a text is read once where it lies and becomes narrow rows, which alone are shuffled, in groups of some GROUP
pieces each; a group leaves a few sequences that are not full, so what is lost does not depend on the number of groups or
tasks. Rows of a group have a total order, so a task that runs again packs alike. A packer holds OPEN numbers and one window.

Defined cases: a null text counts as empty (the end id alone); very long texts are worked on whole; rows that share doc_id
are packed each by itself; null doc_ids are documents; an empty table gives no rows; input columns named like the results
are replaced, others are not passed on.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import common

SIZE = 2048
#: The id that ends each document.
END = 0
OPEN = 512
WINDOW = 1_000
GROUP = 10_000
#: Spellings that a task keeps; then it begins anew.
KEEP = 300_000
#: Longer runs without a blank go to the library that needs no backtracking.
RUN = 20_000

_BREAK = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r" \s|\s \Z")


def default_vocabulary() -> tuple[str, str]:
    """The vocabulary as a tokenizers file, and the same as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Ids(dict):
    """Ids, as little-endian bytes, of what stands between two breaks of a text, the blank before it included.

    A single blank between two other characters always begins a token of this vocabulary's pattern, so a text's ids are
    those of its parts. Parts are met again and again; a new one is spelt by the ranks, which give the file's ids in less time,
    or by the file itself if it is long or may hold a special token.
    """

    def __init__(self, vocabulary: tuple[str, str]):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._file = Tokenizer.from_file(vocabulary[0])
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary[1]).read_bytes().splitlines())}
        self._ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def spell(self, part: str) -> bytes:
        if len(part) > RUN or "<|" in part:
            ids = self._file.encode(part, add_special_tokens=False).ids
        else:
            ids = self._ranks.encode_ordinary(part)
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        if len(self) >= KEEP:
            self.clear()
        out = self[part] = self.spell(f" {part}")
        return out

    def text(self, text: str) -> bytes:
        parts = _BREAK.split(text) if _ODD.search(text) else text.split(" ")
        return self.spell(parts[0]) + b"".join([self[p] for p in parts[1:]])


def cut(length: int, size: int = SIZE) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of so many ids."""
    first = (length - 1) % size + 1
    return [(0, first), *((at, size) for at in range(first, length, size))]


def pieces(docs: DataFrame, vocabulary: tuple[str, str] | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit numbers) of each piece."""
    common.ship(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(vocabulary)
        for batch in batches:
            rows, made, held = [], [], 0
            for i, text in enumerate(batch.column(1)):
                whole = ids.text(text.as_py() or "") + last
                for k, (start, n) in enumerate(cut(len(whole) // 4, size)):
                    rows.append(i)
                    made.append((k, start, n, whole[4 * start : 4 * (start + n)]))
                held += len(whole)
                if held > 4 << 20:
                    yield _pieces(batch, rows, made)
                    rows, made, held = [], [], 0
            if rows:
                yield _pieces(batch, rows, made)

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _pieces(batch: pa.RecordBatch, rows: list[int], made: list[tuple]) -> pa.RecordBatch:
    k, start, n, ids = zip(*made, strict=True)
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])


class Packer:
    """Bins of one group. Bins of like free space are a stack; a bit of `free` is set where a stack is not empty."""

    def __init__(self, size: int = SIZE, most: int = OPEN):
        self.size, self.most, self.free, self.open, self.bins = size, most, 0, 0, 0
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, space: int) -> int:
        stack = self.stacks[space]
        number = stack.pop()
        if not stack:
            self.free &= ~(1 << space)
        return number

    def put(self, length: int) -> tuple[int, int]:
        """The bin of a piece and its offset there."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
            space, number = self.size, self.bins
            self.bins += 1
            self.open += 1
        left = space - length
        if left:
            self.stacks[left].append(number)
            self.free |= 1 << left
        else:
            self.open -= 1
        return number, self.size - space


def pack(cuts: DataFrame, size: int = SIZE, most: int = OPEN, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """cuts (doc_id, piece, length and other columns; stored, as they are read more than once) with sequence_id and offset."""
    common.ship(cuts.sparkSession)
    cuts = common.without(cuts, "sequence_id", "offset")
    short = cuts.filter(F.col("length") < size)
    groups = max(1, -(-short.count() // group))
    others = [c for c in cuts.columns if c not in ("doc_id", "piece", "length", "start")]
    key = F.xxhash64("doc_id", "piece", F.lit(17))
    dealt = short.withColumn("_group", F.pmod(key, F.lit(groups))).withColumn("_key", key)
    dealt = dealt.repartition(groups, "_group").sortWithinPartitions("_group", "_key", "doc_id", "piece", "length", "start", *others)
    place, at = dealt.columns.index("_group"), dealt.columns.index("length")
    names = [*cuts.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packer = None, Packer(size, most)
        for batch in batches:
            ids, lengths = batch.column(place).to_numpy(), batch.column(at).to_numpy()
            number, offset = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if ids[lo] != now:
                    now, packer = int(ids[lo]), Packer(size, most)
                for a in range(lo, hi, window):
                    b = min(a + window, hi)
                    for i in (a + np.argsort(-lengths[a:b], kind="stable")).tolist():
                        bin_, offset[i] = packer.put(int(lengths[i]))
                        number[i] = 2 * ((now << 32) + bin_)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(number), pa.array(offset)], names=names)

    schema = T.StructType([*cuts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    whole = cuts.filter(F.col("length") == size).withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long"))
    return dealt.mapInArrow(run, schema).unionByName(whole)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of each sequence of packed pieces that carry their ids: of one sequence's pieces at a time."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    cuts = common.stored(pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pack-pieces")
    return pack(cuts)
