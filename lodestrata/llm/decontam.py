"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, verified hits, spans or documents removed.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. A benchmark item's windows are its
runs of `window` words; an item of fewer words (but some) is one window. A document word inside an occurrence of a
window is hit. Hash hits are verified word by word.

Defined cases: a null text has no words; items without words have no windows; equal windows of several items count
for each of these items; items that share an item_id count once; a null item_id is reported as the text `null`.
Repeated documents are handled row by row. Input columns that clash with the operator's own are replaced. A very long text
is scanned whole; an empty table gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import common, tokens

#: Bytes of benchmark text whose windows are broadcast at once. A larger benchmark takes several passes.
PASS_BYTES = 16 << 20
U = np.uint64
FOLDS = tokens.folding(tokens.PUNCTUATION)
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
OWN = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", SPAN),
]


@dataclass(frozen=True)
class Windows:
    """The distinct windows of one length: sorted hashes, where the first of each begins, and the numbers of its items."""

    seen: np.ndarray  # a filter by the hashes' leading 16 bits
    keys: np.ndarray
    at: np.ndarray
    ends: np.ndarray
    items: np.ndarray


@dataclass(frozen=True)
class Index:
    """All of a benchmark's words as places in one folded text, and its windows by their length: about 30 bytes a word."""

    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    names: list[str]
    windows: dict[int, Windows]

    def text(self, i: int, n: int) -> bytes:
        return b" ".join(bytes(self.data[a:b]) for a, b in zip(self.start[i : i + n], self.stop[i : i + n], strict=True))


def index(names: list, texts: pa.Array, window: int) -> Index:
    """The index of benchmark items, by whole arrays. Windows are one if two 64-bit hashes of their words agree."""
    data, start, stop = [np.zeros(0, np.uint8)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    found: dict[int, list[tuple]] = defaultdict(list)
    size = words = 0
    for lo, _, b in tokens.blocks(texts, FOLDS):
        h = b.hashes()
        for n in sorted({min(int(c), window) for c in np.unique(b.counts) if c}):
            wh, at = b.windows(h, n)
            if n < window:
                whole = b.counts[b.row[at]] == n
                wh, at = wh[whole], at[whole]
            second = b.windows(tokens.mix(h ^ U(0xA5A5A5A5A5A5A5A5)), n)[0]
            found[n].append((wh, second[whole] if n < window else second, (at + words).astype(np.uint32), (b.row[at] + lo).astype(np.uint32)))
        n_bytes = len(b.raw)
        data.append(b.data[:n_bytes])
        start.append((b.start + size).astype(np.uint32))
        stop.append((b.stop + size).astype(np.uint32))
        size, words = size + n_bytes, words + len(b.start)
    out = {}
    for n, parts in found.items():
        key, second, at, item = (np.concatenate([x[i] for x in parts]) for i in range(4))
        order = np.lexsort((item, second, key))
        key, second, at, item = key[order], second[order], at[order], item[order]
        same = np.zeros(len(key), bool)
        same[1:] = (key[1:] == key[:-1]) & (second[1:] == second[:-1])
        again = np.zeros(len(key), bool)
        again[1:] = same[1:] & (item[1:] == item[:-1])
        head = np.flatnonzero(~same[~again])
        key, at, item = key[~again], at[~again], item[~again]
        seen = np.zeros(1 << 16, bool)
        seen[key >> U(48)] = True
        out[n] = Windows(seen, key[head], at[head], np.append(head, len(key)).astype(np.uint32), item)
    return Index(np.concatenate(data), np.concatenate(start), np.concatenate(stop), ["null" if x is None else str(x) for x in names], out)


def _chars(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points before each byte position."""
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return heads[at]


def scan(column: pa.Array, held: Index, before: tuple[list, list] | None = None) -> tuple[list, list, list, list]:
    """n_words, n_hit, items and spans of each text; before: items and spans that earlier passes found."""
    n_words, n_hit, all_items, all_spans = [], [], [], []
    for lo, _, b in tokens.blocks(column, FOLDS):
        h, hit, items = b.hashes(), np.zeros(len(b.start) + 1, np.int64), defaultdict(set)
        for n, w in held.windows.items():
            wh, at = b.windows(h, n)
            maybe = np.flatnonzero(w.seen[wh >> U(48)])
            pos = np.searchsorted(w.keys, wh[maybe])
            same = w.keys[np.minimum(pos, len(w.keys) - 1)] == wh[maybe]
            for i, k in zip(at[maybe[same]].tolist(), pos[same].tolist(), strict=True):
                text, key = b.text(i, i + n), w.keys[k]
                while k < len(w.keys) and w.keys[k] == key:  # more than one only where hashes collide
                    if held.text(int(w.at[k]), n) == text:
                        hit[i] += 1
                        hit[i + n] -= 1
                        items[int(b.row[i])].update(held.names[j] for j in w.items[w.ends[k] : w.ends[k + 1]].tolist())
                    k += 1
        covered = np.cumsum(hit[:-1]) > 0
        first = None
        if before is not None:
            first = _chars(b.raw, b.offsets)
            for r in range(b.rows):
                if before[1][lo + r]:
                    items[r].update(before[0][lo + r])
                    a, e = b.ends[r], b.ends[r + 1]
                    place = _chars(b.raw, b.start[a:e]) - first[r]
                    starts, stops = (np.array([x[k] for x in before[1][lo + r]]) for k in ("start", "end"))
                    k = np.searchsorted(starts, place, "right") - 1
                    covered[a:e] |= (k >= 0) & (place < stops[np.maximum(k, 0)])
        edges = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
        open_, close = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        cuts = b.ends[1:-1]  # a run of hit words that goes on in the next row is two spans
        cuts = cuts[(cuts > 0) & (cuts < len(covered))]
        cuts = cuts[covered[cuts - 1] & covered[cuts]] if len(cuts) else cuts
        open_, close = np.sort(np.concatenate([open_, np.unique(cuts)])), np.sort(np.concatenate([close, np.unique(cuts)]))
        spans: dict[int, list] = defaultdict(list)
        if len(open_):
            first = _chars(b.raw, b.offsets) if first is None else first
            starts, stops = _chars(b.raw, b.start[open_]), _chars(b.raw, b.stop[close - 1])
            for r, s, e in zip(b.row[open_].tolist(), starts.tolist(), stops.tolist(), strict=True):
                spans[r].append({"start": s - int(first[r]), "end": e - int(first[r])})
        n_words += b.counts.tolist()
        n_hit += np.bincount(b.row[covered], minlength=b.rows).tolist()
        all_items += [sorted(items[r]) if r in items else [] for r in range(b.rows)]
        all_spans += [spans.get(r, []) for r in range(b.rows)]
    return n_words, n_hit, all_items, all_spans


def mark(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs with n_words, n_hit, hit_items (sorted) and hit_spans (code points, end exclusive).

    Benchmark texts of up to pass_bytes are held at once; of more, each row goes through one pass for each slice, all in
    the scan's own tasks: nothing is shuffled, copied or read twice, and a word is hit if any pass hits it. Each pass is a
    Python worker with its slice's index."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text"))
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-total // pass_bytes))
    out = common.without(docs, *[f.name for f in OWN])
    for k in range(passes):
        own = bench if passes == 1 else bench.filter(F.pmod(F.xxhash64("text"), F.lit(passes)) == k)
        out = _pass(out, own, window, text, k > 0)
    return out


def _pass(docs: DataFrame, bench: DataFrame, window: int, text: str, again: bool) -> DataFrame:
    spark = docs.sparkSession
    common.ship(spark)
    items = bench.toArrow()  # a slice: about PASS_BYTES of text
    names = items["item_id"].to_pylist()
    held = spark.sparkContext.broadcast(index(names, items["text"].combine_chunks() if items["text"].num_chunks != 1 else items["text"].chunk(0), window))
    own = [f.name for f in OWN]
    schema = T.StructType([*[f for f in docs.schema.fields if f.name not in own], *OWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = held.value
        for batch in batches:
            at = batch.schema.get_field_index
            before = (batch.column(at("hit_items")).to_pylist(), batch.column(at("hit_spans")).to_pylist()) if again else None
            n_words, n_hit, items, spans = scan(batch.column(at(text)), found, before)
            made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            others = [(c, n) for c, n in zip(batch.columns, batch.schema.names, strict=True) if n not in own]
            yield pa.RecordBatch.from_arrays([*[c for c, _ in others], *made], names=[*[n for _, n in others], *own])

    return docs.mapInArrow(run, schema)


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, most: float = 0.0) -> DataFrame:
    """docs without those of which more than the share `most` of the words is hit."""
    aside, columns = common.aside(docs, *[f.name for f in OWN])
    return mark(aside, benchmark, window).filter(F.col("n_hit") <= F.lit(most) * F.col("n_words")).select(*columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs with the hit spans cut out of their texts (null stays null)."""
    docs, columns = common.aside(docs, *[f.name for f in OWN])
    cut = F.expr("""aggregate(hit_spans, struct('' as out, 0L as at),
        (a, s) -> struct(concat(a.out, substring(text, cast(a.at + 1 as int), cast(s.start - a.at as int))) as out, s.end as at),
        a -> concat(a.out, substring(text, cast(a.at + 1 as int))))""")
    return mark(docs, benchmark, window).withColumn("text", cut).select(*columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mark(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"), 10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
