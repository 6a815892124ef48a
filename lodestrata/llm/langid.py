"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language gives, at any point of a text, the longest piece that occurs in that
language's text. A text is cut greedily into such longest matches, a letter that does not occur being one; a language's cost is its number of phrases, each
priced at log2 of the length of its labelled text, by character. The language of least cost wins, ties by name.

Texts are normalised: lower case, letters kept, any run of other characters becomes one blank. The parse of a text is one
sequence of phrases, however long it is. To walk many places at once, texts are cut into segments of SEGMENT characters,
each is parsed from its first character on until a phrase begins beyond it, and then segments whose true first phrase
begins elsewhere are parsed again from there up to the first phrase that both parses share. This is repeated until every
segment begins where the one before it ended; the result is that of the parse from left to right.

Labelled text: for each language whole texts of at most `rows` rows, by a hash of the text, those of up to STEP characters
first, then those of up to twice as many and so on, as far as `chars` characters go, the first row in any case. These two
numbers bound what is learnt from, and so the automata: a language takes about 2 MB, or 120 bytes for each letter and character
of labelled text while all tables together stay under DENSE bytes. Every whole text is predicted.

score is the share of the winner among the likelihoods 2^-(cost * SCORE_CHARS), 0 to 1.

Defined cases: a null text or one without letters is `und` with score 0; with no labelled rows every text is `und`;
rows whose lang is null, or whose text has no letters, are not learnt from; repeated rows are predicted row by row; ties
go to the first language by name; an empty table gives no rows; input columns named lang_pred or score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import common, tokens

#: Rows and characters of each language that are learnt from: the bound of the automata.
ROWS, CHARS = 400, 60_000
#: Texts are taken by length in steps of so many characters.
STEP = 500
SEGMENT = 512
SCORE_CHARS = 32
#: Bytes of all languages' transitions as tables; beyond it they are sorted keys.
DENSE = 96_000_000
_models: dict[str, Model] = {}
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in [*range(0xD800), *range(0xE000, 0x110000)]:
            if (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def normalised(points: np.ndarray) -> np.ndarray:
    """Lower-case letters; 32 once for each run of other characters."""
    low = letters()[points]
    keep = low != 0
    keep[1:] |= low[:-1] != 0
    out = low[keep]
    out[out == 0] = 32
    return out


class Sparse:
    """Transitions by sorted keys state * symbols + symbol."""

    def __init__(self, nxt: list[dict[int, int]], symbols: int):
        self.rows, self.symbols = len(nxt) + 1, symbols
        # The last key is beyond all that are looked up.
        self.keys = np.array([s * symbols + c for s, d in enumerate(nxt) for c in sorted(d)] + [self.rows * symbols], np.int64)
        self.to = np.array([d[c] for d in nxt for c in sorted(d)] + [-1], np.int32)

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.symbols + symbol
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at], -1)


class Dense:
    """Transitions as a table, state by symbol."""

    def __init__(self, nxt: list[dict[int, int]], symbols: int):
        self.rows, self.symbols = len(nxt) + 1, symbols
        table = np.full((self.rows, symbols), -1, np.int32)
        for s, d in enumerate(nxt):
            for c, t in d.items():
                table[s, c] = t
        self.flat = table.ravel()

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self.flat[state * self.symbols + symbol]


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of text, by state; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def _walk(table: Dense | Sparse, symbols: np.ndarray, lanes: np.ndarray, entry: np.ndarray, stop: np.ndarray, leave: np.ndarray, mark: np.ndarray) -> None:
    """Parse the segments `lanes` from their entries on. Places where phrases begin are marked, others unmarked; a lane ends
    where a phrase begins at or beyond its stop, which becomes its leave, or at a mark: from there on it was parsed before."""
    root = table(np.zeros(table.symbols, np.int32), np.arange(table.symbols, dtype=np.int32))
    root = np.where(root < 0, table.rows - 1, root).astype(np.int32)  # a letter that does not occur is a phrase
    at = entry[lanes]
    mark[at] = True
    state, at, ends = root[symbols[at]], at + 1, stop[lanes]
    while len(lanes):
        c = symbols[at]
        state = table(state, c)
        new = np.flatnonzero(state < 0)
        if len(new):
            state[new] = root[c[new]]
            here = at[new]
            over = here >= ends[new]
            gone = over | mark[here]
            leave[lanes[new[over]]] = here[over]
            own = (at < ends) & mark[at]
            own[new] = False
            mark[at[own]] = False
            mark[here[~gone]] = True
            if gone.any():
                stay = np.ones(len(lanes), bool)
                stay[new[gone]] = False
                lanes, state, at, ends = lanes[stay], state[stay], at[stay], ends[stay]
        else:
            mark[at[at < ends]] = False
        at = at + 1


class Model:
    """Automata of the languages of `texts`, over one alphabet."""

    def __init__(self, texts: dict[str, list[str]]):
        norm = {}
        for lang in sorted(texts):
            parts = [normalised(np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)) for t in texts[lang]]
            joined = np.concatenate([x for p in parts for x in (p, np.array([32], np.uint32))])
            if (joined != 32).any():
                norm[lang] = joined
        self.langs = list(norm)
        seen = np.unique(np.concatenate(list(norm.values()))) if norm else np.zeros(0, np.uint32)
        seen = seen[seen != 32]
        unseen = len(seen) + 1
        self.end = unseen + 1  # stands after each text; no state has a transition by it or by an unseen letter
        self.map = np.full(0x110000, unseen, np.int32)
        self.map[32] = 0
        self.map[seen] = np.arange(1, unseen)
        made = [automaton(self.map[norm[x]].tolist()) for x in self.langs]
        dense = 4 * (self.end + 1) * sum(len(m) + 1 for m in made) <= DENSE
        self.tables = [(Dense if dense else Sparse)(m, self.end + 1) for m in made]
        self.bits = np.array([np.log2(len(norm[x])) for x in self.langs])

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (symbols) in each language."""
        size = np.array([len(t) for t in texts], np.int64)
        symbols = np.concatenate([x for t in texts for x in (t, np.array([self.end], np.int32))]) if texts else np.zeros(0, np.int32)
        begin = np.cumsum(size + 1) - size - 1
        pieces = -(-size // SEGMENT)
        first = np.cumsum(pieces) - pieces
        nth = np.arange(pieces.sum()) - np.repeat(first, pieces)
        start = np.repeat(begin, pieces) + nth * SEGMENT
        stop = np.minimum(start + SEGMENT, np.repeat(begin + size, pieces))
        out = np.zeros((len(self.langs), len(texts)), np.int64)
        for k, table in enumerate(self.tables):
            mark = np.zeros(len(symbols) + 1, bool)
            entry, leave = start.copy(), stop.copy()
            _walk(table, symbols, np.arange(len(start)), entry, stop, leave, mark)
            while True:
                true = np.where(nth > 0, np.concatenate([[0], leave[:-1]]), start) if len(start) else start
                wrong = np.flatnonzero(entry != true)
                if not len(wrong):
                    break
                entry[wrong] = true[wrong]
                for s, a, b in zip(start[wrong].tolist(), entry[wrong].tolist(), stop[wrong].tolist(), strict=True):
                    mark[s : min(a, b)] = False
                beyond = entry[wrong] >= stop[wrong]
                leave[wrong[beyond]] = entry[wrong[beyond]]
                again = wrong[~beyond]
                _walk(table, symbols, again[~mark[entry[again]]], entry, stop, leave, mark)
            total = np.concatenate([[0], np.cumsum(mark[:-1])])
            out[k] = total[begin + size] - total[begin]
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        raw, offsets = tokens.buffers(column)
        for lo, hi in tokens.spans(offsets):
            points = np.frombuffer(raw[offsets[lo] : offsets[hi]].tobytes().decode().encode("utf-32-le"), np.uint32)
            heads = np.concatenate([[0], np.cumsum((raw[offsets[lo] : offsets[hi]] & 0xC0) != 0x80)])[offsets[lo : hi + 1] - offsets[lo]]
            norm = [normalised(points[a:b]) for a, b in zip(heads[:-1], heads[1:], strict=True)]
            size = np.array([len(x) for x in norm])
            has = np.array([bool((x != 32).any()) for x in norm]) & bool(self.langs)
            found = self.phrases([self.map[x] if h else np.zeros(0, np.int32) for x, h in zip(norm, has, strict=True)])
            cost = found * self.bits[:, None] / np.maximum(size, 1) if self.langs else np.zeros((1, hi - lo))
            best = cost.argmin(axis=0)
            share = 1 / np.exp2((cost.min(axis=0) - cost) * SCORE_CHARS).sum(axis=0)
            names += [self.langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
            scores.append(np.where(has, share, 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def sample(labelled: DataFrame, rows: int = ROWS, chars: int = CHARS, text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """Whole texts of at most `rows` rows and `chars` characters for each language, one at least; reruns agree, and only text
    and lang take part. Rows are picked by narrow rows of hashes and lengths, a row for each text that occurs; only the picked
    ones' texts come to the driver."""
    some = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.xxhash64(F.col(text)).alias("o"), F.length(text).alias("size"), F.col(text).alias("t"))
    order = Window.partitionBy("lang").orderBy(F.floor(F.col("size") / STEP), "o", "size")
    narrow = some.select("lang", "o", "size").distinct()
    first = narrow.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rows)
    total = F.sum("size").over(Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    picked = first.withColumn("total", total).filter((F.col("total") <= chars) | (F.col("n") == 1)).select("lang", "o", "size", "n")
    found = some.join(F.broadcast(picked), ["lang", "o", "size"]).groupBy("lang", "n").agg(F.min("t").alias("t"))
    out: dict[str, list[str]] = {}
    for r in sorted(found.select("lang", "n", "t").collect()):
        out.setdefault(r["lang"], []).append(r["t"])
    return out


def identify(docs: DataFrame, labelled: DataFrame, text: str = "text", rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """docs with lang_pred and score, learnt from labelled (text, lang): whole texts of at most `rows` rows and `chars` characters
    for each language."""
    spark = docs.sparkSession
    common.ship(spark)
    learnt = sample(labelled, rows, chars)
    shared = spark.sparkContext.broadcast(learnt)
    key = f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id() if shared._jbroadcast is not None else id(shared)}"
    base = common.without(docs, "lang_pred", "score")
    schema = T.StructType([*[f for f in base.schema.fields if f.name != text], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodestrata.llm import langid

        if key not in langid._models:  # kept while the worker lives
            langid._models.clear()
            langid._models[key] = langid.Model(shared.value)
        model = langid._models[key]
        for batch in batches:
            i = batch.schema.get_field_index(text)
            names, scores = model.predict(batch.column(i))
            yield pa.RecordBatch.from_arrays([*[c for k, c in enumerate(batch.columns) if k != i], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*[c for c in batch.schema.names if c != text], "lang_pred", "score"])

    return base.mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", common.doc_mod(4) == 2)
    out = identify(docs.select("doc_id", "text", "held_out"), docs.filter(~F.col("held_out")).select("text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score")
