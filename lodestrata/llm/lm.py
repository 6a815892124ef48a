"""Language-model scoring: the likelihood of a text over all its segmentations into vocabulary pieces.

Tokens are the words of the text, A-Z in lower case, and one end. The model is a unigram distribution over the pieces of
an existing vocabulary and the end; each word is spelt with a leading blank, bytes stand in where no piece fits, and a
log-space forward recursion sums over all segmentations. No piece crosses a word, so a text's probability is the product
over its words and the end, and each distinct word is worked out once for a block of texts. Piece probabilities begin as the
counts of the vocabulary's own segmentation of every training word, smoothed; `rounds` rounds of expectation and
maximisation over all segmentations of all training words follow.

Beside it stands a word-unigram base score over the same training texts.

Scale: training words are counted in each task before they are shuffled. The most frequent words, `held` of them at
most and all of those that are as frequent, travel to the workers as arrays of bounded size; all other words are looked up in the full count table by a join on a
64-bit hash, so every word counts at any vocabulary size.

Defined cases: a null text counts as empty (one token, the end); without training texts N = V = 0 and nothing is known;
repeated rows are scored row by row; a null doc_id counts as the empty text for the split; a very long text is scored whole,
and a word of over MATRIX bytes, as in texts without blanks, arc by arc; an empty table gives no rows; input columns that
are named like the results are replaced, all others but the text pass, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm import common, tokens

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose counts are broadcast: 20 bytes each.
HELD = 500_000
#: Rounds of expectation and maximisation after the vocabulary's own segmentation.
ROUNDS = 2
#: Added to each piece's count.
SMOOTH = 0.1
FOLDS = tokens.folding(tokens.SPACE)
#: Distinct words that a task keeps before it passes their counts on.
KEEP = 200_000
#: Longer words are spelt one by one.
MATRIX = 64
NONE = -1e300


def vocabulary(path: str) -> list[bytes]:
    """The usable pieces of a sentencepiece file: a leading blank for the word mark, none further in. Bytes come first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]): None for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        p = model.id_to_piece(i)
        if "▁" not in p[1:]:
            found[p.replace("▁", " ").encode()] = None
    return list(found)


class Pieces:
    """Piece log probabilities (natural), the forward recursion and the expected counts of pieces."""

    def __init__(self, pieces: list[bytes], counts: np.ndarray, ends: int):
        total = float(counts.sum()) + ends + SMOOTH * (len(pieces) + 1)
        self.size, self.place = len(pieces), {p: i for i, p in enumerate(pieces)}
        self.logp = np.log((counts + SMOOTH) / total)
        self.end = math.log((ends + SMOOTH) / total)
        own: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            own.setdefault(len(p), []).append(i)
        self.longest = max(own)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, ids in own.items():
            keys = _roll(np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8).reshape(-1, n))
            order = np.argsort(keys)
            seen = np.zeros(1 << 16, bool)
            seen[keys >> np.uint64(48)] = True
            self.by_length[n] = seen, keys[order], np.array(ids)[order]

    def _found(self, rolled: np.ndarray, k: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """Where in rolled hashes a piece of k bytes begins, and which."""
        seen, keys, ids = self.by_length[k]
        key = _finish(rolled, k)
        maybe = np.nonzero(seen[key >> np.uint64(48)])
        x = key[maybe]
        pos = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        same = keys[pos] == x
        return tuple(m[same] for m in maybe), ids[pos[same]]

    def arcs(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every piece in a word, by end."""
        chars = np.frombuffer(word, np.uint8)
        rolled = np.zeros(len(chars), np.uint64)
        start, end, piece = [], [], []
        for k in range(1, min(self.longest, len(chars)) + 1):
            width = len(chars) - k + 1
            rolled = _step(rolled[:width], chars[k - 1 :])
            if k in self.by_length:
                (at,), ids = self._found(rolled, k)
                start.append(at)
                end.append(at + k)
                piece.append(ids)
        start, end, piece = (np.concatenate(x) for x in (start, end, piece))
        order = np.argsort(end, kind="stable")
        return start[order], end[order], piece[order]

    @staticmethod
    def _sums(here: np.ndarray, there: np.ndarray, score: np.ndarray, n: int) -> list[float]:
        """Log sums at the places 0 to n: that of here adds those of there by score; arcs are in order of here."""
        out = [0.0] * (n + 1)
        cut = np.searchsorted(here, np.arange(n + 2)).tolist()
        there, score = there.tolist(), score.tolist()
        for j in range(1, n + 1):
            terms = [out[there[i]] + score[i] for i in range(cut[j], cut[j + 1])]
            top = max(terms)
            out[j] = top + math.log(sum(math.exp(t - top) for t in terms)) if len(terms) > 1 else top
        return out

    def one(self, word: bytes) -> float:
        """log probability of a word (with its leading blank), arc by arc: for words of any length."""
        start, end, piece = self.arcs(word)
        return self._sums(end, start, self.logp[piece], len(word))[-1]

    def _expect_one(self, word: bytes, n: float, out: np.ndarray) -> float:
        start, end, piece = self.arcs(word)
        size, score = len(word), self.logp[piece]
        alpha = np.array(self._sums(end, start, score, size))
        back = np.argsort(size - start, kind="stable")
        beta = np.array(self._sums((size - start)[back], (size - end)[back], score[back], size))[::-1]
        out += np.bincount(piece, n * np.exp(alpha[start] + score + beta[end] - alpha[-1]), self.size)
        return float(alpha[-1])

    def _batches(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """The words of up to MATRIX bytes by length, as matrices of their bytes with a leading blank."""
        order = np.argsort(length, kind="stable")
        order = order[length[order] <= MATRIX]
        for lo in range(0, len(order), 4096):
            rows = order[lo : lo + 4096]
            n = int(length[rows[-1]]) + 1
            at = start[rows][:, None] + np.arange(-1, n - 1)
            chars = data[np.minimum(at, len(data) - 1)]
            chars[:, 0] = 32
            yield rows, chars, n

    def many(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """log probabilities of words in data, each with a leading blank."""
        out = np.empty(len(start))
        length = stop - start
        for i in np.flatnonzero(length > MATRIX):
            out[i] = self.one(b" " + bytes(data[start[i] : stop[i]]))
        for rows, chars, n in self._batches(data, start, length):
            alpha = self._forward(self._matrix(chars, n)[0], n)
            out[rows] = alpha[np.arange(len(rows)), length[rows] + 1]
        return out

    def expect(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected counts of the pieces in words that occur `times` times, and the words' log probability."""
        out, total = np.zeros(self.size), 0.0
        length = stop - start
        for i in np.flatnonzero(length > MATRIX):
            total += times[i] * self._expect_one(b" " + bytes(data[start[i] : stop[i]]), float(times[i]), out)
        for rows, chars, n in self._batches(data, start, length):
            dense, sparse = self._matrix(chars, n)
            alpha = self._forward(dense, n)
            last = length[rows] + 1
            whole = alpha[np.arange(len(rows)), last]
            beta = np.full((len(rows), n + 1), NONE)
            beta[:, n] = np.where(last == n, 0.0, NONE)
            for j in range(n - 1, 0, -1):
                terms = np.stack([beta[:, j + k] + dense[k - 1][:, j] for k in range(1, min(len(dense), n - j) + 1)])
                top = terms.max(axis=0)
                beta[:, j] = np.where(last == j, 0.0, top + np.log(np.exp(terms - top).sum(axis=0)))
            for k, (r, c), ids in sparse:
                score = np.minimum(alpha[r, c] + self.logp[ids] + beta[r, c + k] - whole[r], 0.0)
                out += np.bincount(ids, times[rows[r]] * np.exp(score), self.size)
            total += float((times[rows] * whole).sum())
        return out, total

    def _matrix(self, chars: np.ndarray, n: int) -> tuple[list[np.ndarray], list[tuple]]:
        """For each length of pieces a matrix of log probabilities by begin, and the places and pieces behind it."""
        rolled = np.zeros((len(chars), n), np.uint64)
        dense, sparse = [], []
        for k in range(1, min(self.longest, n) + 1):
            width = n - k + 1
            rolled = _step(rolled[:, :width], chars[:, k - 1 : k - 1 + width])
            score = np.full((len(chars), width), NONE)
            if k in self.by_length:
                at, ids = self._found(rolled, k)
                score[at] = self.logp[ids]
                sparse.append((k, at, ids))
            dense.append(score)
        return dense, sparse

    @staticmethod
    def _forward(dense: list[np.ndarray], n: int) -> np.ndarray:
        alpha = np.full((len(dense[0]), n + 1), NONE)
        alpha[:, 0] = 0
        for j in range(1, n + 1):
            terms = np.stack([alpha[:, j - k] + dense[k - 1][:, j - k] for k in range(1, min(len(dense), j) + 1)])
            top = terms.max(axis=0)
            alpha[:, j] = top + np.log(np.exp(terms - top).sum(axis=0))
        return alpha


_M = np.uint64(0x9E3779B97F4A7C15)


def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h + c.astype(np.uint64) + np.uint64(1)) * _M
    return h ^ (h >> np.uint64(29))


def _finish(h: np.ndarray, k: int) -> np.ndarray:
    return tokens.mix(h + np.uint64(k))


def _roll(chars: np.ndarray) -> np.ndarray:
    h = np.zeros(len(chars), np.uint64)
    for k in range(chars.shape[1]):
        h = _step(h, chars[:, k])
    return _finish(h, chars.shape[1])


def count_words(train: DataFrame, text: str = "text") -> DataFrame:
    """word (binary), hash, n over all texts, counted in each task first."""
    common.ship(train.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter = Counter()
        hashes: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            words = list(kept)
            made = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(np.array([hashes[w] for w in words], np.uint64).view(np.int64)), pa.array([kept[w] for w in words], pa.int64())], names=["word", "hash", "n"])
            kept.clear()
            hashes.clear()
            return made

        for batch in batches:
            for _, _, b in tokens.blocks(batch.column(0), FOLDS):
                h, first, n = np.unique(b.hashes(), return_index=True, return_counts=True)
                raw, start, stop = b.data.tobytes(), b.start[first].tolist(), b.stop[first].tolist()
                for x, s, e, c in zip(h.tolist(), start, stop, n.tolist(), strict=True):
                    w = raw[s:e]
                    kept[w] += c
                    hashes[w] = x
                if len(kept) > KEEP:
                    yield out()
        yield out()

    return train.select(text).mapInArrow(run, "word binary, hash long, n long").groupBy("word", "hash").agg(F.sum("n").alias("n"))


def count_pieces(words: DataFrame, path: str, pieces: list[bytes]) -> np.ndarray:
    """Counts of the vocabulary's own segmentation of all training words, a number for each of pieces."""
    spark = words.sparkSession
    common.ship(spark)
    spark.sparkContext.addFile(path)
    name = Path(path).name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece
        from pyspark import SparkFiles

        model = sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(name))
        size = model.get_piece_size()
        total = np.zeros(size, np.int64)
        for batch in batches:
            texts = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            n = np.array(batch.column(1).to_pylist(), np.int64)
            for lo in range(0, len(texts), 10_000):
                ids = model.encode(texts[lo : lo + 10_000], num_threads=1)
                flat = np.array([i for x in ids for i in x], np.int64)
                total += np.bincount(flat, np.repeat(n[lo : lo + 10_000], [len(x) for x in ids]), size).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "n"])

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    place = {p: i for i, p in enumerate(pieces)}
    out = np.zeros(len(pieces))
    for i, n in words.select("word", "n").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n")).collect():  # as many rows as pieces
        p = model.id_to_piece(i)
        key = bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
        if key in place:
            out[place[key]] += n
    return out


def refine(words: DataFrame, pieces: list[bytes], counts: np.ndarray, ends: int) -> tuple[np.ndarray, float]:
    """One round of expectation and maximisation over all training words (word, n): the pieces' expected counts under the
    probabilities that `counts` give, over all segmentations, and the words' log probability (natural) under these."""
    spark = words.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast((pieces, counts, ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(*shared.value)
        total, log = np.zeros(model.size), 0.0
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                own = batch.slice(lo, 20_000)
                texts = own.column(0).to_pylist()
                size = np.array([len(w) for w in texts], np.int64)
                stop = np.cumsum(size + 1)
                data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
                some, one = model.expect(data, stop - size, stop, own.column(1).to_numpy().astype(float))
                total, log = total + some, log + one
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], log))], names=["piece", "n"])

    out, log = np.zeros(len(pieces)), 0.0
    for i, n in words.select("word", "n").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n")).collect():  # as many rows as pieces
        if i < 0:
            log = n
        else:
            out[i] = n
    shared.destroy()
    return out, log


def _least(counted: DataFrame, held: int) -> int:
    """The least count of which at most held words have that count or more."""
    bits = F.least(F.col("n"), F.lit(1 << 20))
    by_count = counted.groupBy(bits.alias("n")).agg(F.count("*").alias("k"))  # few: counts grow rare as they grow large
    running = F.sum("k").over(Window.orderBy(F.desc("n")))
    found = by_count.select("n", running.alias("above")).filter(F.col("above") <= held).agg(F.min("n")).first()[0]
    return 1 << 62 if found is None else found


def score(docs: DataFrame, train: DataFrame, path: str = VOCABULARY, held: int = HELD, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """docs (its columns less text) with n_tokens, n_known, train_tokens, base_score and score (log10), learnt from train."""
    spark = docs.sparkSession
    counted = common.stored(count_words(train, text), "words")
    ends = train.count()
    types, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n, v = total + ends, types + (ends > 0)
    divisor = n + 0.5 * (v + 1)
    pieces = vocabulary(path)
    weights = count_pieces(counted, path, pieces)
    for _ in range(rounds):
        weights, _ = refine(counted, pieces, weights, ends)
    least = _least(counted, held)
    top = counted.filter(F.col("n") >= least).select("hash", "n").toArrow()  # at most held rows of two longs
    keys = top["hash"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    end_base = math.log10((ends + 0.5) / divisor)
    shared = spark.sparkContext.broadcast((keys[order], top["n"].to_numpy()[order], pieces, weights, ends))
    base = common.without(docs, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    others = [c for c in base.columns if c != text]
    fields = [base.schema[c] for c in others]
    row_, known_, base_, rest_ = own = [common.fresh(base, c) for c in ("_row", "_known", "_base", "_rest")]
    from pyspark.sql import types as T

    schema = T.StructType([*fields, *[T.StructField(k, t) for k, t in ((row_, T.LongType()), ("n_tokens", T.LongType()), (known_, T.LongType()), (base_, T.DoubleType()), ("score", T.DoubleType()), (rest_, T.ArrayType(T.LongType())))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, counts, pieces, weights, ends = shared.value
        model = Pieces(pieces, weights, ends)
        logs = np.log10((counts + 0.5) / divisor)
        spelt = np.full(len(keys), np.nan)
        seen = np.zeros(1 << 22, bool)
        seen[keys >> np.uint64(42)] = True
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            parts: list[list] = [[], [], [], [], []]
            for _, _, b in tokens.blocks(batch.column(batch.schema.get_field_index(text)), FOLDS):
                h, first, back = np.unique(b.hashes(), return_index=True, return_inverse=True)
                place = np.full(len(h), -1)
                maybe = np.flatnonzero(seen[h >> np.uint64(42)])
                if len(keys) and len(maybe):
                    pos = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
                    same = keys[pos] == h[maybe]
                    place[maybe[same]] = pos[same]
                known = place >= 0
                lp = np.empty(len(h))
                lp[known] = spelt[place[known]]
                todo = np.flatnonzero(~known | np.isnan(np.where(known, lp, 0)))
                lp[todo] = model.many(b.data, b.start[first[todo]], b.stop[first[todo]])
                spelt[place[known]] = lp[known]
                logs_of = np.zeros(len(h))
                logs_of[known] = logs[place[known]]
                parts[0].append(b.counts + 1)
                parts[1].append(np.bincount(b.row, known[back], b.rows).astype(np.int64) + int(ends > 0))
                parts[2].append(np.bincount(b.row, logs_of[back], b.rows) + end_base)
                parts[3].append((np.bincount(b.row, lp[back], b.rows) + model.end) / math.log(10))
                rest = ~known[back]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(b.row[rest], minlength=b.rows))])
                parts[4].append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h[back[rest]].view(np.int64))))
            size = batch.num_rows
            if not size:
                continue
            made = [pa.array(np.arange(row, row + size)), *[pa.array(np.concatenate(p)) for p in parts[:4]], pa.concat_arrays(parts[4])]
            row += size
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in others], *made], schema=None, names=[*others, row_, "n_tokens", known_, base_, "score", rest_])

    common.ship(spark)
    part = common.stored(base.mapInArrow(run, schema), "lm-part")
    rest = part.select(F.col(row_).alias("_row"), F.explode(rest_).alias("hash")).groupBy("_row", "hash").agg(F.count("*").alias("m"))
    by_hash = counted.groupBy("hash").agg(F.sum("n").alias("c"))
    c = F.coalesce("c", F.lit(0))
    found = rest.join(by_hash, "hash", "left").groupBy(F.col("_row").alias(own[0] + "_")).agg(F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias(own[1] + "_"), F.sum(F.col("m") * F.log10((c + 0.5) / divisor)).alias(own[2] + "_"))
    return part.join(found, F.col(row_) == F.col(row_ + "_"), "left").select(
        *others,
        "n_tokens",
        (F.col(known_) + F.coalesce(known_ + "_", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col(base_) + F.coalesce(base_ + "_", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", common.doc_mod(5) == 1)
    out = score(docs, docs.filter(~F.col("held_out")).select("text"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
