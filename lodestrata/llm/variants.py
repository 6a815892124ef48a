"""Spelling variants: words that differ by one inserted, deleted or replaced letter, and the form that each is a variant of.

Words are maximal runs of Latin letters, A-Z in lower case, of FEWEST code points and BAR occurrences at least. They make
compact tries (a chain of letters is one node), sorted ranges of the words cut into shards of at most SHARD words and CHARS
characters. The shards are broadcast; a word's distance-one Levenshtein automaton, two bit masks of the places that are reached
with no and with one edit, goes through each depth-first, leaves a subtree when both are empty, and emits the words that it
accepts. Each shard has its words forwards and backwards: the edit lies in one half of a word, and the other half is looked up
first, so that the automaton starts far from the crowded top. Counts and the best form are reduced by word; roots follow the forms by doubling, as each form is far more frequent
than its word.

Scale: runs are counted in the tasks that read the texts and again before they are shuffled, so that a word with a third of
all runs is a row for each task. Words with their counts are narrow rows in a stored table, which tasks build the shards from.
At most PASS bytes of shards are in the driver and in a broadcast at a time; with more shards the words pass several times,
and each pass's pairs are stored before its broadcast goes. A word has as many near words as there are one-letter edits at most.

Defined cases: null and empty texts have no words; very long texts are worked on in one block of their own, very long runs by
themselves; a null doc_id counts as the empty text before the colon; rows that share doc_id are read each; ties between forms
go to the smaller one in code-point order; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import common, tokens

FEWEST = 6
BAR = 5
#: A form is so many times as frequent as its variants.
TIMES = 5
#: Runs of which some lose a letter: those whose crc32 it divides.
LOSES = 199
SHARD, CHARS = 300_000, 4 << 20
#: Bytes of shards in a broadcast: a worker's tries take some twenty times as much.
PASS = 16 << 20
#: Words in a task that looks for near ones.
TASK = 2_000
BLOCK = 2 << 20
#: More than any code point.
FAR = 0x110000

_held: dict[str, list[Shard]] = {}

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: The first byte of the letters from U+00C0 to U+00FF in UTF-8, and of no other characters.
_LEAD = 0xC3
_WORD, _FOLD = tokens.folding(b" ")


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> 1), t >> 1)
    return t


_CRC = _crc_table()


class Runs(tokens.Block):
    """The runs of Latin letters of some rows."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        lead = raw == _LEAD
        inside = _LETTER[raw] | lead
        inside[1:] |= lead[:-1]
        super().__init__(np.where(inside, raw, np.uint8(32)), offsets, _WORD, _FOLD)
        before = np.concatenate([[0], np.cumsum(lead)])
        self.points = self.stop - self.start - (before[self.stop] - before[self.start])

    def only(self, keep: np.ndarray) -> None:
        self.start, self.stop, self.row, self.points = self.start[keep], self.stop[keep], self.row[keep], self.points[keep]

    def crc(self, begun: np.ndarray) -> np.ndarray:
        """crc32 of each run behind a text of its row with the crc32 in begun."""
        out = begun[self.row].astype(np.uint32)
        length = self.stop - self.start
        for i in np.flatnonzero(length > tokens.LONG_WORD):
            out[i] = zlib.crc32(self.data[self.start[i] : self.stop[i]], int(out[i]))
        order = np.argsort(length, kind="stable")
        order = order[length[order] <= tokens.LONG_WORD]
        sizes, at, reg = length[order], self.start[order], ~out[order]
        for j in range(int(sizes[-1]) if len(sizes) else 0):
            live = np.searchsorted(sizes, j, "right")
            r = reg[live:]
            reg[live:] = _CRC[(r ^ self.data[at[live:] + j]) & 255] ^ (r >> 8)
        out[order] = ~reg
        return out


def counted(docs: DataFrame, fewest: int = FEWEST, bar: int = BAR, loses: int = LOSES) -> DataFrame:
    """word, n: the distinct words of docs (doc_id, text)."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tokens.buffers(batch.column(1))
            for lo, hi in tokens.spans(offsets, BLOCK):
                block = Runs(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                block.only(block.points >= fewest)
                begun = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in batch.column(0).slice(lo, hi - lo).to_pylist()], np.uint32)
                crc = block.crc(begun)
                hit = crc % loses == 0
                made = []
                for i in np.flatnonzero(hit):
                    word = bytes(block.data[block.start[i] : block.stop[i]]).decode()
                    k = int(crc[i]) % len(word)
                    if len(word) > fewest:
                        made.append(word[:k] + word[k + 1 :])
                block.only(~hit)
                _, first, n = np.unique(block.hashes(), return_index=True, return_counts=True)
                words = [bytes(block.data[a:b]).decode() for a, b in zip(block.start[first], block.stop[first], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([*words, *made], pa.string()), pa.array(np.concatenate([n, np.ones(len(made), np.int64)]))], names=["word", "n"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= bar)


class Trie:
    """Nodes in the order of a depth-first walk: label, count (0: no word ends here) and the node behind the subtree."""

    def __init__(self, labels: list[str], counts: list[int], behind: list[int]):
        self.labels, self.counts, self.behind = labels, counts, behind
        #: A node's child by the first letter of its label: node * FAR + code point, -1 above the first nodes.
        self.child: dict[int, int] = {}
        path: list[int] = []
        for i, label in enumerate(labels):
            while path and behind[path[-1]] <= i:
                path.pop()
            self.child[(path[-1] if path else -1) * FAR + ord(label[0])] = i
            path.append(i)

    @classmethod
    def of(cls, words: list[tuple[str, int]]) -> Trie:
        """From distinct words in order."""
        labels: list[str] = []
        counts: list[int] = []
        behind: list[int] = []
        # Nodes are closed when a word leaves them; a node that a word leaves midway is split there, so labels are made from
        # the depths at which words part.
        parts = [_common(a[0], b[0]) for a, b in zip(words, words[1:])] + [0]
        open_: list[tuple[int, int]] = []  # node, depth of its end
        before = 0
        for k, (word, n) in enumerate(words):
            while open_ and open_[-1][1] > before:
                behind[open_.pop()[0]] = len(labels)
            depth = open_[-1][1] if open_ else 0
            for end in [*_branches(parts, k, depth, len(word)), len(word)]:
                open_.append((len(labels), end))
                labels.append(word[depth:end])
                counts.append(n if end == len(word) else 0)
                behind.append(0)
                depth = end
            before = parts[k]
        for node, _ in open_:
            behind[node] = len(labels)
        return cls(labels, counts, behind)

    def pack(self) -> bytes:
        text = "".join(self.labels)
        table = pa.table({"size": pa.array([len(x) for x in self.labels], pa.int32()), "n": pa.array(self.counts, pa.int64()), "behind": pa.array(self.behind, pa.int32())}, metadata={"text": text})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    @classmethod
    def unpack(cls, blob: bytes) -> Trie:
        table = pa.ipc.open_stream(blob).read_all()
        text, at, labels = table.schema.metadata[b"text"].decode(), 0, []
        for n in table["size"].to_pylist():
            labels.append(text[at : at + n])
            at += n
        return cls(labels, table["n"].to_pylist(), table["behind"].to_pylist())

    def after(self, prefix: str, rest: str) -> Iterator[tuple[str, int]]:
        """The words that begin with prefix and go on with something at distance one from rest; what goes on, and their counts.

        The prefix is looked up. From there the automaton of rest goes on depth-first: while no edit is made all children are
        tried; once it is made, the places that are reached name the letters that can follow, three at most."""
        labels, counts, behind, child = self.labels, self.counts, self.behind, self.child
        i, at, tail = -1, 0, ""
        while at < len(prefix):
            i = child.get(i * FAR + ord(prefix[at]))
            if i is None:
                return
            label = labels[i]
            if prefix.startswith(label, at):
                at += len(label)
            elif label.startswith(prefix[at:]):
                tail, at = label[len(prefix) - at :], len(prefix)
            else:
                return
        places: dict[str, int] = {}
        for k, c in enumerate(rest):
            places[c] = places.get(c, 0) | 1 << k
        end = 1 << len(rest)
        # Nodes, what of their label is still to be read, the letters so far, and the places reached before without and with one edit.
        todo: list[tuple[int, str, str, int, int]] = [(i, tail, "", 1, 2)]
        while todo:
            i, label, letters, exact, edited = todo.pop()
            for c in label:
                hit = places.get(c, 0)
                step = (exact & hit) << 1
                edited = (edited & hit) << 1 | exact | exact << 1 | step << 1
                if not edited:
                    break
                exact = step
            else:
                letters += label
                if i >= 0 and edited & end and not exact & end and counts[i]:
                    yield letters, counts[i]
                j, last = i + 1, behind[i] if i >= 0 else len(labels)
                if exact:
                    while j < last:
                        todo.append((j, labels[j], letters, exact, edited))
                        j = behind[j]
                elif j < last:
                    base, left, seen = i * FAR, edited & (end - 1), ""
                    while left:
                        low = left & -left
                        left ^= low
                        c = rest[low.bit_length() - 1]
                        if c not in seen and (k := child.get(base + ord(c))) is not None:
                            todo.append((k, labels[k], letters, 0, edited))
                        seen += c


class Shard:
    """The tries of some words, read forwards and backwards. An edit lies in a word's first or in its second half, so the other
    half leads to a narrow part of one of them."""

    def __init__(self, forwards: Trie, backwards: Trie):
        self.forwards, self.backwards = forwards, backwards

    @classmethod
    def of(cls, words: list[tuple[str, int]]) -> Shard:
        return cls(Trie.of(words), Trie.of(sorted((w[::-1], n) for w, n in words)))

    def pack(self) -> bytes:
        a, b = self.forwards.pack(), self.backwards.pack()
        return len(a).to_bytes(8, "little") + a + b

    @classmethod
    def unpack(cls, blob: bytes) -> Shard:
        n = int.from_bytes(blob[:8], "little")
        return cls(Trie.unpack(blob[8 : 8 + n]), Trie.unpack(blob[8 + n :]))

    def near(self, word: str) -> dict[str, int]:
        """The words at distance one and their counts."""
        half = len(word) // 2
        a, b = word[:half], word[half:]
        out = {a + x: n for x, n in self.forwards.after(a, b)}
        for x, n in self.backwards.after(b[::-1], a[::-1]):
            out[x[::-1] + b] = n
        return out


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


def _branches(parts: list[int], k: int, depth: int, length: int) -> list[int]:
    """Depths between depth and length at which later words part from word k, while they still share more than depth with it."""
    out: list[int] = []
    low = length
    while k < len(parts) and low > depth:
        if parts[k] < low:
            low = parts[k]
            if low > depth:
                out.append(low)
        k += 1
    return out[::-1]


def shards(words: DataFrame, total: int, shard: int = SHARD, chars: int = CHARS) -> DataFrame:
    """id, bytes and trie of each shard of words (word, n), ranges in order."""
    common.ship(words.sparkSession)
    parts = max(1, -(-total // shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int]] = []
        size = 0

        def made() -> pa.RecordBatch:
            blob = Shard.of(held).pack()
            return pa.RecordBatch.from_arrays([pa.array([held[0][0]]), pa.array([len(blob)], pa.int64()), pa.array([blob], pa.binary())], names=["id", "bytes", "trie"])

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (len(held) >= shard or size + len(word) > chars):
                    yield made()
                    held, size = [], 0
                held.append((word, n))
                size += len(word)
        if held:
            yield made()

    ordered = words.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word")
    return ordered.mapInArrow(run, "id string, bytes long, trie binary")


def pairs(words: DataFrame, shard: int = SHARD, chars: int = CHARS, most: int = PASS, task: int = TASK) -> DataFrame:
    """word, near, near_n: all pairs at distance one, both ways. words (word, n) are distinct and stored."""
    spark = words.sparkSession
    common.ship(spark)
    total = words.count()
    tries = common.stored(shards(words, total, shard, chars), "variants-tries")
    passes: list[list[str]] = []
    room = 0
    for name, size in tries.select("id", "bytes").sort("id").collect():
        if not passes or size > room:
            passes.append([])
            room = most
        passes[-1].append(name)
        room -= size
    dealt = words.repartition(max(1, -(-total // task)), "word")
    out = None
    for names in passes:
        held = spark.sparkContext.broadcast([bytes(r["trie"]) for r in tries.filter(F.col("id").between(names[0], names[-1])).select("trie").collect()])

        def run(batches: Iterator[pa.RecordBatch], held=held, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            from lodestrata.llm import variants

            if key not in variants._held:  # kept while the worker lives
                variants._held.clear()
                variants._held[key] = [variants.Shard.unpack(b) for b in held.value]
            own = variants._held[key]
            for batch in batches:
                found = [(w, x, n) for w in batch.column(0).to_pylist() for trie in own for x, n in trie.near(w).items()]
                a, b, n = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], names=["word", "near", "near_n"])

        got = common.stored(dealt.select("word").mapInArrow(run, "word string, near string, near_n long"), "variants-pairs")
        held.unpersist()
        out = got if out is None else out.unionByName(got)
    common.release(tries)
    return out if out is not None else spark.createDataFrame([], "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of stored forms (word, form): the last word that following the forms leads to. Forms must not go in circles."""
    now = common.stored(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = now.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        step = common.stored(moved, "variants-roots")
        common.release(now)
        now = step
        if not now.filter("_moved").limit(1).count():
            return now.drop("_moved")
        now = _without(now)


def _without(df: DataFrame) -> DataFrame:
    """df less its mark, still the stored table that can be released."""
    out = df.drop("_moved")
    out.__dict__["_stored_at"] = df.__dict__.get("_stored_at")
    return out


def group(docs: DataFrame, fewest: int = FEWEST, bar: int = BAR, times: int = TIMES, loses: int = LOSES, **how) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of docs (doc_id, text)."""
    words = common.stored(counted(docs, fewest, bar, loses), "variants-words")
    near = pairs(words, **how)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    far = -F.col("best.less") >= times * F.col("n")
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n"))
    known = common.stored(joined, "variants-forms")
    ends = roots(known.filter("form IS NOT NULL"))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(common.table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE_SQL = f"""
WITH RECURSIVE run AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), per AS (
    SELECT doc_id, w, count(*) AS k FROM run WHERE length(w) >= {FEWEST} GROUP BY ALL
), {common.crc32_sql("SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS t FROM per")}, hashed AS (
    SELECT w, k, h FROM per JOIN crc ON t = coalesce(doc_id::VARCHAR, '') || ':' || w
), lost AS (
    SELECT CASE WHEN h % {LOSES} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed
), words AS (
    SELECT word, sum(k)::BIGINT AS n FROM lost WHERE length(word) >= {FEWEST} GROUP BY word HAVING sum(k) >= {BAR}
), holes AS (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON h.rest = w.word
    UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON h.rest = w.word
), ranked AS (
    SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near
), forms AS (
    SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= {TIMES} * w.n THEN r.near END AS form, CASE WHEN r.near_n >= {TIMES} * w.n THEN r.near_n END AS form_n
    FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
), chain AS (
    SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.at AND e.form IS NULL
"""
