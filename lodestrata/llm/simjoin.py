"""N-gram Jaccard join with token-combination prefixes, and the classes of linked documents.

A document's set holds its distinct shingles of `k` words (hashed to 64 bits); with fewer words the whole sequence is
one. Two documents link when 100 * intersection >= percent * union. The join is exact:

1. Equal sets (by a 128-bit sum) become one class; only classes are joined.
2. Token frequencies over all documents give a global order: rare tokens first, by hash, then frequent ones by frequency.
   The most frequent ones are known exactly, the others above the bar by a filter of bits: what it takes for frequent
   besides is so for every set, and changes no result.
3. Of a set of n tokens, a partner lacks t = n - ceil(percent * n / 100) at most. Its prefix extends until it holds t + 1
   signatures that t absences cannot destroy: each rare token is one by itself; of frequent tokens every pair within a
   subclass is indexed, so a subclass with c of them survives c - 1 absences. Subclasses split the frequent tokens of
   large sets by hash, 2^level of them, to keep pairs linear in n; the level follows log2(n), and a set whose larger
   partners have the next level is indexed at that level too.
4. Classes that meet in short lists of rare tokens are candidates if the rare tokens they share, with all that the
   prefixes leave open, can reach the overlap that is needed. Longer lists and pairs of frequent tokens name a pivot, and
   all their classes become candidates of one group through it, without emitting pairs of the list.
5. Groups of candidates are verified whole: the tokens of at most BLOCK classes by BLOCK are multiplied as matrices in
   a task, which passes on only a spanning forest of the links found. Components of these forests are the answer.

Scale: texts are never shuffled; token counts and signatures travel as compressed sorted blocks, a signature in some ten
bytes; equal sets are dropped in each task before the shuffle; of hot lists one pivot stays in memory. Lists of rare tokens
stay short however many tokens are frequent, or their pivots would join all documents in one group. A group larger than a block is dealt out as pairs
of blocks, so no task holds more than two; blocks hold classes of like size, and only those meet whose sizes can link.
A component's hubs are broadcast, so no key of the joins is hot.

Defined cases: null or wordless texts have an empty set and link with nothing, not even each other; rows that repeat are
copies of one another; a null doc_id takes part, and its component_id is the smallest doc_id of its component, null if
there is none; rows of one doc_id with different texts are documents of their own; a very long text is one set, held
whole in one task; an empty table gives no rows; clashing names: only doc_id and text are read, and `deduplicate` gives
the columns of its input back as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import common, tokens
from lodestrata.llm.components import components

FOLDS = tokens.folding(tokens.SPACE)
U = np.uint64
#: A token this frequent is a candidate for the frequent classes; FREQUENT of them at most, else the bar is doubled. Those
#: below that bar are bits of a filter of 2^MIDDLE, 32 MB; MIDDLING tokens in it at most, else its own bar is doubled.
BAR, FREQUENT = 16, 1_000_000
MIDDLE, MIDDLING = 28, 1 << 25
#: Bits of a token's hash that are counted, and tokens that a task gathers or a reducer merges at once.
COUNTED, GATHER = 40, 2_000_000
#: Bits of a signature, bits of s1 that name a class beside it, and signatures that a task packs at once (twice: holds).
SIGNED, NAMED, HELD = 40, 48, 1_000_000
#: Lists of rare tokens up to this long give pairs.
LIST = 16
BLOCK, BLOCK_TOKENS = 768, 2_000_000
#: Bits of the filter that names the classes whose tokens are wanted: 16 MB, whatever their number.
FILTER, PARTS = 27, 8


@dataclass(frozen=True)
class Rule:
    k: int = 3
    percent: int = 90

    def least(self) -> int:
        """The smallest set that can link with one that differs."""
        return -(-self.percent // (100 - self.percent)) if self.percent < 100 else 1 << 40

    def misses(self, n: int) -> int:
        return n - -(-self.percent * n // 100)


def sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row its number and its sorted distinct shingles."""
    for lo, _, b in tokens.blocks(column, FOLDS):
        h = b.hashes()
        wh, at = b.windows(h, k)
        ends = np.searchsorted(at, b.ends)
        short = np.flatnonzero((b.counts > 0) & (b.counts < k))
        few = {}
        for n in np.unique(b.counts[short]).tolist():
            sh, sa = b.windows(h, n)
            for r in short[b.counts[short] == n].tolist():
                few[r] = sh[np.searchsorted(sa, b.ends[r])].reshape(1)
        for r in range(b.rows):
            yield lo + r, few[r] if r in few else np.unique(wh[ends[r] : ends[r + 1]])


def key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    one = int(tokens.mix(s).sum(dtype=U))
    two = int(tokens.mix(s * U(0xC2B2AE3D27D4EB4F) + U(len(s))).sum(dtype=U))
    return one - (1 << 64) if one >> 63 else one, two - (1 << 64) if two >> 63 else two


def _classes(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, a hash of the text, n and the set's key of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two = [], [], []
            for _, s in sets(batch.column(1), rule.k):
                a, b = key(s)
                n.append(len(s))
                one.append(a)
                two.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["doc_id", "h", "n", "s1", "s2"])

    return docs.select("doc_id", "text", _text_hash().alias("h")).mapInArrow(run, "doc_id long, h long, n long, s1 long, s2 long")


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    steps = np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8)[:, :5]
    some = np.minimum(counts, 255).astype(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.column_stack([steps, some]).T).tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(6, -1)
    steps = np.zeros((rows.shape[1], 8), np.uint8)
    steps[:, :5] = rows[:5].T
    return np.cumsum(steps.view(U).ravel(), dtype=U), rows[5].astype(np.int64)


def _frequent(docs: DataFrame, rule: Rule, total: int) -> DataFrame:
    """key (of COUNTED bits) and count of the tokens in BAR documents or more (counts over 255 in a task count as 255)."""
    ranges = max(4, int(total / GATHER).bit_length())  # bits
    shift = U(COUNTED - ranges)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        size = 0

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(keys, np.arange(1 << ranges, dtype=U) << shift)
            cut = np.append(cut, len(keys))
            some = [r for r in range(1 << ranges) if cut[r + 1] > cut[r]]
            blobs = [pack(keys[cut[r] : cut[r + 1]], counts[cut[r] : cut[r + 1]]) for r in some]
            held.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], names=["range", "blob"])

        for batch in batches:
            for _, s in sets(batch.column(0), rule.k):
                if len(s) >= rule.least() and (name := key(s)) not in seen:
                    seen.add(name)
                    held.append(s >> U(64 - COUNTED))
                    size += len(s)
                    if size >= GATHER:
                        yield out()
                        size = 0
        if held:
            yield out()

    def merge(table: pa.Table) -> pa.Table:
        parts = [unpack(b.as_py()) for b in table.column("blob")]
        keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)
        often = counts >= BAR
        return pa.table({"key": keys[often].view(np.int64), "count": counts[often]})

    blobs = docs.select("text").mapInArrow(gather, "range int, blob binary")
    return blobs.groupBy("range").applyInArrow(merge, "key long, count long")


def _bars(counted: DataFrame) -> tuple[int, int]:
    """The least powers of two from BAR on that leave FREQUENT and MIDDLING tokens at most."""
    by = counted.groupBy(F.floor(F.log2(F.col("count").cast("double"))).alias("b")).agg(F.count("*").alias("n")).collect()  # 60 rows at most

    def least(most: int) -> int:
        bar = BAR
        while sum(r["n"] for r in by if 2 ** r["b"] >= bar) > most:
            bar *= 2
        return bar

    return least(FREQUENT), least(MIDDLING)


def _order(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sorted keys of the most frequent tokens, their frequency classes, and the filter of the other frequent ones, if any."""
    bar, low = _bars(counted)
    top = counted.filter(F.col("count") >= bar).toArrow()  # FREQUENT rows at most
    keys, often = top["key"].to_numpy().view(U), top["count"].to_numpy()
    order = np.argsort(keys)
    middle = None
    if low < bar:
        between = (F.col("count") >= low) & (F.col("count") < bar)
        middle = _filter(counted.filter(between).select(F.shiftleft("key", 64 - COUNTED).alias("s1")), MIDDLE)
    return keys[order], np.floor(np.log2(np.maximum(often[order], 1))).astype(np.int8), middle


def level(n: int) -> int:
    return max(0, n.bit_length() - 8)


def prefix(s: np.ndarray, order: np.ndarray, often: np.ndarray, rule: Rule) -> tuple[np.ndarray, list[np.ndarray], int]:
    """Single tokens, signatures of pairs, and how many tokens the singles leave open, of a set.

    often marks the frequent tokens of s, order is their frequency class."""
    n = len(s)
    need = rule.misses(n) + 1
    rare = s[~often]
    if len(rare) >= need:
        return rare[:need], [], n - need
    freq = s[often][np.lexsort((s[often], order[often]))]
    pairs = []
    for lv in sorted({level(n), level(100 * n // rule.percent)}):
        sub = freq & U((1 << lv) - 1)
        _, first = np.unique(sub, return_index=True)
        gain = np.ones(len(freq), np.int64)
        gain[first] = 0
        reached = np.flatnonzero(len(rare) + np.cumsum(gain) >= need)
        m = int(reached[0]) + 1 if len(reached) else len(freq)
        for g in np.unique(sub[:m]):
            own = np.sort(freq[:m][sub[:m] == g])
            i, j = np.triu_indices(len(own), 1)
            pairs.append(tokens.mix(own[i] * U(0x9E3779B97F4A7C15) ^ tokens.mix(own[j] + U(lv + 1))))
    return rare, pairs, n - len(rare)


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype(U).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def pack_signatures(sig: np.ndarray, name: np.ndarray, n: np.ndarray, slack: np.ndarray, rule: Rule) -> bytes:
    """Rows in the order of sig. Where all single tokens of a prefix are rare, slack follows from n: it takes no room."""
    lack = np.where(slack < 0, 0, slack - (n - rule.misses(n) - 1) + 1)
    return zstandard.ZstdCompressor(level=1).compress(_planes(np.diff(sig, prepend=U(0)), SIGNED // 8) + _planes(name, NAMED // 8) + _planes(n, 4) + _planes(lack, 4))


def unpack_signatures(blob: bytes, rule: Rule) -> list[np.ndarray]:
    rows = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape((SIGNED + NAMED) // 8 + 8, -1)
    out, at = [], 0
    for width in (SIGNED // 8, NAMED // 8, 4, 4):
        x = np.zeros((rows.shape[1], 8), np.uint8)
        x[:, :width] = rows[at : at + width].T
        out.append(x.view(np.int64).ravel())
        at += width
    steps, name, n, lack = out
    return [np.cumsum(steps), name, n, np.where(lack == 0, -1, lack - 1 + n - rule.misses(n) - 1)]


def _signatures(docs: DataFrame, rule: Rule, frequent: tuple[np.ndarray, np.ndarray, np.ndarray | None], total: int) -> DataFrame:
    """Every indexed signature with its class's name, n and slack (-1 for pairs of frequent tokens), packed by range."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    ranges = max(4, int(2 * total / GATHER).bit_length())  # bits
    shift = U(SIGNED - ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, classes, middle = shared.value
        seen: set[tuple[int, int]] = set()
        out: list[tuple[np.ndarray, int, int, int]] = []
        size = 0

        def made() -> pa.RecordBatch:
            lengths = [len(x[0]) for x in out]
            sig = tokens.mix(np.concatenate([x[0] for x in out])) >> U(64 - SIGNED)
            order = np.argsort(sig)
            rows = [sig[order], *[np.repeat(np.array([x[i] for x in out], np.int64), lengths)[order] for i in (1, 2, 3)]]
            out.clear()
            cut = np.append(np.searchsorted(rows[0], np.arange(1 << ranges, dtype=U) << shift), len(sig))
            some = [r for r in range(1 << ranges) if cut[r + 1] > cut[r]]
            blobs = [pack_signatures(*[c[cut[r] : cut[r + 1]] for c in rows], rule) for r in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], names=["range", "blob"])

        for batch in batches:
            for _, s in sets(batch.column(0), rule.k):
                if len(s) < rule.least() or (name := key(s)) in seen:
                    continue
                seen.add(name)
                if len(seen) > 500_000:
                    seen.clear()
                part = s >> U(64 - COUNTED)
                often, order = np.zeros(len(s), bool), np.full(len(s), BAR.bit_length() - 1, np.int8)
                if middle is not None:
                    at = (part >> U(COUNTED - MIDDLE)).astype(np.int64)
                    often = (middle[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
                if len(keys):
                    pos = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
                    top = keys[pos] == part
                    often |= top
                    order[top] = classes[pos[top]]
                single, pairs, slack = prefix(s, order, often, rule)
                short = (name[0] & ((1 << 64) - 1)) >> (64 - NAMED)
                for sigs, open_ in [(single, slack), *[(p, -1) for p in pairs]]:
                    if len(sigs):
                        out.append((sigs, short, len(s), open_))
                        size += len(sigs)
                if size > HELD:
                    yield made()
                    size = 0
        if out:
            yield made()

    return docs.select("text").mapInArrow(run, "range int, blob binary")


def _lists(held: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in the order of sig and name, where each list begins, its length, and whether it takes a pivot."""
    cols = [np.concatenate([h[i] for h in held]) for i in range(4)]
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    keep = np.ones(len(order), bool)
    keep[1:] = np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)
    cols = [c[keep] for c in cols]
    head = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))
    length = np.diff(np.append(head, len(cols[0])))
    return cols, head, length, (length > LIST) | (np.minimum.reduceat(cols[3], head) < 0)


def meet(held: list[list[np.ndarray]], rule: Rule) -> list[np.ndarray]:
    """Candidate edges of whole lists: columns sig, name, n, slack to a, b, need (-1: by a pivot)."""
    (sig, name, n, slack), head, length, pivoted = _lists(held)
    run = np.repeat(np.arange(len(head)), length)
    left, right, need = [], [], []
    i = np.flatnonzero(pivoted[run])
    i = i[i != head[run[i]]]
    left.append(head[run[i]])
    right.append(i)
    need.append(np.full(len(i), -1))
    short = ~pivoted & (length > 1)
    for lag in range(1, int(length[short].max()) if short.any() else 0):
        i = np.flatnonzero(short[run[: len(sig) - lag]] & (run[: len(sig) - lag] == run[lag:]))
        small, large = np.minimum(n[i], n[i + lag]), np.maximum(n[i], n[i + lag])
        fit = 100 * small >= rule.percent * large
        i, small, large = i[fit], small[fit], large[fit]
        overlap = -(-rule.percent * (small + large) // (100 + rule.percent))
        left.append(i)
        right.append(i + lag)
        need.append(np.maximum(overlap - np.maximum(slack[i], slack[i + lag]), 0))
    a, b = np.concatenate(left), np.concatenate(right)
    return [name[a], name[b], np.concatenate(need).astype(np.int32)]


def fold(held: list[list[np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of the lists so far that take a pivot, and the rows that stay: their pivots, marked, and the other lists."""
    cols, head, length, pivoted = _lists(held)
    run = np.repeat(np.arange(len(head)), length)
    cols[3] = np.where(pivoted[run], -1, cols[3])
    first = np.zeros(len(run), bool)
    first[head] = True
    others = np.flatnonzero(pivoted[run] & ~first)
    edges = [cols[1][head[run[others]]], cols[1][others], np.full(len(others), -1, np.int32)]
    stay = ~pivoted[run] | first
    return edges, [c[stay] for c in cols]


def _candidates(signatures: DataFrame, rule: Rule) -> DataFrame:
    """a, b: edges between names of classes that may link, or that a pivot holds together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, most = None, [], 0, 2 * HELD
        out = lambda edges: pa.RecordBatch.from_arrays([pa.array(c) for c in edges], names=["a", "b", "need"])
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != now and held:
                    yield out(meet(held, rule))
                    held, size, most = [], 0, 2 * HELD
                now = part
                held.append(unpack_signatures(blob.as_py(), rule))
                size += len(held[-1][0])
                if size > most:
                    edges, rest = fold(held)
                    yield out(edges)
                    held, size = [rest], len(rest[0])
                    most = max(most, 2 * size)
        if held:
            yield out(meet(held, rule))

    ordered = signatures.repartition("range").sortWithinPartitions("range")
    met = ordered.mapInArrow(run, "a long, b long, need int")
    return met.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("need").alias("need")).filter("need < 0 OR c >= need").select("a", "b")


def _filter(classes: DataFrame, size: int = FILTER) -> np.ndarray:
    """A bit for each leading `size` bits of s1 that a row has; set in parts on executors, so no keys reach the driver."""

    def mark(table: pa.Table) -> pa.Table:
        at = (table["s1"].to_numpy().view(U) >> U(64 - size)) & U((1 << (size - PARTS)) - 1)
        bits = np.zeros(1 << (size - PARTS), bool)
        bits[at] = True
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    keyed = classes.select(F.shiftrightunsigned("s1", 64 - PARTS).alias("part"), "s1")
    found = keyed.groupBy("part").applyInArrow(mark, "part long, bits binary").toArrow()  # 2^PARTS rows of fixed size
    out = np.zeros((1 << PARTS, 1 << (size - PARTS - 3)), np.uint8)
    for part, bits in zip(found["part"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[part] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def _tokens(docs: DataFrame, rule: Rule, wanted: np.ndarray) -> DataFrame:
    """s1, s2, tokens of the classes that the filter lets through: all that are wanted, and a few more."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            one, two, blobs = [], [], []
            for _, s in sets(batch.column(0), rule.k):
                if len(s) < rule.least():
                    continue
                name = key(s)
                at = (name[0] & ((1 << 64) - 1)) >> (64 - FILTER)
                if name in seen or not wanted[at >> 3] >> (7 - (at & 7)) & 1:
                    continue
                seen.add(name)
                one.append(name[0])
                two.append(name[1])
                blobs.append(s.tobytes())
            if len(seen) > 500_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(blobs, pa.binary())], names=["s1", "s2", "tokens"])

    return docs.select("text").mapInArrow(run, "s1 long, s2 long, tokens binary")


def forest(ids: list[int], found: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """A star for each component of the links among some sets."""
    m = len(ids)
    size = np.array([len(x) for x in found])
    if m == 2:
        inter = np.array([[0, len(np.intersect1d(found[0], found[1], assume_unique=True))]] * 2)
        inter[1] = inter[0][::-1]
    else:
        words, column, often = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), size)
        shared = often[column] > 1
        row, column = row[shared], column[shared]
        _, column = np.unique(column, return_inverse=True)
        inter = np.zeros((m, m), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        wide = int(column[-1]) + 1 if len(column) else 0
        step = max(1024, 8_000_000 // m)
        for lo in range(0, wide, step):
            a, b = np.searchsorted(column, [lo, lo + step])
            x = np.zeros((m, min(step, wide - lo)), np.float32)
            x[row[a:b], column[a:b] - lo] = 1
            inter += x @ x.T
        inter = inter.astype(np.int64)
    link = 100 * inter >= rule.percent * (size[:, None] + size[None, :] - inter)
    np.fill_diagonal(link, False)
    out, left = [], np.ones(m, bool)
    for i in np.argsort(ids).tolist():
        if left[i]:
            left[i] = False
            todo = [i]
            while todo:
                new = np.flatnonzero(link[todo.pop()] & left)
                left[new] = False
                todo += new.tolist()
                out += [(ids[i], ids[j]) for j in new.tolist()]
    return out


def _links(members: DataFrame, rule: Rule) -> DataFrame:
    """u, v: forests of the links within each group (label, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, edges = None, {}, []

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["u", "v"])
            edges.clear()
            return out

        for batch in batches:
            for *group, node, blob in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if group != now:
                    if len(held) > 1:
                        edges += forest(list(held), list(held.values()), rule)
                    now, held = group, {}
                held[node] = np.frombuffer(blob, U)
            if len(edges) > 10_000:
                yield made()
        if len(held) > 1:
            edges += forest(list(held), list(held.values()), rule)
        yield made()

    return members.mapInArrow(run, "u long, v long")


def _text_hash(text: str = "text"):
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def _linked(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: named, a row for each document (doc_id, h, n, s1, s2), and final, one for each class (s1, s2)
    with the component's smallest doc_id and its first row (nameless, doc_id, h)."""
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = common.stored(_classes(docs, rule), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h")).alias("first")
    classes = named.filter("n > 0").groupBy("s1", "s2").agg(first, F.first("n").alias("n"))
    # A node is a number of the stored row: no two classes share one, whatever their doc_ids.
    classes = common.stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counted = common.stored(_frequent(docs, rule, total), "frequent")
    frequent = _order(counted)
    common.release(counted)
    edges = _candidates(_signatures(docs, rule, frequent, total), rule)
    short = F.shiftrightunsigned("s1", 64 - NAMED)
    a, b = (classes.select(short.alias(name), F.col("node").alias(node)) for name, node in (("a", "u"), ("b", "v")))
    groups = common.stored(components(edges.join(a, "a").join(b, "b").select("u", "v")), "groups")
    grouped = common.stored(classes.join(groups, "node").select("s1", "s2", "node", "n", "label"), "grouped")
    dealt = common.stored(_deal(grouped, rule), "dealt")
    common.release(groups, grouped)
    rows = _tokens(docs, rule, _filter(dealt)).join(dealt, ["s1", "s2"])
    members = rows.select("label", F.explode("boxes").alias("box"), "node", "tokens").select("label", "box.i", "box.j", "node", "tokens")
    members = members.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "node")
    linked = common.stored(components(_links(members, rule)), "linked")
    common.release(dealt)
    final = common.stored(classes.join(linked, "node", "left").select("s1", "s2", "first", "label"), "labelled")
    # A label is a node; the component is named by its first row. A class that links with none has no label.
    some = final.filter("label IS NOT NULL")
    least = some.groupBy("label").agg(F.min("first").alias("least"), F.count("*").alias("k"))
    named_ = common.join_counted(some.select("s1", "s2", "label"), least, ["label"], some.count()).select("s1", "s2", F.col("least").alias("first"))
    out = common.stored(final.filter("label IS NULL").select("s1", "s2", "first").unionByName(named_), "components")
    common.release(linked, classes, final)
    final = out
    return named, final


def _deal(members: DataFrame, rule: Rule) -> DataFrame:
    """members (s1, s2, node, n, label) with boxes, the pairs (i, j) of blocks that a class is verified in.

    A group that fits one block is one box. In a larger one a class's band is the power of 100 / percent that its size
    reaches: classes whose bands differ by more than one cannot link. Bands are dealt to blocks by hash, and a block meets
    those of its own and of the neighbouring bands."""
    ratio = 100 / min(rule.percent, 99.9)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(ratio)) + 1e-9).cast("int")
    banded = members.withColumn("band", band)
    by = banded.groupBy("label", "band").agg(F.count("*").alias("k"), F.sum("n").alias("t"))
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("t") / BLOCK_TOKENS)).cast("long")
    whole = by.groupBy("label").agg(F.sum("k").alias("k"), F.sum("t").alias("t"))
    by = by.withColumn("blocks", blocks).join(whole.select("label", ((F.col("k") <= BLOCK) & (F.col("t") <= BLOCK_TOKENS)).alias("one")), "label")
    width = lambda step: by.select("label", (F.col("band") - step).alias("band"), F.col("blocks").alias(f"w{step + 1}"))
    sizes = by.select("label", "band", "one", "blocks", "k").join(width(-1), ["label", "band"], "left").join(width(1), ["label", "band"], "left")
    at = F.col("band").cast("long") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("blocks"))
    others = lambda step, n: F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda x: (F.col("band") + step).cast("long") * (1 << 32) + x)).otherwise(F.array().cast("array<bigint>"))
    every = F.concat(others(-1, F.coalesce("w0", F.lit(0).cast("long"))), others(0, F.col("blocks")), others(1, F.coalesce("w2", F.lit(0).cast("long"))))
    pair = F.transform(every, lambda o: F.struct(F.least(at, o).alias("i"), F.greatest(at, o).alias("j")))
    single = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))
    return common.join_counted(banded, sizes, ["label", "band"], members.count()).select("s1", "s2", "node", "label", F.when(F.col("one"), single).otherwise(pair).alias("boxes"))


def link(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id of every document (doc_id, text)."""
    with common.scratch() as keep:
        named, final = _linked(docs, rule)
        keep += [named, final]
    return named.join(final, ["s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, rule: Rule = Rule(5, 80)) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, rows without one last, ties by a hash of the text.

    Rows are told apart by doc_id and text, so a doc_id's other texts stay if they are not copies. Documents with an empty
    set stay. Of rows that share doc_id and text one stays, empty set or not; only such rows are shuffled with their texts."""
    with common.scratch() as keep:
        named, final = _linked(docs, rule)
        own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h")
        joined = named.join(final, ["s1", "s2"], "left")
        gone = common.stored(joined.filter((F.col("n") > 0) & (own != F.col("first"))).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct(), "near-copies")
        again = common.stored(named.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_id", "_h"), "repeated")
        keep += [gone, again]
    rows = docs.select(F.struct(*docs.columns).alias("d")).withColumn("h", _text_hash("d.text"))
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    kept = rows.join(common.maybe_broadcast(gone), same, "left_anti")
    if again.isEmpty():
        return kept.select("d.*")
    repeated = common.maybe_broadcast(again)
    one = kept.join(repeated, same, "left_semi").groupBy(F.col("d.doc_id").alias("_id"), "h").agg(F.first("d").alias("d"))
    return kept.join(repeated, same, "left_anti").select("d.*").unionByName(one.select("d.*"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(common.table(spark, sf_dir, "documents"), Rule(3, 90))


# Every pair of documents that share a shingle, and what can be reached over links.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * k >= 90 * (u.n + v.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT x, y FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x),
r AS (SELECT x, least(x, min(y)) AS component_id FROM c GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON x = doc_id
"""
