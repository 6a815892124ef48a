"""Packing, spelling variants and the clustered layout against brute force, and the cases that their docstrings define."""

import bisect
import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import common, layout, packing, registry, variants

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns that clash with the operators'."""
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(60_000))
    rows = [(1, None, None, None), (None, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", "en", None), (5, long, "en", "a"), (6, "same text herein now", "en", "b"), (6, "same text herein now", "en", "b"), (7, "x" * 50_000, "en", "b"), (None, "same text herein now", None, None), (8, "éèàüö ñandúes  ünter\n 漢字 <|endoftext|> x", "fr", "é"), (9, "a", "en", "a\x00"), (10, "a", "en", "a" * 30), (11, "a", "en", "a" * 31)]
    out = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOC)
    for c in ("piece", "start", "length", "ids", "sequence_id", "offset", "word", "n", "z", "position", "file", "c_source", "_place"):
        out = out.withColumn(c, F.lit("clash"))
    return out


# op11


def file_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary()[0])
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_ids_are_those_of_the_file():
    rng = random.Random(4)
    parts = ["a", "Don't", "über", "漢字", " ", "  ", "\n", "\t", "\xa0", "\x1c", "　", "\U0001f600", "12345", "...", "'s", "<|endoftext|>", "<|", "é́", "x" * 40, "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3_000)] + ["y" * 25_000 + " z", " " * 30_000 + "a", "ab " * 9_000, "", " ", " a", "a ", "\n a"]
    ids = packing.Ids(packing.default_vocabulary())
    for text, want in zip(texts, file_ids(texts)):
        assert np.frombuffer(ids.text(text), "<u4").tolist() == want, repr(text)


def check_packed(rows, docs, size):
    """rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset) against docs (doc_id, text)."""
    want = collections.Counter()
    for (doc, _), ids in zip(docs, file_ids([t for _, t in docs])):
        whole = np.array([*ids, 0], "<u4")
        first = len(whole) if len(whole) <= size else (len(whole) - 1) % size + 1
        for k, start in enumerate([0, *range(first, len(whole), size)]):
            part = whole[start : first if k == 0 else start + size]
            want[doc, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter(tuple(r[:5]) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r[5]].append((r[6], r[3]))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    return len(sequences), sum(r[3] for r in rows)


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_packing_of_all_documents(spark, sf):
    docs = [tuple(r) for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()]
    rows = [tuple(r) for r in packing.op11_best_fit_packing(spark, sf).select(COLUMNS).collect()]
    n, total = check_packed(rows, docs, packing.SIZE)
    assert n <= -(-total // packing.SIZE) + 2  # close to the least that there can be


@pytest.mark.parametrize("most,window,group", [(1, 1, 1_000), (3, 5, 40), (512, 1_000, 10_000)])
def test_packing_in_small_bins(spark, sf, most, window, group):
    docs = common.table(spark, sf, "documents").filter("length(text) < 4000").select("doc_id", "text")
    cuts = common.stored(packing.pieces(docs, size=300).withColumn("ids_crc32", F.crc32("ids")), "cuts")
    packed = common.stored(packing.pack(cuts, 300, most, window, group), "packed")
    rows = [tuple(r) for r in packed.select(COLUMNS).collect()]
    check_packed(rows, [tuple(r) for r in docs.collect()], 300)
    ids = {r["doc_id"]: b"" for r in docs.collect()}
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    for doc, _, _, length, crc, sequence, offset in sorted(rows, key=lambda r: (r[0], r[1])):
        part = whole[sequence][4 * offset : 4 * (offset + length)]
        assert zlib.crc32(part) == crc
        ids[doc] += part
    assert all(len(v) % 4 == 0 and v[-4:] == b"\0" * 4 for v in ids.values())


def test_packer_takes_the_fullest_bin_that_fits():
    rng = random.Random(6)
    for most in (1, 2, 5, 100):
        p, bins, made = packing.Packer(50, most), {}, 0
        for _ in range(400):
            n = rng.randint(1, 50)
            number, offset = p.put(n)
            fits = [b for b, free in bins.items() if free >= n]
            if fits:
                assert number in fits and bins[number] == min(bins[b] for b in fits) and offset == 50 - bins[number]
                bins[number] -= n
            else:
                if len(bins) == most:
                    full = min(bins.values())
                    closed = [b for b, free in bins.items() if free == full]
                    # Of equally full bins the one opened or filled last goes.
                    gone = next(b for b in reversed(list(bins)) if b in closed and b not in p.stacks[full])
                    del bins[gone]
                assert number == made and offset == 0
                made += 1
                bins[number] = 50 - n
            bins = {b: free for b, free in bins.items() if free}


def test_packing_cases(spark, odd):
    cuts = common.stored(packing.pieces(odd).withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "cuts")
    rows = [tuple(r) for r in packing.pack(cuts).select(COLUMNS).collect()]
    check_packed(rows, [tuple(r) for r in odd.select("doc_id", "text").collect()], packing.SIZE)
    none = common.stored(packing.pieces(odd.limit(0)), "cuts")
    assert packing.pack(none).count() == 0 and packing.sequences(packing.pack(none)).count() == 0


# op12


def edits(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, fewest, bar, loses):
    count = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % loses == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            count[word] += 1
    return {w: n for w, n in count.items() if len(w) >= fewest and n >= bar}


def brute_groups(words, times):
    out = {}
    for w, n in words.items():
        near = sorted(((-m, x) for x, m in words.items() if edits(w, x)))
        form = near[0] if near and -near[0][0] >= times * n else None
        out[w] = [n, len(near), form and form[1], form and -form[0]]
    ends = set()
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        ends.add((w, *out[w], root))
    return ends


@pytest.mark.parametrize("shard,most,loses", [(50_000, 12 << 20, 199), (7, 3_000, 3), (20, 1, 5)])
def test_groups_against_brute_force(spark, shard, most, loses):
    rng = random.Random(shard)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(4, 7))) for _ in range(25)]
    texts = []
    for d in range(60):
        words = []
        for _ in range(60):
            w = rng.choice(base[: 1 + rng.randint(0, 24)])
            if rng.random() < 0.3:
                i = rng.randint(0, len(w) - 1)
                w = w[:i] + rng.choice(["", "a", "É", w[i] + "b"]) + w[i + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append((d if d else None, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = variants.group(docs, fewest=4, bar=2, times=3, loses=loses, shard=shard, most=most)
    want = brute_groups(brute_words(texts, 4, 2, loses), 3)
    assert {tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()} == want
    assert any(w[5] != w[0] and w[5] != w[3] for w in want)  # chains of two forms or more


def test_tries_find_what_is_near():
    rng = random.Random(9)
    for _ in range(80):
        words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 150))})
        shard = variants.Shard.unpack(variants.Shard.of([(w, i + 1) for i, w in enumerate(words)]).pack())
        for w in [*words, "zz", "abab", "a" * 9]:
            assert shard.near(w) == {x: i + 1 for i, x in enumerate(words) if edits(w, x)}
    deep = ["a" * n for n in range(1, 3_000)]
    shard = variants.Shard.unpack(variants.Shard.of([(w, 1) for w in deep]).pack())
    assert set(shard.near("a" * 1_500)) == {"a" * 1_499, "a" * 1_501}


def test_variant_cases(spark, odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = {tuple(r) for r in variants.group(odd, bar=1).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == brute_groups(brute_words(rows, 6, 1, 199), 5)
    assert any(len(w[0]) > 40_000 for w in got)
    assert variants.group(odd.limit(0)).count() == 0


# op13


def brute_layout(rows, cells, size):
    """rows: key and dimensions; positions, files and coordinates by sorting everything."""
    key = lambda v: (v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0)
    n, dims = len(rows), len(rows[0]) - 1
    sorted_ = [sorted(key(r[1 + d]) for r in rows) for d in range(dims)]
    at = [[cells * bisect.bisect_left(sorted_[d], key(r[1 + d])) // n for d in range(dims)] for r in rows]
    bits = (cells - 1).bit_length()
    z = [int("".join(str(c >> b & 1) for b in reversed(range(bits)) for c in cs), 2) for cs in at]
    return at, z


@pytest.mark.parametrize("n,cells", [(1, 8), (5, 8), (400, 8), (403, 4)])
def test_layout_against_sorting(spark, n, cells):
    rng = random.Random(n)
    names = [None, "", "a", "a\x00", "ab", "é", "z", "longname", "longname1", "longname12345678", "longname12345679", "longname123456790"]
    rows = [(i if i % 11 else None, rng.choice(names), rng.choice(names[:3]), rng.choice([None, -1, 0, 5, 10**12, rng.randint(0, 99)]), rng.randint(0, 364)) for i in range(n)]
    df = common.stored(spark.createDataFrame(rows, "id long, a string, b string, c long, d long"), "rows")
    dims = ["a", "b", "c", "d"]
    laid = layout.with_bounds(layout.layout(df, "id", dims, cells, 16), dims).collect()
    at, z = brute_layout(rows, cells, 16)
    assert sorted((r["z"], *(r[f"c_{d}"] for d in dims)) for r in laid) == sorted((x, *c) for x, c in zip(z, at))
    placed = sorted(laid, key=lambda r: r["position"])
    assert [r["position"] for r in placed] == list(range(n))
    order = [(r["z"], r["id"] is not None, r["id"] or 0) for r in placed]
    assert order == sorted(order) and all(r["file"] == r["position"] // 16 for r in placed)
    reach = {"a": 0, "b": 0, "c": 1, "d": 1}
    bounded = common.stored(spark.createDataFrame(laid, layout.with_bounds(layout.layout(df, "id", dims, cells, 16), dims).schema), "bounded")
    counts = {tuple(r[f"c_{d}"] for d in dims): (r["files_touched"], r["files_matching"]) for r in layout.query_counts(bounded, reach, cells).collect()}
    files = {r["file"]: [(r[f"low_{d}"], r[f"high_{d}"]) for d in dims] for r in placed}
    for q in {tuple(c) for c in at}:
        box = [(v - k, v + k) for v, k in zip(q, reach.values())]
        touched = sum(all(lo <= b and hi >= a for (lo, hi), (a, b) in zip(f, box)) for f in files.values())
        matching = len({r["file"] for r in placed if all(a <= r[f"c_{d}"] <= b for d, (a, b) in zip(dims, box))})
        assert counts[q] == (touched, matching)


def test_layout_cases(spark, odd):
    rows = common.stored(odd.select("doc_id", "source", "lang", F.octet_length("text").cast("long").alias("size"), "z", "position", "file", "c_source", "_place"), "rows")
    laid = layout.layout(rows, "doc_id", ["source", "lang", "size"], 4, 3)
    got = laid.collect()
    at, z = brute_layout([(r["doc_id"], r["source"], r["lang"], r["size"]) for r in rows.collect()], 4, 3)
    assert sorted(r["z"] for r in got) == sorted(z) and sorted(r["position"] for r in got) == list(range(len(z))) and all(r["_place"] == "clash" for r in got)
    none = layout.layout(common.stored(rows.limit(0), "none"), "doc_id", ["source", "size"])
    assert none.count() == 0 and layout.query_counts(common.stored(layout.with_bounds(none, ["source", "size"]), "none"), {"source": 0, "size": 1}).count() == 0


def test_rows_are_found_in_written_files(spark, sf, tmp_path):
    docs = common.table(spark, sf, "documents").select("doc_id", "text", "source", F.length("text").cast("long").alias("length"))
    narrow = common.stored(docs.select("doc_id", "source", "length"), "rows")
    laid = common.stored(layout.layout(narrow, "doc_id", ["source", "length"], 8, 20).join(docs.select("doc_id", "text"), "doc_id"), "laid")
    layout.write(laid, str(tmp_path / "t"))
    box = {"source": (2, 3), "length": (0, 4)}
    inside = (F.col("c_source").between(2, 3)) & (F.col("c_length").between(0, 4))
    found = layout.search(spark, str(tmp_path / "t"), box)
    assert sorted(map(tuple, found.select("doc_id", "text").collect())) == sorted(map(tuple, laid.filter(inside).select("doc_id", "text").collect()))
    assert len(set(p.name for p in (tmp_path / "t" / "rows").glob("file=*"))) == laid.select("file").distinct().count()


def test_few_rounds_whatever_the_rows(spark, monkeypatch):
    """Rounds close in on values that occur: a hundred times the rows take hardly more rounds."""
    rounds = collections.Counter()
    plain = layout._counter
    monkeypatch.setattr(layout, "_counter", lambda bounds: (rounds.update([size]), plain(bounds))[1])
    for size in (300, 30_000):
        rows = common.stored(spark.range(size).select("id", (F.xxhash64("id") % 1_000_000_007).alias("v")), "rows")
        layout.order_statistics(rows, ["v"], [size // 3, size // 2])
    assert rounds[30_000] <= rounds[300] + 5 and rounds[30_000] <= 9


def test_every_new_query_is_registered():
    assert [n for n in registry.QUERIES if re.match(r"op1[123]_", n)] == ["op11_best_fit_packing", "op12_spelling_variants", "op13_clustered_layout"]
    assert list(itertools.chain(registry.ORACLES))
