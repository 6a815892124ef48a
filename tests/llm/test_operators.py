"""The operators against brute force, and the cases that their docstrings define."""

import collections
import hashlib
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import chat, common, components, decontam, langid, licenses, lm, mixing, quality, registry, secrets, simjoin, tokens, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns that clash with the operators'."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(1, None, None, None, None), (None, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", None, 3), (5, long, "en", "a", len(long)), (6, "same text here now", "en", "b", 18), (6, "same text here now", "en", "b", 18), (7, "same text here now", "en", "b", 18), (None, "same text here now", None, None, None), (8, "éè ñandú ünter 漢字 x", "fr", "b", 5)]
    out = spark.createDataFrame(rows, DOC)
    for c in ("spans", "copy", "copies", "n_words", "score", "kept", "label", "n", "size", "s1", "licenses", "host"):
        out = out.withColumn(c, F.lit("clash"))
    return out


def test_words_and_hashes():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB é\n\t.x漢\x85\x1c") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "x" * 700, "a" * 255 + " " + "a" * 257]
    seen = {}
    for lo, hi, b in tokens.blocks(pa.array(texts), tokens.folding(tokens.SPACE)):
        h = b.hashes()
        for r in range(hi - lo):
            got = [bytes(b.data[s:e]) for s, e in zip(b.start[b.ends[r] : b.ends[r + 1]], b.stop[b.ends[r] : b.ends[r + 1]])]
            want = [w.encode().lower() for w in WORD.findall(texts[lo + r])]
            assert got == want
            for w, x in zip(want, h[b.ends[r] : b.ends[r + 1]].tolist()):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_blocks_split_long_columns():
    texts = ["ab cd " * 50_000, "x", "", "y z" * 200_000, "q"]
    n = [int(c) for _, _, b in tokens.blocks(pa.array(texts), tokens.folding(tokens.SPACE)) for c in b.counts]
    assert n == [len(WORD.findall(t)) for t in texts]


# op1


def test_archive_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(3, "http://a/\r\nb", big), (1, "http://c", big), (2, None, big), (4, "u", "tiny"), (5, "v", "tiny"), (6, "w", None), (1, "http://c", big), (None, "n", big), (7, "z", "é" * 60 + "\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    a = warc.write(pages)
    back = {(r["page_id"], warc_type(r)): r for r in warc.read(a).collect()}
    assert warc.read(a).count() == len(rows) and a.payloads.count() == 4
    assert {k for k in back} == {(3, "revisit"), (1, "response"), (2, "revisit"), (4, "response"), (5, "response"), (6, "response"), (None, "revisit"), (7, "response")}
    for (page, kind), r in back.items():
        header, block = next(warc.parse(bytes(r["record"])))
        assert header.decode() == r["warc_header"]
        body = b"" if kind == "revisit" else bytes(r["payload"])
        assert block == r["http_header"].encode() + body
        assert "sha256:" + hashlib.sha256(r["payload"]).hexdigest() in r["warc_header"]
    warc.export(a, str(tmp_path / "w"))
    assert warc.load(spark, str(tmp_path / "w")).count() == len(rows)


def warc_type(r):
    return re.search(r"WARC-Type: (\w+)", r["warc_header"])[1]


def test_foreign_archives(spark, tmp_path):
    import gzip

    record = lambda head, body: head + f"\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    records = [record(b"WARC/1.0\r\nX-Note: caf\xe9", b"\xff\x00" * 700_000), record(b"WARC/1.0\r\nWARC-Type: warcinfo", b""), record(b"WARC/1.1", b"\r\n\r\nbody")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "c.warc").write_bytes(b"".join(records))
    got = warc.load(spark, str(tmp_path)).collect()
    assert sorted(len(r["block"]) for r in got) == [0, 0, 0, 8, 8, 8, 1_400_000, 1_400_000, 1_400_000]
    assert sum("X-Note: café" in r["warc_header"] for r in got) == 3
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(records[0][:-100]))


def test_archive_cases(spark, odd):
    a = warc.write(odd.withColumn("url", F.lit("u")), key="doc_id", payload="text")
    got = warc.parsed(warc.read(a).select("record", F.col("payload").alias("whole"))).collect()
    assert len(got) == odd.count()
    assert all(bytes(r["body"]) == (b"" if "WARC-Type: revisit" in r["warc_header"] else bytes(r["whole"])) for r in got)
    assert all(re.search("WARC-Refers-To: <urn:uuid:", r["warc_header"]) for r in got if "WARC-Type: revisit" in r["warc_header"])


def test_archive_detects_damage(spark):
    a = warc.write(spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string"))
    broken = warc.Archive(a.headers, a.payloads.withColumn("payload", F.lit("y").cast("binary")))
    with pytest.raises(Exception, match="does not match"):
        warc.read(broken).select("payload").collect()
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(empty)).count() == 0


# op2


def test_escape_is_reversible():
    rng = random.Random(2)
    parts = [*chat.CONTROL, "\\", "<", ">", "|", "[", "/", "x", "s>", "INST]", "\n"]
    for _ in range(3_000):
        text, role = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8))), rng.choice(["user", "assistant", "system", "", "a|>b", "\\"])
        assert chat.unescape(chat.escape(text)) == text
        made = "".join(chat.turn(role, text)) + "".join(chat.turn("user", "z"))
        assert list(chat.turns(made)) == [(role, text), ("user", "z")]


def test_fold(spark):
    log = [(1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", "he"), (1, 3, 2, "delta", None, "llo <"), (1, 4, 2, "delta", None, "/s>"), (1, 5, 3, "message", "user", "more"), (1, 6, 4, "message", "assistant", "gone"), (1, 7, 2, "regenerate", "assistant", ""), (1, 8, 2, "delta", None, "new"), (1, 9, 5, "message", "user", "old"), (1, 10, 5, "edit", None, "edited"), (1, 11, 5, "delta", None, "!"), (2, None, 1, None, None, None), (2, 1, 9, "unknown", "user", "x"), (None, 1, 1, "message", "user", "n")]
    events = spark.createDataFrame(log, "conv_id long, seq long, message long, op string, role string, text string")
    rows = {r["conv_id"]: r for r in chat.render(chat.fold(events)).collect()}
    said = {k: list(chat.turns(r["formatted"])) for k, r in rows.items()}
    assert said == {1: [("user", "hi"), ("assistant", "new"), ("user", "edited!")], 2: [("", "")], None: [("user", "n")]}
    loss = rows[1]["loss_spans"]
    assert [rows[1]["formatted"][s["start"] : s["end"]] for s in loss] == ["new"]


def test_long_conversations_are_cut_between_turns(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 50)
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i} " * 3) for i in range(40)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.render(chat.fold(chat.events(talk)))
    got = chat.digest(made).first()
    text = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
    loss = "".join(t for _, _, r, t in rows if r == "assistant")
    assert (got["n_turns"], got["turns_sha256"], got["loss_chars"], got["loss_sha256"]) == (40, hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.render(chat.fold(chat.events(talk.limit(0)))).count() == 0


def test_chunks_are_handed_on_by_their_characters(spark, monkeypatch):
    """Many short conversations are passed on before their characters exceed CHUNK by more than one message."""
    monkeypatch.setattr(chat, "CHUNK", 1_000)
    talk = spark.createDataFrame([(i, 0, "user", "x" * 300) for i in range(100)], "conv_id long, turn long, role string, text string")
    assert chat.render(chat.fold(chat.events(talk))).count() == 100
    seen = {}
    monkeypatch.setattr(type(talk), "mapInArrow", lambda self, f, schema, *a: seen.setdefault("run", f) and self)
    chat.render(chat.fold(chat.events(talk)))
    rows = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([1] * 100), pa.array(["user"] * 100), pa.array(["x" * 300] * 100)], names=["conv_id", "message", "role", "text"])
    held = [sum(map(len, b.column(3).to_pylist())) for b in seen["run"](iter([rows]))]
    assert sum(held) == 100 * 313 and max(held) <= 1_000 + 2 * 313


def test_conversations_against_brute_force(spark, sf):
    """Every hash of the query over its whole table."""
    said = collections.defaultdict(list)
    for r in common.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect():
        said[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    said[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in registry.QUERIES["op2_chat_formatting"](spark, sf).collect()}
    assert set(got) == set(said)
    for conv, rows in said.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        made = "".join("".join(chat.turn(role, t)) for _, role, t in rows)
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"], r["formatted_chars"]) == (len(rows), len(loss), len(made))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in rows).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


# op3


def test_every_letter_has_a_symbol(monkeypatch):
    rng = random.Random(5)
    han = [chr(0x4E00 + i) for i in range(2_000)]
    a, b = ("".join(rng.choice(han[i::2]) for _ in range(20_000)) for i in (0, 1))
    m = langid.Model({"a": [a], "b": [b]})
    assert len(set(m.map[[ord(c) for c in set(a + b)]].tolist())) == len(set(a + b))
    assert m.map[ord("\u9f00")] not in m.map[[ord(c) for c in set(a + b)]]
    texts = [a[500:540], b[900:940], "\u9f00" * 9]
    sparse = m.predict(pa.array(texts))
    assert sparse[0][:2] == ["a", "b"]
    piece = a[100:140] + b[100:140]
    known = {a[i:j] for i in range(len(a)) for j in range(i + 1, min(i + 42, len(a)) + 1)}
    got = m.phrases([m.map[[ord(c) for c in piece]]])
    assert got[0, 0] == brute_phrases(piece, known) and isinstance(m.tables[0], langid.Sparse)
    monkeypatch.setattr(langid, "DENSE", 1 << 40)
    small = langid.Model({"a": [a[:3_000]], "b": [b[:3_000]]}).predict(pa.array(texts))
    monkeypatch.setattr(langid, "DENSE", 5)
    again = langid.Model({"a": [a[:3_000]], "b": [b[:3_000]]}).predict(pa.array(texts))
    assert small[0] == again[0] and (small[1] == again[1]).all()


def brute_phrases(text, known):
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in known:
            size += 1
        n, at = n + 1, at + size
    return n


def own_normal(text):
    return re.sub("[^a-zà-ÿ]+", " ", text.lower()).lstrip(" ")


@pytest.mark.parametrize("segment", [1, 3, 7, 512])
def test_phrases_are_longest_matches(monkeypatch, segment):
    monkeypatch.setattr(langid, "SEGMENT", segment)
    rng = random.Random(segment)
    learn = {"a": ["".join(rng.choice("abc ") for _ in range(300)) + "a" * 30], "b": ["".join(rng.choice("bcd ") for _ in range(300))]}
    m = langid.Model(learn)
    texts = ["".join(rng.choice("abcdx ") for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["a" * 200, learn["a"][0] * 2, "x" * 50, "", "abab" * 40]
    norm = [langid.normalised(np.frombuffer(t.encode("utf-32-le"), np.uint32)) for t in texts]
    got = m.phrases([m.map[x] for x in norm])
    for k, lang in enumerate(m.langs):
        known = own_normal(learn[lang][0]) + " "
        assert got[k].tolist() == [brute_phrases(own_normal(t), known) for t in texts]


def test_predictions_against_brute_force(spark, sf, monkeypatch):
    """Cost, winner and score of whole documents by a plain parse."""
    monkeypatch.setattr(langid, "SEGMENT", 64)
    learn = {"en": ["the cat and the dog went to the house of a friend"], "de": ["die katze und der hund gingen in das haus von einem freund"], "fr": ["le chat et le chien sont dans la maison de mon ami"]}
    m = langid.Model(learn)
    texts = [r["text"] for r in common.table(spark, sf, "documents").orderBy("doc_id").limit(40).collect()]
    texts = [t if t is None else re.sub("[^a-zA-Zà-ÿ ]", "-", t) for t in texts]
    names, scores = m.predict(pa.array(texts, pa.string()))
    for t, name, score in zip(texts, names, scores):
        x = own_normal(t or "")
        if not x.strip():
            assert name == "und" and score == 0
            continue
        cost = {k: brute_phrases(x, own_normal(v[0]) + " ") * math.log2(len(own_normal(v[0])) + 1) / len(x) for k, v in learn.items()}
        best = min(sorted(cost), key=cost.get)
        assert name == best and math.isclose(score, 1 / sum(2 ** ((cost[best] - c) * langid.SCORE_CHARS) for c in cost.values()), rel_tol=1e-9)


def test_language_of_held_out_documents(spark, sf):
    got = registry.QUERIES["op3_language_id"](spark, sf)
    want = common.table(spark, sf, "documents").select("doc_id", "lang")
    rows = got.join(want, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == want.count() and all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in rows)
    recall = {x: np.mean([r["lang_pred"] == x for r in held if r["lang"] == x]) for x in {r["lang"] for r in held}}
    print(recall)
    assert min(recall.values()) > 0.9 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_cases(spark, odd):
    learn = docs(spark, [(1, "the cat and the dog", "s"), (2, None, "s")])
    got = langid.identify(odd.select("doc_id", "text", "score"), learn).collect()
    assert [r["lang_pred"] for r in got[:4]] == ["und"] * 4 and len(got) == odd.count()
    assert all(r["lang_pred"] == "und" for r in langid.identify(odd.select("text"), learn.limit(0)).collect())
    assert langid.identify(learn.limit(0), learn).count() == 0


# op4


def test_mix_meets_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "c", "d", None])) for i in range(3_000)]
    frame = docs(spark, rows)
    sized = frame.select("doc_id", "source", mixing.size(F.col("text")).alias("size"))
    got = mixing.units(sized).collect()
    again = mixing.units(sized.repartition(9)).collect()
    assert {r["doc_id"]: r["copies"] for r in got} == {r["doc_id"]: r["copies"] for r in again}
    total = collections.Counter()
    for _, t, s in rows:
        total[s] += len(t.split())
    goal = water([total[s] for s in ("a", "b", "c", "d", None)])
    for s, g in zip(("a", "b", "c", "d", None), goal):
        own = [r for r in got if r["source"] == s]
        assert all(math.isclose(r["target"], g) and 0 <= r["copies"] <= 2 for r in own)
        assert abs(sum(r["copies"] * r["size"] for r in own) - g) <= 60


def water(sizes, weights=(5, 2, 1)):
    w = np.array([weights[i % 3] for i in range(len(sizes))], float)
    n = np.array(sizes, float)
    full = np.zeros(len(n), bool)
    while True:
        t = np.where(full, 2 * n, w / w[~full].sum() * (1.5 * n.sum() - 2 * n[full].sum()))
        new = full | (t > 2 * n)
        if (new == full).all():
            return t
        full = new


def test_pairs_keep_their_words():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 12)
        mass, p = [float(rng.randint(1, 50)) for _ in range(n)], [rng.random() for _ in range(n)]
        taken, held, q = mixing.round_group([rng.getrandbits(64) for _ in range(n)], mass, p)
        left = 0 if held < 0 else q * mass[held]
        assert abs(sum(a * b for i, (a, b) in enumerate(zip(taken, mass)) if i != held) + left - sum(a * b for a, b in zip(p, mass))) < 1e-6


def test_copies_keep_their_mean():
    rng = random.Random(7)
    taken = np.zeros(3)
    for _ in range(4_000):
        out, held, q = mixing.round_group([rng.getrandbits(64) for _ in range(3)], [3.0, 5.0, 2.0], [0.3, 0.5, 0.8])
        taken += [q if i == held else x for i, x in enumerate(out)]
    assert np.allclose(taken / 4_000, [0.3, 0.5, 0.8], atol=0.04)


def test_mix_cases(spark, odd):
    out = mixing.mix(odd)
    assert out.columns == [c for c in odd.columns if c != "copy"] + ["copy"]
    n = {r["doc_id"]: r["n"] for r in out.filter("doc_id = 6").groupBy("doc_id", "copy").agg(F.count("*").alias("n")).collect()}
    assert set(n.values()) <= {2}
    assert mixing.mix(odd.limit(0)).count() == 0


# op5


def brute_join(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(b" ".join(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([b" ".join(w)] if w else []))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[max(top(i), top(j))] = min(top(i), top(j))
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[top(i)] = min(ids.get(top(i), d), d)
    return [(d, len(sets[i]), ids.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def family(rng, i, base):
    words = base.split()
    for _ in range(rng.randint(0, 4)):
        words[rng.randrange(len(words))] = f"z{rng.randint(0, 9)}"
    return i, " ".join(words)


@pytest.mark.parametrize("k, percent, bar, lst, block", [(3, 90, 16, 16, 768), (3, 90, 2, 2, 4), (5, 80, 3, 4, 5), (2, 60, 2, 3, 3)])
def test_join_against_brute_force(spark, monkeypatch, k, percent, bar, lst, block):
    for name, v in (("BAR", bar), ("LIST", lst), ("BLOCK", block)):
        monkeypatch.setattr(simjoin, name, v)
    rng = random.Random(k * percent)
    bases = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.choice([5, 30, 120, 300]))) for _ in range(12)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [family(rng, i, bases[i % 12] if i % 5 else f"{bases[i % 12]} {passage}") for i in range(160)]
    rows += [(500, None), (501, ""), (502, "one two"), (503, "ONE  two"), (None, rows[3][1]), (3, rows[3][1])]
    got = simjoin.link(spark.createDataFrame(rows, "doc_id long, text string"), simjoin.Rule(k, percent)).collect()
    order = lambda x: sorted(x, key=str)
    assert order(tuple(r) for r in got) == order(brute_join(rows, k, percent))


def test_join_of_a_doc_id_with_many_texts(spark):
    rng = random.Random(12)
    bases = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(60)) for _ in range(9)]
    rows = [(i % 7, family(rng, i, bases[i % 9])[1]) for i in range(90)] + [(None, bases[0])]
    got = simjoin.link(spark.createDataFrame(rows, "doc_id long, text string"), simjoin.Rule(2, 60)).collect()
    order = lambda x: sorted(x, key=str)
    assert order(tuple(r) for r in got) == order(brute_join(rows, 2, 60))


def test_deduplication_tells_rows_of_a_doc_id_apart(spark):
    rng = random.Random(13)
    bases = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(60)) for _ in range(9)]
    rows = [(i % 7 if i % 11 else None, family(rng, i, bases[i % 9])[1]) for i in range(90)] + [(3, bases[0])] * 3 + [(None, None)] * 2
    want, seen = collections.Counter(), {}
    component = brute_classes([t for _, t in rows], 5, 80)
    for (d, t), c in zip(rows, component):
        if c is None:
            want[d, t] = 1
        else:
            seen.setdefault(c, []).append((d, t))
    got = collections.Counter((r["doc_id"], r["text"]) for r in simjoin.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), simjoin.Rule(5, 80)).collect())
    assert all(n == 1 for n in got.values()) and {k for k in want} <= set(got)
    for own in seen.values():
        left = [x for x in set(own) if x in got]
        assert len(left) == 1 and left[0][0] == min((d for d, _ in own if d is not None), default=None)


def brute_classes(texts, k, percent):
    """A number for each text's component, None for empty sets."""
    got = brute_join(list(enumerate(texts)), k, percent)
    return [c if n else None for _, n, c in got]


@pytest.mark.parametrize("few", [400_000, 10])
def test_bands_lose_no_link(spark, monkeypatch, few):
    monkeypatch.setattr(simjoin, "BLOCK", 3)
    monkeypatch.setattr(common, "BROADCAST_ROWS", few)
    words = [f"w{i}" for i in range(400)]
    rows = [(n, " ".join(words[:n])) for n in range(40, 400, 4)]
    got = simjoin.link(spark.createDataFrame(rows, "doc_id long, text string"), simjoin.Rule(1, 90)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_join(rows, 1, 90))


def test_hubs_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(common, "HUB_ROWS", 3)
    monkeypatch.setattr(common, "HUBS", 4)
    edges = [(5, i) for i in range(10, 40)] + [(i, i + 30) for i in range(10, 40)] + [(90, 91), (None, 3)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{x: 5 for e in edges[:60] for x in e}, 90: 90, 91: 90}


def test_join_cases(spark, odd):
    got = simjoin.link(odd)
    assert got.count() == odd.count()
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} >= {(6, 6), (7, 6), (None, 6), (1, 1), (5, 5)}
    kept = simjoin.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 3, 4, 5, 6, 8]
    assert simjoin.link(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(50)] + [(200, 200)]
    up = {}
    for a, b in edges:
        ra, rb = a, b
        while up.setdefault(ra, ra) != ra:
            ra = up[ra]
        while up.setdefault(rb, rb) != rb:
            rb = up[rb]
        up[max(ra, rb)] = min(ra, rb)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in up if x != 200 and any(x in e and e[0] != e[1] for e in edges)}


def test_packed_counts():
    rng = np.random.default_rng(1)
    k = np.unique(rng.integers(0, 1 << 40, 5_000, dtype=np.uint64))
    n = rng.integers(1, 300, len(k))
    a, b = simjoin.unpack(simjoin.pack(k, n))
    assert (a == k).all() and (b == np.minimum(n, 255)).all()


# op6


def brute_secrets(text):
    out = []
    for i, r in enumerate(secrets.RULES):
        for m in re.finditer(r.pattern, text):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), i, m.end()))
    return sorted(out)


def test_secrets_against_brute_force(spark):
    rng = random.Random(9)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", '"', "'", " ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "漢", "abc/def+ghi=jkl", "ghp_" + "a1" * 20, "xoxb-1234567890", "-----BEGIN RSA PRIVATE KEY-----", "\n", "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghij"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30))), "s") for i in range(400)] + [(900, None, None), (None, "token = abcdefghijklmnop", None), (900, "AKIA" + "Z" * 20, "s")]
    for r in secrets.scan(docs(spark, rows).withColumn("spans", F.lit(1))).collect():
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans"]] == brute_secrets(r["text"] or "")


def test_redaction(spark, odd):
    frame = docs(spark, [(1, 'a token = "abcdefghijklmnop" z 0123456789abcdef', "s"), (2, "clean", "s")])
    rows = {r["doc_id"]: r for r in secrets.redact(frame).collect()}
    assert rows[1]["text"] == 'a [SECRET]" z [SECRET]' and rows[1]["n_chars"] == len(rows[1]["text"]) and rows[2]["text"] == "clean"
    named = secrets.scan(odd.withColumn("_id", F.lit("own")).withColumn("_kinds", F.lit("own")))
    assert {(r["_id"], r["_kinds"]) for r in named.collect()} == {("own", "own")}
    assert secrets.redact(odd.drop("spans")).count() == odd.count() and secrets.scan(odd.limit(0)).count() == 0


def test_trigram_queries():
    q = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert q["hex"] is None and q["access"] == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in q["assign"]
    assert secrets.trigram_query(r"\x41b[.]\.c{3}") == [frozenset({"ab.", "b..", "..c", ".cc", "ccc"})]
    assert secrets.trigram_query("x[a-c]yabc*z") == [frozenset({"yab"})] and secrets.trigram_query("[]a]bcd") == [frozenset({"]bc", "bcd"}), frozenset({"abc", "bcd"})]
    for bad in ("(?=a)bcd", "(abc", "abc)", r"\pL"):
        with pytest.raises(ValueError):
            secrets.trigram_query(bad)
    assert secrets.trigram_query("a?b") is None and secrets.trigram_query("(abc|xyz)+q") == [frozenset({"abc"}), frozenset({"xyz"})]


# op7


def test_licences(spark, odd):
    full = licenses.SENTENCES
    bsd3 = "\n".join(full[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name"))
    bsd2 = "\n".join(full[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    texts = {1: "Intro.\n" + full["mit-grant"] + "\n\n" + full["mit-notice"], 2: full["mit-notice"] + "\n" + full["mit-grant"], 3: "x. Licensed under the Apache License, Version 2.0. y", 4: "All Rights  Reserved.\nReleased under the MIT License.", 5: "licensed to drive", 6: None, 7: bsd3, 8: bsd3 + "\n\n" + bsd2, 9: "All rights reserved.", 10: "// SPDX-License-Identifier: GPL-2.0-or-later\nint main;", 11: "License: MIT and more", 12: "Unauthorized copying of this file,\nvia any medium is strictly prohibited."}
    got = {r["doc_id"]: r["licenses"] for r in licenses.identify(docs(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    assert got == {1: ["MIT"], 2: [], 3: ["Apache-2.0"], 4: ["MIT"], 5: [], 6: [], 7: ["BSD-3-Clause"], 8: ["BSD-2-Clause", "BSD-3-Clause"], 9: [], 10: ["GPL-2.0-or-later"], 11: [], 12: ["Proprietary"]}
    assert licenses.identify(odd).count() == odd.count() and licenses.identify(odd.limit(0)).count() == 0


def licence_forms():
    """Every rule and every name: on one line, wrapped, in comments of several kinds, and as a numbered list."""
    rows = []
    for name, parts in licenses.RULES:
        own = [licenses.SENTENCES[p] for p in parts]
        want = [name]
        for mark, start in (("", ""), ("# ", ""), (" * ", ""), ("// ", ""), ("; ", ""), ("", "{}. "), ("# ", "({}) ")):
            wrapped = [start.format(i) + s if start and i else s for i, s in enumerate(own)]
            rows.append((f"\n{mark.rstrip()}\n".join("\n".join(mark + x for x in textwrap.wrap(s, 72, break_long_words=False, break_on_hyphens=False)) for s in wrapped), want))
        rows.append((" ".join(x if x[-1] in ".!?;:" else x + "." for x in own), want))
        rows.append(("Some words\r\n" + "\r\n".join(own) + "\r\nmore words", want))
    for licence, some in licenses.NAMES.items():
        for i, n in enumerate(some):
            b = licenses.BEFORE[(i + len(licence)) % len(licenses.BEFORE)]
            rows += [(f"prose without end\n{b} {n}.\nmore prose", [licence]), (f"# {b} the {n}", [licence]), (f"{b}\n{n}\n", [licence]), (f"{b} {n} and then some", [])]
    return [(i, t, w) for i, (t, w) in enumerate(rows)]


@pytest.fixture(scope="module")
def forms(spark):
    rows = licence_forms()
    return rows, spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").coalesce(4)


def test_every_licence_in_every_form(forms):
    rows, frame = forms
    assert len({name for name, _ in licenses.RULES} | set(licenses.NAMES)) >= 60
    got = {r["doc_id"]: r["licenses"] for r in licenses.identify(frame).collect()}
    assert [(t, got[i], w) for i, t, w in rows if got[i] != w] == []


def test_every_licence_in_sql(forms, same):
    import duckdb

    rows, frame = forms
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    found = licenses.identify(frame)
    same(found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses")), con, licenses.ORACLE_SQL)


def test_lines_that_end_no_licence(spark):
    texts = {6: "All rights\n\nreserved.", 7: "Some text, all\nrights reserved", 8: "Released under\n\nthe MIT License.", 9: "We released under the MIT License."}
    rows = licenses.identify(docs(spark, [(i, t, "s") for i, t in texts.items()])).collect()
    assert all(r["sentence_ids"] == [] for r in rows)


# op8


def brute_quality(text):
    w = WORD.findall(text or "")
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len({p for v in at.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)})


def test_quality_counts(spark, odd):
    rng = random.Random(10)
    rows = [(i, "".join(rng.choice(["a", "b", "é", " ", "\n", "  ", "#", "|x", " "]) for _ in range(rng.randint(0, 120))), "s") for i in range(200)]
    for frame in (docs(spark, rows), odd):
        for r in quality.counts(frame).collect():
            assert tuple(r[c] for c in quality.COUNTS) == brute_quality(r["text"])


def test_hosts(spark, odd):
    good, bad = " ".join(f"w{i}" for i in range(80)), "x y"
    rows = [(i, good, "good") for i in range(40)] + [(100 + i, bad, "bad") for i in range(60)] + [(200, good, "bad"), (300, good, None), (301, bad, "small")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs(spark, rows)).collect()}
    assert all(got[i] for i in range(40)) and not got[200] and got[300] and not got[301]
    kept = quality.keep(docs(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, k in got.items() if k)
    assert quality.judge(odd).count() == odd.count() and quality.keep(odd).columns == odd.columns and quality.judge(odd.limit(0)).count() == 0


# op9


def brute_hits(text, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = split(text), set(), set()
    for name, t in items:
        b = split(t)
        n = min(window, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(name))
    return len(w), len(hit), sorted(found)


def test_hits_against_brute_force(spark):
    rng = random.Random(11)
    word = lambda: rng.choice(["a", "b", "É", "x1", "Foo", "漢"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 3, 4, 5, 9, 12])] + [(20, None), (21, "a, b; foo-x1")]
    rows = [(i, rng.choice([" ", ", ", "--"]).join(word() for _ in range(rng.randint(0, 40))), "s") for i in range(150)] + [(400, None, "s"), (401, "...", "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 20):
        for r in decontam.mark(docs(spark, rows), bench, 4, pass_bytes=size).collect():
            assert (r["n_words"], r["n_hit"], r["hit_items"]) == brute_hits(r["text"], items, 4)


def test_decontamination_cases(spark, odd):
    bench = spark.createDataFrame([(1, "same text here now"), (None, "ñandú"), (2, None)], "item_id long, text string")
    got = decontam.mark(odd, bench).collect()
    assert [r["doc_id"] for r in got if r["n_hit"]] == [6, 6, 7, None, 8] and got[-1]["hit_items"] == ["null"]
    assert decontam.remove_documents(odd, bench).columns == odd.columns and decontam.remove_documents(odd, bench).count() == 6
    cut = {r["doc_id"]: r["text"] for r in decontam.remove_spans(odd, bench).collect()}
    assert cut[7] == "" and "ñandú" not in cut[8] and cut[1] is None
    assert decontam.mark(odd.limit(0), bench).count() == 0 and decontam.mark(odd, bench.limit(0)).filter("n_hit > 0").count() == 0


# op10


@pytest.mark.parametrize("held", [lm.HELD, 40])
def test_scores_against_brute_force(spark, sf, held):
    frame = common.table(spark, sf, "documents").select("doc_id", "text").withColumn("held_out", common.doc_mod(5) == 1)
    got = lm.score(frame, frame.filter("NOT held_out").select("text"), held=held).collect()
    toks = {r["doc_id"]: [*r["text"].encode().lower().split(), None] for r in frame.collect()}
    c = collections.Counter(w for d, t in toks.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in t)
    n, v = sum(c.values()), len(c)
    for r in got:
        t = toks[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert r["score"] < 0


PIECES = [bytes([b]) for b in range(256)] + [b" a", b" ab", b"bc", b"abc", b"ca", " é".encode()]


def packed(words):
    data = np.frombuffer(b" " + b" ".join(words) + b" " * 8, np.uint8)
    stop = np.cumsum([len(w) + 1 for w in words])
    return data, stop - [len(w) for w in words], stop


def paths(s):
    """All segmentations of s."""
    return [[]] if not s else [[p, *rest] for p in PIECES if s.startswith(p) for rest in paths(s[len(p) :])]


def test_lattice_sums_all_segmentations():
    rng = random.Random(12)
    m = lm.Pieces(PIECES, np.array([float(rng.randint(0, 9)) for _ in PIECES]), 5)
    p = {x: math.exp(m.logp[i]) for i, x in enumerate(PIECES)}
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))).encode() for _ in range(60)] + [b"a" * 100, b"abc" * 30]
    got = m.many(*packed(words))
    for w, x in zip(words, got):
        assert math.isclose(x, m.one(b" " + w), rel_tol=1e-9)
        if len(w) < 12:
            assert math.isclose(math.exp(x), sum(math.prod(p[y] for y in path) for path in paths(b" " + w)), rel_tol=1e-9)


def test_expected_counts_of_pieces(monkeypatch):
    rng = random.Random(14)
    m = lm.Pieces(PIECES, np.array([float(rng.randint(0, 9)) for _ in PIECES]), 5)
    p = {x: math.exp(m.logp[i]) for i, x in enumerate(PIECES)}
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))).encode() for _ in range(40)]
    times = np.array([rng.randint(1, 5) for _ in words], float)
    want, total = np.zeros(len(PIECES)), 0.0
    for w, n in zip(words, times):
        some = [(math.prod(p[y] for y in path), path) for path in paths(b" " + w)]
        whole = sum(x for x, _ in some)
        total += n * math.log(whole)
        for x, path in some:
            for y in path:
                want[PIECES.index(y)] += n * x / whole
    for matrix in (lm.MATRIX, 3):
        monkeypatch.setattr(lm, "MATRIX", matrix)
        got, log = m.expect(*packed(words), times)
        assert np.allclose(got, want, rtol=1e-7, atol=1e-9) and math.isclose(log, total, rel_tol=1e-9)


def test_rounds_raise_the_likelihood(spark, sf):
    texts = common.table(spark, sf, "documents").filter("text IS NOT NULL").select("text", common.doc_mod(5).alias("k"))
    train, rest = (common.stored(lm.count_words(texts.filter(k)), "test") for k in ("k <> 1", "k = 1"))
    pieces = lm.vocabulary(lm.VOCABULARY)
    counts = lm.count_pieces(train, lm.VOCABULARY, pieces)
    seen = []
    for _ in range(3):
        seen.append(lm.refine(rest, pieces, counts, 10)[1])
        counts, own = lm.refine(train, pieces, counts, 10)
        seen.append(own)
    assert seen[1] < seen[3] < seen[5] and seen[0] < seen[2]  # on the training words, and after the first round on others


def test_segmentations_are_counted_by_the_vocabulary(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=lm.VOCABULARY)
    words = ["hello", "wörld", "antidisestablishment", "漢字", "x1"]
    pieces = lm.vocabulary(lm.VOCABULARY)
    got = lm.count_pieces(lm.count_words(spark.createDataFrame([(" ".join(words),), ("hello",)], "text string")), lm.VOCABULARY, pieces)
    want = collections.Counter()
    for w in [*words, "hello"]:
        for i in model.encode(w):
            piece = model.id_to_piece(i)
            want[bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()] += 1
    assert {pieces[i]: int(n) for i, n in enumerate(got) if n} == want


def test_scores_are_sums_over_words(spark, sf):
    """score of every document is that of its words and end, each by the plain recursion."""
    frame = common.table(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").limit(60)
    train = frame.select("text")
    words = lm.count_words(train)
    pieces = lm.vocabulary(lm.VOCABULARY)
    counts = lm.refine(words, pieces, lm.count_pieces(words, lm.VOCABULARY, pieces), 60)[0]
    m, kept = lm.Pieces(pieces, counts, 60), {}
    got = {r["doc_id"]: r["score"] for r in lm.score(frame.withColumn("_known", F.lit("clash")).withColumn("_row", F.lit(3)), train, rounds=1).collect()}
    for r in frame.collect():
        total = m.end
        for w in (r["text"] or "").encode().lower().split():
            if w not in kept:
                kept[w] = m.one(b" " + w)
            total += kept[w]
        assert math.isclose(got[r["doc_id"]], total / math.log(10), rel_tol=1e-9)


def test_score_cases(spark, odd):
    got = lm.score(odd.select("doc_id", "text", "score"), odd.select("text").limit(0)).collect()
    assert len(got) == odd.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    assert {(r["doc_id"], r["n_tokens"]) for r in got} >= {(1, 1), (None, 1), (2, 1), (3, 1), (4, 2), (5, 60_001)}
    assert lm.score(odd.select("text").limit(0), odd.select("text")).count() == 0


# All


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(name, spark, sf, duck, same):
    same(registry.QUERIES[name](spark, sf), duck, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_whole_tables(name, spark, sf):
    table = {"op1_warc": "pages"}.get(name, "documents")
    n = registry.QUERIES[name](spark, sf).count()
    want = common.table(spark, sf, "conversations").select("conv_id").distinct().count() + 1 if name.startswith("op2") else common.table(spark, sf, table).count()
    assert n == want


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    start = common.table(spark, sf, "documents")
    rows, seen = start, {}
    for name, stage in p.STAGES:
        before = rows
        rows = common.stored(stage(spark, before, sf), "test")
        seen[name] = {r["doc_id"] for r in rows.select("doc_id").collect()}
        assert rows.columns[:5] == start.columns and seen[name] <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "quality":
            assert all(brute_quality(r["text"])[0] >= 50 for r in rows.collect())
        if name == "near_duplicates":
            want = brute_join([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert seen[name] == {d for d, _, c in want if d == c}
        if name == "decontamination":
            items = [tuple(r) for r in common.table(spark, sf, "benchmark").collect()]
            assert seen[name] == {r["doc_id"] for r in before.collect() if not brute_hits(r["text"], items, 10)[1]}
        if name == "secrets":
            assert seen[name] == {r["doc_id"] for r in before.collect()} and not any(brute_secrets(r["text"]) for r in rows.collect())
    assert p.run(spark, sf).count() == rows.count()


def test_languages_are_learnt_from_whole_texts(spark):
    rows = [("en", f"word{i} " * 30) for i in range(50)] + [("de", "wort " * 2_000)] + [("fr", None), (None, "x y"), ("es", "123")]
    table = spark.createDataFrame(rows, "lang string, text string")
    got = langid.sample(table, 10, 1_000)
    texts = {t for _, t in rows}
    assert set(got) == {"en", "de"} and len(got["de"]) == 1 and all(t in texts for ts in got.values() for t in ts)
    assert 1 <= len(got["en"]) <= 10 and sum(map(len, got["en"])) <= 1_000 and got == langid.sample(table.repartition(7), 10, 1_000)


@pytest.mark.parametrize("sizes", [[5, 0, 100, 7, 30, 1000, 1], [10] * 9, [0, 0], [1000, 1, 1, 1], []])
def test_targets_against_filling_step_by_step(spark, sizes):
    rows = [(f"s{i:02}" if i else None, n) for i, n in enumerate(sizes)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    order = sorted((s for s, _ in rows), key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    size = dict(rows)
    want, left, free = {}, 1.5 * sum(sizes), set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        want |= {s: 2.0 * size[s] for s in over} if over else share
        left -= sum(2.0 * size[s] for s in over)
        free = free - over if over else set()
    assert set(got) == set(want) and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pipeline_cases(spark, sf, odd, rows):
    """Nulls, empty and very long texts, repeated rows and clashing columns pass through all stages, and so does nothing."""
    import corpus_pipeline as p

    table = odd if rows == "odd" else odd.limit(0)
    for c in ("_d", "_host", "_k", "row", "rid", "u", "v"):
        table = table.withColumn(c, F.lit("clash"))
    more = docs(spark, [(100 + i, " ".join(f"plain{i}x{j}" for j in range(80 + i)), "s") for i in range(20)])
    if rows == "odd":
        for c in table.columns[5:]:
            more = more.withColumn(c, F.lit("clash"))
        table = table.unionByName(more)
    start = common.stored(table, "odd")
    now = start
    for name, stage in p.STAGES:
        now = common.stored(stage(spark, now, sf), "odd-" + name)
        own = [c for c in now.columns if c != "copy"]
        assert own == [c for c in start.columns if c != "copy"], name
        assert all(r[c] == "clash" for r in now.select(*own).collect() for c in own[5:]), name
    kept = {r["doc_id"] for r in now.collect()}
    assert kept <= {100 + i for i in range(20)} | {5} and (len(kept) > 0) == (rows == "odd")
