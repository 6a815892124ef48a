"""The similarity join on what larger tables hold: many frequent tokens, many signatures."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import simjoin


def test_join_keeps_groups_small_whatever_is_frequent(spark, monkeypatch):
    """More tokens above the bar than are held exactly: the others stay out of the single signatures (their long lists would
    join all texts in one group), and no link is lost."""
    rng = random.Random(4)
    texts = [[f"own{d}x{i}" for i in range(60)] + rng.sample([f"pool{i}" for i in range(600)], 40) for d in range(450)]
    texts += [t[:97] + [f"new{d}x{i}" for i in range(3)] for d, t in enumerate(texts[:30])]
    sizes = []

    def deal(members, rule, real=simjoin._deal):
        sizes.append(members.groupBy("label").count().agg(F.max("count")).first()[0])
        return real(members, rule)

    monkeypatch.setattr(simjoin, "_deal", deal)
    monkeypatch.setattr(simjoin, "FREQUENT", 20)
    rows = [(d, " ".join(rng.sample(t, len(t)))) for d, t in enumerate(texts)]
    got = simjoin.link(spark.createDataFrame(rows, "doc_id long, text string"), simjoin.Rule(1, 90)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: d - 450 if d >= 450 else d for d in range(480)}
    assert sizes[0] <= 4


def test_join_packs_signatures():
    """A signature takes some ten bytes however few of a set's go one way, and comes back; lists that are folded on the way
    stay connected."""
    rng, rule = np.random.default_rng(5), simjoin.Rule(5, 80)
    m = 20_000
    sig, name, n = np.sort(rng.integers(0, 1 << 40, m).astype(np.uint64)), rng.integers(0, 1 << 48, m), rng.integers(300, 800, m)
    slack = n - rule.misses(n) - 1
    slack[::7] += 5
    slack[::50] = -1
    blob = simjoin.pack_signatures(sig, name, n, slack, rule)
    assert len(blob) < 14 * m
    for want, got in zip((sig.view(np.int64), name, n, slack), simjoin.unpack_signatures(blob, rule), strict=True):
        assert (want == got).all()

    def parts(edges):
        up = {}

        def top(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in edges:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
        return {x: top(x) for x in up}

    sig, name = rng.integers(0, 40, 2000), rng.permutation(2000)
    slack = np.where(sig % 2, -1, 400 - rule.misses(400) - 1)
    cols = [[c[i : i + 200] for c in (sig, name, np.full(2000, 400), slack)] for i in range(0, 2000, 200)]
    edges, held = [], []
    for some in cols:
        e, rest = simjoin.fold([*held, some])
        held = [rest]
        edges += zip(*(x.tolist() for x in e[:2]), strict=True)
    assert len(held[0][0]) == 40
    want = simjoin.meet([[np.concatenate([c[i] for c in cols]) for i in range(4)]], rule)
    assert (want[2] == -1).all()
    edges += zip(*(x.tolist() for x in simjoin.meet(held, rule)[:2]), strict=True)
    assert parts(edges) == parts(zip(want[0].tolist(), want[1].tolist(), strict=True))


def test_join_of_op5_stays_apart_with_many_frequent_tokens(spark, monkeypatch):
    """Three words at 0.9 as in op5: passages that 30 texts have are no reason to verify all texts in one group."""
    rng = random.Random(6)
    pool = [[f"p{i}a", f"p{i}b", f"p{i}c"] for i in range(300)]
    texts = [sum(([f"own{d}x{i}a", f"own{d}x{i}b", *passage] for i, passage in enumerate(rng.sample(pool, 20))), []) for d in range(450)]
    sizes = []

    def deal(members, rule, real=simjoin._deal):
        sizes.append(members.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])
        return real(members, rule)

    monkeypatch.setattr(simjoin, "_deal", deal)
    monkeypatch.setattr(simjoin, "FREQUENT", 20)
    rows = [(d, " ".join(t)) for d, t in enumerate([*texts, [*texts[7], "more"]])]
    got = simjoin.link(spark.createDataFrame(rows, "doc_id long, text string"), simjoin.Rule(3, 90)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: 7 if d == 450 else d for d in range(451)}
    assert sizes[0] <= 4
