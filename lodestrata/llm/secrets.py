"""Secret scanning with a trigram inverted index, in DataFrame functions only.

From each rule's regular expression follows a Boolean query of trigrams that any match must contain, in lower case: an
OR over alternatives of the AND of their trigrams. The index holds postings (trigram, document) for the trigrams of all
rules; their intersection names the candidate documents of a rule, where its expression is then verified. A rule with an
alternative that has no mandatory trigram is run over every text.

A span is a whole match, by code points, end exclusive. Matches are leftmost and do not overlap within a kind; those
whose measured group is shorter than the rule asks are dropped afterwards.

Scale: postings are narrow; candidates are joined back by doc_id, by broadcast only where their counted rows are few.
Texts are read twice and never exploded.

Defined cases: a null text is empty; a null doc_id is a key of its own; rows that share a doc_id share their candidates
(a superset) and are verified row by row; empty tables give empty results; very long texts are scanned whole; an input
column named spans is replaced, others pass whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import common


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    # Maximal runs of 16 or more: the same spans as those of [0-9a-f]+ without the shorter ones.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: Alternatives that an expression is expanded to at most, and characters of a class that count as alternatives.
ALTERNATIVES, CLASS = 256, 5
GAP = None


class _Parser:
    """Reads an expression as sequences of characters and gaps, one of which any match follows.

    It knows literals, escapes, classes, groups, alternatives, anchors and greedy, lazy or possessive repeats. A character
    that ignores case is a class of both letters. What it does not know is an error."""

    def __init__(self, pattern: str):
        self.s, self.i = pattern, 0

    def whole(self) -> list[tuple]:
        out = self.choice()
        if self.i < len(self.s):
            raise ValueError(f"{self.s!r} has an unexpected {self.s[self.i]!r} at {self.i}")
        return out

    def choice(self) -> list[tuple]:
        out = self.sequence()
        while self.next("|"):
            out = out + self.sequence()
        return out if len(out) <= ALTERNATIVES else [(GAP,)]

    def next(self, c: str) -> bool:
        found = self.s.startswith(c, self.i)
        self.i += len(c) * found
        return found

    def sequence(self) -> list[tuple]:
        out: list[tuple] = [()]
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            some = self.repeated(self.atom())
            out = [a + b for a, b in product(out, dict.fromkeys(some))]
            if len(out) > ALTERNATIVES:
                out = [(GAP,)]
        return out

    def atom(self) -> list[tuple]:
        if self.next("(?:") or self.next("("):
            if self.s.startswith("?", self.i):
                raise ValueError(f"{self.s!r} has a group of an unknown kind at {self.i}")
            out = self.choice()
            if not self.next(")"):
                raise ValueError(f"{self.s!r} has an open group")
            return out
        if self.next("["):
            return self.char_class()
        if self.next("^") or self.next("$"):
            return [()]
        if self.next("."):
            return [(GAP,)]
        if self.next("\\"):
            if self.s[self.i] in "bBAZz":
                self.i += 1
                return [()]
            return self.one(self.escaped())
        self.i += 1
        return self.one(self.s[self.i - 1])

    @staticmethod
    def one(c: str | None) -> list[tuple]:
        return [(c.lower(),)] if c is not None and ord(c) < 128 else [(GAP,)]

    def escaped(self) -> str | None:
        """The character after a backslash, None for a class of many."""
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return chr(int(self.s[self.i - 2 : self.i], 16))
        if c in "dDwWsS":
            return None
        if c.isalnum() and c not in "nrtf":
            raise ValueError(f"{self.s!r} has an unknown escape {c!r}")
        return {"n": "\n", "r": "\r", "t": "\t", "f": "\f"}.get(c, c)

    def char_class(self) -> list[tuple]:
        plain, chars, first = not self.next("^"), set(), True
        while first or not self.next("]"):
            first = False
            if self.next("\\"):
                c = self.escaped()
            else:
                c = self.s[self.i]
                self.i += 1
            if self.s.startswith("-", self.i) and not self.s.startswith("-]", self.i):
                self.i += 1
                if self.next("\\"):
                    self.escaped()
                else:
                    self.i += 1
                plain = False  # a range: many characters
            elif c is None or ord(c) >= 128:
                plain = False
            else:
                chars.add(c.lower())
        return [(c,) for c in sorted(chars)] if plain and len(chars) <= CLASS else [(GAP,)]

    def repeated(self, inner: list[tuple]) -> list[tuple]:
        if self.next("?"):
            low, high = 0, 1
        elif self.next("*"):
            low, high = 0, None
        elif self.next("+"):
            low, high = 1, None
        elif m := _COUNT.match(self.s, self.i):
            self.i = m.end()
            low = int(m[1])
            high = low if m[2] is None else int(m[3]) if m[3] else None
        else:
            return inner
        self.next("?") or self.next("+")
        if (low, high) == (0, 1):
            return [(), *inner]
        if low == 0:
            return [(GAP,)]
        if low == high and len(inner) == 1:
            return [inner[0] * low]
        return [x + (GAP,) for x in inner] if low == 1 else [(GAP,)]


_COUNT = re.compile(r"\{(\d+)(,(\d*))?\}")


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives, each a set of mandatory trigrams in lower case; None where one alternative has none."""
    found = set()
    for seq in _Parser(pattern).whole():
        grams = {"".join(seq[i : i + 3]) for i in range(len(seq) - 2) if GAP not in seq[i : i + 3]}
        if not grams:
            return None
        found.add(frozenset(grams))
    return sorted((x for x in found if not any(y < x for y in found)), key=sorted)


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({g for r in rules for a in trigram_query(r.pattern) or () for g in a})


def index(docs: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """Postings (trigram, doc_id) of the given trigrams, without repeats in a row."""
    low = docs.select("doc_id", F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    return low.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.contains("_t", F.lit(g)), F.lit(g)) for g in trigrams]))).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id and the kinds whose trigram query its postings satisfy."""
    grams = vocabulary(rules)
    place = {g: i for i, g in enumerate(grams)}
    words = -(-len(grams) // 60)
    bit = {g: (i // 60, 1 << (i % 60)) for g, i in place.items()}
    known = F.create_map(*[x for g in grams for x in (F.lit(g), F.lit(bit[g][1]).cast("long"))])
    where = F.create_map(*[x for g in grams for x in (F.lit(g), F.lit(bit[g][0]))])
    b = postings.select("doc_id", known[F.col("trigram")].alias("b"), where[F.col("trigram")].alias("w"))
    have = b.groupBy("doc_id").agg(*[F.coalesce(F.bit_or(F.when(F.col("w") == k, F.col("b"))), F.lit(0).cast("long")).alias(f"m{k}") for k in range(words)])

    def holds(grams: frozenset[str]) -> Column:
        need = [sum(bit[g][1] for g in grams if bit[g][0] == k) for k in range(words)]
        test = F.lit(True)
        for k, n in enumerate(need):
            if n:
                test &= F.col(f"m{k}").bitwiseAND(F.lit(n)) == n
        return test

    kinds = []
    for r in rules:
        query = trigram_query(r.pattern)
        if query is not None:
            test = F.lit(False)
            for a in query:
                test |= holds(a)
            kinds.append(F.when(test, F.lit(r.kind)))
    return have.select("doc_id", F.array_compact(F.array(*kinds)).alias("kinds")).filter(F.size("kinds") > 0)


def spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans in text: array of (start, kind's place, end)."""
    whole, measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    rows = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x)).alias("p"), F.transform(whole, lambda x: F.length(x)).alias("m"), F.transform(measured, lambda x: F.length(x)).alias("g"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["p"]
        e = s + F.coalesce(x["m"], F.lit(0))
        one = F.struct(s.alias("start"), F.lit(order).alias("kind"), e.alias("end"))
        return F.struct(e.alias("at"), F.when(x["m"].isNotNull() & (x["g"] >= rule.least), F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(rows, start, step, lambda a: a["out"])).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with `spans`: array of (start, kind's place in rules, end), by start, then kind."""
    base = common.without(docs, "spans")
    id_, kinds = common.fresh(base, "_id"), common.fresh(base, "_kinds")
    full = [r for r in rules if trigram_query(r.pattern) is None]
    grams = vocabulary(rules)
    t = F.coalesce(F.col(text), F.lit(""))
    found = [spans(t, r, i) if r in full else F.when(F.array_contains(kinds, r.kind), spans(t, r, i)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>")) for i, r in enumerate(rules)]
    if grams:
        some = common.stored(candidates(index(base, grams, text), rules), "secrets").withColumnsRenamed({"doc_id": id_, "kinds": kinds})
        base = base.join(common.maybe_broadcast(some), F.col("doc_id").eqNullSafe(F.col(id_)), "left").drop(id_)
    return base.withColumn("spans", F.sort_array(F.concat(*found))).drop(kinds)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mark (overlapping spans by one), n_chars kept in step if there is one."""
    docs, columns = common.aside(docs, "spans")
    found = scan(docs, rules)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        between = F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"])
        return F.struct(F.when(fresh, F.concat(a["out"], between, F.lit(mark))).otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    made = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    out = found.withColumn("text", F.when(F.size("spans") > 0, made).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)


def _of_kind(i: int):
    return lambda x: x["kind"] == i


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    shown = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")
    base = [i for i, r in enumerate(RULES) if r.base]
    n = [F.size(F.filter("spans", _of_kind(i))).cast("long").alias(f"n_{RULES[i].kind}") for i in base]
    return found.select("doc_id", *n, F.sha2(shown(F.filter("spans", lambda x: x["kind"] <= max(base))), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def _oracle() -> str:
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, {i} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {r.group}) AS g, string_split_regex(t, '{p}') AS p FROM d WHERE regexp_matches(t, '{p}')")
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), r AS (" + " UNION ALL ".join(parts) + """),
x AS (SELECT doc_id, k, kind, least, length(g[i]) AS n, CAST(list_sum(list_transform(p[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS BIGINT) AS s, length(m[i]) AS w
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM r)),
y AS (SELECT doc_id, k, kind, s, kind || ':' || s || ':' || (s + w) AS v FROM x WHERE n >= least),
z AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  string_agg(v, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS b, string_agg(v, ',' ORDER BY s, k) AS a FROM y GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN z USING (doc_id)"""
    )


ORACLE_SQL = _oracle()
