"""Licence recognition by sentence rules, in DataFrame functions only.

A text is normalised to its letters and digits, lower case, single blanks, with marks where sentences end and where lines
end; what stands before a line's first word, comment marks and list numbers among them, does not count. A known sentence is
found where it begins after a mark and ends before one; it may run over single line ends, as in hard-wrapped texts and
comments, but not over an empty line. Of two that begin at one place the longer counts. Known sentences have identifiers.
A licence rule is an ordered list of identifiers; it holds where these occur in a text in that order, others between them
allowed. A rule whose sentences are part of a longer rule's does not count where that one holds and takes all of them: a
text with as many endings of the longer rule as beginnings of both. Sentences that do nothing but name a licence count for
it by themselves.

Scale: one pass over the scan, nothing is shuffled. Only texts with a telling word of the known sentences are searched: each
known sentence has such a word, so none is missed.

Defined cases: a null text has no sentences; an unknown licence word alone is no licence, and neither is "All rights
reserved."; repeated rows are judged row by row; a text with several licences lists them all, sorted; a very long text is
searched whole; an empty table gives no rows; input columns named sentence_ids or licenses are replaced.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import common
from lodestrata.llm.license_texts import ARTICLES, BEFORE, NAMES, RULES, SENTENCES

SENTENCE_END = r"(?<=[.!?;:])[\x20\x09\x0B-\x0D]+"
#: What stands before a line's first word: anything but letters and digits, and a list number or letter.
LINE_START = r"(?m)^[^a-z0-9\n]*(?:(?:[0-9]{1,2}|[a-z])[.)][\x20\x09]+)?"
TELLING = ("licen", "permi", "redistribut", "reserved", "contributors", "warranty", "copyright", "software", "acknowledg", "public domain", "confidential", "prohibited", "notice", "reciprocal", "reproduction", "released", "distributed", "available", "published")


def marked(sentence: str) -> str:
    """A known sentence as texts are normalised: S stands for the end of a sentence within it."""
    s = re.sub(SENTENCE_END, "S", sentence.lower())
    return re.sub(" ?S ?", "S", re.sub("[^a-z0-9S]+", " ", s)).strip(" S")


def plain(s: str) -> str:
    return s.replace("S", " ")


def _pattern(s: str) -> str:
    return s.replace("S", "(?:SN?|N)").replace(" ", "[ N]")


@cache
def known() -> dict[str, str]:
    """Identifier of each known sentence, by its plain normalised form."""
    return {plain(marked(v)): k for k, v in SENTENCES.items()}


@cache
def names() -> dict[str, str]:
    """Licence of each name, by its plain normalised form."""
    return {plain(marked(n)): k for k, all_ in NAMES.items() for n in all_}


def _before() -> str:
    """A pattern of what comes before a name."""
    some = "|".join(_pattern(marked(b)) + ("(?:SN?|N| )" if b.endswith(":") else "[ N]") for b in sorted(BEFORE, key=lambda b: (-len(b), b)))
    articles = "|".join(_pattern(marked(a)) for a in sorted(ARTICLES, key=lambda a: (-len(a), a)))
    return f"(?:{some})(?:(?:{articles})[ N])?"


@cache
def _any_known() -> str:
    """A pattern of all known sentences and namings in a marked text; those with one first word are tried together."""
    first: dict[str, list[str]] = {}
    for s in sorted({marked(v) for v in SENTENCES.values()}, key=lambda s: (-len(s), s)):
        word, _, rest = s.partition(" ")
        first.setdefault(word, []).append("[ N]" + _pattern(rest) if rest else "")
    sentences = "|".join(f"{w}(?:{'|'.join(rest)})" for w, rest in sorted(first.items()))
    named = "|".join(_pattern(marked(n)) for n in sorted({n for all_ in NAMES.values() for n in all_}, key=lambda n: (-len(n), n)))
    return rf"(?<![a-z0-9 ])(?:{sentences}|{_before()}(?:{named}))(?![a-z0-9 ])"


def contains(long: tuple[str, ...], short: tuple[str, ...]) -> bool:
    """Whether short's sentences are part of long's, in order."""
    rest = iter(long)
    return len(short) < len(long) and all(x in rest for x in short)


def overruled() -> list[tuple[int, int, str, str]]:
    """(rule, longer rule, the rule's first sentence, the first of the longer rule's that the rule lacks)."""
    return [(i, j, a[0], next(x for x in b if x not in a)) for i, (_, a) in enumerate(RULES) for j, (_, b) in enumerate(RULES) if contains(b, a)]


def _mapped(pairs: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))])


def identify(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sentence_ids (in order of occurrence) and licenses (sorted names)."""
    every = [*known(), *(plain(marked(b)) for b in BEFORE)]
    if blind := [s for s in every if not any(w in s for w in TELLING)]:
        raise ValueError(f"no telling word in {blind}")
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    telling = F.lit(False)
    for w in TELLING:
        telling |= F.contains(low, F.lit(w)) if " " not in w else low.rlike(w.replace(" ", r"[^a-z0-9]+"))
    # No capital is left in low: S stands for the end of a sentence, N for that of a line.
    ends = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, LINE_START, ""), SENTENCE_END, "S"), r"\n", "N")
    ends = F.regexp_replace(F.regexp_replace(ends, "[^a-z0-9SN]+", " "), " ?([SN]) ?", "$1")
    found = F.regexp_extract_all(F.trim(ends), F.lit(_any_known()), F.lit(0))
    named = lambda s: F.element_at(_mapped(names()), F.translate(F.regexp_replace(s, "^" + _before(), ""), "SN", "  "))
    told = F.transform(found, lambda s: F.coalesce(F.try_element_at(_mapped(known()), F.regexp_replace(s, "(?:SN?|N)", " ")), F.concat(F.lit("name:"), named(s))))
    none = F.array().cast("array<string>")
    out = common.without(docs, "sentence_ids", "licenses").withColumn("sentence_ids", F.when(telling, told).otherwise(none))
    return out.withColumn("licenses", F.when(F.size("sentence_ids") > 0, _licenses(F.col("sentence_ids"))).otherwise(none))


def _licenses(ids: Column) -> Column:
    line = F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))
    over: dict[int, list[tuple[int, str, str]]] = {}
    for i, j, first, key in overruled():
        over.setdefault(i, []).append((j, first, key))

    def rule(i: int) -> Column:
        name, parts = RULES[i]
        pattern = "," + ",(?:.*,)?".join(map(re.escape, parts)) + ","
        longer = [F.struct(F.lit(j).alias("no"), F.lit(a).alias("first"), F.lit(b).alias("key")) for j, a, b in over.get(i, [])]
        return F.struct(F.lit(i).alias("no"), F.lit(name).alias("name"), F.lit(pattern).alias("pattern"), (F.array(*longer) if longer else F.array().cast("array<struct<no:int,first:string,key:string>>")).alias("over"))

    count = lambda x: F.size(F.filter(ids, lambda y: y == x))
    held = F.filter(F.array(*[rule(i) for i in range(len(RULES))]), lambda r: F.rlike(line, r["pattern"]))
    numbers = F.transform(held, lambda r: r["no"])
    left = F.filter(held, lambda r: ~F.exists(r["over"], lambda o: F.array_contains(numbers, o["no"]) & (count(o["first"]) <= count(o["key"]))))
    by_name = F.transform(F.filter(ids, lambda y: F.startswith(y, F.lit("name:"))), lambda y: F.substring(y, 6, 99))
    return F.array_sort(F.array_distinct(F.concat(F.transform(left, lambda r: r["name"]), by_name)))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _oracle() -> str:
    """Written apart from the expressions above: pieces of lines are rows, runs of pieces are joined with the known sentences,
    and rules are walked sentence by sentence."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    sentences = ", ".join(f"({q(marked(v))}, {q(k)})" for k, v in SENTENCES.items())
    before = ", ".join(f"({q(marked(b))}, {q('S' if b.endswith(':') else ' ')})" for b in BEFORE)
    articles = ", ".join(f"({q(marked(a) + ' ')})" for a in ARTICLES)
    name_rows = ", ".join(f"({q(m)}, {q(k)})" for m, k in {marked(n): k for k, all_ in NAMES.items() for n in all_}.items())
    rules = ", ".join(f"({i}, {q(name)}, {len(parts)}, {p}, {q(x)})" for i, (name, parts) in enumerate(RULES) for p, x in enumerate(parts, 1))
    longer = ", ".join(f"({i}, {j}, {q(a)}, {q(b)})" for i, j, a, b in overruled())
    return rf"""
WITH RECURSIVE before(b, sep) AS (VALUES {before}), article(a) AS (VALUES (''), {articles}), named(m, k) AS (VALUES {name_rows}),
known AS (SELECT s, id FROM (VALUES {sentences}) t(s, id) UNION ALL SELECT b || sep || a || m, 'name:' || k FROM before, article, named),
keyed AS (SELECT s, id, replace(s, 'S', ' ') AS key FROM known),
heads AS (SELECT DISTINCT string_split(key, ' ')[1] AS w FROM keyed),
d AS (SELECT doc_id, string_split(lower(coalesce(text, '')), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, n, regexp_replace(lines[n], '^[^a-z0-9]*(([0-9][0-9]?|[a-z])[.)][\x20\x09]+)?', '') AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS n FROM d)),
c AS (SELECT doc_id, n, string_split(regexp_replace(line, '([.!?;:])[\x20\x09\x0B-\x0D]+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM l),
p AS (SELECT doc_id, n, k, k = len(parts) AS last, trim(regexp_replace(parts[k], '[^a-z0-9]+', ' ', 'g')) AS words FROM (SELECT doc_id, n, parts, unnest(range(1, len(parts) + 1)) AS k FROM c)),
-- An empty last piece is the blank after a sentence's end; other empty pieces are empty lines, which end a run.
o AS (SELECT doc_id, words, last AND NOT (k > 1 AND words = '') AS line_end, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) AS i FROM p WHERE NOT (k > 1 AND words = '' AND last)),
run AS (SELECT o.doc_id, o.i, o.i AS j, words AS run, line_end FROM o JOIN heads ON string_split(words, ' ')[1] = w
  UNION ALL SELECT run.doc_id, run.i, o.i, run.run || CASE WHEN run.line_end THEN 'N' ELSE 'S' END || o.words, o.line_end FROM run JOIN o ON o.doc_id = run.doc_id AND o.i = run.j + 1
  WHERE o.words <> '' AND run.run <> '' AND length(run.run) < 900 AND EXISTS (SELECT 1 FROM keyed WHERE starts_with(key, translate(run.run, 'SN', '  ')))),
hit AS (SELECT doc_id, i, j, id, length(run) AS n FROM run JOIN keyed ON key = translate(run, 'SN', '  ')
  WHERE len(list_filter(range(1, length(s) + 1), lambda x: (run[x] = 'S' AND s[x] <> 'S') OR (s[x] = 'S' AND run[x] = ' '))) = 0),
long AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY n DESC) = 1),
seen AS (SELECT * FROM long a WHERE NOT EXISTS (SELECT 1 FROM long b WHERE b.doc_id = a.doc_id AND b.i < a.i AND b.j >= a.i)),
rule(no, name, size, pos, sid) AS (VALUES {rules}),
walk AS (SELECT doc_id, no, 1 AS pos, min(i) AS place FROM seen JOIN rule ON sid = id AND pos = 1 GROUP BY doc_id, no
  UNION ALL SELECT doc_id, no, pos, place FROM (SELECT walk.doc_id, walk.no, rule.pos, s.i AS place, row_number() OVER (PARTITION BY walk.doc_id, walk.no, rule.pos ORDER BY s.i) AS k
    FROM walk JOIN rule ON rule.no = walk.no AND rule.pos = walk.pos + 1 JOIN seen s ON s.doc_id = walk.doc_id AND s.id = rule.sid AND s.i > walk.place) WHERE k = 1),
held AS (SELECT DISTINCT walk.doc_id, walk.no, name FROM walk JOIN rule ON rule.no = walk.no AND rule.pos = walk.pos WHERE walk.pos = size),
many AS (SELECT doc_id, id, count(*) AS n FROM seen GROUP BY 1, 2),
longer(no, by_no, first_id, key_id) AS (VALUES {longer}),
lost AS (SELECT a.doc_id, a.no FROM held a JOIN longer USING (no) JOIN held b ON b.doc_id = a.doc_id AND b.no = by_no
  JOIN many x ON x.doc_id = a.doc_id AND x.id = first_id JOIN many y ON y.doc_id = a.doc_id AND y.id = key_id WHERE x.n <= y.n),
lic AS (SELECT doc_id, name FROM held WHERE (doc_id, no) NOT IN (SELECT doc_id, no FROM lost) UNION SELECT doc_id, substr(id, 6) FROM seen WHERE id LIKE 'name:%'),
names AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses FROM lic GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids FROM seen GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN ids USING (doc_id) LEFT JOIN names USING (doc_id)"""


ORACLE_SQL = _oracle()
