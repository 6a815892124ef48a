"""Quality rules with host verdicts, in DataFrame functions only.

Each document gets counts from its whole text. Words are runs of anything but ASCII white space:

* word_chars: code points in words; n_symbols: characters of `#*$%&|<>`;
* n_dup_lines: lines with a word that equal an earlier line;
* n_repeat_words: words in 3-word windows that occur twice or more (windows are compared by 64-bit hash).

A document fails the base rules with fewer than MIN_WORDS words or with over half of its words repeated. It fails the
soft rules with many symbols or many repeated lines. The failures of either kind are summed by host; a host's rate is
shrunk towards all hosts by a beta prior fitted by moments, and a host whose shrunk rate is over HOST_LIMIT is rejected
with all its documents.

Scale: the counts are computed in the scan, only they are kept; hosts are pre-aggregated before the shuffle, so a host
with a third of all rows costs no more than another.

Defined cases: a null text has no words and fails; a null host is a host of its own; without rows nothing is returned;
with one host, or hosts that do not differ, the prior is the overall rate with the weight of PRIOR_MAX documents;
repeated rows count each; extra columns pass through `keep` whatever their names, and those that clash are replaced by the
operator's own in `judge`; a very long text is counted whole, as arrays of its words in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import common

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS_PER_WORD = 0.5
#: Repeated lines may be this share of a text's lines, a line being taken for eight words.
DUP_LINE_SHARE = 0.5
HOST_LIMIT = 0.75
PRIOR_MIN, PRIOR_MAX = 2.0, 10_000.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bound(value: Column, use) -> Column:
    """use(value) with value computed once: lambdas compute an outer expression anew for every element."""
    return F.transform(F.array(value), use)[0]


def _repeats(w: Column) -> Column:
    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def repeated(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(bound(ordered, covered))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, 0).otherwise(bound(hashes, repeated))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the five counts of text. Of docs' columns those named like a count are replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = bound(words, lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeats(w).alias("n_repeat_words")))
    of_lines = bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    found = common.without(docs, *COUNTS).withColumn("_w", of_words)
    return (
        found.withColumn("n_words", F.col("_w.n_words").cast("long"))
        .withColumn("word_chars", F.col("_w.word_chars").cast("long"))
        .withColumn("n_symbols", F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", of_lines.cast("long"))
        .withColumn("n_repeat_words", F.col("_w.n_repeat_words").cast("long"))
        .drop("_w")
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def soft_failed() -> Column:
    return (F.col("n_symbols") > SYMBOLS_PER_WORD * F.col("n_words")) | (F.col("n_dup_lines") > DUP_LINE_SHARE * F.col("n_words") / 8)


def hosts(counted: DataFrame, host: str = "source", failed: Column | None = None) -> DataFrame:
    """One row per host: its documents, failures (of either kind), shrunk rate and whether it is rejected."""
    failed = base_failed() | soft_failed() if failed is None else failed
    by_host = counted.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"))
    by_host = common.stored(by_host, "host-counts")
    m, v, w = by_host.agg(F.sum("failed") / F.sum("n"), F.var_pop(F.col("failed") / F.col("n")), F.avg(1 / F.col("n"))).first()
    m, between = m or 0.0, (v or 0.0) - (m or 0.0) * (1 - (m or 0.0)) * (w or 0.0)  # less what sampling adds
    k = min(max(m * (1 - m) / between - 1, PRIOR_MIN), PRIOR_MAX) if between > 0 else PRIOR_MAX
    shrunk = (F.col("failed") + m * k) / (F.col("n") + k)
    return by_host.select("host", "n", "failed", shrunk.alias("rate"), (shrunk > HOST_LIMIT).alias("rejected"))


def judge(docs: DataFrame, host: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and host of every document with its counts, base_failed, host_rate and kept."""
    own = [*COUNTS, "base_failed", "host_rate", "kept"]
    columns = list(dict.fromkeys(c for c in (*keep, host) if c not in own))
    counted = common.stored(counts(docs.select(*dict.fromkeys([*columns, "text"]))).select(*columns, *COUNTS), "quality")
    verdicts = hosts(counted, host).select(F.col("host").alias("_host"), "rate", "rejected")
    joined = counted.join(verdicts, F.col(host).eqNullSafe(F.col("_host")), "left")
    return joined.select(*columns, *COUNTS, base_failed().alias("base_failed"), F.col("rate").alias("host_rate"), (~base_failed() & ~F.col("rejected")).alias("kept"))


def keep(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that pass the base rules and whose host is not rejected, with docs' own columns.

    Each text is counted once: rows that pass the base rules are stored with their host, of the others only the host and
    the failure; hosts are then summed from the narrow columns, so no text is shuffled."""
    rows = docs.select(F.struct(*docs.columns).alias("_d"), F.col("text"), F.col(host).alias("_host"))
    judged = counts(rows).select("_host", base_failed().alias("_base"), (base_failed() | soft_failed()).alias("_failed"), F.when(~base_failed(), F.col("_d")).alias("_d"))
    with common.scratch() as keep_:
        judged = common.stored(judged, "judged")
        rejected = common.stored(hosts(judged, "_host", F.col("_failed")).filter("rejected").select("host"), "hosts")
        keep_ += [judged, rejected]
    passed = judged.filter(~F.col("_base")).select("_d", "_host")
    return passed.join(common.maybe_broadcast(rejected), F.col("_host").eqNullSafe(F.col("host")), "left_anti").select("_d.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS x FROM d),
c AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(x) - len(list_distinct(x)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols > 0.5 * n_words OR n_dup_lines > 0.5 * n_words / 8 AS soft FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR soft) AS k FROM f GROUP BY source),
p AS (SELECT sum(k) / sum(n) AS m, var_pop(k / n) AS v, avg(1 / n) AS w FROM h),
q AS (SELECT m, CASE WHEN v - m * (1 - m) * w > 0 THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * w) - 1, 2.0), 10000.0) ELSE 10000.0 END AS s FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (k + m * s) / (n + s) > 0.75 AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, q
"""
