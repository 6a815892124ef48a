"""Chat logs: event-sourced reconstruction, formatting with a loss mask, and reading back.

Events (conv_id, seq, message, op, role, text) are folded by conversation in order of seq, ties by op and text:

* message: begins a message with role and text;
* delta: adds text to it;
* edit: replaces its text;
* regenerate: begins it anew, and all messages after it that had begun before are dropped.

Formatting marks each turn by role and puts a backslash before every control string and backslash of a text, which can be
undone. The loss mask covers the assistants' texts, without marks.

Scale: the fold is window functions over one hash partitioning by conversation, which spill. Formatting and reading back
stream over sorted rows and hold one message and chunks of CHUNK characters in all; a conversation longer than that becomes
several chunks, cut between turns, so that none has to fit in memory.

Defined cases: a null text is empty; a null role is written as an empty other role; null seq comes first; a null conv_id
is a conversation of its own; rows with an unknown op are ignored; repeated message events of one message leave the last;
deltas without a beginning make a message with a null role; a very long message is one text; clashing names: only the named
columns are read; an empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm import common

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
#: Any other role stands between the first two of these; the third ends its turn.
OTHER = ("<|", "|>", "<|/|>")
CONTROL = [x for pair in MARKS.values() for x in pair] + ["<|/|>", "<|", "|>"]
_ANY = "|".join(map(re.escape, CONTROL))
_ESCAPE = re.compile(rf"\\|{_ANY}")
_UNESCAPE = re.compile(rf"\\(\\|{_ANY})")
_TOKEN = re.compile(rf"\\(?:\\|{_ANY})|({_ANY})")
CHUNK = 4_000_000
ROWS = 500
SCHEMA = "conv_id long, chunk int, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>"


def _plain(x: pa.Scalar) -> str:
    return x.as_py()


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def turn(role: str, text: str) -> tuple[str, str, str]:
    """A turn's opening, escaped text and closing."""
    opening, closing = MARKS.get(role) or (OTHER[0] + escape(role) + OTHER[1], OTHER[2])
    return opening, escape(text), closing


def turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted string."""
    roles = {o: r for r, (o, _) in MARKS.items()}
    tokens = ((m[1], m.start(), m.end()) for m in _TOKEN.finditer(formatted) if m[1])
    for mark, _, end in tokens:
        if mark == OTHER[0]:
            mark, start, stop = next(tokens)
            role, closing, end = unescape(formatted[end:start]), OTHER[2], stop
            expected = OTHER[1]
        else:
            role = roles[mark]
            closing, expected = MARKS[role][1], mark
        if mark != expected:
            raise ValueError(f"{mark} stands where {expected} should")
        mark, start, _ = next(tokens)
        if mark != closing:
            raise ValueError(f"{mark} stands where {closing} should")
        yield role, unescape(formatted[end:start])


def fold(events: DataFrame) -> DataFrame:
    """The pieces (conv_id, message, seq, role, text) of the final messages, to be joined in order of seq."""
    op = F.coalesce("op", F.lit("message"))
    e = events.select("conv_id", "seq", "message", op.alias("op"), "role", F.coalesce("text", F.lit("")).alias("text")).filter(F.col("op").isin("message", "delta", "edit", "regenerate"))
    e = e.repartition("conv_id")
    last_first = [F.desc_nulls_last("seq"), F.desc("op"), F.desc("text")]
    of_message, of_conv = Window.partitionBy("conv_id", "message"), Window.partitionBy("conv_id")
    later = F.count_if(F.col("op") != "delta").over(of_message.orderBy(*last_first).rowsBetween(Window.unboundedPreceding, -1))
    cut = F.min(F.when(F.col("op") == "regenerate", F.col("message"))).over(of_conv.orderBy(*last_first).rowsBetween(Window.unboundedPreceding, -1))
    order = F.struct(F.col("seq"), F.col("op"), F.col("text"))
    begins = F.col("op").isin("message", "regenerate")
    e = e.withColumn("later", later).withColumn("cut", cut)
    e = e.withColumn("begin", F.max_by(F.struct("cut"), F.when(begins, order)).over(of_message)).withColumn("role", F.max_by("role", F.when(F.col("role").isNotNull(), order)).over(of_message))
    alive = F.coalesce(F.col("message") <= F.col("begin.cut"), F.lit(True))
    return e.filter((F.col("later") == 0) & alive).select("conv_id", "message", "seq", "role", "text", "op")


def render(pieces: DataFrame) -> DataFrame:
    """Formatted conversations: conv_id, chunk, n_turns, formatted, loss_spans (code points of the chunk)."""
    common.ship(pieces.sparkSession)
    ordered = pieces.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "seq", F.when(F.col("op") == "delta", 1).otherwise(0).alias("added"))
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("message"), F.asc_nulls_first("seq"), "added", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        chunk = {"conv": None, "no": 0, "turns": 0, "at": 0, "out": [], "loss": [], "held": 0}
        message: list = []  # conv, message, role, texts

        def close_chunk() -> None:
            if chunk["turns"]:
                rows.append((chunk["conv"], chunk["no"], chunk["turns"], "".join(chunk["out"]), chunk["loss"]))
                chunk.update(no=chunk["no"] + 1, turns=0, held=chunk["held"] + chunk["at"], at=0, out=[], loss=[])

        def close_message() -> None:
            if message:
                conv, _, role, texts = message
                opening, body, closing = turn(role, "".join(texts))
                if chunk["conv"] != conv or chunk["no"] == 0 and not chunk["turns"]:
                    close_chunk()
                    chunk.update(conv=conv, no=0)
                elif chunk["at"] + len(body) > CHUNK:
                    close_chunk()
                start = chunk["at"] + len(opening)
                if role == "assistant" and body:
                    chunk["loss"].append({"start": start, "end": start + len(body)})
                chunk["out"] += [opening, body, closing]
                chunk["at"] = start + len(body) + len(closing)
                chunk["turns"] += 1
                message.clear()

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "chunk", "n_turns", "formatted", "loss_spans"])
            rows.clear()
            chunk["held"] = 0
            return out

        for batch in batches:
            for conv, no, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), map(_plain, batch.column(3)), strict=True):
                if message and message[:2] == [conv, no]:
                    message[3].append(text)
                else:
                    close_message()
                    message += [conv, no, role, [text]]
                if len(rows) >= ROWS or chunk["held"] >= CHUNK:
                    yield made()
        close_message()
        close_chunk()
        yield made()

    return ordered.mapInArrow(run, SCHEMA)


def digest(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    common.ship(formatted.sparkSession)
    ordered = formatted.select("conv_id", "chunk", "formatted", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []  # conv, turns, digest, loss characters, loss digest, characters
        done: list[list] = []

        def made() -> pa.RecordBatch:
            columns = [[r[0] for r in done], [r[1] for r in done], [r[2].hexdigest() for r in done], [r[3] for r in done], [r[4].hexdigest() for r in done], [r[5] for r in done]]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, text, loss in zip(batch.column(0).to_pylist(), map(_plain, batch.column(2)), batch.column(3).to_pylist(), strict=True):
                if not now or now[0] != conv:
                    if now:
                        done.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode("utf-8", "replace"))
                for s in loss:
                    masked = unescape(text[s["start"] : s["end"]])
                    now[3] += len(masked)
                    now[4].update(masked.encode("utf-8", "replace"))
                now[5] += len(text)
            if len(done) >= ROWS:
                yield made()
        if now:
            done.append(now)
        yield made()

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events(conversations: DataFrame) -> DataFrame:
    """The log of plain conversation rows: each row a message, in order of turn, ties by role and text."""
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id")
    n = F.row_number().over(w).cast("long")
    return rows.select("conv_id", n.alias("seq"), n.alias("message"), F.lit("message").alias("op"), "role", "text")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ours = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return digest(common.stored(render(fold(events(told.unionByName(ours)))), "chat"))


# A turn's length is that of its marks, its text and a backslash for each control string and backslash in it.
_COUNTED = r"\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<\|/\|>|<\||\|>"
_ORDER = "ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST"
ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, role AS r, text AS x, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]', role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
m AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_COUNTED}')) AS n,
  CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 9 + length(role) + len(regexp_extract_all(role, '{_COUNTED}')) END AS marks FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + marks) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
