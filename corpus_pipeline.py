"""The corpus pipeline: five stages, each over all that the one before it kept, each written and read again.

1. quality: documents that the quality rules or their host's verdict reject go;
2. near_duplicates: of each component of near copies (five-word shingles, similarity of 0.8 or more) one stays;
3. decontamination: documents with a passage of ten benchmark words go;
4. secrets: every secret in a text is replaced by a mark;
5. mixing: each remaining document is taken as often as its source's target weight asks, a row for each copy.

Stages 1 to 4 return the columns of documents; the last adds `copy`. Empty tables pass through all stages. Rows with a null
text go in stage 1; null hosts are a host, null doc_ids are documents like others; of rows that share doc_id and text one
passes stage 2; very long texts are worked on whole; extra columns pass through all stages, but for one named `copy`.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import common, decontam, mixing, quality, secrets, simjoin

#: SQL cannot express the random mix nor the secrets' marks; tests hold the stages against brute force instead.
ORACLE_SQL = None


_left = common.Left()


def _stage(function):
    """A stage as a step of the chain: it is called when its predecessor's result has been written and read again, so what the
    predecessor stored goes first. One chain at a time runs in a driver."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _left.go()
        with _left.over():
            return function(spark, docs, sf_dir)

    return run_stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with _left.over():
        return quality.keep(docs)


@_stage
def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simjoin.deduplicate(docs, simjoin.Rule(5, 80))


@_stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_documents(docs, common.table(spark, sf_dir, "benchmark"), 10)


@_stage
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _left.go()
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir. What a stage stored goes when its result is written, and that when the next
    stage has read it."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        _left.go()
        common.release(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
