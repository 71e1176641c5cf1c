"""The corpus pipeline: documents in, token digests out.

Each stage is one of the training-data operators over all that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palaver.llm import bpe, decontaminate, minhash, secrets, toxicity
from palaver.llm.common import dropped, kept, scratch, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labelled ones among docs, does not reject."""
    return toxicity.rejected_removed(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.near_dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document kept."""
    import public_tokenizers

    return bpe.encode_decode(docs, bpe.tokenizer_path(), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("encode", encode),
]

#: SQL cannot fit the classifier or merge byte pairs; tests/llm/test_pipeline.py holds every stage
#: against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again by the next.

    What a stage stored for itself is deleted once its result is written, and that once the next
    stage's is; so the folder holds two stages' tables at most.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            after = kept(stored(stage(spark, docs, sf_dir), name))
        if k:
            dropped(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
