"""From raw documents to tokens: quality, near-duplicates, benchmark passages, personal data, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import bpe, decontaminate, near, pii, quality
from recordloom.llm.common import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _measured(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the lengths of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold of the classifier."""
    return quality.accepted(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word Jaccard similarity of 0.8 or more): that with the smallest id.

    Candidates come from the SimHash index of operator 8 and, beyond its reach, from shared shingles; each is compared exactly.
    """
    return near.first_rows(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages cut out of their texts."""
    return _measured(decontaminate.without_passages(docs, table(spark, sf_dir, "benchmark")))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal numbers, dates and addresses."""
    return _measured(pii.pseudonymised(docs))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids of each text and of the bytes they decode to."""
    return bpe.digests(bpe.encode_decode(docs))


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark_passages),
    ("pii", hide_personal_data),
    ("bpe", tokenise),
]

ORACLE_SQL = None  # a fitted classifier and a tokenizer are no SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
