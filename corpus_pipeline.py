"""A training-data pipeline over ``documents``: each stage reads what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of ``documents``;
the last returns token ids. Extra columns of ``documents`` travel along unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quorate.llm import byte_convnet, shingle_join, speculative_bpe, template_tree, winnowing
from quorate.llm.common import documents, materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for low quality go."""
    return byte_convnet.keep_good(docs, byte_convnet.train(docs, documents(spark, sf_dir, "labels")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template an earlier document has are taken out of the texts."""
    return template_tree.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose texts share 0.8 of their 5-word shingles or more."""
    return shingle_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat benchmark passages go."""
    return winnowing.drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts, and the text that they decode to."""
    keep = tuple(c for c in docs.columns if c in ("doc_id", "lang", "source"))
    return speculative_bpe.encode_texts(docs, VOCABULARY, keep)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("repeated_lines", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("encoded", encoded),
]

# A trained network, XXH64 fingerprints and byte-pair encoding have no SQL form; tests/llm holds the
# stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
