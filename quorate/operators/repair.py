"""Audit of replacement texts for damaged documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.functions import text as tx
from quorate.operators.evaluation import anchor_hits
from quorate.session import spread

# Statuses, in the order in which they are decided.
STATUSES = ("SEM_FONTE", "FALHA", "SEM_GANHO", "REPARADO")
_REPLACEMENT_CHARACTER = "�"


def judge_replacements(documents: DataFrame, replacements: DataFrame) -> DataFrame:
    """(source_doc, text, new_text, url, status, words_before, words_new) per target document.

    No source address: SEM_FONTE.  No text, broken encoding or no shared run of words: FALHA.  No
    more words than before: SEM_GANHO.  Otherwise: REPARADO.
    """
    no_source, failed, no_gain, repaired = STATUSES
    both = spread(documents, "source_doc").join(replacements, "source_doc")
    new = F.coalesce("new_text", F.lit(""))
    sized = both.withColumn("words_before", tx.word_count(F.col("text"))).withColumn(
        "words_new", tx.word_count(new)
    )
    unusable = F.col("new_text").isNull() | F.contains(new, F.lit(_REPLACEMENT_CHARACTER))
    status = (
        F.when(F.col("url").isNull(), no_source)
        .when(unusable, failed)
        .when(~tx.shared_run(F.col("text"), new), failed)
        .when(F.col("words_new") <= F.col("words_before"), no_gain)
        .otherwise(repaired)
    )
    return sized.withColumn("status", status)


def repair_audit(documents: DataFrame, replacements: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per target: status, words, and expected articles matched before and after.

    ``expected`` (source_doc, anchor) repeats an article once per item that expects it; repeats
    count only in ``pairs_gained``.
    """
    judged = judge_replacements(documents, replacements)
    counted = expected.groupBy("source_doc", "anchor").agg(F.count("*").alias("repeats"))

    def matches(column: str, flag: str) -> DataFrame:
        texts = judged.select("source_doc", F.coalesce(column, F.lit("")).alias("text"))
        hit = anchor_hits(texts.withColumn("chunk_id", F.col("source_doc")), counted)
        return hit.select("source_doc", "anchor", F.lit(True).alias(flag))

    flags = (
        counted.join(matches("text", "_a"), ["source_doc", "anchor"], "left")
        .join(matches("new_text", "_b"), ["source_doc", "anchor"], "left")
    )
    a, b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    per = flags.groupBy("source_doc").agg(
        F.count("*").alias("n_articles"),
        F.count_if(a).alias("_before"),
        F.count_if(b).alias("_after"),
        F.sum(F.when(b & ~a, F.col("repeats")).otherwise(0)).alias("_gained"),
    )
    fixed = F.col("status") == STATUSES[-1]
    before = F.coalesce("_before", F.lit(0))
    return judged.drop("text", "new_text").join(per, "source_doc", "left").select(
        "source_doc",
        "status",
        "words_before",
        F.when(F.col("status") == STATUSES[0], F.col("words_before")).otherwise(F.col("words_new")).alias("words_after"),
        F.col("status").isin(*STATUSES[2:]).alias("shared"),
        F.coalesce("n_articles", F.lit(0)).alias("n_articles"),
        before.alias("articles_before"),
        F.when(fixed, F.coalesce("_after", F.lit(0))).otherwise(before).alias("articles_after"),
        F.when(fixed, F.coalesce("_gained", F.lit(0))).otherwise(F.lit(0)).alias("pairs_gained"),
    )


def repaired_documents(
    documents: DataFrame, replacements: DataFrame, expected: DataFrame | None = None
) -> DataFrame:
    """All documents; only a repaired target takes its new text."""
    judged = judge_replacements(documents, replacements).where(F.col("status") == STATUSES[-1])
    new = judged.select("source_doc", F.col("new_text").alias("_new"))
    return documents.join(new, "source_doc", "left").select(
        "source_doc",
        F.coalesce("_new", "text").alias("text"),
        F.col("_new").isNotNull().alias("repaired"),
    )
