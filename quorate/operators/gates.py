"""Quality gates: each returns the violating rows or counts; ``require_empty`` turns them into an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.constants import GOLDEN_TOLERANCE


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise when a gate reports anything; looks at no more than five rows."""
    examples = violations.take(5)
    if examples:
        raise ValueError(f"{message}: {[r.asDict() for r in examples]}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def id_set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids present on one side only, with the side that has them."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, key, "full")
    return both.where("_l is null or _r is null").select(
        key, F.when(F.col("_l").isNull(), "right_only").otherwise("left_only").alias("side")
    )


def domain_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Count of rows that break each named rule, in one pass; null counts as a break."""
    broken = df.agg(
        *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()]
    )
    return broken.unpivot([], list(rules), "rule", "n_violations")


def unequal_sizes(panel: DataFrame, group: str) -> DataFrame:
    """Groups whose row count differs from the largest one (agents must cover the same items)."""
    sizes = panel.groupBy(group).agg(F.count("*").alias("n"))
    return sizes.where(F.col("n") != sizes.agg(F.max("n")).scalar())


def golden_drift(
    metrics: DataFrame, golden: DataFrame, keys: Sequence[str], tolerance: float = GOLDEN_TOLERANCE
) -> DataFrame:
    """Metrics that moved from their recorded value by more than the tolerance, or are missing."""
    joined = golden.withColumnRenamed("value", "golden").join(metrics, list(keys), "full")
    delta = F.abs(F.col("value") - F.col("golden"))
    return joined.withColumn("delta", delta).where(delta.isNull() | (delta > tolerance))


def reproduction_mismatches(
    ours: DataFrame, stored: DataFrame, key: str, rtol: float = 1e-5, atol: float = 1e-8
) -> DataFrame:
    """Items whose winner differs or whose score is not close to the stored one."""
    b = stored.select(
        key, F.col("agent_chosen").alias("_agent"), F.col("score").alias("_score")
    )
    close = F.abs(F.col("score") - F.col("_score")) <= F.lit(atol) + F.lit(rtol) * F.abs("_score")
    same = F.col("agent_chosen").eqNullSafe(F.col("_agent"))
    return ours.join(b, key, "full").where(~same | ~F.coalesce(close, F.lit(False)))


def alignment_report(chunks: DataFrame, vectors: DataFrame, postings: DataFrame) -> DataFrame:
    """Chunks without vector, vectors without chunk and postings without chunk, in one row each."""
    ids = chunks.select("chunk_id").distinct()
    terms = postings.select("chunk_id").distinct()

    def missing(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        return a.join(b, "chunk_id", "left_anti").agg(F.count("*").alias("n")).withColumn(
            "check", F.lit(name)
        )

    vec = vectors.select("chunk_id").distinct()
    return (
        missing(ids, vec, "chunk_without_vector")
        .unionByName(missing(vec, ids, "vector_without_chunk"))
        .unionByName(missing(terms, ids, "posting_without_chunk"))
        .select("check", "n")
    )
