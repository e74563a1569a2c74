"""Cross-fitting folds, samples and annotation draws, all by deterministic digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from quorate.functions import constants as C
from quorate.functions.rand import draw_digest, permute
from quorate.operators.prefix import distributed_rank
from quorate.session import values_table


def assign_folds(
    items: DataFrame, stratum: str, n_folds: int = C.N_FOLDS, seed: int = 42
) -> DataFrame:
    """(item_id, stratum, fold_k): shuffled inside each stratum, dealt round robin.

    A stratum starts where the earlier strata stopped, so whole folds differ by at most one item.
    """
    keyed = items.select("item_id", stratum, draw_digest(F.col("item_id"), seed).alias("digest"))
    ranked = distributed_rank(keyed, [stratum], "digest", ["item_id"])
    sizes = items.groupBy(stratum).agg(F.count("*").alias("_n"))
    earlier = W.orderBy(stratum).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(stratum, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return ranked.join(starts, stratum).select(
        "item_id", stratum, ((F.col("rank0") + F.col("_start")) % n_folds).cast("int").alias("fold_k")
    )


def fold_roles(
    spark: SparkSession, n_folds: int = C.N_FOLDS, n_val: int = C.N_VAL_FOLDS, seed: int = 42
) -> DataFrame:
    """(exec_k, fold_k, role): K x K parameter rows; test is fold k, validation the first ``n_val``
    folds of the seeded permutation without k, fit the rest."""
    if n_val >= n_folds:
        raise ValueError("the number of validation folds must be below the number of folds")
    order = permute(list(range(n_folds)), seed)
    rows = []
    for k in range(n_folds):
        rest = [f for f in order if f != k]
        rows.append((k, k, "test"))
        rows += [(k, f, "val") for f in rest[:n_val]]
        rows += [(k, f, "fit") for f in rest[n_val:]]
    return values_table(spark, "exec_k, fold_k, role", rows)


def fit_fold_lists(
    n_folds: int = C.N_FOLDS, n_val: int = C.N_VAL_FOLDS, seed: int = 42
) -> dict[int, list[int]]:
    """Fit folds of each execution, for jobs that run once per fold."""
    order = permute(list(range(n_folds)), seed)
    return {k: [f for f in order if f != k][n_val:] for k in range(n_folds)}


def fold_cover(folds: DataFrame, roles: DataFrame) -> DataFrame:
    """Items that are not in the test part exactly once (empty when the cover is right)."""
    tests = folds.join(roles.where("role = 'test'"), "fold_k", "left")
    return (
        tests.groupBy("item_id")
        .agg(F.count("exec_k").alias("n_tests"))
        .where("n_tests <> 1")
    )


def stratified_sample(
    items: DataFrame, flag: str, size: int, seed: int = 42
) -> DataFrame:
    """Proportional sample of two strata without replacement; the share of the flagged stratum is
    rounded half to even, the other takes the rest; ``draw_order`` shuffles the result."""
    keyed = items.select("item_id", flag, draw_digest(F.col("item_id"), seed).alias("digest"))
    ranked = distributed_rank(keyed, [flag], "digest", ["item_id"])
    totals = items.agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("n_flag"))
    n, n_flag = totals.select("n").scalar(), totals.select("n_flag").scalar()
    quota_flag = F.bround(F.lit(size) * n_flag / n)
    quota = F.when(F.col(flag), quota_flag).otherwise(F.lit(size) - quota_flag)
    picked = ranked.where(F.col("rank0") < quota)
    order = draw_digest(F.concat(F.lit("order:"), F.col("item_id").cast("string")), seed)
    return picked.select("item_id", flag, order.alias("draw_order"))


def fixed_sample(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items of a stored id list."""
    return items.join(ids.select("item_id").distinct(), "item_id", "left_semi")


def annotation_draw(
    pairs: DataFrame, seed: int = 42, refusal: str = "recusa"
) -> DataFrame:
    """Draw order of (item, agent) pairs for human validation.

    Each stratum is permuted.  Outside the refusal stratum an item appears once per stratum (its
    earliest pair) and, over strata, only where its order is smaller (ties to the first name);
    orders are then numbered again without gaps.
    """
    key = F.concat_ws(":", F.col("item_id").cast("string"), F.col("agent_id").cast("string"))
    keyed = pairs.withColumn("digest", draw_digest(key, seed))
    substantive = keyed.where(F.col("stratum") != refusal)
    first = substantive.groupBy("stratum", "item_id").agg(
        F.min_by(F.struct("agent_id", "digest"), F.struct("digest", "agent_id")).alias("p")
    )
    once = first.select("stratum", "item_id", "p.agent_id", "p.digest")
    ordered = distributed_rank(once, ["stratum"], "digest", ["item_id"])
    kept = ordered.groupBy("item_id").agg(
        F.min_by(F.struct("stratum", "agent_id", "digest"), F.struct("rank0", "stratum")).alias("p")
    )
    kept = kept.select("p.stratum", "item_id", "p.agent_id", "p.digest")
    refusals = keyed.where(F.col("stratum") == refusal).select(
        "stratum", "item_id", "agent_id", "digest"
    )
    final = distributed_rank(
        kept.unionByName(refusals), ["stratum"], "digest", ["item_id", "agent_id"]
    )
    return final.select(
        "stratum", (F.col("rank0") + 1).alias("draw_order"), "item_id", "agent_id"
    )


def annotation_sequence(
    draw: DataFrame, wanted: dict[str, int], interleaved: bool = True
) -> DataFrame:
    """First pairs of each stratum, in the order in which they are shown."""
    spark = draw.sparkSession
    rows = [(s, n, i) for i, (s, n) in enumerate(wanted.items()) if n > 0]
    limits = values_table(spark, "stratum, wanted, stratum_pos", rows)
    kept = draw.join(F.broadcast(limits), "stratum").where("draw_order <= wanted")
    order = ["draw_order", "stratum"] if interleaved else ["stratum_pos", "draw_order"]
    return kept.orderBy(*order).select("stratum", "draw_order", "item_id", "agent_id")


def recover_fit_folds(
    folds: DataFrame, fit_sizes: DataFrame, permutation: Sequence[int]
) -> DataFrame:
    """(exec_k, n_val, fit_size, n_matches): the number of validation folds for which the stored
    fit size is met; a result is valid only where ``n_matches`` is 1."""
    spark = folds.sparkSession
    n_folds = len(permutation)
    rows = []
    for k in range(n_folds):
        rest = [f for f in permutation if f != k]
        for n_val in range(1, len(rest)):
            rows += [(k, n_val, f) for f in rest[n_val:]]
    candidates = values_table(spark, "exec_k, n_val, fold_k", rows)
    counts = folds.groupBy("fold_k").agg(F.count("*").alias("n"))
    sizes = (
        counts.join(F.broadcast(candidates), "fold_k")
        .groupBy("exec_k", "n_val")
        .agg(F.sum("n").alias("candidate_size"))
    )
    return (
        fit_sizes.join(sizes, "exec_k")
        .where("candidate_size = fit_size")
        .groupBy("exec_k", "fit_size")
        .agg(F.count("*").alias("n_matches"), F.min("n_val").alias("n_val"))
    )
