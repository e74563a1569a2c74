"""Paired comparison of pipelines: quality, cost and decomposition of differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from quorate.operators.bootstrap import compress, replica_rows, replica_weights


def paired_metrics(
    old: DataFrame, new: DataFrame, metrics: Sequence[str], flags: Sequence[str]
) -> DataFrame:
    """One row per item with every metric of both sides (``<m>_old``, ``<m>_new``)."""
    a = old.select("item_id", *flags, *[F.col(m).cast("double").alias(f"{m}_old") for m in metrics])
    b = new.select("item_id", *[F.col(m).cast("double").alias(f"{m}_new") for m in metrics])
    return a.join(b, "item_id")


def long_pairs(paired: DataFrame, metrics: Sequence[str], stratum: str) -> DataFrame:
    """(item_id, stratum, metric, old, new); rows where a side is undefined are left out."""
    listed = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), F.col(f"{m}_old").alias("old"), F.col(f"{m}_new").alias("new")
            )
            for m in metrics
        ]
    )
    rows = paired.select("item_id", stratum, F.inline(listed))
    return rows.where("old is not null and new is not null")


def comparison_means(long: DataFrame) -> DataFrame:
    """Items, means of both sides and mean difference per metric."""
    return long.groupBy("metric").agg(
        F.count("*").alias("n"),
        F.avg("old").alias("old"),
        F.avg("new").alias("new"),
        F.avg(F.col("new") - F.col("old")).alias("delta"),
    )


def comparison_intervals(
    long: DataFrame, stratum: str, replicas: int = 10_000, seed: int = 42
) -> DataFrame:
    """Percentile interval of the mean difference of every metric in one job.

    A resampling stratum is a (metric, stratum) pair; cells are distinct differences.
    """
    keyed = long.select(
        F.concat_ws("|", "metric", F.col(stratum).cast("string")).alias("_g"),
        "metric",
        (F.col("new") - F.col("old")).alias("d"),
    )
    cells = compress(keyed, "_g", ["metric", "d"])
    rows = replica_rows(replica_weights(cells, ["metric", "d"], replicas, seed))
    values = rows.groupBy("metric", "replica").agg(
        (F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("delta")
    )
    q = F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975)))
    return values.groupBy("metric").agg(q.alias("q")).select(
        "metric", F.col("q")[0].alias("ci_lo"), F.col("q")[1].alias("ci_hi")
    )


def compare(long: DataFrame, stratum: str, replicas: int = 10_000) -> DataFrame:
    return comparison_means(long).join(comparison_intervals(long, stratum, replicas), "metric")


def cost_by_stage(calls: DataFrame) -> DataFrame:
    """Calls and cost per stage and side, with the side's total beside them."""
    stage = calls.groupBy("stage", "side").agg(
        F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd")
    )
    total = F.sum("cost_usd").over(W.partitionBy("side"))
    return stage.withColumn("side_total", total)


def decomposition(paired: DataFrame, stratum: str, a: str, b: str) -> DataFrame:
    """Contribution of each stratum, (n_s / N) (b_s - a_s); contributions add up to the difference."""
    per = paired.groupBy(stratum).agg(
        F.count("*").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b")
    )
    total = per.agg(F.sum("n")).scalar()
    return per.withColumn(
        "contribution", F.col("n") / total * (F.col("mean_b") - F.col("mean_a"))
    )


def arm_contrasts(items: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """n, means and difference a - b for each pair of arm columns, in one pass."""
    listed = F.array(
        *[
            F.struct(
                F.lit(a).alias("a"),
                F.lit(b).alias("b"),
                F.col(a).cast("double").alias("va"),
                F.col(b).cast("double").alias("vb"),
            )
            for a, b in pairs
        ]
    )
    rows = items.select(F.inline(listed))
    return rows.groupBy("a", "b").agg(
        F.count("*").alias("n"),
        F.avg("va").alias("mean_a"),
        F.avg("vb").alias("mean_b"),
        F.avg(F.col("va") - F.col("vb")).alias("delta"),
    )


def verdict_shares(verdicts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Counts of verdicts 2, 1, 0 and -1 and the shares of the first three among all rows."""
    v = F.col("verdict")
    n = F.count("*")
    return verdicts.groupBy(*group).agg(
        n.alias("n"),
        F.count_if(v == 2).alias("n_sufficient"),
        F.count_if(v == 1).alias("n_partial"),
        F.count_if(v == 0).alias("n_insufficient"),
        F.count_if(v == -1).alias("n_failed"),
        (F.count_if(v == 2) / n).alias("share_sufficient"),
        (F.count_if(v == 1) / n).alias("share_partial"),
        (F.count_if(v == 0) / n).alias("share_insufficient"),
    )


def rung_verdicts(rungs: DataFrame) -> DataFrame:
    """A rung is confirmed when its lower bound exceeds the point value of the rung before it.

    The input has one row per rung (``pos``, ``rung``, ``point``, ``ci_lo``).
    """
    before = F.lag("point").over(W.orderBy("pos"))
    return rungs.withColumn("previous", before).withColumn(
        "verdict",
        F.when(F.col("previous").isNull(), "base")
        .when(F.col("ci_lo") > F.col("previous"), "confirmed")
        .otherwise("not confirmed"),
    )
