"""Cross-fitted adequacy weights and isotonic calibration from fold-additive sums.

Rows are aggregated once per (fold, agent, value); the statistics of "every fold that is fit data
in execution k" are then sums over the small fold-role table, so data is never copied K times.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from quorate.operators.prefix import unit_bucket

# Confidence buckets by which calibrator spans and wanted confidences meet.
MAP_BUCKETS = 256


def _fit_roles(roles: DataFrame) -> DataFrame:
    return F.broadcast(roles.where("role = 'fit'").select("exec_k", "fold_k"))


def adequacy_sums(panel: DataFrame, roles: DataFrame) -> DataFrame:
    """(exec_k, agent_id, n, s): rows and adequate answers over the fit folds."""
    per_fold = panel.groupBy("fold_k", "agent_id").agg(
        F.count("*").alias("n"), F.sum("z").cast("bigint").alias("s")
    )
    return (
        per_fold.join(_fit_roles(roles), "fold_k")
        .groupBy("exec_k", "agent_id")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    )


def normalise_weights(alphas: DataFrame) -> DataFrame:
    """Share of each agent's alpha in its execution; equal shares when all are zero.

    The total is folded in agent order so that it does not depend on shuffle order.
    """
    whole = W.partitionBy("exec_k")
    ordered = F.array_sort(F.collect_list(F.struct("agent_id", "alpha")).over(whole))
    total = F.aggregate(ordered, F.lit(0.0), lambda acc, x: acc + x["alpha"])
    count = F.size(ordered)
    return (
        alphas.withColumn("_total", total)
        .withColumn("_count", count)
        .withColumn(
            "weight",
            F.when(F.col("_total") == 0, F.lit(1.0) / F.col("_count")).otherwise(
                F.col("alpha") / F.col("_total")
            ),
        )
        .drop("_total", "_count")
    )


def adequacy_weights(panel: DataFrame, roles: DataFrame) -> DataFrame:
    """(exec_k, agent_id, alpha, weight, fit_size); alpha is the mean label over the fit folds."""
    sums = adequacy_sums(panel, roles)
    return normalise_weights(
        sums.select(
            "exec_k", "agent_id", (F.col("s") / F.col("n")).alias("alpha"), F.col("n").alias("fit_size")
        )
    )


def weights_without_refusals(panel: DataFrame, roles: DataFrame) -> DataFrame:
    """As ``adequacy_weights`` over answers that are not textual refusals."""
    return adequacy_weights(panel.where(~F.col("refused")), roles)


def informativeness_weights(panel: DataFrame, roles: DataFrame) -> DataFrame:
    """Weights from max(AUROC - 0.5, 0) of raw confidence against the label, per execution."""
    from quorate.operators.selective import auroc_from_levels

    per_fold = panel.groupBy("fold_k", "agent_id", "conf").agg(
        F.count("*").alias("n"), F.sum("z").cast("bigint").alias("pos")
    )
    per_exec = (
        per_fold.join(_fit_roles(roles), "fold_k")
        .groupBy("exec_k", "agent_id", "conf")
        .agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    )
    area = auroc_from_levels(per_exec, ["exec_k", "agent_id"], "conf")
    alphas = area.select(
        "exec_k",
        "agent_id",
        F.greatest(F.col("auroc") - F.lit(0.5), F.lit(0.0)).alias("alpha"),
        F.col("n").alias("fit_size"),
    )
    return normalise_weights(alphas)


def isotonic_levels(panel: DataFrame, roles: DataFrame) -> DataFrame:
    """(exec_k, agent_id, x, n, s): distinct confidences of the fit folds with label sums."""
    per_fold = panel.groupBy("fold_k", "agent_id", F.col("conf").alias("x")).agg(
        F.count("*").alias("n"), F.sum("z").cast("bigint").alias("s")
    )
    return (
        per_fold.join(_fit_roles(roles), "fold_k")
        .groupBy("exec_k", "agent_id", "x")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    )


def _pool_violators(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge neighbouring blocks of rows sorted by (execution, agent, bucket, x) until block means
    increase; only the open blocks of one group are held.  Means are compared by integer cross
    products, so the result does not depend on rounding."""
    key, stack = None, []

    def flush(into: list) -> None:
        into.extend((key[0], key[1], *block) for block in stack)

    for pdf in batches:
        done: list = []
        for e, a, b, lo, hi, n, s in zip(
            pdf.exec_k, pdf.agent_id, pdf["_b"], pdf.x_lo, pdf.x_hi, pdf.n, pdf.s
        ):
            if (e, a, b) != key:
                if key is not None:
                    flush(done)
                key, stack = (e, a, b), []
            block = (lo, hi, int(n), int(s))
            while stack and stack[-1][3] * block[2] >= block[3] * stack[-1][2]:
                prev = stack.pop()
                block = (prev[0], block[1], prev[2] + block[2], prev[3] + block[3])
            stack.append(block)
        yield pd.DataFrame(done, columns=["exec_k", "agent_id", "x_lo", "x_hi", "n", "s"])
    done = []
    if key is not None:
        flush(done)
    yield pd.DataFrame(done, columns=["exec_k", "agent_id", "x_lo", "x_hi", "n", "s"])


def isotonic_fit(levels: DataFrame, buckets: int = 1024) -> DataFrame:
    """(exec_k, agent_id, x_lo, x_hi, y): blocks of the increasing fit, clipped to [0, 1].

    Pooling neighbours may be done in any order, so violators are pooled inside narrow confidence
    buckets first, in parallel, and the last merge per (execution, agent) streams over the few
    surviving blocks.
    """
    group = ["exec_k", "agent_id"]
    types = dict(levels.dtypes)
    schema = (
        f"exec_k {types['exec_k']}, agent_id {types['agent_id']}, "
        "x_lo double, x_hi double, n bigint, s bigint"
    )
    blocks = levels.select(
        *group, F.col("x").alias("x_lo"), F.col("x").alias("x_hi"), "n", "s"
    )
    for width in (buckets, 1):
        keyed = blocks.withColumn("_b", unit_bucket(F.col("x_lo"), width))
        ordered = keyed.repartition(*group, "_b").sortWithinPartitions(*group, "_b", "x_lo")
        blocks = ordered.mapInPandas(_pool_violators, schema)
    y = F.least(F.greatest(F.col("s") / F.col("n"), F.lit(0.0)), F.lit(1.0))
    return blocks.select(*group, "x_lo", "x_hi", y.alias("y"))


def isotonic_diagnostics(blocks: DataFrame) -> DataFrame:
    """Range of x and number of breakpoints of each calibrator."""
    points = F.when(F.col("x_lo") == F.col("x_hi"), 1).otherwise(2)
    return blocks.groupBy("exec_k", "agent_id").agg(
        F.min("x_lo").alias("x_min"),
        F.max("x_hi").alias("x_max"),
        F.sum(points).cast("bigint").alias("n_breakpoints"),
    )


def calibration_map(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(exec_k, agent_id, conf, conf_calib) for each distinct confidence asked for.

    Inside a block the block value holds; between two blocks the value is interpolated on a
    straight line; outside the first and last block it is clipped.  ``wanted`` holds distinct
    (agent_id, conf) pairs.  Both sides are compressed tables and meet by equality on the confidence
    bucket: a block is listed in each bucket that its span touches, a confidence in its own.
    """
    after = W.partitionBy("exec_k", "agent_id").orderBy("x_lo")
    spans = blocks.select(
        "exec_k",
        "agent_id",
        "x_lo",
        "x_hi",
        "y",
        F.lead("x_lo").over(after).alias("next_x"),
        F.lead("y").over(after).alias("next_y"),
        F.row_number().over(after).alias("_pos"),
    )
    conf = F.col("conf")
    from_bucket = F.when(F.col("_pos") == 1, 0).otherwise(unit_bucket(F.col("x_lo"), MAP_BUCKETS))
    to_bucket = F.when(F.col("next_x").isNull(), MAP_BUCKETS - 1).otherwise(
        unit_bucket(F.col("next_x"), MAP_BUCKETS)
    )
    listed = spans.withColumn("_b", F.explode(F.sequence(from_bucket, to_bucket)))
    asked = wanted.select("agent_id", "conf").distinct().withColumn(
        "_b", unit_bucket(conf, MAP_BUCKETS)
    )
    inside = (conf >= F.col("x_lo")) | (F.col("_pos") == 1)
    below_next = F.col("next_x").isNull() | (conf < F.col("next_x"))
    hit = listed.join(asked, ["agent_id", "_b"]).where(inside & below_next)
    slope = (F.col("next_y") - F.col("y")) / (F.col("next_x") - F.col("x_hi"))
    value = F.when(
        (conf <= F.col("x_hi")) | F.col("next_x").isNull(), F.col("y")
    ).otherwise(F.col("y") + slope * (conf - F.col("x_hi")))
    return hit.select("exec_k", "agent_id", "conf", value.alias("conf_calib"))
