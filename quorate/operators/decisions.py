"""Winner selection, uncertainty, risk-controlled abstention and baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.operators import calibration as cal
from quorate.operators.selective import tau_star
from quorate.session import materialise


def mean_in_agent_order(value: Column) -> Column:
    """Mean over the agents of an item, added in agent order.

    Sums of doubles depend on their order; a fixed order keeps equal confidences on equal levels.
    The list has one entry per agent.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col("agent_id"), value.alias("v"))))
    return F.aggregate(listed, F.lit(0.0), lambda acc, x: acc + x["v"]) / F.size(listed)


def weighted_head(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Winner by score; ties to the larger weight, then to the larger agent id; eta = 1 - score.

    The label of the winner travels inside the maximum, so no second join is needed.
    """
    best = F.max_by(
        F.struct("agent_id", "z", "score"), F.struct("score", "weight", "agent_id")
    ).alias("w")
    return scored.groupBy(*keys).agg(best).select(
        *keys,
        F.col("w.agent_id").alias("agent_chosen"),
        F.col("w.z").alias("z_winner"),
        (F.lit(1.0) - F.col("w.score")).alias("eta"),
    )


def mean_confidence_head(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Winner by raw confidence, ties to the smaller agent id; eta = 1 - mean raw confidence."""
    best = F.min_by(F.struct("agent_id", "z"), F.struct(-F.col("conf"), F.col("agent_id")))
    return panel.groupBy(*keys).agg(best.alias("w"), mean_in_agent_order(F.col("conf")).alias("m")).select(
        *keys,
        F.col("w.agent_id").alias("agent_chosen"),
        F.col("w.z").alias("z_winner"),
        (F.lit(1.0) - F.col("m")).alias("eta"),
    )


def _with_roles(panel: DataFrame, roles: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Attach executions to rows by role; at most ``n_val + 1`` copies of a row."""
    picked = roles.where(F.col("role").isin(*wanted))
    return panel.join(F.broadcast(picked), "fold_k")


def score_panel(
    panel: DataFrame,
    roles: DataFrame,
    *,
    calibrated: bool = True,
    wanted: Sequence[str] = ("val", "test"),
) -> DataFrame:
    """Rows of the wanted roles with weight, calibrated confidence and score per execution.

    Weights (executions x agents) and the calibration map (executions x agents x distinct
    confidences) are compressed tables; the planner broadcasts them when they are small and
    shuffles when they are not.
    """
    weights = cal.adequacy_weights(panel, roles).select("exec_k", "agent_id", "alpha", "weight")
    rows = _with_roles(panel, roles, wanted).join(weights, ["exec_k", "agent_id"])
    if not calibrated:
        return rows.withColumn("score", F.col("weight") * F.col("conf"))
    blocks = cal.isotonic_fit(cal.isotonic_levels(panel, roles))
    curve = cal.calibration_map(blocks, panel.select("agent_id", "conf"))
    return rows.join(curve, ["exec_k", "agent_id", "conf"]).withColumn(
        "score", F.col("weight") * F.col("conf_calib")
    )


def abstain(test: DataFrame, thresholds: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row per test decision and c_min; abstains when eta is strictly above the threshold."""
    picked = thresholds.select(*on, "c_min", "tau_star")
    decided = test.join(picked, list(on))
    return decided.withColumn("abstained", F.col("eta") > F.col("tau_star")).withColumn(
        "z_system", F.when(~F.col("abstained"), F.col("z_winner"))
    )


def cross_fitted_decisions(
    panel: DataFrame, roles: DataFrame, c_mins: Sequence[float]
) -> tuple[DataFrame, DataFrame]:
    """Thresholds and test decisions of all executions and constraints in one plan."""
    scored = score_panel(panel, roles)
    heads = materialise(weighted_head(scored, ["exec_k", "role", "item_id", "has_doc_ref"]))
    val = heads.where("role = 'val'").select("exec_k", "eta", F.col("z_winner").alias("z"))
    thresholds = tau_star(val, ["exec_k"], c_mins)
    test = heads.where("role = 'test'").drop("role")
    return thresholds, abstain(test, thresholds, ["exec_k"])


def baseline_best_agent(panel: DataFrame, roles: DataFrame) -> DataFrame:
    """B1: the agent with the best fit adequacy answers everything (ties to the first agent)."""
    sums = cal.adequacy_weights(panel, roles)
    best = sums.groupBy("exec_k").agg(
        F.min_by("agent_id", F.struct(-F.col("alpha"), F.col("agent_id"))).alias("agent_id")
    )
    test = _with_roles(panel, roles, ["test"])
    return test.join(F.broadcast(best), ["exec_k", "agent_id"]).select(
        "exec_k",
        "item_id",
        "has_doc_ref",
        F.col("agent_id").alias("agent_chosen"),
        F.col("z").alias("z_winner"),
    )


def baseline_raw(panel: DataFrame, roles: DataFrame) -> DataFrame:
    """B2: weight x raw confidence, always answers."""
    scored = score_panel(panel, roles, calibrated=False, wanted=["test"])
    return weighted_head(scored, ["exec_k", "item_id", "has_doc_ref"])


def baseline_calibrated(panel: DataFrame, roles: DataFrame) -> DataFrame:
    """B3: weight x calibrated confidence, always answers."""
    scored = score_panel(panel, roles, wanted=["test"])
    return weighted_head(scored, ["exec_k", "item_id", "has_doc_ref"])


def baseline_solo(
    panel: DataFrame, roles: DataFrame, c_mins: Sequence[float]
) -> tuple[DataFrame, DataFrame]:
    """Each agent alone with its calibrated confidence and its own threshold per constraint."""
    blocks = cal.isotonic_fit(cal.isotonic_levels(panel, roles))
    curve = cal.calibration_map(blocks, panel.select("agent_id", "conf"))
    rows = _with_roles(panel, roles, ["val", "test"]).join(curve, ["exec_k", "agent_id", "conf"])
    rows = materialise(rows.withColumn("eta", F.lit(1.0) - F.col("conf_calib")))
    val = rows.where("role = 'val'").select("exec_k", "agent_id", "eta", "z")
    thresholds = tau_star(val, ["exec_k", "agent_id"], c_mins)
    test = rows.where("role = 'test'").select(
        "exec_k", "item_id", "has_doc_ref", "agent_id", F.col("z").alias("z_winner"), "eta"
    )
    return thresholds, abstain(test, thresholds, ["exec_k", "agent_id"])


def retrospective_best_agent(panel: DataFrame) -> DataFrame:
    """B0: the agent with the best mean over all labels, test ones too; an optimistic baseline."""
    means = panel.groupBy("agent_id").agg(F.avg("z").alias("adequacy"))
    return means.groupBy().agg(
        F.min_by(F.struct("agent_id", "adequacy"), F.struct(-F.col("adequacy"), F.col("agent_id"))).alias("b")
    ).select("b.agent_id", "b.adequacy")


def weight_stability(weights: DataFrame) -> DataFrame:
    """Mean, sample deviation and coefficient of variation of each agent's weight over folds."""
    return _stability(weights, ["agent_id"], "weight")


def threshold_stability(thresholds: DataFrame) -> DataFrame:
    """The same for the threshold per constraint, with the share of satisfied constraints."""
    base = _stability(thresholds, ["c_min"], "tau_star")
    share = thresholds.groupBy("c_min").agg(
        F.avg(F.col("constraint_satisfied").cast("double")).alias("share_satisfied")
    )
    return base.join(share, "c_min")


def _stability(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    out = df.groupBy(*group).agg(
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.count("*").alias("n_folds"),
    )
    cv = F.when(F.abs("mean") >= 1e-12, F.col("std") / F.abs("mean"))
    return out.withColumn("cv", cv)
