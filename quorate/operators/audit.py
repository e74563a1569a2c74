"""Decision audit: utilities and precisions of a probabilistic answering policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions import constants as C
from quorate.operators.selective import response_probability


def contrast_metrics(kind: str) -> list[str]:
    """Ratio metrics that a contrast of ``variants`` or of stored ``points`` reports."""
    return [metric for metric, kinds in C.METRIC_CONTRASTS.items() if kind in kinds]


def metric_parts(p: Column) -> dict[str, tuple[Column, Column]]:
    """Numerator and denominator per row of every ratio metric, for response probability ``p``.

    Input columns: z_winner, textual_refusal, refusal_verdict (nullable), context_sufficiency.
    """
    zero, one = F.lit(0.0), F.lit(1.0)

    def flag(cond: Column) -> Column:
        return F.when(cond, one).otherwise(zero)

    z = F.col("z_winner").cast("double")
    err = one - z
    refusal = F.col("textual_refusal")
    substantive = flag(~refusal)
    answer = p * substantive
    no_answer = one - answer
    abst = one - p
    strict_refusal = flag(refusal & (F.col("refusal_verdict") == 2))
    broad_refusal = flag(refusal & F.col("refusal_verdict").isin(1, 2))
    context = F.col("context_sufficiency")
    strict, broad = flag(context == 0), flag(context <= 1)
    useful = answer * z
    strict_utility = abst * strict + p * (strict_refusal + substantive * z)
    broad_utility = abst * broad + p * (broad_refusal + substantive * z)
    return {
        "nominal_coverage": (p, one),
        "effective_coverage": (answer, one),
        "conventional_risk": (p * err, p),
        "substantive_risk": (answer * err, answer),
        "abstention_error_precision": (abst * err, abst),
        "abstention_error_recall": (abst * err, err),
        "false_abstention_rate": (abst * z, z),
        "abstention_context_precision_strict": (abst * strict, abst),
        "abstention_context_precision_broad": (abst * broad, abst),
        "nonresponse_context_precision_strict": (no_answer * strict, no_answer),
        "nonresponse_context_precision_broad": (no_answer * broad, no_answer),
        "abstention_given_insufficient": (abst * strict, strict),
        "abstention_given_partial": (abst * flag(context == 1), flag(context == 1)),
        "abstention_given_sufficient": (abst * flag(context == 2), flag(context == 2)),
        "conventional_utility": (useful, one),
        "effective_error_utility": (useful + no_answer * err, one),
        "context_utility_strict": (strict_utility, one),
        "context_utility_broad": (broad_utility, one),
        "context_penalty_strict": (strict_utility - useful, one),
        "context_penalty_broad": (broad_utility - useful, one),
    }


def decision_metrics(
    items: DataFrame, p: Column, group: Sequence[str], weight: Column | None = None
) -> DataFrame:
    """All metrics in one aggregation; ``weight`` multiplies rows (bootstrap replicas)."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    refusal = F.when(F.col("textual_refusal"), F.lit(1.0)).otherwise(F.lit(0.0))
    aggs = [
        F.sum(w).alias("n"),
        F.sum(w * refusal).alias("refusals_selected"),
        F.sum(w * p * refusal).alias("refusals_released"),
    ]
    for name, (num, den) in metric_parts(p).items():
        total = F.sum(w * den)
        aggs.append(F.when(total > 0, F.sum(w * num) / total).alias(name))
    return items.groupBy(*group).agg(*aggs)


def metrics_by_coverage(items: DataFrame, coverages: Sequence[float]) -> DataFrame:
    """One row per variant and target coverage; ties at the cut answer with a fraction.

    Rows are compressed to distinct (variant, score, labels) cells before coverages multiply them.
    """
    columns = ["z_winner", "textual_refusal", "refusal_verdict", "context_sufficiency"]
    cells = items.groupBy("variant", "score", *columns).agg(F.count("*").alias("_w"))
    probs = response_probability(items, ["variant"], coverages)
    joined = cells.join(probs, ["variant", "score"])
    return decision_metrics(
        joined, F.col("p_respond"), ["variant", "target_coverage"], F.col("_w")
    )


def operating_point(decided: DataFrame, group: Sequence[str]) -> DataFrame:
    """Metrics of stored decisions: the probability of answering is 1 unless it abstained."""
    p = F.when(F.col("abstained"), F.lit(0.0)).otherwise(F.lit(1.0))
    return decision_metrics(decided, p, group)


def attach_verdicts(decided: DataFrame, audit: DataFrame) -> DataFrame:
    """Join the auditor's verdict of the chosen agent; an unaudited refusal stays null."""
    verdicts = audit.select("item_id", F.col("agent_id").alias("agent_chosen"), "refusal_verdict")
    return decided.join(verdicts, ["item_id", "agent_chosen"], "left")


def unaudited_refusals(decided: DataFrame) -> DataFrame:
    """Gate: selected textual refusals that have no verdict."""
    return decided.where(F.col("textual_refusal") & F.col("refusal_verdict").isNull())


def action_sufficiency(long: DataFrame) -> DataFrame:
    """Action (abstained or answered) x sufficiency: pairs, share of the action, mean label."""
    cells = long.groupBy("action", "sufficiency").agg(
        F.count("*").alias("n"), F.avg("z").alias("adequacy")
    )
    totals = cells.groupBy("action").agg(F.sum("n").alias("_t"))
    return cells.join(totals, "action").select(
        "action", "sufficiency", "n", (F.col("n") / F.col("_t")).alias("row_share"), "adequacy"
    )


def justified_agreement(audit: DataFrame, sufficiency: DataFrame) -> DataFrame:
    """Share of audited refusals where "justified" agrees with "context insufficient"."""
    both = audit.join(sufficiency, "item_id").where("refusal_verdict >= 0 and verdict >= 0")
    same = (F.col("refusal_verdict") == 2) == (F.col("verdict") == 0)
    return both.agg(
        F.count("*").alias("n"),
        F.avg(same.cast("double")).alias("agreement"),
        F.avg((F.col("verdict") == 0).cast("double")).alias("insufficient_share"),
        F.avg(F.col("verdict").isin(0, 1).cast("double")).alias("not_sufficient_share"),
    )


def adequacy_by_sufficiency(
    decided: DataFrame, sufficiency: DataFrame, group: Sequence[str] = ()
) -> DataFrame:
    """System adequacy, mean eta and coverage per sufficiency level."""
    return (
        decided.join(sufficiency.where("verdict >= 0"), "item_id")
        .groupBy(*group, "verdict")
        .agg(
            F.count("*").alias("n"),
            F.avg("z_winner").alias("adequacy"),
            F.avg("eta").alias("mean_eta"),
            F.avg((~F.col("abstained")).cast("double")).alias("coverage"),
        )
    )
