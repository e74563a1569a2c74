"""Intervals on the summary tables that users read, all from one kind of stratified draw.

Every function returns (statistic, point, ci_lo, ci_hi, n_resamples, n_dropped) with the columns that name
its rows. A statistic without a value, or without one in more than half of the replicas, has null bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.operators.bootstrap import interval_table, percentile_interval, weighted_mean, weighted_ratio
from quorate.operators.diversity import disagreement_items, selection_bias_rows
from quorate.operators.replica_curves import auroc_replicas
from quorate.operators.selective import auroc
from quorate.session import materialise


def verdict_share_intervals(verdicts: DataFrame, stratum: str | None = None, replicas: int = 10_000) -> DataFrame:
    """Shares of sufficient, partial and insufficient contexts; failed verdicts stay in the denominator."""
    names = {"sufficient": 2, "partial": 1, "insufficient": 0}
    shares = {f"share_{k}": weighted_mean((F.col("verdict") == v).cast("double")) for k, v in names.items()}
    return interval_table(verdicts, stratum, ["verdict"], shares, replicas)


def variant_intervals(items: DataFrame, columns: Sequence[str], stratum: str, replicas: int = 10_000) -> DataFrame:
    """Mean of each agent's column and mean over the agents per item."""
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    means = {c: weighted_mean(F.col(c)) for c in columns} | {"mean_over_agents": weighted_mean(total / len(columns))}
    return interval_table(items, stratum, list(columns), means, replicas)


def arm_intervals(items: DataFrame, pairs: Sequence[tuple[str, str]], stratum: str | None, replicas: int = 10_000) -> DataFrame:
    """Differences a - b between arms of the same items, resampled together."""
    arms = sorted({a for pair in pairs for a in pair})
    deltas = {f"{a} - {b}": weighted_mean(F.col(a) - F.col(b)) for a, b in pairs}
    return interval_table(items, stratum, arms, deltas, replicas)


def selection_intervals(
    panel: DataFrame, policy_a: DataFrame, policy_b: DataFrame, stratum: str, replicas: int = 10_000
) -> DataFrame:
    """Rates of two policies and their difference on items whose agents disagree; ``policy_a`` has the stratum."""
    both = (
        disagreement_items(panel)
        .join(policy_a.select("item_id", stratum, F.col("z_winner").alias("a")), "item_id")
        .join(policy_b.select("item_id", F.col("z_winner").alias("b")), "item_id")
    )
    rates = {"rate_a": weighted_mean(F.col("a")), "rate_b": weighted_mean(F.col("b")), "difference": weighted_mean(F.col("a") - F.col("b"))}
    return interval_table(both, stratum, ["a", "b"], rates, replicas)


def bias_intervals(panel: DataFrame, replicas: int = 10_000) -> DataFrame:
    """Confidence minus label of the selected agent, of the others, and their difference; items are resampled."""
    rows = selection_bias_rows(panel)
    selected = weighted_mean(F.col("selected_bias"))
    others = weighted_ratio(F.col("other_bias"), F.col("others"))
    stats = {"bias_selected": selected, "bias_not_selected": others, "difference": selected - others}
    return interval_table(rows, None, ["selected_bias", "other_bias", "others"], stats, replicas)


def decision_statistics() -> dict[str, Column]:
    """Statistics of decided items (``abst``, ``z``) over the weight ``w``."""
    abst, error = F.col("abst"), 1 - F.col("z")
    precision, base = weighted_ratio(abst * error, abst), weighted_ratio(error, F.lit(1))
    return {
        "coverage": weighted_ratio(1 - abst, F.lit(1)),
        "risk_selective": weighted_ratio((1 - abst) * error, 1 - abst),
        "adequacy_useful": weighted_ratio((1 - abst) * F.col("z"), F.lit(1)),
        "precision_abstention": precision,
        "base_rate_inadequacy": base,
        "lift_pp": (precision - base) * 100,
        "n_abstentions": F.sum(F.col("w") * abst).cast("double"),
    }


def system_intervals(decided: DataFrame, system: str, stratum: str, replicas: int = 10_000) -> DataFrame:
    """(system, statistic, ...): the decision summary of every system of a long table, one draw for all.

    A system is a stratum of its own, so each keeps its size; a system without abstentions has a null
    abstention precision and lift. With a column ``eta`` there is an AUROC too, of eta for an error; a system
    with a null eta has a null AUROC.
    """
    cells = decided.select(
        system, F.concat_ws("|", F.col(system), F.col(stratum).cast("string")).alias("_g"), "abst", "z"
    )
    from quorate.operators.bootstrap import compress, replica_rows, replica_weights

    cells = compress(cells, "_g", [system, "abst", "z"])
    stats = decision_statistics()
    aggs = [c.alias(k) for k, c in stats.items()]
    points = cells.withColumn("w", F.col("_n")).groupBy(system).agg(*aggs).unpivot([system], list(stats), "statistic", "point")
    rows = replica_rows(replica_weights(cells, [system, "abst", "z"], replicas))
    values = rows.groupBy(system, "replica").agg(*aggs).unpivot([system, "replica"], list(stats), "statistic", "value")
    # As many values as replicas meet in a group.
    bounds = values.groupBy(system, "statistic").agg(
        F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("q"),
        F.count("*").alias("n_resamples"),
        F.count_if(F.col("value").isNull()).alias("n_dropped"),
    )
    kept = F.col("n_dropped") * 2 <= F.col("n_resamples")
    bounds = bounds.select(system, "statistic", F.when(kept, F.col("q")[0]).alias("ci_lo"), F.when(kept, F.col("q")[1]).alias("ci_hi"), "n_resamples", "n_dropped")
    out = points.join(bounds, [system, "statistic"], "left")
    return out.unionByName(_auroc_intervals(decided, system, stratum, replicas)) if "eta" in decided.columns else out


def _auroc_intervals(decided: DataFrame, system: str, stratum: str, replicas: int) -> DataFrame:
    rows = materialise(decided.select(system, stratum, "eta", (1 - F.col("z")).cast("int").alias("error")))
    points = auroc(rows, [system], "eta", F.col("error")).select(system, F.col("auroc").alias("point"))
    points = rows.select(system).distinct().join(points, system, "left").withColumn("statistic", F.lit("auroc"))
    bounds = None
    # Systems are a short list; each has a curve of its own.
    complete = rows.groupBy(system).agg(F.count_if(F.col("eta").isNull()).alias("n")).where("n = 0")
    for name in sorted(r[system] for r in complete.collect()):
        values = auroc_replicas(rows.where(F.col(system) == name), stratum, "eta", "error", replicas)
        one = percentile_interval(values, ["auroc"]).withColumn(system, F.lit(name))
        bounds = one if bounds is None else bounds.unionByName(one)
    columns = (system, "statistic", "point", "ci_lo", "ci_hi", "n_resamples", "n_dropped")
    if bounds is None:
        nothing = F.lit(None).cast("double")
        return points.select(system, "statistic", "point", nothing.alias("ci_lo"), nothing.alias("ci_hi"), F.lit(replicas).cast("bigint").alias("n_resamples"), F.lit(replicas).cast("bigint").alias("n_dropped"))
    joined = points.join(bounds, [system, "statistic"], "left")
    # A system without eta drew nothing that has a value.
    return joined.withColumns({c: F.coalesce(c, F.lit(replicas).cast("bigint")) for c in ("n_resamples", "n_dropped")}).select(*columns)
