"""Error diversity between agents, winner's curse and selection under disagreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def error_concordance(panel: DataFrame) -> DataFrame:
    """P(agent j wrong | agent i wrong) for all ordered pairs, null when i makes no errors.

    The agents that err on an item form an array no longer than the number of agents; pairs are
    counted from distinct error patterns, whose number does not grow with the items.
    """
    agents = panel.select("agent_id").distinct()
    wrong = F.collect_list(F.when(F.col("z") == 0, F.col("agent_id")))
    patterns = (
        panel.groupBy("item_id")
        .agg(F.array_sort(wrong).alias("wrong"))
        .groupBy("wrong")
        .agg(F.count("*").alias("n"))
    )
    pairs = (
        patterns.withColumn("agent_i", F.explode("wrong"))
        .withColumn("agent_j", F.explode("wrong"))
        .groupBy("agent_i", "agent_j")
        .agg(F.sum("n").alias("both"))
    )
    singles = patterns.withColumn("agent_i", F.explode("wrong")).groupBy("agent_i").agg(
        F.sum("n").alias("errors")
    )
    everyone = F.array_sort(F.collect_set("agent_id"))
    named = agents.select(F.col("agent_id").alias("agent_i")).withColumn(
        "agent_j", F.explode(agents.agg(everyone).scalar())
    )
    return (
        named.join(singles, "agent_i", "left")
        .join(pairs, ["agent_i", "agent_j"], "left")
        .select(
            "agent_i",
            "agent_j",
            F.when(
                F.col("errors") > 0, F.coalesce("both", F.lit(0)) / F.col("errors")
            ).alias("p_j_given_i"),
        )
    )


def concordance_display(matrix: DataFrame, panel: DataFrame) -> DataFrame:
    """The same with each agent's marginal error rate on the diagonal."""
    rates = panel.groupBy(F.col("agent_id").alias("agent_i")).agg(
        F.avg((F.lit(1) - F.col("z")).cast("double")).alias("error_rate")
    )
    own = F.col("agent_i") == F.col("agent_j")
    return matrix.join(rates, "agent_i").select(
        "agent_i", "agent_j", F.when(own, F.col("error_rate")).otherwise(F.col("p_j_given_i")).alias("p_j_given_i")
    )


def all_wrong_ratio(panel: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Observed share of items on which every agent errs, the share expected if errors were
    independent (product of marginal rates) and their ratio."""
    group = list(group)
    rates = panel.groupBy(*group, "agent_id").agg(
        F.avg((F.lit(1) - F.col("z")).cast("double")).alias("rate")
    )
    ordered = F.array_sort(F.collect_list(F.struct("agent_id", "rate")))
    product = F.aggregate(ordered, F.lit(1.0), lambda acc, x: acc * x["rate"])
    expected = rates.groupBy(*group).agg(product.alias("expected"))
    items = panel.groupBy(*group, "item_id").agg(F.max("z").alias("best"))
    observed = items.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.avg((F.col("best") == 0).cast("double")).alias("observed"),
    )
    ratio = F.when(F.col("expected") > 0, F.col("observed") / F.col("expected")).alias("rho")
    if group:
        both = observed.join(expected, group)
    else:
        both = observed.withColumn("expected", expected.scalar())
    return both.select(*group, "n", "observed", "expected", ratio)


def conditional_rho(panel: DataFrame, stratum: str) -> DataFrame:
    """Observed all-wrong share against sum over strata of (n_s / N) x product of rates in s."""
    per = all_wrong_ratio(panel, [stratum])
    weighted = F.sum(F.col("n") * F.col("expected")) / F.sum("n")
    observed = F.sum(F.col("n") * F.col("observed")) / F.sum("n")
    return per.agg(
        F.sum("n").alias("n"), observed.alias("observed"), weighted.alias("expected_conditional")
    ).withColumn(
        "rho_conditional",
        F.when(F.col("expected_conditional") > 0, F.col("observed") / F.col("expected_conditional")),
    )


def selection_bias_rows(panel: DataFrame) -> DataFrame:
    """Per item: bias of the selected agent, sum of the others' biases, best and mean confidence."""
    bias = F.col("conf") - F.col("z")
    return (
        panel.groupBy("item_id")
        .agg(
            F.min_by(F.struct("conf", "z"), F.struct(-F.col("conf"), F.col("agent_id"))).alias("w"),
            F.sum(bias).alias("all_bias"),
            F.count("*").alias("k"),
            F.avg("conf").alias("mean_conf"),
        )
        .select(
            "item_id",
            (F.col("w.conf") - F.col("w.z")).alias("selected_bias"),
            (F.col("all_bias") - (F.col("w.conf") - F.col("w.z"))).alias("other_bias"),
            (F.col("k") - 1).alias("others"),
            F.col("w.conf").alias("max_conf"),
            "mean_conf",
            F.col("w.z").alias("z_selected"),
        )
    )


def winners_curse(panel: DataFrame) -> DataFrame:
    """Mean confidence minus label of the selected agent and of the others, and overestimates."""
    rows = selection_bias_rows(panel)
    selected = F.avg("selected_bias")
    others = F.sum("other_bias") / F.sum("others")
    return rows.agg(
        selected.alias("bias_selected"),
        others.alias("bias_not_selected"),
        (selected - others).alias("difference"),
        F.avg("max_conf").alias("mean_max_conf"),
        F.avg("mean_conf").alias("mean_mean_conf"),
        F.avg("z_selected").alias("z_selected"),
        (F.avg("max_conf") - F.avg("z_selected")).alias("overestimate_max"),
        (F.avg("mean_conf") - F.avg("z_selected")).alias("overestimate_mean"),
    )


def disagreement_items(panel: DataFrame) -> DataFrame:
    """Items on which the agents' labels differ."""
    return (
        panel.groupBy("item_id")
        .agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
        .where("lo <> hi")
        .select("item_id")
    )


def conditioned_selection(
    panel: DataFrame, policy_a: DataFrame, policy_b: DataFrame
) -> DataFrame:
    """Adequacy of two policies on the items where selection can matter, and the difference."""
    kept = disagreement_items(panel)
    both = (
        kept.join(policy_a.select("item_id", F.col("z_winner").alias("a")), "item_id")
        .join(policy_b.select("item_id", F.col("z_winner").alias("b")), "item_id")
    )
    return both.agg(
        F.count("*").alias("n"),
        F.avg("a").alias("rate_a"),
        F.avg("b").alias("rate_b"),
        F.avg(F.col("a") - F.col("b")).alias("difference"),
    )


def any_correct(panel: DataFrame) -> DataFrame:
    """Ceiling of perfect selection and the best single agent."""
    ceiling = panel.groupBy("item_id").agg(F.max("z").alias("best")).agg(F.avg("best"))
    single = panel.groupBy("agent_id").agg(F.avg("z").alias("rate")).agg(F.max("rate").alias("best_single"))
    return single.select(ceiling.scalar().alias("any_correct"), "best_single")
