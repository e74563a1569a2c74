"""Architecture variants built from one scored panel, their table and contrasts.

Ties in every variant go to the first agent in sorted order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.operators import calibration as cal
from quorate.operators.decisions import mean_in_agent_order
from quorate.operators.prefix import running_totals
from quorate.operators.replica_curves import area_differences
from quorate.operators.selective import aurc, aurc_term, auroc, risk_at_coverage
from quorate.session import materialise


def scored_test_panel(panel: DataFrame, roles: DataFrame) -> DataFrame:
    """Test rows with the three weightings and the calibrated confidence of their execution."""
    test = panel.join(F.broadcast(roles.where("role = 'test'").select("exec_k", "fold_k")), "fold_k")
    w = cal.adequacy_weights(panel, roles).select("exec_k", "agent_id", F.col("weight").alias("w_alpha"))
    w2 = cal.weights_without_refusals(panel, roles).select(
        "exec_k", "agent_id", F.col("weight").alias("w_no_refusal")
    )
    w3 = cal.informativeness_weights(panel, roles).select(
        "exec_k", "agent_id", F.col("weight").alias("w_informative")
    )
    weights = w.join(w2, ["exec_k", "agent_id"]).join(w3, ["exec_k", "agent_id"])
    blocks = cal.isotonic_fit(cal.isotonic_levels(panel, roles))
    curve = cal.calibration_map(blocks, panel.select("agent_id", "conf"))
    return test.join(weights, ["exec_k", "agent_id"]).join(curve, ["exec_k", "agent_id", "conf"])


def _first_best(score: Column) -> Column:
    """Struct of the agent with the largest score; the smaller id wins a tie."""
    return F.min_by(F.struct("agent_id", "z", "refused"), F.struct(-score, F.col("agent_id")))


def variants(
    scored: DataFrame, best_agent: DataFrame | None = None, names: Sequence[str] | None = None
) -> DataFrame:
    """(item_id, fold_k, has_doc_ref, variant, agent_chosen, z, refused, score) for all variants.

    One aggregation per item computes every variant; an explode of the short array makes rows.
    """
    calib, raw = F.col("conf_calib"), F.col("conf")
    products = {
        "A0": F.col("w_alpha") * calib,
        "A2": F.col("w_no_refusal") * calib,
        "A3": F.col("w_informative") * calib,
    }
    specs: dict[str, tuple[Column, Column]] = {
        name: (_first_best(score), F.max(score)) for name, score in products.items()
    }
    by_calib, by_raw = _first_best(calib), _first_best(raw)
    specs["A1"] = (by_calib, F.max(calib))
    specs["A4"] = (by_calib, mean_in_agent_order(calib))
    specs["A5"] = (by_raw, mean_in_agent_order(raw))
    specs["A7"] = (by_raw, F.max(raw))
    if best_agent is not None:
        chosen = best_agent.select("agent_id").scalar()
        is_best = F.col("agent_id") == chosen
        specs["B0"] = (
            F.max(F.when(is_best, F.struct("agent_id", "z", "refused"))),
            F.max(F.when(is_best, raw)),
        )
    wanted = list(names or specs)
    packed = F.array(
        *[
            F.struct(F.lit(n).alias("variant"), specs[n][0].alias("w"), specs[n][1].alias("score"))
            for n in wanted
        ]
    )
    rows = scored.groupBy("item_id", "fold_k", "has_doc_ref").agg(packed.alias("v"))
    return rows.select("item_id", "fold_k", "has_doc_ref", F.explode("v").alias("v")).select(
        "item_id",
        "fold_k",
        "has_doc_ref",
        "v.variant",
        F.col("v.w.agent_id").alias("agent_chosen"),
        F.col("v.w.z").alias("z"),
        F.col("v.w.refused").alias("refused"),
        "v.score",
    )


def logistic_features(scored: DataFrame) -> DataFrame:
    """Per item: mean, min, max and population deviation of calibrated confidence, refusals."""
    c = F.col("conf_calib")
    return scored.groupBy("item_id", "fold_k", "has_doc_ref").agg(
        mean_in_agent_order(c).alias("f_mean"),
        F.min(c).alias("f_min"),
        F.max(c).alias("f_max"),
        F.stddev_pop(c).alias("f_std"),
        F.sum(F.col("refused").cast("double")).alias("f_refusals"),
        _first_best(c).alias("w"),
    ).select("*", F.col("w.agent_id").alias("agent_chosen"), F.col("w.z").alias("z"))


FEATURES = ("f_mean", "f_min", "f_max", "f_std", "f_refusals")
# Steps allowed, and the largest slope of the penalised loss at which a model counts as fitted.
MAX_STEPS = 1_000
FLAT = 1e-9


def _products(columns: Sequence[Column]) -> list[Column]:
    return [columns[i] * columns[j] for i in range(len(columns)) for j in range(i + 1)]


def logistic_models(rows: DataFrame, roles: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """(exec_k, n_fit, intercept, names): penalised logistic models of z, one per execution, on its fit folds.

    Inverse strength of the penalty is 1, the intercept has none. All models take each Newton step together:
    one aggregation gives their losses, slopes and curvatures; the driver solves systems of six numbers
    per execution. A step that does not lower the loss is halved. An execution without fit rows keeps
    zeros, which is a probability of one half.
    """
    spark, width = rows.sparkSession, len(names) + 1
    fit = F.broadcast(roles.where("role = 'fit'").select("exec_k", "fold_k"))
    columns = ["exec_k", *[f"b{i}" for i in range(width)]]
    execs = sorted(r["exec_k"] for r in roles.select("exec_k").distinct().collect())
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    beta = {k: np.zeros(width) for k in execs}
    held = {k: (np.inf, np.zeros(width), np.zeros(width)) for k in execs}
    sizes = dict.fromkeys(execs, 0)
    penalty = np.ones(width)
    penalty[0] = 0.0
    for _ in range(MAX_STEPS):
        models = F.broadcast(spark.createDataFrame([(k, *beta[k].tolist()) for k in execs], ", ".join(["exec_k int", *[f"b{i} double" for i in range(width)]])).select(*columns))
        margin = sum((F.col(f"b{i}") * x[i] for i in range(1, width)), F.col("b0"))
        # The logarithm of 1 + exp(m) without overflow.
        loss = F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin))) - F.col("z") * margin
        p = 1 / (1 + F.exp(-margin))
        sums = [F.sum(loss).alias("loss"), *[F.sum((p - F.col("z")) * c).alias(f"g{i}") for i, c in enumerate(x)]]
        sums += [F.sum(p * (1 - p) * c).alias(f"h{i}") for i, c in enumerate(_products(x))]
        found = rows.join(fit, "fold_k").join(models, "exec_k").groupBy("exec_k").agg(F.count("*").alias("n"), *sums).collect()
        flat = True
        for r in found:
            k = r["exec_k"]
            sizes[k] = r["n"]
            slope = np.array([r[f"g{i}"] for i in range(width)]) + penalty * beta[k]
            curve = np.zeros((width, width))
            curve[np.tril_indices(width)] = [r[f"h{i}"] for i in range(width * (width + 1) // 2)]
            curve = np.tril(curve) + np.tril(curve, -1).T + np.diag(penalty)
            loss_k = r["loss"] + 0.5 * float(penalty @ beta[k] ** 2)
            if np.abs(slope).max() <= FLAT * max(1, r["n"]):
                continue
            last, start, step = held[k]
            if loss_k > last + 1e-12 * abs(last):
                # Too far: half the step from where it began.
                flat, step = False, step / 2
                if np.abs(step).max() < 1e-14:
                    flat = True
                    continue
            else:
                flat, last, start = False, loss_k, beta[k]
                step = -np.linalg.lstsq(curve, slope, rcond=None)[0]
            held[k] = (last, start, step)
            beta[k] = start + step
        if flat:
            break
    schema = ", ".join(["exec_k int", "n_fit bigint", "intercept double", *[f"{c} double" for c in names]])
    return spark.createDataFrame([(k, sizes[k], *beta[k].tolist()) for k in execs], schema)


def logistic_variant(scored: DataFrame, roles: DataFrame) -> DataFrame:
    """A6: score of a logistic model fit on the fit folds of each execution, applied to its test fold."""
    rows = materialise(logistic_features(scored))
    models = logistic_models(rows, roles)
    test = roles.where("role = 'test'").select("exec_k", "fold_k")
    named = models.select("exec_k", "intercept", *[F.col(c).alias(f"b_{c}") for c in FEATURES]).join(F.broadcast(test), "exec_k")
    margin = sum((F.col(f"b_{c}") * F.col(c) for c in FEATURES), F.col("intercept"))
    return rows.join(F.broadcast(named), "fold_k").select(
        "item_id", "fold_k", "has_doc_ref", F.lit("A6").alias("variant"), "agent_chosen", "z",
        F.col("w.refused").alias("refused"), (1 / (1 + F.exp(-margin))).alias("score"),
    )


def ablation_table(rows: DataFrame, base: str = "A0") -> DataFrame:
    """Accuracy, AUROC, AURC, risk at coverage 0.3 and 0.5 and difference of AURC to the base."""
    accuracy = rows.groupBy("variant").agg(F.avg("z").alias("accuracy"))
    area = auroc(rows, ["variant"], "score", F.col("z")).select("variant", "auroc")
    curve = aurc(rows, ["variant"]).select("variant", "n_items", "n_tied", "aurc")
    risk = risk_at_coverage(rows, ["variant"], [0.3, 0.5])
    risks = risk.groupBy("variant").agg(
        F.max(F.when(F.col("coverage") == 0.3, F.col("risk"))).alias("risk_30"),
        F.max(F.when(F.col("coverage") == 0.5, F.col("risk"))).alias("risk_50"),
    )
    table = accuracy.join(area, "variant").join(curve, "variant").join(risks, "variant")
    base_area = curve.where(F.col("variant") == base).select("aurc").scalar()
    return table.withColumn("delta_aurc", F.col("aurc") - base_area)


def pair_matrix(rows: DataFrame) -> DataFrame:
    """Difference of AURC for every ordered pair of variants (a short table), with the better one."""
    curve = aurc(rows, ["variant"]).select("variant", "aurc")
    listed = F.array_sort(F.collect_list(F.struct("variant", "aurc")))
    pairs = curve.withColumn("o", F.explode(curve.agg(listed).scalar()))
    delta = F.col("aurc") - F.col("o.aurc")
    return pairs.where(F.col("variant") != F.col("o.variant")).select(
        F.col("variant").alias("a"),
        F.col("o.variant").alias("b"),
        delta.alias("delta_aurc"),
        F.when(delta < 0, F.col("variant")).when(delta > 0, F.col("o.variant")).otherwise("tie").alias("better"),
    )


def interaction(rows: DataFrame) -> DataFrame:
    """(A5 - A7) - (A4 - A1) in AURC: does mean aggregation help raw confidence more?"""
    curve = aurc(rows.where(F.col("variant").isin("A1", "A4", "A5", "A7")), ["variant"])
    value = {v: F.max(F.when(F.col("variant") == v, F.col("aurc"))) for v in ("A1", "A4", "A5", "A7")}
    raw, calibrated = value["A5"] - value["A7"], value["A4"] - value["A1"]
    return curve.agg(
        raw.alias("raw_effect"),
        calibrated.alias("calibrated_effect"),
        (raw - calibrated).alias("interaction"),
    )


def _terms(rows: DataFrame, base: str) -> dict[str, dict[str, int]]:
    """Each variant's area less the base's; variants are a short list."""
    names = sorted(r["variant"] for r in rows.select("variant").distinct().collect())
    return {v: {v: 1, base: -1} for v in names if v != base}


def area_bounds(rows: DataFrame, terms: dict[str, dict[str, int]], stratum: str, replicas: int) -> DataFrame:
    """(statistic, delta_aurc, ci_lo, ci_hi, n_resamples, n_dropped) of combinations of the variants' areas."""
    curve = aurc(rows, ["variant"]).select("variant", "aurc")
    points = curve.agg(*[_combined(factors, F.col("variant"), F.col("aurc")).alias(name) for name, factors in terms.items()])
    points = points.unpivot([], list(terms), "statistic", "delta_aurc")
    return points.join(area_differences(rows, terms, stratum, replicas), "statistic")


def _combined(factors: dict[str, int], variant: Column, value: Column) -> Column:
    out = F.lit(0.0)
    for v, f in factors.items():
        out = out + F.lit(float(f)) * F.max(F.when(variant == v, value))
    return out


def ablation_intervals(rows: DataFrame, base: str = "A0", stratum: str = "has_doc_ref", replicas: int = 10_000) -> DataFrame:
    """Difference of each variant's AURC to the base with its interval; significant if the interval leaves 0 out."""
    found = area_bounds(rows, _terms(rows, base), stratum, replicas).withColumnRenamed("statistic", "variant")
    return found.withColumn("significant", (F.col("ci_hi") < 0) | (F.col("ci_lo") > 0))


def pair_intervals(rows: DataFrame, stratum: str = "has_doc_ref", replicas: int = 10_000) -> DataFrame:
    """Every ordered pair of variants with the interval of its AURC difference; the winner, if the interval leaves 0 out."""
    names = sorted(r["variant"] for r in rows.select("variant").distinct().collect())
    terms = {f"{a}|{b}": {a: 1, b: -1} for a in names for b in names if a < b}
    found = area_bounds(rows, terms, stratum, replicas).withColumn("p", F.split("statistic", "\\|"))
    there = F.struct(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), F.col("delta_aurc"), F.col("ci_lo"), F.col("ci_hi"))
    back = F.struct(F.col("p")[1].alias("a"), F.col("p")[0].alias("b"), (-F.col("delta_aurc")).alias("delta_aurc"), (-F.col("ci_hi")).alias("ci_lo"), (-F.col("ci_lo")).alias("ci_hi"))
    both = found.select(F.inline(F.array(there, back)), "n_resamples", "n_dropped")
    winner = F.when(F.col("ci_hi") < 0, F.col("a")).when(F.col("ci_lo") > 0, F.col("b")).otherwise("tie")
    return both.withColumn("winner", winner)


def interaction_interval(rows: DataFrame, stratum: str = "has_doc_ref", replicas: int = 10_000) -> DataFrame:
    """(A5 - A7) - (A4 - A1) in AURC with its interval, and whether that holds 0."""
    terms = {"interaction": {"A5": 1, "A7": -1, "A4": -1, "A1": 1}}
    found = area_bounds(rows, terms, stratum, replicas)
    return found.withColumn("includes_zero", (F.col("ci_lo") <= 0) & (F.col("ci_hi") >= 0))


JACK_GROUPS = 40


def area_jackknife(rows: DataFrame, terms: dict[str, dict[str, int]], own: Column, groups: int = JACK_GROUPS) -> DataFrame:
    """(statistic, se): standard errors by leaving out one of ``groups`` groups of items at a time (``own`` numbers them).

    Rows are compressed to levels first, so the groups multiply levels and not rows.
    """
    levels = rows.groupBy("variant", "score", own.alias("_own")).agg(F.count("*").alias("n"), F.sum("z").cast("bigint").alias("s"))
    left = levels.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).where("_own <> _g")
    left = left.groupBy("_g", "variant", "score").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    cum = running_totals(left, ["_g", "variant"], "score", ["n", "s"], descending=True)
    term = aurc_term(F.col("n"), F.col("s"), F.col("before_n"), F.col("before_s"))
    areas = cum.groupBy("_g", "variant").agg((F.sum(term) / F.sum("n")).alias("aurc"))
    wide = areas.groupBy("_g").agg(*[_combined(factors, F.col("variant"), F.col("aurc")).alias(name) for name, factors in terms.items()])
    long = wide.unpivot(["_g"], list(terms), "statistic", "value")
    return long.groupBy("statistic").agg(F.sqrt(F.var_pop("value") * (F.count("*") - 1)).alias("se"))


def progression(systems: dict[str, DataFrame]) -> DataFrame:
    """Paired item table of several systems; an abstaining system scores 0."""
    out = None
    for name, df in systems.items():
        z = F.col("z_winner")
        if "abstained" in df.columns:
            z = F.when(F.col("abstained"), F.lit(0)).otherwise(z)
        one = df.select("item_id", z.alias(f"z_{name}"))
        out = one if out is None else out.join(one, "item_id")
    return out


def progression_deltas(paired: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean adequacy of each system and its gain over the previous one."""
    stacked = paired.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("step"),
                        F.lit(n).alias("system"),
                        F.col(f"z_{n}").alias("z"),
                        (F.col(f"z_{n}") - F.col(f"z_{names[i - 1]}") if i else F.lit(None)).cast("double").alias("gain"),
                    )
                    for i, n in enumerate(names)
                ]
            )
        ).alias("r")
    )
    return stacked.groupBy("r.step", "r.system").agg(
        F.count("*").alias("n"), F.avg("r.z").alias("adequacy"), F.avg("r.gain").alias("delta")
    )
