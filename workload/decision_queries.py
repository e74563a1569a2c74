"""Queries over the item x agent panel: folds, weights, calibration, decisions, baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorate.operators import calibration as cal
from quorate.operators import decisions as dec
from quorate.operators import folds as fd
from quorate.operators import panel as pn
from quorate.operators import selective as sel
from workload import fixtures as fx
from workload.ctes import r6, with_ctes
from workload.registry import query


@query("panel_grid", with_ctes("SELECT item_id, agent_id, has_doc_ref, conf_raw, valid_json, z, conf, refused FROM fx_panel"))
def panel_grid(spark, sf_dir):
    return fx.panel(spark, sf_dir)


@query("agent_adequacy", r6("""
SELECT agent_id, count(*) AS n, avg(z) AS adequacy, CAST(sum(z) AS BIGINT) AS n_adequate,
       CAST(sum(CASE WHEN refused THEN 1 ELSE 0 END) AS BIGINT) AS n_refusals,
       CAST(sum(CASE WHEN refused AND agent_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_evasive,
       CAST(sum(CASE WHEN valid_json THEN 0 ELSE 1 END) AS BIGINT) AS n_parse_failures
FROM fx_panel GROUP BY agent_id""", "adequacy"))
def agent_adequacy(spark, sf_dir):
    audit = fx.refusal_audit(spark, sf_dir)
    long = fx.panel(spark, sf_dir).join(audit, ["item_id", "agent_id"], "left")
    evasive = F.coalesce(F.col("refusal_verdict") == 1, F.lit(False))
    return pn.variant_summary(long.withColumn("evasive", evasive))


@query("item_rollup", r6("""
SELECT item_id, max(CASE WHEN agent_id = 1 THEN z END) AS z_1, max(CASE WHEN agent_id = 2 THEN z END) AS z_2,
       max(CASE WHEN agent_id = 3 THEN z END) AS z_3, avg(z) AS z_mean,
       max(CASE WHEN agent_id = 1 THEN CAST(refused AS INTEGER) END) AS refused_1,
       max(CASE WHEN agent_id = 2 THEN CAST(refused AS INTEGER) END) AS refused_2,
       max(CASE WHEN agent_id = 3 THEN CAST(refused AS INTEGER) END) AS refused_3,
       avg(CAST(refused AS INTEGER)) AS refused_mean
FROM fx_panel GROUP BY item_id""", "z_mean", "refused_mean"))
def item_rollup(spark, sf_dir):
    long = fx.panel(spark, sf_dir).withColumn("refused", F.col("refused").cast("int"))
    return pn.item_rollup(long, fx.AGENTS, ["z", "refused"])


@query("melt_labels", with_ctes("SELECT item_id, CAST(agent_id AS VARCHAR) AS agent_id, z FROM fx_panel"))
def melt_labels(spark, sf_dir):
    wide = pn.item_rollup(fx.panel(spark, sf_dir), fx.AGENTS, ["z"]).drop("z_mean")
    wide = wide.withColumnsRenamed({f"z_{a}": f"z_agent_{a}" for a in fx.AGENTS})
    return pn.unpivot_labels(wide, ["item_id"], "z_agent_", "z")


@query("crosstab_action_sufficiency", r6("""
SELECT c.action, c.sufficiency, c.n, CAST(c.n AS DOUBLE) / sum(c.n) OVER (PARTITION BY c.action) AS row_share, c.adequacy
FROM (
  SELECT CASE WHEN p.refused THEN 'absteve' ELSE 'respondeu' END AS action,
         CASE s.verdict WHEN 2 THEN 'suficiente' WHEN 1 THEN 'parcial' ELSE 'insuficiente' END AS sufficiency,
         count(*) AS n, avg(p.z) AS adequacy
  FROM fx_panel p JOIN fx_sufficiency s USING (item_id) GROUP BY 1, 2) c""", "row_share", "adequacy"))
def crosstab_action_sufficiency(spark, sf_dir):
    from quorate.functions.constants import SUFFICIENCY_LABELS
    from quorate.operators.audit import action_sufficiency

    long = fx.panel(spark, sf_dir).join(fx.sufficiency(spark, sf_dir), "item_id")
    return action_sufficiency(
        long.withColumn("sufficiency", pn.label_of(F.col("verdict"), SUFFICIENCY_LABELS)).withColumn(
            "action", F.when(F.col("refused"), "absteve").otherwise("respondeu")
        )
    )


@query("crosstab_wide", r6("""
SELECT CASE WHEN p.refused THEN 'absteve' ELSE 'respondeu' END AS action,
       100 * CAST(sum(CASE WHEN s.verdict = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS insuficiente,
       100 * CAST(sum(CASE WHEN s.verdict = 1 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS parcial,
       100 * CAST(sum(CASE WHEN s.verdict = 2 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS suficiente
FROM fx_panel p JOIN fx_sufficiency s USING (item_id) GROUP BY 1""", "insuficiente", "parcial", "suficiente"))
def crosstab_wide(spark, sf_dir):
    from quorate.functions.constants import SUFFICIENCY_LABELS

    names = ["insuficiente", "parcial", "suficiente"]
    long = fx.panel(spark, sf_dir).join(fx.sufficiency(spark, sf_dir), "item_id").select(
        F.when(F.col("refused"), "absteve").otherwise("respondeu").alias("action"),
        pn.label_of(F.col("verdict"), SUFFICIENCY_LABELS).alias("sufficiency"),
    )
    return pn.row_shares(pn.crosstab(long, "action", "sufficiency", names), "action", names, 100.0)


@query("pivot_mean_adequacy", r6("""
SELECT agent_id, avg(CASE WHEN s.verdict = 0 THEN z END) AS insuficiente,
       avg(CASE WHEN s.verdict = 1 THEN z END) AS parcial, avg(CASE WHEN s.verdict = 2 THEN z END) AS suficiente
FROM fx_panel JOIN fx_sufficiency s USING (item_id) GROUP BY 1""", "insuficiente", "parcial", "suficiente"))
def pivot_mean_adequacy(spark, sf_dir):
    from quorate.functions.constants import SUFFICIENCY_LABELS

    long = fx.panel(spark, sf_dir).join(fx.sufficiency(spark, sf_dir), "item_id").withColumn(
        "sufficiency", pn.label_of(F.col("verdict"), SUFFICIENCY_LABELS)
    )
    return pn.pivot_mean(long, "agent_id", "sufficiency", ["insuficiente", "parcial", "suficiente"], "z")


@query("fold_assignment", with_ctes("SELECT item_id, has_doc_ref, fold_k FROM fx_folds"))
def fold_assignment(spark, sf_dir):
    return fx.folds(spark, sf_dir)


@query("fold_role_sizes", with_ctes("""
SELECT exec_k, role, count(*) AS n, count(*) FILTER (WHERE has_doc_ref) AS n_with_ref
FROM fx_folds JOIN fx_roles USING (fold_k) GROUP BY 1, 2"""))
def fold_role_sizes(spark, sf_dir):
    joined = fx.folds(spark, sf_dir).join(F.broadcast(fx.roles(spark)), "fold_k")
    return joined.groupBy("exec_k", "role").agg(
        F.count("*").alias("n"), F.count_if("has_doc_ref").alias("n_with_ref")
    )


@query("fold_cover", with_ctes("""
SELECT count(*) AS n_items, count(*) FILTER (WHERE t <> 1) AS n_violations
FROM (SELECT item_id, count(exec_k) AS t FROM fx_folds f
      LEFT JOIN fx_roles r ON r.fold_k = f.fold_k AND r.role = 'test' GROUP BY 1)"""))
def fold_cover(spark, sf_dir):
    folds = fx.folds(spark, sf_dir)
    broken = fd.fold_cover(folds, fx.roles(spark)).agg(F.count("*").alias("n"))
    return folds.agg(F.count("*").alias("n_items")).withColumn("n_violations", broken.scalar())


@query("recover_fit_folds", with_ctes("""
SELECT exec_k, fit_size, CAST(1 AS BIGINT) AS n_matches, CAST(2 AS INTEGER) AS n_val
FROM (SELECT exec_k, count(*) AS fit_size FROM fx_folds JOIN fx_roles USING (fold_k) WHERE role = 'fit' GROUP BY 1)"""))
def recover_fit_folds(spark, sf_dir):
    from quorate.functions.rand import permute

    folds, roles = fx.folds(spark, sf_dir), fx.roles(spark)
    stored = folds.join(F.broadcast(roles.where("role = 'fit'")), "fold_k").groupBy("exec_k").agg(
        F.count("*").alias("fit_size")
    )
    return fd.recover_fit_folds(folds, stored, permute(list(range(10)), 42))


@query("stratified_sample", with_ctes("""
SELECT item_id, has_doc_ref, md5('42:order:' || item_id) AS draw_order
FROM (
  SELECT item_id, has_doc_ref, row_number() OVER (PARTITION BY has_doc_ref ORDER BY md5('42:' || item_id), item_id) AS rn,
         count(*) OVER () AS n, count(*) FILTER (WHERE has_doc_ref) OVER () AS n_flag
  FROM fx_items)
WHERE rn <= CASE WHEN has_doc_ref THEN round_even(CAST(200 * n_flag AS DOUBLE) / n, 0)
            ELSE 200 - round_even(CAST(200 * n_flag AS DOUBLE) / n, 0) END"""))
def stratified_sample(spark, sf_dir):
    return fd.stratified_sample(fx.items(spark, sf_dir), "has_doc_ref", 200)


_DRAW = """
SELECT p.item_id, p.agent_id, CASE WHEN a.refusal_verdict IS NOT NULL THEN 'recusa' WHEN p.z = 1 THEN 'adequada'
       ELSE 'inadequada' END AS stratum, md5('42:' || p.item_id || ':' || p.agent_id) AS digest
FROM fx_panel p LEFT JOIN fx_audit a USING (item_id, agent_id)
"""


@query("annotation_draw", with_ctes(f"""
SELECT stratum, row_number() OVER (PARTITION BY stratum ORDER BY digest, item_id, agent_id) AS draw_order, item_id, agent_id
FROM (
  SELECT stratum, item_id, agent_id, digest FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos, stratum) AS k FROM (
      SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY digest, item_id) AS pos FROM (
        SELECT *, row_number() OVER (PARTITION BY stratum, item_id ORDER BY digest, agent_id) AS f
        FROM ({_DRAW}) WHERE stratum <> 'recusa') WHERE f = 1)) WHERE k = 1
  UNION ALL SELECT stratum, item_id, agent_id, digest FROM ({_DRAW}) WHERE stratum = 'recusa')"""))
def annotation_draw(spark, sf_dir):
    return fd.annotation_draw(_strata(spark, sf_dir))


def _strata(spark, sf_dir):
    audit = fx.refusal_audit(spark, sf_dir)
    joined = fx.panel(spark, sf_dir).join(audit, ["item_id", "agent_id"], "left")
    stratum = (
        F.when(F.col("refusal_verdict").isNotNull(), "recusa")
        .when(F.col("z") == 1, "adequada")
        .otherwise("inadequada")
    )
    return joined.select("item_id", "agent_id", "z", "refusal_verdict", stratum.alias("stratum"))


@query("agent_weights", r6("SELECT exec_k, agent_id, alpha, weight, fit_size FROM fx_weights", "alpha", "weight"))
def agent_weights(spark, sf_dir):
    return cal.adequacy_weights(fx.folded_panel(spark, sf_dir), fx.roles(spark))


@query("alt_weights_no_refusal", r6("""
SELECT exec_k, agent_id, alpha, alpha / sum(alpha) OVER (PARTITION BY exec_k) AS weight, fit_size
FROM (SELECT exec_k, agent_id, avg(z) AS alpha, count(*) AS fit_size FROM fx_fpanel JOIN fx_roles USING (fold_k)
      WHERE role = 'fit' AND NOT refused GROUP BY 1, 2)""", "alpha", "weight"))
def alt_weights_no_refusal(spark, sf_dir):
    return cal.weights_without_refusals(fx.folded_panel(spark, sf_dir), fx.roles(spark))


@query("alt_weights_informative", r6("""
SELECT exec_k, agent_id, alpha, CASE WHEN sum(alpha) OVER (PARTITION BY exec_k) = 0 THEN CAST(1 AS DOUBLE) / 3
       ELSE alpha / sum(alpha) OVER (PARTITION BY exec_k) END AS weight, fit_size
FROM (
  SELECT exec_k, agent_id, greatest(sum(s * (below + (n - s) / 2.0)) / (CAST(sum(s) AS DOUBLE) * sum(n - s)) - 0.5, 0) AS alpha,
         CAST(sum(n) AS BIGINT) AS fit_size
  FROM (SELECT *, coalesce(sum(n - s) OVER (PARTITION BY exec_k, agent_id ORDER BY x
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM fx_levels)
  GROUP BY 1, 2)""", "alpha", "weight"))
def alt_weights_informative(spark, sf_dir):
    return cal.informativeness_weights(fx.folded_panel(spark, sf_dir), fx.roles(spark))


@query("isotonic_levels", r6("SELECT exec_k, agent_id, x, n, s, y FROM fx_isotonic", "y"))
def isotonic_levels(spark, sf_dir):
    levels = cal.isotonic_levels(fx.folded_panel(spark, sf_dir), fx.roles(spark))
    blocks = cal.isotonic_fit(levels)
    value = cal.calibration_map(blocks, levels.select("agent_id", F.col("x").alias("conf")))
    return levels.join(
        value.select("exec_k", "agent_id", F.col("conf").alias("x"), F.col("conf_calib").alias("y")),
        ["exec_k", "agent_id", "x"],
    )


@query("isotonic_apply", r6("SELECT exec_k, agent_id, conf, conf_calib FROM fx_calibration", "conf_calib"))
def isotonic_apply(spark, sf_dir):
    panel = fx.folded_panel(spark, sf_dir)
    blocks = cal.isotonic_fit(cal.isotonic_levels(panel, fx.roles(spark)))
    return cal.calibration_map(blocks, panel.select("agent_id", "conf"))


@query("isotonic_diagnostics", with_ctes("""
SELECT exec_k, agent_id, min(x) AS x_min, max(x) AS x_max, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 2 END) AS BIGINT) AS n_breakpoints
FROM (SELECT exec_k, agent_id, y, min(x) AS x, count(*) AS k FROM fx_isotonic GROUP BY 1, 2, 3
      UNION ALL SELECT exec_k, agent_id, NULL, max(x), NULL FROM fx_isotonic GROUP BY 1, 2) WHERE true GROUP BY 1, 2"""
).replace("sum(CASE WHEN k = 1 THEN 1 ELSE 2 END)", "sum(CASE WHEN k IS NULL THEN 0 WHEN k = 1 THEN 1 ELSE 2 END)"))
def isotonic_diagnostics(spark, sf_dir):
    blocks = cal.isotonic_fit(cal.isotonic_levels(fx.folded_panel(spark, sf_dir), fx.roles(spark)))
    return cal.isotonic_diagnostics(blocks)


@query("decisions_weighted", r6("""
SELECT exec_k, item_id, has_doc_ref, agent_chosen, z_winner, eta, c_min, tau_star, abstained,
       CAST(z_system AS INTEGER) AS z_system FROM fx_decisions""", "eta", "tau_star"))
def decisions_weighted(spark, sf_dir):
    _, decided = dec.cross_fitted_decisions(fx.folded_panel(spark, sf_dir), fx.roles(spark), fx.C_MINS)
    return decided


@query("tau_star", r6("""
SELECT exec_k, c_min, tau_star, coverage_emp_val, risk_sel_emp_val, val_size, constraint_satisfied
FROM fx_thresholds""", "tau_star", "coverage_emp_val", "risk_sel_emp_val"))
def tau_star(spark, sf_dir):
    thresholds, _ = dec.cross_fitted_decisions(
        fx.folded_panel(spark, sf_dir), fx.roles(spark), fx.C_MINS
    )
    return thresholds


@query("decisions_mean_raw", r6("SELECT item_id, has_doc_ref, agent_chosen, z_winner, eta FROM fx_mean_head", "eta"))
def decisions_mean_raw(spark, sf_dir):
    return dec.mean_confidence_head(fx.panel(spark, sf_dir), ["item_id", "has_doc_ref"])


@query("baseline_b1", with_ctes("""
SELECT r.exec_k, p.item_id, p.has_doc_ref, p.agent_id AS agent_chosen, p.z AS z_winner
FROM fx_fpanel p JOIN fx_roles r ON r.fold_k = p.fold_k AND r.role = 'test'
JOIN (SELECT exec_k, agent_id FROM (SELECT *, row_number() OVER (PARTITION BY exec_k ORDER BY alpha DESC, agent_id) AS rn
      FROM fx_weights) WHERE rn = 1) b ON b.exec_k = r.exec_k AND b.agent_id = p.agent_id"""))
def baseline_b1(spark, sf_dir):
    return dec.baseline_best_agent(fx.folded_panel(spark, sf_dir), fx.roles(spark))


@query("baseline_b2", r6("""
SELECT exec_k, item_id, has_doc_ref, agent_id AS agent_chosen, z AS z_winner, 1 - weight * conf AS eta
FROM (SELECT *, row_number() OVER (PARTITION BY exec_k, item_id ORDER BY weight * conf DESC, weight DESC, agent_id DESC) AS rn
      FROM fx_scored WHERE role = 'test') WHERE rn = 1""", "eta"))
def baseline_b2(spark, sf_dir):
    return dec.baseline_raw(fx.folded_panel(spark, sf_dir), fx.roles(spark))


@query("baseline_b3", r6("""
SELECT exec_k, item_id, has_doc_ref, agent_chosen, z_winner, eta FROM fx_heads WHERE role = 'test'""", "eta"))
def baseline_b3(spark, sf_dir):
    return dec.baseline_calibrated(fx.folded_panel(spark, sf_dir), fx.roles(spark))


@query("baseline_solo", r6("""
WITH cand AS (
  SELECT exec_k, agent_id, tau, sum(n) OVER w AS answered, sum(err) OVER w AS errors,
         sum(n) OVER (PARTITION BY exec_k, agent_id) AS val_size
  FROM (SELECT exec_k, agent_id, tau, sum(n) AS n, sum(err) AS err FROM (
          SELECT exec_k, agent_id, 1 - conf_calib AS tau, 1 AS n, 1 - z AS err FROM fx_scored WHERE role = 'val'
          UNION ALL SELECT DISTINCT exec_k, agent_id, CAST(1 AS DOUBLE), 0, 0 FROM fx_scored) GROUP BY 1, 2, 3)
  WINDOW w AS (PARTITION BY exec_k, agent_id ORDER BY tau)),
best AS (
  SELECT * FROM (SELECT exec_k, agent_id, c_min, tau, row_number() OVER (PARTITION BY exec_k, agent_id, c_min
     ORDER BY CAST(errors AS DOUBLE) / answered, answered DESC, tau) AS rn
    FROM cand CROSS JOIN fx_grid WHERE answered > 0 AND CAST(answered AS DOUBLE) / val_size >= c_min) WHERE rn = 1)
SELECT agent_id, c_min, count(*) AS n, avg(CASE WHEN 1 - s.conf_calib > b.tau THEN 0 ELSE 1 END) AS coverage,
       avg(CASE WHEN 1 - s.conf_calib > b.tau THEN NULL ELSE 1 - s.z END) AS selective_risk
FROM fx_scored s JOIN best b USING (exec_k, agent_id) WHERE s.role = 'test' GROUP BY 1, 2""", "coverage", "selective_risk"))
def baseline_solo(spark, sf_dir):
    _, decided = dec.baseline_solo(fx.folded_panel(spark, sf_dir), fx.roles(spark), fx.C_MINS)
    return sel.coverage_risk(decided, ["agent_id", "c_min"])


@query("best_agent_retrospective", r6("""
SELECT agent_id, adequacy FROM (SELECT agent_id, avg(z) AS adequacy FROM fx_panel GROUP BY 1)
ORDER BY adequacy DESC, agent_id LIMIT 1""", "adequacy"))
def best_agent_retrospective(spark, sf_dir):
    return dec.retrospective_best_agent(fx.panel(spark, sf_dir))


@query("stability_weights", r6("""
SELECT agent_id, avg(weight) AS mean, stddev_samp(weight) AS std, count(*) AS n_folds,
       stddev_samp(weight) / abs(avg(weight)) AS cv FROM fx_weights GROUP BY 1""", "mean", "std", "cv"))
def stability_weights(spark, sf_dir):
    return dec.weight_stability(cal.adequacy_weights(fx.folded_panel(spark, sf_dir), fx.roles(spark)))


@query("stability_thresholds", r6("""
SELECT c_min, avg(tau_star) AS mean, stddev_samp(tau_star) AS std, count(*) AS n_folds,
       stddev_samp(tau_star) / abs(avg(tau_star)) AS cv, CAST(1 AS DOUBLE) AS share_satisfied
FROM fx_thresholds GROUP BY 1""", "mean", "std", "cv"))
def stability_thresholds(spark, sf_dir):
    thresholds, _ = dec.cross_fitted_decisions(
        fx.folded_panel(spark, sf_dir), fx.roles(spark), fx.C_MINS
    )
    return dec.threshold_stability(thresholds)
