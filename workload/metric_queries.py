"""Queries for selective metrics, audit, diversity and ablation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorate.functions import constants as C
from quorate.functions.rand import draw_unit
from quorate.operators import ablation as ab
from quorate.operators import audit as au
from quorate.operators import decisions as dec
from quorate.operators import diversity as dv
from quorate.operators import folds as fd
from quorate.operators import gates as gt
from quorate.operators import panel as pn
from quorate.operators import selective as sel
from quorate.session import materialise
from workload import fixtures as fx
from workload.ctes import cte, r6, with_ctes
from workload.registry import query

cte("fx_mean_candidates", """
SELECT exec_k, tau, sum(n) OVER w AS answered, sum(err) OVER w AS errors, sum(n) OVER (PARTITION BY exec_k) AS val_size
FROM (SELECT exec_k, tau, sum(n) AS n, sum(err) AS err FROM (
    SELECT exec_k, eta AS tau, 1 AS n, 1 - z_winner AS err
    FROM fx_mean_head JOIN fx_folds USING (item_id) JOIN fx_roles USING (fold_k) WHERE role = 'val'
    UNION ALL SELECT DISTINCT exec_k, CAST(1 AS DOUBLE), 0, 0 FROM fx_roles) GROUP BY 1, 2)
WINDOW w AS (PARTITION BY exec_k ORDER BY tau)
""")
cte("fx_mean_decisions", """
SELECT h.*, t.exec_k, t.c_min, t.tau_star, h.eta > t.tau_star AS abstained
FROM fx_mean_head h JOIN fx_folds f USING (item_id)
JOIN (SELECT exec_k, c_min, tau AS tau_star FROM (
        SELECT exec_k, c_min, tau, row_number() OVER (PARTITION BY exec_k, c_min
           ORDER BY CAST(errors AS DOUBLE) / answered, answered DESC, tau) AS rn
        FROM fx_mean_candidates CROSS JOIN fx_grid WHERE answered > 0 AND CAST(answered AS DOUBLE) / val_size >= c_min)
      WHERE rn = 1) t ON t.exec_k = f.fold_k
""")


def mean_decisions(spark, sf_dir):
    """Minimal head with cross-fitted thresholds."""
    heads = dec.mean_confidence_head(fx.panel(spark, sf_dir), ["item_id", "has_doc_ref"])
    heads = materialise(heads.join(fx.folds(spark, sf_dir).select("item_id", "fold_k"), "item_id"))
    roles = fx.roles(spark)
    val = heads.join(F.broadcast(roles.where("role = 'val'")), "fold_k").select(
        "exec_k", "eta", F.col("z_winner").alias("z")
    )
    thresholds = sel.tau_star(val, ["exec_k"], fx.C_MINS)
    test = heads.withColumn("exec_k", F.col("fold_k"))
    return dec.abstain(test, thresholds, ["exec_k"])


@query("minimal_slice", r6("""
SELECT c_min, count(*) AS n, avg(CASE WHEN abstained THEN 0 ELSE 1 END) AS coverage,
       avg(CASE WHEN abstained THEN NULL ELSE 1 - z_winner END) AS selective_risk,
       avg(tau_star) AS mean_tau FROM fx_mean_decisions GROUP BY 1""", "coverage", "selective_risk", "mean_tau"))
def minimal_slice(spark, sf_dir):
    decided = mean_decisions(spark, sf_dir)
    answered = ~F.col("abstained")
    return decided.groupBy("c_min").agg(
        F.count("*").alias("n"),
        F.avg(answered.cast("double")).alias("coverage"),
        F.avg(F.when(answered, (1 - F.col("z_winner")).cast("double"))).alias("selective_risk"),
        F.avg("tau_star").alias("mean_tau"),
    )


@query("selective_metrics", r6("""
SELECT c_min, stratum, count(*) AS n, avg(CASE WHEN abstained THEN 0 ELSE 1 END) AS coverage,
       avg(CASE WHEN abstained THEN NULL ELSE 1 - z_winner END) AS selective_risk
FROM fx_mean_decisions CROSS JOIN LATERAL (VALUES ('all'), (CAST(has_doc_ref AS VARCHAR))) AS s(stratum)
GROUP BY 1, 2""", "coverage", "selective_risk"))
def selective_metrics(spark, sf_dir):
    decided = sel.with_overall(
        mean_decisions(spark, sf_dir).withColumn("stratum", F.col("has_doc_ref")), "stratum"
    )
    return sel.coverage_risk(decided, ["c_min", "stratum"])


@query("abstention_metrics", r6("""
SELECT c_min, CAST(sum(CASE WHEN abstained THEN 0 ELSE z_winner END) AS DOUBLE) / count(*) AS adequacy_useful,
       avg(CASE WHEN abstained THEN 1 - z_winner END) AS abstention_precision, avg(1 - z_winner) AS base_rate,
       avg(CASE WHEN abstained THEN 1 - z_winner END) - avg(1 - z_winner) AS lift,
       count(*) FILTER (WHERE abstained) AS n_abstentions
FROM fx_mean_decisions GROUP BY 1""", "adequacy_useful", "abstention_precision", "base_rate", "lift"))
def abstention_metrics(spark, sf_dir):
    return sel.abstention_metrics(mean_decisions(spark, sf_dir), ["c_min"])


_STRATUM = """CASE WHEN NOT has_doc_ref THEN 'sem_doc_ref' WHEN recall = 0 THEN 'recall=0'
   WHEN recall < 0.5 THEN '0<recall<0.5' ELSE 'recall>=0.5' END"""


@query("strata_summary", r6(f"""
SELECT c_min, {_STRATUM} AS stratum, count(*) AS n, avg(CASE WHEN abstained THEN 1 ELSE 0 END) AS abstention_rate,
       avg(CASE WHEN abstained THEN 1 - z_winner END) AS abstention_precision,
       avg(CASE WHEN NOT abstained THEN 1 - z_winner END) AS selective_risk,
       avg(CASE WHEN NOT abstained THEN z_winner END) AS answered_adequacy
FROM fx_mean_decisions JOIN (SELECT o_orderkey AS item_id, floor(o_totalprice) % 5 / 4.0 AS recall FROM orders) USING (item_id)
GROUP BY 1, 2""", "abstention_rate", "abstention_precision", "selective_risk", "answered_adequacy"))
def strata_summary(spark, sf_dir):
    recall = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), (F.floor("o_totalprice") % 5 / 4.0).alias("recall")
    )
    decided = mean_decisions(spark, sf_dir).join(recall, "item_id")
    stratum = pn.retrieval_stratum(F.col("has_doc_ref"), F.col("recall"))
    decided = decided.select(
        F.struct("c_min", stratum.alias("stratum")).alias("g"), "abstained", F.col("z_winner").alias("z")
    )
    return pn.strata_summary(decided, "g").select("g.*", "*").drop("g")


@query("tradeoff_by_c_min", r6("""
SELECT c_min, avg(CASE WHEN abstained THEN 1 - z_winner END) AS abstention_precision,
       count(*) FILTER (WHERE abstained) AS n_abstentions, avg(CASE WHEN abstained THEN 0 ELSE 1 END) AS coverage,
       avg(CASE WHEN NOT abstained THEN 1 - z_winner END) AS selective_risk
FROM fx_decisions GROUP BY 1""", "abstention_precision", "coverage", "selective_risk"))
def tradeoff_by_c_min(spark, sf_dir):
    _, decided = dec.cross_fitted_decisions(fx.folded_panel(spark, sf_dir), fx.roles(spark), fx.C_MINS)
    return pn.tradeoff_by_level(decided.withColumnRenamed("z_winner", "z"))


@query("risk_coverage", r6("""
WITH d AS (
  SELECT stratum, eta, 1 - z_winner AS err FROM fx_mean_head
  CROSS JOIN LATERAL (VALUES ('all'), (CAST(has_doc_ref AS VARCHAR))) AS s(stratum)),
t AS (
  SELECT stratum, tau, sum(n) AS n, sum(err) AS err FROM (
    SELECT stratum, eta AS tau, 1 AS n, err FROM d
    UNION ALL SELECT stratum, CASE WHEN i = 199 THEN 1 ELSE i * (CAST(1 AS DOUBLE) / 199) END, 0, 0
    FROM (SELECT DISTINCT stratum FROM d) CROSS JOIN range(200) r(i)) GROUP BY 1, 2)
SELECT stratum, tau, CAST(cn AS DOUBLE) / total AS coverage,
       CASE WHEN cn > 0 THEN CAST(ce AS DOUBLE) / cn END AS selective_risk, CAST(cn AS BIGINT) AS n_answered
FROM (SELECT stratum, tau, sum(n) OVER w AS cn, sum(err) OVER w AS ce, sum(n) OVER (PARTITION BY stratum) AS total
      FROM t WINDOW w AS (PARTITION BY stratum ORDER BY tau))""", "tau", "coverage", "selective_risk"))
def risk_coverage(spark, sf_dir):
    heads = dec.mean_confidence_head(fx.panel(spark, sf_dir), ["item_id", "has_doc_ref"])
    rows = sel.with_overall(heads.withColumn("stratum", F.col("has_doc_ref")), "stratum")
    return sel.risk_coverage_curve(rows.withColumnRenamed("z_winner", "z"), ["stratum"])


@query("nearest_curve_point", r6("""
WITH c AS (
  SELECT tau, CAST(cn AS DOUBLE) / total AS coverage, CASE WHEN cn > 0 THEN CAST(ce AS DOUBLE) / cn END AS selective_risk
  FROM (SELECT tau, sum(n) OVER w AS cn, sum(err) OVER w AS ce, sum(n) OVER () AS total
        FROM (SELECT tau, sum(n) AS n, sum(err) AS err FROM (
                SELECT eta AS tau, 1 AS n, 1 - z_winner AS err FROM fx_mean_head
                UNION ALL SELECT CASE WHEN i = 199 THEN 1 ELSE i * (CAST(1 AS DOUBLE) / 199) END, 0, 0 FROM range(200) r(i))
              GROUP BY 1) WINDOW w AS (ORDER BY tau)))
SELECT wanted_tau, tau, coverage, selective_risk FROM (
  SELECT *, row_number() OVER (PARTITION BY wanted_tau ORDER BY abs(tau - wanted_tau), tau) AS rn
  FROM c CROSS JOIN (SELECT DISTINCT tau_star AS wanted_tau FROM fx_mean_decisions)) WHERE rn = 1""",
  "wanted_tau", "tau", "coverage", "selective_risk"))
def nearest_curve_point(spark, sf_dir):
    decided = mean_decisions(spark, sf_dir)
    curve = sel.risk_coverage_curve(
        dec.mean_confidence_head(fx.panel(spark, sf_dir), ["item_id"]).withColumnRenamed("z_winner", "z")
    )
    taus = decided.select(F.col("tau_star").alias("wanted_tau")).distinct()
    return sel.nearest_curve_point(curve, taus)


@query("eta_histogram", with_ctes("""
SELECT * FROM (WITH b AS (SELECT floor(min(eta) * 20) / 20.0 AS lo, ceil(max(eta) * 20) / 20.0 AS hi FROM fx_mean_head)
SELECT CAST(least(floor((eta - lo) / ((hi - lo) / 21)), 20) AS INTEGER) AS bin, z_winner AS z, count(*) AS n
FROM fx_mean_head CROSS JOIN b GROUP BY 1, 2)"""))
def eta_histogram(spark, sf_dir):
    heads = dec.mean_confidence_head(fx.panel(spark, sf_dir), ["item_id"])
    return pn.uncertainty_histogram(heads.withColumnRenamed("z_winner", "z"))


cte("fx_edges", "SELECT CAST(i AS INTEGER) AS i, CASE WHEN i = 15 THEN 1 ELSE i * (CAST(1 AS DOUBLE) / 15) END AS e FROM range(16) r(i)")
cte("fx_bins", """
SELECT agent_id, b.i AS bin, count(*) AS n, avg(conf) AS mc, avg(z) AS acc
FROM fx_panel p JOIN (SELECT a.i, a.e AS lo, b.e AS hi FROM fx_edges a JOIN fx_edges b ON b.i = a.i + 1) b
  ON p.conf >= b.lo AND (p.conf < b.hi OR (b.i = 14 AND p.conf <= b.hi))
GROUP BY 1, 2
""")


@query("ece_equal_width", r6("""
SELECT agent_id, sum(n * abs(acc - mc)) / sum(n) AS ece FROM fx_bins GROUP BY 1""", "ece"))
def ece_equal_width(spark, sf_dir):
    return sel.ece_equal_width(fx.panel(spark, sf_dir), ["agent_id"])


@query("ece_quantile", r6("""
WITH q AS (SELECT agent_id, i, CASE WHEN i = 0 THEN 0 WHEN i = 15 THEN 1 + 1e-9 ELSE e END AS e FROM (
    SELECT agent_id, unnest(range(16)) AS i,
      unnest(quantile_cont(conf, [0, 1/15, 2/15, 3/15, 4/15, 5/15, 6/15, 7/15, 8/15, 9/15, 10/15, 11/15, 12/15, 13/15, 14/15, 1])) AS e
    FROM fx_panel GROUP BY agent_id)),
b AS (SELECT x.agent_id, x.i, x.e AS lo, y.e AS hi FROM q x JOIN q y ON x.agent_id = y.agent_id AND y.i = x.i + 1)
SELECT agent_id, sum(n * abs(acc - mc)) / sum(n) AS ece
FROM (SELECT p.agent_id, b.i, count(*) AS n, avg(p.z) AS acc, avg(p.conf) AS mc
      FROM fx_panel p JOIN b ON b.agent_id = p.agent_id AND p.conf >= b.lo AND (p.conf < b.hi OR (b.i = 14 AND p.conf <= b.hi))
      GROUP BY 1, 2) GROUP BY 1""", "ece"))
def ece_quantile(spark, sf_dir):
    return sel.ece_quantile(fx.panel(spark, sf_dir), ["agent_id"])


@query("reliability_bins", r6("""
SELECT a.agent_id, x.i AS bin, x.e AS bin_lo, y.e AS bin_hi, coalesce(b.n, 0) AS count, b.mc AS avg_confidence, b.acc AS accuracy
FROM (SELECT DISTINCT agent_id FROM fx_panel) a CROSS JOIN fx_edges x JOIN fx_edges y ON y.i = x.i + 1
LEFT JOIN fx_bins b ON b.agent_id = a.agent_id AND b.bin = x.i""", "bin_lo", "bin_hi", "avg_confidence", "accuracy"))
def reliability_bins(spark, sf_dir):
    return sel.reliability_table(fx.panel(spark, sf_dir), ["agent_id"])


@query("representative_fold", r6("""
WITH e AS (
  SELECT fold_k, avg(ece) AS ece FROM (
    SELECT fold_k, agent_id, sum(n * abs(acc - mc)) / sum(n) AS ece FROM (
      SELECT fold_k, agent_id, b.i, count(*) AS n, avg(conf) AS mc, avg(z) AS acc
      FROM fx_fpanel p JOIN (SELECT a.i, a.e AS lo, b.e AS hi FROM fx_edges a JOIN fx_edges b ON b.i = a.i + 1) b
        ON p.conf >= b.lo AND (p.conf < b.hi OR (b.i = 14 AND p.conf <= b.hi)) GROUP BY 1, 2, 3)
    GROUP BY 1, 2) GROUP BY 1)
SELECT fold_k, ece, round(abs(ece - (SELECT median(ece) FROM e)), 12) AS distance FROM e
ORDER BY distance, fold_k LIMIT 1""", "ece", "distance"))
def representative_fold(spark, sf_dir):
    return sel.representative_fold(fx.folded_panel(spark, sf_dir))


cte("fx_scores", """
SELECT 'mean' AS variant, 1 - eta AS score, z_winner AS z, item_id FROM fx_mean_head
UNION ALL SELECT 'max', conf, z, item_id FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY conf DESC, agent_id) AS rn FROM fx_panel) WHERE rn = 1
""")
cte("fx_score_levels", """
SELECT variant, score, n, s, n0, s0, sum(n) OVER (PARTITION BY variant) AS total FROM (
  SELECT variant, score, n, s,
    coalesce(sum(n) OVER w, 0) AS n0, coalesce(sum(s) OVER w, 0) AS s0
  FROM (SELECT variant, score, count(*) AS n, sum(z) AS s FROM fx_scores GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY variant ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
""")


def score_rows(spark, sf_dir):
    """Two score variants: mean and maximum of raw confidence."""
    panel = fx.panel(spark, sf_dir)
    mean = dec.mean_confidence_head(panel, ["item_id"]).select(
        F.lit("mean").alias("variant"), (1 - F.col("eta")).alias("score"), F.col("z_winner").alias("z"), "item_id"
    )
    best = F.min_by(F.struct("conf", "z"), F.struct(-F.col("conf"), F.col("agent_id"))).alias("w")
    top = panel.groupBy("item_id").agg(best).select(
        F.lit("max").alias("variant"), F.col("w.conf").alias("score"), F.col("w.z").alias("z"), "item_id"
    )
    return mean.unionByName(top)


@query("auroc", r6("""
SELECT variant, CAST(sum(n) AS BIGINT) AS n,
  sum(s * ((total - n0 - n) - (total_s - s0 - s) + (n - s) / 2.0)) / (CAST(max(total_s) AS DOUBLE) * max(total - total_s)) AS auroc
FROM (SELECT *, sum(s) OVER (PARTITION BY variant) AS total_s FROM fx_score_levels) GROUP BY 1""", "auroc"))
def auroc(spark, sf_dir):
    return sel.auroc(score_rows(spark, sf_dir), ["variant"], "score", F.col("z"))


@query("aurc", r6("""
SELECT variant, CAST(max(total) AS BIGINT) AS n_items, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS n_tied,
       sum(term) / max(total) AS aurc
FROM (SELECT l.*, list_sum(list_transform(range(1, n + 1), lambda j: 1 - (s0 + j * (CAST(s AS DOUBLE) / n)) / (n0 + j))) AS term
      FROM fx_score_levels l) GROUP BY 1""", "aurc"))
def aurc(spark, sf_dir):
    return sel.aurc(score_rows(spark, sf_dir), ["variant"])


@query("aurc_row_order", r6("""
SELECT variant, avg(1 - CAST(cs AS DOUBLE) / cn) AS aurc_row_order FROM (
  SELECT variant, sum(z) OVER w AS cs, count(*) OVER w AS cn FROM fx_scores
  WINDOW w AS (PARTITION BY variant ORDER BY score DESC, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY 1""",
  "aurc_row_order"))
def aurc_row_order(spark, sf_dir):
    return sel.aurc_row_order(score_rows(spark, sf_dir), ["variant"], "item_id")


@query("risk_at_coverage", r6("""
SELECT variant, coverage, 1 - sum(greatest(least(k - n0, n), 0) * (CAST(s AS DOUBLE) / n)) / max(k) AS risk
FROM (SELECT l.*, c.coverage, greatest(floor(c.coverage * total), 1) AS k FROM fx_score_levels l
      CROSS JOIN (SELECT CAST(c AS DOUBLE) AS coverage FROM (VALUES (0.3), (0.5), (0.8)) v(c)) c) GROUP BY 1, 2""", "risk"))
def risk_at_coverage(spark, sf_dir):
    return sel.risk_at_coverage(score_rows(spark, sf_dir), ["variant"], [0.3, 0.5, 0.8])


@query("response_probability", r6("""
SELECT variant, score, target_coverage, least(greatest((target_coverage * total - n0) / n, 0), 1) AS p_respond
FROM fx_score_levels CROSS JOIN (SELECT CAST(c AS DOUBLE) AS target_coverage FROM (VALUES (0.3), (0.5), (0.8)) v(c))""",
  "score", "p_respond"))
def response_probability(spark, sf_dir):
    return sel.response_probability(score_rows(spark, sf_dir), ["variant"], [0.3, 0.5, 0.8])


# Ablation variants ---------------------------------------------------------------------------

cte("fx_w2", """
SELECT exec_k, agent_id, alpha / sum(alpha) OVER (PARTITION BY exec_k) AS weight
FROM (SELECT exec_k, agent_id, avg(z) AS alpha FROM fx_fpanel JOIN fx_roles USING (fold_k)
      WHERE role = 'fit' AND NOT refused GROUP BY 1, 2)
""")
cte("fx_w3", """
SELECT exec_k, agent_id, CASE WHEN sum(alpha) OVER (PARTITION BY exec_k) = 0 THEN CAST(1 AS DOUBLE) / 3
       ELSE alpha / sum(alpha) OVER (PARTITION BY exec_k) END AS weight
FROM (SELECT exec_k, agent_id, greatest(sum(s * (below + (n - s) / 2.0)) / (CAST(sum(s) AS DOUBLE) * sum(n - s)) - 0.5, 0) AS alpha
  FROM (SELECT *, coalesce(sum(n - s) OVER (PARTITION BY exec_k, agent_id ORDER BY x
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM fx_levels) GROUP BY 1, 2)
""")
cte("fx_abl_rows", """
SELECT s.item_id, s.fold_k, s.has_doc_ref, s.agent_id, s.z, s.refused, s.conf, s.conf_calib, s.weight * s.conf_calib AS p0,
       w2.weight * s.conf_calib AS p2, w3.weight * s.conf_calib AS p3
FROM fx_scored s JOIN fx_w2 w2 USING (exec_k, agent_id) JOIN fx_w3 w3 USING (exec_k, agent_id) WHERE s.role = 'test'
""")
cte("fx_abl_long", """
SELECT item_id, fold_k, has_doc_ref, agent_id, z, refused, v.variant, v.key, v.own,
       (max(CASE WHEN agent_id = 1 THEN v.own END) OVER w + max(CASE WHEN agent_id = 2 THEN v.own END) OVER w
        + max(CASE WHEN agent_id = 3 THEN v.own END) OVER w) / 3 AS mean_own
FROM fx_abl_rows CROSS JOIN LATERAL (VALUES ('A0', p0, p0), ('A2', p2, p2), ('A3', p3, p3), ('A1', conf_calib, conf_calib),
  ('A4', conf_calib, conf_calib), ('A5', conf, conf), ('A7', conf, conf)) AS v(variant, key, own)
WINDOW w AS (PARTITION BY item_id, v.variant)
""")
cte("fx_variants", """
SELECT item_id, fold_k, has_doc_ref, variant, agent_id AS agent_chosen, z, refused,
       CASE WHEN variant IN ('A4', 'A5') THEN mean_own ELSE own END AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, variant ORDER BY key DESC, agent_id) AS rn FROM fx_abl_long) WHERE rn = 1
UNION ALL
SELECT item_id, fold_k, has_doc_ref, 'B0', agent_id, z, refused, conf FROM fx_abl_rows
WHERE agent_id = (SELECT agent_id FROM fx_panel GROUP BY 1 ORDER BY avg(z) DESC, agent_id LIMIT 1)
""")


def variant_rows(spark, sf_dir):
    panel = fx.folded_panel(spark, sf_dir)
    scored = ab.scored_test_panel(panel, fx.roles(spark))
    return materialise(ab.variants(scored, dec.retrospective_best_agent(panel)))


@query("ablation_variants", r6(
    "SELECT item_id, fold_k, has_doc_ref, variant, agent_chosen, z, refused, score FROM fx_variants", "score"))
def ablation_variants(spark, sf_dir):
    return variant_rows(spark, sf_dir)


cte("fx_log_features", """
SELECT r.item_id, r.fold_k, max(CASE WHEN v.agent_chosen = r.agent_id THEN r.z END) AS z,
       CAST(1 AS DOUBLE) AS intercept, avg(conf_calib) AS f_mean, min(conf_calib) AS f_min, max(conf_calib) AS f_max,
       stddev_pop(conf_calib) AS f_std, CAST(sum(CASE WHEN r.refused THEN 1 ELSE 0 END) AS DOUBLE) AS f_refusals
FROM fx_abl_rows r JOIN fx_variants v ON v.item_id = r.item_id AND v.variant = 'A1' GROUP BY 1, 2
""")


@query("ablation_logistic", r6("""
SELECT CAST(exec_k AS INTEGER) AS exec_k, count(*) AS n_fit, sum(z * intercept) AS intercept, sum(z * f_mean) AS f_mean, sum(z * f_min) AS f_min,
       sum(z * f_max) AS f_max, sum(z * f_std) AS f_std, sum(z * f_refusals) AS f_refusals
FROM fx_log_features JOIN fx_roles USING (fold_k) WHERE role = 'fit' GROUP BY 1""", "intercept", "f_mean", "f_min", "f_max", "f_std", "f_refusals"))
def ablation_logistic(spark, sf_dir):
    """What makes a penalised model the best: on its fit rows each feature has the same sum under the fitted
    probabilities, plus its coefficient, as under the labels; the labels' sums need no model."""
    panel, roles = fx.folded_panel(spark, sf_dir), fx.roles(spark)
    rows = materialise(ab.logistic_features(ab.scored_test_panel(panel, roles)))
    models = ab.logistic_models(rows, roles)
    named = models.select("exec_k", "n_fit", *[F.col(c).alias(f"b_{c}") for c in ("intercept", *ab.FEATURES)])
    fit = rows.join(F.broadcast(roles.where("role = 'fit'").select("exec_k", "fold_k")), "fold_k").join(F.broadcast(named), "exec_k")
    margin = sum((F.col(f"b_{c}") * F.col(c) for c in ab.FEATURES), F.col("b_intercept"))
    p = 1 / (1 + F.exp(-margin))
    sums = [(F.sum(p * F.col(c)) + F.max(f"b_{c}")).alias(c) for c in ab.FEATURES]
    return fit.groupBy("exec_k").agg(F.max("n_fit").alias("n_fit"), F.sum(p).alias("intercept"), *sums)


@query("ablation_with_logistic")
def ablation_with_logistic(spark, sf_dir):
    """The ablation table with A6 among its variants; its scores come from an iteration that has no SQL form."""
    panel, roles = fx.folded_panel(spark, sf_dir), fx.roles(spark)
    scored = materialise(ab.scored_test_panel(panel, roles))
    rows = ab.variants(scored, dec.retrospective_best_agent(panel)).unionByName(ab.logistic_variant(scored, roles))
    return ab.ablation_table(materialise(rows))


cte("fx_var_levels", """
SELECT variant, score, n, s, n0, s0, sum(n) OVER (PARTITION BY variant) AS total,
       sum(s) OVER (PARTITION BY variant) AS total_s FROM (
  SELECT variant, score, n, s, coalesce(sum(n) OVER w, 0) AS n0, coalesce(sum(s) OVER w, 0) AS s0
  FROM (SELECT variant, score, count(*) AS n, sum(z) AS s FROM fx_variants GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY variant ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
""")
cte("fx_var_aurc", """
SELECT variant, CAST(max(total) AS BIGINT) AS n_items, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS n_tied,
       sum(list_sum(list_transform(range(1, n + 1), lambda j: 1 - (s0 + j * (CAST(s AS DOUBLE) / n)) / (n0 + j)))) / max(total) AS aurc,
       CAST(max(total_s) AS DOUBLE) / max(total) AS accuracy,
       sum(s * ((total - n0 - n) - (total_s - s0 - s) + (n - s) / 2.0)) / (CAST(max(total_s) AS DOUBLE) * max(total - total_s)) AS auroc,
       1 - sum(greatest(least(greatest(floor(0.3 * total), 1) - n0, n), 0) * (CAST(s AS DOUBLE) / n)) / greatest(floor(0.3 * max(total)), 1) AS risk_30,
       1 - sum(greatest(least(greatest(floor(0.5 * total), 1) - n0, n), 0) * (CAST(s AS DOUBLE) / n)) / greatest(floor(0.5 * max(total)), 1) AS risk_50
FROM fx_var_levels GROUP BY 1
""")


@query("ablation_table", r6("""
SELECT variant, accuracy, auroc, n_items, n_tied, aurc, risk_30, risk_50,
       aurc - (SELECT aurc FROM fx_var_aurc WHERE variant = 'A0') AS delta_aurc FROM fx_var_aurc""",
  "accuracy", "auroc", "aurc", "risk_30", "risk_50", "delta_aurc"))
def ablation_table(spark, sf_dir):
    return ab.ablation_table(variant_rows(spark, sf_dir))


@query("pair_matrix", r6("""
SELECT a.variant AS a, b.variant AS b, a.aurc - b.aurc AS delta_aurc,
       CASE WHEN a.aurc < b.aurc THEN a.variant WHEN a.aurc > b.aurc THEN b.variant ELSE 'tie' END AS better
FROM fx_var_aurc a JOIN fx_var_aurc b ON a.variant <> b.variant""", "delta_aurc"))
def pair_matrix(spark, sf_dir):
    return ab.pair_matrix(variant_rows(spark, sf_dir))


@query("interaction_2x2", r6("""
SELECT raw_effect, calibrated_effect, raw_effect - calibrated_effect AS interaction FROM (
SELECT max(CASE WHEN variant = 'A5' THEN aurc END) - max(CASE WHEN variant = 'A7' THEN aurc END) AS raw_effect,
       max(CASE WHEN variant = 'A4' THEN aurc END) - max(CASE WHEN variant = 'A1' THEN aurc END) AS calibrated_effect
FROM fx_var_aurc)""", "raw_effect", "calibrated_effect", "interaction"))
def interaction_2x2(spark, sf_dir):
    return ab.interaction(variant_rows(spark, sf_dir))


# Draws differ between engines, so the checked columns are the point, the standard error by leaving out groups of
# items, which needs no draws, and whether both bounds lie where that error puts them.

cte("fx_var_jack", """
SELECT g, variant, sum(list_sum(list_transform(range(1, n + 1), lambda j: 1 - (s0 + j * (CAST(s AS DOUBLE) / n)) / (n0 + j)))) / sum(n) AS aurc
FROM (
  SELECT g, variant, score, n, s, coalesce(sum(n) OVER w, 0) AS n0, coalesce(sum(s) OVER w, 0) AS s0
  FROM (SELECT g, variant, score, count(*) AS n, sum(z) AS s
        FROM (SELECT *, floor(CAST('0x' || substr(md5('11:' || item_id), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) * 40) AS own FROM fx_variants),
             (SELECT unnest(range(0, 40)) AS g) WHERE own <> g GROUP BY 1, 2, 3)
  WINDOW w AS (PARTITION BY g, variant ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
GROUP BY 1, 2
""")
cte("fx_pair_jack", """
SELECT a.variant AS a, b.variant AS b, sqrt(var_pop(a.aurc - b.aurc) * (count(*) - 1)) AS se
FROM fx_var_jack a JOIN fx_var_jack b ON a.g = b.g AND a.variant <> b.variant GROUP BY 1, 2
""")


def lawful(df, point, se):
    """Bounds replaced by whether each lies within 0.6 standard errors, or two thousandths, of its place under a normal law.

    Two variants that choose alike for almost all items differ by their few ties, which is no normal law.
    """
    near = lambda c, z: F.coalesce(F.abs(F.col(c) - (F.col(point) + z * F.col(se))) <= F.greatest(0.6 * F.col(se), F.lit(0.002)), F.lit(False))
    return df.withColumns({"lower_as_normal": near("ci_lo", -1.959964), "upper_as_normal": near("ci_hi", 1.959964)}).drop("ci_lo", "ci_hi")


def item_group():
    return F.floor(draw_unit(F.col("item_id").cast("string"), 11) * ab.JACK_GROUPS).cast("int")


_LAWFUL = "CAST(10000 AS BIGINT) AS n_resamples, CAST(0 AS BIGINT) AS n_dropped, true AS lower_as_normal, true AS upper_as_normal"


@query("ablation_intervals", r6(f"""
SELECT v.variant, v.aurc - o.aurc AS delta_aurc, j.se, {_LAWFUL}
FROM fx_var_aurc v JOIN fx_var_aurc o ON o.variant = 'A0' AND v.variant <> 'A0' JOIN fx_pair_jack j ON j.a = v.variant AND j.b = 'A0'""", "delta_aurc", "se"))
def ablation_intervals(spark, sf_dir):
    rows = variant_rows(spark, sf_dir)
    se = ab.area_jackknife(rows, ab._terms(rows, "A0"), item_group()).withColumnRenamed("statistic", "variant")
    return lawful(ab.ablation_intervals(rows).join(se, "variant"), "delta_aurc", "se").drop("significant")


@query("pair_intervals", r6(f"""
SELECT a.variant AS a, b.variant AS b, a.aurc - b.aurc AS delta_aurc, {_LAWFUL}
FROM fx_var_aurc a JOIN fx_var_aurc b ON a.variant <> b.variant""", "delta_aurc"))
def pair_intervals(spark, sf_dir):
    rows = variant_rows(spark, sf_dir)
    names = [f"A{i}" for i in (0, 1, 2, 3, 4, 5, 7)] + ["B0"]
    se = ab.area_jackknife(rows, {f"{a}|{b}": {a: 1, b: -1} for a in names for b in names if a != b}, item_group())
    pair = F.split("statistic", "\\|")
    found = ab.pair_intervals(rows).join(se.select(pair[0].alias("a"), pair[1].alias("b"), "se"), ["a", "b"])
    return lawful(found, "delta_aurc", "se").drop("winner", "se")


@query("interaction_interval", r6(f"""
SELECT 'interaction' AS statistic, p.d AS delta_aurc, j.se, {_LAWFUL}
FROM (SELECT sum(CASE WHEN variant IN ('A5', 'A1') THEN aurc WHEN variant IN ('A7', 'A4') THEN -aurc ELSE 0 END) AS d FROM fx_var_aurc) p,
     (SELECT sqrt(var_pop(d) * (count(*) - 1)) AS se FROM (
        SELECT g, sum(CASE WHEN variant IN ('A5', 'A1') THEN aurc WHEN variant IN ('A7', 'A4') THEN -aurc ELSE 0 END) AS d FROM fx_var_jack GROUP BY 1)) j""",
  "delta_aurc", "se"))
def interaction_interval(spark, sf_dir):
    rows = variant_rows(spark, sf_dir)
    se = ab.area_jackknife(rows, {"interaction": {"A5": 1, "A7": -1, "A4": -1, "A1": 1}}, item_group())
    return lawful(ab.interaction_interval(rows).join(se, "statistic"), "delta_aurc", "se").drop("includes_zero")


@query("progression", r6("""
SELECT CAST(i AS INTEGER) AS step, system, count(*) AS n, avg(z) AS adequacy, avg(gain) AS delta FROM (
  SELECT v.* FROM (
    SELECT b1.z_winner AS z1, b2.z AS z2, h.z_winner AS z3, CASE WHEN d.abstained THEN 0 ELSE d.z_winner END AS z4
    FROM (SELECT p.item_id, p.z AS z_winner FROM fx_fpanel p
          JOIN (SELECT exec_k, agent_id FROM (SELECT *, row_number() OVER (PARTITION BY exec_k ORDER BY alpha DESC, agent_id) AS rn
                FROM fx_weights) WHERE rn = 1) b ON b.exec_k = p.fold_k AND b.agent_id = p.agent_id) b1
    JOIN (SELECT item_id, z FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY weight * conf DESC, weight DESC, agent_id DESC) AS rn
          FROM fx_scored WHERE role = 'test') WHERE rn = 1) b2 USING (item_id)
    JOIN fx_heads h ON h.item_id = b1.item_id AND h.role = 'test'
    JOIN fx_decisions d ON d.item_id = b1.item_id AND d.c_min = 0.7) s
  CROSS JOIN LATERAL (VALUES (0, 'B1', z1, NULL), (1, 'B2', z2, z2 - z1), (2, 'B3', z3, z3 - z2), (3, 'Full', z4, z4 - z3)) v(i, system, z, gain))
GROUP BY 1, 2""", "adequacy", "delta"))
def progression(spark, sf_dir):
    panel, roles = fx.folded_panel(spark, sf_dir), fx.roles(spark)
    _, full = dec.cross_fitted_decisions(panel, roles, [0.7])
    paired = ab.progression(
        {
            "B1": dec.baseline_best_agent(panel, roles),
            "B2": dec.baseline_raw(panel, roles),
            "B3": dec.baseline_calibrated(panel, roles),
            "Full": full,
        }
    )
    return ab.progression_deltas(paired, ["B1", "B2", "B3", "Full"])


# Audit -----------------------------------------------------------------------------------------

_METRIC_SQL = """
SELECT {group}, CAST(sum(w) AS DOUBLE) AS n, CAST(sum(t * w) AS DOUBLE) AS refusals_selected, CAST(sum(a * t * w) AS DOUBLE) AS refusals_released,
  sum(a * w) / sum(w) AS nominal_coverage, sum(r * w) / sum(w) AS effective_coverage,
  sum(a * e * w) / nullif(sum(a * w), 0) AS conventional_risk, sum(r * e * w) / nullif(sum(r * w), 0) AS substantive_risk,
  sum((1 - a) * e * w) / nullif(sum((1 - a) * w), 0) AS abstention_error_precision,
  sum((1 - a) * e * w) / nullif(sum(e * w), 0) AS abstention_error_recall,
  sum((1 - a) * z * w) / nullif(sum(z * w), 0) AS false_abstention_rate,
  sum((1 - a) * k0 * w) / nullif(sum((1 - a) * w), 0) AS abstention_context_precision_strict,
  sum((1 - a) * k01 * w) / nullif(sum((1 - a) * w), 0) AS abstention_context_precision_broad,
  sum((1 - r) * k0 * w) / nullif(sum((1 - r) * w), 0) AS nonresponse_context_precision_strict,
  sum((1 - r) * k01 * w) / nullif(sum((1 - r) * w), 0) AS nonresponse_context_precision_broad,
  sum((1 - a) * k0 * w) / nullif(sum(k0 * w), 0) AS abstention_given_insufficient,
  sum((1 - a) * k1 * w) / nullif(sum(k1 * w), 0) AS abstention_given_partial,
  sum((1 - a) * k2 * w) / nullif(sum(k2 * w), 0) AS abstention_given_sufficient,
  sum(r * z * w) / sum(w) AS conventional_utility, sum((r * z + (1 - r) * e) * w) / sum(w) AS effective_error_utility,
  sum(((1 - a) * k0 + a * (t2 + (1 - t) * z)) * w) / sum(w) AS context_utility_strict,
  sum(((1 - a) * k01 + a * (t12 + (1 - t) * z)) * w) / sum(w) AS context_utility_broad,
  sum(((1 - a) * k0 + a * (t2 + (1 - t) * z)) * w) / sum(w) - sum(r * z * w) / sum(w) AS context_penalty_strict,
  sum(((1 - a) * k01 + a * (t12 + (1 - t) * z)) * w) / sum(w) - sum(r * z * w) / sum(w) AS context_penalty_broad
FROM (
  SELECT q.*, a * (1 - t) AS r, 1 - z AS e, CASE WHEN k = 0 THEN 1 ELSE 0 END AS k0, CASE WHEN k <= 1 THEN 1 ELSE 0 END AS k01,
    CASE WHEN k = 1 THEN 1 ELSE 0 END AS k1, CASE WHEN k = 2 THEN 1 ELSE 0 END AS k2,
    CASE WHEN t = 1 AND v = 2 THEN 1 ELSE 0 END AS t2, CASE WHEN t = 1 AND v IN (1, 2) THEN 1 ELSE 0 END AS t12
  FROM ({rows}) q)
GROUP BY {group}
"""
_METRIC_COLUMNS = [
    "n", "refusals_selected", "refusals_released", "nominal_coverage", "effective_coverage", "conventional_risk",
    "substantive_risk", "abstention_error_precision", "abstention_error_recall", "false_abstention_rate",
    "abstention_context_precision_strict", "abstention_context_precision_broad",
    "nonresponse_context_precision_strict", "nonresponse_context_precision_broad", "abstention_given_insufficient",
    "abstention_given_partial", "abstention_given_sufficient", "conventional_utility", "effective_error_utility",
    "context_utility_strict", "context_utility_broad", "context_penalty_strict", "context_penalty_broad",
]


def audit_items(spark, sf_dir):
    """Item x variant table with the auditor's verdict and the sufficiency of the context."""
    rows = variant_rows(spark, sf_dir).withColumnsRenamed({"z": "z_winner", "refused": "textual_refusal"})
    with_verdict = au.attach_verdicts(rows, fx.refusal_audit(spark, sf_dir))
    suff = fx.sufficiency(spark, sf_dir).withColumnRenamed("verdict", "context_sufficiency")
    return with_verdict.join(suff, "item_id")


@query("decision_metrics_by_coverage", r6(_METRIC_SQL.format(group="variant, target_coverage", rows="""
SELECT i.variant, c.target_coverage, least(greatest((c.target_coverage * l.total - l.n0) / l.n, 0), 1) AS a, i.z,
       CAST(i.refused AS INTEGER) AS t, u.refusal_verdict AS v, s.verdict AS k, 1 AS w
FROM fx_variants i JOIN fx_var_levels l ON l.variant = i.variant AND l.score = i.score
CROSS JOIN (SELECT CAST(c AS DOUBLE) AS target_coverage FROM (VALUES (0.3), (0.5), (0.7), (0.9), (1.0)) v(c)) c
JOIN fx_sufficiency s ON s.item_id = i.item_id
LEFT JOIN fx_audit u ON u.item_id = i.item_id AND u.agent_id = i.agent_chosen"""), *_METRIC_COLUMNS))
def decision_metrics_by_coverage(spark, sf_dir):
    return au.metrics_by_coverage(materialise(audit_items(spark, sf_dir)), C.AUDIT_COVERAGES)


@query("operating_point", r6(_METRIC_SQL.format(group="c_min", rows="""
SELECT d.c_min, CASE WHEN d.abstained THEN 0 ELSE 1 END AS a, d.z_winner AS z, CAST(p.refused AS INTEGER) AS t,
       u.refusal_verdict AS v, s.verdict AS k, 1 AS w
FROM fx_decisions d JOIN fx_panel p ON p.item_id = d.item_id AND p.agent_id = d.agent_chosen
JOIN fx_sufficiency s ON s.item_id = d.item_id
LEFT JOIN fx_audit u ON u.item_id = d.item_id AND u.agent_id = d.agent_chosen"""), *_METRIC_COLUMNS))
def operating_point(spark, sf_dir):
    panel = fx.folded_panel(spark, sf_dir)
    _, decided = dec.cross_fitted_decisions(panel, fx.roles(spark), fx.C_MINS)
    refused = panel.select(
        "item_id", F.col("agent_id").alias("agent_chosen"), F.col("refused").alias("textual_refusal")
    )
    suff = fx.sufficiency(spark, sf_dir).withColumnRenamed("verdict", "context_sufficiency")
    rows = au.attach_verdicts(
        decided.join(refused, ["item_id", "agent_chosen"]), fx.refusal_audit(spark, sf_dir)
    )
    return au.operating_point(rows.join(suff, "item_id"), ["c_min"])


@query("unaudited_refusals", with_ctes("""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE i.refused AND u.refusal_verdict IS NULL) AS n_unaudited
FROM fx_variants i LEFT JOIN fx_audit u ON u.item_id = i.item_id AND u.agent_id = i.agent_chosen"""))
def unaudited_refusals(spark, sf_dir):
    rows = materialise(audit_items(spark, sf_dir))
    missing = au.unaudited_refusals(rows).agg(F.count("*"))
    return rows.agg(F.count("*").alias("n_rows")).withColumn("n_unaudited", missing.scalar())


@query("justified_agreement", r6("""
SELECT count(*) AS n, avg(CASE WHEN (refusal_verdict = 2) = (verdict = 0) THEN 1 ELSE 0 END) AS agreement,
       avg(CASE WHEN verdict = 0 THEN 1 ELSE 0 END) AS insufficient_share,
       avg(CASE WHEN verdict IN (0, 1) THEN 1 ELSE 0 END) AS not_sufficient_share
FROM fx_audit JOIN fx_sufficiency USING (item_id)""", "agreement", "insufficient_share", "not_sufficient_share"))
def justified_agreement(spark, sf_dir):
    return au.justified_agreement(fx.refusal_audit(spark, sf_dir), fx.sufficiency(spark, sf_dir))


@query("adequacy_by_sufficiency", r6("""
SELECT c_min, verdict, count(*) AS n, avg(z_winner) AS adequacy, avg(eta) AS mean_eta,
       avg(CASE WHEN abstained THEN 0 ELSE 1 END) AS coverage
FROM fx_mean_decisions JOIN fx_sufficiency USING (item_id) GROUP BY 1, 2""", "adequacy", "mean_eta", "coverage"))
def adequacy_by_sufficiency(spark, sf_dir):
    decided = mean_decisions(spark, sf_dir)
    return au.adequacy_by_sufficiency(decided, fx.sufficiency(spark, sf_dir), ["c_min"])


# Diversity -------------------------------------------------------------------------------------

@query("error_concordance", r6("""
SELECT a.agent_id AS agent_i, b.agent_id AS agent_j,
       CASE WHEN sum(1 - a.z) > 0 THEN CAST(sum((1 - a.z) * (1 - b.z)) AS DOUBLE) / sum(1 - a.z) END AS p_j_given_i
FROM fx_panel a JOIN fx_panel b USING (item_id) GROUP BY 1, 2""", "p_j_given_i"))
def error_concordance(spark, sf_dir):
    return dv.error_concordance(fx.panel(spark, sf_dir))


@query("concordance_display", r6("""
SELECT a.agent_id AS agent_i, b.agent_id AS agent_j,
       CASE WHEN a.agent_id = b.agent_id THEN avg(1 - a.z)
            ELSE CAST(sum((1 - a.z) * (1 - b.z)) AS DOUBLE) / sum(1 - a.z) END AS p_j_given_i
FROM fx_panel a JOIN fx_panel b USING (item_id) GROUP BY 1, 2""", "p_j_given_i"))
def concordance_display(spark, sf_dir):
    panel = fx.panel(spark, sf_dir)
    return dv.concordance_display(dv.error_concordance(panel), panel)


_RHO = """
SELECT {g} n, observed, r1 * r2 * r3 AS expected, observed / (r1 * r2 * r3) AS rho FROM (
  SELECT {g} count(*) AS n, avg(CASE WHEN z1 + z2 + z3 = 0 THEN 1 ELSE 0 END) AS observed,
         avg(1 - z1) AS r1, avg(1 - z2) AS r2, avg(1 - z3) AS r3
  FROM (SELECT item_id, max(CASE WHEN agent_id = 1 THEN z END) AS z1, max(CASE WHEN agent_id = 2 THEN z END) AS z2,
               max(CASE WHEN agent_id = 3 THEN z END) AS z3 FROM fx_panel GROUP BY 1) JOIN fx_sufficiency USING (item_id)
  {by})
"""


@query("all_wrong_ratio", r6(_RHO.format(g="", by=""), "observed", "expected", "rho"))
def all_wrong_ratio(spark, sf_dir):
    return dv.all_wrong_ratio(fx.panel(spark, sf_dir))


@query("all_wrong_ratio_by_sufficiency", r6(_RHO.format(g="verdict,", by="GROUP BY verdict"), "observed", "expected", "rho"))
def all_wrong_ratio_by_sufficiency(spark, sf_dir):
    panel = fx.panel(spark, sf_dir).join(fx.sufficiency(spark, sf_dir), "item_id")
    return dv.all_wrong_ratio(panel, ["verdict"])


@query("conditional_rho", r6(f"""
SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * observed) / sum(n) AS observed, sum(n * expected) / sum(n) AS expected_conditional,
       (sum(n * observed) / sum(n)) / (sum(n * expected) / sum(n)) AS rho_conditional
FROM ({_RHO.format(g="verdict,", by="GROUP BY verdict")})""", "observed", "expected_conditional", "rho_conditional"))
def conditional_rho(spark, sf_dir):
    panel = fx.panel(spark, sf_dir).join(fx.sufficiency(spark, sf_dir), "item_id")
    return dv.conditional_rho(panel, "verdict")


@query("winners_curse", r6("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY conf DESC, agent_id) = 1 AS chosen FROM fx_panel),
m AS (SELECT avg(c) AS m FROM (SELECT avg(conf) AS c FROM fx_panel GROUP BY item_id))
SELECT avg(CASE WHEN chosen THEN conf - z END) AS bias_selected, avg(CASE WHEN NOT chosen THEN conf - z END) AS bias_not_selected,
       avg(CASE WHEN chosen THEN conf - z END) - avg(CASE WHEN NOT chosen THEN conf - z END) AS difference,
       avg(CASE WHEN chosen THEN conf END) AS mean_max_conf, max(m) AS mean_mean_conf, avg(CASE WHEN chosen THEN z END) AS z_selected,
       avg(CASE WHEN chosen THEN conf - z END) AS overestimate_max, max(m) - avg(CASE WHEN chosen THEN z END) AS overestimate_mean
FROM r CROSS JOIN m""", "bias_selected", "bias_not_selected", "difference", "mean_max_conf", "mean_mean_conf", "z_selected",
  "overestimate_max", "overestimate_mean"))
def winners_curse(spark, sf_dir):
    return dv.winners_curse(fx.panel(spark, sf_dir))


@query("conditioned_selection", r6("""
SELECT count(*) AS n, avg(h.z_winner) AS rate_a, avg(b.z) AS rate_b, avg(h.z_winner - b.z) AS difference
FROM fx_mean_head h JOIN (SELECT item_id FROM fx_panel GROUP BY 1 HAVING min(z) <> max(z)) d USING (item_id)
JOIN fx_panel b ON b.item_id = h.item_id
 AND b.agent_id = (SELECT agent_id FROM fx_panel GROUP BY 1 ORDER BY avg(z) DESC, agent_id LIMIT 1)""",
  "rate_a", "rate_b", "difference"))
def conditioned_selection(spark, sf_dir):
    panel = fx.panel(spark, sf_dir)
    fixed = panel.where(F.col("agent_id") == dec.retrospective_best_agent(panel).select("agent_id").scalar())
    return dv.conditioned_selection(
        panel, dec.mean_confidence_head(panel, ["item_id"]), fixed.withColumnRenamed("z", "z_winner")
    )


@query("oracle_any_correct", r6("""
SELECT (SELECT avg(b) FROM (SELECT max(z) AS b FROM fx_panel GROUP BY item_id)) AS any_correct,
       (SELECT max(b) FROM (SELECT avg(z) AS b FROM fx_panel GROUP BY agent_id)) AS best_single""", "any_correct", "best_single"))
def oracle_any_correct(spark, sf_dir):
    return dv.any_correct(fx.panel(spark, sf_dir))


@query("auroc_by_stratum", r6("""
WITH d AS (SELECT has_doc_ref, eta, 1 - z_winner AS e FROM fx_mean_head),
l AS (SELECT has_doc_ref, eta, count(*) AS n, sum(e) AS s FROM d GROUP BY 1, 2),
c AS (SELECT *, coalesce(sum(n - s) OVER (PARTITION BY has_doc_ref ORDER BY eta ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM l)
SELECT has_doc_ref, CAST(sum(n) AS BIGINT) AS n, sum(s * (below + (n - s) / 2.0)) / (CAST(sum(s) AS DOUBLE) * sum(n - s)) AS auroc
FROM c GROUP BY 1""", "auroc"))
def auroc_by_stratum(spark, sf_dir):
    heads = dec.mean_confidence_head(fx.panel(spark, sf_dir), ["item_id", "has_doc_ref"])
    return sel.auroc(heads, ["has_doc_ref"], "eta", 1 - F.col("z_winner"))


# Gates -----------------------------------------------------------------------------------------

@query("duplicate_key_gate", with_ctes("""
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"""))
def duplicate_key_gate(spark, sf_dir):
    return gt.duplicate_keys(fx.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("id_set_gate", with_ctes("""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right_only' ELSE 'left_only' END AS side
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL"""))
def id_set_gate(spark, sf_dir):
    return gt.id_set_difference(fx.table(spark, sf_dir, "documents"), fx.table(spark, sf_dir, "labels"), "doc_id")


@query("domain_gate", with_ctes("""
SELECT v.rule, v.n_violations FROM (
  SELECT count(*) FILTER (WHERE NOT coalesce(z IN (0, 1), false)) AS a,
         count(*) FILTER (WHERE NOT coalesce(conf_raw BETWEEN 0 AND 1, false)) AS b,
         count(*) FILTER (WHERE NOT coalesce(conf BETWEEN 0 AND 1, false)) AS c FROM fx_panel)
CROSS JOIN LATERAL (VALUES ('binary_label', a), ('raw_confidence', b), ('used_confidence', c)) v(rule, n_violations)"""))
def domain_gate(spark, sf_dir):
    return gt.domain_violations(
        fx.panel(spark, sf_dir),
        {
            "binary_label": F.col("z").isin(0, 1),
            "raw_confidence": F.col("conf_raw").between(0, 1),
            "used_confidence": F.col("conf").between(0, 1),
        },
    )


@query("agent_size_gate", with_ctes("""
SELECT CAST(l_linenumber AS INTEGER) AS agent_id, count(*) AS n FROM lineitem GROUP BY 1
HAVING count(*) <> (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_linenumber))"""))
def agent_size_gate(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("agent_id"))
    return gt.unequal_sizes(rows, "agent_id")


@query("reproduction_gate", with_ctes("""
SELECT (SELECT count(*) FROM fx_variants WHERE variant = 'A0') AS n_items, count(*) AS n_mismatches
FROM fx_variants v JOIN fx_heads h ON h.item_id = v.item_id AND h.role = 'test' AND v.variant = 'A0'
WHERE v.agent_chosen <> h.agent_chosen OR abs(v.score - (1 - h.eta)) > 1e-8 + 1e-5 * abs(1 - h.eta)"""))
def reproduction_gate(spark, sf_dir):
    panel = fx.folded_panel(spark, sf_dir)
    stored = dec.baseline_calibrated(panel, fx.roles(spark)).withColumn("score", 1 - F.col("eta"))
    scored = ab.scored_test_panel(panel, fx.roles(spark))
    ours = materialise(ab.variants(scored, names=["A0"]))
    bad = gt.reproduction_mismatches(ours, stored, "item_id").agg(F.count("*"))
    return ours.agg(F.count("*").alias("n_items")).withColumn("n_mismatches", bad.scalar())


@query("golden_drift", r6("""
SELECT agent_id, golden, value, abs(value - golden) AS delta FROM (
  SELECT agent_id, avg(z) AS value, avg(CASE WHEN o.o_orderdate < TIMESTAMP '1998-01-01' THEN z END) AS golden
  FROM fx_panel JOIN orders o ON o.o_orderkey = item_id GROUP BY 1)
WHERE abs(value - golden) > 0.001""", "golden", "value", "delta"))
def golden_drift(spark, sf_dir):
    panel = fx.panel(spark, sf_dir)
    early = fx.table(spark, sf_dir, "orders").where("o_orderdate < timestamp '1998-01-01'")
    early = early.select(F.col("o_orderkey").alias("item_id"))
    stored = panel.join(early, "item_id", "left_semi").groupBy("agent_id").agg(F.avg("z").alias("value"))
    now = panel.groupBy("agent_id").agg(F.avg("z").alias("value"))
    return gt.golden_drift(now, stored, ["agent_id"])
