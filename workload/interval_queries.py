"""Queries for the intervals of summary tables; points are checked by SQL, bounds must hold them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorate.operators import decisions as dec
from quorate.operators import intervals as iv
from quorate.operators import panel as pn
from workload import fixtures as fx
from workload.comparison_queries import REPLICAS, SIDES, holding
from workload.ctes import r6
from workload.metric_queries import mean_decisions
from workload.registry import query

_EXACT = f"CAST({REPLICAS} AS BIGINT) AS n_resamples, CAST(0 AS BIGINT) AS n_dropped, true AS holds"


@query("sufficiency_intervals", r6(f"""
SELECT v.statistic, v.point, {_EXACT} FROM (
  SELECT avg(CASE WHEN verdict = 2 THEN 1 ELSE 0 END) AS a, avg(CASE WHEN verdict = 1 THEN 1 ELSE 0 END) AS b,
         avg(CASE WHEN verdict = 0 THEN 1 ELSE 0 END) AS c FROM fx_sufficiency)
CROSS JOIN LATERAL (VALUES ('share_sufficient', a), ('share_partial', b), ('share_insufficient', c)) v(statistic, point)""", "point"))
def sufficiency_intervals(spark, sf_dir):
    return holding(iv.verdict_share_intervals(fx.sufficiency(spark, sf_dir), None, REPLICAS), "point")


@query("variant_intervals", r6(f"""
SELECT coalesce('z_' || agent_id, 'mean_over_agents') AS statistic, avg(z) AS point, {_EXACT}
FROM fx_panel GROUP BY GROUPING SETS ((agent_id), ())""", "point"))
def variant_intervals(spark, sf_dir):
    panel = fx.panel(spark, sf_dir)
    wide = pn.item_rollup(panel, fx.AGENTS, ["z"]).join(fx.items(spark, sf_dir), "item_id")
    return holding(iv.variant_intervals(wide, [f"z_{a}" for a in fx.AGENTS], "has_doc_ref", REPLICAS), "point")


@query("arm_intervals", r6(f"""
SELECT v.statistic, avg(v.d) AS point, {_EXACT} FROM (
  SELECT o.z_mean AS o, n.z_mean AS n, p.z_mean AS p FROM fx_side_old o JOIN fx_side_new n USING (item_id) JOIN fx_side_api p USING (item_id))
CROSS JOIN LATERAL (VALUES ('api - new', p - n), ('new - old', n - o), ('api - old', p - o)) v(statistic, d) GROUP BY 1""", "point"))
def arm_intervals(spark, sf_dir):
    arms = fx.items(spark, sf_dir)
    for name, lines in SIDES.items():
        one = pn.item_rollup(fx.panel(spark, sf_dir, *lines), fx.AGENTS, ["z"])
        arms = arms.join(one.select("item_id", F.col("z_mean").alias(name)), "item_id")
    pairs = [("api", "new"), ("new", "old"), ("api", "old")]
    return holding(iv.arm_intervals(arms, pairs, "has_doc_ref", REPLICAS), "point")


@query("selection_intervals", r6(f"""
SELECT v.statistic, v.point, {_EXACT} FROM (
  SELECT avg(h.z_winner) AS a, avg(b.z) AS b, avg(h.z_winner - b.z) AS d
  FROM fx_mean_head h JOIN (SELECT item_id FROM fx_panel GROUP BY 1 HAVING min(z) <> max(z)) s USING (item_id)
  JOIN fx_panel b ON b.item_id = h.item_id AND b.agent_id = (SELECT agent_id FROM fx_panel GROUP BY 1 ORDER BY avg(z) DESC, agent_id LIMIT 1))
CROSS JOIN LATERAL (VALUES ('rate_a', a), ('rate_b', b), ('difference', d)) v(statistic, point)""", "point"))
def selection_intervals(spark, sf_dir):
    panel = fx.panel(spark, sf_dir)
    fixed = panel.where(F.col("agent_id") == dec.retrospective_best_agent(panel).select("agent_id").scalar())
    head = dec.mean_confidence_head(panel, ["item_id", "has_doc_ref"])
    found = iv.selection_intervals(panel, head, fixed.withColumnRenamed("z", "z_winner"), "has_doc_ref", REPLICAS)
    return holding(found, "point")


@query("bias_intervals", r6(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY conf DESC, agent_id) = 1 AS chosen FROM fx_panel)
SELECT v.statistic, v.point, {_EXACT} FROM (
  SELECT avg(CASE WHEN chosen THEN conf - z END) AS a, avg(CASE WHEN NOT chosen THEN conf - z END) AS b FROM r)
CROSS JOIN LATERAL (VALUES ('bias_selected', a), ('bias_not_selected', b), ('difference', a - b)) v(statistic, point)""", "point"))
def bias_intervals(spark, sf_dir):
    return holding(iv.bias_intervals(fx.panel(spark, sf_dir), REPLICAS), "point")


@query("system_intervals", r6(f"""
SELECT s.system, v.statistic, v.point, CAST({REPLICAS} AS BIGINT) AS n_resamples, v.point IS NOT NULL AS holds FROM (
  SELECT system, avg(1 - a) AS c, sum((1 - a) * e) / sum(1 - a) AS r, avg((1 - a) * (1 - e)) AS u, CASE WHEN sum(a) > 0 THEN sum(a * e) / CAST(sum(a) AS DOUBLE) END AS p,
         avg(e) AS b, CAST(sum(a) AS DOUBLE) AS k,
         CASE WHEN count(eta) = count(*) THEN sum(e * (below + ties / 2.0)) / (CAST(sum(e) AS DOUBLE) * sum(1 - e)) END AS auc
  FROM (SELECT *, coalesce(sum(1 - e) OVER (PARTITION BY system ORDER BY eta RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
                  - sum(1 - e) OVER (PARTITION BY system, eta) AS below, sum(1 - e) OVER (PARTITION BY system, eta) AS ties
        FROM (SELECT 'c_min ' || c_min AS system, CAST(abstained AS INTEGER) AS a, 1 - z_winner AS e, eta FROM fx_mean_decisions
              UNION ALL SELECT 'agent 1', 0, 1 - z, NULL FROM fx_panel WHERE agent_id = 1)) GROUP BY 1) s
CROSS JOIN LATERAL (VALUES ('coverage', c), ('risk_selective', r), ('adequacy_useful', u), ('precision_abstention', p), ('base_rate_inadequacy', b),
  ('lift_pp', (p - b) * 100), ('n_abstentions', k), ('auroc', auc)) v(statistic, point)""", "point"))
def system_intervals(spark, sf_dir):
    """Decision summary of three thresholded systems and of one agent that never abstains."""
    decided = mean_decisions(spark, sf_dir).select(
        F.concat(F.lit("c_min "), F.col("c_min").cast("string")).alias("system"), "has_doc_ref",
        F.col("abstained").cast("int").alias("abst"), F.col("z_winner").alias("z"), "eta",
    )
    always = fx.panel(spark, sf_dir).where("agent_id = 1").select(F.lit("agent 1").alias("system"), "has_doc_ref", F.lit(0).alias("abst"), "z", F.lit(None).cast("double").alias("eta"))
    return holding(iv.system_intervals(decided.unionByName(always), "system", "has_doc_ref", REPLICAS), "point").drop("n_dropped")
