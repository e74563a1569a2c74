"""Queries for bootstrap intervals, human agreement and pipeline comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorate.functions import constants as C
from quorate.functions.rand import draw_unit
from quorate.operators import ablation as ab
from quorate.operators import agreement as ag
from quorate.operators import audit as au
from quorate.operators import bootstrap as bs
from quorate.operators import comparison as cp
from quorate.operators import decisions as dec
from quorate.operators import panel as pn
from quorate.operators import replica_curves as rc
from quorate.session import materialise
from workload import fixtures as fx
from workload.ctes import cte, r6, with_ctes
from workload.metric_queries import _METRIC_SQL, audit_items, item_group, lawful, mean_decisions, variant_rows
from workload.decision_queries import _strata
from workload.registry import query

REPLICAS = 10_000
KAPPA_REPLICAS = 4_000

# Bootstrap ---------------------------------------------------------------------------------------
#
# Draws differ between engines, so these queries return what is exact (points, numbers of replicas) and
# whether the interval holds its point; tests/test_bootstrap.py holds the bounds against NumPy.


def holding(df, point=None):
    """Interval columns replaced by ``holds``: bounds are in order, and around ``point`` where there is one."""
    lo, hi = F.col("ci_lo") - 1e-9, F.col("ci_hi") + 1e-9
    ok = lo <= hi if point is None else (lo <= F.col(point)) & (F.col(point) <= hi)
    return df.withColumn("holds", F.coalesce(ok, F.lit(False))).drop("ci_lo", "ci_hi")


def operating_cells(spark, sf_dir):
    decided = mean_decisions(spark, sf_dir).where("c_min = 0.7")
    return decided.select(
        "has_doc_ref", F.col("abstained").cast("int").alias("abst"), F.col("z_winner").alias("z")
    )


def statistics():
    """Numerator and denominator of each metric per row."""
    abst, error = F.col("abst"), 1 - F.col("z")
    return {
        "coverage": (1 - abst, F.lit(1)),
        "selective_risk": ((1 - abst) * error, 1 - abst),
        "adequacy_useful": ((1 - abst) * F.col("z"), F.lit(1)),
        "abstention_precision": (abst * error, abst),
    }


_POINTS = """
SELECT v.statistic, v.point{more} FROM (
  SELECT avg(1 - a) AS cov, sum((1 - a) * (1 - z)) / sum(1 - a) AS risk, avg((1 - a) * z) AS useful, sum(a * (1 - z)) / sum(a) AS prec
  FROM (SELECT CAST(abstained AS INTEGER) AS a, z_winner AS z FROM fx_mean_decisions WHERE c_min = 0.7))
CROSS JOIN LATERAL (VALUES ('coverage', cov), ('selective_risk', risk), ('adequacy_useful', useful), ('abstention_precision', prec)) v(statistic, point)"""


@query("bootstrap_percentile", r6(_POINTS.format(more=", CAST(10000 AS BIGINT) AS n_resamples, CAST(0 AS BIGINT) AS n_dropped, true AS holds"), "point"))
def bootstrap_percentile(spark, sf_dir):
    stats = {name: bs.weighted_ratio(n, d) for name, (n, d) in statistics().items()}
    return holding(
        bs.interval_table(operating_cells(spark, sf_dir), "has_doc_ref", ["abst", "z"], stats, REPLICAS), "point"
    )


@query("bootstrap_bca", r6(_POINTS.format(more=", CAST(0 AS BIGINT) AS n_dropped, true AS holds"), "point"))
def bootstrap_bca(spark, sf_dir):
    found = bs.bca_interval(operating_cells(spark, sf_dir), "has_doc_ref", ["abst", "z"], statistics(), REPLICAS)
    return holding(found, "point").drop("acceleration")


@query("bootstrap_mean_law", r6("""
SELECT agent_id, avg(z) AS adequacy, CAST(10000 AS BIGINT) AS n_resamples, true AS lower_as_normal, true AS upper_as_normal
FROM fx_panel GROUP BY 1""", "adequacy"))
def bootstrap_mean_law(spark, sf_dir):
    """Interval of each agent's adequacy against the normal interval of a stratified mean: both
    bounds must agree within a quarter of the standard error."""
    panel = fx.panel(spark, sf_dir).select(
        "agent_id", F.concat_ws("|", "agent_id", "has_doc_ref").alias("g"), "z"
    )
    cells = materialise(bs.compress(panel, "g", ["agent_id", "z"]))
    rows = bs.replica_rows(bs.replica_weights(cells, ["agent_id", "z"], REPLICAS))
    means = rows.groupBy("agent_id", "replica").agg(bs.weighted_mean(F.col("z")).alias("m"))
    bounds = means.groupBy("agent_id").agg(
        F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("*").alias("n_resamples")
    )
    n_s, p_s = F.sum("_n"), F.sum(F.col("_n") * F.col("z")) / F.sum("_n")
    strata = cells.groupBy("agent_id", "_s").agg(n_s.alias("n"), p_s.alias("p"))
    law = strata.groupBy("agent_id").agg(
        (F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("adequacy"),
        (F.sqrt(F.sum(F.col("n") * F.col("p") * (1 - F.col("p")))) / F.sum("n")).alias("se"),
    )
    near = lambda bound, z: F.abs(bound - (F.col("adequacy") + z * F.col("se"))) < F.col("se") / 4
    return law.join(bounds, "agent_id").select(
        "agent_id",
        "adequacy",
        "n_resamples",
        near(F.col("q")[0], -1.959964).alias("lower_as_normal"),
        near(F.col("q")[1], 1.959964).alias("upper_as_normal"),
    )


@query("bootstrap_paired_delta", r6("""
SELECT avg(p.z) AS mean_a, avg(h.z_winner) AS mean_b, avg(h.z_winner - p.z) AS delta, CAST(10000 AS BIGINT) AS n_resamples, true AS holds
FROM fx_mean_head h JOIN fx_panel p ON p.item_id = h.item_id AND p.agent_id = 1""", "mean_a", "mean_b", "delta"))
def bootstrap_paired_delta(spark, sf_dir):
    panel = fx.panel(spark, sf_dir)
    fixed = panel.where("agent_id = 1").select("item_id", F.col("z").alias("a"))
    head = dec.mean_confidence_head(panel, ["item_id", "has_doc_ref"]).withColumnRenamed("z_winner", "b")
    found = bs.paired_delta(head.join(fixed, "item_id"), "a", "b", "has_doc_ref", REPLICAS)
    return holding(found, "delta").drop("includes_zero")


def paired_scores(spark, sf_dir, a, b):
    rows = variant_rows(spark, sf_dir).where(F.col("variant").isin(a, b))
    pick = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    return rows.groupBy("item_id", "has_doc_ref").agg(
        pick(a, "score").alias("score_a"), pick(a, "z").alias("z_a"),
        pick(b, "score").alias("score_b"), pick(b, "z").alias("z_b"),
    )


@query("bootstrap_aurc", r6("""
SELECT 'delta_aurc' AS statistic, a.aurc - b.aurc AS point, CAST(10000 AS BIGINT) AS n_resamples, CAST(0 AS BIGINT) AS n_dropped, j.se,
       true AS lower_as_normal, true AS upper_as_normal
FROM fx_var_aurc a JOIN fx_var_aurc b ON a.variant = 'A5' AND b.variant = 'A7' JOIN fx_pair_jack j ON j.a = 'A5' AND j.b = 'A7'""", "point", "se"))
def bootstrap_aurc(spark, sf_dir):
    paired = materialise(paired_scores(spark, sf_dir, "A5", "A7"))
    rows = paired.select("item_id", F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"score_{k}").alias("score"), F.col(f"z_{k}").alias("z")) for k, v in (("a", "A5"), ("b", "A7"))])))
    se = ab.area_jackknife(rows, {"delta_aurc": {"A5": 1, "A7": -1}}, item_group())
    return lawful(rc.paired_area_delta(paired, "has_doc_ref", REPLICAS).join(se, "statistic"), "point", "se")


def _contrast_sql(metrics: str, pairs, names, extra: str = "", more: str = "") -> str:
    """Differences of the metrics of two variants from a statement with a row per variant (and ``extra`` column)."""
    listed = ", ".join(f"('{m}', x.{m} - y.{m})" for m in names)
    both = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    same = f" AND y.{extra} = x.{extra}" if extra else ""
    column = f"x.{extra}, " if extra else ""
    return f"""
SELECT p.a, p.b, {column}v.metric, v.d AS delta_a_minus_b, {more}true AS holds
FROM (VALUES {both}) p(a, b) JOIN ({metrics}) x ON x.variant = p.a JOIN ({metrics}) y ON y.variant = p.b{same}
CROSS JOIN LATERAL (VALUES {listed}) v(metric, d)"""


_BY_COVERAGE = _METRIC_SQL.format(group="variant, target_coverage", rows="""
SELECT i.variant, c.target_coverage, least(greatest((c.target_coverage * l.total - l.n0) / l.n, 0), 1) AS a, i.z,
       CAST(i.refused AS INTEGER) AS t, u.refusal_verdict AS v, s.verdict AS k, 1 AS w
FROM fx_variants i JOIN fx_var_levels l ON l.variant = i.variant AND l.score = i.score
CROSS JOIN (SELECT CAST(c AS DOUBLE) AS target_coverage FROM (VALUES (0.3), (0.5), (0.7), (0.9), (1.0)) v(c)) c
JOIN fx_sufficiency s ON s.item_id = i.item_id
LEFT JOIN fx_audit u ON u.item_id = i.item_id AND u.agent_id = i.agent_chosen""")


@query("bootstrap_contrasts", r6(_contrast_sql(_BY_COVERAGE, C.CONTRAST_PAIRS, au.contrast_metrics("variants"), "target_coverage", "CAST(10000 AS BIGINT) AS n_resamples, "), "delta_a_minus_b"))
def bootstrap_contrasts(spark, sf_dir):
    items = materialise(audit_items(spark, sf_dir))
    found = bs.metric_contrasts(
        items, C.CONTRAST_PAIRS, C.AUDIT_COVERAGES, au.contrast_metrics("variants"), "has_doc_ref", REPLICAS
    )
    return holding(found, "delta_a_minus_b")


def stored_points(spark, sf_dir):
    """Two stored operating points: the full system and the minimal head, both at c_min 0.7."""
    panel = fx.folded_panel(spark, sf_dir)
    _, full = dec.cross_fitted_decisions(panel, fx.roles(spark), [0.7])
    cols = ["item_id", "has_doc_ref", "agent_chosen", "z_winner", "abstained"]
    head = mean_decisions(spark, sf_dir).where("c_min = 0.7")
    both = full.select(F.lit("full").alias("variant"), *cols).unionByName(
        head.select(F.lit("minimal").alias("variant"), *cols)
    )
    refused = panel.select(
        "item_id", F.col("agent_id").alias("agent_chosen"), F.col("refused").alias("textual_refusal")
    )
    suff = fx.sufficiency(spark, sf_dir).withColumnRenamed("verdict", "context_sufficiency")
    rows = au.attach_verdicts(both.join(refused, ["item_id", "agent_chosen"]), fx.refusal_audit(spark, sf_dir))
    p = F.when(F.col("abstained"), F.lit(0.0)).otherwise(F.lit(1.0))
    return materialise(rows.join(suff, "item_id").withColumn("p_respond", p))


_STORED = _METRIC_SQL.format(group="variant", rows="""
SELECT d.variant, CASE WHEN d.abstained THEN 0 ELSE 1 END AS a, d.z_winner AS z, CAST(p.refused AS INTEGER) AS t,
       u.refusal_verdict AS v, s.verdict AS k, 1 AS w
FROM (SELECT 'full' AS variant, item_id, agent_chosen, z_winner, abstained FROM fx_decisions WHERE c_min = 0.7
      UNION ALL SELECT 'minimal', item_id, agent_chosen, z_winner, abstained FROM fx_mean_decisions WHERE c_min = 0.7) d
JOIN fx_panel p ON p.item_id = d.item_id AND p.agent_id = d.agent_chosen
JOIN fx_sufficiency s ON s.item_id = d.item_id
LEFT JOIN fx_audit u ON u.item_id = d.item_id AND u.agent_id = d.agent_chosen""")


@query("bootstrap_point_contrasts", r6(_contrast_sql(_STORED, [("full", "minimal")], au.contrast_metrics("points")), "delta_a_minus_b"))
def bootstrap_point_contrasts(spark, sf_dir):
    found = bs.point_contrasts(
        stored_points(spark, sf_dir), [("full", "minimal")], au.contrast_metrics("points"), "has_doc_ref", REPLICAS
    )
    return holding(found, "delta_a_minus_b")


@query("bootstrap_rho", r6("""
SELECT 'rho' AS statistic, avg(e1 * e2 * e3) / (avg(e1) * avg(e2) * avg(e3)) AS point, CAST(10000 AS BIGINT) AS n_resamples,
       CAST(0 AS BIGINT) AS n_dropped, true AS holds FROM (
  SELECT item_id, 1 - max(CASE WHEN agent_id = 1 THEN z END) AS e1, 1 - max(CASE WHEN agent_id = 2 THEN z END) AS e2,
         1 - max(CASE WHEN agent_id = 3 THEN z END) AS e3 FROM fx_panel GROUP BY 1)""", "point"))
def bootstrap_rho(spark, sf_dir):
    """Unstratified interval of the all-wrong ratio, from label patterns of items."""
    wide = pn.item_rollup(fx.panel(spark, sf_dir), fx.AGENTS, ["z"])
    wrong = [1 - F.col(f"z_{a}") for a in fx.AGENTS]
    rates = [bs.weighted_mean(e) for e in wrong]
    rho = F.try_divide(bs.weighted_mean(wrong[0] * wrong[1] * wrong[2]), rates[0] * rates[1] * rates[2])
    return holding(bs.interval_table(wide, None, [f"z_{a}" for a in fx.AGENTS], {"rho": rho}, REPLICAS), "point")


# Human agreement -----------------------------------------------------------------------------------

cte("fx_annotations", """
SELECT item_id, agent_id, stratum, judge, refusal_verdict,
       CAST(CASE WHEN u < 0.02 THEN -1 WHEN u < 0.1 THEN 1 - judge ELSE judge END AS INTEGER) AS human,
       CASE WHEN u > 0.999 THEN 'revisar' ELSE '' END AS comment
FROM (
  SELECT p.item_id, p.agent_id, p.z AS judge, a.refusal_verdict,
         CASE WHEN a.refusal_verdict IS NOT NULL THEN 'recusa' WHEN p.z = 1 THEN 'adequada' ELSE 'inadequada' END AS stratum,
         CAST('0x' || substr(md5('7:' || p.item_id || ':' || p.agent_id), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u
  FROM fx_panel p LEFT JOIN fx_audit a USING (item_id, agent_id))
""")


def annotations(spark, sf_dir):
    rows = _strata(spark, sf_dir)
    key = F.concat_ws(":", F.col("item_id").cast("string"), F.col("agent_id").cast("string"))
    u, judge = draw_unit(key, 7), F.col("z")
    return rows.select(
        "item_id", "agent_id", "stratum", judge.alias("judge"), "refusal_verdict",
        F.when(u < 0.02, -1).when(u < 0.1, 1 - judge).otherwise(judge).alias("human"),
        F.when(u > 0.999, "revisar").otherwise("").alias("comment"),
    )


@query("judge_confusion", with_ctes("""
SELECT stratum, judge, human, count(*) AS n FROM fx_annotations GROUP BY 1, 2, 3"""))
def judge_confusion(spark, sf_dir):
    return ag.confusion(annotations(spark, sf_dir), ["stratum"])


@query("kappa", r6("""
SELECT n, po AS observed, pe AS expected, (po - pe) / (1 - pe) AS kappa FROM (
  SELECT count(*) AS n, avg(CASE WHEN judge = human THEN 1 ELSE 0 END) AS po,
         avg(judge) * avg(human) + (1 - avg(judge)) * (1 - avg(human)) AS pe
  FROM fx_annotations WHERE human >= 0)""", "observed", "expected", "kappa"))
def kappa(spark, sf_dir):
    return ag.cohen_kappa(annotations(spark, sf_dir))


@query("kappa_interval", r6("""
SELECT 'kappa' AS statistic, kappa AS point, CAST(4000 AS BIGINT) AS n_resamples, CAST(0 AS BIGINT) AS n_dropped,
       sqrt((p11 * (1 - (a + b) * (1 - kappa)) ** 2 + p00 * (1 - (2 - a - b) * (1 - kappa)) ** 2
             + (1 - kappa) ** 2 * (p10 * (b + 1 - a) ** 2 + p01 * (1 - b + a) ** 2) - (kappa - pe * (1 - kappa)) ** 2) / n) / (1 - pe) AS se,
       true AS lower_as_normal, true AS upper_as_normal
FROM (SELECT *, (p00 + p11 - pe) / (1 - pe) AS kappa FROM (
  SELECT *, a * b + (1 - a) * (1 - b) AS pe FROM (
    SELECT count(*) AS n, avg(judge) AS a, avg(human) AS b, avg(CASE WHEN judge = 1 AND human = 1 THEN 1 ELSE 0 END) AS p11,
           avg(CASE WHEN judge = 0 AND human = 0 THEN 1 ELSE 0 END) AS p00, avg(CASE WHEN judge = 1 AND human = 0 THEN 1 ELSE 0 END) AS p10,
           avg(CASE WHEN judge = 0 AND human = 1 THEN 1 ELSE 0 END) AS p01
    FROM fx_annotations WHERE human >= 0)))""", "point", "se"))
def kappa_interval(spark, sf_dir):
    rows = materialise(annotations(spark, sf_dir))
    law = ag.kappa_error(rows).select(F.lit("kappa").alias("statistic"), F.col("kappa").alias("point"), "se")
    return lawful(law.join(ag.kappa_interval(rows, KAPPA_REPLICAS), "statistic"), "point", "se")


# Bounds by halving, with the tail as the plain sum of its terms.
_AGREEMENT = """
WITH RECURSIVE agreement AS (
  SELECT stratum, count(*) AS n, count(*) FILTER (WHERE judge = human) AS k FROM fx_annotations WHERE human >= 0 GROUP BY 1
), halved AS (
  SELECT stratum, n, k, 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, t.first, t.target
  FROM agreement, LATERAL (VALUES (k, CAST(0.025 AS DOUBLE)), (k + 1, CAST(0.975 AS DOUBLE))) t(first, target)
  UNION ALL
  SELECT stratum, n, k, i + 1, CASE WHEN tail < target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN tail < target THEN hi ELSE (lo + hi) / 2 END, first, target
  FROM (SELECT *, list_sum(list_transform(range(first, n + 1), lambda j:
          exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((lo + hi) / 2) + (n - j) * ln(1 - (lo + hi) / 2)))) AS tail
        FROM halved WHERE i < 50)
)
SELECT a.stratum, a.n, a.k, CAST(a.k AS DOUBLE) / a.n AS agreement,
       CASE WHEN a.k = 0 THEN 0 ELSE (l.lo + l.hi) / 2 END AS ci_lo, CASE WHEN a.k = a.n THEN 1 ELSE (h.lo + h.hi) / 2 END AS ci_hi
FROM agreement a JOIN halved l ON l.stratum = a.stratum AND l.i = 50 AND l.target < 0.5 JOIN halved h ON h.stratum = a.stratum AND h.i = 50 AND h.target > 0.5
"""


@query("conditional_agreement", r6(_AGREEMENT, "agreement", "ci_lo", "ci_hi"))
def conditional_agreement(spark, sf_dir):
    return ag.conditional_agreement(annotations(spark, sf_dir))


@query("clopper_pearson", r6(f"SELECT stratum, ci_hi - ci_lo AS width, ci_lo, ci_hi FROM ({_AGREEMENT})", "width", "ci_lo", "ci_hi"))
def clopper_pearson(spark, sf_dir):
    return ag.conditional_agreement(annotations(spark, sf_dir)).select("stratum", (F.col("ci_hi") - F.col("ci_lo")).alias("width"), "ci_lo", "ci_hi")


@query("disagreement_direction", with_ctes("""
SELECT count(*) FILTER (WHERE judge = 1 AND human = 0) AS judge_milder,
       count(*) FILTER (WHERE judge = 0 AND human = 1) AS judge_stricter FROM fx_annotations"""))
def disagreement_direction(spark, sf_dir):
    return ag.disagreement_direction(annotations(spark, sf_dir))


@query("disagreements", with_ctes("""
SELECT stratum, item_id, agent_id, reference, human, CASE WHEN human >= 0 THEN human = reference END AS agrees FROM (
  SELECT *, CASE WHEN stratum = 'recusa' THEN coalesce(refusal_verdict, -9) ELSE judge END AS reference FROM fx_annotations)
WHERE (human >= 0 AND human <> reference) OR comment <> ''"""))
def disagreements(spark, sf_dir):
    return ag.disagreements(annotations(spark, sf_dir))


@query("annotation_upsert", with_ctes("""
SELECT item_id, agent_id, human, CAST(CASE WHEN human < 0 THEN 2 ELSE 1 END AS INTEGER) AS version
FROM (SELECT item_id, agent_id, CASE WHEN human < 0 THEN judge ELSE human END AS human_new, human, judge FROM fx_annotations)""")
  .replace("SELECT item_id, agent_id, human, CAST", "SELECT item_id, agent_id, human_new AS human, CAST"))
def annotation_upsert(spark, sf_dir):
    rows = annotations(spark, sf_dir)
    stored = rows.select("item_id", "agent_id", "human", F.lit(1).alias("version"))
    again = rows.where("human < 0").select(
        "item_id", "agent_id", F.col("judge").alias("human"), F.lit(2).alias("version")
    )
    return ag.upsert(stored, again, ["item_id", "agent_id"], "version")


@query("annotation_progress", with_ctes("""
SELECT stratum, count(*) AS drawn, count(human) AS annotated, count(*) FILTER (WHERE human >= 0) AS judged,
       count(*) FILTER (WHERE human >= 0 AND human = judge) AS agreeing
FROM (SELECT a.stratum, b.human, b.judge FROM fx_annotations a
      LEFT JOIN fx_annotations b ON a.item_id = b.item_id AND a.agent_id = b.agent_id AND b.agent_id < 3) GROUP BY 1"""))
def annotation_progress(spark, sf_dir):
    rows = annotations(spark, sf_dir)
    return ag.progress(rows.select("stratum", "item_id", "agent_id"), rows.where("agent_id < 3"))


@query("documented_exclusions", with_ctes("""
SELECT stratum, count(*) AS n FROM fx_annotations a
WHERE NOT EXISTS (SELECT 1 FROM fx_annotations e WHERE e.item_id = a.item_id AND e.agent_id = a.agent_id AND e.comment <> '')
GROUP BY 1"""))
def documented_exclusions(spark, sf_dir):
    rows = annotations(spark, sf_dir)
    listed = rows.where("comment <> ''").select("item_id", "agent_id", F.col("comment").alias("reason"))
    return pn.exclude_documented(rows, listed, ["item_id", "agent_id"]).groupBy("stratum").agg(F.count("*").alias("n"))


# Comparison ----------------------------------------------------------------------------------------

SIDE_METRICS = [
    "z_mean", "z_1", "z_2", "z_3", "z_b0", "refused_mean", "evasive_mean", "parse_failure",
    "sufficient", "insufficient", "words", "n_chunks", "recall_passage", "recall_file",
]


# First and last line of the pipelines that are compared; old and new share out all seven lines.
SIDES = {"old": (1, 3), "new": (4, 7), "api": (5, 7)}


def side(spark, sf_dir, name):
    """Item metrics of one pipeline: a range of lines, dealt to its three agents."""
    first_line, last_line = SIDES[name]
    lines = fx.table(spark, sf_dir, "lineitem")
    panel = fx.panel(spark, sf_dir, first_line, last_line)
    evasive = F.col("refused") & (F.col("agent_id") % 2 == 0)
    marks = panel.select(
        "item_id", "agent_id", "z", F.col("refused").cast("int").alias("refused"),
        evasive.cast("int").alias("evasive"), (~F.col("valid_json")).cast("int").alias("failed"),
    )
    roll = pn.item_rollup(marks, fx.AGENTS, ["z", "refused", "evasive", "failed"])
    context = lines.where(F.col("l_linenumber").between(first_line, last_line)).groupBy(F.col("l_orderkey").alias("item_id")).agg(
        F.count("*").alias("n_chunks"), F.sum("l_quantity").alias("words")
    )
    orders = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), (F.col("o_orderstatus") != "P").alias("has_doc_ref"),
        F.floor("o_totalprice").alias("_t"),
    )
    verdict = fx.sufficiency(spark, sf_dir)
    mod = first_line + 2
    recall = F.when(F.col("has_doc_ref"), F.col("_t") % mod / F.lit(float(mod - 1)))
    return (
        roll.join(orders, "item_id").join(verdict, "item_id").join(context, "item_id", "left")
        .select(
            "item_id", "has_doc_ref", "z_mean", "z_1", "z_2", "z_3", F.col("z_1").alias("z_b0"),
            "refused_mean", "evasive_mean", F.col("failed_mean").alias("parse_failure"),
            (F.col("verdict") == 2).cast("int").alias("sufficient"),
            (F.col("verdict") == 0).cast("int").alias("insufficient"),
            F.coalesce("words", F.lit(0.0)).alias("words"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
            recall.alias("recall_passage"), F.greatest(recall, F.when(F.col("has_doc_ref"), F.lit(0.5))).alias("recall_file"),
        )
    )


def _side_sql(name: str) -> str:
    first, last = SIDES[name]
    agent = f"(l_linenumber - {first}) % 3 + 1"
    mod = first + 2
    return f"""
SELECT o.o_orderkey AS item_id, o.o_orderstatus <> 'P' AS has_doc_ref, o.o_orderpriority,
  coalesce(a.z1, 0) AS z_1, coalesce(a.z2, 0) AS z_2, coalesce(a.z3, 0) AS z_3,
  (coalesce(a.z1, 0) + coalesce(a.z2, 0) + coalesce(a.z3, 0)) / CAST(3 AS DOUBLE) AS z_mean, coalesce(a.z1, 0) AS z_b0,
  coalesce(a.refused, 0) / CAST(3 AS DOUBLE) AS refused_mean, coalesce(a.evasive, 0) / CAST(3 AS DOUBLE) AS evasive_mean,
  (3 - coalesce(a.present, 0)) / CAST(3 AS DOUBLE) AS parse_failure,
  CASE WHEN substr(o.o_orderpriority, 1, 1) IN ('1', '2') THEN 1 ELSE 0 END AS sufficient,
  CASE WHEN substr(o.o_orderpriority, 1, 1) NOT IN ('1', '2', '3', '4') THEN 1 ELSE 0 END AS insufficient,
  coalesce(c.words, 0) AS words, coalesce(c.n_chunks, 0) AS n_chunks,
  CASE WHEN o.o_orderstatus <> 'P' THEN floor(o.o_totalprice) % {mod} / CAST({mod - 1} AS DOUBLE) END AS recall_passage,
  CASE WHEN o.o_orderstatus <> 'P' THEN greatest(floor(o.o_totalprice) % {mod} / CAST({mod - 1} AS DOUBLE), 0.5) END AS recall_file
FROM orders o
LEFT JOIN (
  SELECT l_orderkey, max(CASE WHEN g = 1 THEN z END) AS z1, max(CASE WHEN g = 2 THEN z END) AS z2, max(CASE WHEN g = 3 THEN z END) AS z3,
         sum(CASE WHEN flag_n = 1 AND c < 0.3 THEN 1 ELSE 0 END) AS refused,
         sum(CASE WHEN flag_n = 1 AND c < 0.3 AND g = 2 THEN 1 ELSE 0 END) AS evasive, count(*) AS present
  FROM (SELECT l_orderkey, {agent} AS g, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS z,
               max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS flag_n, round(10 * max(l_discount), 1) AS c
        FROM lineitem WHERE l_linenumber BETWEEN {first} AND {last} GROUP BY 1, 2) GROUP BY 1) a ON a.l_orderkey = o.o_orderkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n_chunks, sum(l_quantity) AS words FROM lineitem WHERE l_linenumber BETWEEN {first} AND {last} GROUP BY 1) c
  ON c.l_orderkey = o.o_orderkey
"""


cte("fx_side_old", _side_sql("old"))
cte("fx_side_new", _side_sql("new"))


def pairs(spark, sf_dir):
    paired = cp.paired_metrics(side(spark, sf_dir, "old"), side(spark, sf_dir, "new"), SIDE_METRICS, ["has_doc_ref"])
    return cp.long_pairs(paired, SIDE_METRICS, "has_doc_ref")


_LATERAL = ", ".join(f"('{m}', CAST(a.{m} AS DOUBLE), CAST(b.{m} AS DOUBLE))" for m in SIDE_METRICS)


@query("paired_comparison", r6(f"""
SELECT v.metric, count(*) AS n, avg(v.o) AS old, avg(v.w) AS new, avg(v.w - v.o) AS delta
FROM fx_side_old a JOIN fx_side_new b USING (item_id) CROSS JOIN LATERAL (VALUES {_LATERAL}) v(metric, o, w)
WHERE v.o IS NOT NULL AND v.w IS NOT NULL GROUP BY 1""", "old", "new", "delta"))
def paired_comparison(spark, sf_dir):
    return cp.comparison_means(pairs(spark, sf_dir))


@query("paired_comparison_intervals", r6(f"""
SELECT v.metric, count(*) AS n, avg(v.o) AS old, avg(v.w) AS new, avg(v.w - v.o) AS delta, true AS holds
FROM fx_side_old a JOIN fx_side_new b USING (item_id) CROSS JOIN LATERAL (VALUES {_LATERAL}) v(metric, o, w)
WHERE v.o IS NOT NULL AND v.w IS NOT NULL GROUP BY 1""", "old", "new", "delta"))
def paired_comparison_intervals(spark, sf_dir):
    return holding(cp.compare(materialise(pairs(spark, sf_dir)), "has_doc_ref", REPLICAS), "delta")


@query("cost_by_stage", r6("""
SELECT stage, side, calls, cost_usd, sum(cost_usd) OVER (PARTITION BY side) AS side_total FROM (
  SELECT event_type AS stage, CASE WHEN user_id % 2 = 0 THEN 'old' ELSE 'new' END AS side, count(*) AS calls,
         sum(value / 1000) AS cost_usd FROM events GROUP BY 1, 2)""", "cost_usd", "side_total"))
def cost_by_stage(spark, sf_dir):
    calls = fx.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"),
        F.when(F.col("user_id") % 2 == 0, "old").otherwise("new").alias("side"),
        (F.col("value") / 1000).alias("cost_usd"),
    )
    return cp.cost_by_stage(calls)


@query("delta_decomposition", r6("""
SELECT CAST(CASE WHEN sufficient = 1 THEN 2 WHEN insufficient = 1 THEN 0 ELSE 1 END AS INTEGER) AS verdict, count(*) AS n,
       avg(z_old) AS mean_a, avg(z_new) AS mean_b,
       CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM orders) * (avg(z_new) - avg(z_old)) AS contribution
FROM (SELECT a.sufficient, a.insufficient, a.z_mean AS z_old, b.z_mean AS z_new FROM fx_side_old a JOIN fx_side_new b USING (item_id))
GROUP BY 1""", "mean_a", "mean_b", "contribution"))
def delta_decomposition(spark, sf_dir):
    paired = cp.paired_metrics(side(spark, sf_dir, "old"), side(spark, sf_dir, "new"), ["z_mean"], [])
    paired = paired.join(fx.sufficiency(spark, sf_dir), "item_id")
    return cp.decomposition(paired, "verdict", "z_mean_old", "z_mean_new")


cte("fx_side_api", _side_sql("api"))


@query("arm_contrasts", r6("""
SELECT v.a, v.b, count(*) AS n, avg(v.x) AS mean_a, avg(v.y) AS mean_b, avg(v.x - v.y) AS delta FROM (
  SELECT o.z_mean AS o, n.z_mean AS n, p.z_mean AS p FROM fx_side_old o JOIN fx_side_new n USING (item_id) JOIN fx_side_api p USING (item_id))
CROSS JOIN LATERAL (VALUES ('api', 'new', p, n), ('new', 'old', n, o), ('api', 'old', p, o)) v(a, b, x, y) GROUP BY 1, 2""",
  "mean_a", "mean_b", "delta"))
def arm_contrasts(spark, sf_dir):
    arms = None
    for name, lines in SIDES.items():
        one = pn.item_rollup(fx.panel(spark, sf_dir, *lines), fx.AGENTS, ["z"]).select(
            "item_id", F.col("z_mean").alias(name)
        )
        arms = one if arms is None else arms.join(one, "item_id")
    return cp.arm_contrasts(arms, [("api", "new"), ("new", "old"), ("api", "old")])


@query("sufficiency_summary", r6("""
SELECT count(*) AS n, count(*) FILTER (WHERE verdict = 2) AS n_sufficient, count(*) FILTER (WHERE verdict = 1) AS n_partial,
       count(*) FILTER (WHERE verdict = 0) AS n_insufficient, count(*) FILTER (WHERE verdict = -1) AS n_failed,
       avg(CASE WHEN verdict = 2 THEN 1 ELSE 0 END) AS share_sufficient, avg(CASE WHEN verdict = 1 THEN 1 ELSE 0 END) AS share_partial,
       avg(CASE WHEN verdict = 0 THEN 1 ELSE 0 END) AS share_insufficient FROM fx_sufficiency""",
  "share_sufficient", "share_partial", "share_insufficient"))
def sufficiency_summary(spark, sf_dir):
    return cp.verdict_shares(fx.sufficiency(spark, sf_dir))


@query("order_equality_gate", with_ctes("""
SELECT coalesce(a.item_id, b.item_id) AS item_id, CASE WHEN a.item_id IS NULL THEN 'right_only' ELSE 'left_only' END AS side
FROM (SELECT DISTINCT l_orderkey AS item_id FROM lineitem WHERE l_linenumber <= 3) a
FULL JOIN (SELECT DISTINCT l_orderkey AS item_id FROM lineitem WHERE l_linenumber >= 4) b ON a.item_id = b.item_id
WHERE a.item_id IS NULL OR b.item_id IS NULL"""))
def order_equality_gate(spark, sf_dir):
    from quorate.operators.gates import id_set_difference

    lines = fx.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "item_id")
    return id_set_difference(lines.where("l_linenumber <= 3"), lines.where("l_linenumber >= 4"), "item_id")
