"""Hand-computed and brute-force checks of panel operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorate.operators import ablation as ab
from quorate.operators import audit as au
from quorate.operators import calibration as cal
from quorate.operators import comparison as cp
from quorate.operators import decisions as dec
from quorate.operators import folds as fd
from quorate.operators import gates as gt
from quorate.operators import panel as pn
from quorate.operators import selective as sel
from quorate.operators.prefix import running_totals


def frame(spark, columns, rows):
    return spark.createDataFrame(rows, columns)


def test_response_probability_splits_the_tie_at_the_cut(spark):
    df = frame(spark, "score double", [(0.9,), (0.8,), (0.8,), (0.1,)])
    got = {r.score: r.p_respond for r in sel.response_probability(df, [], [0.5]).collect()}
    assert got == {0.9: 1.0, 0.8: 0.5, 0.1: 0.0}


def test_running_totals_match_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 4000), "k": rng.random(4000) * 1.4 - 0.2, "n": rng.integers(1, 9, 4000)})
    pdf.loc[pdf.g == 0, "k"] = 0.5 + pdf.loc[pdf.g == 0, "k"] / 1e6
    pdf = pdf.drop_duplicates(["g", "k"])
    for down in (False, True):
        out = running_totals(spark.createDataFrame(pdf), ["g"], "k", ["n"], descending=down).toPandas()
        ref = pdf.sort_values("k", ascending=not down)
        ref = ref.assign(b=ref.groupby("g").n.cumsum() - ref.n)
        both = out.merge(ref, on=["g", "k", "n"])
        assert len(both) == len(pdf) and (both.before_n == both.b).all()
        assert (out.groupby("g").total_n.first() == pdf.groupby("g").n.sum()).all()


def brute_tau(eta, z, c_min):
    best = None
    for tau in np.unique(np.r_[eta, 1.0]):
        on = eta <= tau
        if on.mean() < c_min or not on.any():
            continue
        key = ((1 - z[on]).mean(), -on.mean(), tau)
        best = key if best is None or key < best else best
    return best


def test_tau_star_against_brute_force(spark):
    rng = np.random.default_rng(2)
    eta, z = np.round(rng.random(300), 2), rng.integers(0, 2, 300)
    df = spark.createDataFrame(pd.DataFrame({"eta": eta, "z": z}))
    for row in sel.tau_star(df, [], [0.3, 0.6, 1.0]).collect():
        risk, cov, tau = brute_tau(eta, z, row.c_min)
        assert (row.tau_star, row.coverage_emp_val) == (tau, -cov)
        assert row.risk_sel_emp_val == pytest.approx(risk)
        assert row.constraint_satisfied


def test_tau_star_falls_back_when_uncertainty_exceeds_one(spark):
    df = frame(spark, "eta double, z int", [(1.5, 1), (1.2, 0), (0.4, 1)])
    row = sel.tau_star(df, [], [0.9]).first()
    assert row.tau_star == 1.5 and row.constraint_satisfied
    only = sel.tau_star(frame(spark, "eta double, z int", [(0.4, 1)]), [], [1.0]).first()
    assert only.tau_star == 0.4


def brute_aurc(score, z):
    order = np.argsort(-score, kind="stable")
    s, y = score[order], z[order].astype(float)
    mean = pd.Series(y).groupby(s).transform("mean").to_numpy()
    return np.mean(1 - np.cumsum(mean) / np.arange(1, len(y) + 1)), mean


def test_aurc_and_risk_at_coverage_against_brute_force(spark):
    rng = np.random.default_rng(3)
    score, z = np.round(rng.random(3000), 1), rng.integers(0, 2, 3000)
    df = spark.createDataFrame(pd.DataFrame({"score": score, "z": z}))
    area, mean = brute_aurc(score, z)
    assert sel.aurc(df, []).first().aurc == pytest.approx(area, abs=1e-9)
    for row in sel.risk_at_coverage(df, [], [0.0001, 0.37, 1.0]).collect():
        n = max(int(row.coverage * 3000), 1)
        assert row.risk == pytest.approx(1 - mean[:n].mean())


def test_auroc_ties_and_single_class(spark):
    df = frame(spark, "score double, z int", [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)])
    assert sel.auroc(df, [], "score", F.col("z")).first().auroc == pytest.approx(0.875)
    one = frame(spark, "score double, z int", [(0.1, 1), (0.4, 1)])
    assert sel.auroc(one, [], "score", F.col("z")).first().auroc is None
    hole = frame(spark, "score double, z int", [(0.1, 0), (None, 1), (0.4, 1)])
    assert sel.auroc(hole, [], "score", F.col("z")).first().auroc is None


def isotonic_brute(x, z):
    xs = np.unique(x)
    n = np.array([(x == v).sum() for v in xs])
    s = np.array([z[x == v].sum() for v in xs])
    return xs, np.array(
        [max(min(s[j : k + 1].sum() / n[j : k + 1].sum() for k in range(i, len(xs))) for j in range(i + 1)) for i in range(len(xs))]
    )


def test_isotonic_fit_and_interpolation(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.random(400), 2)
    z = (rng.random(400) < x * 0.8).astype(int)
    pdf = pd.DataFrame({"fold_k": 0, "agent_id": "a", "conf": x, "z": z})
    roles = frame(spark, "exec_k int, fold_k int, role string", [(1, 0, "fit")])
    blocks = cal.isotonic_fit(cal.isotonic_levels(spark.createDataFrame(pdf), roles))
    xs, ys = isotonic_brute(x, z)
    ask = np.r_[xs, xs[:-1] + np.diff(xs) / 3, -0.5, 0.0, 1.0, 1.7]
    wanted = spark.createDataFrame(pd.DataFrame({"agent_id": "a", "conf": ask}))
    got = cal.calibration_map(blocks, wanted).toPandas().sort_values("conf")
    assert len(got) == len(np.unique(ask))
    assert np.allclose(got.conf_calib, np.interp(got.conf, xs, ys))


def test_weights_are_uniform_when_nobody_is_right(spark):
    panel = frame(spark, "fold_k int, agent_id string, z int", [(0, "a", 0), (0, "b", 0)])
    roles = frame(spark, "exec_k int, fold_k int, role string", [(1, 0, "fit")])
    assert {r.weight for r in cal.adequacy_weights(panel, roles).collect()} == {0.5}


def test_winner_ties(spark):
    scored = frame(
        spark, "item_id int, agent_id string, z int, score double, weight double, conf double",
        [(1, "a", 0, 0.5, 0.4, 0.7), (1, "b", 1, 0.5, 0.4, 0.7), (2, "a", 1, 0.5, 0.6, 0.1), (2, "b", 0, 0.5, 0.4, 0.2)],
    )
    heavy = {r.item_id: r.agent_chosen for r in dec.weighted_head(scored, ["item_id"]).collect()}
    assert heavy == {1: "b", 2: "a"}
    mean = {r.item_id: r for r in dec.mean_confidence_head(scored, ["item_id"]).collect()}
    assert mean[1].agent_chosen == "a" and mean[2].agent_chosen == "b"
    assert mean[2].eta == pytest.approx(0.85)


def test_abstains_only_above_the_threshold(spark):
    test = frame(spark, "exec_k int, eta double, z_winner int", [(0, 0.4, 1), (0, 0.41, 0)])
    tau = frame(spark, "exec_k int, c_min double, tau_star double", [(0, 0.5, 0.4)])
    rows = {r.eta: r for r in dec.abstain(test, tau, ["exec_k"]).collect()}
    assert not rows[0.4].abstained and rows[0.4].z_system == 1
    assert rows[0.41].abstained and rows[0.41].z_system is None


def test_audit_metrics_by_hand(spark):
    rows = [(1, False, None, 2, 1.0), (0, False, None, 0, 0.0), (0, True, 2.0, 0, 1.0), (1, False, None, 2, 1.0)]
    df = frame(spark, "z_winner int, textual_refusal boolean, refusal_verdict double, context_sufficiency int, p double", rows)
    m = au.decision_metrics(df, F.col("p"), []).first()
    assert m.nominal_coverage == 0.75 and m.effective_coverage == 0.5
    assert m.conventional_utility == 0.5 and m.context_utility_strict == 1.0 and m.context_penalty_strict == 0.5
    assert m.abstention_given_partial is None


def test_calibration_error_edges(spark):
    df = frame(spark, "g int, conf double, z int", [(0, 1.0, 1), (0, 0.0, 0), (0, 14 * (1 / 15), 1)])
    table = {r.bin: r["count"] for r in sel.reliability_table(df, ["g"]).collect()}
    assert len(table) == 15 and table[14] == 2 and table[0] == 1
    assert sel.ece_equal_width(df, ["g"]).first().ece == pytest.approx(1 / 45)


def test_folds_cover_and_balance(spark):
    items = spark.range(997).select(F.col("id").alias("item_id"), (F.col("id") % 3 == 0).alias("flag"))
    folds = fd.assign_folds(items, "flag")
    sizes = [r["count"] for r in folds.groupBy("fold_k").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1
    roles = fd.fold_roles(spark)
    assert fd.fold_cover(folds, roles).count() == 0
    assert {r["count"] for r in roles.where("role = 'val'").groupBy("exec_k").count().collect()} == {2}
    assert roles.where("role = 'test' and exec_k <> fold_k").count() == 0


def test_sample_quota_is_half_even_and_exact(spark):
    items = spark.range(80).select(F.col("id").alias("item_id"), (F.col("id") < 10).alias("flag"))
    got = fd.stratified_sample(items, "flag", 20).groupBy("flag").count().collect()
    assert {r.flag: r["count"] for r in got} == {True: 2, False: 18}


def test_annotation_draw_uses_an_item_once(spark):
    rows = [(i, a, "adequada" if (i + a) % 2 else "inadequada") for i in range(40) for a in range(3)]
    draw = fd.annotation_draw(frame(spark, "item_id int, agent_id int, stratum string", rows)).toPandas()
    assert draw.item_id.is_unique and len(draw) == 40
    for _, part in draw.groupby("stratum"):
        assert sorted(part.draw_order) == list(range(1, len(part) + 1))


def test_logistic_variant_matches_newton(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        for a in range(3):
            c = float(rng.random())
            rows.append((i, i % 2, True, a, int(rng.random() < c), bool(rng.random() < 0.2), c))
    scored = frame(
        spark, "item_id int, fold_k int, has_doc_ref boolean, agent_id int, z int, refused boolean, conf_calib double", rows
    )
    roles = frame(spark, "exec_k int, fold_k int, role string", [(0, 0, "test"), (0, 1, "fit"), (1, 1, "test"), (1, 0, "fit")])
    out = ab.logistic_variant(scored, roles).toPandas().set_index("item_id").sort_index()
    feats = ab.logistic_features(scored).toPandas().set_index("item_id").sort_index()
    x = feats[["f_mean", "f_min", "f_max", "f_std", "f_refusals"]].to_numpy()
    x1, y, fold = np.c_[x, np.ones(len(x))], feats.z.to_numpy(), feats.fold_k.to_numpy()
    for test in (0, 1):
        fit, w = fold != test, np.zeros(6)
        penalty = np.diag([1.0] * 5 + [0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x1[fit] @ w))
            grad = x1[fit].T @ (p - y[fit]) + penalty @ w
            w -= np.linalg.solve(x1[fit].T * (p * (1 - p)) @ x1[fit] + penalty, grad)
        assert np.allclose(out.score[fold == test], 1 / (1 + np.exp(-x1[fold == test] @ w)), atol=1e-8)
    # An execution without fit rows has no opinion; labels of one kind end as well.
    alone = frame(spark, "exec_k int, fold_k int, role string", [(0, 0, "test"), (0, 7, "fit"), (1, 1, "test"), (1, 0, "fit")])
    one_kind = scored.withColumn("z", F.lit(1))
    got = ab.logistic_variant(one_kind, alone).toPandas().set_index("item_id").sort_index()
    assert (got.score[got.fold_k == 0] == 0.5).all() and (got.score[got.fold_k == 1] > 0.99).all()


def test_gates(spark):
    df = frame(spark, "k int, v double", [(1, 0.2), (1, 1.4), (2, None)])
    assert gt.duplicate_keys(df, ["k"]).first().n == 2
    assert gt.domain_violations(df, {"unit": F.col("v").between(0, 1)}).first().n_violations == 2
    with pytest.raises(ValueError):
        gt.require_empty(gt.duplicate_keys(df, ["k"]), "keys repeat")
    now = frame(spark, "m string, value double", [("a", 0.5), ("b", 0.7)])
    old = frame(spark, "m string, value double", [("a", 0.5005), ("b", 0.702), ("c", 1.0)])
    assert {r.m for r in gt.golden_drift(now, old, ["m"]).collect()} == {"b", "c"}


def test_rung_verdicts_and_shares(spark):
    rungs = frame(spark, "pos int, rung string, point double, ci_lo double", [(0, "R0", 0.2, 0.1), (1, "R1", 0.3, 0.25), (2, "R2", 0.31, 0.28)])
    got = {r.rung: r.verdict for r in cp.rung_verdicts(rungs).collect()}
    assert got == {"R0": "base", "R1": "confirmed", "R2": "not confirmed"}
    v = frame(spark, "verdict int", [(2,), (0,), (0,), (-1,)])
    row = cp.verdict_shares(v).first()
    assert (row.n, row.n_failed, row.share_insufficient) == (4, 1, 0.5)


def test_refusal_predicate_ignores_case_and_null(spark):
    df = frame(spark, "t string", [("NÃO É POSSÍVEL RESPONDER com isso",), (None,), ("ok",), ("o contexto é insuficiente",)])
    assert [r[0] for r in df.select(pn.is_refusal(F.col("t"))).collect()] == [True, False, False, True]


def test_row_order_area_with_one_dominant_score(spark):
    import numpy as np

    from quorate.operators import selective as sel

    rng = np.random.default_rng(5)
    scores = np.where(rng.random(4000) < 0.9, 0.5, rng.integers(0, 11, 4000) / 10)
    z = rng.integers(0, 2, 4000)
    df = spark.createDataFrame([("v", int(i), float(s), int(y)) for i, (s, y) in enumerate(zip(scores, z))], "variant string, item_id long, score double, z int")
    order = np.lexsort((np.arange(4000), -scores))
    want = np.mean(1 - np.cumsum(z[order]) / np.arange(1, 4001))
    assert abs(sel.aurc_row_order(df, ["variant"], "item_id").first().aurc_row_order - want) < 1e-12


def test_quantiles_and_nearest_points_against_numpy(spark):
    import numpy as np

    from quorate.operators import selective as sel

    rng = np.random.default_rng(6)
    x = np.append(np.round(rng.random(997), 2), [0.5] * 3000)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 0.25), ("c", None)], "g string, conf double")
    probs = [i / 15 for i in range(16)]
    got = {r.g: list(r._q) for r in sel.exact_quantiles(df, ["g"], "conf", probs).collect()}
    assert np.allclose(got["a"], np.quantile(x, probs), atol=1e-12) and got["b"] == [0.25] * 16 and "c" not in got
    taus = np.unique(np.round(rng.random(60), 4))
    curve = spark.createDataFrame([(float(t), float(t) / 2, float(t) / 3) for t in taus], "tau double, coverage double, selective_risk double")
    wanted = [0.0, 1.0, *taus[:5].tolist(), *rng.random(40).tolist(), float((taus[3] + taus[4]) / 2)]
    asked = spark.createDataFrame([(float(w),) for w in wanted], "wanted_tau double")
    near = {r.wanted_tau: r.tau for r in sel.nearest_curve_point(curve, asked).collect()}
    assert near == {float(w): float(min(taus, key=lambda t: (abs(t - w), t))) for w in wanted}
