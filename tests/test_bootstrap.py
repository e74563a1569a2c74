"""Bootstrap draws and intervals against NumPy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorate.functions.stats import clopper_pearson, log_gamma
from quorate.operators import audit as au
from quorate.operators import bootstrap as bs
from quorate.operators import replica_curves as rc


def sample(n=400):
    rng = np.random.default_rng(7)
    s = rng.random(n) < 0.3
    return pd.DataFrame({"s": s, "x": rng.integers(0, 4, n), "y": (rng.random(n) < 0.4 + 0.3 * s).astype(int)})


def test_replica_weights_keep_stratum_sizes(spark):
    pdf = sample()
    cells = bs.compress(spark.createDataFrame(pdf), "s", ["x", "y"])
    rows = bs.replica_rows(bs.replica_weights(cells, ["x", "y"], 150)).toPandas()
    per = rows.groupby(["_s", "replica"]).w.sum().unstack()
    assert per.shape == (2, 150)
    assert (per.loc["true"] == pdf.s.sum()).all() and (per.loc["false"] == (~pdf.s).sum()).all()
    again = bs.replica_rows(bs.replica_weights(cells, ["x", "y"], 150)).toPandas()
    keys = ["_s", "x", "y", "replica"]
    pd.testing.assert_frame_equal(
        rows.sort_values(keys).reset_index(drop=True), again.sort_values(keys).reset_index(drop=True)
    )
    with pytest.raises(ValueError):
        bs.replica_weights(cells, ["x"], 99)


def test_percentile_interval_is_that_of_resampling(spark):
    pdf = sample()
    got = bs.interval_table(
        spark.createDataFrame(pdf), "s", ["y"], {"mean": bs.weighted_mean(F.col("y"))}, 3000
    ).first()
    rng, parts = np.random.default_rng(1), [pdf.y[pdf.s].to_numpy(), pdf.y[~pdf.s].to_numpy()]
    draws = [np.concatenate([p[rng.integers(0, len(p), len(p))] for p in parts]).mean() for _ in range(3000)]
    lo, hi = np.quantile(draws, [0.025, 0.975])
    assert got.point == pytest.approx(pdf.y.mean())
    assert got.ci_lo == pytest.approx(lo, abs=0.006) and got.ci_hi == pytest.approx(hi, abs=0.006)
    assert got.n_resamples == 3000 and got.n_dropped == 0


def test_bca_against_numpy(spark):
    from statistics import NormalDist

    pdf = sample(200)
    df = spark.createDataFrame(pdf)
    got = bs.bca_interval(df, "s", ["x", "y"], {"r": (F.col("x") * F.col("y"), F.col("x"))}, 4000).first()
    num, den = (pdf.x * pdf.y).to_numpy(), pdf.x.to_numpy()
    theta = num.sum() / den.sum()
    jack = (num.sum() - num) / (den.sum() - den)
    gap = jack.mean() - jack
    accel = (gap**3).sum() / (6 * (gap**2).sum() ** 1.5)
    rng, idx = np.random.default_rng(2), [np.flatnonzero(pdf.s), np.flatnonzero(~pdf.s)]
    boot = []
    for _ in range(4000):
        pick = np.concatenate([i[rng.integers(0, len(i), len(i))] for i in idx])
        boot.append(num[pick].sum() / den[pick].sum())
    boot, nd = np.array(boot), NormalDist()
    z0 = nd.inv_cdf((boot < theta).mean())
    ends = [np.quantile(boot, nd.cdf(z0 + (z0 + z) / (1 - accel * (z0 + z)))) for z in (nd.inv_cdf(0.025), nd.inv_cdf(0.975))]
    assert got.point == pytest.approx(theta) and got.acceleration == pytest.approx(accel)
    assert got.ci_lo == pytest.approx(ends[0], abs=0.012) and got.ci_hi == pytest.approx(ends[1], abs=0.012)


def test_paired_aurc_delta_against_resampling(spark):
    rng = np.random.default_rng(3)
    n = 250
    pdf = pd.DataFrame({"s": rng.random(n) < 0.5, "score_a": np.round(rng.random(n), 1), "score_b": np.round(rng.random(n), 1)})
    pdf["z_a"] = (rng.random(n) < pdf.score_a).astype(int)
    pdf["z_b"] = (rng.random(n) < 0.5).astype(int)

    def area(score, z):
        order = np.argsort(-score, kind="stable")
        y = pd.Series(z[order].astype(float)).groupby(score[order]).transform("mean").to_numpy()
        return np.mean(1 - np.cumsum(y) / np.arange(1, len(y) + 1))

    got = rc.paired_area_delta(spark.createDataFrame(pdf), "s", 400).first()
    assert got.point == pytest.approx(area(pdf.score_a.to_numpy(), pdf.z_a.to_numpy()) - area(pdf.score_b.to_numpy(), pdf.z_b.to_numpy()))
    idx, draws = [np.flatnonzero(pdf.s), np.flatnonzero(~pdf.s)], []
    for _ in range(400):
        pick = np.concatenate([i[rng.integers(0, len(i), len(i))] for i in idx])
        d = pdf.iloc[pick]
        draws.append(area(d.score_a.to_numpy(), d.z_a.to_numpy()) - area(d.score_b.to_numpy(), d.z_b.to_numpy()))
    lo, hi = np.quantile(draws, [0.025, 0.975])
    assert got.ci_lo == pytest.approx(lo, abs=0.02) and got.ci_hi == pytest.approx(hi, abs=0.02)


def test_areas_of_replicas_are_those_of_copied_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 240
    pdf = pd.DataFrame({"s": rng.random(n) < 0.4, "a": np.round(rng.random(n), 1), "b": np.round(rng.normal(size=n), 3)})
    pdf["za"], pdf["zb"] = (rng.random(n) < 0.5).astype(int), (rng.random(n) < 0.6).astype(int)
    df = spark.createDataFrame(pdf)
    curves = {"a": rc.Curve("a", "za"), "b": rc.Curve("b", "zb")}
    columns = ["a", "za", "b", "zb"]
    rows = bs.replica_rows(bs.replica_weights(bs.compress(df, "s", columns), columns, 100, block=rc.BLOCK)).toPandas()
    want = {}
    for r, own in rows.groupby("replica"):
        if r % 9:
            continue
        for name, curve in curves.items():
            score, z = (np.repeat(own[c].to_numpy(), own.w) for c in (curve.score, curve.kind))
            order = np.argsort(-score, kind="stable")
            y = pd.Series(z[order].astype(float)).groupby(score[order]).transform("mean").to_numpy()
            want[name, r] = np.mean(1 - np.cumsum(y) / np.arange(1, len(y) + 1))
    for cells in (4096, 30):
        monkeypatch.setattr(rc, "RANGE_CELLS", cells)
        got = {(r.curve, r.replica): r.aurc for r in rc.area_replicas(df, "s", curves, 100).collect()}
        assert len(got) == 200 and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())


def test_harmonic_numbers():
    n = np.array([0, 1, 2, 63, 64, 65, 1000, 10**6])
    want = [sum(1 / i for i in range(1, k + 1)) for k in n.tolist()]
    assert rc.harmonic(n) == pytest.approx(want, rel=1e-14)


def test_combinations_of_areas_and_missing_variants(spark):
    from quorate.operators import ablation as ab

    rng = np.random.default_rng(6)
    rows = [(i, i % 3 == 0, v, float(np.round(rng.random(), 2)), int(rng.random() < p)) for i in range(200) for v, p in (("A1", 0.4), ("A4", 0.5), ("A5", 0.6), ("A7", 0.5), ("A0", 0.5))]
    df = spark.createDataFrame(rows, "item_id int, has_doc_ref boolean, variant string, score double, z int")
    areas = {r.variant: r.aurc for r in ab.aurc(df, ["variant"]).collect()}
    one = ab.interaction_interval(df, replicas=400).first()
    assert one.delta_aurc == pytest.approx(areas["A5"] - areas["A7"] - areas["A4"] + areas["A1"]) and one.ci_lo < one.delta_aurc < one.ci_hi and one.n_resamples == 400
    found = {r.variant: r for r in ab.ablation_intervals(df, replicas=400).collect()}
    assert found.keys() == {"A1", "A4", "A5", "A7"}
    pairs = {(r.a, r.b): r for r in ab.pair_intervals(df, replicas=400).collect()}
    assert len(pairs) == 20 and pairs["A5", "A0"].ci_lo == pytest.approx(found["A5"].ci_lo) and pairs["A0", "A5"].ci_hi == pytest.approx(-found["A5"].ci_lo)
    se = {r.statistic: r.se for r in ab.area_jackknife(df, {"A5": {"A5": 1, "A0": -1}}, F.col("item_id") % 40).collect()}
    assert se["A5"] == pytest.approx((found["A5"].ci_hi - found["A5"].ci_lo) / 3.92, rel=0.4)
    with pytest.raises(ValueError):
        ab.interaction_interval(df.where("not (variant = 'A5' and item_id = 7)"), replicas=200)


def test_metric_contrasts_point_values(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        for v in ("A0", "A5", "B0"):
            rows.append((i, i % 2 == 0, v, float(np.round(rng.random(), 1)), int(rng.random() < 0.5), bool(rng.random() < 0.2), int(rng.integers(0, 3))))
    pdf = pd.DataFrame(rows, columns=["item_id", "has_doc_ref", "variant", "score", "z_winner", "textual_refusal", "context_sufficiency"])
    pdf["context_sufficiency"] = pdf.item_id % 3
    pdf["refusal_verdict"] = np.where(pdf.textual_refusal, 2, None)
    pdf["refusal_verdict"] = pdf.refusal_verdict.astype("Int64")
    df = spark.createDataFrame(pdf).withColumn("refusal_verdict", F.col("refusal_verdict").cast("int"))
    got = bs.metric_contrasts(df, [("A5", "A0"), ("A5", "B0")], [0.5], ["effective_coverage"], "has_doc_ref", 100).collect()
    table = {r.variant: r.effective_coverage for r in au.metrics_by_coverage(df, [0.5]).collect()}
    assert len(got) == 2
    for r in got:
        assert r.delta_a_minus_b == pytest.approx(table[r.a] - table[r.b])
        assert r.ci_lo <= r.delta_a_minus_b <= r.ci_hi and r.n_resamples == 100


def test_replicated_metrics_are_those_of_copied_rows(spark, monkeypatch):
    """Every replica's metric against the one of its copied rows, through the same weights."""
    rng = np.random.default_rng(9)
    n = 150
    pdf = pd.DataFrame({"item_id": range(n), "s": rng.random(n) < 0.5, "score": np.round(rng.random(n), 1), "z_winner": rng.integers(0, 2, n), "k": rng.integers(0, 3, n)})
    df = spark.createDataFrame(pdf)
    columns = ["v_score", "v_kind"]
    wide = df.select("s", F.col("score").alias("v_score"), bs._kind(F.col("z_winner"), F.lit(False), F.lit(None).cast("int"), F.col("k")).alias("v_kind"))
    cells = bs.compress(wide, "s", columns)
    rows = bs.replica_rows(bs.replica_weights(cells, columns, 100, block=rc.BLOCK)).toPandas()
    monkeypatch.setattr(rc, "RANGE_CELLS", 12)
    found = rc.replica_values(cells, columns, {"v": rc.Curve("v_score", "v_kind")}, rc.answered([0.3], n, bs.KINDS), 100).toPandas()
    for r in (0, 17, 99):
        own = rows[rows.replica == r]
        score, kind = np.repeat(own.v_score.to_numpy(), own.w), np.repeat(own.v_kind.to_numpy(), own.w)
        levels = {x: (score > x).sum() for x in score}
        p = np.array([np.clip((0.3 * n - levels[x]) / (score == x).sum(), 0, 1) for x in score])
        got = found[found.replica == r].set_index("key").value
        for k in set(kind.tolist()):
            assert got[k] == (kind == k).sum() and got[bs.KINDS + k] == pytest.approx(p[kind == k].sum())


def test_point_contrasts_use_given_probabilities(spark):
    rng = np.random.default_rng(8)
    rows = [(i, i % 3 == 0, v, int(rng.random() < 0.5), i % 3, float(rng.integers(0, 2))) for i in range(80) for v in ("a", "b")]
    df = spark.createDataFrame(rows, "item_id int, has_doc_ref boolean, variant string, z_winner int, context_sufficiency int, p_respond double")
    df = df.withColumns({"textual_refusal": F.lit(False), "refusal_verdict": F.lit(None).cast("int")})
    got = {r.metric: r for r in bs.point_contrasts(df, [("a", "b")], ["nominal_coverage", "conventional_risk"], "has_doc_ref", 200).collect()}
    pdf = pd.DataFrame(rows, columns=["i", "s", "v", "z", "k", "p"])
    a, b = pdf[pdf.v == "a"], pdf[pdf.v == "b"]
    assert got["nominal_coverage"].delta_a_minus_b == pytest.approx(a.p.mean() - b.p.mean())
    risk = lambda d: (d.p * (1 - d.z)).sum() / d.p.sum()
    assert got["conventional_risk"].delta_a_minus_b == pytest.approx(risk(a) - risk(b))
    for r in got.values():
        assert r.ci_lo < r.delta_a_minus_b < r.ci_hi


def binomial_tail(k, n, p):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))


def test_exact_binomial_bounds(spark):
    rows = [(0, 10), (8, 10), (10, 10), (1, 1), (0, 1), (37, 4000), (3990, 4000), (500, 1000), (1, 100_000), (0, 0)]
    got = {(r.k, r.n): r.ci for r in spark.createDataFrame(rows, "k long, n long").select("k", "n", clopper_pearson(F.col("k"), F.col("n")).alias("ci")).collect()}
    assert tuple(got[0, 10]) == pytest.approx((0.0, 0.308497), abs=1e-5)
    assert tuple(got[8, 10]) == pytest.approx((0.443905, 0.974789), abs=1e-5)
    assert tuple(got[10, 10]) == pytest.approx((0.691503, 1.0), abs=1e-5)
    assert got[0, 0] is None
    for k, n in rows[:-1]:
        lo, hi = got[k, n]
        assert lo == 0 if k == 0 else binomial_tail(k, n, lo) == pytest.approx(0.025, rel=1e-7)
        assert hi == 1 if k == n else binomial_tail(k + 1, n, hi) == pytest.approx(0.975, rel=1e-7)
    values = [0.1, 0.5, 1.0, 2.5, 17.0, 1e4]
    out = spark.createDataFrame([(v,) for v in values], "x double").select("x", log_gamma(F.col("x")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), abs=1e-9, rel=1e-13) for r in out)


def test_tasks_add_up_buckets_before_they_pass_levels_on(spark):
    """6 000 cells of ten scores: before, every bucket passed on its own rows of every score."""
    df = spark.range(6000).select((F.col("id") % 10 / 10.0).alias("score"), (F.col("id") % 2).cast("int").alias("z"), F.col("id").alias("other"))
    columns = ["score", "z", "other"]
    cells = bs.compress(df, None, columns)
    drawn = rc._drawn(cells, columns, {"v": rc.Curve("score", "z")}, 100, 42, {"v": np.zeros(0)}, 3, np.int32).collect()
    assert len(drawn) == 10 and sum(np.frombuffer(r.w, np.int32).sum() for r in drawn) == 6000 * 100
    rows = bs.replica_rows(bs.replica_weights(cells, columns, 100, buckets=3, block=rc.BLOCK)).groupBy("score", "replica").agg(F.sum("w").alias("w")).toPandas()
    for r in drawn:
        want = rows[rows.score == r.score].set_index("replica").w.reindex(range(100), fill_value=0)
        assert (np.frombuffer(r.w, np.int32) == want.to_numpy()).all()


def test_scores_far_from_the_cuts_are_merged_and_answered_alike(spark):
    rng = np.random.default_rng(11)
    n = 4000
    pdf = pd.DataFrame({"s": rng.random(n) < 0.5, "a_score": np.round(rng.random(n), 4), "a_kind": rng.integers(0, 4, n).astype("int32")})
    cells = bs.compress(spark.createDataFrame(pdf), "s", ["a_score", "a_kind"])
    merged = bs.compress_again(bs.far_merged(cells, {"a": rc.Curve("a_score", "a_kind")}, [0.3, 0.7, 1.0], n, 60), ["a_score", "a_kind"]).toPandas()
    assert merged._n.sum() == n and len(merged) < 600 < 3000 < cells.count()
    pdf = pdf.sort_values("a_score", ascending=False, kind="stable")
    edges = np.sort(merged.a_score.unique())
    to = edges[np.searchsorted(edges, pdf.a_score.to_numpy())]
    far = np.isin(to, merged.a_score[merged.a_kind >= bs.KINDS])
    zero, values = np.zeros((2, 50), np.int64), []
    w = rng.multinomial(n, np.full(n, 1 / n), size=50).T
    for score, kind in ((pdf.a_score.to_numpy(), pdf.a_kind.to_numpy()), (to, pdf.a_kind.to_numpy() + bs.KINDS * far)):
        score, kind, weights = rc._summed(score, kind.astype(np.int64), w, np.int64)
        firsts = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
        values.append(rc.answered([0.3, 0.7, 1.0], n, bs.KINDS)(rc.Matrix(weights, kind, firsts, zero)))
    assert values[0].keys() == values[1].keys()
    cut_in_far = np.isnan(values[1][bs.KINDS]) | np.isnan(values[1][2 * bs.KINDS])
    assert cut_in_far.sum() < 25
    for key, value in values[0].items():
        assert values[1][key][~cut_in_far] == pytest.approx(value[~cut_in_far])


def test_contrasts_widen_the_band_that_a_replica_leaves(spark, monkeypatch):
    rng = np.random.default_rng(12)
    n = 300
    rows = [(i, i % 2 == 0, v, float(np.round(rng.random(), 3)), int(rng.random() < p), False, None, i % 3) for i in range(n) for v, p in (("A", 0.7), ("B", 0.5))]
    df = spark.createDataFrame(rows, "item_id int, s boolean, variant string, score double, z_winner int, textual_refusal boolean, refusal_verdict int, context_sufficiency int")
    found = []
    for margin in (4.0, 0.05):
        monkeypatch.setattr(bs, "MARGIN", margin)
        found.append({r.metric: r for r in bs.metric_contrasts(df, [("A", "B")], [0.5], ["effective_coverage", "conventional_risk"], "s", 400).collect()})
    for metric, r in found[0].items():
        again = found[1][metric]
        assert again.n_resamples == r.n_resamples == 400 and again.delta_a_minus_b == pytest.approx(r.delta_a_minus_b)
        assert again.ci_lo == pytest.approx(r.ci_lo, abs=0.04) and again.ci_hi == pytest.approx(r.ci_hi, abs=0.04)
