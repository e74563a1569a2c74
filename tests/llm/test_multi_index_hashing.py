"""Recall against brute force, exact probing, and odd rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.llm import multi_index_hashing as mih

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType())])


def brute(ids, x, asks, k):
    out = {}
    for i in np.flatnonzero(asks):
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_tables_retrieve_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 16, (700, 16), dtype=np.uint16)
    near = codes[:40].copy()
    for row in near:
        for bit in rng.choice(256, int(rng.integers(0, 60)), replace=False):
            row[bit // 16] ^= np.uint16(1 << (bit % 16))
    tables = mih.Tables(codes)
    for query in near:
        margins = rng.random(256) * rng.choice([0.1, 1, 3])
        bits = np.unpackbits((codes ^ query).view(np.uint8), axis=1)
        costs = (bits * margins).reshape(len(codes), 16, 16).sum(axis=2)
        for share in (0.0, 0.01, 0.02, 0.04, 1.0):
            budget = share * margins.sum()
            found = tables.probe(query, margins, budget + 1e-12)
            assert (found == (costs <= budget + 1e-12).any(axis=1)).all()
            assert found[costs.sum(axis=1) <= 16 * budget].all()
        assert (tables.differing(query, np.arange(700)) == bits.sum(axis=1)).all()


def test_flips_are_all_that_the_budget_buys():
    rng = np.random.default_rng(1)
    margins = rng.random(16)
    bits = np.unpackbits(np.arange(1 << 16, dtype="<u2").view(np.uint8).reshape(-1, 2), axis=1)
    cost = bits @ margins
    for budget in (-1.0, 0.0, 0.5, 2.0, 99.0):
        assert sorted(mih.cheap_flips(margins, budget).tolist()) == np.flatnonzero(cost <= budget).tolist()


def test_probing_touches_a_part_of_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").toArrow().to_pydict()
    ids, x = np.array(table["vec_id"]), np.array(table["embedding"], dtype=np.float32).astype(np.float64)
    codes = mih.learn(x, float(np.linalg.norm(x, axis=1).max()), len(x), 20)
    tables = mih.Tables(codes.of(codes.lifted(x)))
    touched, met = [], []
    for i in np.flatnonzero(ids % 20 == 0):
        side = mih._query_side(x[i][None])
        margins = codes.margins(side)[0]
        found = tables.probe(codes.of(side)[0], margins, codes.share * margins.sum())
        score = x @ x[i]
        score[i] = -np.inf
        touched.append(found.mean())
        met.append(found[np.argsort(-score)[:20]].mean())
    assert np.mean(touched) < 0.36, np.mean(touched)
    assert np.mean(met) > 0.9, np.mean(met)


def test_recall_and_scores_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.select("vec_id", "embedding").toArrow().to_pydict()
    ids, x = np.array(rows["vec_id"]), np.array(rows["embedding"], dtype=np.float32).astype(np.float64)
    want = brute(ids, x, ids % 20 == 0, 20)
    got = collected(mih.search(table, F.col("vec_id") % 20 == 0))
    assert got.keys() == want.keys()
    assert all(len(v) == 20 for v in got.values())
    share = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert share >= 0.9, share
    truth = {q: {int(j): s for j, s in zip(ids, (x * x[ids == q]).sum(axis=1))} for q in want}
    assert all(abs(s - truth[q][i]) < 1e-12 for q in got for i, s in got[q])


def test_lengths_that_differ_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(mih, "INDEX_ROWS", 300)
    monkeypatch.setattr(mih, "QUERY_ROWS", 40)
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(1500, 12)) * rng.uniform(0.2, 3, (1500, 1))).astype(np.float32)
    ids = np.arange(1500) * 3
    table = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, x)], ROWS)
    want = brute(ids, x.astype(np.float64), ids % 20 == 0, 20)
    got = collected(mih.search(table, F.col("vec_id") % 20 == 0))
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_odd_rows(spark):
    one = [1.0, 0.0]
    rows = [(0, one, "x"), (1, None, "x"), (2, [0.0, 0.0], "x"), (3, [1.0, None], "x"), (4, [float("nan"), 1.0], "x"), (5, [float("inf"), 1.0], "x"),
            (6, one, "x"), (7, one, "x"), (None, one, "x"), (8, [1.0], "x"), (9, [-1.0, 0.5], "x"), (6, one, "x"), (20, [], "x"), (40, [0.5, 0.5], None)]
    got = collected(mih.search(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 20 == 0))
    assert got == {0: [(6, 1.0), (7, 1.0), (40, 0.5), (9, -1.0)], 40: [(0, 0.5), (6, 0.5), (7, 0.5), (9, -0.25)]}
    assert mih.search(spark.createDataFrame([], ROWS), F.col("vec_id") % 20 == 0).count() == 0
    assert mih.search(spark.createDataFrame(rows[1:2], ROWS), F.col("vec_id") % 20 == 0).count() == 0
    assert mih.search(spark.createDataFrame(rows[:1], ROWS), F.col("vec_id") % 20 == 0).count() == 0
