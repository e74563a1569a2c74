"""Network against a plain forward pass, gradients, held-out accuracy, odd rows."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import types as T

from quorate.llm import byte_convnet as bc
from quorate.llm.queries import QUERIES

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("text", T.StringType())])


def network(seed=0):
    rng = np.random.default_rng(seed)
    return bc.Network(rng.normal(size=(256, bc.DIM)).astype(np.float32), rng.normal(size=(2 * bc.STRIDE * bc.DIM, bc.FILTERS)).astype(np.float32), rng.normal(size=bc.FILTERS).astype(np.float32), rng.normal(size=2 * bc.FILTERS + 1))


def plain_score(net, text):
    k = max(1, -(-(len(text) - bc.STRIDE) // bc.HOP))
    data = np.frombuffer(text.ljust(k * bc.HOP + bc.STRIDE, b"\0"), np.uint8)
    pooled = []
    for c in range(k):
        chunk = data[c * bc.HOP : c * bc.HOP + bc.CHUNK]
        outs = [net.embed[chunk[s : s + 2 * bc.STRIDE]].reshape(-1) @ net.filters for s in range(0, bc.CHUNK - bc.STRIDE, bc.STRIDE)]
        pooled.append(np.maximum(np.max(outs, axis=0) + net.bias, 0))
    z = np.concatenate((np.mean(pooled, axis=0), np.max(pooled, axis=0))) @ net.out[:-1] + net.out[-1]
    return 1 / (1 + np.exp(-z))


def test_scores_cover_the_whole_text():
    net = network()
    net.out *= 0.02
    for n in (0, 1, 255, 256, 257, 508, 509, 5000):
        text = np.random.default_rng(n).integers(1, 256, n, dtype=np.uint8).tobytes()
        got = net.scores(np.frombuffer(text, np.uint8), np.array([0, n]))[0]
        assert abs(got - plain_score(net, text)) < 1e-4, n
    long = b"a" * 20_000
    ends = [net.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in (long, long + b"\xf0###%%%&&&", b"\xf0###%%%&&&" + long)]
    assert ends[1] != ends[0] != ends[2]


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    net = network(1)
    net.embed, net.filters, net.bias = (a.astype(np.float64) * 0.3 for a in (net.embed, net.filters, net.bias))
    samples = [bc.cut(np.frombuffer(rng.integers(0, 256, n, dtype=np.uint8).tobytes(), np.uint8), np.array([0, n]))[0] for n in (300, 900, 40)]
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 0.7])

    def loss():
        counts = np.array([len(s) for s in samples])
        p = net.probability(net.combine(net.pooled(np.concatenate(samples)), np.cumsum(counts) - counts, counts))
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    grads = bc._gradients(net, samples, y, weight)
    for name in ("filters", "bias", "out", "embed"):
        values = getattr(net, name)
        flat = values.reshape(-1)
        for i in rng.choice(flat.size, 6, replace=False):
            keep, step = flat[i], 1e-6
            flat[i] = keep + step
            up = loss()
            flat[i] = keep - step
            down = loss()
            flat[i] = keep
            extra = 1e-4 * keep if name == "out" and i < flat.size - 1 else 0
            assert abs((up - down) / (2 * step) + extra - grads[name].reshape(-1)[i]) < 1e-4, name


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op2_byte_convnet"](spark, sf_dir).collect()}
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for d, r in got.items())
    labels = [(r.quality, got[r.doc_id]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([q == r.predicted for q, r in labels]) >= 0.93
    assert np.mean([r.predicted for q, r in labels if q == 1]) >= 0.98


def test_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, "text", "x"), (1, "text", "x"), (None, None, None), (3, "", "x"), (4, "y" * 300_000, "x")], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert bc.train(docs, none) is None
    assert [r.score for r in bc.with_scores(docs, None).collect()] == [0.5] * 5
    assert bc.keep_good(docs, None).count() == 5
    some = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (4, 0, None), (None, 1, "x"), (3, None, "x"), (99, 1, "x")], LABELS)
    net = bc.train(docs, some)
    scored = {(r.doc_id, r.score) for r in bc.with_scores(docs, net).collect()}
    assert len(scored) == 4
    kept = bc.keep_good(docs, net)
    assert kept.columns == DOCS.names and kept.count() <= 5
    assert bc.with_scores(spark.createDataFrame([], DOCS), net).count() == 0
