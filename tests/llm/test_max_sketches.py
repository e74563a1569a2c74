"""Ranked search against scores of all documents, and bounds against scores."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from quorate.llm import max_sketches as ms

TABLE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.StringType()), T.StructField("score", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("doc_id", T.StringType())])


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, items, k=10):
    counted = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        found = []
        for d, c in counted:
            m = 10 + (90 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def made(rng, n_docs=300, n_items=25):
    words = [f"w{i}" for i in range(400)] + ["É", "über", "ß9"]
    share = [1 / (1 + i) for i in range(len(words))]
    docs = [(rng.randrange(10**6), " ".join(rng.choices(words, share, k=rng.choice([0, 1, 5, 40, 300])))) for _ in range(n_docs)]
    docs += [(rng.randrange(10**6), docs[7][1]) for _ in range(60)] + [docs[3], docs[3], (None, "w1 w2 w300"), (5, None), (6, ""), (7, "-- !"), (8, "W399 " * 20_000)]
    items = [(i, ", ".join(rng.choices(words, share, k=rng.choice([1, 3, 12])))) for i in range(n_items)]
    items += [(90, docs[7][1]), (91, None), (92, "nowhere"), (93, "w398"), (93, "W397; w398"), (None, "w5"), (94, "")]
    return docs, items


def ours(spark, docs, items, k=10):
    d = spark.createDataFrame([(*r, "a", "b") for r in docs], TABLE)
    i = spark.createDataFrame([(*r, "c") for r in items], ITEMS)
    out = ms.search(d, i, k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(tuple(r) for r in out.collect())


def test_all_items_against_all_documents(spark):
    docs, items = made(random.Random(1))
    assert ours(spark, docs, items) == plain(docs, items)


def test_small_blocks_batches_and_rounds(spark, monkeypatch):
    for name, value in (("BATCH_TERMS", 40), ("BLOCK_POSTINGS", 300), ("CELLS", 64), ("ROUND", 1), ("LEAST", 2), ("SPREAD", 1)):
        monkeypatch.setattr(ms, name, value)
    docs, items = made(random.Random(2))
    assert ours(spark, docs, items, 3) == plain(docs, items, 3)


@pytest.mark.parametrize("seed", range(5))
def test_bounds_hold_and_spare_exact_scores(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 300, 800)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    vocabulary = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    terms_ = np.concatenate([np.sort(rng.choice(vocabulary, s, replace=False)) for s in sizes])
    impacts = rng.integers(1, 1_000_000, len(terms_))
    universe = np.sort(rng.choice(vocabulary, 500, replace=False))
    query_sizes = rng.integers(1, 40, 30)
    query_starts = np.concatenate(([0], np.cumsum(query_sizes)))
    own = np.concatenate([np.sort(rng.choice(500, s, replace=False)) for s in query_sizes])
    queries = ms.Queries(list(range(30)), universe, rng.integers(1, 20_000, 500), query_starts, own)
    bounds = ms.Sketches(starts, terms_, impacts).bounds(queries)
    exact = ms.Postings(starts, terms_, impacts, queries)
    q, d = (v.ravel() for v in np.meshgrid(np.arange(30), np.arange(800), indexing="ij"))
    scores = exact.scores(q, d)
    assert (bounds[q, d] >= scores).all()
    best = ms.Best(30, 10)
    taken = ms.rank_block(np.arange(800), starts, terms_, impacts, queries, best)
    assert taken < len(q) // 4
    for i in range(30):
        want = sorted((-s, j) for j, s in enumerate(scores[q == i].tolist()) if s > 0)[:10]
        assert [(-s, j) for s, j in zip(best.score[best.query == i].tolist(), best.doc[best.query == i].tolist())] == want


def test_empty_tables(spark):
    docs, items = made(random.Random(3), 20, 3)
    assert ours(spark, [], items) == [] and ours(spark, docs, []) == [] and ours(spark, [(1, None)], items) == []


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**9], np.int64)
    assert ms.length_terms(n, 10**10, 10**13).tolist() == [10 + 90 * v * 10**10 // 10**13 for v in n.tolist()]
