"""SimHash trie join against all pairs."""

from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import types as T

from quorate.llm import simhash_trie as st

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("component_id", T.StringType())])


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(pairs, max_bits=4):
    """pairs: (doc_id, fp); smallest doc_id reachable, by union-find over all pairs."""
    parent = list(range(len(pairs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= max_bits:
                parent[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(pairs):
        out.setdefault(find(i), []).append(d)
    return [min((d for d in out[find(i)] if d is not None), default=None) for i in range(len(pairs))]


def rows_of(texts, ids=None):
    return [(i if ids is None else ids[i], t, "x", "y") for i, t in enumerate(texts)]


def test_fingerprint_of_edge_texts():
    rng = random.Random(3)
    for text in ["", "   \n", "One", "a B\tc", "A b C d", "x " * 5000, "é ü ñ ß 你好   z", " ".join(rng.choice("abcdefg") * 3 for _ in range(999))]:
        assert st.fingerprint(text.encode()) == slow_fingerprint(text), text[:20]


def test_components_match_all_pairs(spark):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    texts = list(base)
    for t in base[:20]:
        words = t.split()
        for _ in range(4):
            words[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += ["", None, " \n", "a", "a", base[0]]
    ids = [(7 * i) % 1000 for i in range(len(texts))]
    ids[5] = None
    got = {}
    for r in st.near_duplicates(spark.createDataFrame(rows_of(texts, ids), DOCS)).collect():
        got.setdefault((r.doc_id, r.fp & (1 << 64) - 1), []).append(r.component_id)
    pairs = [(d, slow_fingerprint(t)) for d, t in zip(ids, texts)]
    want = {}
    for (d, f), c in zip(pairs, slow_components(pairs)):
        want.setdefault((d, f), []).append(c)
    assert got == want


def test_trie_walk_finds_planted_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 300, dtype=np.uint64)
    values = set(centres.tolist())
    for c in centres[:150].tolist():
        for _ in range(6):
            x = c
            for b in rng.choice(64, 4, replace=False):
                x ^= 1 << int(b)
            values.add(x)
    # A crowd within a few bits of each other, larger than one leaf.
    for a in range(64):
        for b in range(a):
            values.add(int(centres[299]) ^ (1 << a) ^ (1 << b))
    values = sorted(values)
    nodes = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp bigint")
    edges = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in st.links(nodes).collect()]
    assert all((a ^ b).bit_count() > 0 for a, b in edges)
    want = slow_components([(v, v) for v in values])
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for v in values:
        groups.setdefault(find(v), []).append(v)
    assert [min(groups[find(v)]) for v in values] == want
    assert len(edges) <= 40 * len(values)


def test_blocks_of_a_crowded_prefix(spark, monkeypatch):
    monkeypatch.setattr(st, "BLOCK", 16)
    rng = np.random.default_rng(2)
    values = {int(v) >> 20 for v in rng.integers(0, 2**63, 400, dtype=np.uint64)}
    values |= {v ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for v in list(values)}
    values = sorted(values)
    nodes = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp bigint")
    edges = {(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in st.links(nodes).collect()}
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for v in values:
        groups.setdefault(find(v), []).append(v)
    assert [min(groups[find(v)]) for v in values] == slow_components([(v, v) for v in values])


def test_empty_table_and_keep_one(spark):
    empty = spark.createDataFrame([], DOCS)
    assert st.near_duplicates(empty).count() == 0
    assert st.keep_one(empty).count() == 0
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(3, text, "x", "y"), (1, text, "x", "y"), (1, text, "x", "y"), (None, text, "x", "y"), (9, "other words entirely here now", "x", "y"), (4, None, "x", "y"), (5, "", "x", "y")]
    kept = st.keep_one(spark.createDataFrame(rows, DOCS))
    assert kept.columns == DOCS.names
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, text), (4, None), (9, "other words entirely here now")]
