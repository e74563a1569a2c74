"""Overlap against plain windows, for long and short items, nulls and repeats."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import types as T

from quorate.llm import winnowing as w

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("h", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items):
    windows = {}
    for i, t in items:
        ws = words(t)
        n = min(13, len(ws))
        for k in range(len(ws) - n + 1 if n and i is not None else 0):
            windows.setdefault(tuple(ws[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        ws, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(ws[k : k + n])]
        out.append((d, len(ws), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return out


def check(spark, docs, items):
    got = w.overlap(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS), spark.createDataFrame([(*i, "z") for i in items], ITEMS)).collect()
    have = sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items), r.contaminated) for r in got), key=str)
    assert have == sorted(plain(docs, items), key=str)


def sentence(rng, n):
    return rng.choice([" ", "  ", ", ", "\n"]).join(rng.choice(["Über", "a1", "the", "X", "éé", "q7", "word", "zz", "in", "on"]) + str(rng.randrange(9)) for _ in range(n))


def test_random_overlaps(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.choice([1, 2, 5, 12, 13, 14, 30, 60]))) for i in range(30)]
    items += [(3, sentence(rng, 20)), (77, items[5][1]), (None, sentence(rng, 20)), (8, None), (9, ""), (9, "?!")]
    docs = []
    for d in range(120):
        parts = [sentence(rng, rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            text = rng.choice(items)[1] or ""
            ws = text.split(" ")
            lo = rng.randrange(len(ws))
            parts.append(" ".join(ws[lo : lo + rng.choice([5, 13, 20, 99])]))
            parts.append(sentence(rng, rng.randrange(30)))
        docs.append((d, rng.choice([" ", "-"]).join(parts)))
    docs += [docs[3], docs[3], (3, "other text"), (None, docs[4][1]), (500, None), (501, ""), (502, "x" * 200_000), (503, sentence(rng, 20_000) + " " + items[6][1])]
    check(spark, docs, items)


def test_texts_that_touch_do_not_share_words_or_windows(spark):
    item = " ".join(f"w{i}" for i in range(13))
    docs = [(1, " ".join(f"w{i}" for i in range(7))), (2, " ".join(f"w{i}" for i in range(7, 13))), (3, item[:-1]), (4, "2"), (5, item)]
    check(spark, docs, [(1, item)])
    check(spark, docs, [])
    check(spark, [], [(1, item)])


def test_winnowing_keeps_a_gram_of_every_window():
    rng = np.random.default_rng(0)
    for length in range(1, 14):
        hashes = rng.integers(0, 6, 400).astype(np.uint64)
        owner = np.repeat([0, 1, 2], [200, 5, 195])
        at, _, windows = w.winnow(hashes, owner, length)
        k = (length + 1) // 2
        kept = set(at.tolist())
        for s in range(400 - length + 1):
            if owner[s] == owner[s + length - 1]:
                assert any(p in kept for p in range(s, s + length - k + 1))
        assert len(at) == 0 or (windows != 0).any(axis=1).all()


def test_drop_keeps_columns(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, item, "x", "y"), (1, "clean", "x", "y"), (None, item, "x", "y"), (2, None, None, None)], DOCS)
    kept = w.drop_contaminated(docs, spark.createDataFrame([(5, item, "z")], ITEMS))
    assert kept.columns == DOCS.names and sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "clean"), ("2", None)]
