"""The exact similarity join and its pipeline stage against all pairs."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from quorate.llm import shingle_join as sj
from quorate.llm.common import text_blocks

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n", T.StringType())])


def plain_set(text, width=5):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ") if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_keepers(rows):
    """The doc_ids that stay, by a comparison of all pairs."""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(min(g) for g in groups.values())


def made(rng):
    """Texts with 0 to 8 words changed: similarities on both sides of 0.8, chains among them."""
    rows = []
    passage = " ".join(f"common{i}" for i in range(40))
    for _ in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 5, 9, 30, 80, 200]))]
        for _ in range(rng.randrange(1, 6)):
            for _ in range(rng.randrange(4)):
                words = list(words)
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(words).upper() if rng.random() < 0.1 else " ".join(words))
        if rng.random() < 0.4:
            rows.append(" ".join(words[:20]) + "\n" + passage)
    rows += ["", "  \n", "one", "One", "a b c d", "a b c d e", passage, passage + " end"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("small", [False, True])
def test_stage_keeps_one_of_each_group_of_near_copies(spark, monkeypatch, small):
    monkeypatch.setattr(sj, "SAMPLE", 50)
    if small:
        monkeypatch.setattr(sj, "FEW", 2)
        monkeypatch.setattr(sj, "BLOCK", 3)
        # Without the links found first, all pairs are left to the blocks.
        monkeypatch.setattr(sj, "simhash_pairs", lambda texts: texts.select(F.col("key").alias("a"), F.col("key").alias("b")).where("false"))
    rows = made(random.Random(11 + small))
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)
    kept = corpus_pipeline.near_duplicates(spark, table, "")
    assert kept.columns == DOCS.names
    assert sorted(r.doc_id for r in kept.collect()) == plain_keepers(rows)


def test_copies_beyond_four_bits_go(spark):
    words = [f"w{i}" for i in range(100)]
    near = words[:50] + ["other"] + words[51:]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:50] + near[50:70]))]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS), "")
    assert sorted(r.doc_id for r in kept.collect()) == plain_keepers(rows) == [1, 3]


def test_documents_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == plain_keepers(rows)


def test_null_and_repeated_rows(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(3, text), (1, text), (1, text), (None, text), (9, "other words here"), (4, None), (5, "")]
    kept = sj.keep_one(spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, text), (4, None), (9, "other words here")]
    assert sj.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def sets_of(texts):
    [(_, _, data, offsets)] = text_blocks(pa.array(texts))
    keys, value, text = sj.block_sets(data, offsets)
    return keys, [value[text == i] for i in range(len(texts))]


def test_sets_keys_and_bounds():
    rng = random.Random(5)
    rows = [t for _, t in made(rng)]
    keys, sets = sets_of(rows)
    plain = [plain_set(t) for t in rows]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    bits = [sj._bitmaps(s, np.zeros(len(s), np.int64), 1)[0] for s in sets]
    for i in range(len(rows)):
        for j in range(0, i, 7):
            both = len(plain[i] & plain[j])
            assert len(np.intersect1d(sets[i], sets[j])) == both
            union = len(plain[i]) + len(plain[j]) - both
            assert sj.similar(sets[i], sets[j]) == (5 * both >= 4 * union)
            flipped = int(np.bitwise_count(bits[i] ^ bits[j]).sum())
            assert flipped <= union - both
            if sj.similar(sets[i], sets[j]):
                assert flipped <= sj.most_apart(len(sets[i]), len(sets[j]))
    words = [tuple(t.lower().split()) for t in rows]
    assert all((keys[i] == keys[j]) == (words[i] == words[j]) for i in range(len(rows)) for j in range(i))


def test_repeated_rows_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 300_000), (4, "x" * 300_000)] + [(7, "same text here")] * 300
    kept = sj.keep_one(spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, long), (3, "x" * 300_000), (7, "same text here")]


def test_rare_shingle_of_different_texts_makes_no_pair(spark):
    """Places and sketches rule out what sizes alone allowed: before, every two texts with one passage met."""
    def text(i, n, shared):
        own = [f"t{i}x{j}" for j in range(n)]
        own[n // 2 : n // 2 + 6] = [f"passage{shared}x{j}" for j in range(6)]
        return own

    texts = [text(i, n, n) for n in (60, 400) for i in range(8)]
    near = [[*texts[0][:-1], "changed"], ["changed", *texts[8][1:]]]
    rows = spark.createDataFrame([(i, " ".join(t), "x", "y") for i, t in enumerate(texts + near)], DOCS)
    described = sj.described(rows).select("doc_id", F.col("key").alias("k"), "n", *sj.sketch(F.col("bits")), F.posexplode("prefix").alias("at", "s"))
    pairs = sj.few_pairs(described.withColumnRenamed("k", "key")).collect()
    keys = {r.doc_id: r.k for r in described.select("doc_id", "k").distinct().collect()}
    assert {(r.a, r.b) for r in pairs} == {tuple(sorted((keys[i], keys[j]))) for i, j in ((0, 16), (8, 17))}


def test_wide_bitmaps_bound_and_part_large_sets():
    """Sets of thousands of shingles fill the narrow bitmaps, which let all of them pass; the wide ones do not."""
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (40, 1000, 1025, 2500, 3900, 4100, 4200, 9000)]
    sets += [np.unique(np.concatenate((s[len(s) // 10 :], rng.integers(0, 1 << 63, len(s) // 10).astype(np.uint64)))) for s in sets]
    sizes = np.array([len(s) for s in sets])
    value, text = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    flat, words = sj._wide_bitmaps(value, text, sizes)
    wide = np.split(flat, np.cumsum(words)[:-1])
    narrow = sj._bitmaps(value, text, len(sets))
    assert [len(w) for w in wide[:8]] == [0, 0, 32, 64, 64, 128, 128, 256]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            apart = sj.wide_apart(wide[i], wide[j])
            assert apart == sj.wide_apart(wide[j], wide[i]) <= len(np.setxor1d(a, b))
            most = sj.most_apart(len(a), len(b))
            if sj.similar(a, b):
                assert apart <= most
            elif min(len(a), len(b)) >= 2500 and max(len(a), len(b)) * 4 <= min(len(a), len(b)) * 5:
                assert int(np.bitwise_count(narrow[i] ^ narrow[j]).sum()) <= most < apart


def test_sets_of_long_texts_with_one_passage_are_not_read(spark, monkeypatch):
    """Before, every long text that shared a passage was read again and its set sent with each of its pairs."""
    monkeypatch.setattr(sj, "SAMPLE", 1)
    rng = random.Random(3)
    passage = [f"passage{j}" for j in range(40)]
    texts = [[f"t{i}x{j}" for j in range(1500)] + passage + [f"t{i}y{j}" for j in range(1500 + rng.randrange(50))] for i in range(12)]
    texts.append(["changed", *texts[4][1:]])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    read, plain = [], sj.wanted_sets

    def counted(docs, wanted, width):
        read.append(wanted.select("h").distinct().count())
        return plain(docs, wanted, width)

    monkeypatch.setattr(sj, "wanted_sets", counted)
    monkeypatch.setattr(sj, "sampled_texts", lambda docs: docs.select("text").limit(0))
    kept = sj.keep_one(spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == plain_keepers(rows) == list(range(12))
    assert sum(read) == 2


def test_shingles_of_frequent_words_come_last(spark):
    """Shingles that chance repeats, since their words are frequent, are in no prefix of a text that has others."""
    rng = random.Random(4)
    texts = []
    for i in range(30):
        words = [f"rare{i}x{j}" for j in range(60)]
        for at in range(0, 60, 12):
            words[at : at + 6] = [rng.choice(["the", "of", "and", "in"]) for _ in range(6)]
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS)
    frequent = spark.createDataFrame([(i, " ".join(w), "x", "y") for i, w in enumerate(itertools.product(["the", "of", "and", "in"], repeat=5))], DOCS)
    common = [r.s for r in sj.described(frequent).select(F.explode("prefix").alias("s")).distinct().collect()]
    prefixes = sj.described(docs).select(F.explode("prefix").alias("s"))
    assert prefixes.where(F.col("s").isin(common)).count() == 0
