"""Smallest capacity against trying all cuts, slots without gaps, copies together."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

from quorate.llm import contiguous_shards as cs
from quorate.llm.queries import QUERIES

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("cell", T.StringType())])


def smallest(sizes, shards):
    best = sum(sizes)
    for cut in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1):
        edges = (0, *cut, len(sizes))
        best = min(best, max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])))
    return best


def test_capacity_is_the_smallest(spark, monkeypatch):
    rng = random.Random(8)
    for read in (200_000, 3):
        monkeypatch.setattr(cs, "READ_GROUPS", read)
        for case in range(4):
            sizes = [rng.choice([1, 2, 9, 40, 200]) for _ in range(14)] if case else [5]
            keys = sorted(rng.randrange(-(2**63), 2**63) for _ in sizes)
            groups = cs.Groups(spark.createDataFrame(list(zip(keys, sizes)), "key bigint, bytes bigint"))
            for shards in (1, 2, 4):
                assert cs.smallest_capacity(groups, shards) == smallest(sizes, shards)
                assert set(cs.cuts(groups, shards)) <= set(keys)


def test_rows_and_slots(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    rows = [(i, rng.choice(texts), "x") for i in range(900)] + [(10_000 + i, "hot " * 20, "x") for i in range(500)] + [(None, None, "x"), (5, None, None), (6, "", "x"), (7, "a", "x"), (7, "a", "x")]
    got = cs.assign_shards(spark.createDataFrame(rows, DOCS), 16).collect()
    assert Counter((r.doc_id, r.text, r.cell) for r in got) == Counter(rows)
    where, slots, filled = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        assert r.size == len((r.text or "").encode()) + 1
        where[r.text].add(r.shard)
        slots[r.shard].append(r.slot)
        filled[r.shard] += r.size
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(16))
    largest = max(Counter({t: sum(r.size for r in got if r.text == t) for t in where}).values())
    assert max(filled.values()) <= -(-sum(filled.values()) // 16) + largest
    assert cs.assign_shards(spark.createDataFrame([], DOCS), 16).count() == 0


def test_crowded_buckets_are_refined_before_they_are_read(spark, monkeypatch):
    monkeypatch.setattr(cs, "READ_GROUPS", 4)
    monkeypatch.setattr(cs, "BUCKET_BITS", 3)
    rng = random.Random(4)
    # Most keys share their leading bits, some of them all but the last few.
    keys = sorted({rng.randrange(1 << 61) - (1 << 62) for _ in range(40)} | {77 + (1 << 50) * i for i in range(30)} | {-5, -1, 0, 1, 2, 3, 4, 5, 6, 2**63 - 1, -(2**63)})
    sizes = [rng.randrange(1, 50) for _ in keys]
    groups = cs.Groups(spark.createDataFrame(list(zip(keys, sizes)), "key bigint, bytes bigint"))
    ends = list(itertools.accumulate(sizes))
    assert groups.total == ends[-1] and groups.largest == max(sizes) and groups.level.depth == 0
    for position in rng.sample(range(-1, ends[-1] + 2), 60):
        k = sum(e <= position for e in ends)
        want = (ends[-1], None) if position >= ends[-1] else (ends[k - 1] if k else 0, keys[k])
        assert groups.reach(max(position, 0)) == want or position < 0
    assert groups.level.inner and any(level.inner for level in groups.level.inner.values())


def test_clashing_columns_are_refused_and_hot_rows_are_spread(spark):
    with pytest.raises(ValueError):
        cs.assign_shards(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, Slot int"))
    rows = [(1, "same", "x")] * 3000 + [(i, "x" * 100_000 if i == 2 else f"t{i}", "x") for i in range(2, 60)]
    got = cs.assign_shards(spark.createDataFrame(rows, DOCS), 4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.text == "same"}) == 1


def test_query_contract(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = QUERIES["op10_contiguous_shards"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id for r in got} == set(texts)
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None for r in got)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(sizes) == 16
