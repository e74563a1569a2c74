"""Permutation, layout, resumption and the exact round trip of every text."""

from __future__ import annotations

import os
import random
import tempfile

import numpy as np
from pyspark.sql import types as T

from quorate.llm import training_order as to

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("slot", T.StringType())])


def test_every_number_has_one_slot():
    for count in (1, 2, 3, 5, 16, 17, 1000, 4097):
        slots = to.permuted(np.arange(count), count, 77)
        assert sorted(slots.tolist()) == list(range(count))
        again = to.permuted(np.arange(count)[::-1].copy(), count, 77)[::-1]
        assert (again == slots).all()
    assert (to.permuted(np.arange(1000), 1000, 1) != to.permuted(np.arange(1000), 1000, 2)).mean() > 0.9
    # Far from the given order: neighbours do not stay neighbours.
    assert (np.abs(np.diff(to.permuted(np.arange(1000), 1000, 1))) < 3).mean() < 0.05


def test_round_trip_and_resumption(spark):
    rng = random.Random(6)
    texts = ["", None, "a", "é" * 31, "x" * 63, "x" * 64, "x" * 65, "line\nbreak\r\n\x00end"] + ["".join(rng.choice("abcé\n你 ") for _ in range(rng.randrange(400))) for _ in range(80)]
    rows = [(i // 2 if i > 10 else i, t, "x") for i, t in enumerate(texts)] + [(None, "nameless", None), (3, "é" * 31, "x")]
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{base}/docs")
    docs = spark.read.schema(DOCS).parquet(f"{base}/docs")
    found, layout = to.records(docs, 9, 64, 50)
    assert to.write_shards(found, layout, f"{base}/out") == layout.shards > 3
    back = {r.slot: r for r in to.read_shards(spark, layout, f"{base}/out").collect()}
    assert sorted(back) == list(range(layout.count))
    for r in found.collect():
        assert bytes(back[r.slot].record) == bytes(r.record) and back[r.slot].n_tokens == r.n_tokens
        assert layout.at(r.slot)[0] == back[r.slot].shard
    # Read in the order of their numbers, sequences give back every text.
    slots = to.permuted(np.arange(layout.count), layout.count, 9)
    stream = b"".join(bytes(back[s].record)[: back[s].n_tokens] for s in slots.tolist())
    assert sorted(stream.split(b"\xff")[:-1]) == sorted((t or "").encode() for _, t, _ in rows)
    owners = {r.slot: r.doc_id for r in found.collect()}
    at, known, of = 0, [], {t: d for d, t, _ in rows if len(t or "") > 130}
    for s in slots.tolist():
        known.append((at, owners[s]))
        at += back[s].n_tokens
    for text, d in of.items():
        begin = stream.index(text.encode())
        assert any(o == d for p, o in known if begin < p <= begin + len(text.encode()))
    # A record is where arithmetic says.
    shard, place = layout.at(57)
    [name] = [f for f in os.listdir(f"{base}/out/shard={shard}") if f.endswith(".txt")]
    with open(f"{base}/out/shard={shard}/{name}", "rb") as file:
        file.seek(place)
        assert file.read(64) == bytes(back[57].record)
    # A lost shard is written again, the others are left.
    assert to.write_shards(found, layout, f"{base}/out") == 0
    os.remove(f"{base}/out/shard={shard}/{name}")
    assert to.write_shards(found, layout, f"{base}/out") == 1
    again = {r.slot: bytes(r.record) for r in to.read_shards(spark, layout, f"{base}/out").collect()}
    assert again == {s: bytes(r.record) for s, r in back.items()}


def test_empty_table(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame([], DOCS).write.parquet(f"{base}/docs")
    found, layout = to.records(spark.read.schema(DOCS).parquet(f"{base}/docs"), 9)
    assert layout.count == 0 and found.count() == 0 and to.write_shards(found, layout, f"{base}/out") == 0
