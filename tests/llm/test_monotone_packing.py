"""Packing against a plain dynamic programme, the tokenizers library and exact reassembly."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.llm import monotone_packing as mp
from quorate.llm.queries import QUERIES
from quorate.llm.word_codec import WordCodec, codec

PATH = public_tokenizers.path("word_bpe_49k.json")
SF_DIR = "/root/testdata/sf0.001"


def expected(coder, text):
    return [*coder.library.encode(text or "", add_special_tokens=False).ids, 2]


def agree(coder, texts):
    ids, counts = coder.encode(texts)
    at = 0
    for text, n in zip(texts, counts.tolist()):
        assert ids[at : at + n].tolist() == coder.library.encode(text, add_special_tokens=False).ids, text[:60]
        at += n
    assert at == len(ids)


def test_ids_are_those_of_the_library():
    coder, rng = codec(PATH), random.Random(3)
    agree(coder, ["'s's 'SAB'll'lla ''s !'s 're're've'd't'm 'r 'l", "", "  \n", "<|endoftext|> a", "x" * 3000, "İstanbul", "你好 world", "a'", "'", "'s", "3.5 4'5"])
    agree(coder, [chr(c) + "a" + chr(c) for c in range(0x300)])
    mixed = [lambda: rng.randrange(0x250), lambda: rng.randrange(0x30, 0x7F), lambda: rng.choice([39, 32, 115, 108])]
    agree(coder, ["".join(chr(rng.choice(mixed)()) for _ in range(rng.randrange(60))) for _ in range(2000)])


def test_words_are_forgotten_and_learned_again(monkeypatch):
    from quorate.llm import word_codec

    monkeypatch.setattr(word_codec, "REMEMBERED_WORDS", 60)
    monkeypatch.setattr(word_codec, "BLOCK", 200)
    coder, rng = WordCodec(PATH), random.Random(4)
    agree(coder, [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(30)) for _ in range(60)])


def plain_cost(n, penalty, window, dense):
    """Least cost over all cuts, by trying every earlier place; powers of two only among dense places."""
    places = sorted(penalty)
    cost = {0: 0}
    for j in places[1:]:
        options = []
        for i in places:
            size = j - i
            if 0 < size <= window:
                free = size == window or (size & (size - 1) == 0 and i >= dense)
                options.append(cost[i] + (0 if free else window - size))
        cost[j] = min(options) + penalty[j]
    return cost[n]


@pytest.mark.parametrize("seed", range(12))
def test_cuts_are_the_cheapest(seed):
    rng = random.Random(seed)
    window = 16
    n = rng.randrange(1, 160)
    ends = np.array([0, 1, 2], np.uint8)
    ids = np.array([rng.choice([0, 0, 0, 0, 1, 2]) for _ in range(n)])
    doc_ends = np.array(sorted({rng.randrange(1, n + 1) for _ in range(rng.randrange(1, 6))} | {n}))
    places, penalties, dense = mp.cut_places(ids, doc_ends, ends, window)
    if np.diff(places).max(initial=0) > window:
        places, penalties = np.arange(n + 1), np.full(n + 1, 3)
        penalties[doc_ends] = 0
        dense = max(0, n - window)
    cost, cuts = mp.best_cuts(places.tolist(), penalties.tolist(), dense, window)
    own = dict(zip(places.tolist(), penalties.tolist()))
    assert cost == plain_cost(n, own, window, places[dense])
    sizes = np.diff([0, *cuts])
    assert cuts[-1] == n and (sizes > 0).all() and (sizes <= window).all() and set(cuts) <= set(own)


def test_long_stretches_without_a_sentence_end_can_be_cut():
    n = 30_000
    places, penalties, dense = mp.cut_places(np.zeros(n, int), np.array([n]), np.zeros(1, np.uint8), mp.WINDOW)
    assert np.diff(places).max() <= 2 * mp.GAP and places[0] == 0 and places[-1] == n
    _, cuts = mp.best_cuts(places.tolist(), penalties.tolist(), dense, mp.WINDOW)
    sizes = np.diff([0, *cuts]).tolist()
    assert max(sizes) <= mp.WINDOW and sum(0 if s & (s - 1) == 0 else mp.WINDOW - s for s in sizes) <= mp.WINDOW // 16


def check_pieces(coder, rows, pieces, window):
    """Every token of every document in one piece, offsets gapless, little padding."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        by_doc.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, len(ids)))
    assert by_doc.keys() == {d for d, _ in rows}
    for d, text in rows:
        found = sorted(by_doc[d])
        want = expected(coder, text)
        assert [t for _, ids, _ in found for t in ids] == want and {n for *_, n in found} == {len(want)}
        assert [s for s, *_ in found] == np.cumsum([0, *[len(ids) for _, ids, _ in found]])[:-1].tolist()
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
        assert sum(n for _, n in parts) <= window
    return {s: sum(n for _, n in parts) for s, parts in by_sequence.items()}


def test_documents_of_the_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sizes = check_pieces(codec(PATH), rows, mp.pack(docs, PATH, 2).collect(), mp.WINDOW)
    tokens = sum(sizes.values())
    padded = sum(n if n & (n - 1) == 0 else mp.WINDOW for n in sizes.values())
    assert padded - tokens <= 0.005 * tokens
    digests = {(r.doc_id, r.start): r for r in QUERIES["op11_monotone_packing"](spark, SF_DIR).collect()}
    import zlib

    for d, text in rows:
        want = expected(codec(PATH), text)
        own = sorted(k for k in digests if k[0] == d)
        for k in own:
            r = digests[k]
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes())
        assert sum(digests[k].length for k in own) == len(want) == digests[own[0]].doc_tokens


def test_odd_rows_short_runs_and_sequences(spark, monkeypatch):
    monkeypatch.setattr(mp, "RUN", 500)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.StringType())])
    rows = [(1, "One. Two 3.5 three."), (2, None), (3, ""), (4, "word " * 5000), (5, "x" * 20_000), (6, "a. " * 900)]
    table = spark.createDataFrame([(*r, "z") for r in rows], schema)
    pieces = mp.pack(table, PATH, 2).collect()
    sizes = check_pieces(codec(PATH), rows, pieces, mp.WINDOW)
    whole = mp.sequences(mp.pack(table, PATH, 2), 7).collect()
    assert {r.sequence_id: r.n_tokens for r in whole} == sizes
    for r in whole:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else mp.WINDOW) and (ids[r.n_tokens :] == 7).all()
    again = spark.createDataFrame([(9, "same text", "a"), (9, "same text", "a"), (None, "no id", "b")], schema)
    assert sorted((r.doc_id is None, r.doc_tokens) for r in mp.pack(again, PATH, 2).where('start = 0').collect()) == [(False, 3), (False, 3), (True, 3)]
    assert mp.pack(spark.createDataFrame([], schema), PATH, 2).count() == 0
    with pytest.raises(ValueError):
        mp.pack(table, PATH, 2, carry=("doc_id", "start"))


def test_padding_of_a_larger_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = mp.pack(docs, PATH, 2).groupBy("sequence_id").agg(F.sum(mp.token_count()).alias("n"))
    tokens, taken = sizes.agg(F.sum("n"), F.sum(mp.padded_size(F.col("n")))).first()
    assert taken - tokens <= 0.003 * tokens
