"""Encoding against the tokenizers library, and exact round trips."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from quorate.llm.speculative_bpe import Codec, encode_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tools():
    theirs = Tokenizer.from_file(PATH)
    theirs.no_padding()
    theirs.no_truncation()
    return Codec(PATH), theirs


def agree(tools, text):
    ours, theirs = tools
    found = ours.encode([text])[0]
    ids = found.tolist()
    want = theirs.encode(text, add_special_tokens=False).ids
    assert ids == want, text[:60]
    back = ours.decode(found).decode("utf-8", "replace")
    assert back == theirs.decode(want, skip_special_tokens=False)
    assert back == text


def test_edge_texts(tools):
    for text in ["", " ", "\n\n  \t x", "don't we'll I'm 'S 'LL", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "naïve façade 你好世界 שלום 🙂🙃👩‍👩‍👧",
                 "\x85\xa0  x　y\x1c\x1d z\x1f", "a" * 3000, "ab" * 2000 + "c", " " * 500, "1234567890 ½ ² Ⅷ ٣", "!!??..,,;;", "\x00\x01\x7f", "é ­​﻿", "the" * 700]:
        agree(tools, text)


def test_random_texts(tools):
    rng = random.Random(11)
    syllables = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ci ón eau ß ü é ñ".split()
    for _ in range(400):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(60))]
        agree(tools, rng.choice([" ", "  ", "\n", " | "]).join(words))
    for _ in range(400):
        agree(tools, "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 127), rng.randrange(160, 0x500), rng.randrange(0x2000, 0x2100), rng.randrange(0x4E00, 0x4F00), rng.randrange(0x1F300, 0x1F400)])) for _ in range(rng.randrange(80))))


def test_cleared_memory_and_long_text(tools, monkeypatch):
    from quorate.llm import speculative_bpe as sb

    monkeypatch.setattr(sb, "REMEMBERED_WORDS", 50)
    monkeypatch.setattr(sb, "SLICE", 20)
    rng = random.Random(2)
    ours = Codec(PATH)
    text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(900))
    agree((ours, tools[1]), text)


def test_table(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])
    rows = [(1, "Hello there", "x"), (1, "Hello there", "x"), (None, None, None), (2, "", "y")]
    got = [(r.doc_id, list(r.ids), r.decoded) for r in encode_texts(spark.createDataFrame(rows, schema), PATH).collect()]
    want = Tokenizer.from_file(PATH).encode("Hello there", add_special_tokens=False).ids
    assert sorted(got, key=str) == sorted([(1, want, "Hello there")] * 2 + [(None, [], ""), (2, [], "")], key=str)
    assert encode_texts(spark.createDataFrame([], schema), PATH).count() == 0
