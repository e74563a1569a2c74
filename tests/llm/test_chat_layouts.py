"""Layouts, reversible templates and loss masks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.llm import chat_layouts as cl

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("mask", T.StringType())])


def both(spark, rows):
    table = spark.createDataFrame(rows, TURNS)
    formatted = cl.format_turns(cl.turn_rows(table, "conv_id"))
    return {r.key: r for r in formatted.collect()}, {r.key: r for r in cl.read_back(formatted).collect()}


def test_round_trip_of_nasty_texts(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<\\/s>", "", "a\nb</s>\n", "[[INST]]", "<</s>>", "[/INST]\n", "é🙂\\</s>", "[/INST", "x" * 5000, "\x00\t$1"]
    rows = [(c, i, role, t, "m") for c in (1, 2) for i, (role, t) in enumerate(zip(["user", "assistant"] * 7, texts[c - 1 :] + texts[: c - 1]))]
    formatted, back = both(spark, rows)
    for c in (1, 2):
        own = [r for r in rows if r[0] == c]
        assert [(t.role, t.text) for t in back[c].turns] == [(r[2], r[3]) for r in own]
        assert "".join(back[c].loss) == "".join(r[3] for r in own if r[2] == "assistant")
        assert back[c].formatted_chars == len(formatted[c].formatted)
        for span, r in zip(formatted[c].mask, own):
            cut = formatted[c].formatted[span.loss_start : span.loss_start + span.loss_length]
            assert cut == "" if r[2] != "assistant" else cut.replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") == r[3] or "\\" in r[3] or "\x00" in r[3]
        assert formatted[c].formatted.count(cl.END) == len(own)


def test_nulls_ties_and_long_conversations(spark):
    rows = [(None, 0, None, None, "m"), (None, None, "user", "first", "m"), (3, 0, "user", "b", "m"), (3, 0, "user", "a", "m"), (3, 0, "user", "a", "m"), (3, 1, "assistant]", "z", "m")]
    rows += [(9, i, "assistant", f"t{i} é", "m") for i in range(4000)]
    _, back = both(spark, rows)
    assert [(t.role, t.text) for t in back[None].turns] == [("user", "first"), ("", "")]
    assert [(t.role, t.text) for t in back[3].turns] == [("user", "a"), ("user", "a"), ("user", "b"), ("assistant]", "z")]
    assert "".join(back[9].loss) == "".join(f"t{i} é" for i in range(4000))
    assert both(spark, []) == ({}, {})


def test_layouts_become_the_same_turns(spark):
    want = [("user", "ask"), ("assistant", "say")]
    records = {
        1: {"prompt": "ask", "completion": "say"}, 2: {"instruction": "ask", "output": "say"}, 3: {"instruction": "ask", "input": "", "output": "say", "id": 7},
        4: {"messages": [{"role": "user", "content": "ask"}, {"role": "assistant", "content": "say", "weight": 1}]},
        5: {"conversations": [{"from": "human", "value": "ask"}, {"from": "gpt", "value": "say"}], "source": {"content": 1}},
        6: {"question": "ask", "answer": "say"}, 7: {"dialogue": [{"role": "User", "text": "ask"}, {"role": "bot", "text": "say"}]},
        8: {"system": "be kind", "prompt": "ask", "response": "say"}, 9: {"instruction": "ask", "input": "this", "output": "say"},
        10: {"title": "no layout"}, 11: "not an object", 12: {"messages": "text"}, 13: {"messages": []},
    }
    rows = [(k, v if isinstance(v, str) else json.dumps(v), "x") for k, v in records.items()] + [(14, None, "x")]
    table = spark.createDataFrame(rows, "id long, record string, turn string")
    got = {}
    for r in cl.turn_rows(table, "id", "record").orderBy("key", "turn").collect():
        got.setdefault(r.key, []).append((r.role, r.text) if r.layout_known else None)
    for k in range(1, 8):
        assert got[k] == want, k
    assert got[8] == [("system", "be kind"), *want] and got[9] == [("user", "ask\n\nthis"), ("assistant", "say")]
    assert all(got[k] == [None] for k in range(10, 15))
    marks = {r.id: r.m for r in table.select("id", cl.fingerprint(F.col("record")).alias("m")).collect()}
    assert marks[2] == marks[2] and marks[2] != marks[3] and marks[11] is None and marks[14] is None


def test_rows_of_tables_select_a_mapping_too(spark):
    say = lambda df, *more: sorted(((r.key, r.turn, r.role, r.text, r.layout_known) for r in cl.turn_rows(df, "id", *more).collect()), key=str)
    # Records that are one turn keep their number, role and text, in JSON and in columns.
    rows = [(1, 7, "Human", "a"), (1, None, None, None), (2, 0, "assistant", "")]
    table = spark.createDataFrame(rows, "id long, turn int, role string, text string")
    want = sorted(((i, t, r, x, True) for i, t, r, x in rows), key=str)
    assert say(table) == want
    as_json = table.select("id", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    assert say(as_json, "record") == want
    table = spark.createDataFrame([(1, "ask", "say", "x"), (2, None, "b", "y")], "id long, prompt string, completion string, note string")
    assert say(table) == [(1, 0, "user", "ask", True), (1, 1, "assistant", "say", True), (2, 0, "user", "", True), (2, 1, "assistant", "b", True)]
    table = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")], "be kind"), (2, [], "s"), (3, None, None)], "id long, conversations array<struct<from:string,value:string>>, system string")
    assert say(table) == [(1, 0, "system", "be kind", True), (1, 1, "user", "q", True), (1, 2, "assistant", "a", True), (2, 0, "system", "s", True), (3, None, None, None, False)]
    table = spark.createDataFrame([(1, "user", "t")], "id long, role string, text string")
    assert say(table) == [(1, None, None, None, False)]
    marks = table.select(cl.path_hash(F.array(*[F.lit(p) for p in cl.TURN_FIELDS])).alias("a"), cl.fingerprint(F.lit('{"text": null, "turn": 1, "role": "x", "id": 2}')).alias("b")).first()
    assert marks.a == marks.b
