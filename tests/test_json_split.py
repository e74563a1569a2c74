"""JSON files of all layouts cut into records, in one range and in many, against the json module."""

from __future__ import annotations

import json
import random

import pytest

from quorate.sources import json_split as js
from quorate.sources import records as rec


@pytest.fixture()
def ranges(spark):
    """Files are dealt in small ranges."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def odd_text(rng):
    return "".join(rng.choice(['"', "\\", "}", "{", "[", "]", ",", ":", "\n", "é", "🙂", " ", "a", "\\\\", "\t"]) for _ in range(rng.randrange(40)))


def odd_value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 4)
    if kind < 2:
        return odd_text(rng)
    if kind == 2:
        return rng.choice([None, True, 0, -1.5e3])
    if kind == 3:
        return {}
    if kind == 4:
        return [odd_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {odd_text(rng): odd_value(rng, depth + 1) for _ in range(rng.randrange(4))}


def raws(spark, *paths):
    return sorted((r.file, r.kind, r.pos, r.raw) for r in js.read_json_values(spark, [str(p) for p in paths]).collect())


@pytest.mark.parametrize("seed", range(2))
def test_lists_and_objects_are_cut_anywhere(spark, tmp_path, ranges, seed):
    rng = random.Random(seed)
    values = [odd_value(rng) for _ in range(60)] + ["x" * 2000, {"long": "}" * 900}]
    indent = rng.choice([None, 1])
    (tmp_path / "a.json").write_text("\ufeff" * (seed == 1) + " \n" + json.dumps(values, indent=indent, ensure_ascii=seed == 0) + "\n", encoding="utf-8")
    members = {f"k{i}\\\"}}": v for i, v in enumerate(values)}
    (tmp_path / "b.json").write_text(json.dumps(members, indent=indent) + (" " * 700 if seed else ""), encoding="utf-8")
    rows = js.read_json_values(spark, [str(tmp_path)])
    got = sorted((r.file, r.pos, r.raw) for r in rows.collect())
    assert [json.loads(t) for f, _, t in got if f == "a.json"] == values
    assert [json.loads("{" + t + "}") for f, _, t in got if f == "b.json"] == [{k: v} for k, v in members.items()]
    assert [p for f, p, _ in got if f == "a.json"] == list(range(len(values)))


def test_a_list_on_one_line_is_read_by_many_tasks(spark, tmp_path, ranges):
    values = [{"id": str(i), "text": "some text " * 5} for i in range(200)]
    (tmp_path / "a.json").write_text(json.dumps(values), encoding="utf-8")
    rows = spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).select("_metadata.file_path", "_metadata.file_block_start").distinct()
    assert rows.count() > 10
    found = rec.read_corpora(spark, [str(tmp_path / "a.json")]).orderBy("load_order").collect()
    assert [(r.doc_id, r.text, r.load_order) for r in found] == [(v["id"], v["text"].strip(), i) for i, v in enumerate(values)]


@pytest.mark.parametrize("text", ["[]", " [ \n ] ", "{}", "[1]", '["a,b]"]', '{"a": [1, 2]}', "[[[]]]", "[{}]\n\n"])
def test_small_files(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text, encoding="utf-8")
    value = json.loads(text)
    got = [t for *_, t in raws(spark, tmp_path / "a.json")]
    if isinstance(value, list):
        assert [json.loads(t) for t in got] == value
    else:
        assert [json.loads("{" + t + "}") for t in got] == [{k: v} for k, v in value.items()]


@pytest.mark.parametrize("text", ["", "   ", "7", '"a"', "[1] [2]", '{"a": 1} x', '{"a": "x"} garbage', "x [1]", "[1", '[{"id": "x"}, {"id": ', "[1]]", "]", "[1,]", "[,1]", "[1,,2]", '["a', '{"a": 1', '[{"id": 1} {"id": 2}]', '[{"id": 1} x]', "[{]}", '{"questions": [{"question_number": 1}]} trailing'])
def test_what_is_not_one_value_stops_the_job(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text, encoding="utf-8")
    load = rec.questions_of_values if "questions" in text else rec.corpus_of_values
    with pytest.raises(Exception):
        load(js.read_json_values(spark, [str(tmp_path / "a.json")])).collect()


def test_texts_in_a_table_hold_one_value(spark):
    row = lambda raw: spark.createDataFrame([("f.json", "f", raw)], "file string, stem string, raw string")
    assert [tuple(r) for r in rec.corpus_records(row('[{"id": "a", "text": "b"}]')).collect()] == [("f.json", "a", "b", 0)]
    for raw in ('[{"id": "a"}] [{"id": "b"}]', '{"a": "x"} garbage', "", '[{"id": "a"}],[]'):
        for load in (rec.corpus_records, rec.question_items):
            with pytest.raises(Exception):
                load(row(raw)).collect()


def test_json_lines_are_records(spark, tmp_path, ranges):
    lines = [{"id": f"d{i}", "texto": f"um {i} " + "x" * (i % 40)} for i in range(150)]
    text = "\r\n".join(json.dumps(x) for x in lines[:75]) + "\r\n\n" + "\n".join(json.dumps(x) for x in lines[75:])
    (tmp_path / "a.jsonl").write_bytes(text.encode())
    values = js.read_json_lines(spark, [str(tmp_path / "a.jsonl")]).orderBy("pos").collect()
    assert [json.loads(r.raw) for r in values] == lines and [r.pos for r in values] == [*range(75), *range(76, 151)]
    found = rec.read_corpora(spark, [str(tmp_path / "a.jsonl")]).orderBy("load_order").collect()
    assert [(r.doc_id, r.text) for r in found] == [(x["id"], x["texto"].strip()) for x in lines]
    (tmp_path / "q.jsonl").write_text('{"question_number": 4, "question_text": "um"}\n7\n{"question_number": 5, "question_summary": "dois"}\n', encoding="utf-8")
    asked = rec.questions_of_values(rec.read_values(spark, [str(tmp_path / "q.jsonl")])).collect()
    assert sorted((r.item_id, r.question) for r in asked) == [("q_0004", "um"), ("q_0005", "dois")]
    for bad in ("", '{"id": "a"} {"id": "b"}\n', '{"id": \n'):
        (tmp_path / "bad.jsonl").write_text(bad, encoding="utf-8")
        with pytest.raises(Exception):
            rec.read_corpora(spark, [str(tmp_path / "bad.jsonl")]).collect()


def test_layouts_give_the_same_records(spark, tmp_path):
    texts = {f"d{i}": odd_text(random.Random(i)) + "." for i in range(50)}
    (tmp_path / "list.json").write_text(json.dumps([{"id": k, "texto": v} for k, v in texts.items()]), encoding="utf-8")
    (tmp_path / "map.json").write_text(json.dumps(texts), encoding="utf-8")
    (tmp_path / "l.jsonl").write_text("\n".join(json.dumps({"id": k, "texto": v}) for k, v in texts.items()), encoding="utf-8")
    (tmp_path / "one.json").write_text(json.dumps({"filename": "f.txt", "filedata": {"content": "inner"}, "more": 1}), encoding="utf-8")
    read = lambda n: sorted(tuple(r) for r in rec.read_corpora(spark, [str(tmp_path / n)]).collect())
    assert read("list.json") == read("map.json") == read("l.jsonl") and len(read("map.json")) == 50
    assert [r[:2] for r in read("one.json")] == [("f.txt", "inner")]
    both = rec.read_corpora(spark, [str(tmp_path / n) for n in ("one.json", "map.json", "l.jsonl")]).collect()
    assert len(both) == 51 and {r.load_order // rec.FILE_POSITIONS for r in both} == {0, 1}


def test_parts_of_records_are_not_parsed_alone(spark, tmp_path, ranges):
    values = [{"id": f"d{i}", "n": [1, {"x": "}"}], "texto": "some text " * (i % 90)} for i in range(60)]
    for name, whole in (("list", values), ("object", {v["id"]: {"content": v["texto"]} for v in values})):
        (tmp_path / f"{name}.json").write_text(json.dumps(whole), encoding="utf-8")
    before = spark.conf.get("spark.sql.codegen.wholeStage")
    # The filters of a plan that is not compiled as a whole evaluate what they share before they decide.
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    try:
        found = rec.read_curated_corpus(spark, [str(tmp_path / "list.json")]).collect()
        assert {r.doc_id: r.text for r in found} == {v["id"]: v["texto"].strip() for v in values if v["texto"]}
        assert rec.read_curated_corpus(spark, [str(tmp_path / "object.json")]).count() == 60
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", before)
