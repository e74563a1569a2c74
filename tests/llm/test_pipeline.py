"""Every stage against a plain version of its decision, each on its own input."""

from __future__ import annotations

import public_tokenizers
from test_shingle_join import plain_keepers
from test_template_tree import plain as plain_lines
from test_winnowing import plain as plain_overlap
from tokenizers import Tokenizer

import corpus_pipeline
from quorate.llm import byte_convnet
from quorate.llm.common import materialise

SF_DIR = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF_DIR))
        outs.append(docs)
        if name != "encoded":
            assert docs.columns == columns, name
    first = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [{r.doc_id: r.text for r in d.collect()} for d in (first, *outs[:-1])]
    net = byte_convnet.train(first, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    scores = {r.doc_id: r.score for r in byte_convnet.with_scores(first, net).collect()}
    assert rows[1] == {d: t for d, t in rows[0].items() if scores[d] >= 0.5}
    lines = {d: t for d, t in plain_lines(list(rows[1].items())) if t.strip() or t == rows[1][d]}
    assert rows[2] == lines
    assert sorted(rows[3]) == plain_keepers(list(rows[2].items())) and all(rows[3][d] == rows[2][d] for d in rows[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    dirty = {d for d, *_, bad in plain_overlap(list(rows[3].items()), items) if bad}
    assert rows[4] == {d: t for d, t in rows[3].items() if d not in dirty}
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in outs[-1].collect()}
    assert got.keys() == rows[4].keys()
    assert all(list(got[d].ids) == theirs.encode(t, add_special_tokens=False).ids and got[d].decoded == t for d, t in rows[4].items())


def test_extra_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr("*", "'a' as score", "'b' as fp", "'c' as text_key", "array(1) as ids", "'d' as shard").limit(60)
    nothing = docs.limit(1).selectExpr(*[f"nullif({c}, {c}) as {c}" for c in docs.columns])
    docs = materialise(docs.unionByName(docs.limit(3)).unionByName(nothing))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, SF_DIR))
        assert out.columns == docs.columns
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == docs.count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF_DIR))
        assert docs.count() == 0
