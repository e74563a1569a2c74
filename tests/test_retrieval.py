"""Text and retrieval operators on small cases and against brute force."""

from __future__ import annotations

import html
import html.entities
import math
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorate.functions import text as tx
from quorate.operators import evaluation as ev
from quorate.operators import fusion as fu
from quorate.operators import retrieval as rt
from quorate.operators import versions as vs
from quorate.operators.chunking import chunk_documents
from quorate.plans import ladder
from quorate.sources import records as rec
from quorate.sources import tables as tb
from quorate.streaming import resume


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_tokens_keep_accents_and_drop_stop_words(spark):
    assert one(spark, tx.tokens(F.lit("A Dedução, é de 10% — IRPF_x!"))) == ["dedução", "10", "irpf_x"]


def test_sentences_need_an_ascii_capital(spark):
    assert one(spark, tx.sentences(F.lit("Um. Dois? três! É quatro. Fim"))) == ["Um.", "Dois? três! É quatro.", "Fim"]


def pack_brute(units, limit, overlap):
    out, cur = [], []
    size = lambda us: sum(len(u.split()) for u in us)
    for u in units:
        n = len(u.split())
        if n > limit:
            if cur:
                out.append(cur)
            out.append([u])
            cur = []
            continue
        if cur and size(cur) + n > limit:
            out.append(cur)
            keep = 0
            while keep < len(cur) and size(cur[len(cur) - keep - 1 :]) <= overlap:
                keep += 1
            cur = cur[len(cur) - keep :]
        cur = cur + [u]
    return [" ".join(c) for c in (out + [cur] if cur else out)]


def test_window_packing_against_brute_force(spark):
    rng = np.random.default_rng(0)
    for _ in range(6):
        units = [" ".join(f"w{rng.integers(99)}" for _ in range(rng.integers(1, 12))) for _ in range(40)]
        got = one(spark, tx.pack_windows(F.array(*[F.lit(u) for u in units]), tx.word_count, 10, 4))
        assert got == pack_brute(units, 10, 4)


def test_chunk_ids_and_resplit(spark):
    text = "a b c.\n\n" + " ".join(f"X{i} y z." for i in range(6)) + "\n\n   "
    docs = spark.createDataFrame([("d", text, 3), ("blank", "  \n ", 4)], "doc_id string, text string, load_order long")
    rows = chunk_documents(docs, 6, 0).orderBy("load_order").collect()
    assert [r.chunk_id for r in rows] == [f"d#{i:04d}" for i in range(4)]
    assert [r.n_tokens for r in rows] == [3, 6, 6, 6] and rows[0].load_order == 30_000_000


def test_article_labels_and_anchors(spark):
    norm = lambda s: one(spark, tx.normalise_article(F.lit(s)))
    assert [norm(s) for s in ("1º", "12-a", " 25 ", "3°.", "7o")] == ["1", "12-A", "25", "3", "7"]
    found = set(one(spark, tx.article_anchors(F.lit("Art. 250 e art.1º; ARTIGO 12-A, art 05 art. 1.829 Art. 5Art. 6"))))
    assert {"250", "1", "12-A", "12", "5", "05", "1.829", "6"} <= found and "25" not in found and "2" not in found


def test_anchor_hits_by_equality_and_by_pattern(spark):
    chunks = spark.createDataFrame(
        [("f#0000", "f", "Art. 250 nada"), ("f#0001", "f", "Art. 25, caput e art. 5, I"), ("g#0000", "g", "Art. 25")],
        "chunk_id string, source_doc string, text string",
    )
    want = spark.createDataFrame([("f", "25"), ("f", "5, I"), ("f", "2")], "source_doc string, anchor string")
    got = {(r.chunk_id, r.anchor) for r in ev.anchor_hits(chunks, want).collect()}
    assert got == {("f#0001", "25"), ("f#0001", "5, I")}


def test_shared_runs(spark):
    words = [f"p{i}" for i in range(30)]
    text = " ".join(words)
    check = lambda o, n, w=15: one(spark, tx.shared_run(F.lit(o), F.lit(n), w))
    assert check(text, "x " + " ".join(words[5:20]) + " y")
    assert not check(text, " ".join(words[5:19]))
    assert check("a b", "c a  b d") and not check("a b", "a c b") and not check("", "a")


class Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head", "title")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head", "title") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def test_elements_left_open_hide_the_rest(spark):
    pages = ["<p>a</p><script>var x = 1;", "<p>a</p><style>p{}", "<head><p>hidden", "<head><title>T</head>still hidden", "<head><title>T</title></head>seen",
             "</head>seen</title> too", "<header>seen</header>", "<head/>seen <title />too", "<HEAD a='>'>x</HEAD>y<title>t", "a<script>1</script>b<SCRIPT>2</Script >c",
             "<title><title>x</title>y</title>z", "<head></head><head>x", ""]
    got = [r.v for r in spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string").select("i", tx.html_text(F.col("p")).alias("v")).orderBy("i").collect()]
    for page, text in zip(pages, got):
        parser = Visible()
        parser.feed(page)
        parser.close()
        assert text == " ".join(" ".join(parser.parts).split()), page


def test_references_are_those_of_the_standard(spark):
    rng = np.random.default_rng(2)
    names = sorted(html.entities.html5)
    texts = ["&amp;lt; &lt &ltx &notit; &not; &nosuch; &; & &# &#; &#x; &#65; &#65 &#x41;b &#0; &#128; &#x80; &#xD800; &#1114112; &#99999999999; &#xFDD0; &#x1FFFE; &#11; &#127;", "plain", "", "&", "&&amp;&",
             "&acE;&Aacute&AacuteX &#x1F642; &#128578; x&copy2024 &hellip;", "".join(f"&{n} " for n in names[::7]), "".join(f"&{n.rstrip(';')}z;" for n in names[::11])]
    texts += ["".join(rng.choice(["&", "#", "x", ";", "amp", "lt", "6", "5", "a", " ", "not", "in"], 30)) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.unescape_entities(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.v for r in rows] == [html.unescape(t) for t in texts]


def test_packing_moves_closed_windows_on(spark, monkeypatch):
    monkeypatch.setattr(tx, "RECENT_WINDOWS", 3)
    rng = np.random.default_rng(3)
    units = [" ".join(["w"] * int(rng.integers(1, 15))) for _ in range(120)]
    got = one(spark, tx.pack_windows(F.array(*[F.lit(u) for u in units]), tx.word_count, 10, 4))
    assert got == pack_brute(units, 10, 4)


def test_html_text(spark):
    page = '<html><head><title>T</title></head><body a=">"><script>var t="</p>";</script>Olá&nbsp;<b>m&atilde;o</b>&amp;lt; 1 < 2<!-- x --></body>'
    assert one(spark, tx.html_text(F.lit(page))) == "Olá mão &lt; 1 < 2"


def test_rrf_order_and_caps(spark):
    lists = spark.createDataFrame(
        [(0, 1, "a"), (0, 2, "b"), (0, 3, "c"), (0, 1, "c"), (0, 2, "d")], "query_id int, rank int, chunk_id string"
    ).withColumn("source_doc", F.when(F.col("chunk_id").isin("a", "c"), "x").otherwise(F.col("chunk_id")))
    fused = fu.reciprocal_rank_fusion(lists)
    assert [r.chunk_id for r in fused.orderBy("fused_rank").collect()] == ["c", "a", "b", "d"]
    cut = lambda m: [r.chunk_id for r in fu.cut_fused(fused, 3, m).orderBy("combined_rank").collect()]
    assert cut(None) == ["c", "a", "b"] and cut(1) == ["c", "b", "d"] and cut(2) == ["c", "a", "b"]
    assert fu.contract_violations(fu.cut_fused(fused, 3, 1), 3).count() == 0


def bm25_brute(docs, query, k):
    toks = [d.split() for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in raw.items()}
    score = [sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.split()) for t in toks]
    return sorted(range(n), key=lambda i: (-round(score[i], 9), i))[:k]


@pytest.fixture
def corpus():
    rng = np.random.default_rng(5)
    vocab = [f"termo{i}" for i in range(12)]
    docs = [" ".join(rng.choice(vocab, rng.integers(3, 15))) for _ in range(60)]
    return docs + docs[:5] + ["outro nada"]


@pytest.mark.parametrize("bounded", [True, False])
def test_lexical_search_against_brute_force(spark, corpus, monkeypatch, bounded):
    if not bounded:
        monkeypatch.setattr(rt, "QUERY_MATRIX_BYTES", 0)
    chunks = spark.createDataFrame([(f"c{i}", f"d{i}", d, i) for i, d in enumerate(corpus)], "chunk_id string, source_doc string, text string, load_order long")
    asked = {0: "termo1 termo2 termo1", 1: "outro", 2: "de para", 3: "termo0 ausente termo5 termo7 termo11"}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    got = rt.lexical_search(queries, rt.lexical_index(chunks), 8).toPandas()
    assert set(got.query_id) == {0, 1, 3}
    for q in (0, 1, 3):
        mine = got[got.query_id == q].sort_values("rank").load_order.tolist()
        assert mine == bm25_brute(corpus, asked[q], 8)


@pytest.mark.parametrize("bounded", [True, False])
def test_dense_search_ties_and_both_paths(spark, monkeypatch, bounded):
    if not bounded:
        monkeypatch.setattr(rt, "QUERY_MATRIX_BYTES", 0)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(200, 8)).astype(np.float32)
    v[100:110] = v[0]
    q = np.r_[v[:1], rng.normal(size=(4, 8)).astype(np.float32)]
    vectors = spark.createDataFrame([(f"c{i}", i, x.tolist()) for i, x in enumerate(v)], "chunk_id string, load_order long, embedding array<float>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id int, embedding array<float>")
    got = rt.dense_search(vectors, queries, 7).toPandas()
    scores = np.round(v.astype(float) @ q.T.astype(float), 9)
    for i in range(5):
        want = sorted(range(200), key=lambda j: (-scores[j, i], j))[:7]
        assert got[got.query_id == i].sort_values("rank").load_order.tolist() == want


def test_split_of_the_budget():
    assert rt.split_top_k(7, 5, 5) == (4, 3) and rt.split_top_k(1, 5, 5) == (1, 1) and rt.split_top_k(3, 9, 1) == (3, 1)


def test_passage_recall_by_hand(spark):
    served = spark.createDataFrame([("i", 1, "f#0", "f"), ("i", 2, "g#0", "g")], "item_id string, combined_rank int, chunk_id string, source_doc string")
    want = spark.createDataFrame([("i", "f", "1"), ("i", "f", "2"), ("i", "h", "1"), ("j", "f", "1")], "item_id string, source_doc string, anchor string")
    hits = spark.createDataFrame([("f#0", "f", "1"), ("f#9", "f", "2")], "chunk_id string, source_doc string, anchor string")
    rows = {r.item_id: r for r in ev.passage_recall(served, want, hits).collect()}
    assert rows["i"].file_recall == pytest.approx(2 / 3) and rows["i"].passage_recall == pytest.approx(1 / 3)
    assert rows["j"].file_recall == 0 and rows["j"].n_expected == 1
    assert ev.oracle_ceiling(want, hits).first().n_reachable == 3


def test_unequal_expected_counts_stop_the_pairing(spark):
    a = spark.createDataFrame([("i", 1, 0.5, 0.5)], "item_id string, n_expected long, file_recall double, passage_recall double")
    assert ev.paired_recall(a, a).count() == 1
    with pytest.raises(Exception):
        ev.paired_recall(a, a.withColumn("n_expected", F.lit(2).cast("long"))).collect()


def test_json_files_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "x", "text": " um "}, {"id": "y", "text": "dois"}]', encoding="utf-8")
    (tmp_path / "b.json").write_text('{"y": {"titulo": "novo"}, "disp_1": "z"}', encoding="utf-8")
    read = lambda n: rec.corpus_of_values(rec.read_json_values(spark, [str(tmp_path / n)]))
    merged = {r.doc_id: r for r in rec.merge_corpora([read("a.json"), read("b.json")]).collect()}
    assert merged["x"].text == "um" and merged["y"].text == "novo" and merged["y"].load_order == 1
    assert rec.read_curated_corpus(spark, [str(tmp_path / "a.json")]).count() == 2
    with pytest.raises(ValueError):
        rec.read_curated_corpus(spark, [str(tmp_path / "b.json")])


def test_bad_and_missing_files_do_not_pass_silently(spark, tmp_path):
    (tmp_path / "good.json").write_text('\n {"questions": [{"question_number": 3, "question_text": "q"}, 7]}', encoding="utf-8")
    (tmp_path / "cut.json").write_text('[{"id": "x", "text": "um"}, {"id": ', encoding="utf-8")
    (tmp_path / "word.json").write_text('"just text"', encoding="utf-8")
    at = lambda n: str(tmp_path / n)
    assert [r.item_id for r in rec.questions_of_values(rec.read_json_values(spark, [at("good.json")])).collect()] == ["q_0003"]
    for name in ("cut.json", "word.json"):
        for load in (rec.corpus_of_values, rec.questions_of_values):
            with pytest.raises(Exception):
                load(rec.read_json_values(spark, [at(name)])).collect()
    (tmp_path / "a.json").write_text('{"a": "1"}', encoding="utf-8")
    assert rec.read_corpora(spark, [at("none.json"), at("a.json")]).count() == 1
    assert rec.read_corpora(spark, [at("none.json")]).count() == 0
    with pytest.raises(FileNotFoundError):
        rec.read_curated_corpus(spark, [at("a.json"), at("none.json")])


def test_agent_folders_partitions_and_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0.5, 0, 1), (2, "b", 0.7, 1, 0)], "item_id int, agent_id string, c_min double, fold_k int, z int")
    base = str(tmp_path / "resp")
    rows.write.partitionBy("agent_id").parquet(base)
    assert {r.agent_id for r in tb.read_agent_responses(spark, base).collect()} == {"a", "b"}
    path = str(tmp_path / "dec")
    tb.write_decisions(rows.withColumns({"run": F.lit("r"), "baseline": F.lit("full")}), path)
    assert {r.c_min for r in tb.available_constraints(spark.read.parquet(path)).collect()} == {0.5, 0.7}
    tb.export_items_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    out = tb.write_version(rows, str(tmp_path / "v"), "1")
    with pytest.raises(Exception):
        tb.write_version(rows, str(tmp_path / "v"), "1")
    assert tb.read_table(spark, out, ["z"]).columns == ["z"]


def test_resume_adds_each_key_once(spark, tmp_path):
    path, seen = str(tmp_path / "out"), []
    wanted = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "k int, t string")

    def work(todo):
        seen.append(todo.count())
        return todo

    resume.append_pending(wanted.where("k < 3"), path, ["k"], work)
    resume.append_pending(wanted, path, ["k"], work)
    resume.append_pending(wanted, path, ["k"], work)
    assert seen == [3, 2, 0] and spark.read.parquet(path).count() == 5


def test_output_parsing(spark):
    rows = [
        '{"resposta": "x", "confianca": 0.5}', '```json\n{"RESPOSTA": "x", "Confiança": "0.25"}\n```', 'diz {"resposta": "x", "confianca": 1} fim',
        '{"resposta": "x", "confianca": 1.2}', "nada", None,
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    got = [r.a for r in df.select("i", tx.answer_fields(F.col("raw")).alias("a")).orderBy("i").collect()]
    assert [g.valid_json for g in got] == [True, True, True, False, False, False]
    assert [g.confidence_raw for g in got][:3] == [0.5, 0.25, 1.0]


def _lexical(spark, chunks, queries, k):
    table = spark.createDataFrame([(f"c{i}", "d", i, t) for i, t in chunks], "chunk_id string, source_doc string, load_order bigint, text string")
    asked = spark.createDataFrame(queries, "query_id bigint, text string")
    return [
        (r.query_id, r.load_order, r.score)
        for r in rt.lexical_search(asked, rt.lexical_index(table), k).orderBy("query_id", "rank").collect()
    ]


def test_both_plans_give_one_answer_on_close_scores(spark, monkeypatch):
    import random

    rng = random.Random(3)
    vocabulary = [f"termo{i}" for i in range(30)]
    chunks = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([8, 9, 200, 201])))) for i in range(150)]
    # The same terms in other orders: sums whose parts come in another sequence must tie.
    chunks += [(1000 + i, " ".join(rng.sample(chunks[i][1].split(), len(chunks[i][1].split())))) for i in range(40)]
    queries = [(q, " ".join(rng.choice(vocabulary) for _ in range(12))) for q in range(10)]
    small = _lexical(spark, chunks, queries, 25)
    monkeypatch.setattr(rt, "QUERY_MATRIX_BYTES", 0)
    assert _lexical(spark, chunks, queries, 25) == small


def test_chunks_without_a_score_rank_above_negative_ones(spark):
    chunks = [(i, "alfa") for i in range(6)] + [(6, ""), (7, ""), (8, "")]
    got = _lexical(spark, chunks, [(1, "alfa")], 3)
    assert [(q, o) for q, o, _ in got] == [(1, 6), (1, 7), (1, 8)] and all(s == 0 for *_, s in got)
    got = _lexical(spark, chunks, [(1, "alfa"), (2, "beta")], 5)
    assert [o for q, o, _ in got if q == 1] == [6, 7, 8, 0, 1] and [o for q, o, _ in got if q == 2] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("k", [1, 3, 8])
def test_free_places_are_the_first_chunks_without_a_score(spark, k):
    rng = np.random.default_rng(k)
    orders = sorted(rng.choice(10_000, 60, replace=False).tolist())
    index = spark.createDataFrame([(g, o) for g in ("a", "b") for o in orders[: 60 if g == "a" else 5]], "g string, load_order long")
    # One query scores nearly all chunks, one none, one every other.
    rows = [(g, q, o) for g in ("a", "b") for q, keep in ((1, lambda i: i not in (7, 30, 31, 59)), (3, lambda i: i % 2)) for i, o in enumerate(orders[: 60 if g == "a" else 5]) if keep(i)]
    scored = spark.createDataFrame([(*r, -1.0) for r in rows], "g string, query_id int, load_order long, score double")
    asked = spark.createDataFrame([(g, q) for g in ("a", "b") for q in (1, 2, 3)], "g string, query_id int")
    got = {}
    for r in rt._free_places(scored, rt._positions(index, ["g"]), asked, k, ["g"]).collect():
        got.setdefault((r.g, r.query_id), []).append(r.load_order)
    taken = set(rows)
    for g in ("a", "b"):
        for q in (1, 2, 3):
            want = [o for o in orders[: 60 if g == "a" else 5] if (g, q, o) not in taken][:k]
            assert sorted(got.get((g, q), [])) == want, (g, q)


def test_versions_share_the_base_and_mend_its_counts(spark):
    rows = [("d1#0", "d1", 1, "casa rio monte"), ("d1#1", "d1", 2, "rio"), ("d2#0", "d2", 3, "casa casa verde"), ("d3#0", "d3", 4, "")]
    schema = "chunk_id string, source_doc string, load_order long, text string"
    base = vs.first_version(spark.createDataFrame(rows, schema))
    new = [("d1#0", "d1", 1, "monte azul"), ("d4#0", "d4", 5, "rio azul azul")]
    gone = spark.createDataFrame([("d1",), ("d4",), ("d3",)], "source_doc string")
    second = vs.revised(base, spark.createDataFrame(new, schema), gone)
    third = vs.revised(second, spark.createDataFrame([], schema), spark.createDataFrame([("d2",)], "source_doc string"))
    for version, texts in ((base, rows), (second, [*new, rows[2]]), (third, new)):
        index = rt.lexical_index(spark.createDataFrame(texts, schema))
        want = {(r.term, round(r.idf, 12), round(r.avgdl, 12)) for r in rt.term_idf(index).collect()}
        assert {(r.term, round(r.idf, 12), round(r.avgdl, 12)) for r in vs.idf_of(version).collect()} == want
        assert sorted(r.chunk_id for r in version.rows.collect()) == sorted(t[0] for t in texts)
    with pytest.raises(ValueError):
        vs.revised(base, spark.createDataFrame(new, schema), gone.where("source_doc <> 'd4'"))


def test_ladder_gains(spark):
    served = spark.createDataFrame([(1, "R0", "c", "a", 1), (1, "R0'", "c", "a", 1), (1, "R0'", "e", "b", 2), (2, "R0'", "x", "z", 1)], "query_id int, rung string, chunk_id string, source_doc string, combined_rank int")
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "q")], "query_id int, source_doc string")
    got = {r.rung: r for r in ladder.gains(served, expected).collect()}
    assert got["R0"].doc_recall == 0.25 and got["R0"].gain is None and got["R0'"].doc_recall == 0.5 and got["R0'"].gain == 0.25
    assert got["R0"].n_items == 2 and got["R0'"].n_chunks == 1.5


def test_chunks_by_words_are_those_of_the_expressions(spark):
    from quorate.operators import chunking as ck

    rng = np.random.default_rng(8)
    parts = ["um", "Dois.", "três!", "\n", "\n", " ", " ", " ", "\x1c", "Quatro", "x" * 9, "　Cinco?", "seis", ""]
    texts = [" ".join(rng.choice(parts, rng.integers(0, 160))) for _ in range(80)] + ["", " \n ", None, "a " * 70 + ". B" * 90]
    rows = spark.createDataFrame([(i, t, i, "k") for i, t in enumerate(texts)], "doc_id long, text string, load_order long, source_type string")
    for most, overlap in ((64, 8), (10, 4), (5, 5), (3, 0)):
        ours = ck.chunk_documents(rows, most, overlap, "\n")
        plain = ck.chunk_documents(rows, most, overlap, "\n", lambda c: tx.word_count(c))
        assert "mapInArrow" in ours._jdf.queryExecution().toString().replace("MapInArrow", "mapInArrow")
        assert ours.dtypes == plain.dtypes
        assert sorted(map(tuple, ours.drop("section_path").collect())) == sorted(map(tuple, plain.drop("section_path").collect()))


def test_dense_search_in_blocks_of_both_sides(spark, monkeypatch):
    for name, value in (("SHIPPED_QUERIES", 10), ("VECTOR_BLOCK", 150), ("QUERY_BLOCK", 60), ("LEAST_BLOCK", 20), ("PRODUCT_QUERIES", 16), ("MATRIX_CELLS", 700)):
        monkeypatch.setattr(rt, name, value)
    rng = np.random.default_rng(7)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    v[::4] = v[3]
    v[5] *= 1e-3
    # A vector of each kind of query; some components are never asked for.
    q = np.r_[v[:90], np.zeros((1, 8), np.float32)] * np.array([1, 1, 0, 1, 1, 0, 1, 1], np.float32)
    listed = lambda rows, n: spark.createDataFrame([(f"c{i}" if n == "chunk_id" else i, i, x.tolist()) for i, x in enumerate(rows)], f"{n} {'string' if n == 'chunk_id' else 'int'}, load_order long, embedding array<float>")
    got = rt.dense_search(listed(v, "chunk_id"), listed(q, "query_id").drop("load_order"), 7).toPandas()
    scores = np.round(v.astype(float) @ q.T.astype(float), 9)
    for i in range(len(q)):
        want = sorted(range(400), key=lambda j: (-scores[j, i], j))[:7]
        assert got[got.query_id == i].sort_values("rank").load_order.tolist() == want


def test_vectors_stream_past_blocks_of_queries(spark, monkeypatch):
    """A task ends with whole lists over any number of vectors: before, each block of these sent k rows a query to be ranked again."""
    for name, value in (("SHIPPED_QUERIES", 10), ("VECTOR_BLOCK", 100), ("QUERY_BLOCK", 60), ("LEAST_BLOCK", 20), ("PRODUCT_QUERIES", 16), ("PRODUCT_ROWS", 24), ("HELD_VECTORS", 90), ("HELD_PAIRS", 30), ("HELD_ROWS", 50)):
        monkeypatch.setattr(rt, name, value)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(500, 9)).astype(np.float32)
    v[::5] = v[4]
    # Rows that enter again and again, and queries with the same components in no order.
    v = v[np.argsort(v @ v[4])]
    masks = np.array([[1] * 9, [1, 0, 1] * 3, [0] * 9, [0, 1, 0] * 3], np.float32)
    q = v[:130] * masks[rng.integers(0, 4, 130)]
    vectors = spark.createDataFrame([(f"c{i}", i, f"d{i % 7}", x.tolist()) for i, x in enumerate(v)], "chunk_id string, load_order long, source_doc string, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id int, embedding array<float>")
    scores = np.round(v.astype(float) @ q.T.astype(float), 9)
    for parts in (1, 3):
        monkeypatch.setattr(rt, "_blocks", lambda *_, parts=parts: (parts, 4))
        found = rt.dense_search(vectors, queries, 7, ["source_doc"])
        assert ("Window" in found._jdf.queryExecution().toString()) == (parts > 1)
        got = found.toPandas()
        assert (got.source_doc == "d" + (got.load_order % 7).astype(str)).all() and (got.chunk_id == "c" + got.load_order.astype(str)).all()
        for i in range(len(q)):
            want = sorted(range(500), key=lambda j: (-scores[j, i], j))[:7]
            mine = got[got.query_id == i].sort_values("rank")
            assert mine.load_order.tolist() == want and mine["rank"].tolist() == list(range(1, 8))
    monkeypatch.undo()
    # All neighbours of 615 000 vectors in four wordings: one part. A few questions to many vectors: these are sent once.
    assert rt._blocks(615_000, 4 * 615_000, 64, 50, 12) == (1, 48)
    assert rt._blocks(100_000_000, 5000, 64, 50, 12) == (24, 1)


def test_ladder_asks_for_scores_of_reranked_heads_only(spark, monkeypatch):
    """Before, every pair of every list was scored, reranked or not."""
    monkeypatch.setattr(ladder.C, "RERANK_POOL", 3)
    lists = [(q, r, f"c{(q * 3 + r) % 9}", b) for q in range(4) for b in ("dense", "lexical") for r in range(1, 8)]
    pools = spark.createDataFrame(lists, "query_id int, rank int, chunk_id string, branch string").withColumn("source_doc", F.col("chunk_id"))
    pools = pools.withColumn("source_type", F.when(F.col("chunk_id") < "c4", "norm").otherwise("ruling"))
    asked = []

    def given(pairs):
        asked.append({(r.query_id, r.chunk_id) for r in pairs.collect()})
        return pairs.withColumn("rerank_score", F.crc32("chunk_id").cast("double"))

    every = pools.select("query_id", "chunk_id").distinct().withColumn("rerank_score", F.crc32("chunk_id").cast("double"))
    for name, most in (("R2", 3), ("R3", 6)):
        served = sorted(ladder.serve(ladder.RUNGS[name], pools, given).collect())
        assert served == sorted(ladder.serve(ladder.RUNGS[name], pools, every).collect()) != []
        assert len(asked[-1]) <= 4 * most < every.count()
