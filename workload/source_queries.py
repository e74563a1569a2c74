"""Queries for JSON sources, references, prompts, digests, resumable work and the ladder."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quorate.functions import text as tx
from quorate.operators import evaluation as ev
from quorate.operators import folds as fd
from quorate.operators import fusion as fu
from quorate.operators import panel as pn
from quorate.operators import prompts as pr
from quorate.operators import retrieval as rt
from quorate.operators import selective as sel
from quorate.plans import ladder
from quorate.session import materialise, shared_folder
from quorate.sources import records as rec
from quorate.sources import tables as tb
from quorate.streaming import resume
from workload import fixtures as fx
from workload.ctes import cte, r6, with_ctes
from workload.decision_queries import _strata
from workload.registry import query
from workload.retrieval_queries import WORDINGS, by_question, pools_of, repaired_vectors, served_lexical, typed_pools, vector_pools, wordings


def corpus_files(spark, sf_dir):
    """One JSON text per document, in four layouts."""
    d, k = fx.table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    enc = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    body = enc(F.col("text"))
    raw = (
        F.when(k == 0, F.concat(F.lit('[{"id": '), "doc_id", F.lit(', "text": '), body, F.lit("}]")))
        .when(k == 1, F.concat(F.lit('[{"filename": "f'), "doc_id", F.lit('.txt", "filedata": {"n": 1, "content": '), body, F.lit("}}]")))
        .when(k == 2, F.concat(F.lit('["skip", {"ementa": ["a", '), body, F.lit(']}, {"number": "n'), "doc_id", F.lit('", "text": "  "}]')))
        .otherwise(F.concat(F.lit('{"k'), "doc_id", F.lit('": '), body, F.lit("}")))
    )
    return d.select(F.concat(F.lit("s"), "doc_id", F.lit(".json")).alias("file"), F.concat(F.lit("s"), "doc_id").alias("stem"), raw.alias("raw"))


cte("fx_corpus", """
SELECT 's' || doc_id || '.json' AS file, CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN 'f' || doc_id || '.txt'
       WHEN 2 THEN 's' || doc_id || '_00001' ELSE 'k' || doc_id END AS doc_id,
  CASE doc_id % 4 WHEN 2 THEN 'a' || chr(10) || trim(text, ' ' || chr(10)) ELSE trim(text, ' ' || chr(10)) END AS text,
  CAST(CASE doc_id % 4 WHEN 2 THEN 1 ELSE 0 END AS INTEGER) AS pos
FROM documents
""")


@query("corpus_records", with_ctes("SELECT file, doc_id, text, pos FROM fx_corpus"))
def corpus_records(spark, sf_dir):
    return rec.corpus_records(corpus_files(spark, sf_dir))


LAYOUTS = ("list", "object", "lines")
FILE_ROWS = 50_000


def stored_corpus(spark, sf_dir):
    """The documents as real JSON files of three layouts, in order: paths of lists, objects and JSON lines."""
    d = fx.table(spark, sf_dir, "documents")
    files = 2 + d.count() // FILE_ROWS
    layout = F.element_at(F.array(*[F.lit(x) for x in LAYOUTS]), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = d.select("doc_id", "text", layout.alias("layout"), F.floor(F.col("doc_id") / 3).cast("bigint").alias("k"))
    rows = rows.withColumn("part", (F.col("k") % files).cast("int"))
    # At most FILE_ROWS rows a file, so neither window nor file grows with the table.
    here = Window.partitionBy("layout", "part")
    first = F.row_number().over(here.orderBy("doc_id")) == 1
    last = F.row_number().over(here.orderBy(F.desc("doc_id"))) == 1
    text = F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", "")
    record = F.concat(F.lit('{"id": "d'), "doc_id", F.lit('", "n": [1, {"x": "}"}], "texto": '), text, F.lit("}"))
    member = F.concat(F.lit('"d'), "doc_id", F.lit('": {"content": '), text, F.lit("}"))
    line = (
        F.when(F.col("layout") == "list", F.concat(F.when(first, "[").otherwise(","), record, F.when(last, "]").otherwise("")))
        .when(F.col("layout") == "object", F.concat(F.when(first, "{").otherwise(","), member, F.when(last, "}").otherwise("")))
        .otherwise(record)
    )
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    lined = rows.select("layout", "part", "doc_id", line.alias("value")).repartition("layout", "part").sortWithinPartitions("layout", "part", "doc_id")
    lined.drop("doc_id").write.partitionBy("layout", "part").text(folder)
    stored = [f"{folder}/layout={x}/part={i}" for x in LAYOUTS[:2] for i in range(files)]
    spark.read.text(f"{folder}/layout=lines").drop("part").write.text(f"{folder}/lines.jsonl")
    return [p for p in rec.existing(spark, stored)], f"{folder}/lines.jsonl"


@query("curated_corpus", with_ctes("""
SELECT 'd' || doc_id AS doc_id, trim(text, ' ' || chr(10)) AS text, CASE WHEN doc_id % 3 = 2 THEN 'lines' ELSE 'whole' END AS layout,
  CASE WHEN doc_id % 3 = 2 THEN NULL ELSE
    (dense_rank() OVER (ORDER BY doc_id % 3 = 2, doc_id % 3, (doc_id // 3) % files) - 1) * 1000000000000
    + row_number() OVER (PARTITION BY doc_id % 3, (doc_id // 3) % files ORDER BY doc_id) - 1 END AS load_order
FROM documents, (SELECT 2 + count(*) // 50000 AS files FROM documents) WHERE doc_id % 3 = 1 OR trim(text, ' ' || chr(10)) <> ''"""))
def curated_corpus(spark, sf_dir):
    """All documents written as JSON files in three layouts and read by the curated reader, in file order.

    Lines have no order across the files that Spark writes, so theirs is checked to be behind the others only.
    """
    whole, lines = stored_corpus(spark, sf_dir)
    found = rec.read_curated_corpus(spark, [*whole, lines])
    is_line = F.substring("doc_id", 2, 20).cast("bigint") % 3 == 2
    behind = F.col("load_order") >= len(whole) * rec.FILE_POSITIONS
    layout = F.when(is_line & behind, "lines").when(~is_line & ~behind, "whole")
    return found.select("doc_id", "text", layout.alias("layout"), F.when(~is_line, F.col("load_order")).alias("load_order"))


@query("question_files", with_ctes("""
SELECT printf('q_%04d', item_id) AS item_id, trim(text, ' ' || chr(10)) AS question FROM benchmark"""))
def question_file_records(spark, sf_dir):
    """All benchmark items written as JSON files, as records of lines and as lists under "questions", and read by the splitting readers."""
    b = fx.table(spark, sf_dir, "benchmark")
    text = F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", "")
    record = F.concat(F.lit('{"question_number": '), "item_id", F.lit(', "question_text": '), text, F.lit("}"))
    folder = f"{shared_folder(spark)}/questions-{uuid.uuid4().hex}"
    b.where("item_id % 2 = 0").select(record.alias("value")).write.text(f"{folder}/lines.jsonl")
    bucket = (F.col("item_id") % (2 + b.count() // FILE_ROWS)).alias("part")
    lists = b.where("item_id % 2 = 1").groupBy(bucket).agg(F.array_join(F.collect_list(record), ", ").alias("r"))
    lists.select(F.concat(F.lit('{"n": 1, "questions": ['), "r", F.lit("]}")).alias("value"), "part").repartition("part").write.partitionBy("part").text(f"{folder}/lists")
    parts = [f"{folder}/lists/part={r['part']}" for r in spark.read.text(f"{folder}/lists").select("part").distinct().collect()]
    found = rec.questions_of_values(rec.read_values(spark, [f"{folder}/lines.jsonl", *parts]))
    return found.select("item_id", "question")


@query("corpus_merge", with_ctes("""
SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, coalesce(b.text, a.text) AS text,
       CASE WHEN a.doc_id IS NOT NULL THEN a.pos ELSE 1000000000000 + b.pos END AS load_order
FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, doc_id AS pos FROM documents WHERE doc_id % 3 <> 0) a
FULL JOIN (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text || ' v2' AS text, doc_id * 2 AS pos FROM documents WHERE doc_id % 2 = 0) b ON a.doc_id = b.doc_id"""))
def corpus_merge(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    name = F.col("doc_id").cast("string").alias("doc_id")
    a = d.where("doc_id % 3 <> 0").select(name, "text", F.col("doc_id").alias("pos"))
    b = d.where("doc_id % 2 = 0").select(name, F.concat("text", F.lit(" v2")).alias("text"), (F.col("doc_id") * 2).alias("pos"))
    return rec.merge_corpora([a, b])


@query("synthetic_id_gate", with_ctes("SELECT 'disp_' || doc_id AS doc_id FROM documents WHERE doc_id % 5 = 0"))
def synthetic_id_gate(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("disp_"), "doc_id")).otherwise(F.col("source"))
    return rec.synthetic_ids(d.select(name.alias("doc_id")))


def question_files(spark, sf_dir):
    b = fx.table(spark, sf_dir, "benchmark")
    enc = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    k, text = F.col("item_id") % 3, enc(F.col("text"))
    record = F.concat(
        F.lit('{"question_number": '), "item_id",
        F.when(k == 0, F.concat(F.lit(', "question_text": '), text)).otherwise(F.concat(F.lit(', "question_text": "", "question_summary": '), text)),
        F.lit(', "answer_cleaned": "", "answer": "resposta '), "item_id", F.lit('"'),
        F.when(k == 1, F.lit(', "formatted_references": [], "references": ["Lei 1", "Acórdão 9 do CARF", {"text": "Decreto 2"}]'))
        .when(k == 2, F.lit(', "references": " "')).otherwise(F.lit("")),
        F.lit("}"),
    )
    raw = F.when(k == 0, F.concat(F.lit("["), record, F.lit(', "x"]'))).when(k == 1, F.concat(F.lit('{"questions": ['), record, F.lit("]}"))).otherwise(
        F.concat(F.lit('{"a": '), record, F.lit("}"))
    )
    return b.select(raw.alias("raw"))


@query("question_items", with_ctes("""
SELECT printf('q_%04d', item_id) AS item_id, trim(text) AS question, 'resposta ' || item_id AS ground_truth,
       CASE WHEN item_id % 3 = 1 THEN 'Lei 1|Decreto 2' ELSE '' END AS provisions,
       CASE WHEN item_id % 3 = 1 THEN 'Acórdão 9 do CARF' ELSE '' END AS rulings, item_id % 3 = 1 AS has_doc_ref FROM benchmark"""))
def question_items(spark, sf_dir):
    items = rec.question_items(question_files(spark, sf_dir))
    return items.withColumn("provisions", F.array_join("provisions", "|")).withColumn("rulings", F.array_join("rulings", "|"))


@query("corpus_of_items", with_ctes("""
SELECT CASE kind WHEN 0 THEN 'disp_' ELSE 'carf_' END || doc_id || '_' || lpad(CAST(p AS VARCHAR), 2, '0') AS doc_id, text,
       (doc_id * 2 + kind) * 100000 + p AS load_order
FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, kind, p) AS rn FROM (
  SELECT doc_id, 0 AS kind, 0 AS p, lang || ' ' || (doc_id % 97) AS text FROM documents
  UNION ALL SELECT doc_id, 0, 1, 'lei ' || source FROM documents
  UNION ALL SELECT doc_id, 1, 0, 'acordao ' || (n_chars % 50) FROM documents)) WHERE rn = 1"""))
def corpus_of_items(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    items = d.select(
        F.col("doc_id").alias("item_id"),
        F.array(F.concat("lang", F.lit(" "), F.col("doc_id") % 97), F.concat(F.lit("lei "), "source")).alias("provisions"),
        F.array(F.concat(F.lit("acordao "), F.col("n_chars") % 50)).alias("rulings"),
    )
    return rec.corpus_of_items(items.withColumn("o", F.col("item_id")), "o")


def annotated(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    note = F.concat(
        F.lit('{"Lei '), "source", F.lit('": [{"file": " f'), F.col("doc_id") % 10, F.lit('.txt ", "artigos": [{"artigo": "'),
        F.col("doc_id") % 7 + 1, F.lit('º"}, {"artigo": "12-a"}]}], "Outro": [{"file": "", "artigos": [{"artigo": "3"}]}, {"file": "g.txt"}]}'),
    )
    return d.select(F.col("doc_id").alias("item_id"), F.array(note, F.concat(F.lit("texto livre "), "lang"), note).alias("references"), note.alias("raw"))


@query("annotation_pairs", with_ctes("""
SELECT doc_id AS item_id, 'f' || (doc_id % 10) || '.txt' AS source_doc, v.a AS anchor FROM documents
CROSS JOIN LATERAL (VALUES (CAST(doc_id % 7 + 1 AS VARCHAR)), ('12-A')) v(a)"""))
def annotation_pairs(spark, sf_dir):
    return rec.expected_pairs(annotated(spark, sf_dir))


@query("annotation_documents", with_ctes("""
SELECT doc_id AS item_id, v.f AS source_doc FROM documents CROSS JOIN LATERAL (VALUES ('f' || (doc_id % 10) || '.txt'), ('g.txt')) v(f)"""))
def annotation_documents(spark, sf_dir):
    return rec.expected_documents(annotated(spark, sf_dir))


@query("citation_lines", with_ctes("""
SELECT doc_id AS item_id, CAST(p AS INTEGER) AS pos, CAST(l AS INTEGER) AS line,
  CASE WHEN p = 1 THEN 'texto livre ' || lang WHEN l = 0 THEN 'Lei ' || source || ' — art. ' || (doc_id % 7 + 1) || 'º, art. 12-a'
       WHEN l = 1 THEN 'Outro — art. 3' ELSE 'Outro' END AS citation
FROM documents CROSS JOIN (VALUES (0, 0), (0, 1), (0, 2), (1, 0), (2, 0), (2, 1), (2, 2)) v(p, l)"""))
def citation_lines(spark, sf_dir):
    return rec.citation_lines(annotated(spark, sf_dir))


@query("expected_from_ids", with_ctes("""
SELECT doc_id AS item_id, v.s AS source_doc FROM documents CROSS JOIN LATERAL (VALUES ('disp_' || doc_id || '_00', true), ('disp_' || doc_id || '_01', doc_id % 2 = 0),
  ('carf_' || doc_id || '_00', doc_id % 3 = 0)) v(s, keep) WHERE v.keep"""))
def expected_from_ids(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    two, none = F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>")
    return ev.expected_from_ids(
        d.select(
            F.col("doc_id").alias("item_id"),
            F.when(F.col("doc_id") % 2 == 0, two).otherwise(F.array(F.lit("a"))).alias("provisions"),
            F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("c"))).otherwise(none).alias("rulings"),
        )
    )


@query("synthetic_id_mode", r6("""
SELECT avg(CASE WHEN doc_id % 12 = 0 THEN 0 ELSE 1 END) AS share, avg(CASE WHEN doc_id % 12 = 0 THEN 0 ELSE 1 END) >= 0.9 AS synthetic FROM documents""", "share"))
def synthetic_id_mode(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 12 == 0, F.col("source")).otherwise(F.concat(F.lit("disp_"), "doc_id"))
    return ev.uses_synthetic_ids(d.select(name.alias("source_doc")))


cte("fx_context", """
SELECT doc_id // 10 AS item_id, string_agg('[DOCUMENTO ' || (doc_id % 10 + 1) || ' — ' || CASE WHEN doc_id % 7 = 0 THEN 'c' || doc_id || ']' || chr(10) || '(chunk não encontrado no índice)'
     ELSE source || ']' || chr(10) || trim(text, ' ' || chr(10)) END, chr(10) || chr(10) ORDER BY doc_id) AS context
FROM documents WHERE doc_id % 10 < 4 AND doc_id // 10 % 5 <> 0 GROUP BY 1
""")


def served_documents(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    chunk = F.concat(F.lit("c"), "doc_id").alias("chunk_id")
    item = F.floor(F.col("doc_id") / 10).cast("bigint").alias("item_id")
    served = d.where("doc_id % 10 < 4 and floor(doc_id / 10) % 5 <> 0").select(item, (F.col("doc_id") % 10 + 1).alias("combined_rank"), chunk)
    chunks = d.where("doc_id % 7 <> 0").select(chunk, F.col("source").alias("source_doc"), "text")
    return served, chunks, d.select(item).distinct()


@query("context_rendering", with_ctes("""
SELECT i.item_id, coalesce(c.context, '(Nenhum documento recuperado para esta pergunta.)') AS context
FROM (SELECT DISTINCT doc_id // 10 AS item_id FROM documents) i LEFT JOIN fx_context c USING (item_id)"""))
def context_rendering(spark, sf_dir):
    return pr.render_context(*served_documents(spark, sf_dir))


@query("request_table", with_ctes("""
SELECT item_id, prompt, sha256('{"max_tokens": 1024, "model": "m", "reasoning_effort": null, "system": "Responda.", "temperature": 0.0, "user": ' || CAST(to_json(prompt) AS VARCHAR) || '}') AS prompt_hash
FROM (SELECT item_id, 'CONTEXTO:' || chr(10) || context || chr(10) || chr(10) || 'PERGUNTA: item ' || item_id AS prompt FROM fx_context)"""))
def request_table(spark, sf_dir):
    served, chunks, items = served_documents(spark, sf_dir)
    asked = pr.render_context(served, chunks, served.select("item_id").distinct())
    fields = {"context": F.col("context"), "question": F.concat(F.lit("item "), "item_id")}
    return pr.request_table(asked, "CONTEXTO:\n{context}\n\nPERGUNTA: {question}", fields, "Responda.", "m")


@query("stored_context_gate", with_ctes("SELECT doc_id // 10 AS item_id, 'c' || doc_id AS chunk_id FROM documents WHERE doc_id % 10 < 4 AND doc_id // 10 % 5 <> 0 AND doc_id % 7 = 0"))
def stored_context_gate(spark, sf_dir):
    served, chunks, _ = served_documents(spark, sf_dir)
    stored = served.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("combined_rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved_chunk_ids"))
    return ev.unknown_chunks(ev.served_from_responses(stored), chunks)


@query("content_digest", with_ctes("""
SELECT bucket, count(*) AS n, sha256(concat_ws(',', CAST(sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT)) AS VARCHAR),
  CAST(sum(CAST('0x' || substr(h, 31, 15) AS HUGEINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 46, 15) AS HUGEINT)) AS VARCHAR))) AS digest FROM (
  SELECT CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 64 AS bucket, sha256(doc_id || chr(10) || text) AS h FROM documents) GROUP BY 1"""))
def content_digest(spark, sf_dir):
    return tb.content_digest(fx.table(spark, sf_dir, "documents"), "doc_id", "text", 64)


@query("pending_queries", with_ctes("""
SELECT sha256(text) AS query_hash, text FROM conversations GROUP BY text HAVING NOT bool_or(turn % 2 = 0)"""))
def pending_queries(spark, sf_dir):
    turns = fx.table(spark, sf_dir, "conversations")
    stored = turns.where("turn % 2 = 0").select(rt.query_hash(F.col("text")).alias("query_hash"))
    return resume.pending_queries(turns.select("text"), stored).select("query_hash", "text")


@query("labels_with_fallback", with_ctes("SELECT item_id, CAST(agent_id AS VARCHAR) AS agent_id, CASE WHEN agent_id < 3 THEN z ELSE 0 END AS z FROM fx_panel"))
def labels_with_fallback(spark, sf_dir):
    grid = fx.panel(spark, sf_dir).select("item_id", F.col("agent_id").cast("string").alias("agent_id"))
    wide = pn.item_rollup(fx.panel(spark, sf_dir), [1, 2], ["z"]).select("item_id", F.col("z_1").alias("z_agent_1"), F.col("z_2").alias("z_agent_2"))
    return pn.labels_with_fallback(grid, None, wide, "z_agent_")


_SEQ = """
SELECT stratum, draw_order, item_id, agent_id FROM (
  SELECT stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('5:' || item_id || ':' || agent_id), item_id, agent_id) AS draw_order, item_id, agent_id
  FROM (SELECT p.item_id, p.agent_id, CASE WHEN a.refusal_verdict IS NOT NULL THEN 'recusa' WHEN p.z = 1 THEN 'adequada' ELSE 'inadequada' END AS stratum
        FROM fx_panel p LEFT JOIN fx_audit a USING (item_id, agent_id)))
WHERE draw_order <= CASE stratum WHEN 'recusa' THEN 30 WHEN 'adequada' THEN 20 ELSE 10 END
"""


@query("annotation_sequence", with_ctes(_SEQ))
def annotation_sequence(spark, sf_dir):
    from quorate.functions.rand import draw_digest
    from quorate.operators.prefix import distributed_rank

    key = F.concat_ws(":", F.col("item_id").cast("string"), F.col("agent_id").cast("string"))
    rows = _strata(spark, sf_dir).select("stratum", "item_id", "agent_id", draw_digest(key, 5).alias("d"))
    ranked = distributed_rank(rows, ["stratum"], "d", ["item_id", "agent_id"])
    draw = ranked.withColumn("draw_order", F.col("rank0") + 1)
    return fd.annotation_sequence(draw, {"recusa": 30, "adequada": 20, "inadequada": 10})


@query("fixed_sample", with_ctes("SELECT item_id, has_doc_ref FROM fx_items WHERE item_id IN (SELECT user_id FROM events)"))
def fixed_sample(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"))
    return fd.fixed_sample(fx.items(spark, sf_dir), ids)


@query("recall_auroc", r6("""

SELECT agent_id, CAST(sum(n) AS BIGINT) AS n, sum(s * (below + (n - s) / 2.0)) / (CAST(sum(s) AS DOUBLE) * sum(n - s)) AS auroc FROM (
  SELECT *, coalesce(sum(n - s) OVER (PARTITION BY agent_id ORDER BY recall ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT agent_id, floor(o_totalprice) % 5 / 4.0 AS recall, count(*) AS n, sum(z) AS s
        FROM fx_panel JOIN orders ON o_orderkey = item_id WHERE has_doc_ref GROUP BY 1, 2)) GROUP BY 1""", "auroc"))
def recall_auroc(spark, sf_dir):
    recall = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), (F.floor("o_totalprice") % 5 / 4.0).alias("recall")
    )
    rows = fx.panel(spark, sf_dir).where("has_doc_ref").join(recall, "item_id")
    return sel.auroc(rows, ["agent_id"], "recall", F.col("z"))


@query("recall_bands", with_ctes("""
SELECT CASE WHEN r = 0 THEN 'zero' WHEN r >= 1 THEN 'one' ELSE 'between' END AS band, count(*) AS n FROM (SELECT floor(o_totalprice) % 5 / 4.0 AS r FROM orders) GROUP BY 1"""))
def recall_bands(spark, sf_dir):
    r = (F.floor("o_totalprice") % 5 / 4.0).alias("r")
    return fx.table(spark, sf_dir, "orders").select(r).groupBy(pn.recall_band(F.col("r")).alias("band")).agg(F.count("*").alias("n"))


@query("error_categories", with_ctes("""
SELECT category, count(*) AS n FROM (SELECT unnest(CASE doc_id % 3 WHEN 0 THEN [lang, source] WHEN 1 THEN [lang] ELSE [] END) AS category FROM documents) GROUP BY 1"""))
def error_categories(spark, sf_dir):
    k = F.col("doc_id") % 3
    listed = F.when(k == 0, F.array("lang", "source")).when(k == 1, F.array("lang")).otherwise(F.array().cast("array<string>"))
    return pn.value_counts(fx.table(spark, sf_dir, "documents").select(listed.alias("category")), "category")


@query("refusal_verdict_labels", with_ctes("""
SELECT CASE refusal_verdict WHEN 2 THEN 'justificada' ELSE 'evasiva' END AS label, count(*) AS n FROM fx_audit GROUP BY 1"""))
def refusal_verdict_labels(spark, sf_dir):
    from quorate.functions.constants import REFUSAL_LABELS

    kept = pn.drop_parse_failures(fx.refusal_audit(spark, sf_dir), "refusal_verdict")
    return kept.groupBy(pn.label_of(F.col("refusal_verdict"), REFUSAL_LABELS).alias("label")).agg(F.count("*").alias("n"))


@query("recall_pairing", r6("""
SELECT item_id, n_expected, new_file, new_passage, old_file, old_passage FROM (
  SELECT item_id, n_expected, file_recall AS new_file, passage_recall AS new_passage FROM fx_per_item) JOIN (
  SELECT item_id, avg(f) AS old_file, avg(p) AS old_passage FROM (
    SELECT DISTINCT e.item_id, e.source_doc, e.anchor,
      CASE WHEN EXISTS (SELECT 1 FROM fx_served s WHERE s.combined_rank <= 3 AND s.item_id = e.item_id AND s.source_doc = e.source_doc) THEN 1 ELSE 0 END AS f,
      CASE WHEN EXISTS (SELECT 1 FROM fx_served s JOIN fx_hits h ON h.chunk_id = s.chunk_id WHERE s.combined_rank <= 3 AND s.item_id = e.item_id AND h.source_doc = e.source_doc AND h.anchor = e.anchor) THEN 1 ELSE 0 END AS p
    FROM fx_expected e) GROUP BY 1) USING (item_id)""", "new_file", "new_passage", "old_file", "old_passage"))
def recall_pairing(spark, sf_dir):
    chunks, expected = fx.written_chunks(spark, sf_dir), materialise(fx.expected(spark, sf_dir))
    hits, served = ev.literal_hits(chunks, expected), served_lexical(spark, sf_dir, chunks)
    return ev.paired_recall(
        ev.passage_recall(served.where("combined_rank <= 3"), expected, hits), ev.passage_recall(served, expected, hits)
    )


_SCORE = "CAST('0x' || substr(md5('11:' || query_id || '|' || chunk_id), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE)"


def _plain_rung(name: str, pools: str) -> str:
    return f"""
SELECT query_id, '{name}' AS rung, chunk_id, source_doc, combined_rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS combined_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, source_doc ORDER BY pos) AS seen FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN d IS NOT NULL AND l IS NOT NULL THEN 0 ELSE 1 END, d DESC NULLS LAST, chunk_id) AS pos FROM (
        SELECT query_id, chunk_id, source_doc, max(CASE WHEN branch = 'dense' THEN score END) AS d, max(CASE WHEN branch = 'lexical' THEN score END) AS l
        FROM {pools} WHERE rank <= 5 GROUP BY 1, 2, 3))) WHERE seen <= 1) WHERE combined_rank <= 10"""


def _quota_rung(name: str, pools: str) -> str:
    return f"""
SELECT query_id, '{name}' AS rung, chunk_id, source_doc,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, CASE source_type WHEN 'norm' THEN 0 ELSE 1 END, pos) AS INTEGER) AS combined_rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY rerank_score DESC, typed) AS pos FROM (
  SELECT *, {_SCORE} AS rerank_score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY round(rrf_score, 14) DESC, chunk_id) AS typed FROM (
      SELECT query_id, chunk_id, source_doc, source_type, sum(CAST(1 AS DOUBLE) / (60 + rank)) AS rrf_score FROM {pools} GROUP BY 1, 2, 3, 4)) WHERE typed <= 100))
WHERE pos <= CASE source_type WHEN 'norm' THEN 5 ELSE 2 END"""


cte("fx_rfused", """
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 14) DESC, chunk_id) AS INTEGER) AS fused_rank
FROM (SELECT query_id, chunk_id, source_doc, sum(CAST(1 AS DOUBLE) / (60 + rank)) AS rrf_score FROM fx_pools_repaired GROUP BY 1, 2, 3)
""")
cte("fx_ladder", " UNION ALL ".join([
    _plain_rung("R0", "fx_pools"), _plain_rung("R0''", "fx_pools_repaired"),
    "SELECT query_id, 'R1', chunk_id, source_doc, fused_rank FROM fx_rfused WHERE fused_rank <= 7",
    f"""SELECT query_id, 'R2', chunk_id, source_doc, r FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_SCORE} DESC, fused_rank) AS INTEGER) AS r FROM fx_rfused WHERE fused_rank <= 100) WHERE r <= 7""",
    _quota_rung("R3", "(SELECT * FROM fx_pools_typed WHERE variant = 0)"), _quota_rung("R5", "fx_pools_typed"),
]))


def ladder_served(spark, sf_dir):
    """All six rungs: R0 on the original vectors, the others on the repaired ones."""
    repaired = repaired_vectors(spark, sf_dir)
    first = vector_pools(spark, sf_dir)
    second = materialise(pools_of(repaired, fx.vector_queries(spark, sf_dir)))
    worded = materialise(typed_pools(repaired, wordings(spark, sf_dir)))
    single = worded.where(F.col("query_id") % WORDINGS == 0)
    return materialise(ladder.climb({
        "R0": (first, None), "R0'": (second, None), "R1": (second, None), "R2": (second, fx.rerank_scores),
        "R3": (by_question(single), fx.rerank_scores), "R5": (by_question(worded), fx.rerank_scores),
    }))


@query("retrieval_ladder", with_ctes("SELECT query_id, rung, chunk_id, combined_rank FROM fx_ladder"))
def retrieval_ladder(spark, sf_dir):
    return ladder_served(spark, sf_dir).select("query_id", "rung", "chunk_id", "combined_rank")


cte("fx_rungs", """
SELECT rung, count(*) AS n_items, avg(n) AS n_chunks, avg(hit / CAST(2 AS DOUBLE)) AS doc_recall,
       CASE rung WHEN 'R0''' THEN 'R0' WHEN 'R1' THEN 'R0''' WHEN 'R2' THEN 'R1' WHEN 'R3' THEN 'R2' WHEN 'R5' THEN 'R3' END AS previous
FROM (SELECT r.rung, q.query_id, count(l.chunk_id) AS n,
             count(DISTINCT CASE WHEN l.source_doc IN (CAST(q.query_id % 50 AS VARCHAR), CAST((q.query_id + 1) % 50 AS VARCHAR)) THEN l.source_doc END) AS hit
      FROM (SELECT vec_id AS query_id FROM embeddings) q CROSS JOIN (SELECT DISTINCT rung FROM fx_ladder) r
      LEFT JOIN fx_ladder l ON l.query_id = q.query_id AND l.rung = r.rung GROUP BY 1, 2) GROUP BY 1
""")


@query("ladder_gains", r6("""
SELECT t.rung, t.n_items, t.n_chunks, t.doc_recall, t.previous, t.doc_recall - o.doc_recall AS gain
FROM fx_rungs t LEFT JOIN fx_rungs o ON o.rung = t.previous""", "n_chunks", "doc_recall", "gain"))
def ladder_gains(spark, sf_dir):
    """Recall of two expected documents a question on every rung, and the gain over the rung before; the first gain is that of the repair."""
    wanted = F.explode(F.array((F.col("query_id") % 50).cast("string"), ((F.col("query_id") + 1) % 50).cast("string")))
    asked = fx.vector_queries(spark, sf_dir).select("query_id", wanted.alias("source_doc"))
    return ladder.gains(ladder_served(spark, sf_dir), asked)


@query("query_variants", with_ctes("""
SELECT b.item_id, CAST(v AS INTEGER) AS variant, CASE WHEN v IN (1, 2) AND (b.item_id + v) % 2 = 0 THEN q.text || ' v2' ELSE q.text END AS text
FROM benchmark b JOIN fx_queries q ON q.query_id = b.item_id CROSS JOIN range(4) r(v)"""))
def query_variants(spark, sf_dir):
    asked = fx.queries(spark, sf_dir)
    given = asked.withColumn("variant", F.explode(F.array(F.lit(1), F.lit(2)))).where("(query_id + variant) % 2 = 0")
    return fu.expand_variants(asked, given.withColumn("text", F.concat("text", F.lit(" v2"))), 3)
