"""Queries for lexical, dense and fused retrieval and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorate.functions import constants as C
from quorate.functions import text as tx
from quorate.operators import evaluation as ev
from quorate.operators import fusion as fu
from quorate.operators import retrieval as rt
from quorate.operators import versions as vs
from quorate.session import materialise
from workload import fixtures as fx
from workload.ctes import cte, r6, with_ctes
from workload.registry import query
from workload.text_queries import tokens_sql, words_sql

cte("fx_queries", f"""
SELECT item_id AS query_id, array_to_string({words_sql('text')}, ' ') AS text FROM benchmark
""")
cte("fx_expected", """
SELECT b.item_id, CAST(d.doc_id AS VARCHAR) AS source_doc, b.text AS anchor
FROM documents d JOIN benchmark b ON contains(d.text, b.text)
""")
cte("fx_tokens", f"SELECT chunk_id, source_doc, load_order, {tokens_sql('text')} AS t FROM fx_chunks")
cte("fx_postings", """
SELECT chunk_id, source_doc, load_order, CAST(dl AS INTEGER) AS dl, term, count(*) AS tf
FROM (SELECT chunk_id, source_doc, load_order, len(t) AS dl, unnest(t) AS term FROM fx_tokens) GROUP BY 1, 2, 3, 4, 5
""")
cte("fx_stats", "SELECT count(*) AS n_chunks, CAST(sum(len(t)) AS DOUBLE) / count(*) AS avgdl FROM fx_tokens")
cte("fx_rawidf", """
SELECT term, df, ln(n_chunks - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM fx_postings GROUP BY 1) CROSS JOIN fx_stats
""")
cte("fx_idf", "SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM fx_rawidf) ELSE raw END AS idf FROM fx_rawidf")
cte("fx_qterms", f"""
SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({tokens_sql('text')}) AS term FROM fx_queries) GROUP BY 1, 2
""")
cte("fx_bm25", """
SELECT q.query_id, p.chunk_id, p.source_doc, p.load_order,
       sum(q.qf * i.idf * (p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / s.avgdl)))) AS score
FROM fx_qterms q JOIN fx_idf i USING (term) JOIN fx_postings p USING (term) CROSS JOIN fx_stats s GROUP BY 1, 2, 3, 4
""")
cte("fx_lexical", """
SELECT query_id, rank, chunk_id, source_doc, load_order, round(score, 9) AS score FROM (
  SELECT query_id, chunk_id, source_doc, load_order, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, load_order) AS INTEGER) AS rank
  FROM (
    SELECT query_id, chunk_id, source_doc, load_order, score FROM fx_bm25
    UNION ALL
    SELECT q.query_id, c.chunk_id, c.source_doc, c.load_order, 0
    FROM (SELECT DISTINCT query_id FROM fx_qterms) q CROSS JOIN (SELECT * FROM fx_chunks ORDER BY load_order LIMIT 50) c
    WHERE NOT EXISTS (SELECT 1 FROM fx_bm25 b WHERE b.query_id = q.query_id AND b.chunk_id = c.chunk_id)))
WHERE rank <= 50
""")


@query("bm25_postings", with_ctes("SELECT chunk_id, source_doc, load_order, dl, term, tf FROM fx_postings"))
def bm25_postings(spark, sf_dir):
    return rt.postings(fx.chunks(spark, sf_dir))


@query("bm25_idf", r6("SELECT term, avgdl, idf FROM fx_idf CROSS JOIN fx_stats", "avgdl", "idf"))
def bm25_idf(spark, sf_dir):
    return rt.term_idf(fx.lexical_index(fx.chunks(spark, sf_dir)))


# A repaired version of the corpus: the chunks of every seventh document end in more words, those of every
# eleventh are gone. It shares the stored index of the original.

cte("fx_chunks_repaired", """
SELECT chunk_id, source_doc, load_order, CASE WHEN doc_id % 7 = 3 THEN text || ' reparo texto novo' ELSE text END AS text
FROM fx_chunks WHERE doc_id % 11 <> 5
""")
cte("fx_rtokens", f"SELECT chunk_id, source_doc, load_order, {tokens_sql('text')} AS t FROM fx_chunks_repaired")
cte("fx_rpostings", """
SELECT chunk_id, source_doc, load_order, CAST(dl AS INTEGER) AS dl, term, count(*) AS tf
FROM (SELECT chunk_id, source_doc, load_order, len(t) AS dl, unnest(t) AS term FROM fx_rtokens) GROUP BY 1, 2, 3, 4, 5
""")
cte("fx_rstats", "SELECT count(*) AS n_chunks, CAST(sum(len(t)) AS DOUBLE) / count(*) AS avgdl FROM fx_rtokens")
cte("fx_rrawidf", """
SELECT term, df, ln(n_chunks - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM fx_rpostings GROUP BY 1) CROSS JOIN fx_rstats
""")
cte("fx_ridf", "SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM fx_rrawidf) ELSE raw END AS idf FROM fx_rrawidf")


def repaired_version(spark, sf_dir):
    chunks = fx.written_chunks(spark, sf_dir)
    doc = F.col("source_doc").cast("bigint")
    longer = chunks.where((doc % 7 == 3) & (doc % 11 != 5)).withColumn("text", F.concat("text", F.lit(" reparo texto novo")))
    replaced = chunks.where((doc % 7 == 3) | (doc % 11 == 5)).select("source_doc").distinct()
    return vs.revised(vs.first_version(chunks), longer, replaced)


@query("versioned_idf", r6("SELECT term, avgdl, idf FROM fx_ridf CROSS JOIN fx_rstats", "avgdl", "idf"))
def versioned_idf(spark, sf_dir):
    """Term weights of the repaired corpus, from the original's counts and those of the changed chunks."""
    return vs.idf_of(repaired_version(spark, sf_dir))


@query("versioned_topk", r6("""
SELECT query_id, rank, chunk_id, source_doc, load_order, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, load_order) AS INTEGER) AS rank FROM (
    SELECT q.query_id, p.chunk_id, p.source_doc, p.load_order, round(sum(q.qf * i.idf * (p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / s.avgdl)))), 9) AS score
    FROM fx_qterms q JOIN fx_ridf i USING (term) JOIN fx_rpostings p USING (term) CROSS JOIN fx_rstats s GROUP BY 1, 2, 3, 4
    UNION ALL
    SELECT q.query_id, c.chunk_id, c.source_doc, c.load_order, 0 FROM (SELECT DISTINCT query_id FROM fx_qterms) q
    CROSS JOIN (SELECT * FROM fx_chunks_repaired ORDER BY load_order LIMIT 20) c
    WHERE NOT EXISTS (SELECT 1 FROM fx_qterms t JOIN fx_rpostings p USING (term) WHERE t.query_id = q.query_id AND p.chunk_id = c.chunk_id)))
WHERE rank <= 20""", "score"))
def versioned_topk(spark, sf_dir):
    version = repaired_version(spark, sf_dir)
    return rt.lexical_search(fx.queries(spark, sf_dir), materialise(version.rows), 20, idf=vs.idf_of(version))


@query("bm25_topk", r6("SELECT query_id, rank, chunk_id, source_doc, load_order, score FROM fx_lexical", "score"))
def bm25_topk(spark, sf_dir):
    return rt.lexical_search(fx.queries(spark, sf_dir), fx.lexical_index(fx.chunks(spark, sf_dir)), 50)


cte("fx_vec", """
SELECT printf('v%06d', vec_id) AS chunk_id, CAST(vec_id % 50 AS VARCHAR) AS source_doc, vec_id AS load_order,
       CASE WHEN label < 5 THEN 'norm' ELSE 'ruling' END AS source_type, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
""")
cte("fx_vecq", "SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings")
cte("fx_dot", """
SELECT q.query_id, v.chunk_id, v.source_doc, v.load_order, v.source_type, round(list_dot_product(v.e, q.e), 9) AS score FROM fx_vec v CROSS JOIN fx_vecq q
""")


@query("dense_topk", r6("""
SELECT query_id, chunk_id, load_order, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, load_order) AS INTEGER) AS rank FROM fx_dot) WHERE rank <= 20""", "score"))
def dense_topk(spark, sf_dir):
    return rt.dense_search(fx.vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir), 20)


# Split index: one idf per source type.

cte("fx_typed_tokens", f"""
SELECT CASE WHEN d.lang = 'en' THEN 'norm' ELSE 'ruling' END AS source_type, c.chunk_id, c.source_doc, c.load_order, {tokens_sql('c.text')} AS t
FROM fx_chunks c JOIN documents d USING (doc_id)
""")
cte("fx_typed_post", """
SELECT source_type, chunk_id, source_doc, load_order, dl, term, count(*) AS tf
FROM (SELECT source_type, chunk_id, source_doc, load_order, len(t) AS dl, unnest(t) AS term FROM fx_typed_tokens) GROUP BY 1, 2, 3, 4, 5, 6
""")
cte("fx_typed_stats", "SELECT source_type, count(*) AS n_chunks, CAST(sum(len(t)) AS DOUBLE) / count(*) AS avgdl FROM fx_typed_tokens GROUP BY 1")
cte("fx_typed_raw", """
SELECT source_type, term, ln(n_chunks - df + 0.5) - ln(df + 0.5) AS raw
FROM (SELECT source_type, term, count(*) AS df FROM fx_typed_post GROUP BY 1, 2) JOIN fx_typed_stats USING (source_type)
""")
cte("fx_typed_idf", """
SELECT r.source_type, term, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM fx_typed_raw r
JOIN (SELECT source_type, avg(raw) AS m FROM fx_typed_raw GROUP BY 1) a USING (source_type)
""")
cte("fx_typed_bm25", """
SELECT source_type, q.query_id, p.chunk_id, p.source_doc, p.load_order,
       sum(q.qf * i.idf * (p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / s.avgdl)))) AS score
FROM fx_qterms q JOIN fx_typed_idf i USING (term) JOIN fx_typed_post p USING (term, source_type)
JOIN fx_typed_stats s USING (source_type) GROUP BY 1, 2, 3, 4, 5
""")
cte("fx_typed_first", f"""
SELECT * FROM (SELECT source_type, chunk_id, source_doc, load_order, row_number() OVER (PARTITION BY source_type ORDER BY load_order) AS rn
FROM fx_typed_tokens) WHERE rn <= 10
""")


@query("split_index_topk", r6("""
SELECT source_type, query_id, rank, chunk_id, source_doc, load_order, round(score, 9) AS score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY source_type, query_id ORDER BY round(score, 9) DESC, load_order) AS INTEGER) AS rank FROM (
    SELECT * FROM fx_typed_bm25
    UNION ALL SELECT f.source_type, q.query_id, f.chunk_id, f.source_doc, f.load_order, 0
    FROM (SELECT DISTINCT query_id FROM fx_qterms) q CROSS JOIN fx_typed_first f
    WHERE NOT EXISTS (SELECT 1 FROM fx_typed_bm25 b WHERE b.query_id = q.query_id AND b.chunk_id = f.chunk_id)))
WHERE rank <= 10""", "score"))
def split_index_topk(spark, sf_dir):
    index = fx.lexical_index(fx.chunks(spark, sf_dir), ("source_type",))
    return rt.lexical_search(fx.queries(spark, sf_dir), index, 10, ["source_type"])


# Fusion over two ranked branches of the vector table: neighbours of the query by all dimensions,
# and by the even dimensions alone, which stand in for the lexical branch.

cte("fx_dot_even", """
SELECT q.query_id, v.chunk_id, v.source_doc, v.load_order, v.source_type,
       round(list_dot_product(v.e, list_transform(q.e, lambda x, i: CASE WHEN i % 2 = 1 THEN x ELSE 0 END)), 9) AS score
FROM fx_vec v CROSS JOIN fx_vecq q
""")
cte("fx_pools", """
SELECT query_id, 'dense' AS branch, rank, chunk_id, source_doc, source_type, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, load_order) AS INTEGER) AS rank FROM fx_dot) WHERE rank <= 50
UNION ALL
SELECT query_id, 'lexical', rank, chunk_id, source_doc, source_type, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, load_order) AS INTEGER) AS rank FROM fx_dot_even) WHERE rank <= 50
""")


def pools_of(vectors, asked):
    """Two pools of 50 per query over a table of vectors."""
    even = F.transform("embedding", lambda x, i: F.when(i % 2 == 0, x).otherwise(F.lit(0.0).cast("float")))
    dense = rt.dense_search(vectors, asked, 50, ["source_doc"])
    lexical = rt.dense_search(vectors, asked.withColumn("embedding", even), 50, ["source_doc"])
    return rt.pools(lexical, dense)


def vector_pools(spark, sf_dir):
    return materialise(pools_of(fx.vectors(spark, sf_dir), fx.vector_queries(spark, sf_dir)))


# The repaired corpus: every seventh vector is another one. Wordings of a question: its vector, and three vectors
# with part of its dimensions.

WORDINGS = 4
cte("fx_vec_repaired", """
SELECT chunk_id, source_doc, load_order, source_type, CASE WHEN load_order % 7 = 3 THEN list_reverse(e) ELSE e END AS e FROM fx_vec
""")
cte("fx_wordings", """
SELECT query_id, variant, list_transform(e, lambda x, i: CASE WHEN variant = 0 OR variant = 1 AND i % 3 <> 0 OR variant = 2 AND i <= 40 OR variant = 3 AND i > 24 THEN x ELSE 0 END) AS e
FROM fx_vecq CROSS JOIN (SELECT unnest(range(0, 4)) AS variant)
""")


def _pools_sql(corpus: str, part: str = "query_id, variant", where: str = "true") -> str:
    one = """
SELECT query_id, variant, '{name}' AS branch, rank, chunk_id, source_doc, source_type, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY {part} ORDER BY score DESC, load_order) AS INTEGER) AS rank FROM (
    SELECT q.query_id, q.variant, v.chunk_id, v.source_doc, v.load_order, v.source_type, round(list_dot_product(v.e, {vector}), 9) AS score
    FROM {corpus} v CROSS JOIN fx_wordings q WHERE {where})) WHERE rank <= 50"""
    even = "list_transform(q.e, lambda x, i: CASE WHEN i % 2 = 1 THEN x ELSE 0 END)"
    return " UNION ALL ".join(one.format(name=n, part=part, vector=v, corpus=corpus, where=where) for n, v in (("dense", "q.e"), ("lexical", even)))


cte("fx_pools_repaired", _pools_sql("fx_vec_repaired", where="variant = 0"))
cte("fx_pools_typed", _pools_sql("fx_vec_repaired", "query_id, variant, source_type"))
cte("fx_pools_wordings", _pools_sql("fx_vec"))


def repaired_vectors(spark, sf_dir):
    changed = F.when(F.col("load_order") % 7 == 3, F.reverse("embedding")).otherwise(F.col("embedding"))
    return fx.vectors(spark, sf_dir).withColumn("embedding", changed)


def wordings(spark, sf_dir):
    """All wordings of every question, numbered by ``query_id`` * WORDINGS + variant."""
    asked = fx.vector_queries(spark, sf_dir).withColumn("variant", F.explode(F.array(*[F.lit(i) for i in range(WORDINGS)])))
    v, kept = F.col("variant"), lambda i: (F.col("variant") == 0) | ((F.col("variant") == 1) & ((i + 1) % 3 != 0)) | ((F.col("variant") == 2) & (i < 40)) | ((F.col("variant") == 3) & (i >= 24))
    some = F.transform("embedding", lambda x, i: F.when(kept(i), x).otherwise(F.lit(0.0).cast("float")))
    return asked.select((F.col("query_id") * WORDINGS + v).alias("query_id"), some.alias("embedding"))


def by_question(pools):
    """Pools of wordings under the question's own number."""
    return pools.withColumn("query_id", F.floor(F.col("query_id") / WORDINGS).cast("bigint"))


def typed_pools(vectors, asked):
    """Pools of one index for each source type."""
    out = None
    for kind in ("norm", "ruling"):
        one = pools_of(vectors.where(F.col("source_type") == kind), asked).withColumn("source_type", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


cte("fx_union_all", """
SELECT s.setting, s.kd, s.kl, s.m, p.query_id, p.chunk_id, p.source_doc, max(CASE WHEN branch = 'dense' THEN score END) AS dense_score,
       max(CASE WHEN branch = 'lexical' THEN score END) AS bm25_score
FROM fx_pools p CROSS JOIN (VALUES (0,5,5,1),(1,5,5,3),(2,5,5,99),(3,15,15,1),(4,15,15,3),(5,30,30,1),(6,30,30,3),(7,50,50,99),(8,30,1,3),(9,1,30,3)) s(setting, kd, kl, m)
WHERE p.rank <= CASE WHEN branch = 'dense' THEN s.kd ELSE s.kl END GROUP BY 1, 2, 3, 4, 5, 6, 7
""")
cte("fx_union_served", """
SELECT setting, query_id, chunk_id, source_doc, dense_score, bm25_score, combined_rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY setting, query_id ORDER BY pos) AS INTEGER) AS combined_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY setting, query_id, source_doc ORDER BY pos) AS seen FROM (
      SELECT *, row_number() OVER (PARTITION BY setting, query_id ORDER BY CASE WHEN dense_score IS NOT NULL AND bm25_score IS NOT NULL THEN 0 ELSE 1 END,
        dense_score DESC NULLS LAST, chunk_id) AS pos FROM fx_union_all)) WHERE seen <= m) WHERE combined_rank <= kd + kl
""")


@query("hybrid_union", r6("""
SELECT query_id, chunk_id, source_doc, dense_score, bm25_score, combined_rank FROM fx_union_served WHERE setting = 0""", "dense_score", "bm25_score"))
def hybrid_union(spark, sf_dir):
    return fu.hybrid_union(vector_pools(spark, sf_dir), 5, 5, 1)


@query("retrieval_sweep", with_ctes("""
SELECT CAST(setting AS INTEGER) AS setting, query_id, chunk_id, combined_rank FROM fx_union_served"""))
def retrieval_sweep(spark, sf_dir):
    served = fu.retrieval_sweep(vector_pools(spark, sf_dir))
    return served.select("setting", "query_id", "chunk_id", "combined_rank")


cte("fx_fused", """
SELECT query_id, chunk_id, source_doc, source_type, rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 14) DESC, chunk_id) AS INTEGER) AS fused_rank
FROM (SELECT query_id, chunk_id, source_doc, source_type, sum(CAST(1 AS DOUBLE) / (60 + rank)) AS rrf_score FROM fx_pools GROUP BY 1, 2, 3, 4)
""")


@query("rrf_fusion", r6("SELECT query_id, chunk_id, source_doc, rrf_score, fused_rank FROM fx_fused", "rrf_score"))
def rrf_fusion(spark, sf_dir):
    return fu.reciprocal_rank_fusion(vector_pools(spark, sf_dir))


@query("capped_cut", r6("""
SELECT query_id, chunk_id, source_doc, rrf_score, fused_rank, combined_rank,
       (SELECT max(score) FROM fx_pools p WHERE p.query_id = q.query_id AND p.chunk_id = q.chunk_id AND branch = 'dense') AS dense_score,
       (SELECT max(score) FROM fx_pools p WHERE p.query_id = q.query_id AND p.chunk_id = q.chunk_id AND branch = 'lexical') AS bm25_score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS INTEGER) AS combined_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, source_doc ORDER BY fused_rank) AS seen FROM fx_fused) WHERE seen <= 1) q
WHERE combined_rank <= 7""", "rrf_score", "dense_score", "bm25_score"))
def capped_cut(spark, sf_dir):
    pools = vector_pools(spark, sf_dir)
    return fu.with_branch_scores(fu.cut_fused(fu.reciprocal_rank_fusion(pools), 7, 1), pools)


cte("fx_reranked", """
SELECT *, CAST('0x' || substr(md5('11:' || query_id || '|' || chunk_id), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS rerank_score
FROM fx_fused WHERE fused_rank <= 100
""")


@query("rerank_cut", r6("""
SELECT query_id, chunk_id, source_doc, rrf_score, fused_rank, rerank_score, combined_rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) AS INTEGER) AS combined_rank FROM fx_reranked)
WHERE combined_rank <= 7""", "rrf_score", "rerank_score"))
def rerank_cut(spark, sf_dir):
    fused = fu.reciprocal_rank_fusion(vector_pools(spark, sf_dir))
    return fu.rerank(fused, fx.rerank_scores(fused))


@query("stale_score_gate", with_ctes("""
SELECT a.query_id, a.fused_rank, a.chunk_id, b.chunk_id AS scored_chunk FROM fx_fused a
JOIN (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS INTEGER) AS fused_rank FROM fx_reranked) b
  ON a.query_id = b.query_id AND a.fused_rank = b.fused_rank
WHERE a.fused_rank <= 100 AND a.chunk_id <> b.chunk_id"""))
def stale_score_gate(spark, sf_dir):
    fused = materialise(fu.reciprocal_rank_fusion(vector_pools(spark, sf_dir)))
    head = fused.where("fused_rank <= 100").drop("fused_rank")
    scored = rt.top_k(head, ["query_id"], [F.col("chunk_id")], 100, "fused_rank")
    return fu.stale_scores(fused, scored)


@query("quota_retrieval", r6("""
SELECT query_id, chunk_id, source_type, rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC,
         CASE source_type WHEN 'norm' THEN 0 ELSE 1 END, pos) AS INTEGER) AS combined_rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY rerank_score DESC, fused_rank) AS pos FROM fx_reranked)
WHERE pos <= CASE source_type WHEN 'norm' THEN 5 ELSE 2 END""", "rerank_score"))
def quota_retrieval(spark, sf_dir):
    pools = vector_pools(spark, sf_dir)
    fused = fu.reciprocal_rank_fusion(pools)
    kinds = fx.vectors(spark, sf_dir).select("chunk_id", "source_type")
    ranked = fused.where("fused_rank <= 100").join(fx.rerank_scores(fused), ["query_id", "chunk_id"]).join(kinds, "chunk_id")
    served = fu.quota_retrieval(ranked)
    return served.select("query_id", "chunk_id", "source_type", "rerank_score", "combined_rank")


@query("multi_query", r6("""
SELECT query_id, chunk_id, source_doc, rrf_score, fused_rank, rerank_score, combined_rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) AS INTEGER) AS combined_rank FROM (
    SELECT *, CAST('0x' || substr(md5('11:' || query_id || '|' || chunk_id), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS rerank_score FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 14) DESC, chunk_id) AS INTEGER) AS fused_rank FROM (
        SELECT query_id, chunk_id, source_doc, sum(CAST(1 AS DOUBLE) / (60 + rank)) AS rrf_score FROM fx_pools_wordings GROUP BY 1, 2, 3))
    WHERE fused_rank <= 100)) WHERE combined_rank <= 7""", "rrf_score", "rerank_score"))
def multi_query(spark, sf_dir):
    """Four wordings of every question, two branches each: eight lists fused, the head reranked by the question itself."""
    fused = fu.reciprocal_rank_fusion(by_question(pools_of(fx.vectors(spark, sf_dir), wordings(spark, sf_dir))))
    # Scores are asked for what is reranked only.
    head = materialise(fused.where(F.col("fused_rank") <= C.RERANK_POOL))
    return fu.rerank(head, fx.rerank_scores(head))


@query("served_contract_gate", with_ctes("""
SELECT query_id, count(*) AS n, count(DISTINCT chunk_id) AS chunks, count(DISTINCT rank) AS ranks, min(rank) AS lo, max(rank) AS hi
FROM (SELECT query_id, CASE WHEN query_id % 3 = 0 AND fused_rank = 2 THEN chunk_id || '!' ELSE chunk_id END AS chunk_id,
             CASE WHEN query_id % 5 = 0 THEN fused_rank + 1 ELSE fused_rank END AS rank
      FROM fx_fused WHERE fused_rank <= CASE WHEN query_id % 3 = 0 THEN 9 ELSE 7 END) GROUP BY 1
HAVING count(*) > 7 OR count(DISTINCT chunk_id) <> count(*) OR count(DISTINCT rank) <> count(*) OR min(rank) <> 1 OR max(rank) <> count(*)"""))
def served_contract_gate(spark, sf_dir):
    """Served lists of which some are too long and some have wrong ranks: the gate names exactly those."""
    fused = materialise(fu.reciprocal_rank_fusion(vector_pools(spark, sf_dir)))
    served = fused.where(F.col("fused_rank") <= F.when(F.col("query_id") % 3 == 0, 9).otherwise(7))
    chunk = F.when((F.col("query_id") % 3 == 0) & (F.col("fused_rank") == 2), F.concat("chunk_id", F.lit("!"))).otherwise(F.col("chunk_id"))
    rank = F.when(F.col("query_id") % 5 == 0, F.col("fused_rank") + 1).otherwise(F.col("fused_rank"))
    return fu.contract_violations(served.select("query_id", chunk.alias("chunk_id"), rank.alias("combined_rank")), 7)


@query("alignment_gate", with_ctes("""
SELECT v.name AS "check", v.n FROM (
  SELECT (SELECT count(*) FROM fx_chunks WHERE load_order % 5 <> 0 AND load_order % 2 <> 0) AS a,
         (SELECT count(*) FROM fx_chunks WHERE load_order % 5 = 0 AND load_order % 2 = 0) AS b,
         (SELECT count(DISTINCT chunk_id) FROM fx_postings WHERE load_order % 5 = 0) AS c) CROSS JOIN LATERAL (VALUES
  ('chunk_without_vector', a), ('vector_without_chunk', b), ('posting_without_chunk', c)) v(name, n)"""))
def alignment_gate(spark, sf_dir):
    from quorate.operators.gates import alignment_report

    chunks = fx.written_chunks(spark, sf_dir)
    return alignment_report(chunks.where("load_order % 5 <> 0"), chunks.where("load_order % 2 = 0"), rt.postings(chunks))


# Evaluation -------------------------------------------------------------------------------------------

cte("fx_served", """
SELECT query_id AS item_id, rank AS combined_rank, chunk_id, source_doc FROM fx_lexical WHERE rank <= 20
""")
cte("fx_hits", """
SELECT c.chunk_id, c.source_doc, e.anchor FROM fx_chunks c JOIN (SELECT DISTINCT source_doc, anchor FROM fx_expected) e
  ON e.source_doc = c.source_doc AND contains(c.text, e.anchor)
""")
cte("fx_per_item", """
SELECT item_id, count(*) AS n_expected, avg(f) AS file_recall, avg(p) AS passage_recall FROM (
  SELECT DISTINCT e.item_id, e.source_doc, e.anchor,
    CASE WHEN EXISTS (SELECT 1 FROM fx_served s WHERE s.item_id = e.item_id AND s.source_doc = e.source_doc) THEN 1 ELSE 0 END AS f,
    CASE WHEN EXISTS (SELECT 1 FROM fx_served s JOIN fx_hits h ON h.chunk_id = s.chunk_id
       WHERE s.item_id = e.item_id AND h.source_doc = e.source_doc AND h.anchor = e.anchor) THEN 1 ELSE 0 END AS p
  FROM fx_expected e) GROUP BY 1
""")


def served_lexical(spark, sf_dir, chunks):
    found = rt.lexical_search(fx.queries(spark, sf_dir), fx.lexical_index(chunks), 20)
    return materialise(found.select(F.col("query_id").alias("item_id"), F.col("rank").alias("combined_rank"), "chunk_id", "source_doc"))


@query("expected_pairs", with_ctes("SELECT item_id, source_doc, anchor FROM fx_expected"))
def expected_pairs(spark, sf_dir):
    return fx.expected(spark, sf_dir)


@query("passage_recall", r6("SELECT item_id, n_expected, file_recall, passage_recall FROM fx_per_item", "file_recall", "passage_recall"))
def passage_recall(spark, sf_dir):
    chunks, expected = fx.written_chunks(spark, sf_dir), materialise(fx.expected(spark, sf_dir))
    return ev.passage_recall(served_lexical(spark, sf_dir, chunks), expected, ev.literal_hits(chunks, expected))


@query("doc_recall", r6("""
SELECT b.item_id, coalesce(x.n, 0) AS n_expected, x.r AS document_recall FROM benchmark b LEFT JOIN (
  SELECT item_id, count(*) AS n, avg(CASE WHEN EXISTS (SELECT 1 FROM fx_served s WHERE s.item_id = e.item_id AND s.source_doc = e.source_doc) THEN 1 ELSE 0 END) AS r
  FROM (SELECT DISTINCT item_id, source_doc FROM fx_expected) e GROUP BY 1) x USING (item_id)""", "document_recall"))
def doc_recall(spark, sf_dir):
    served = served_lexical(spark, sf_dir, fx.written_chunks(spark, sf_dir))
    items = fx.table(spark, sf_dir, "benchmark").select("item_id")
    return ev.document_recall(served, fx.expected(spark, sf_dir).select("item_id", "source_doc").distinct(), items)


@query("mrr", r6("""
SELECT item_id, count(*) AS n_expected, CAST(count(*) FILTER (WHERE pos <= 1) AS DOUBLE) / count(*) AS recall_at_1,
       CAST(max(CASE WHEN pos <= 1 THEN 1 ELSE 0 END) AS DOUBLE) AS hit_at_1, CAST(count(*) FILTER (WHERE pos <= 5) AS DOUBLE) / count(*) AS recall_at_5,
       CAST(max(CASE WHEN pos <= 5 THEN 1 ELSE 0 END) AS DOUBLE) AS hit_at_5, coalesce(max(CAST(1 AS DOUBLE) / pos), 0) AS reciprocal_rank
FROM (SELECT DISTINCT item_id, source_doc FROM fx_expected) e LEFT JOIN (
  SELECT item_id, source_doc, row_number() OVER (PARTITION BY item_id ORDER BY f) AS pos
  FROM (SELECT item_id, source_doc, min(combined_rank) AS f FROM fx_served GROUP BY 1, 2)) d USING (item_id, source_doc) GROUP BY 1""",
  "recall_at_1", "hit_at_1", "recall_at_5", "hit_at_5", "reciprocal_rank"))
def mrr(spark, sf_dir):
    served = served_lexical(spark, sf_dir, fx.written_chunks(spark, sf_dir))
    return ev.ranked_documents(served, fx.expected(spark, sf_dir), [1, 5])


@query("oracle_ceiling", r6("""
SELECT count(*) AS n_pairs, count(*) FILTER (WHERE h) AS n_reachable, avg(CASE WHEN h THEN 1 ELSE 0 END) AS ceiling
FROM (SELECT DISTINCT item_id, source_doc, anchor, EXISTS (SELECT 1 FROM fx_hits x WHERE x.source_doc = e.source_doc AND x.anchor = e.anchor) AS h
      FROM fx_expected e)""", "ceiling"))
def oracle_ceiling(spark, sf_dir):
    chunks, expected = fx.chunks(spark, sf_dir), materialise(fx.expected(spark, sf_dir))
    return ev.oracle_ceiling(expected, ev.literal_hits(chunks, expected))


@query("retrieval_summary", r6("""
SELECT count(*) AS n_items, CAST(sum(n_expected) AS BIGINT) AS n_pairs, avg(passage_recall) AS passage_recall, avg(file_recall) AS file_recall,
       avg(CASE WHEN passage_recall > 0 THEN 1 ELSE 0 END) AS hit_rate, avg(CASE WHEN passage_recall = 0 THEN 1 ELSE 0 END) AS zero_share,
       avg(s.n_chunks) AS n_chunks, avg(s.n_words) AS n_words
FROM fx_per_item JOIN (SELECT item_id, count(*) AS n_chunks, sum(n_tokens) AS n_words FROM fx_served JOIN fx_chunks USING (chunk_id) GROUP BY 1) s USING (item_id)""",
  "passage_recall", "file_recall", "hit_rate", "zero_share", "n_chunks", "n_words"))
def retrieval_summary(spark, sf_dir):
    chunks, expected = fx.written_chunks(spark, sf_dir), materialise(fx.expected(spark, sf_dir))
    served = served_lexical(spark, sf_dir, chunks)
    per_item = ev.passage_recall(served, expected, ev.literal_hits(chunks, expected))
    sizes = served.join(chunks.select("chunk_id", "n_tokens"), "chunk_id").groupBy("item_id").agg(
        F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("n_words")
    )
    return ev.retrieval_summary(per_item, sizes)


@query("recall_inflation", r6("""
SELECT count(*) AS n_items, avg(file_recall) / avg(passage_recall) AS inflation,
       count(*) FILTER (WHERE file_recall > 0 AND passage_recall = 0) AS n_file_without_passage FROM fx_per_item""", "inflation"))
def recall_inflation(spark, sf_dir):
    chunks, expected = fx.written_chunks(spark, sf_dir), materialise(fx.expected(spark, sf_dir))
    served = served_lexical(spark, sf_dir, chunks)
    return ev.inflation(ev.passage_recall(served, expected, ev.literal_hits(chunks, expected)))


@query("recall_histogram", with_ctes("""
SELECT t.threshold, count(*) FILTER (WHERE passage_recall >= t.threshold) AS n FROM fx_per_item
CROSS JOIN (SELECT CAST(x AS DOUBLE) AS threshold FROM (VALUES (0.25), (0.5), (0.75), (1.0)) v(x)) t GROUP BY 1"""))
def recall_histogram(spark, sf_dir):
    chunks, expected = fx.written_chunks(spark, sf_dir), materialise(fx.expected(spark, sf_dir))
    served = served_lexical(spark, sf_dir, chunks)
    return ev.threshold_histogram(ev.passage_recall(served, expected, ev.literal_hits(chunks, expected)), [0.25, 0.5, 0.75, 1.0])


@query("composition_share", r6("""
SELECT source_type, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM fx_served) AS share
FROM fx_served s JOIN (SELECT CAST(doc_id AS VARCHAR) AS source_doc, CASE WHEN lang = 'en' THEN 'norm' ELSE 'ruling' END AS source_type FROM documents) d USING (source_doc)
GROUP BY 1""", "share"))
def composition_share(spark, sf_dir):
    from quorate.operators.panel import composition_share as share

    chunks = fx.written_chunks(spark, sf_dir)
    served = served_lexical(spark, sf_dir, chunks).join(chunks.select("chunk_id", "source_type"), "chunk_id")
    return share(served, "source_type")


@query("rescore_stored_run", r6("""
SELECT count(*) AS n, max(abs(passage_recall - stored)) AS max_abs_difference, CAST(0 AS BIGINT) AS n_unmatched
FROM (SELECT passage_recall, round(passage_recall, 1) AS stored FROM fx_per_item)""", "max_abs_difference"))
def rescore_stored_run(spark, sf_dir):
    """Stored recalls are the recomputed ones at one decimal, so the difference is known."""
    chunks, expected = fx.written_chunks(spark, sf_dir), materialise(fx.expected(spark, sf_dir))
    served = served_lexical(spark, sf_dir, chunks)
    ours = materialise(ev.passage_recall(served, expected, ev.literal_hits(chunks, expected)))
    stored = ours.withColumn("passage_recall", F.round("passage_recall", 1))
    return ev.rescore_difference(ours, stored, "passage_recall")
