"""Queries over documents, pages and outputs: tokens, chunks, HTML, anchors, parsing, repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorate.functions import text as tx
from quorate.operators import chunking as ck
from quorate.operators import evaluation as ev
from quorate.operators import panel as pn
from workload import fixtures as fx
from workload.ctes import cte, r6, with_ctes
from workload.registry import query

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STOP = (
    "'a','o','as','os','um','uma','uns','umas','de','da','do','das','dos','em','no','na','nos','nas','por','para',"
    "'com','sem','sob','sobre','ante','perante','e','ou','mas','porém','se','que','como','quando','é','são','foi',"
    "'será','ser','estar','ter','haver','este','esta','isto','esse','essa','isso','aquele','aquela','aquilo','seu',"
    "'sua','seus','suas','ao','à','aos','às'"
)


def tokens_sql(text: str) -> str:
    clean = f"regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}_{_WS}]', ' ', 'g')"
    return (
        f"list_filter(regexp_split_to_array({clean}, '[{_WS}]+'), "
        f"lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"
    )


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[{_WS}]+'), lambda t: t <> '')"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


@query("tokenize", with_ctes(f"""
SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs
FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY 1"""))
def tokenize(spark, sf_dir):
    terms = fx.table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    per_doc = terms.groupBy("term", "doc_id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("term").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs"))


@query("token_counts", with_ctes(f"""
SELECT doc_id, CAST(len({words_sql('text')}) AS INTEGER) AS n_words, CAST(len({tokens_sql('text')}) AS INTEGER) AS n_terms FROM documents"""))
def token_counts(spark, sf_dir):
    text = F.col("text")
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", tx.word_count(text).alias("n_words"), F.size(tx.tokens(text)).alias("n_terms")
    )


@query("paragraph_split", with_ctes(f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, p[i] AS paragraph FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS p FROM documents)
CROSS JOIN LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)"""))
def paragraph_split(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(tx.paragraphs(F.col("text"), "\n")).alias("pos", "paragraph")
    )


@query("sentence_split", with_ctes(f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, p[i] AS sentence FROM (
  SELECT doc_id, list_filter(list_transform(
    string_split(regexp_replace(text, '([.!?])[{_WS}]+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS p
  FROM documents)
CROSS JOIN LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)"""))
def sentence_split(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence")
    )


# Window packing as a recursion over units: the state is the first unit of the open window; a window
# is written where it closes.
cte("fx_units", f"""
SELECT doc_id, u, list_transform(u, lambda x: len({words_sql('x')})) AS w FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS u FROM documents)
""")
_STEP = """
SELECT k, u, w, i + 1 AS i,
  CASE WHEN i > len(w) THEN s
       WHEN w[i] > 64 THEN i + 1
       WHEN i > s AND coalesce(list_sum(w[s:i - 1]), 0) + w[i] > 64
         THEN coalesce(list_min(list_filter(range(s, i), lambda j: list_sum(w[j:i - 1]) <= 8)), i)
       ELSE s END AS s,
  CASE WHEN i > len(w) THEN CASE WHEN i > s THEN [[s, i - 1]] ELSE [] END
       WHEN w[i] > 64 THEN CASE WHEN i > s THEN [[s, i - 1], [i, i]] ELSE [[i, i]] END
       WHEN i > s AND coalesce(list_sum(w[s:i - 1]), 0) + w[i] > 64 THEN [[s, i - 1]]
       ELSE [] END AS emitted
FROM {rec} WHERE i <= len(w) + 1
"""
cte("fx_pack_rec", """
SELECT doc_id AS k, u, w, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS s, CAST([] AS BIGINT[][]) AS emitted FROM fx_units
UNION ALL
""" + _STEP.format(rec="fx_pack_rec"))
cte("fx_windows", """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, p) AS pos, array_to_string(u[win[1]:win[2]], ' ') AS text
FROM (SELECT k AS doc_id, u, i, unnest(emitted) AS win, unnest(range(1, len(emitted) + 1)) AS p FROM fx_pack_rec)
""")
cte("fx_resplit", f"""
SELECT doc_id, pos, u, list_transform(u, lambda x: len({words_sql('x')})) AS w FROM (
  SELECT doc_id, pos, list_filter(list_transform(
    string_split(regexp_replace(text, '([.!?])[{_WS}]+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS u
  FROM fx_windows WHERE len({words_sql('text')}) > 64)
""")
cte("fx_sentpack_rec", """
SELECT CAST(doc_id AS VARCHAR) || ':' || pos AS k, u, w, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS s, CAST([] AS BIGINT[][]) AS emitted FROM fx_resplit
UNION ALL
""" + _STEP.format(rec="fx_sentpack_rec"))
cte("fx_chunks", f"""
SELECT doc_id, CAST(doc_id AS VARCHAR) || '#' || lpad(CAST(chunk_pos AS VARCHAR), 4, '0') AS chunk_id, CAST(doc_id AS VARCHAR) AS source_doc,
       CAST(chunk_pos AS INTEGER) AS chunk_pos, text, CAST(len({words_sql('text')}) AS INTEGER) AS n_tokens,
       doc_id * 10000000 + chunk_pos AS load_order
FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, i, p) - 1 AS chunk_pos, text FROM (
    SELECT doc_id, pos, 0 AS i, 0 AS p, text FROM fx_windows WHERE len({words_sql('text')}) <= 64
    UNION ALL
    SELECT CAST(split_part(k, ':', 1) AS BIGINT), CAST(split_part(k, ':', 2) AS BIGINT), i, p, array_to_string(u[win[1]:win[2]], ' ')
    FROM (SELECT k, u, i, unnest(emitted) AS win, unnest(range(1, len(emitted) + 1)) AS p FROM fx_sentpack_rec)))
""")


@query("chunk_documents", with_ctes(
    "SELECT chunk_id, text, source_doc, n_tokens, chunk_pos, load_order FROM fx_chunks"))
def chunk_documents(spark, sf_dir):
    return fx.chunks(spark, sf_dir).drop("section_path", "source_type")


@query("chunk_size_quantiles", r6("""
SELECT count(*) AS n, avg(n_tokens) AS mean, quantile_cont(n_tokens, 0.5) AS median, quantile_cont(n_tokens, 0.95) AS p95,
       quantile_cont(n_tokens, 0.99) AS p99, max(n_tokens) AS max, count(*) FILTER (WHERE n_tokens > 64) AS n_over_limit
FROM fx_chunks""", "mean", "median", "p95", "p99"))
def chunk_size_quantiles(spark, sf_dir):
    return pn.size_quantiles(fx.chunks(spark, sf_dir), "n_tokens", 64)


@query("index_composition", with_ctes("""
SELECT CASE WHEN d.lang = 'en' THEN 'norm' ELSE 'ruling' END AS source_type, count(DISTINCT c.doc_id) AS n_documents, count(*) AS n_chunks
FROM fx_chunks c JOIN documents d USING (doc_id) GROUP BY 1"""))
def index_composition(spark, sf_dir):
    chunks = fx.chunks(spark, sf_dir)
    per_doc = chunks.groupBy("source_type", "source_doc").agg(F.count("*").alias("c"))
    return per_doc.groupBy("source_type").agg(
        F.count("*").alias("n_documents"), F.sum("c").alias("n_chunks")
    )


@query("source_types", with_ctes("""
SELECT name, CASE WHEN starts_with(name, 'disp_') OR starts_with(name, 'carf_') THEN 'pseudo_doc'
   WHEN regexp_matches(name, '^\\d[\\d_]*(\\.txt)?$') THEN 'ruling' ELSE 'norm' END AS kind
FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'disp_' || source WHEN 1 THEN doc_id || '_' || n_chars || '.txt'
             WHEN 2 THEN 'carf_' || doc_id ELSE lang || '-' || source END AS name FROM documents)"""))
def source_types(spark, sf_dir):
    d, kind = fx.table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    name = (
        F.when(kind == 0, F.concat(F.lit("disp_"), "source"))
        .when(kind == 1, F.concat("doc_id", F.lit("_"), "n_chars", F.lit(".txt")))
        .when(kind == 2, F.concat(F.lit("carf_"), "doc_id"))
        .otherwise(F.concat("lang", F.lit("-"), "source"))
    )
    return d.select(name.alias("name")).withColumn("kind", tx.source_type(F.col("name")))


@query("refusal_flags", with_ctes("""
SELECT conv_id, turn, regexp_matches(t, '(?i)não é possível responder|nao e possivel responder|não posso responder|contexto (fornecido )?(é|e) insuficiente|não há informa|nao ha informa|material fornecido não|não contém informa|não permite responder') AS refused
FROM (SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN text || ' NÃO POSSO RESPONDER.' WHEN 1 THEN 'O contexto fornecido é insuficiente. ' || text
       WHEN 2 THEN text || ' não há informação' ELSE text END AS t FROM conversations)"""))
def refusal_flags(spark, sf_dir):
    c, k = fx.table(spark, sf_dir, "conversations"), (F.col("conv_id") + F.col("turn")) % 5
    text = (
        F.when(k == 0, F.concat("text", F.lit(" NÃO POSSO RESPONDER.")))
        .when(k == 1, F.concat(F.lit("O contexto fornecido é insuficiente. "), "text"))
        .when(k == 2, F.concat("text", F.lit(" não há informação")))
        .otherwise(F.col("text"))
    )
    return c.select("conv_id", "turn", pn.is_refusal(text).alias("refused"))


_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"),
             ("&middot;", "·"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&")]


def _html_sql() -> str:
    body = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for name in ("script", "style", "title", "head"):
        body = f"regexp_replace({body}, '(?is)<{name}\\b[^>]*>.*?</{name}[{_WS}]*>', ' ', 'g')"
    body = f"regexp_replace({body}, '<[A-Za-z/!?][^>]*>', ' ', 'g')"
    for entity, char in _ENTITIES:
        body = f"replace({body}, '{entity}', '{char}')"
    return f"trim(regexp_replace({body}, '[{_WS}]+', ' ', 'g'))"


@query("html_text", with_ctes(f"SELECT page_id, {_html_sql()} AS text FROM pages"))
def html_text(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


# Repair audit ----------------------------------------------------------------------------------------

cte("fx_repair", """
SELECT doc_id, CAST(doc_id AS VARCHAR) AS source_doc, text || ' Art. ' || (doc_id % 7 + 1) || 'º fim' AS original,
  CASE doc_id % 6 WHEN 0 THEN text || ' Art. ' || (doc_id % 7 + 1) || 'º fim Artigo 12-A e Art. 0' || (doc_id % 9 + 1) || ' extra'
       WHEN 1 THEN substr(text, 1, 400) WHEN 2 THEN NULL WHEN 3 THEN text || chr(65533)
       WHEN 4 THEN 'outro documento sem relação alguma ' || doc_id ELSE text || ' mais palavras Art. 250.' END AS new_text,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'https://example.org/' || doc_id END AS url
FROM documents
""")
cte("fx_repair_expected", """
SELECT CAST(d.doc_id AS VARCHAR) AS source_doc, v.article, v.item FROM documents d
CROSS JOIN LATERAL (VALUES (CAST(d.doc_id % 7 + 1 AS VARCHAR), 1), ('12-A', 1), ('12-A', 2), (CAST(d.doc_id % 9 + 1 AS VARCHAR), 2), ('25', 3)) v(article, item)
""")


def repair_tables(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    kind, base = F.col("doc_id") % 6, F.concat("text", F.lit(" Art. "), F.col("doc_id") % 7 + 1, F.lit("º fim"))
    new = (
        F.when(kind == 0, F.concat(base, F.lit(" Artigo 12-A e Art. 0"), F.col("doc_id") % 9 + 1, F.lit(" extra")))
        .when(kind == 1, F.substring("text", 1, 400))
        .when(kind == 2, F.lit(None))
        .when(kind == 3, F.concat("text", F.lit("�")))
        .when(kind == 4, F.concat(F.lit("outro documento sem relação alguma "), "doc_id"))
        .otherwise(F.concat("text", F.lit(" mais palavras Art. 250.")))
    )
    name = F.col("doc_id").cast("string").alias("source_doc")
    url = F.when(F.col("doc_id") % 11 == 0, None).otherwise(F.concat(F.lit("https://example.org/"), "doc_id"))
    documents = d.select(name, base.alias("text"))
    replacements = d.select(name, new.alias("new_text"), url.alias("url"))
    listed = F.array(
        (F.col("doc_id") % 7 + 1).cast("string"), F.lit("12-A"), F.lit("12-A"),
        (F.col("doc_id") % 9 + 1).cast("string"), F.lit("25"),
    )
    expected = d.select(name, F.explode(listed).alias("anchor"))
    return documents, replacements, expected


def _runs(ws: str, n: int) -> str:
    return f"list_transform(range(1, len({ws}) - {n} + 2), lambda i: array_to_string({ws}[i:i + {n} - 1], ' '))"


cte("fx_shared", f"""
SELECT source_doc, CASE WHEN new_text IS NULL THEN NULL WHEN len(o) = 0 THEN false
     WHEN len(o) >= 15 THEN list_has_any({_runs('o', 15)}, {_runs('n', 15)})
     ELSE list_contains(list_transform(range(1, len(n) - len(o) + 2), lambda i: array_to_string(n[i:i + len(o) - 1], ' ')), array_to_string(o, ' ')) END AS shared
FROM (SELECT source_doc, new_text, {words_sql('original')} AS o, {words_sql("coalesce(new_text, '')")} AS n FROM fx_repair)
""")


@query("shared_run", with_ctes("SELECT source_doc, shared FROM fx_shared"))
def shared_run(spark, sf_dir):
    documents, replacements, _ = repair_tables(spark, sf_dir)
    both = documents.join(replacements, "source_doc")
    return both.select(
        "source_doc",
        F.when(F.col("new_text").isNotNull(), tx.shared_run(F.col("text"), F.col("new_text"))).alias("shared"),
    )


def _match(text: str, article: str) -> str:
    return f"regexp_matches({text}, '(?i)art(igo)?\\.?\\s*0*' || {article} || '($|[^0-9])')"


@query("repair_audit", with_ctes(f"""
SELECT r.source_doc, r.status, r.words_before, CAST(CASE WHEN r.status = 'SEM_FONTE' THEN r.words_before ELSE r.words_new END AS INTEGER) AS words_after,
       r.status IN ('REPARADO', 'SEM_GANHO') AS shared, e.total AS n_articles, e.before AS articles_before,
       CASE WHEN r.status = 'REPARADO' THEN e.after ELSE e.before END AS articles_after,
       CASE WHEN r.status = 'REPARADO' THEN e.gained ELSE 0 END AS pairs_gained
FROM (
  SELECT source_doc, words_before, words_new, CASE WHEN url IS NULL THEN 'SEM_FONTE'
         WHEN new_text IS NULL OR contains(new_text, chr(65533)) OR NOT shared THEN 'FALHA'
         WHEN words_new <= words_before THEN 'SEM_GANHO' ELSE 'REPARADO' END AS status
  FROM (SELECT f.source_doc, f.url, f.new_text, s.shared, CAST(len({words_sql('f.original')}) AS INTEGER) AS words_before,
               len({words_sql("coalesce(f.new_text, '')")}) AS words_new FROM fx_repair f JOIN fx_shared s USING (source_doc))) r
JOIN (
  SELECT source_doc, count(DISTINCT article) AS total, count(DISTINCT CASE WHEN a THEN article END) AS before,
         count(DISTINCT CASE WHEN b THEN article END) AS after, count(*) FILTER (WHERE b AND NOT a) AS gained
  FROM (SELECT e.source_doc, e.article, {_match('f.original', 'e.article')} AS a, {_match("coalesce(f.new_text, '')", 'e.article')} AS b
        FROM fx_repair_expected e JOIN fx_repair f USING (source_doc)) GROUP BY 1) e USING (source_doc)"""))
def repair_audit(spark, sf_dir):
    from quorate.operators.repair import repair_audit as audit

    return audit(*repair_tables(spark, sf_dir))


@query("repaired_corpus", with_ctes(f"""
SELECT count(*) AS n, count(*) FILTER (WHERE ok) AS n_repaired, CAST(sum(length(CASE WHEN ok THEN new_text ELSE original END)) AS BIGINT) AS n_chars
FROM (SELECT f.*, url IS NOT NULL AND new_text IS NOT NULL AND NOT contains(coalesce(new_text, ''), chr(65533)) AND coalesce(shared, false)
      AND len({words_sql("coalesce(new_text, '')")}) > len({words_sql('original')}) AS ok FROM fx_repair f JOIN fx_shared USING (source_doc))"""))
def repaired_corpus(spark, sf_dir):
    from quorate.operators.repair import repaired_documents

    fixed = repaired_documents(*repair_tables(spark, sf_dir))
    return fixed.agg(
        F.count("*").alias("n"), F.count_if("repaired").alias("n_repaired"), F.sum(F.length("text").cast("bigint")).alias("n_chars")
    )


@query("article_anchors", with_ctes(f"""
SELECT source_doc, article AS anchor, {_match('original', 'article')} AS matched
FROM fx_repair JOIN (SELECT DISTINCT source_doc, article FROM fx_repair_expected) USING (source_doc)"""))
def article_anchors(spark, sf_dir):
    documents, _, expected = repair_tables(spark, sf_dir)
    chunks = documents.withColumn("chunk_id", F.col("source_doc"))
    hits = ev.anchor_hits(chunks, expected).select("source_doc", "anchor", F.lit(True).alias("_m"))
    return expected.distinct().join(hits, ["source_doc", "anchor"], "left").select(
        "source_doc", "anchor", F.col("_m").isNotNull().alias("matched")
    )


@query("reachability", with_ctes(f"""
SELECT count(*) AS n_pairs, count(*) FILTER (WHERE a) AS before, count(*) FILTER (WHERE b) AS after,
       count(*) FILTER (WHERE b AND NOT a) AS gained, count(*) FILTER (WHERE a AND NOT b) AS lost
FROM (SELECT DISTINCT e.source_doc, e.article, {_match('f.original', 'e.article')} AS a, {_match("coalesce(f.new_text, '')", 'e.article')} AS b
      FROM fx_repair_expected e JOIN fx_repair f USING (source_doc))"""))
def reachability(spark, sf_dir):
    documents, replacements, expected = repair_tables(spark, sf_dir)
    old = documents.withColumn("chunk_id", F.col("source_doc"))
    new = replacements.select("source_doc", F.coalesce("new_text", F.lit("")).alias("text")).withColumn(
        "chunk_id", F.col("source_doc")
    )
    pairs = expected.withColumn("item_id", F.lit(0))
    return ev.reachability(pairs, ev.anchor_hits(old, expected), ev.anchor_hits(new, expected))


@query("normalise_article", with_ctes("""
SELECT l_orderkey, l_linenumber, upper(regexp_replace(trim(translate(a, 'ºª', 'oa')), '[o°.]+$', '')) AS article
FROM (SELECT DISTINCT l_orderkey, l_linenumber, CASE l_partkey % 4 WHEN 0 THEN ' ' || l_suppkey || 'º ' WHEN 1 THEN l_suppkey || '-a'
      WHEN 2 THEN l_suppkey || '°.' ELSE 'art' || l_suppkey || 'o' END AS a FROM lineitem)"""))
def normalise_article(spark, sf_dir):
    lines, k, n = fx.table(spark, sf_dir, "lineitem"), F.col("l_partkey") % 4, F.col("l_suppkey")
    raw = (
        F.when(k == 0, F.concat(F.lit(" "), n, F.lit("º ")))
        .when(k == 1, F.concat(n, F.lit("-a")))
        .when(k == 2, F.concat(n, F.lit("°.")))
        .otherwise(F.concat(F.lit("art"), n, F.lit("o")))
    )
    rows = lines.select("l_orderkey", "l_linenumber", raw.alias("a")).distinct()
    return rows.select("l_orderkey", "l_linenumber", tx.normalise_article(F.col("a")).alias("article"))


# Model outputs -----------------------------------------------------------------------------------------

cte("fx_outputs", """
SELECT doc_id, CASE doc_id % 7
  WHEN 0 THEN '{"resposta": "texto ' || doc_id || '", "confianca": 0.' || (doc_id % 10) || '}'
  WHEN 1 THEN '```json' || chr(10) || '{"Resposta": "cercado", "CONFIANÇA": 0.5}' || chr(10) || '```'
  WHEN 2 THEN 'Segue a resposta: {"resposta": "livre", "confiança": "0.25"} obrigado'
  WHEN 3 THEN '{"resposta": "cortada ' || lang
  WHEN 4 THEN '{"resposta": "alta", "confianca": 1.5}'
  WHEN 5 THEN '{"resposta": "sem nota"}'
  ELSE 'nada' END AS raw
FROM documents
""")


@query("json_answer_parse", r6("""
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS valid_json,
  CASE doc_id % 7 WHEN 0 THEN regexp_extract(raw, '"resposta": "([^"]*)"', 1) WHEN 1 THEN 'cercado' WHEN 2 THEN 'livre' END AS response_text,
  CASE doc_id % 7 WHEN 0 THEN CAST(regexp_extract(raw, '"confianca": ([0-9.]+)', 1) AS DOUBLE) WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 END AS confidence_raw
FROM fx_outputs""", "confidence_raw"))
def json_answer_parse(spark, sf_dir):
    d, k = fx.table(spark, sf_dir, "documents"), F.col("doc_id") % 7
    raw = (
        F.when(k == 0, F.concat(F.lit('{"resposta": "texto '), "doc_id", F.lit('", "confianca": 0.'), F.col("doc_id") % 10, F.lit("}")))
        .when(k == 1, F.lit('```json\n{"Resposta": "cercado", "CONFIANÇA": 0.5}\n```'))
        .when(k == 2, F.lit('Segue a resposta: {"resposta": "livre", "confiança": "0.25"} obrigado'))
        .when(k == 3, F.concat(F.lit('{"resposta": "cortada '), "lang"))
        .when(k == 4, F.lit('{"resposta": "alta", "confianca": 1.5}'))
        .when(k == 5, F.lit('{"resposta": "sem nota"}'))
        .otherwise(F.lit("nada"))
    )
    return d.select("doc_id", tx.answer_fields(raw).alias("a")).select("doc_id", "a.*")


@query("verdict_parse", with_ctes("""
SELECT doc_id, CAST(CASE doc_id % 5 WHEN 0 THEN doc_id % 3 WHEN 1 THEN 2 WHEN 2 THEN doc_id % 3 ELSE -1 END AS INTEGER) AS verdict,
  CASE doc_id % 5 WHEN 0 THEN 'ok ' || lang WHEN 1 THEN 'cercado' WHEN 2 THEN 'cortado em ' || lang
    WHEN 3 THEN 'fora' ELSE 'sem json ' || source END AS reasoning FROM documents"""))
def verdict_parse(spark, sf_dir):
    d, k = fx.table(spark, sf_dir, "documents"), F.col("doc_id") % 5
    n = F.col("doc_id") % 3
    raw = (
        F.when(k == 0, F.concat(F.lit('{"raciocinio": "ok '), "lang", F.lit('", "veredicto": '), n, F.lit("}")))
        .when(k == 1, F.lit('```json\n{"raciocinio": "cercado", "veredicto": 2}\n```'))
        .when(k == 2, F.concat(F.lit('{"veredicto": '), n, F.lit(', "raciocinio": "cortado em '), "lang"))
        .when(k == 3, F.lit('{"veredicto": 7, "raciocinio": "fora"}'))
        .otherwise(F.concat(F.lit("sem json "), "source"))
    )
    return d.select("doc_id", tx.verdict_fields(raw).alias("v")).select("doc_id", "v.*")
