"""Registered queries of this package and the SQL that checks them.

Every query applies its operator with production parameters to the whole of its table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.llm import (
    byte_convnet,
    chat_layouts,
    contiguous_shards,
    host_words,
    max_sketches,
    monotone_packing,
    multi_index_hashing,
    simhash_trie,
    speculative_bpe,
    template_tree,
    training_order,
    veb_manifest,
    winnowing,
)
from quorate.llm.common import documents
from quorate.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op5_simhash_trie")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = simhash_trie.near_duplicates(documents(spark, sf_dir))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query(
    "op3_winnowing",
    r"""
    WITH item_words AS (
        SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
    ), windows AS (
        SELECT DISTINCT item_id, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS g
        FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)
    ), doc_words AS (
        SELECT row_number() OVER () AS r, doc_id,
               coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
        FROM documents
    ), grams AS (
        SELECT r, i, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS g
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
    ), found AS (
        SELECT r, i, n, item_id FROM grams JOIN windows USING (n, g)
    ), words_hit AS (
        SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r
    ), items_hit AS (
        SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r
    )
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM doc_words LEFT JOIN words_hit USING (r) LEFT JOIN items_hit USING (r)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in windows of benchmark items."""
    found = winnowing.overlap(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    joined = F.array_join("items", ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), "contaminated"
    )


@query(
    "op8_template_tree",
    r"""
    WITH lines AS (
        SELECT doc_id, text, i - 1 AS line, string_split(text, chr(10))[i] AS content
        FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
    ), parsed AS (
        SELECT doc_id, text, line, list_transform(list_filter(regexp_split_to_array(content, '[ \t-\r]+'), lambda t: t <> ''),
            lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS t
        FROM lines
    ), leaves AS (
        SELECT doc_id, text, line, k, len(t) AS n,
               list_aggregate(t[1 : 3 + ((len(t) - 3) * k) // 4], 'string_agg', ' ') AS before,
               coalesce(list_aggregate(t[4 + ((len(t) - 3) * (k + 1)) // 4 :], 'string_agg', ' '), '') AS after
        FROM parsed, (SELECT unnest(range(0, 4)) AS k) WHERE len(t) >= 6
    ), recurring AS (
        SELECT k, n, before, after, min(doc_id) AS first FROM leaves GROUP BY ALL HAVING count(DISTINCT doc_id) > 1
    ), gone AS (
        SELECT DISTINCT l.doc_id, l.text, l.line FROM leaves l JOIN recurring r USING (k, n, before, after) WHERE l.doc_id > r.first
    ), kept AS (
        SELECT l.doc_id, l.text, count(*) AS n_lines, count(g.line) AS n_dropped,
               coalesce(string_agg(CASE WHEN g.line IS NULL THEN content END, chr(10) ORDER BY l.line), '') AS rest
        FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.text = g.text AND l.line = g.line GROUP BY l.doc_id, l.text
    )
    SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(rest) AS text_sha256
    FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents whose template recurs, and a digest of what stays."""
    out, n_lines, dropped = template_tree.without_repeats(documents(spark, sf_dir))
    return out.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(dropped).alias("n_dropped"), F.sha2("text", 256).alias("text_sha256"))


@query("op2_byte_convnet")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; held-out rows teach nothing."""
    docs = documents(spark, sf_dir)
    net = byte_convnet.train(docs, documents(spark, sf_dir, "labels"))
    scored = byte_convnet.with_scores(docs, net)
    predicted = (F.col("score") >= byte_convnet.THRESHOLD).cast("int")
    return scored.select("doc_id", byte_convnet.held_out().alias("held_out"), "score", predicted.alias("predicted"))


@query("op9_speculative_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded, as digests."""
    coded = speculative_bpe.encode_texts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


@query("op1_host_words")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by rules and host words."""
    pages = documents(spark, sf_dir, "pages").select("page_id", "url", "html")
    return host_words.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")


CONTROL = "</s>[INST] ok [/INST]"


@query(
    "op4_chat_layouts",
    r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), escaped AS (
        SELECT *, replace(replace(replace(replace(role, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>') AS r,
               replace(replace(replace(replace(text, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>') AS t
        FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length('[INST]' || r || '[/INST]' || chr(10) || t || '</s>' || chr(10))) AS BIGINT) AS formatted_chars
    FROM escaped GROUP BY conv_id
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    given = chat_layouts.turn_rows(documents(spark, sf_dir, "conversations"), "conv_id")
    odd = spark.sql(f"SELECT -1L AS conv_id, to_json(named_struct('prompt', '{CONTROL}', 'completion', '{CONTROL}')) AS record")
    turns = given.unionByName(chat_layouts.turn_rows(odd, "conv_id", "record")).where("layout_known")
    back = chat_layouts.read_back(chat_layouts.format_turns(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        F.col("key").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


@query("op6_multi_index_hashing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty neighbours of every twentieth vector among all vectors."""
    return multi_index_hashing.search(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query("op10_contiguous_shards")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes, copies of a text together."""
    check = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = documents(spark, sf_dir).select("doc_id", "text", check.alias("text_crc32"))
    placed = contiguous_shards.assign_shards(rows, 16, ("doc_id", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


TRAINING_KEY = 20_260_701


@query("op7_training_order")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte ids in training order: the records read back from the shards, as digests."""
    found, layout = training_order.records(documents(spark, sf_dir), TRAINING_KEY)
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    training_order.write_shards(found, layout, folder)
    back = training_order.read_shards(spark, layout, folder)
    return back.select("slot", "shard", "n_tokens", F.sha2("record", 256).alias("record_sha256"))


@query("op11_monotone_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    pieces = monotone_packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select(
        "doc_id", "start", monotone_packing.token_count().alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@query(
    "op12_veb_manifest",
    r"""
    WITH RECURSIVE rows AS (
        SELECT doc_id, lang, sha256(concat(
                coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
                coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-'),
                coalesce(octet_length(encode(text)) || ':' || text, '-'))) AS leaf,
            sha256(concat(
                coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
                coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) || ':' || (n_chars + 1), '-'),
                coalesce(octet_length(encode(text)) || ':' || text, '-'))) AS changed
        FROM documents
    ), table_of_bytes AS (
        SELECT range AS c0, range AS b FROM range(256)
    ), crc_steps AS (
        SELECT b, 0 AS k, CAST(b AS BIGINT) AS c FROM table_of_bytes
        UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8
    ), crc_table AS (
        SELECT b, c FROM crc_steps WHERE k = 8
    ), ids AS (
        SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL
    ), crc AS (
        SELECT doc_id, s, 1 AS i, CAST(4294967295 AS BIGINT) AS c FROM ids
        UNION ALL SELECT doc_id, s, i + 1, xor(crc.c >> 8, t.c) FROM crc JOIN crc_table t ON t.b = xor(crc.c & 255, ascii(s[i])) WHERE i <= len(s)
    ), tampered AS (
        SELECT doc_id, xor(c, 4294967295) % 7 = 0 AS hit FROM crc WHERE i = len(s) + 1
    ), leaves AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n,
               coalesce('l' || lang, '') AS tree, row_number() OVER () AS r
        FROM rows
    ), lower_nodes AS (
        SELECT tree, 0 AS level, place AS i, n, leaf AS h FROM leaves
        UNION ALL SELECT tree, level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM lower_nodes WHERE n > 1 GROUP BY tree, level, i // 2
    ), subroots AS (
        SELECT tree, level AS height, h, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM lower_nodes WHERE n = 1
    ), upper_nodes AS (
        SELECT 0 AS level, place AS i, n, h FROM subroots
        UNION ALL SELECT level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM upper_nodes WHERE n > 1 GROUP BY level, i // 2
    ), steps AS (
        SELECT r, l.tree, k.level AS level, l.place >> k.level AS i, s.h AS sibling
        FROM leaves l JOIN (SELECT DISTINCT tree, level FROM lower_nodes WHERE n > 1) k USING (tree)
        LEFT JOIN lower_nodes s ON s.tree = l.tree AND s.level = k.level AND s.i = xor(l.place >> k.level, 1)
        UNION ALL
        SELECT r, l.tree, u.height + k.level, u.place >> k.level, s.h
        FROM leaves l JOIN subroots u USING (tree) JOIN (SELECT DISTINCT level FROM upper_nodes WHERE n > 1) k ON true
        LEFT JOIN upper_nodes s ON s.level = k.level AND s.i = xor(u.place >> k.level, 1)
    ), walk AS (
        SELECT r, 0 AS level, CASE WHEN hit THEN changed ELSE leaf END AS h FROM leaves LEFT JOIN tampered USING (doc_id)
        UNION ALL
        SELECT w.r, w.level + 1, sha256(CASE WHEN s.i % 2 = 1 THEN s.sibling || w.h ELSE w.h || coalesce(s.sibling, '') END)
        FROM walk w JOIN steps s ON s.r = w.r AND s.level = w.level
    ), proofs AS (
        SELECT r, string_agg(sibling, '' ORDER BY level) AS p FROM steps GROUP BY r
    ), ends AS (
        SELECT r, arg_max(h, level) AS h FROM walk GROUP BY r
    )
    SELECT l.doc_id, l.leaf, u.h AS subroot, t.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
    FROM leaves l JOIN subroots u USING (tree) JOIN ends e USING (r) LEFT JOIN proofs p USING (r) JOIN (SELECT h FROM upper_nodes WHERE n = 1) t ON true
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash trees over all documents, and every document's proof, of which some are tampered with."""
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    carry = {"doc_id": F.col("doc_id"), "tampered": F.when(hit, F.lower(F.hex(veb_manifest.digest(*changed))))}
    made = veb_manifest.manifest(documents(spark, sf_dir), FIELDS, carry=carry)
    root = F.lit(made.root).cast("string")
    ends = made.proofs().withColumn("folded_root", veb_manifest.folded(F.coalesce("tampered", "leaf")))
    return ends.select(
        "doc_id", "leaf", "subroot", root.alias("root"), F.sha2(veb_manifest.proof_text(), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == root).alias("verified"),
    )


@query(
    "op13_max_sketches",
    r"""
    WITH words AS (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
        FROM documents
    ), docs AS (
        SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0
    ), total AS (
        SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM docs
    ), postings AS (
        SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM docs) GROUP BY r, t
    ), weights AS (
        SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM postings, total GROUP BY t, n_docs
    ), lengths AS (
        SELECT r, doc_id, 100 - 90 + ((90 * n * n_docs) // l) AS m FROM docs, total
    ), item_terms AS (
        SELECT DISTINCT item_id, t FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
            FROM benchmark WHERE item_id IS NOT NULL)
    ), scores AS (
        SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
        FROM item_terms JOIN weights USING (t) JOIN postings USING (t) JOIN lengths USING (r) WHERE doc_id IS NOT NULL GROUP BY item_id, r, doc_id
    )
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for each benchmark item."""
    return max_sketches.search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
