"""Input tables of the operators, derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.operators.folds import assign_folds, fold_roles
from quorate.operators.panel import complete_grid, usable_confidence
from quorate.session import materialise

AGENTS = [1, 2, 3]
C_MINS = [0.5, 0.7, 0.9]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), (F.col("o_orderstatus") != "P").alias("has_doc_ref")
    )


def panel(spark: SparkSession, sf_dir: str, first_line: int = 1, last_line: int = 7) -> DataFrame:
    """Every order as an item; its lines are dealt to three agents by line number, all seven by default.

    A narrower range of lines stands for one of several pipelines that are compared.
    """
    agent = (F.col("l_linenumber") - first_line) % 3 + 1
    lines = (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_linenumber").between(first_line, last_line))
        .groupBy(F.col("l_orderkey").alias("item_id"), agent.alias("agent_id"))
        .agg(
            F.round(F.max("l_discount") * 10, 1).alias("conf_raw"),
            F.max((F.col("l_linestatus") == "F").cast("int")).alias("z"),
            F.max((F.col("l_returnflag") == "N").cast("int")).alias("flag_n"),
        )
    )
    grid = complete_grid(items(spark, sf_dir), AGENTS, lines, {"z": 0})
    conf = F.col("conf_raw")
    return grid.select(
        "item_id",
        "agent_id",
        "has_doc_ref",
        "conf_raw",
        conf.isNotNull().alias("valid_json"),
        "z",
        usable_confidence(conf).alias("conf"),
        F.coalesce((F.col("flag_n") == 1) & (conf < 0.3), F.lit(False)).alias("refused"),
    )


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_folds(items(spark, sf_dir), "has_doc_ref")


def roles(spark: SparkSession) -> DataFrame:
    return fold_roles(spark)


def folded_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel with folds, written once: weights, calibrators and test rows all read it."""
    return materialise(
        panel(spark, sf_dir).join(folds(spark, sf_dir).select("item_id", "fold_k"), "item_id")
    )


def sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"),
        F.when(code.isin("1", "2"), 2).when(code.isin("3", "4"), 1).otherwise(0).alias("verdict"),
    )


def refusal_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).where("refused").select(
        "item_id", "agent_id", F.when(F.col("agent_id") % 2 == 1, 2).otherwise(1).alias("refusal_verdict")
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in load order; English sources play the norms, the others the rulings."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        F.col("doc_id").alias("load_order"),
        F.when(F.col("lang") == "en", "norm").otherwise("ruling").alias("source_type"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 64 words with an overlap of 8; the documents have single line breaks only."""
    from quorate.operators.chunking import chunk_documents

    return chunk_documents(corpus(spark, sf_dir), 64, 8, "\n")


def written_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written once: postings, statistics, hits and fill rows all read them."""
    return materialise(chunks(spark, sf_dir))


def lexical_index(chunk_table: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    from quorate.operators import retrieval as rt

    return materialise(rt.lexical_index(chunk_table, group))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole benchmark passage as a query."""
    from quorate.functions.text import words

    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.array_join(words(F.col("text")), " ").alias("text")
    )


# Words of a passage by which documents are looked up before the whole passage is tested.
LOOKUP_WORDS = 6


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, source_doc, anchor): documents that contain a passage; the anchor is the passage.

    A passage may start or end inside a word of the document, so the look-up uses words inside it: up
    to LOOKUP_WORDS of them, fewer for a short passage. Documents meet passages by equality on runs
    whose first word is one of the passages' (tested in the scan, so few runs are made), then the whole
    passage is tested. Passages of one or two words have no inner word and are refused.
    """
    from quorate.functions import text as tx
    from quorate.session import broadcast_if_small, spread

    inner = F.least(F.size("w") - 2, F.lit(LOOKUP_WORDS))
    passages = table(spark, sf_dir, "benchmark").select(
        "item_id", F.col("text").alias("passage"), tx.words(F.col("text")).alias("w")
    )
    passages = passages.select("item_id", "passage", inner.alias("n"), F.array_join(F.slice("w", 2, F.greatest(inner, F.lit(0))), " ").alias("run"))
    # At most LOOKUP_WORDS values above zero.
    lengths = sorted(r.n for r in passages.select("n").distinct().collect())
    if lengths and lengths[0] < 1:
        raise ValueError("a passage needs at least three words")
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    side = broadcast_if_small(passages)
    found = None
    for n in lengths:
        runs = documents.select("doc_id", F.explode(F.array_distinct(tx.word_runs(tx.spaced(F.col("text")), n))).alias("run"))
        one = runs.join(side.where(F.col("n") == n), "run").select("doc_id", "item_id", "passage")
        found = one if found is None else found.unionByName(one)
    return (
        found.distinct().join(documents, "doc_id")
        .where(F.contains(F.col("text"), F.col("passage")))
        .select("item_id", F.col("doc_id").cast("string").alias("source_doc"), F.col("passage").alias("anchor"))
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, source_doc, load_order, source_type, embedding) from the embeddings table."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.format_string("v%06d", v).alias("chunk_id"),
        (v % 50).cast("string").alias("source_doc"),
        v.alias("load_order"),
        F.when(F.col("label") < 5, "norm").otherwise("ruling").alias("source_type"),
        "embedding",
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector asks for its neighbours, under its own number."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def chunk_vectors(chunks: DataFrame, dim: int = 16) -> DataFrame:
    """Hashed bag-of-terms vectors of unit length, standing in for an embedding model's table."""
    from quorate.functions.text import tokens

    return _hashed(chunks.select("chunk_id", "load_order", tokens(F.col("text")).alias("_t")), dim)


def query_vectors(queries: DataFrame, dim: int = 16) -> DataFrame:
    from quorate.functions.text import tokens

    return _hashed(queries.select("query_id", tokens(F.col("text")).alias("_t")), dim)


def _hashed(df: DataFrame, dim: int) -> DataFrame:
    slot = lambda t: F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("bigint") % dim
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.size(F.filter("_s", lambda s: s == i)).cast("double"),
    )
    named = df.withColumn("_s", F.transform("_t", slot)).withColumn("_c", counts)
    norm = F.sqrt(F.aggregate("_c", F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform("_c", lambda x: F.try_divide(x, F.col("_n")).cast("float"))
    out = named.withColumn("_n", norm).withColumn("embedding", F.coalesce(F.when(F.col("_n") > 0, unit), F.transform("_c", lambda x: x.cast("float"))))
    return out.drop("_t", "_s", "_c", "_n")


def rerank_scores(pairs: DataFrame) -> DataFrame:
    """Given cross-encoder scores: a fixed function of the pair, in [0, 1)."""
    from quorate.functions.rand import draw_unit

    key = F.concat_ws("|", F.col("query_id").cast("string"), "chunk_id")
    return pairs.select("query_id", "chunk_id").distinct().withColumn("rerank_score", draw_unit(key, 11))
