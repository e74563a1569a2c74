"""Retrieval quality at document and passage level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from quorate.functions import constants as C
from quorate.functions import text as tx


def document_of(chunk_id: Column) -> Column:
    return F.substring_index(chunk_id, "#", 1)


def document_recall(served: DataFrame, expected: DataFrame, items: DataFrame) -> DataFrame:
    """Share of an item's expected documents among its served ones.

    ``served`` has item_id and chunk_id, ``expected`` distinct (item_id, source_doc).  Null without
    expected documents or for an item that was not run (absent from ``items``), 0 if nothing came.
    """
    docs = served.select("item_id", document_of(F.col("chunk_id")).alias("source_doc")).distinct()
    hits = expected.join(docs.withColumn("_hit", F.lit(1)), ["item_id", "source_doc"], "left")
    per = hits.groupBy("item_id").agg(
        F.count("*").alias("n_expected"), F.count("_hit").alias("n_hits")
    )
    return items.select("item_id").join(per, "item_id", "left").select(
        "item_id",
        F.coalesce("n_expected", F.lit(0)).alias("n_expected"),
        (F.col("n_hits") / F.col("n_expected")).alias("document_recall"),
    )


def expected_from_ids(items: DataFrame) -> DataFrame:
    """(item_id, source_doc) of documents that were built from the item's own references."""

    def names(prefix: str, column: str) -> Column:
        numbers = F.sequence(F.lit(0), F.size(column) - 1)
        made = F.transform(
            numbers, lambda i: F.concat(F.lit(prefix), F.col("item_id"), F.format_string("_%02d", i))
        )
        return F.when(F.size(column) > 0, made).otherwise(F.array().cast("array<string>"))

    both = F.concat(names(C.PROVISION_PREFIX, "provisions"), names(C.RULING_PREFIX, "rulings"))
    return items.select("item_id", F.explode(both).alias("source_doc"))


def uses_synthetic_ids(chunks: DataFrame, share: float = 0.9) -> DataFrame:
    """One row: whether nearly all chunks come from documents with a synthetic prefix."""
    name = F.col("source_doc")
    synthetic = name.startswith(C.PROVISION_PREFIX) | name.startswith(C.RULING_PREFIX)
    return chunks.agg(F.avg(synthetic.cast("double")).alias("share")).select(
        "share", (F.col("share") >= share).alias("synthetic")
    )


def anchors(chunks: DataFrame) -> DataFrame:
    """(chunk_id, source_doc, anchor): article labels that each chunk's headings match."""
    return chunks.select(
        "chunk_id", "source_doc", F.explode(tx.article_anchors(F.col("text"))).alias("anchor")
    )


def anchor_hits(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """(chunk_id, source_doc, anchor) of expected anchors that a chunk of that document matches.

    Only chunks of expected documents are read for anchors.  Plain labels meet by equality on extracted anchors; labels with other characters meet by
    document and are tested by their own pattern.
    """
    pairs = expected.select("source_doc", "anchor").distinct()
    plain = F.col("anchor").rlike(tx.ANCHOR_CHARS)
    relevant = chunks.select("chunk_id", "source_doc", "text").join(
        pairs.where(plain).select("source_doc").distinct(), "source_doc", "left_semi"
    )
    equal = anchors(relevant).join(pairs.where(plain), ["source_doc", "anchor"])
    odd = (
        chunks.select("chunk_id", "source_doc", "text")
        .join(pairs.where(~plain), "source_doc")
        .where(F.rlike(F.col("text"), tx.article_pattern(F.col("anchor"))))
    )
    cols = ["chunk_id", "source_doc", "anchor"]
    return equal.select(*cols).unionByName(odd.select(*cols))


def literal_hits(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """The same for anchors that are literal passages of text."""
    pairs = expected.select("source_doc", "anchor").distinct()
    joined = chunks.select("chunk_id", "source_doc", "text").join(pairs, "source_doc")
    return joined.where(F.contains(F.col("text"), F.col("anchor"))).select("chunk_id", "source_doc", "anchor")


def passage_recall(
    served: DataFrame, expected: DataFrame, hits: DataFrame, keys: Sequence[str] = ("item_id",)
) -> DataFrame:
    """Per item: expected pairs, pairs whose file was served, pairs whose passage was served.

    ``keys`` may hold a configuration column besides the item, which is then last.
    """
    keys = list(keys)
    item = keys[-1]
    configs = [c for c in keys if c != item]
    slim = served.select(*keys, "chunk_id", "source_doc")
    files = slim.select(*keys, "source_doc").distinct().withColumn("_file", F.lit(1))
    found = (
        slim.join(hits, ["chunk_id", "source_doc"])
        .select(*keys, "source_doc", "anchor")
        .distinct()
        .withColumn("_passage", F.lit(1))
    )
    pairs = expected.select(item, "source_doc", "anchor").distinct()
    if configs:
        names = served.select(*configs).distinct()
        listed = names.agg(F.collect_set(F.struct(*configs))).scalar()
        pairs = pairs.withColumn("_c", F.explode(listed)).select("_c.*", item, "source_doc", "anchor")
    joined = pairs.join(files, [*keys, "source_doc"], "left").join(
        found, [*keys, "source_doc", "anchor"], "left"
    )
    n = F.count("*")
    return joined.groupBy(*keys).agg(
        n.alias("n_expected"),
        (F.count("_file") / n).alias("file_recall"),
        (F.count("_passage") / n).alias("passage_recall"),
    )


def ranked_documents(served: DataFrame, expected: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Recall@k, Hit@k and reciprocal rank per item over documents in first-seen order."""
    docs = served.groupBy("item_id", "source_doc").agg(F.min("combined_rank").alias("_first"))
    position = F.row_number().over(W.partitionBy("item_id").orderBy("_first"))
    placed = docs.withColumn("pos", position)
    want = expected.select("item_id", "source_doc").distinct()
    joined = want.join(placed, ["item_id", "source_doc"], "left")
    aggs = [F.count("*").alias("n_expected")]
    for k in ks:
        hit = F.col("pos") <= k
        aggs.append((F.count_if(hit) / F.count("*")).alias(f"recall_at_{k}"))
        aggs.append(F.max(F.when(hit, 1.0).otherwise(0.0)).alias(f"hit_at_{k}"))
    aggs.append(F.coalesce(F.max(F.lit(1.0) / F.col("pos")), F.lit(0.0)).alias("reciprocal_rank"))
    return joined.groupBy("item_id").agg(*aggs)


def oracle_ceiling(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """Expected pairs that some chunk of the index can match."""
    pairs = expected.select("item_id", "source_doc", "anchor").distinct()
    found = hits.select("source_doc", "anchor").distinct().withColumn("_hit", F.lit(1))
    joined = pairs.join(found, ["source_doc", "anchor"], "left")
    return joined.agg(
        F.count("*").alias("n_pairs"),
        F.count("_hit").alias("n_reachable"),
        (F.count("_hit") / F.count("*")).alias("ceiling"),
    )


def reachability(expected: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs reachable in two indexes, gained and lost."""
    pairs = expected.select("item_id", "source_doc", "anchor").distinct()
    keys = ["source_doc", "anchor"]
    a = before.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = after.select(*keys).distinct().withColumn("_b", F.lit(True))
    flags = pairs.join(a, keys, "left").join(b, keys, "left")
    was, now = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return flags.agg(
        F.count("*").alias("n_pairs"),
        F.count_if(was).alias("before"),
        F.count_if(now).alias("after"),
        F.count_if(~was & now).alias("gained"),
        F.count_if(was & ~now).alias("lost"),
    )


def retrieval_summary(
    per_item: DataFrame, served_size: DataFrame, group: Sequence[str] = ()
) -> DataFrame:
    """Means, hit rate, zero share, sizes and totals; ``served_size`` has chunks and words per item."""
    joined = per_item.join(served_size, [*group, "item_id"], "left")
    r = F.col("passage_recall")
    return joined.groupBy(*group).agg(
        F.count("*").alias("n_items"),
        F.sum("n_expected").alias("n_pairs"),
        F.avg(r).alias("passage_recall"),
        F.avg("file_recall").alias("file_recall"),
        F.avg((r > 0).cast("double")).alias("hit_rate"),
        F.avg((r == 0).cast("double")).alias("zero_share"),
        F.avg(F.coalesce("n_chunks", F.lit(0))).alias("n_chunks"),
        F.avg(F.coalesce("n_words", F.lit(0))).alias("n_words"),
    )


def inflation(per_item: DataFrame) -> DataFrame:
    """File recall over passage recall, and items with the right file but no passage."""
    right_file = (F.col("file_recall") > 0) & (F.col("passage_recall") == 0)
    return per_item.agg(
        F.count("*").alias("n_items"),
        F.try_divide(F.avg("file_recall"), F.avg("passage_recall")).alias("inflation"),
        F.count_if(right_file).alias("n_file_without_passage"),
    )


def rescore_difference(ours: DataFrame, stored: DataFrame, column: str) -> DataFrame:
    """Largest absolute difference between recomputed and stored values, and items on one side."""
    b = stored.select("item_id", F.col(column).alias("_stored"), F.lit(True).alias("_r"))
    a = ours.select("item_id", F.col(column).alias("_ours"), F.lit(True).alias("_l"))
    return a.join(b, "item_id", "full").agg(
        F.count("*").alias("n"),
        F.max(F.abs(F.col("_ours") - F.col("_stored"))).alias("max_abs_difference"),
        F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("n_unmatched"),
    )


def threshold_histogram(per_item: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Items whose passage recall reaches each threshold."""
    listed = F.array(*[F.lit(float(t)) for t in thresholds])
    rows = per_item.select("passage_recall", F.explode(listed).alias("threshold"))
    return rows.groupBy("threshold").agg(
        F.count_if(F.col("passage_recall") >= F.col("threshold")).alias("n")
    )


def served_from_responses(responses: DataFrame) -> DataFrame:
    """(item_id, combined_rank, chunk_id) of stored responses with arrays of chunk ids."""
    return responses.select(
        "item_id", F.posexplode("retrieved_chunk_ids").alias("_p", "chunk_id")
    ).select("item_id", (F.col("_p") + 1).alias("combined_rank"), "chunk_id")


def unknown_chunks(served: DataFrame, chunks: DataFrame) -> DataFrame:
    """Gate: served chunk ids that the index does not hold."""
    return served.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("item_id", "chunk_id")


def served_context(served: DataFrame, chunks: DataFrame) -> DataFrame:
    """Served chunks with their text and document."""
    return served.join(chunks.select("chunk_id", "source_doc", "text"), "chunk_id")


def paired_recall(old: DataFrame, new: DataFrame) -> DataFrame:
    """Recalls of two pipelines per item; expected counts must be equal on both sides."""
    a = old.select(
        "item_id",
        F.col("n_expected").alias("_n"),
        F.col("file_recall").alias("old_file"),
        F.col("passage_recall").alias("old_passage"),
    )
    b = new.select(
        "item_id",
        "n_expected",
        F.col("file_recall").alias("new_file"),
        F.col("passage_recall").alias("new_passage"),
    )
    same = F.assert_true(F.col("_n") == F.col("n_expected"), "expected counts differ between the sides")
    return b.join(a, "item_id").where(same.isNull()).drop("_n")
