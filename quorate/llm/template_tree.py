"""Line dedup by a tree of line templates, as log parsers build them; DataFrame functions only.

The tree has a fixed depth: the token count of a line, then its leading tokens, then the rest cut into
a fixed number of runs of tokens. Tokens with a digit are variable fields from the start. A leaf is
reached by leaving one run out, so lines of one leaf agree in everything but the fields of that run:
the template is the line with these fields generalised. A line has one leaf per run.

A template that occurs in more than one document recurs. The document with the smallest id keeps its
lines, later documents lose theirs, so each content stays once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import fresh, materialise

LEADING = 3
RUNS = 4
# Shorter lines are too common by chance to count as templates.
MIN_TOKENS = 6

TOKEN_BREAK = r"[ \x09-\x0D]+"


def _tokens(line: Column) -> Column:
    words = F.filter(F.split(line, TOKEN_BREAK), lambda t: t != "")
    return F.transform(words, lambda t: F.when(F.regexp_like(t, F.lit("[0-9]")), F.lit("<*>")).otherwise(t))


def line_templates(docs: DataFrame) -> DataFrame:
    """(doc_id, h, line, leaves) for every line long enough; ``h`` is the hash of the whole text."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    parsed = lines.select("doc_id", "h", "line", _tokens(F.col("content")).alias("t")).where(F.size("t") >= MIN_TOKENS)
    rest = F.size("t") - LEADING
    edge = [F.floor(rest * i / RUNS).cast("int") + LEADING for i in range(RUNS + 1)]
    parts = [F.xxhash64(F.slice("t", edge[i] + 1, edge[i + 1] - edge[i])).alias(f"s{i}") for i in range(RUNS)]
    cut = parsed.select("doc_id", "h", "line", F.size("t").alias("n"), F.xxhash64(F.slice("t", 1, LEADING)).alias("lead"), *parts)

    def leaf(i: int) -> Column:
        path = [F.lit(i), F.col("n"), F.col("lead"), *[F.col(f"s{j}") for j in range(RUNS) if j != i]]
        # 96 bits of the path: one hash alone would meet by chance at cluster scale.
        return F.struct(F.xxhash64(*path).alias("a"), F.hash(*path).alias("b"))

    return cut.select("doc_id", "h", "line", F.array(*[leaf(i) for i in range(RUNS)]).alias("leaves"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, lines): the lines (from 0) of each distinct (doc_id, text) whose template an earlier document has.

    A line counts if any of its leaves is shared. Rows without doc_id come after all others and do not
    make each other's lines repeat.
    """
    parsed = materialise(line_templates(docs)).select("doc_id", "h", "line", F.explode("leaves").alias("leaf"))
    parsed = parsed.select("doc_id", "h", "line", "leaf.a", "leaf.b")
    # A hot template is a counted key: only its extremes are kept, combined before the shuffle.
    spread = parsed.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nameless"))
    recurring = spread.where("first < last or (first is not null and nameless > 0)").select("a", "b", "first")
    later = parsed.join(recurring, ["a", "b"]).where("doc_id > first or doc_id is null")
    return later.groupBy("doc_id", "h").agg(F.collect_set("line").alias("lines"))


def without_repeats(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with the repeated lines taken out of ``text``, and the names of two added columns: lines before, lines dropped.

    Null texts stay null; a text none of whose lines repeats is unchanged; a text of repeated lines only
    becomes empty. Repeated rows are treated alike. All other columns are untouched.
    """
    cut, key, n_lines, dropped, gone, gone_id, gone_key = fresh(docs, "line_list", "text_key", "n_lines", "n_dropped", "lines_gone", "gone_id", "gone_key")
    found = repeated_lines(docs).select(F.col("doc_id").alias(gone_id), F.col("h").alias(gone_key), F.col("lines").alias(gone))
    # Lines are cut below the join, so that the choice of kept lines reads them from the row.
    lined = docs.withColumn(key, F.xxhash64("text")).withColumn(cut, F.split("text", "\n")).drop("text")
    same = lined["doc_id"].eqNullSafe(found[gone_id]) & (lined[key] == found[gone_key])
    joined = lined.join(found, same, "left")
    every = F.sequence(F.lit(0), F.size(cut) - 1)
    kept = F.when(F.col(gone).isNull(), F.col(cut)).otherwise(F.transform(F.array_except(every, F.col(gone)), lambda i: F.get(F.col(cut), i)))
    text = F.when(F.col(cut).isNotNull(), F.array_join(kept, "\n")).alias("text")
    size = F.when(F.col(cut).isNotNull(), F.size(cut)).otherwise(0)
    columns = [text if c == "text" else F.col(c) for c in docs.columns]
    out = joined.select(*columns, size.cast("bigint").alias(n_lines), F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias(dropped))
    return out, n_lines, dropped


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines; a document left without any text by that goes."""
    out, _, dropped = without_repeats(docs)
    return out.where((F.col(dropped) == 0) | F.col("text").rlike(r"\S")).select(*docs.columns)
