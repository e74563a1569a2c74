"""Request tables for model services: rendered context, filled templates and cache keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions import constants as C
from quorate.functions.text import strip


def render_context(
    served: DataFrame, chunks: DataFrame, items: DataFrame, missing: str = "note"
) -> DataFrame:
    """(item_id, context): served chunks in rank order under numbered headers.

    A served chunk that is not in the index is noted, or skipped with ``missing="skip"``; an item
    without chunks gets the placeholder.  An item has as many parts as it was served chunks.
    """
    known = chunks.select("chunk_id", F.col("source_doc").alias("_doc"), F.col("text").alias("_text"))
    joined = served.select("item_id", "combined_rank", "chunk_id").join(known, "chunk_id", "left")
    if missing == "skip":
        joined = joined.where(F.col("_text").isNotNull())
    name = F.coalesce("_doc", "chunk_id")
    body = F.coalesce(strip(F.col("_text")), F.lit(C.MISSING_CHUNK))
    part = F.concat(F.format_string(C.CONTEXT_HEADER, F.col("combined_rank"), name), F.lit("\n"), body)
    parts = joined.groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.struct("combined_rank", part.alias("part")))).alias("_p")
    )
    text = F.array_join(F.col("_p.part"), "\n\n")
    return items.select("item_id").join(parts, "item_id", "left").select(
        "item_id", F.coalesce(F.nullif(text, F.lit("")), F.lit(C.EMPTY_CONTEXT)).alias("context")
    )


def fill_template(template: str, fields: dict[str, Column]) -> Column:
    """Template with ``{name}`` places filled from trimmed columns."""
    out = [F.lit("")]
    rest = template
    while rest:
        start = rest.find("{")
        if start < 0:
            out.append(F.lit(rest))
            break
        end = rest.index("}", start)
        out += [F.lit(rest[:start]), strip(fields[rest[start + 1 : end]])]
        rest = rest[end + 1 :]
    return F.concat(*out)


def numbered_list(texts: Column, title: str, empty: str) -> Column:
    """Texts under numbered titles, or a note when there are none."""
    parts = F.transform(
        texts, lambda t, i: F.concat(F.lit(f"{title} "), (i + 1).cast("string"), F.lit(":\n"), strip(t))
    )
    return F.when(F.size(texts) > 0, F.array_join(parts, "\n\n")).otherwise(F.lit(empty))


def request_key(
    system: Column, user: Column, model: str, temperature: float, max_tokens: int, effort: str | None = None
) -> Column:
    """SHA-256 over the canonical JSON (sorted keys, one blank after separators) of a request."""

    def quoted(text: Column) -> Column:
        return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")

    payload = F.concat(
        F.lit(f'{{"max_tokens": {max_tokens}, "model": '),
        quoted(F.lit(model)),
        F.lit(', "reasoning_effort": '),
        quoted(F.lit(effort)) if effort is not None else F.lit("null"),
        F.lit(', "system": '),
        quoted(F.coalesce(system, F.lit(""))),
        F.lit(f', "temperature": {temperature!r}, "user": '),
        quoted(user),
        F.lit("}"),
    )
    return F.sha2(payload, 256)


def request_table(
    items: DataFrame, template: str, fields: dict[str, Column], system: str, model: str,
    temperature: float = 0.0, max_tokens: int = 1024,
) -> DataFrame:
    """(item_id, prompt, prompt_hash): what a model service is to be asked, with its cache key."""
    filled = items.select("item_id", fill_template(template, fields).alias("prompt"))
    key = request_key(F.lit(system), F.col("prompt"), model, temperature, max_tokens)
    return filled.withColumn("prompt_hash", key)
