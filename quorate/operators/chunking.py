"""Documents to chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.functions import constants as C
from quorate.functions import text as tx
from quorate.session import spread

# Chunk positions inside one document; order over the corpus is document order, then position.
POSITIONS = 10_000_000


# Documents whose chunks a task makes at once.
BATCH_DOCUMENTS = 1000

_SENTENCE_END = re.compile(rf"(?<=[.!?])[{tx.WS}]+(?=[A-Z])")


def _windows(units: Sequence[str], max_tokens: int, overlap: int) -> Iterator[tuple[str, int]]:
    """(text, words) of the windows of ``text.pack_windows``, with words counted once a unit."""
    sizes = [len(u.split()) for u in units]
    start = used = 0
    for i, n in enumerate(sizes):
        if start < i and (n > max_tokens or used + n > max_tokens):
            yield " ".join(units[start:i]), used
            while start < i and (n > max_tokens or used > overlap):
                used -= sizes[start]
                start += 1
        used += n
        if n > max_tokens:
            yield units[i], n
            start, used = i + 1, 0
    if start < len(units):
        yield " ".join(units[start:]), used


def _stripped(parts: Sequence[str]) -> list[str]:
    return [p for p in map(str.strip, parts) if p]


def _pieces(text: str, max_tokens: int, overlap: int, separator: str) -> list[tuple[str, int]]:
    """(text, words) of the chunks of ``text.chunk_texts``; white space is that of Python's strings."""
    out = []
    for window, n in _windows(_stripped(text.split(separator)), max_tokens, overlap):
        if n > max_tokens:
            out.extend(_windows(_stripped(_SENTENCE_END.split(window)), max_tokens, overlap))
        else:
            out.append((window, n))
    return out


def _by_words(documents: DataFrame, max_tokens: int, overlap: int, separator: str) -> DataFrame:
    """Rows of documents with ``text`` repeated for each chunk, with its chunk_pos, text and n_tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, BATCH_DOCUMENTS):
                batch = whole.slice(first, BATCH_DOCUMENTS)
                found = [_pieces(t, max_tokens, overlap, separator) if t else [] for t in batch.column("text").to_pylist()]
                counts = np.array([len(f) for f in found])
                pos = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                kept = batch.drop_columns(["text"]).take(pa.array(np.repeat(np.arange(len(found)), counts)))
                columns = [pa.array(pos, pa.int32()), pa.array([t for f in found for t, _ in f], pa.string()), pa.array([n for f in found for _, n in f], pa.int32())]
                yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*kept.schema.names, "chunk_pos", "text", "n_tokens"])

    kept = ", ".join(f"`{c}` {t}" for c, t in documents.dtypes if c != "text")
    return documents.mapInArrow(cut, f"{kept}, chunk_pos int, text string, n_tokens int")


def chunk_documents(
    documents: DataFrame,
    max_tokens: int = C.CHUNK_MAX_TOKENS,
    overlap: int = C.CHUNK_OVERLAP_TOKENS,
    separator: str = C.PARAGRAPH_SEPARATOR,
    counter=tx.word_count,
) -> DataFrame:
    """(chunk_id, text, source_doc, section_path, n_tokens, chunk_pos, load_order).

    ``documents`` has doc_id, text and load_order; any other column (such as a source type) is
    carried along.  Chunking happens inside each row; blank documents give none.  Words are counted
    by a small function in the tasks; another counter is a column expression, and so is then all else.
    """
    extra = [c for c in documents.columns if c not in ("doc_id", "text", "load_order", "section_path")]
    section = F.col("section_path") if "section_path" in documents.columns else F.lit(None).cast("string")
    rows = spread(documents, "doc_id").select(
        F.col("doc_id").cast("string").alias("source_doc"),
        section.alias("section_path"),
        F.col("load_order").alias("_doc_order"),
        *extra,
        "text",
    )
    if counter is tx.word_count and separator:
        pieces = _by_words(rows, max_tokens, overlap, separator)
    else:
        cut = F.posexplode(tx.chunk_texts(F.col("text"), max_tokens, overlap, separator, counter)).alias("chunk_pos", "text")
        pieces = rows.select("source_doc", "section_path", "_doc_order", *extra, cut).withColumn("n_tokens", counter(F.col("text")))
    number = F.col("chunk_pos").cast("string")
    padded = F.when(F.col("chunk_pos") < 10_000, F.lpad(number, 4, "0")).otherwise(number)
    return pieces.select(
        F.concat("source_doc", F.lit("#"), padded).alias("chunk_id"),
        "text",
        "source_doc",
        "section_path",
        "n_tokens",
        "chunk_pos",
        (F.col("_doc_order") * POSITIONS + F.col("chunk_pos")).alias("load_order"),
        *extra,
    )
