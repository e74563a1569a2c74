"""Packing of documents into training sequences by an order-preserving dynamic programme.

Documents keep their order and are laid end to end; sequences are stretches of that line. Cuts may lie
at document ends, at sentence ends and, where neither is near, inside a sentence; a cut costs nothing,
a little or more. Of all choices of cuts the one with the least padding plus cut penalties is found: the
cost of the best packing up to a place is the least, over earlier places within one window, of their cost
plus the padding between. Since padding is the window less the distance, that least is the front of a
monotone queue of (cost + place), and every place enters and leaves the queue once.

A sequence of a power of two tokens is not padded. Such sequences matter where a run of documents ends:
in its last window every place may be cut and all powers of two are tried.

A task packs its documents in runs of about ``RUN`` tokens, so memory is bounded by a run or by one
document, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.llm.word_codec import codec

WINDOW = 4096
# Tokens packed together; a longer document is a run of its own.
RUN = 1 << 20
# Penalties, in tokens of padding, of a cut at a sentence end and inside a sentence.
SENTENCE, INSIDE = 4, 16
# Longer stretches without a sentence end may be cut at every so many tokens.
GAP = 16
# Texts encoded at once.
SLICE = 256


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, penalties, first of the dense ones): where a line of tokens may be cut, 0 and its end included.

    ``ends`` tells by id which tokens end a sentence (1) and which are numbers (2); a full stop before a
    number ends nothing.
    """
    n = len(ids)
    never = np.iinfo(np.int16).max
    penalty = np.full(n + 1, never, np.int16)
    kind = ends[ids]
    stop = kind == 1
    stop[:-1] &= kind[1:] != 2
    penalty[1:][stop] = SENTENCE
    penalty[0] = 0
    penalty[doc_ends] = 0
    dense = max(0, n - window)
    penalty[dense:] = np.minimum(penalty[dense:], INSIDE)
    places = np.flatnonzero(penalty < never)
    wide = np.flatnonzero(np.diff(places) > 2 * GAP)
    for lo, hi in zip(places[wide].tolist(), places[wide + 1].tolist()):
        penalty[lo + GAP : hi - GAP // 2 : GAP] = INSIDE
    places = np.flatnonzero(penalty < never)
    return places, penalty[places].astype(np.int64), int(np.searchsorted(places, dense))


def best_cuts(places: list[int], penalties: list[int], dense: int, window: int) -> tuple[int, list[int]]:
    """(cost, cuts): the cheapest cuts from the first place to the last; cuts include the end but not 0.

    No two neighbouring places are further apart than ``window``. From number ``dense`` on places are
    consecutive, and windows of a power of two are tried among them.
    """
    n = len(places)
    powers = [1 << k for k in range(window.bit_length() - 1) if 1 << k < window]
    cost, came = [0] * n, [0] * n
    queue, keys, head = [0] * n, [0] * n, 0
    keys[0] = places[0]
    tail = 1
    for j in range(1, n):
        here = places[j]
        if j > 1:
            key = cost[j - 1] + places[j - 1]
            while tail > head and keys[tail - 1] > key:
                tail -= 1
            queue[tail], keys[tail] = j - 1, key
            tail += 1
        while places[queue[head]] < here - window:
            head += 1
        best, at = keys[head] + window - here, queue[head]
        if j > dense:
            for s in powers:
                if j - s < dense:
                    break
                if cost[j - s] < best:
                    best, at = cost[j - s], j - s
        cost[j], came[j] = best + penalties[j], at
    cuts = []
    j = n - 1
    while j > 0:
        cuts.append(places[j])
        j = came[j]
    return cost[n - 1], cuts[::-1]


def pack_run(ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, document, sequence) of each piece of a run of documents, in order."""
    doc_ends = np.cumsum(sizes)
    places, penalties, dense = cut_places(ids, doc_ends, ends, window)
    _, cuts = best_cuts(places.tolist(), penalties.tolist(), dense, window)
    cuts = np.array(cuts)
    begins = np.unique(np.concatenate((doc_ends - sizes, np.append(0, cuts[:-1]))))
    return begins, np.searchsorted(doc_ends, begins, side="right"), np.searchsorted(cuts, begins, side="right")


PIECE = ("start", "ids", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` of each row of ``docs``, once for every piece of its text, and the piece.

    ``start`` counts the document's tokens before the piece, ``ids`` are its token ids as little-endian
    32-bit numbers, ``doc_tokens`` counts all tokens of the document, its closing ``end_id`` among them;
    ``sequence_id`` names the sequence and ``offset`` the place of the first token in it. Offsets of a
    sequence count from 0 without gaps; no sequence is longer than ``window`` (a power of two). ``path``
    names a vocabulary file that every executor has.

    Null and empty texts are documents of the closing token alone. Repeated rows are documents of their
    own. An empty table has no pieces. Carried columns named like an added one are refused. Sequences are
    numbered by partition and place in it, so ``docs`` must be a stored table.
    """
    if clash := set(PIECE) & {c.lower() for c in carry}:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        ends = coder.sentence_ends()
        number = TaskContext.get().partitionId() << 33
        rows: list[pa.RecordBatch] = []
        lines: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal number
            line, sizes = np.concatenate(lines), np.concatenate(counts)
            begin, doc, sequence = pack_run(line, sizes, ends, window)
            first = np.cumsum(sizes) - sizes
            at_head = np.ones(len(begin), bool)
            at_head[1:] = sequence[1:] != sequence[:-1]
            offset = begin - begin[at_head][sequence]
            bounds = pa.py_buffer((4 * np.append(begin, len(line))).astype(np.int32))
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, bounds, pa.py_buffer(line.astype("<u4"))])
            own = pa.Table.from_batches(rows).combine_chunks().take(pa.array(doc)).columns
            own = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own]
            columns = [pa.array(begin - first[doc]), ids, pa.array(sizes[doc]), pa.array(number + sequence), pa.array(offset)]
            number += int(sequence[-1]) + 1
            return pa.RecordBatch.from_arrays([*own, *columns], names=[*carry, *PIECE])

        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                ids, sizes = coder.encode([t or "" for t in part.column(n).to_pylist()])
                upto = np.cumsum(sizes)
                line = np.insert(ids, upto, end_id)
                sizes = sizes + 1
                upto = np.cumsum(sizes)
                done, begin = 0, 0
                while done < len(sizes):
                    # The first document with which the run is long enough, or all that are left.
                    stop = min(len(sizes), done + 1 + int(np.searchsorted(upto[done:], begin + RUN - held)))
                    end = int(upto[stop - 1])
                    rows.append(part.slice(done, stop - done).select(list(carry)))
                    lines.append(line[begin:end])
                    counts.append(sizes[done:stop])
                    held += end - begin
                    done, begin = stop, end
                    if held >= RUN:
                        yield packed()
                        rows, lines, counts, held = [], [], [], 0
        if held:
            yield packed()

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    schema = ", ".join([*kinds, "start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"])
    return docs.select(*carry, "text").mapInArrow(run, schema)


def token_count(ids: str | Column = "ids") -> Column:
    """Number of tokens in packed ids."""
    return F.shiftright(F.octet_length(ids), 2).cast("bigint")


def padded_size(tokens: Column, window: int = WINDOW) -> Column:
    """Tokens that a sequence takes up: its own number if that is a power of two, else the window."""
    whole = F.bit_count(tokens) == 1
    return F.when(whole, tokens).otherwise(F.lit(window)).cast("bigint")


def sequences(pieces: DataFrame, pad_id: int, window: int = WINDOW) -> DataFrame:
    """(sequence_id, ids, n_tokens): whole sequences with their padding, from pieces.

    A sequence has at most ``window`` tokens, so a group is bounded.
    """
    listed = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(listed.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    filler = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (padded_size(F.col("n_tokens"), window) - F.col("n_tokens")).cast("int")))
    whole = whole.withColumn("ids", joined).withColumn("n_tokens", token_count())
    return whole.select("sequence_id", F.concat("ids", filler).alias("ids"), "n_tokens")
