"""Ranked lexical search with hashed max-sketches.

The impact of a term in a document grows with its frequency there and falls with the document's length;
a query's score is the sum, over its terms, of weight times impact. A document's sketch has a power of
two coordinates, several for each of its terms; every term is hashed to one coordinate, which keeps the
greatest impact that falls there. For a query, the weighted sum of the coordinates of its terms is an upper bound
of the score. Bounds of all queries of a batch are looked up for a block of documents at once; then, for
each query, documents are scored exactly in descending order of their bounds, until no bound reaches the
k-th best score so far. That threshold is carried from block to block of a task.

Impacts do not depend on the queries, weights not on the documents, so one index of the corpus serves any
queries. Terms are known by 64-bit hashes. Scores are whole numbers; only weights use doubles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorate.llm.common import materialise, span_hashes, text_blocks

K = 10
# Fixed values of the score: weights in thousandths; impacts up to SCALE / 1000; length share in hundredths.
SCALE = 1_000_000_000
LENGTH_SHARE = 90
# Coordinates of a sketch for each term, and at least. With 16 a fifteenth of all pairs is scored exactly where all are strangers.
SPREAD, LEAST = 16, 64
# Sketches hold impacts in steps of 1 << STEP, rounded up, in 16 bits.
STEP = 4
# Terms of queries that are searched together, and postings of a block of documents.
BATCH_TERMS = 1_000_000
BLOCK_POSTINGS = 1 << 19
# Values of a table of bounds that are summed at once.
CELLS = 1 << 22
# Documents of a query that are scored exactly in the first round; each round doubles them.
ROUND = 16

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
# Digits, letters and everything beyond ASCII.
_IN_TERM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def text_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all terms of a block of texts, in order."""
    low = _LOWER[data]
    inside = _IN_TERM[low]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    start[heads] |= inside[heads]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | start[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return span_hashes(low, s, e), np.searchsorted(offsets, s, side="right") - 1


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values)


def index(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, n, terms, tfs) of every row with at least one term: its distinct terms in ascending order and their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                hashes, owner = text_terms(data, offsets)
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                first = np.ones(len(hashes), bool)
                first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(first)
                tfs = np.diff(np.append(at, len(hashes)))
                n, distinct = np.bincount(owner, minlength=hi - lo), np.bincount(owner[at], minlength=hi - lo)
                some = np.flatnonzero(n)
                columns = [batch.column(0).take(pa.array(lo + some)), pa.array(n[some])]
                lists = [_lists(distinct[some], pa.array(hashes[at].view(np.int64))), _lists(distinct[some], pa.array(tfs.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*columns, *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<bigint>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_terms(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of documents with n terms each, as whole numbers beyond 64 bits if need be."""
    if len(n) and LENGTH_SHARE * int(n.max()) * n_docs >= 1 << 63:
        n = n.astype(object)
    return (100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // max(total, 1)).astype(np.int64)


@dataclass
class Queries:
    """A batch of queries: the terms of all, query after query in ascending order, as numbers of ``universe``."""

    items: list
    universe: np.ndarray  # sorted distinct term hashes
    weights: np.ndarray  # of the universe
    starts: np.ndarray  # of each query, and the end
    terms: np.ndarray


class Sketches:
    """The sketches of a block of documents, those of one width as the columns of one matrix."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> None:
        sizes = np.diff(starts)
        bits = np.maximum(np.ceil(np.log2(np.maximum(SPREAD * sizes, LEAST))).astype(np.int64), 1)
        self.groups: list[tuple[int, np.ndarray, np.ndarray]] = []
        of_term = np.repeat(np.arange(len(sizes)), sizes)
        steps = ((impacts + (1 << STEP) - 1) >> STEP).astype(np.uint16)
        for b in np.unique(bits).tolist():
            docs = np.flatnonzero(bits == b)
            column = np.zeros(len(sizes), np.int64)
            column[docs] = np.arange(len(docs))
            own = np.flatnonzero(bits[of_term] == b)
            sketch = np.zeros((1 << b) * len(docs), np.uint16)
            cell = (terms[own] >> np.uint64(64 - b)).astype(np.int64) * len(docs) + column[of_term[own]]
            np.maximum.at(sketch, cell, steps[own])
            self.groups.append((b, docs, sketch.reshape(1 << b, len(docs))))

    def bounds(self, queries: Queries) -> np.ndarray:
        """(query, document): no score is above its bound."""
        out = np.zeros((len(queries.items), sum(len(d) for _, d, _ in self.groups)), np.float32)
        hashes, weights = queries.universe[queries.terms], queries.weights[queries.terms].astype(np.float32)
        for b, docs, sketch in self.groups:
            rows = (hashes >> np.uint64(64 - b)).astype(np.int64)
            lo = 0
            while lo < len(queries.items):
                upto = queries.starts[lo] + max(1, CELLS // len(docs))
                hi = max(lo + 1, int(np.searchsorted(queries.starts, upto, side="right")) - 1)
                since, until = queries.starts[lo], queries.starts[hi]
                part = sketch[rows[since:until]] * weights[since:until, None]
                out[lo:hi, docs] = np.add.reduceat(part, queries.starts[lo:hi] - since, axis=0)
                lo = hi
        # Sums of singles may fall short by their rounding.
        return out * np.float32((1 << STEP) * 1.0001)


class Best:
    """The k best documents of every query so far: higher score first, then smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.query = np.zeros(0, np.int64)
        self.doc = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.least = np.ones(queries, np.int64)

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        good = score > 0
        query, doc, score = (np.concatenate((a, b[good])) for a, b in ((self.query, query), (self.doc, doc), (self.score, score)))
        order = np.lexsort((doc, -score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        kept = order[place < self.k]
        self.query, self.doc, self.score = query[kept], doc[kept], score[kept]
        full = place[place < self.k] == self.k - 1
        self.least[self.query[full]] = self.score[full]


class Postings:
    """Exact impacts of the queries' terms in a block of documents."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, queries: Queries) -> None:
        at = np.minimum(np.searchsorted(queries.universe, terms), len(queries.universe) - 1)
        met = np.flatnonzero(queries.universe[at] == terms)
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[met]
        # Ascending, because the terms of a document are.
        self.keys = doc * len(queries.universe) + at[met]
        self.impacts = impacts[met]
        self.queries = queries

    def scores(self, query: np.ndarray, doc: np.ndarray) -> np.ndarray:
        q = self.queries
        sizes = q.starts[query + 1] - q.starts[query]
        upto = np.cumsum(sizes)
        term = q.terms[np.arange(upto[-1] if len(upto) else 0) + np.repeat(q.starts[query] - (upto - sizes), sizes)]
        keys = np.repeat(doc, sizes) * len(q.universe) + term
        if not len(self.keys):
            return np.zeros(len(query), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        part = np.where(self.keys[at] == keys, self.impacts[at] * q.weights[term], 0)
        return np.add.reduceat(part, upto - sizes) if len(part) else np.zeros(0, np.int64)


def rank_block(ids: np.ndarray, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, queries: Queries, best: Best) -> int:
    """Bring ``best`` up to date with a block of documents; the number of exact scores it took."""
    bounds = Sketches(starts, terms, impacts).bounds(queries)
    exact = Postings(starts, terms, impacts, queries)
    taken, done = ROUND, 0
    while True:
        open_ = np.flatnonzero((bounds >= best.least[:, None]).any(axis=1))
        if not len(open_):
            return done
        wide = min(taken, bounds.shape[1])
        own = bounds[open_]
        top = np.argpartition(-own, wide - 1, axis=1)[:, :wide]
        value = np.take_along_axis(own, top, axis=1)
        row, place = np.nonzero(value >= best.least[open_][:, None])
        query, doc = open_[row], top[row, place]
        bounds[query, doc] = -1
        best.add(query, ids[doc], exact.scores(query, doc))
        done += len(query)
        taken *= 2


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values) of a column of lists."""
    starts = column.offsets.to_numpy().astype(np.int64)
    return starts - starts[0], column.flatten().to_numpy(zero_copy_only=False)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, starts, terms, tfs) of runs of rows of about BLOCK_POSTINGS terms."""
    starts, terms = _flat(batch.column("terms"))
    tfs = _flat(batch.column("tfs"))[1]
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(starts, starts[lo] + BLOCK_POSTINGS, side="right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows)
        cut = slice(starts[lo], starts[hi])
        yield lo, hi, starts[lo : hi + 1] - starts[lo], terms[cut].view(np.uint64), tfs[cut].astype(np.int64)
        lo = hi


def frequencies(stored: DataFrame, universe: np.ndarray) -> np.ndarray:
    """Number of documents of an index that hold each of some terms (sorted hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(universe), np.int64)
        for batch in batches:
            terms = _flat(batch.column(0))[1].view(np.uint64)
            at = np.minimum(np.searchsorted(universe, terms), len(universe) - 1)
            counts += np.bincount(at[universe[at] == terms], minlength=len(universe))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["term", "df"])

    out = np.zeros(len(universe), np.int64)
    if len(universe):
        # At most one row for each term of the batch.
        found = stored.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


def _batch(rows: pa.Table, stored: DataFrame, n_docs: int) -> Queries:
    """Queries from rows (item, term); terms that no document holds or that weigh nothing are left out."""
    items, item = np.unique(rows.column("item").to_numpy(), return_inverse=True)
    universe, term = np.unique(rows.column("term").to_numpy().view(np.uint64), return_inverse=True)
    df = frequencies(stored, universe)
    weights = np.array([weight(n_docs, d) if d else 0 for d in df.tolist()], np.int64)
    good = weights[term] > 0
    number = np.cumsum(weights > 0) - 1
    item, term = item[good], number[term[good]]
    order = np.lexsort((term, item))
    present, item = np.unique(item[order], return_inverse=True)
    starts = np.searchsorted(item, np.arange(len(present) + 1))
    return Queries(items[present].tolist(), universe[weights > 0], weights[weights > 0], starts, term[order])


def _ranked(stored: DataFrame, queries: Queries, n_docs: int, total: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): the best of every task for each query."""
    items = np.array(queries.items, np.int64)
    if not len(items):
        return stored.sparkSession.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items), k)
        for batch in batches:
            for lo, hi, starts, terms, tfs in _blocks(batch):
                n = batch.column("n").slice(lo, hi - lo).to_numpy()
                m = np.repeat(length_terms(n, n_docs, total), np.diff(starts))
                ids = batch.column("doc_id").slice(lo, hi - lo).to_numpy()
                rank_block(ids, starts, terms, (SCALE * tfs) // (1000 * tfs + 8 * m), queries, best)
        yield pa.RecordBatch.from_arrays([pa.array(items[best.query]), pa.array(best.doc), pa.array(best.score)], names=["item_id", "doc_id", "score"])

    return stored.where("doc_id is not null").mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best rows of ``docs`` for each item, all with a score above 0 if fewer.

    Both tables have an integer id and ``text``; other columns are ignored. Null and empty texts have no
    terms. Rows of ``docs`` that repeat an id are documents of their own; rows without id count in the
    statistics but cannot be named, so they are not ranked. Rows of ``items`` with one id are one item with the terms of
    all; items without id take no part. Equal scores go to the smaller id. Empty tables give no rows.

    Items are dealt into batches of about BATCH_TERMS terms, each searched by one scan of the index; the
    driver holds one batch.
    """
    stored = materialise(index(docs, key))
    n_docs, total = stored.agg(F.count("*"), F.sum("n")).first()
    asked = index(items.where(F.col(item_key).isNotNull()), item_key)
    asked = materialise(asked.select(F.col("doc_id").alias("item"), F.explode("terms").alias("term")).distinct())
    batches = max(1, -(-asked.count() // BATCH_TERMS))
    found = None
    for i in range(batches):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == i).toArrow()
        part = _ranked(stored, _batch(rows, stored, n_docs), n_docs, total or 0, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
