"""Approximate nearest neighbours by largest inner product, with multi-index hashing.

Vectors become binary codes by learned rotations: the principal axes of a sample, turned so that signs
lose least (alternating between signs and the best rotation to them); several rotations from different
starts give a long code. Codes are split into substrings, each with its own table from key to rows.

Bits weigh as much as the query is sure of them: the distance of a code is the sum of the query's margins
(how far it lies from the plane of a bit) over the bits that differ. A code whose distance is within a
radius differs in some substring by no more than the radius over the number of tables (pigeonhole). So
every table is probed with all keys that cost no more than that, each a lookup, and every code within the
radius is retrieved. Retrieved rows with too many differing bits are left out and the others are measured
on the original vectors in double precision.

Lengths may differ: rows are scaled by the largest norm and lifted to the unit sphere, which turns the
largest inner product into the smallest angle.

The index is dealt into blocks of rows, and every block answers the stated queries, which reach it in
blocks, with its own best. The radius is learned on the sample; a query that finds fewer than it wants in
a block widens its radius there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.llm.common import materialise

BITS = 256
PART = 16
# Rows the rotations and the radius are learned on: those with the smallest hash of the id.
SAMPLE = 4096
ROUNDS = 20
# Shares of a sample query's true neighbours that probing retrieves, and that differ in few enough bits to be measured.
COVER, NEAR = 0.94, 0.985
INDEX_ROWS = 16_384
QUERY_ROWS = 2_048
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


@dataclass
class Codes:
    turn: np.ndarray  # (dimension + 1) x BITS
    largest: float
    share: float  # of a query's whole margin that a probed key may cost in its table
    radius: int  # bits in which a measured row may differ

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.largest
        return np.concatenate((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))), axis=1)

    def of(self, lifted: np.ndarray) -> np.ndarray:
        """Codes as 16-bit substrings, one row per vector."""
        return np.packbits(lifted @ self.turn > 0, axis=1).view(np.uint16)

    def margins(self, lifted: np.ndarray) -> np.ndarray:
        """How sure a query is of each bit: its distance from the bit's plane."""
        return np.abs(lifted @ self.turn)


def usable(vector: str) -> Column:
    """Whether a vector is there, has no null or non-finite component and is not zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def learn(sample: np.ndarray, largest: float, rows: int, k: int, seed: int = 5) -> Codes:
    """Rotations and radius from a sample of ``rows`` vectors."""
    rng = np.random.default_rng(seed)
    blank = Codes(np.zeros((0, 0)), largest, 1.0, BITS)
    x = blank.lifted(sample)
    d = x.shape[1]
    values, axes = np.linalg.eigh(x.T @ x)
    # Axes without any spread cannot tell rows apart.
    axes = axes[:, ::-1][:, : max(1, int((values > 1e-9 * values.max()).sum()))]
    z = x @ axes
    turns = []
    for _ in range(math.ceil(BITS / axes.shape[1])):
        r = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.sign(z @ r).T @ z)
            r = (u @ vt).T
        turns.append(axes @ r)
    codes = Codes(np.concatenate(turns, axis=1)[:, :BITS].reshape(d, -1), largest, 1.0, BITS)
    asked = np.arange(0, len(sample), max(1, len(sample) // 256))
    near = min(max(3, math.ceil(k * len(sample) / max(rows, 1))), max(1, len(sample) - 1))
    if len(sample) < 2:
        return codes
    stored, own = codes.of(x), sample.astype(np.float64)
    side = _query_side(own[asked])
    query, margins = codes.of(side), codes.margins(side)
    costs, apart = [], []
    for i, q, m in zip(asked, query, margins):
        score = own @ own[i]
        score[i] = -np.inf
        differ = stored[np.argsort(-score)[:near]] ^ q
        bits = np.unpackbits(differ.view(np.uint8), axis=1)
        # The table in which a neighbour is cheapest finds it first.
        costs.append((bits * m).reshape(len(differ), -1, PART).sum(axis=2).min(axis=1) / m.sum())
        apart.append(bits.sum(axis=1))
    codes.share = float(np.quantile(np.concatenate(costs), COVER))
    codes.radius = int(np.ceil(np.quantile(np.concatenate(apart), NEAR)))
    return codes


def _query_side(x: np.ndarray) -> np.ndarray:
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.concatenate((x, np.zeros((len(x), 1))), axis=1)


def _words(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes).view(np.uint64)


class Tables:
    """Substring tables of one block of codes: rows by key."""

    def __init__(self, codes: np.ndarray) -> None:
        self.words = _words(codes)
        self.rows, self.starts = [], []
        for j in range(codes.shape[1]):
            self.rows.append(np.argsort(codes[:, j], kind="stable"))
            counts = np.bincount(codes[:, j], minlength=1 << PART)
            self.starts.append(np.concatenate(([0], np.cumsum(counts))))

    def probe(self, query: np.ndarray, margins: np.ndarray, budget: float) -> np.ndarray:
        """Truth value for each row: some substring of its code costs the query at most ``budget``."""
        found = np.zeros(len(self.words), bool)
        for j, (rows, starts) in enumerate(zip(self.rows, self.starts)):
            own = margins[j * PART : (j + 1) * PART]
            keys = int(query[j]) ^ cheap_flips(own, budget)
            since, sizes = starts[keys], starts[keys + 1] - starts[keys]
            some = np.flatnonzero(sizes)
            since, sizes = since[some], sizes[some]
            upto = np.cumsum(sizes)
            if len(upto):
                found[rows[np.arange(upto[-1]) + np.repeat(since - (upto - sizes), sizes)]] = True
        return found

    def differing(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Bits in which the codes of ``rows`` differ from the query's."""
        return np.bitwise_count(self.words[rows] ^ _words(query[None])).sum(axis=1)


def cheap_flips(margins: np.ndarray, budget: float) -> np.ndarray:
    """All flips of a substring's bits whose margins sum up to at most ``budget``."""
    low, high = _BYTE_BITS @ margins[:8], _BYTE_BITS @ margins[8:]
    order = np.argsort(low)
    counts = np.searchsorted(low[order], budget - high, side="right")
    upto = np.cumsum(counts)
    place = np.arange(upto[-1]) - np.repeat(upto - counts, counts)
    return order[place] + (np.repeat(np.arange(256), counts) << 8)


def best(ids: np.ndarray, vectors: np.ndarray, tables: Tables, query_ids: np.ndarray, queries: np.ndarray, codes: Codes, k: int):
    """(query id, id, score): the ``k`` best rows of a block for each query, without the query's own row."""
    side = _query_side(queries)
    asked, margins = codes.of(side), codes.margins(side)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i, own_id in enumerate(query_ids.tolist()):
        want = min(k, len(ids) - int((ids == own_id).sum()))
        budget, radius = codes.share * margins[i].sum(), codes.radius
        while True:
            row = np.flatnonzero(tables.probe(asked[i], margins[i], budget))
            row = row[(tables.differing(asked[i], row) <= radius) & (ids[row] != own_id)]
            if len(row) >= want:
                break
            # Fewer than asked for: this query probes again with a wider radius.
            budget, radius = 1.5 * budget + 1e-3, radius + 16
        score = (vectors[row] * queries[i]).sum(axis=1)
        order = np.lexsort((ids[row], -score))[:k]
        out.append((np.full(len(order), own_id), ids[row[order]], score[order]))
    return tuple(np.concatenate(c) for c in zip(*out))


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every row that ``is_query`` marks.

    ``vectors`` has an id and an array of floats. Rows without id, and vectors that are null, zero or hold
    null or non-finite components, take no part; nor do vectors of another length than the most frequent
    one (the shorter on a tie). A row is never its own neighbour; rows that repeat an id count as the same
    row and one of them (the smallest vector) takes part. Ties go to the smaller id. With fewer than ``k`` other rows
    all are returned; without queries or rows nothing.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull()).where(usable("v"))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id bigint, id bigint, score double"
    if length is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("v") == length["d"]).groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    rows = materialise(rows)
    squares = F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v)
    n, asking, largest = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1)), F.sqrt(F.max(squares))).first()
    picked = rows.select(F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE)
    sample = rows.join(F.broadcast(picked.select("id")), "id").select("id", "v").toArrow().sort_by("id")
    codes = learn(_matrix(sample.column("v").combine_chunks()), largest, n, k)
    blocks, query_blocks = math.ceil(n / INDEX_ROWS), max(1, math.ceil(asking / QUERY_ROWS))
    place, asker = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int")
    stored = rows.select("id", "v", F.lit(False).alias("asks"), place.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    asked = rows.where("asks").select("id", "v", "asks", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), asker.alias("qb"))

    def run(table: pa.Table) -> pa.Table:
        ids, v = table.column("id").to_numpy(), _matrix(table.column("v").combine_chunks())
        q = np.asarray(table.column("asks").to_pylist(), dtype=bool)
        if q.all() or not q.any():
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        found = best(ids[~q], v[~q], Tables(codes.of(codes.lifted(v[~q]))), ids[q], v[q], codes, k)
        return pa.table(dict(zip(("query_id", "id", "score"), found)))

    found = stored.unionByName(asked).groupBy("b", "qb").applyInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _matrix(lists: pa.Array) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks() if lists.num_chunks else pa.array([], lists.type)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))
