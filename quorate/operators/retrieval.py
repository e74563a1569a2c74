"""Lexical and dense ranking of chunks for many queries at once."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from quorate.functions import constants as C
from quorate.functions.text import tokens
from quorate.operators.prefix import running_totals
from quorate.session import broadcast_if_small, materialise, spread

# Parts of a lexical score are summed as integers in this unit, so equal chunks tie exactly in every sum
# order; the sum is then rounded to SCORE_DIGITS, in integers as well. Both plans follow this one rule.
UNIT = 1e12
SCORE_DIGITS = 9
_ROUNDING = 1000


def top_k(df: DataFrame, query: Sequence[str], order: Sequence[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """First k rows per query; the planner limits each group before the shuffle."""
    position = F.row_number().over(W.partitionBy(*query).orderBy(*order))
    return df.withColumn(rank, position).where(F.col(rank) <= k)


def postings(chunks: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, chunk_id, source_doc, load_order, dl, term, tf).

    Chunks are spread by chunk id once; counting terms and, later, adding up a query's terms per
    chunk need no further shuffle, since every posting of a chunk stays in its partition.
    """
    spread = chunks.select(
        *group, "chunk_id", "source_doc", "load_order", tokens(F.col("text")).alias("_t")
    ).repartition("chunk_id")
    terms = spread.select(
        *group, "chunk_id", "source_doc", "load_order", F.size("_t").alias("dl"), F.explode("_t").alias("term")
    )
    return terms.groupBy("chunk_id", "source_doc", "load_order", "dl", *group, "term").agg(
        F.count("*").alias("tf")
    )


def lexical_index(chunks: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, chunk_id, source_doc, load_order, dl, tokens): one row per chunk, tokenised once.

    Write it before searching; statistics, scores and fill rows all read it.
    """
    tokenised = chunks.select(
        *group, "chunk_id", "source_doc", "load_order", tokens(F.col("text")).alias("tokens")
    )
    return tokenised.withColumn("dl", F.size("tokens"))


def corpus_stats(index: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, n_chunks, avgdl); chunks without tokens count too."""
    return index.groupBy(*group).agg(
        F.count("*").alias("n_chunks"), (F.sum("dl") / F.count("*")).alias("avgdl")
    )


def document_frequencies(index: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, term, df): chunks of an index that hold each term."""
    terms = index.select(*group, F.explode(F.array_distinct("tokens")).alias("term"))
    return terms.groupBy(*group, "term").agg(F.count("*").alias("df"))


def term_idf(
    index: DataFrame, group: Sequence[str] = (), epsilon: float = C.BM25_EPSILON
) -> DataFrame:
    """(group, term, idf, avgdl): a negative idf becomes epsilon times the mean idf of the index."""
    return idf_from(document_frequencies(index, group), corpus_stats(index, group), group, epsilon)


def idf_from(
    counted: DataFrame, stats: DataFrame, group: Sequence[str] = (), epsilon: float = C.BM25_EPSILON
) -> DataFrame:
    """``term_idf`` from document frequencies (group, term, df) and ``corpus_stats``."""
    counted = _attach(counted, stats, group)
    raw = F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    scored = counted.select(*group, "term", "avgdl", raw.alias("idf"))
    mean = _attach(scored, scored.groupBy(*group).agg(F.avg("idf").alias("_mean")), group)
    floor = F.lit(epsilon) * F.col("_mean")
    return mean.select(
        *group, "term", "avgdl", F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")).alias("idf")
    )


def _attach(df: DataFrame, one_per_group: DataFrame, group: Sequence[str]) -> DataFrame:
    """Add columns of a table that has one row per group (one row in all without groups)."""
    if group:
        return df.join(F.broadcast(one_per_group), list(group))
    names = one_per_group.columns
    return df.withColumns({c: one_per_group.select(c).scalar() for c in names})


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qf): every repetition of a term counts."""
    return (
        queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qf"))
    )


def query_weights(queries: DataFrame, idf: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, query_id, term, weight, avgdl): idf times repetitions of each query term."""
    return idf.join(query_terms(queries), "term").select(
        *group, "query_id", "term", (F.col("idf") * F.col("qf")).alias("weight"), "avgdl"
    )


def lexical_scores(
    index: DataFrame,
    weights: DataFrame,
    group: Sequence[str] = (),
    k1: float = C.BM25_K1,
    b: float = C.BM25_B,
) -> DataFrame:
    """(group, query_id, load_order, score) of every chunk that shares a term with a query, by a
    join of term counts and query terms; for query sets of any size."""
    terms = index.select(*group, "load_order", "dl", F.explode("tokens").alias("term"))
    counted = terms.groupBy("load_order", *group, "dl", "term").agg(F.count("*").alias("tf"))
    tf = F.col("tf").cast("double")
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
    part = F.col("weight") * (tf * (k1 + 1) / (tf + norm))
    hits = counted.join(weights, [*group, "term"]).select(
        *group, "query_id", "load_order", F.round(part * UNIT).cast("bigint").alias("p")
    )
    up = F.sum("p") + F.lit(_ROUNDING // 2)
    score = (up - F.pmod(up, F.lit(_ROUNDING))) / F.lit(_ROUNDING) / F.lit(10.0**SCORE_DIGITS)
    return hits.groupBy(*group, "load_order", "query_id").agg(score.alias("score"))


def lexical_search(
    queries: DataFrame, index: DataFrame, k: int, group: Sequence[str] = (), idf: DataFrame | None = None
) -> DataFrame:
    """Top k per query (and group) by BM25 over a lexical index; ties go to the earlier chunk.

    ``idf`` is that of the index, where it is known already (``versions.idf_of``).

    Chunks without any query term score zero and fill the free places in load order; a query
    without tokens gets nothing.  When the weights of all query terms are proven to fit a bounded
    matrix, tasks score the chunks they read and send k rows per query; otherwise term counts and
    query terms are joined.
    """
    group = list(group)
    weights = materialise(query_weights(queries, term_idf(index, group) if idf is None else idf, group))
    order = [F.col("score").desc(), F.col("load_order")]
    shape = weights.agg(
        F.count_distinct(F.struct(*group, "term")).alias("terms"), F.count_distinct("query_id").alias("queries")
    ).first()
    if weights.where("weight < 0").limit(1).count():
        return _with_negative_scores(queries, index, weights, k, group)
    if max(shape.terms, k * ROW_CELLS) * shape.queries * 8 <= QUERY_MATRIX_BYTES:
        best = _matrix_scores(index, weights, k, group)
    else:
        best = lexical_scores(index, broadcast_if_small(weights), group)
    best = top_k(best, [*group, "query_id"], order, k).drop("rank")

    # The first k chunks of the load order are enough to fill with: at most k places are free, and a
    # chunk is skipped only when it scored, which uses up one of the places.
    fill = _first_chunks(queries, index, k, group).join(best, [*group, "query_id", "load_order"], "left_anti")
    return _named(best.unionByName(fill.withColumn("score", F.lit(0.0))), index, k, group)


def _named(scored: DataFrame, index: DataFrame, k: int, group: Sequence[str]) -> DataFrame:
    ranked = top_k(scored, [*group, "query_id"], [F.col("score").desc(), F.col("load_order")], k)
    names = index.select("load_order", "chunk_id", "source_doc")
    return ranked.join(names, "load_order").select(
        *group, "query_id", "chunk_id", "source_doc", "load_order", "score", "rank"
    )


def _first_chunks(queries: DataFrame, index: DataFrame, m: int, group: Sequence[str]) -> DataFrame:
    """(group, query_id, load_order): the first m chunks of each group for every query with tokens."""
    slim = index.select(*group, "load_order")
    if group:
        first = top_k(slim, group, [F.col("load_order")], m)
    else:
        first = slim.orderBy("load_order").limit(m)
    listed = first.groupBy(*group).agg(F.collect_list("load_order").alias("_f"))
    asked = queries.where(F.size(tokens(F.col("text"))) > 0).select("query_id")
    if group:
        kinds = listed.agg(F.collect_list(F.struct(*group, "_f"))).scalar()
        fill = asked.select("query_id", F.inline(kinds))
    else:
        fill = asked.withColumn("_f", listed.scalar())
    return fill.select(*group, "query_id", F.explode("_f").alias("load_order"))


# Ranges of the load order in which positions are counted.
ORDER_RANGES = 1024


def _positions(index: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, load_order, pos): places of the chunks of each group in load order, from 0, without one task for all."""
    slim = index.select(*group, "load_order", F.lit(1).cast("bigint").alias("_one"))
    ends = slim.agg(F.min("load_order").alias("lo"), F.max("load_order").alias("hi")).first()
    lo, hi = ends.lo or 0, ends.hi or 0
    part = F.floor((F.col("load_order") - lo) / F.lit(hi - lo + 1) * ORDER_RANGES).cast("int")
    cum = running_totals(slim, group, "load_order", ["_one"], bucket=part)
    return cum.select(*group, "load_order", F.col("before__one").alias("pos"))


def _free_places(scored: DataFrame, positions: DataFrame, asked: DataFrame, k: int, group: Sequence[str]) -> DataFrame:
    """(group, query_id, load_order): the first k chunks without a score of every asked query, from the gaps.

    ``v`` is the number of free chunks before a scored one. The j-th free chunk stands at j plus the
    number of scored chunks with v of at most j, so a query needs only the counts of its first k values.
    """
    keys = [*group, "query_id"]
    rows = scored.select(*keys, "load_order", F.lit(1).cast("bigint").alias("_one")).join(positions, [*group, "load_order"])
    most = positions.agg(F.max("pos")).first()[0] or 0
    cum = running_totals(rows, keys, "pos", ["_one"], bucket=F.floor(F.col("pos") / F.lit(most + 1) * ORDER_RANGES).cast("int"))
    gaps = cum.select(*keys, (F.col("pos") - F.col("before__one")).alias("j")).where(F.col("j") < k)
    gaps = gaps.groupBy(*keys, "j").agg(F.count("*").alias("n"))
    places = asked.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))).alias("j"))
    places = places.join(gaps, [*keys, "j"], "left")
    before = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy(*keys).orderBy("j"))
    places = places.select(*keys, (F.col("j") + before).alias("pos"))
    return places.join(positions, [*group, "pos"]).select(*keys, "load_order")


def _with_negative_scores(
    queries: DataFrame, index: DataFrame, weights: DataFrame, k: int, group: Sequence[str]
) -> DataFrame:
    """Top k when some term weight is negative, which takes an index whose mean idf is.

    A chunk without any query term then ranks above one that scored below zero, so each query needs
    its first k chunks without a score.
    """
    scored = materialise(lexical_scores(index, broadcast_if_small(weights), group))
    positions = materialise(_positions(index, group))
    asked = queries.where(F.size(tokens(F.col("text"))) > 0).select("query_id").distinct()
    if group:
        # Groups are few: one idf each.
        kinds = [tuple(r) for r in index.select(*group).distinct().collect()]
        asked = asked.select("query_id", F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(group, kind)]) for kind in kinds]))) if kinds else asked.where("false")
    fill = _free_places(scored, positions, asked, k, group)
    return _named(scored.unionByName(fill.withColumn("score", F.lit(0.0))), index, k, group)


def _matrix_scores(index: DataFrame, weights: DataFrame, k: int, group: Sequence[str]) -> DataFrame:
    """k best chunks per query and task, scored by the query-term matrix."""
    spark = index.sparkSession
    table = weights.toPandas()
    table["_g"] = pd.factorize(pd.MultiIndex.from_frame(table[list(group)]))[0] if group else 0
    key = pd.MultiIndex.from_frame(table[["_g", "term"]])
    codes, uniques = pd.factorize(key)
    names, columns = np.unique(table["query_id"].to_numpy(), return_inverse=True)
    matrix = np.zeros((len(uniques), len(names)))
    matrix[codes, columns] = table["weight"].to_numpy()
    avgdl = table.groupby("_g")["avgdl"].first().to_dict()
    vocabulary = table.assign(term_id=codes)[[*group, "_g", "term", "term_id"]].drop_duplicates()
    if len(vocabulary) == 0:
        return lexical_scores(index, weights, group)
    vocab = spark.createDataFrame(vocabulary).withColumnRenamed("_g", "g")
    shipped = spark.sparkContext.broadcast((names, matrix, avgdl))
    k1, b = C.BM25_K1, C.BM25_B

    terms = spread(index, "load_order").select(
        *group, F.col("load_order").cast("bigint").alias("load_order"), "dl", F.explode("tokens").alias("term")
    )
    hits = terms.join(F.broadcast(vocab), [*group, "term"]).select(
        F.col("g").cast("int").alias("g"), "load_order", F.col("dl").cast("int").alias("dl"), F.col("term_id").cast("int").alias("t")
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, avgdl = shipped.value
        best: dict[int, _Best] = {}

        def flush(rows: np.ndarray) -> None:
            """Rows (g, load_order, dl, term) of whole chunks."""
            # Rows of a chunk are neighbours: its number among them and the term make one key.
            chunk = np.cumsum(np.r_[0, np.any(rows[1:, :2] != rows[:-1, :2], axis=1)])
            _, at, tf = np.unique(chunk * len(matrix) + rows[:, 3], return_index=True, return_counts=True)
            pairs = rows[at]
            mean = np.array([avgdl[g] for g in pairs[:, 0]])
            tf = tf.astype(np.float64)
            gain = tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * pairs[:, 2] / mean))
            starts = np.flatnonzero(np.r_[True, np.any(pairs[1:, :2] != pairs[:-1, :2], axis=1)])
            ends = np.r_[starts[1:], len(pairs)]
            step = max(1, MATRIX_CELLS // max(1, matrix.shape[1]))
            i = 0
            while i < len(starts):
                j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, side="right")))
                lo, hi = starts[i], ends[j - 1]
                part = np.floor(matrix[pairs[lo:hi, 3]] * gain[lo:hi, None] * UNIT + 0.5).astype(np.int64)
                sums = np.add.reduceat(part, starts[i:j] - lo, axis=0)
                scores = ((sums + _ROUNDING // 2) // _ROUNDING) / 10.0**SCORE_DIGITS
                gs, order = pairs[starts[i:j], 0], pairs[starts[i:j], 1]
                for g in np.unique(gs):
                    own = gs == g
                    state = best.setdefault(int(g), _Best(len(names), k, np.int64))
                    state.add(scores[own], order[own], order[own])
                i = j

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)]))
            size += batch.num_rows
            if size >= HELD_ROWS:
                rows = np.concatenate(held)
                # A chunk's rows are neighbours; the last chunk may go on in the next batch.
                open_from = int(np.flatnonzero(rows[:, 1] != rows[-1, 1])[-1]) + 1 if np.any(rows[:, 1] != rows[-1, 1]) else 0
                if open_from:
                    flush(rows[:open_from])
                held, size = [rows[open_from:]], len(rows) - open_from
        if size:
            flush(np.concatenate(held))
        for g, state in best.items():
            q, score, order, _, _ = state.rows()
            if len(q):
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame({"g": np.full(len(q), g, dtype=np.int32), "query_id": names[q], "load_order": order, "score": score}), preserve_index=False
                )

    schema = f"g int, query_id {dict(weights.dtypes)['query_id']}, load_order bigint, score double"
    found = hits.mapInArrow(score, schema)
    if group:
        labels = vocab.select(F.col("g").cast("int").alias("g"), *group).distinct()
        found = found.join(F.broadcast(labels), "g")
    return found.select(*group, "query_id", "load_order", "score")


# Dense ---------------------------------------------------------------------------------------------

# Largest query matrix, in bytes, that is shipped to every task; what a task keeps for its queries is held
# to the same bound, at so many 8-byte cells for each kept row.
QUERY_MATRIX_BYTES = 64 * 1024 * 1024
ROW_CELLS = 4

# Cells of a score block and rows of term hits that a task holds at once.
MATRIX_CELLS = 2_000_000
HELD_ROWS = 50_000

# More queries than these are cut into blocks, past each of which the vectors stream, so that a task ends with whole lists
# and not with k rows for each query there is. Rows of a block of either side and queries of the smallest block; vectors
# that one task sees at most, since it keeps their names, and those it holds at once.
SHIPPED_QUERIES = 4096
VECTOR_BLOCK, QUERY_BLOCK, LEAST_BLOCK = 131_072, 65_536, 512
STREAMED_VECTORS, HELD_VECTORS = 4_194_304, 65_536

# Queries and vectors of one product, which stays in a core's cache; pairs of a query that are kept before they are ranked.
PRODUCT_QUERIES, PRODUCT_ROWS, HELD_PAIRS = 256, 2048, 4096


class _Best:
    """Running top k per query over batches: exact, with ties to the smaller load order."""

    def __init__(self, n_queries: int, k: int, ids: type = object) -> None:
        self.k = k
        self.score = np.full((n_queries, k), -np.inf)
        self.order = np.full((n_queries, k), np.iinfo(np.int64).max)
        self.ids = np.zeros((n_queries, k), ids)

    @property
    def floor(self) -> np.ndarray:
        """Score below which a row cannot enter, per query."""
        return self.score[:, -1]

    def put(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, order: np.ndarray) -> None:
        """Rows of queries ``q``, which ascend."""
        if not len(q):
            return
        own, starts, counts = np.unique(q, return_index=True, return_counts=True)
        row, place = np.repeat(np.arange(len(own)), counts), np.arange(len(q)) - np.repeat(starts, counts) + self.k
        shape = (len(own), self.k + int(counts.max()))
        both = []
        for kept, new, empty in ((self.score, score, -np.inf), (self.order, order, np.iinfo(np.int64).max), (self.ids, ids, 0)):
            wide = np.full(shape, empty, kept.dtype)
            wide[:, : self.k] = kept[own]
            wide[row, place] = new
            both.append(wide)
        pick = np.lexsort((both[1], -both[0]), axis=1)[:, : self.k]
        for kept, wide in zip((self.score, self.order, self.ids), both):
            kept[own] = np.take_along_axis(wide, pick, axis=1)

    def add(self, scores: np.ndarray, ids: np.ndarray, order: np.ndarray) -> None:
        """Scores (row, query) of which zeros do not count."""
        scores = np.where(scores == 0.0, -np.inf, scores).T
        cut = self.floor
        n = scores.shape[1]
        if n > self.k:
            cut = np.maximum(cut, np.partition(scores, n - self.k, axis=1)[:, n - self.k])
        q, rows = np.nonzero((scores >= cut[:, None]) & (scores > -np.inf))
        self.put(q, scores[q, rows], ids[rows], order[rows])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, load order, id, rank) of what is kept, best first."""
        q, place = np.nonzero(self.score > -np.inf)
        return q, self.score[q, place], self.order[q, place], self.ids[q, place], place + 1


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _by_components(matrix: np.ndarray) -> np.ndarray:
    """An order of queries in which those that have the same components other than zero are neighbours."""
    return np.lexsort(np.packbits(matrix != 0, axis=1).T) if matrix.size else np.arange(len(matrix))


def _places(marks: np.ndarray) -> np.ndarray:
    """Flat places of the few true marks, looked for by eights."""
    if marks.size % 8:
        return np.flatnonzero(marks)
    eights = marks.reshape(-1, 8)
    row = np.flatnonzero(eights.view(np.uint64))
    at, place = np.nonzero(eights[row])
    return row[at] * 8 + place


class _Asked:
    """A query matrix that rows are scored against in blocks of bounded size.

    Products in single precision, whose error is bounded by the lengths of the vectors, tell which pairs may
    enter; those alone are scored in double precision. Components that no query of a block has take no part.
    """

    def __init__(self, matrix: np.ndarray) -> None:
        self.matrix = matrix
        self.lengths = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        self.seen = 0

    def add(self, state: _Best, rows: np.ndarray, ids: np.ndarray, order: np.ndarray) -> None:
        if not len(rows) or not len(self.matrix):
            return
        far = np.sqrt(np.einsum("ij,ij->i", rows, rows)).max(initial=0.0)
        longest = np.array([self.lengths.max(initial=0.0), far])
        kind = np.float32 if np.isfinite(longest).all() and longest.max() < 1e15 else np.float64
        step = max(1, min(PRODUCT_ROWS, MATRIX_CELLS // PRODUCT_QUERIES))
        held = np.empty(PRODUCT_QUERIES * step, kind), np.empty(PRODUCT_QUERIES * step, bool)
        used = None
        for lo in range(0, len(self.matrix), PRODUCT_QUERIES):
            block = slice(lo, lo + PRODUCT_QUERIES)
            some = self.matrix[block].any(axis=0)
            if used is None or (some != used).any():
                used, own = some, rows if some.all() else np.ascontiguousarray(rows[:, some])
                short = own.astype(kind, copy=False)
            # Rounding of the components, of the products and of their sum.
            slack = 10.0**-SCORE_DIGITS + (rows.shape[1] + 4) * np.finfo(kind).eps * self.lengths[block] * far
            self._add_block(state, lo, self.matrix[block][:, used], own, short, slack, step, held, ids, order)
        self.seen += len(rows)

    def _add_block(
        self, state: _Best, lo: int, asked: np.ndarray, rows: np.ndarray, short: np.ndarray, slack: np.ndarray, step: int, held: tuple[np.ndarray, np.ndarray], ids: np.ndarray, order: np.ndarray
    ) -> None:
        """Rows, of which ``short`` is a copy in the precision of the products, against the queries from ``lo`` on."""
        block, kind = slice(lo, lo + len(asked)), short.dtype.type
        short_asked = asked.astype(kind, copy=False)
        cut = state.floor[block] - slack
        found, counts, settled = [], np.zeros(len(asked), np.int64), 0
        for i in range(0, len(rows), step):
            part = short[i : i + step]
            n = len(part)
            near, enters = (x[: len(asked) * n].reshape(len(asked), n) for x in held)
            np.matmul(short_asked, part.T, out=near)
            if n > state.k and np.isneginf(cut).any():
                cut = np.maximum(cut, np.partition(near, n - state.k, axis=1)[:, n - state.k] - 2 * slack)
            # Towards zero or up, the bound in single precision may not lie above the bound.
            np.greater_equal(near, np.nextafter(cut.astype(kind), kind(-np.inf))[:, None], out=enters)
            q, at = np.divmod(_places(enters), n)
            found.append((q, at + i))
            counts += np.bincount(q, minlength=len(asked))
            # The bound rises with the rows seen, so pairs are ranked each time these have grown by half.
            if counts.max() < HELD_PAIRS and 2 * (i + n - settled) < self.seen + settled and i + n < len(rows):
                continue
            settled = i + n
            q, at = (np.concatenate(x) for x in zip(*found))
            found, counts = [], np.zeros(len(asked), np.int64)
            by_query = np.argsort(q, kind="stable")
            q, at = q[by_query], at[by_query]
            score = np.empty(len(q))
            pairs = max(1, MATRIX_CELLS // max(1, rows.shape[1]))
            for j in range(0, len(q), pairs):
                few = slice(j, j + pairs)
                score[few] = np.einsum("ij,ij->i", asked[q[few]], rows[at[few]])
            score = np.round(score, SCORE_DIGITS)
            ok = score >= state.floor[lo + q]
            q, at, score = q[ok], at[ok], score[ok]
            state.put(lo + q, score, ids[at], order[at])
            cut = np.maximum(cut, state.floor[block] - slack)


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, carried: Sequence[str] = ()) -> DataFrame:
    """Top k chunks per query by inner product; ties go to the earlier chunk.  Chunk ids are unique.

    ``vectors`` has chunk_id, load_order, embedding; ``queries`` query_id, embedding.  A query
    matrix of proven small size is shipped to the tasks that read the vectors, which then stay where
    they are and send k rows per query and task.  A larger one is cut into blocks that the vectors
    stream past.  Columns of ``vectors`` named in ``carried`` go with their chunk.
    """
    head = queries.select(F.size("embedding")).head()
    width = head[0] if head else 0
    # Counting stops one row beyond what fits.
    fits = min(SHIPPED_QUERIES, QUERY_MATRIX_BYTES // (8 * max(width, k * ROW_CELLS, 1)))
    n_queries = queries.limit(fits + 1).count()
    types = dict(vectors.dtypes)
    id_type, q_type = types["chunk_id"], dict(queries.dtypes)["query_id"]
    schema = f"query_id {q_type}, chunk_id {id_type}, load_order bigint, score double"
    slim = vectors.select("chunk_id", F.col("load_order").cast("bigint").alias("load_order"), "embedding")
    if n_queries > fits:
        return _streamed(vectors.select(*slim.columns, *carried).withColumn("load_order", F.col("load_order").cast("bigint")), queries, k, schema, carried)
    partial = _with_query_matrix(spread(slim, "chunk_id"), queries, k, schema)
    best = top_k(partial, ["query_id"], [F.col("score").desc(), F.col("load_order")], k)
    return best.join(vectors.select("chunk_id", *carried), "chunk_id").select(*best.columns, *carried) if carried else best


def _with_query_matrix(vectors: DataFrame, queries: DataFrame, k: int, schema: str) -> DataFrame:
    table = queries.select("query_id", "embedding").toArrow().combine_chunks()
    names, matrix = table["query_id"].to_pandas().to_numpy(), _matrix(table["embedding"].combine_chunks())
    alike = _by_components(matrix)
    shipped = vectors.sparkSession.sparkContext.broadcast((names[alike], matrix[alike]))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shipped.value
        state, asked = _Best(len(names), k), _Asked(matrix)
        for batch in batches:
            if batch.num_rows == 0 or len(names) == 0:
                continue
            asked.add(
                state,
                _matrix(batch.column("embedding")),
                batch.column("chunk_id").to_pandas().to_numpy(),
                batch.column("load_order").to_numpy(),
            )
        q, score, order, ids, _ = state.rows()
        if len(q):
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame({"query_id": names[q], "chunk_id": ids, "load_order": order, "score": score}), preserve_index=False
            )

    return vectors.mapInArrow(best, schema)


def _blocks(n_vectors: int, n_queries: int, width: int, k: int, slots: int) -> tuple[int, int]:
    """(parts of the vectors, blocks of queries) that send the least.

    Vectors go to every block of queries, queries to every part of the vectors, and unless there is one part only,
    each part sends k rows a query. Blocks of queries are as large as memory allows, unless that leaves slots idle.
    """
    plans = []
    for most in (STREAMED_VECTORS, VECTOR_BLOCK):
        nv = max(1, -(-n_vectors // most))
        nq = max(1, -(-n_queries // QUERY_BLOCK), min(-(-n_queries // LEAST_BLOCK), -(-2 * slots // nv)))
        if nq * nv > 2 * slots:
            # The last tasks of equal size leave no slot without one.
            nq = -(-nq // slots) * slots
        sent = (n_vectors * nq + n_queries * nv) * (4 * width + 24) + (n_queries * k * nv * 40 if nv > 1 else 0)
        plans.append((sent, nv, nq))
    return min(plans)[1:]


def _streamed(vectors: DataFrame, queries: DataFrame, k: int, schema: str, carried: Sequence[str]) -> DataFrame:
    """Lists of each block of queries, past which a part of the vectors streams: a task holds its queries and a few of the vectors."""
    types = dict(vectors.dtypes)
    head = queries.select(F.size("embedding")).head()
    nv, nq = _blocks(vectors.count(), queries.count(), head[0], k, queries.sparkSession.sparkContext.defaultParallelism)
    names = ["chunk_id", *carried]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = vectors.withColumn("_v", F.pmod(F.xxhash64("chunk_id"), F.lit(nv))).withColumn("_q", every(nq)).withColumn("_is", F.lit(True))
    right = queries.select("query_id", "embedding").withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(nq))).withColumn("_v", every(nv)).withColumn("_is", F.lit(False))
    both = right.unionByName(left, allowMissingColumns=True).withColumn("_part", (F.col("_q") * nv + F.col("_v")).cast("int"))
    # Queries first: a task has them all when the first vector comes.
    dealt = both.repartitionById(nv * nq, "_part").sortWithinPartitions("_is").select("_is", "query_id", "load_order", "embedding", *names)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_names, asked_rows, kept_names = [], [], []
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        state = asked = alike = None
        seen = held = 0

        def score_held() -> None:
            nonlocal waiting, held, seen
            if held:
                rows, order = (np.concatenate(x) for x in zip(*waiting))
                asked.add(state, rows, np.arange(seen, seen + held), order)
            waiting, seen, held = [], seen + held, 0

        for batch in batches:
            n_asked = batch.num_rows - batch.column("_is").true_count
            if n_asked:
                asked_names.append(batch.column("query_id").slice(0, n_asked))
                asked_rows.append(_matrix(batch.column("embedding").slice(0, n_asked)))
            if n_asked == batch.num_rows or not asked_rows:
                continue
            if asked is None:
                matrix = np.concatenate(asked_rows)
                alike = _by_components(matrix)
                asked_rows, asked, state = [matrix[:0]], _Asked(matrix[alike]), _Best(len(matrix), k, np.int64)
            part = batch.slice(n_asked)
            kept_names.append(part.select(names))
            waiting.append((_matrix(part.column("embedding")), part.column("load_order").to_numpy()))
            held += part.num_rows
            if held >= min(max(seen, PRODUCT_ROWS), HELD_VECTORS):
                score_held()
        if asked is None:
            return
        score_held()
        listed, of_queries = pa.Table.from_batches(kept_names).combine_chunks(), pa.concat_arrays(asked_names)
        q, score, order, at, rank = state.rows()
        for lo in range(0, len(q), HELD_ROWS):
            rows = slice(lo, lo + HELD_ROWS)
            chunk = listed.take(pa.array(at[rows]))
            columns = [of_queries.take(pa.array(alike[q[rows]])), chunk["chunk_id"].combine_chunks(), pa.array(order[rows], pa.int64()), pa.array(score[rows], pa.float64()), pa.array(rank[rows], pa.int32())]
            columns += [chunk[c].combine_chunks() for c in carried]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "load_order", "score", "rank", *carried])

    found = dealt.mapInArrow(best, ", ".join([schema, "rank int", *[f"{c} {types[c]}" for c in carried]]))
    if nv == 1:
        return found
    ranked = top_k(found.drop("rank"), ["query_id"], [F.col("score").desc(), F.col("load_order")], k)
    return ranked.select(*found.columns)


def pools(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """(query_id, branch, rank, chunk_id, source_doc, score) of both branches."""
    cols = ["query_id", "rank", "chunk_id", "source_doc", "score"]
    a = lexical.select(F.lit("lexical").alias("branch"), *cols)
    b = dense.select(F.lit("dense").alias("branch"), *cols)
    return a.unionByName(b)


def query_hash(text: Column) -> Column:
    """Key of a query in stored pools."""
    return F.sha2(text, 256)


def split_budget(total: Column, k_dense: Column, k_lexical: Column) -> tuple[Column, Column]:
    """``split_top_k`` for columns."""
    dense = F.greatest(F.ceil(total * (k_dense / (k_dense + k_lexical))), F.lit(1)).cast("int")
    return dense, F.greatest(total - dense, F.lit(1)).cast("int")


def split_top_k(total: int, k_dense: int, k_lexical: int) -> tuple[int, int]:
    """A budget of chunks shared by the branches in the ratio of their configured depths, the dense
    share rounded up; each branch keeps at least one."""
    if total < 1:
        raise ValueError("the budget must be at least one chunk")
    dense = max(math.ceil(total * (k_dense / (k_dense + k_lexical))), 1)
    return dense, max(total - dense, 1)
