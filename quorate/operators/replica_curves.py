"""Bootstrap replicas of statistics along score curves, as matrices of cells by replicas.

A curve statistic of a replica needs the weights of all cells in score order. Cells are sorted once, not
once per replica: a task draws the weights of a bucket of cells for a block of replicas, which is a matrix
with a column per replica, and hands every curve's rows to the key range of their scores. A range is again
one matrix, and totals before a level are prefix sums down its columns, for all replicas at once. Totals
before a range are added from the ranges' own totals.

All curves of a cell share its weights, so differences between curves are paired.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorate.operators.bootstrap import BUCKET_CELLS, block_starts, bucket_picks, bucket_weights, bucketed, compress, percentile_interval
from quorate.session import materialise

# Cells of a key range, and replicas of a block: a task holds a matrix of that size.
RANGE_CELLS = 4096
BLOCK = 500
# Buckets of cells that a task draws for its block, and bytes of summed weights that it keeps before it passes them on.
TASK_BUCKETS = 64
KEPT_BYTES = 64 << 20
EULER = 0.5772156649015329
SMALL = 64
_HARMONIC = np.concatenate(([0.0], np.cumsum(1.0 / np.arange(1, SMALL))))


@dataclass(frozen=True)
class Curve:
    """Columns of the score, best first, and of a small whole number that tells rows of one score apart."""

    score: str
    kind: str


@dataclass
class Matrix:
    """The levels of a range, best first: rows (level, kind) by replicas, and totals before the range."""

    weights: np.ndarray  # (row, replica)
    kinds: np.ndarray  # of each row
    firsts: np.ndarray  # first row of each level
    before: np.ndarray  # (2, replica): weight, and weight of rows of an odd kind

    def levels(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(n, s, n0, s0), each (level, replica): weight and odd weight of each level, and before it."""
        odd = self.weights * (self.kinds & 1)[:, None]
        n, s = np.add.reduceat(self.weights, self.firsts), np.add.reduceat(odd, self.firsts)
        return n, s, np.cumsum(n, axis=0) - n + self.before[0], np.cumsum(s, axis=0) - s + self.before[1]


Fold = Callable[[Matrix], dict[int, np.ndarray]]


def harmonic(n: np.ndarray) -> np.ndarray:
    """Harmonic numbers of whole numbers from 0."""
    x = np.maximum(n, SMALL - 1).astype(np.float64)
    series = np.log(x) + EULER + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return np.where(n < SMALL, _HARMONIC[np.minimum(n, SMALL - 1)], series)


def area(matrix: Matrix) -> dict[int, np.ndarray]:
    """Sum over rows of the risk at their places, ties by the level's mean; kinds are labels 0 and 1."""
    n, s, n0, s0 = matrix.levels()
    mean = np.divide(s, n, out=np.zeros(n.shape), where=n > 0)
    term = n * (1 - mean) - (s0 - n0 * mean) * (harmonic(n0 + n) - harmonic(n0))
    return {0: np.where(n > 0, term, 0.0).sum(axis=0)}


def discrimination(matrix: Matrix) -> dict[int, np.ndarray]:
    """What an AUROC needs, keys 0 to 2: pairs won by odd kinds (half for a tie), rows of odd kinds, rows of even kinds."""
    n, s, _, s0 = matrix.levels()
    return {0: ((n - s) * (s0 + s / 2)).sum(axis=0), 1: s.sum(axis=0, dtype=np.float64), 2: (n - s).sum(axis=0, dtype=np.float64)}


def answered(coverages: Sequence[float], total: int, kinds: int) -> Fold:
    """Weight and answered weight of each kind at each coverage: keys kind, and (1 + coverage) * kinds + kind.

    Rows are answered from the best score down until the coverage's share of the total is reached; the
    level at the cut answers with a fraction. Kinds from ``kinds`` on mark a level that stands for several, which cannot
    be cut: a replica that does has no value (NaN).
    """

    def fold(matrix: Matrix) -> dict[int, np.ndarray]:
        n, _, n0, _ = matrix.levels()
        of_row = np.repeat(np.arange(len(matrix.firsts)), np.diff(np.append(matrix.firsts, len(matrix.kinds))))
        out, many, own = {}, matrix.kinds[matrix.firsts] >= kinds, matrix.kinds % kinds
        for i, c in enumerate([None, *coverages]):
            if c is None:
                part = matrix.weights
            else:
                share = np.clip(np.divide(c * total - n0, n, out=np.zeros(n.shape), where=n > 0), 0, 1)
                share[:, ((share > 0) & (share < 1) & many[:, None]).any(axis=0)] = np.nan
                part = matrix.weights * share[of_row]
            for kind in np.unique(own).tolist():
                out[i * kinds + kind] = part[own == kind].sum(axis=0, dtype=np.float64)
        return out

    return fold


def _edges(cells: DataFrame, curves: dict[str, Curve], ranges: int) -> dict[str, np.ndarray]:
    """Scores at which each curve's ranges begin, best first, so that a range has some RANGE_CELLS cells."""
    if ranges == 1:
        return {name: np.zeros(0) for name in curves}
    shares = [i / ranges for i in range(1, ranges)]
    cuts = cells.agg(*[F.percentile_approx(c.score, shares, 20 * ranges).alias(name) for name, c in curves.items()]).first()
    return {name: np.unique(np.array(cuts[name], np.float64)) for name in curves}


LEVEL = "curve string, _range int, _first int, score double, kind int, w binary"


def _summed(score: np.ndarray, kind: np.ndarray, weights: np.ndarray, dtype: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal score and kind added up, best score first."""
    order = np.lexsort((kind, -score))
    score, kind = score[order], kind[order]
    at = np.flatnonzero(np.append(True, (score[1:] != score[:-1]) | (kind[1:] != kind[:-1])))
    return score[at], kind[at], np.add.reduceat(weights[order], at, dtype=dtype)


def _drawn(cells: DataFrame, columns: Sequence[str], curves: dict[str, Curve], replicas: int, seed: int, edges: dict[str, np.ndarray], buckets: int, dtype: type) -> DataFrame:
    """Weights of scores and kinds of each curve in blocks of replicas, added up over the buckets of a task; drawn as by ``replica_weights``."""
    keyed = bucketed(cells, columns, buckets)
    tasks = -(-buckets // TASK_BUCKETS)
    picks = bucket_picks(keyed, replicas, seed, BLOCK)
    rows = keyed.select("_s", "_b", F.explode(block_starts(replicas, BLOCK)).alias("_first"), *columns, "_n").unionByName(picks, allowMissingColumns=True)
    rows = rows.withColumn("_task", F.col("_b") % tasks)
    # The picks of a bucket stand before its cells.
    parts = 3 * tasks * -(-replicas // BLOCK)
    dealt = rows.repartition(parts, "_first", "_task").sortWithinPartitions("_first", "_task", "_s", "_b", F.col("_picks").isNull(), *columns)

    def level_rows(first: int, kept: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for name, listed in kept.items():
            for score, kind, sums in listed:
                n, size = len(score), sums.shape[1] * sums.itemsize
                place = len(edges[name]) - np.searchsorted(edges[name], score, side="right")
                bounds = pa.py_buffer((np.arange(n + 1) * size).astype(np.int32))
                w = pa.BinaryArray.from_buffers(pa.binary(), n, [None, bounds, pa.py_buffer(np.ascontiguousarray(sums))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array(place.astype(np.int32)), pa.array(np.full(n, first, np.int32)), pa.array(score), pa.array(kind.astype(np.int32)), w],
                    names=["curve", "_range", "_first", "score", "kind", "w"],
                )

    def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """One table for each bucket and block, its picks in the first row."""
        parts: list[pa.RecordBatch] = []
        for batch in batches:
            at = [*np.flatnonzero(batch.column("_picks").is_valid().to_numpy(zero_copy_only=False)).tolist(), batch.num_rows]
            parts.append(batch.slice(0, at[0]))
            for lo, hi in zip(at, at[1:]):
                if sum(p.num_rows for p in parts):
                    yield pa.Table.from_batches(parts)
                parts = [batch.slice(lo, hi - lo)]
        if sum(p.num_rows for p in parts):
            yield pa.Table.from_batches(parts)

    def compacted(kept: dict[str, list]) -> dict[str, list]:
        return {name: [_summed(*map(np.concatenate, zip(*listed)), dtype)] for name, listed in kept.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list] = {}
        size, block = 0, None
        for table in buckets_of(batches):
            s, first, order, picked = (table.column(c)[0].as_py() for c in ("_s", "_first", "_order", "_picks"))
            if block is not None and first != block:
                yield from level_rows(block, compacted(kept))
                kept, size = {}, 0
            block, own = first, table.slice(1).combine_chunks()
            weights = bucket_weights(seed, s, first, order, picked, own.column("_n").to_numpy()).T
            for name, curve in curves.items():
                score, kind = own.column(curve.score).to_numpy().astype(np.float64), own.column(curve.kind).to_numpy().astype(np.int64)
                kept.setdefault(name, []).append(_summed(score, kind, weights, dtype))
                size += kept[name][-1][2].nbytes
            if size > KEPT_BYTES:
                kept = compacted(kept)
                size = sum(listed[0][2].nbytes for listed in kept.values())
                if 2 * size > KEPT_BYTES:
                    yield from level_rows(block, kept)
                    kept, size = {}, 0
        if kept:
            yield from level_rows(block, compacted(kept))

    return dealt.mapInArrow(run, LEVEL)


def _flat(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """(row, replica) of written weights."""
    return np.frombuffer(b"".join(v.as_buffer() for v in column.combine_chunks()), dtype).reshape(len(column), -1)


def _matrix(table: pa.Table, dtype: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, kinds, first row of each level) of the rows of a range, best first; rows of other tasks are added up."""
    score, kind, weights = _summed(table.column("score").to_numpy(), table.column("kind").to_numpy(), _flat(table.column("w"), dtype), np.int64)
    level = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
    return weights, kind.astype(np.int64), level


def replica_values(cells: DataFrame, columns: Sequence[str], curves: dict[str, Curve], fold: Fold, replicas: int, seed: int = 42) -> DataFrame:
    """(curve, key, replica, value): what ``fold`` gives for each curve and replica, summed over the curve's ranges.

    ``cells`` is as ``bootstrap.compress`` makes it. Scores must not be null.
    """
    cells = materialise(cells)
    count, total = cells.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    ranges, buckets = max(1, -(-count // RANGE_CELLS)), max(1, -(-count // BUCKET_CELLS))
    dtype = np.int32 if total < 1 << 31 else np.int64
    levels = _drawn(cells, columns, curves, replicas, seed, _edges(cells, curves, ranges), buckets, dtype)
    group = ["curve", "_range", "_first"]

    def values(table: pa.Table, before: np.ndarray | None) -> pa.Table:
        weights, kinds, firsts = _matrix(table, dtype)
        zero = np.zeros((2, weights.shape[1]), np.int64)
        found = fold(Matrix(weights, kinds, firsts, zero if before is None else before))
        n = len(found)
        return pa.table({
            "curve": pa.array([table.column("curve")[0].as_py()] * n, pa.string()), "_first": pa.array([table.column("_first")[0].as_py()] * n, pa.int32()),
            "key": pa.array(list(found), pa.int32()), "v": pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64())),
        })

    schema = "curve string, _first int, key int, v array<double>"
    if ranges == 1:
        each = levels.groupBy(*group).applyInArrow(lambda table: values(table, None), schema)
    else:
        levels = materialise(levels)

        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                for head in table.select(group).group_by(group).aggregate([]).to_pylist():
                    mine = np.logical_and.reduce([np.asarray(table.column(c)) == head[c] for c in group])
                    own = table.filter(pa.array(mine))
                    weights, odd = _flat(own.column("w"), dtype).astype(np.int64), own.column("kind").to_numpy() & 1 == 1
                    sums = {"n": weights.sum(axis=0), "s": weights[odd].sum(axis=0)}
                    out = {"curve": pa.array([head["curve"]]), **{c: pa.array([head[c]], pa.int32()) for c in group[1:]}, **{c: pa.array([v.tolist()], pa.list_(pa.int64())) for c, v in sums.items()}}
                    yield pa.RecordBatch.from_pydict(out)

        # Weights are summed where they are read; only the sums are shuffled.
        summed = levels.mapInArrow(totals, "curve string, _range int, _first int, n array<bigint>, s array<bigint>")
        one = summed.select(*group, F.posexplode(F.arrays_zip("n", "s")).alias("_i", "t"))
        one = one.groupBy(*group, "_i").agg(F.sum("t.n").alias("n"), F.sum("t.s").alias("s"))
        before = Window.partitionBy("curve", "_first", "_i").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        one = one.select(*group, "_i", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n", "s")])
        starts = one.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_i", "n", "s"))).alias("b"))
        starts = starts.select(*group, F.col("b.n").alias("n"), F.col("b.s").alias("s"))

        def met(table: pa.Table, start: pa.Table) -> pa.Table:
            return values(table, np.array([start.column(c)[0].as_py() for c in ("n", "s")], np.int64))

        each = levels.groupBy(*group).cogroup(starts.groupBy(*group)).applyInArrow(met, schema)
    rows = each.select("curve", "key", "_first", F.posexplode("v").alias("_i", "value"))
    return rows.groupBy("curve", "key", (F.col("_first") + F.col("_i")).alias("replica")).agg(F.sum("value").alias("value"))


def area_replicas(wide: DataFrame, stratum: str | None, curves: dict[str, Curve], replicas: int, seed: int = 42) -> DataFrame:
    """(curve, replica, aurc): areas under the risk-coverage curves of rows with a score and a 0/1 label per curve."""
    columns = list(dict.fromkeys(c for curve in curves.values() for c in (curve.score, curve.kind)))
    cells = materialise(compress(wide, stratum, columns))
    total = cells.agg(F.sum("_n")).first()[0] or 0
    found = replica_values(cells, columns, curves, area, replicas, seed)
    # Strata keep their sizes, so every replica has as many rows as the table.
    return found.select("curve", "replica", (F.col("value") / F.lit(total)).alias("aurc"))


def auroc_replicas(rows: DataFrame, stratum: str | None, score: str, label: str, replicas: int, seed: int = 42) -> DataFrame:
    """(replica, auroc) of a score for a 0/1 label; null where a replica has rows of one label only."""
    cells = compress(rows, stratum, [score, label])
    found = replica_values(cells, [score, label], {"auroc": Curve(score, label)}, discrimination, replicas, seed)
    part = {k: F.max(F.when(F.col("key") == k, F.col("value"))) for k in range(3)}
    return found.groupBy("replica").agg(F.try_divide(part[0], part[1] * part[2]).alias("auroc"))


def widened(rows: DataFrame, names: Sequence[str], parts: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per item with the ``parts`` of every variant as ``<variant>_<part>``."""
    rows = rows.where(F.col("variant").isin(list(names)))
    return rows.groupBy(*by).agg(*[F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{v}_{c}") for v in names for c in parts])


def area_differences(
    rows: DataFrame, terms: dict[str, dict[str, int]], stratum: str, replicas: int = 10_000, seed: int = 42
) -> DataFrame:
    """(statistic, ci_lo, ci_hi, n_resamples, n_dropped) of whole-number combinations of variants' areas, with shared weights.

    ``rows`` has item_id, ``stratum``, variant, score and z; ``terms`` gives for each statistic its variants
    with their factors. An item that lacks a wanted variant is an error.
    """
    names = sorted({v for factors in terms.values() for v in factors})
    wide = materialise(widened(rows, names, ["score", "z"], ["item_id", stratum]))
    lacking = F.lit(False)
    for v in names:
        lacking = lacking | F.col(f"{v}_score").isNull() | F.col(f"{v}_z").isNull()
    if not wide.where(lacking).isEmpty():
        raise ValueError("an item lacks a score or label of a variant")
    areas = area_replicas(wide, stratum, {v: Curve(f"{v}_score", f"{v}_z") for v in names}, replicas, seed)
    value = {v: F.max(F.when(F.col("curve") == v, F.col("aurc"))) for v in names}
    sums = []
    for name, factors in terms.items():
        whole = F.lit(0.0)
        for v, f in factors.items():
            whole = whole + F.lit(float(f)) * value[v]
        sums.append(whole.alias(name))
    return percentile_interval(areas.groupBy("replica").agg(*sums), list(terms))


def paired_area_delta(paired: DataFrame, stratum: str | None, replicas: int = 10_000, seed: int = 42) -> DataFrame:
    """Point and interval of AURC(a) - AURC(b) with shared weights; ``paired`` has score_a, z_a, score_b, z_b per item."""
    from quorate.operators.selective import aurc

    curves = {k: Curve(f"score_{k}", f"z_{k}") for k in ("a", "b")}
    areas = area_replicas(paired, stratum, curves, replicas, seed)
    pick = lambda k: F.max(F.when(F.col("curve") == k, F.col("aurc")))
    delta = areas.groupBy("replica").agg((pick("a") - pick("b")).alias("delta_aurc"))
    long = paired.select(F.inline(F.array(*[F.struct(F.lit(k).alias("curve"), F.col(f"score_{k}").alias("score"), F.col(f"z_{k}").alias("z")) for k in ("a", "b")])))
    point = aurc(long, ["curve"]).agg((pick("a") - pick("b")).alias("point")).withColumn("statistic", F.lit("delta_aurc"))
    return point.join(percentile_interval(delta, ["delta_aurc"]), "statistic", "left")
