"""SimHash near-duplicates by a binary trie self-join on 64-bit fingerprints.

Every text becomes one fingerprint; equal fingerprints are one node. Two tries are walked together:
a pair of trie nodes carries the bits in which their paths differ, and a pair that exceeds the error
budget is dropped with everything below it.

A pair of fingerprints within ``max_bits`` of each other has, in at least one of R equal bit ranges,
at most ``max_bits // R`` differing bits. The walk is therefore made R times, each with another range
in front and the smaller budget while inside it; this keeps the walk thin without losing a pair.

On the cluster the top of the trie is a shuffle key: a fingerprint goes to its own prefix and, as a
guest, to the prefixes that differ from it in one set bit (so each pair of prefixes meets once). A
prefix with many fingerprints is split into blocks of bounded size, each of which meets the others.
A task returns only the links of a spanning forest of what it found, never all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import fresh, materialise
from quorate.llm.components import components

BITS = 64
RANGES = 4
SEED = 42
# Fingerprints of one prefix that one task takes as the left side of its walk.
BLOCK = 8192
# Node pairs of at most so many fingerprint pairs are compared directly.
LEAF_PAIRS = 256
# Fingerprint pairs compared at once.
BATCH_PAIRS = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def shingles(text: bytes, width: int) -> np.ndarray:
    """Hashes of the word shingles of a text in order, repeats included; a shorter text is one shingle."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, len(words) - width + 1)


def fingerprint(text: bytes, width: int = 4) -> int:
    """SimHash of the word shingles of a text, repeats included; 0 for a text without words."""
    hashes = shingles(text, width)
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) for every row of ``docs`` (doc_id, text); other columns are ignored.

    Null and empty texts, and texts of white space only, get fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in batch.column(1)]
            fps = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def links(nodes: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all pairs within ``max_bits``.

    ``nodes`` has one column ``fp``, distinct. Pairs that are linked only through others may be left
    out, as long as they stay connected.
    """
    n = nodes.count()
    part = BITS // RANGES
    near = max_bits // RANGES
    if near > 1:
        raise ValueError("max_bits must be below 8: prefixes meet those that differ in at most one bit")
    depth = min(part, max(4, math.ceil(math.log2(max(n, 1) / 512 + 1))))
    x = F.col("x")
    turned = nodes.select(F.explode(F.array(*[F.lit(r) for r in range(RANGES)])).alias("r"), "fp")
    turned = turned.select("r", _rotated("fp", "r", part).alias("x"))
    prefix = F.shiftrightunsigned(x, BITS - depth)
    own = turned.select("r", "x", prefix.alias("p"))
    # At most RANGES * 2 ** depth rows, and depth is at most 16: small whatever the input.
    crowded = own.groupBy("r", "p").count().where(F.col("count") > BLOCK)
    crowded = crowded.select("r", "p", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    bits = F.array(*[F.lit(1 << j).cast("bigint") for j in range(depth)])
    guest_of = F.filter(bits, lambda b: F.col("p").bitwiseAND(b) != 0) if near else F.array().cast("array<bigint>")
    placed = own.select(
        "r", "x", F.explode(F.concat(F.array(F.struct(F.col("p").alias("p"), F.lit(True).alias("own"))),
            F.transform(guest_of, lambda b: F.struct(F.col("p").bitwiseXOR(b).alias("p"), F.lit(False).alias("own"))))).alias("k"),
    ).select("r", "x", "k.p", "k.own")
    placed = placed.join(F.broadcast(crowded), ["r", "p"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")
    placed = placed.withColumn("block", F.when(F.col("own"), block))
    meets = F.sequence(F.lit(0), F.coalesce("block", F.col("blocks") - 1))
    placed = placed.select("r", "p", "x", "block", F.explode(meets).alias("b"))
    placed = placed.select("r", "p", "b", "x", (F.coalesce("block", F.lit(-1)) == F.col("b")).alias("left"))

    def walk(table: pa.Table) -> pa.Table:
        x = table.column("x").to_numpy().view(np.uint64)
        left = table.column("left").to_numpy()
        r = table.column("r")[0].as_py()
        ends = forest(np.sort(x[left]), np.sort(x[~left]), depth, part, near, max_bits)
        back = [_rotate_back(v, r * part).view(np.int64) for v in ends]
        return pa.table({"a": back[0], "b": back[1]})

    return placed.groupBy("r", "p", "b").applyInArrow(walk, "a bigint, b bigint")


def _rotated(fp: str, r: str, part: int) -> F.Column:
    """Range ``r`` of the fingerprint in front."""
    out = F.col(fp)
    for k in range(1, RANGES):
        turned = F.shiftleft(F.col(fp), k * part).bitwiseOR(F.shiftrightunsigned(F.col(fp), BITS - k * part))
        out = F.when(F.col(r) == k, turned).otherwise(out)
    return out


def _rotate_back(x: np.ndarray, by: int) -> np.ndarray:
    return x if not by else (x >> np.uint64(by)) | (x << np.uint64(BITS - by))


def forest(left: np.ndarray, right: np.ndarray, depth: int, part: int, near: int, max_bits: int):
    """Links (child, root) of a spanning forest over all pairs within the budget that have an end in ``left``.

    Both arrays are sorted; all of ``left`` shares the first ``depth`` bits, ``right`` differs there in
    ``near`` bits at most. Inside the first ``part`` bits the budget is ``near``, below it ``max_bits``.
    """
    values = np.concatenate((left, right))
    n = len(left)
    parent = np.arange(len(values))
    shift = np.uint64(BITS - depth)
    if n:
        heads, first = np.unique(right >> shift, return_index=True)
        err = np.bitwise_count(heads ^ (left[0] >> shift)).astype(np.int64)
        cuts = np.append(first, len(right)) + n
        frontier = (
            np.concatenate(([0], np.zeros(len(heads), np.int64))),
            np.concatenate(([n], np.full(len(heads), n))),
            np.concatenate(([0], cuts[:-1])).astype(np.int64),
            np.concatenate(([n], cuts[1:])).astype(np.int64),
            np.concatenate(([0], err)),
        )
        d = depth
        while len(frontier[0]):
            a0, a1, b0, b1, err = frontier
            budget = near if d < part else max_bits
            small = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (d == BITS)
            for i, j in _pairs(a0[small], a1[small], b0[small], b1[small]):
                close = np.bitwise_count(values[i] ^ values[j]) <= max_bits
                _unite(parent, i[close], j[close])
            a0, a1, b0, b1, err = (v[~small] for v in frontier)
            if not len(a0):
                break
            am, bm = _split(values, n, a0, a1, d), _split(values, n, b0, b1, d)
            same = (a0 == b0) & (a1 == b1)
            kids = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), (am[~same], a1[~same], b0[~same], bm[~same], err[~same] + 1)]
            frontier = tuple(np.concatenate([k[c] for k in kids]) for c in range(5))
            d += 1
            budget = near if d <= part else max_bits
            alive = (frontier[0] < frontier[1]) & (frontier[2] < frontier[3]) & (frontier[4] <= budget)
            frontier = tuple(v[alive] for v in frontier)
    root = parent
    moved = np.flatnonzero(root != np.arange(len(values)))
    return values[moved], values[root[moved]]


def _split(values: np.ndarray, n: int, lo: np.ndarray, hi: np.ndarray, d: int) -> np.ndarray:
    """First place of each range whose bit ``d`` (from the front) is set."""
    bit = np.uint64(1 << (BITS - 1 - d))
    last = values[hi - 1]
    wanted = (last & ~np.uint64((1 << (BITS - d)) - 1)) | bit
    in_left = np.searchsorted(values[:n], wanted)
    in_right = np.searchsorted(values[n:], wanted) + n
    return np.clip(np.where(lo < n, in_left, in_right), lo, hi)


def _pairs(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the node pairs, in batches of bounded size."""
    na, nb = a1 - a0, b1 - b0
    total = na * nb
    # A pair of nodes beyond the batch size is cut along its left side.
    while len(total):
        upto = int(np.searchsorted(np.cumsum(total), BATCH_PAIRS, side="right"))
        if upto == 0:
            rows = max(1, BATCH_PAIRS // int(nb[0]))
            for lo in range(int(a0[0]), int(a1[0]), rows):
                i = np.arange(lo, min(lo + rows, int(a1[0])))
                j = np.arange(int(b0[0]), int(b1[0]))
                yield np.repeat(i, len(j)), np.tile(j, len(i))
            upto = 1
        else:
            t = total[:upto]
            node = np.repeat(np.arange(upto), t)
            k = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
            yield a0[node] + k // nb[node], b0[node] + k % nb[node]
        a0, a1, b0, b1, na, nb, total = (v[upto:] for v in (a0, a1, b0, b1, na, nb, total))


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of the pairs; every set keeps its smallest index as root."""
    while len(i):
        ri, rj = parent[i], parent[j]
        apart = ri != rj
        if not apart.any():
            return
        i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
        np.minimum.at(parent, np.maximum(ri, rj), np.minimum(ri, rj))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable through links of ``max_bits`` or fewer.

    One row per row of ``docs``. Null, empty and white-space texts share fingerprint 0, which links
    like any other. Rows with a null doc_id take part in links but never name a component (null only
    if the whole component has no doc_id). Repeated rows fall together. An empty table gives no rows.
    """
    signed = materialise(fingerprints(docs, width))
    least = signed.groupBy("fp").agg(F.min("doc_id").alias("first"))
    least = materialise(least)
    roots = components(links(least.select("fp"), max_bits))
    named = least.join(roots, least["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    named = named.join(named.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    return signed.join(named.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """Rows of ``docs`` that stay when one document of each near-duplicate group is kept.

    The document with the smallest doc_id of its group stays; of several rows with that doc_id in one
    group, one. Rows without doc_id in a group that has one go; if none has one, one row stays. All
    columns of ``docs`` are returned unchanged.
    """
    key, mark, rank = fresh(docs, "row_key", "row_text", "row_rank")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    # doc_id and text together name a row; several rows of one doc_id are told apart by their texts.
    ids = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text")
    groups = materialise(fingerprints_of_keys(ids, width))
    least = materialise(groups.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")).alias("first")))
    roots = components(links(least.select("fp"), max_bits))
    named = least.join(roots, least["fp"] == roots["node"], "left").select(F.coalesce("root", "fp").alias("root"), "first")
    keepers = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(mark), F.col("first.h").alias(rank))
    kept = keyed.join(keepers, keyed["doc_id"].eqNullSafe(keepers[mark]) & (keyed[key] == keepers[rank]), "left_semi")
    from pyspark.sql import Window

    # Identical rows of one document: only rows of equal doc_id and text meet here.
    order = Window.partitionBy("doc_id", key).orderBy(F.lit(0))
    return kept.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*docs.columns)


def fingerprints_of_keys(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, h, fp) of rows whose doc_id is a struct of both."""
    return fingerprints(rows, width).select("doc_id.doc_id", "doc_id.h", "fp")
