"""Merkle manifest of a dataset in van Emde Boas layout.

Every group of rows (a language) has a binary hash tree over its rows in key order; the trees' roots, in
group order, have one more tree above them. Trees are stored as aligned blocks: a block holds the subtree
over ``1 << LEVELS`` neighbouring nodes, and the roots of blocks are the leaves of the next tier of blocks,
until one block is left. Inside a block nodes lie in van Emde Boas order: the tree is split at half its
height, the top comes first and each bottom tree follows as one stretch, and so on inside each part.
Addresses follow from depth and index alone; building a block and reading a leaf's siblings use the same.

Rows are numbered by a range partition of small digest rows; texts are read once and never shuffled. A
block is one bounded group. Siblings are read block by block from the top tier down: a block hands the
path of each of its leaves to the block below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.llm.common import materialise
from quorate.session import broadcast_if_small

# Levels of edges in a block: it has 1 << LEVELS leaves at most.
LEVELS = 12
# Place of a row inside a partition, in the low bits of Spark's own row numbers.
PLACE_BITS = 33


@cache
def addresses(height: int) -> tuple[np.ndarray, ...]:
    """By depth, the addresses of all nodes of a complete tree of ``height`` levels in van Emde Boas order."""
    if height == 1:
        return (np.zeros(1, np.int64),)
    top = height // 2
    upper, lower = addresses(top), addresses(height - top)
    starts = (1 << top) - 1 + np.arange(1 << top) * ((1 << (height - top)) - 1)
    return (*upper, *((starts[:, None] + own).ravel() for own in lower))


def _joined(nodes: np.ndarray, at: np.ndarray) -> bytes:
    return nodes[at].tobytes().hex().encode()


def levels_of(count: int, levels: int) -> list[int]:
    """Number of nodes at each depth of a block over ``count`` leaves, the root first."""
    out = [count]
    for _ in range(levels):
        out.append(-(-out[-1] // 2))
    return out[::-1]


def build_block(digests: np.ndarray, levels: int) -> np.ndarray:
    """Nodes (address, 32) of the block over leaf digests in order; a node without neighbour is hashed alone."""
    where = addresses(levels + 1)
    nodes = np.zeros(((2 << levels) - 1, 32), np.uint8)
    nodes[where[levels][: len(digests)]] = digests
    counts = levels_of(len(digests), levels)
    for depth in range(levels, 0, -1):
        text = _joined(nodes, where[depth][: counts[depth]])
        found = b"".join(hashlib.sha256(text[i : i + 128]).digest() for i in range(0, len(text), 128))
        nodes[where[depth - 1][: counts[depth - 1]]] = np.frombuffer(found, np.uint8).reshape(-1, 32)
    return nodes


def block_paths(nodes: np.ndarray, count: int, levels: int) -> list[list[str]]:
    """For each leaf of a block its steps to the block's root, lowest first.

    A step is the sibling's digest behind ``L`` if it stands to the left or ``R`` if to the right; it is
    empty where there is no sibling.
    """
    where, counts = addresses(levels + 1), levels_of(count, levels)
    steps = []
    for depth in range(levels, 0, -1):
        text = _joined(nodes, where[depth][: counts[depth]]).decode()
        own = ["RL"[i & 1 ^ 1] + text[64 * i : 64 * i + 64] for i in range(counts[depth])]
        if counts[depth] % 2:
            own.append("")
        steps.append(own)
    return [[own[(i >> level) ^ 1] for level, own in enumerate(steps)] for i in range(count)]


def digest(*fields: str | Column) -> Column:
    """Binary sha256 of fields: each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    parts = []
    for field in fields:
        value = (F.col(field) if isinstance(field, str) else field).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _hex(column: str | Column) -> Column:
    return F.lower(F.hex(column))


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Stored ``rows`` with ``name``: their place in the given order, from 0 without gaps.

    Sorted partitions number their own rows, and the counts of partitions, as many as there are
    partitions, shift them. Equal rows are told apart by the place where they are stored.
    """
    told = rows.withColumn("_told", F.xxhash64(F.monotonically_increasing_id()))
    spread = told.repartitionByRange(*order, "_told").sortWithinPartitions(*order, "_told").drop("_told")
    placed = materialise(spread.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", PLACE_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_shift"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    placed = placed.withColumn("_part", part).join(broadcast_if_small(shifts), "_part")
    return placed.withColumn(name, F.col("_shift") + inside).drop("_part", "_shift", "_at")


BLOCK = "tree bigint, n bigint, block bigint, count int, levels int, nodes binary"


def _blocks(leaves: DataFrame) -> DataFrame:
    """One row per block from (tree, n, place, digest); ``n`` is the number of leaves that the tree has on this tier."""

    def build(table: pa.Table) -> pa.Table:
        place = table.column("place").to_numpy()
        order = np.argsort(place)
        digests = np.frombuffer(b"".join(table.column("digest").to_pylist()), np.uint8).reshape(-1, 32)[order]
        n = table.column("n")[0].as_py()
        levels = min(LEVELS, (n - 1).bit_length())
        nodes = build_block(digests, levels)
        row = {"tree": table.column("tree")[:1], "n": [n], "block": [int(place[0]) >> LEVELS], "count": pa.array([len(place)], pa.int32()), "levels": pa.array([levels], pa.int32()), "nodes": pa.array([nodes.tobytes()], pa.binary())}
        return pa.table(row)

    block = F.shiftright("place", LEVELS).alias("block")
    return leaves.select("tree", "n", block, "place", "digest").groupBy("tree", "block").applyInArrow(build, BLOCK)


def _tiers(leaves: DataFrame, largest: int) -> list[DataFrame]:
    """Stored blocks of all trees, tier by tier; ``largest`` is the number of leaves of the largest tree."""
    out = []
    while True:
        out.append(materialise(_blocks(leaves)))
        if largest <= 1 << LEVELS:
            return out
        largest = -(-largest >> LEVELS)
        above = out[-1].where(F.col("n") > 1 << LEVELS)
        fewer = F.expr(f"(n + {(1 << LEVELS) - 1}) div {1 << LEVELS}")
        leaves = above.select("tree", fewer.alias("n"), F.col("block").alias("place"), F.substring("nodes", 1, 32).alias("digest"))


def _roots(tiers: list[DataFrame]) -> DataFrame:
    """(tree, digest): the root of each tree, which is the first node of its only block of the last tier."""
    tops = [t.where(F.col("n") <= 1 << LEVELS).select("tree", F.substring("nodes", 1, 32).alias("digest")) for t in tiers]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _children(blocks: DataFrame) -> DataFrame:
    """(tree, place, path) of every leaf of blocks with a ``path`` of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, block, count, levels, nodes, path in zip(*(batch.column(i).to_pylist() for i in range(6))):
                inner = block_paths(np.frombuffer(nodes, np.uint8).reshape(-1, 32), count, levels)
                columns = [pa.array([tree] * count, pa.int64()), pa.array(range(block << LEVELS, (block << LEVELS) + count), pa.int64())]
                paths = pa.array([own + path for own in inner], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*columns, paths], names=["tree", "place", "path"])

    return blocks.select("tree", "block", "count", "levels", "nodes", "path").mapInArrow(run, "tree bigint, place bigint, path array<string>")


def _with_paths(tiers: list[DataFrame], of_trees: DataFrame) -> DataFrame:
    """Blocks of the lowest tier with ``path``, the steps from the block's root to the root of all."""
    from_above = None
    for tier in reversed(tiers):
        own = tier.where(F.col("n") <= 1 << LEVELS).join(of_trees, "tree")
        if from_above is not None:
            below = from_above.withColumnRenamed("place", "block")
            own = own.unionByName(tier.where(F.col("n") > 1 << LEVELS).join(below, ["tree", "block"]).select(own.columns))
        out, from_above = own, _children(own)
    return out


@dataclass
class Manifest:
    """Stored tables of a dataset's hash trees.

    ``leaves`` has own (a struct of the carried columns), digest, tree, n and place for every row;
    ``trees`` has group, tree, n, digest (its root) and place for every group; ``tiers`` and ``top`` are the
    blocks of the groups' trees and of the tree above them, lowest tier first.
    """

    leaves: DataFrame
    trees: DataFrame
    tiers: list[DataFrame]
    top: list[DataFrame]
    root: str | None

    def proofs(self) -> DataFrame:
        """The carried columns of every row with ``leaf``, ``subroot`` and ``path`` (see ``block_paths``) to the root of all."""
        nothing = F.array().cast("array<string>")
        top = _with_paths(self.top, _roots(self.top).select("tree", nothing.alias("path")))
        above = self.trees.join(_children(top).drop("tree"), "place")
        above = materialise(above.select("tree", "path", F.col("digest").alias("subroot")))
        blocks = _with_paths(self.tiers, above.select("tree", "path"))

        def read(leaves: pa.Table, block: pa.Table) -> pa.Table:
            nodes = np.frombuffer(block.column("nodes")[0].as_buffer(), np.uint8).reshape(-1, 32)
            inner = block_paths(nodes, block.column("count")[0].as_py(), block.column("levels")[0].as_py())
            above = block.column("path")[0].as_py()
            first = block.column("block")[0].as_py() << LEVELS
            paths = pa.array([inner[p - first] + above for p in leaves.column("place").to_pylist()], pa.list_(pa.string()))
            return pa.table([*(leaves.column(c) for c in ("own", "digest", "tree")), paths], names=["own", "digest", "tree", "path"])

        own = self.leaves.schema["own"].dataType.simpleString()
        leaves = self.leaves.select("own", "digest", "tree", "place", F.shiftright("place", LEVELS).alias("block"))
        met = leaves.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block"))
        found = met.applyInArrow(read, f"own {own}, digest binary, tree bigint, path array<string>")
        found = found.join(broadcast_if_small(above.select("tree", "subroot")), "tree")
        return found.select("own.*", _hex("digest").alias("leaf"), _hex("subroot").alias("subroot"), "path")


def manifest(docs: DataFrame, fields: tuple[str, ...], group: str = "lang", key: str = "doc_id", carry: dict[str, Column] | None = None) -> Manifest:
    """Hash trees over the ``fields`` of all rows of ``docs``, a tree for each value of ``group`` in ascending order of ``key``.

    A null group is a group, the first; null keys come first in theirs. Rows with equal keys are ordered by
    their digests, and equal rows are leaves of their own. ``carry`` names what each row takes along (the
    key by default). Other columns are ignored. An empty table has no trees and no root. A group of one row
    has that row's digest for its root; so has a table of one group that group's.
    """
    carry = {key: F.col(key)} if carry is None else carry
    if clash := {"leaf", "subroot", "path"} & {c.lower() for c in carry}:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    own = F.struct(*[c.alias(name) for name, c in carry.items()])
    # Digests are stored before they are sorted: sampling their order does not read the texts again.
    rows = materialise(docs.select(F.col(group).alias("_group"), F.col(key).alias("_key"), digest(*fields).alias("digest"), own.alias("own")))
    rows = _numbered(rows, ["_group", "_key", "digest"], "_index")
    trees = materialise(rows.groupBy("_group").agg(F.min("_index").alias("tree"), F.count("*").alias("n")))
    largest, groups = trees.agg(F.max("n"), F.count("*")).first()
    small = trees.select(F.col("_group").alias("_its"), "tree", "n")
    leaves = rows.join(broadcast_if_small(small), F.col("_group").eqNullSafe(F.col("_its")))
    leaves = leaves.select("own", "digest", "tree", "n", (F.col("_index") - F.col("tree")).alias("place"))
    tiers = _tiers(leaves, largest or 0)
    # Trees start in the order of their groups.
    trees = _numbered(materialise(trees.join(_roots(tiers), "tree")), ["tree"], "place")
    trees = materialise(trees.withColumnRenamed("_group", "group"))
    top = _tiers(trees.select(F.lit(-1).cast("bigint").alias("tree"), F.lit(groups).cast("bigint").alias("n"), "place", "digest"), groups)
    root = _roots(top).select(_hex("digest")).first()
    return Manifest(leaves, trees, tiers, top, root[0] if root else None)


def proof_text(path: str | Column = "path") -> Column:
    """All siblings of a path, one after another."""
    return F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), "")


def folded(leaf: Column, path: str | Column = "path") -> Column:
    """The root that a leaf and its path lead to."""

    def up(node: Column, step: Column) -> Column:
        other = F.substring(step, 2, 64)
        return F.sha2(F.when(step.startswith("L"), F.concat(other, node)).otherwise(F.concat(node, other)), 256)

    return F.aggregate(path, leaf, up)
