"""Sharding by a minimax contiguous partition of ordered atomic groups.

Equal texts are one group, in the order of their hash. The smallest capacity is searched for which the
groups, taken in order, fill at most the wanted number of shards; a capacity is checked greedily, each
shard reaching as far as the capacity lets it. Shards are cut where the check of the smallest feasible
capacity cuts.

Group sizes stay on the cluster as a table of their own, bucketed by hash. The driver holds one total
per bucket, of which there is a fixed number, and reads single buckets of group sizes where a greedy
step ends; a bucket of more groups than it may hold is summed up by its next bits first, as often as need
be. A row's shard follows from comparing its hash with the cuts, without a join.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.llm.common import fresh, materialise

# Buckets of group sizes by the leading bits of the hash.
BUCKET_BITS = 14
# Groups read to the driver at once and kept, at most.
READ_GROUPS = 200_000
# Cells in which the rows of a shard are numbered: leading bits of the text's hash, and parts of the row's own hash.
CELL_BITS = 8
CELL_PARTS = 128


def group_key(text: str = "text") -> Column:
    """Order of the groups: equal texts have equal keys."""
    return F.xxhash64(F.col(text))


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def _bucket(key: Column, bits: int) -> Column:
    """Leading bits of a signed hash, in its order."""
    return (F.shiftright(key, 64 - bits) + (1 << (bits - 1))).cast("int")


class Groups:
    """Ordered group sizes: totals of buckets here, the sizes themselves on the cluster."""

    def __init__(self, sizes: DataFrame) -> None:
        """``sizes``: (key, bytes), one row per group."""
        # Sorted inside its files, so that reading a few buckets skips most of each.
        self.table = materialise(sizes.withColumn("bucket", _bucket(F.col("key"), BUCKET_BITS)).sortWithinPartitions("bucket", "key"))
        self.read: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        self.level = Level(self, self.table, 0)
        self.total, self.largest = self.level.total, self.level.largest

    def keep(self, found: dict[tuple[int, int], tuple[list[int], list[int]]]) -> None:
        if sum(len(k) for k, _ in (*self.read.values(), *found.values())) > 4 * READ_GROUPS:
            self.read.clear()
        self.read.update(found)

    def reach(self, position: int) -> tuple[int, int | None]:
        """Largest group end at or before ``position``, and the key of the group that follows (None at the end)."""
        return self.level.reach(position)


class Level:
    """Totals of the buckets by some more bits of a hash, among groups that share the bits before."""

    def __init__(self, groups: Groups, rows: DataFrame, depth: int) -> None:
        """``rows`` are the groups of the level; ``depth`` bits of their hashes are the same."""
        self.groups, self.rows, self.depth = groups, rows, depth
        self.bits = min(BUCKET_BITS, 64 - depth)
        counted = rows.groupBy(self._part(F.col("key")).alias("part")).agg(F.sum("bytes"), F.count("*"), F.max("bytes"), F.min("key")).collect()
        counted = sorted(tuple(r) for r in counted)
        self.parts = [r[0] for r in counted]
        self.counts = [r[2] for r in counted]
        self.firsts = [r[4] for r in counted]
        self.starts = [0, *np.cumsum([r[1] for r in counted]).tolist()]
        self.total = self.starts[-1]
        self.largest = max((r[3] for r in counted), default=0)
        self.inner: dict[int, Level] = {}

    def _part(self, key: Column) -> Column:
        if not self.depth:
            return _bucket(key, BUCKET_BITS)
        return F.shiftrightunsigned(F.shiftleft(key, self.depth), 64 - self.bits).cast("int")

    def _chosen(self, lo: int, hi: int) -> DataFrame:
        """Groups of the parts from number ``lo`` to ``hi``."""
        if not self.depth:
            return self.rows.where(F.col("bucket").between(self.parts[lo], self.parts[hi]))
        return self.rows.where(self._part(F.col("key")).between(self.parts[lo], self.parts[hi]))

    def _sizes(self, i: int) -> tuple[list[int], list[int]]:
        """Keys and running totals inside part number ``i``, with neighbours read along."""
        read, name = self.groups.read, lambda j: (self.depth, self.firsts[j])
        if name(i) not in read:
            since, upto, held = i, i + 1, self.counts[i]
            while since > 0 and name(since - 1) not in read and held + self.counts[since - 1] <= READ_GROUPS // 2:
                since -= 1
                held += self.counts[since]
            while upto < len(self.parts) and name(upto) not in read and held + self.counts[upto] <= READ_GROUPS:
                held += self.counts[upto]
                upto += 1
            got = self._chosen(since, upto - 1).select("key", "bytes").toArrow()
            key, size = got.column("key").to_numpy(), got.column("bytes").to_numpy()
            order = np.argsort(key)
            key, size = key[order], size[order]
            edges = np.searchsorted(key, [*self.firsts[since:upto]]).tolist() + [len(key)]
            found = {name(since + j): (key[lo:hi].tolist(), np.cumsum(size[lo:hi]).tolist()) for j, (lo, hi) in enumerate(zip(edges, edges[1:]))}
            self.groups.keep(found)
            return found[name(i)]
        return read[name(i)]

    def reach(self, position: int) -> tuple[int, int | None]:
        if position >= self.total:
            return self.total, None
        i = bisect.bisect_right(self.starts, position) - 1
        inside = position - self.starts[i]
        if self.counts[i] > READ_GROUPS and self.depth + self.bits < 64:
            if i not in self.inner:
                self.inner[i] = Level(self.groups, self._chosen(i, i), self.depth + self.bits)
            end, key = self.inner[i].reach(inside)
        else:
            keys, ends = self._sizes(i)
            k = bisect.bisect_right(ends, inside)
            end, key = (ends[k - 1] if k else 0), keys[k]
        return self.starts[i] + end, key


def smallest_capacity(groups: Groups, shards: int) -> int:
    """Smallest capacity with which greedy filling needs at most ``shards`` shards."""

    def fits(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            at, _ = groups.reach(at + capacity)
            if at == groups.total:
                return True
        return False

    low = max(groups.largest, -(-groups.total // shards))
    high = -(-groups.total // shards) + groups.largest
    while low < high:
        middle = (low + high) // 2
        if fits(middle):
            high = middle
        else:
            low = middle + 1
    return low


def cuts(groups: Groups, shards: int) -> list[int]:
    """First key of each shard after the first; fewer if fewer shards are filled."""
    capacity, at, out = smallest_capacity(groups, shards), 0, []
    for _ in range(shards - 1):
        at, following = groups.reach(at + capacity)
        if following is None:
            break
        out.append(following)
    return out


def assign_shards(docs: DataFrame, shards: int = 16, carry: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with ``shard``, ``slot`` and ``size``: bytes near equal, copies of a text together.

    The size of a row is its text's UTF-8 bytes (null: none) plus 1. Null texts are one group, empty texts
    another. Slots of a shard count from 0 without gaps, in the order of cells of text hashes and of where the
    rows are stored; equal rows get different slots, and a row that repeats very often lies in many cells. The largest shard is as small as contiguous groups in hash order allow.
    An empty table gives no rows. Carried columns named like an added one are refused. Texts that are not
    carried are not shuffled.
    """
    carry = tuple(docs.columns) if carry is None else carry
    clash = {"shard", "slot", "size"} & {c.lower() for c in carry}
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    key, part, size, cell, place, base = fresh(docs, "group_key", "row_part", "row_size", "cell", "place", "base")
    # A row's own number tells equal rows apart; it is written, so that every later read finds the same.
    own = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(CELL_PARTS)).cast("int")
    rows = materialise(docs.select(*carry, group_key().alias(key), own.alias(part), size_of().alias(size)))
    groups = Groups(rows.groupBy(F.col(key).alias("key")).agg(F.sum(size).alias("bytes")))
    shard = F.lit(0)
    for bound in cuts(groups, shards):
        shard = shard + (F.col(key) >= bound).cast("int")
    rows = rows.withColumn("shard", shard).withColumn(cell, _bucket(F.col(key), CELL_BITS) * CELL_PARTS + F.col(part))
    # A fixed number of cells, and at most one more bucket for each cut.
    counted = materialise(rows.groupBy("shard", cell).agg(F.count("*").alias("n")))
    before = Window.partitionBy("shard").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select("shard", cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy("shard", cell).orderBy(key, *(["doc_id"] if "doc_id" in carry else []))
    rows = rows.withColumn(place, F.row_number().over(inside)).join(F.broadcast(counted), ["shard", cell])
    slot = (F.col(base) + F.col(place) - 1).cast("bigint")
    return rows.select(*carry, "shard", slot.alias("slot"), F.col(size).alias("size"))
