"""Training-order materialisation of token ids.

Texts become a stream of token ids in fixed-length sequences. Every sequence has a dense number; a keyed Feistel
permutation of the numbers, with cycle-walking where the domain is no power of four, gives each its global
slot without any sort. Slots are dealt by range to shards of a fixed number of records, and every record
has the same stride, so the record of a slot is found by arithmetic: a run that stopped after any number
of slots goes on by reading from there.

Shards are written by Spark's text writer as raw bytes: a record is its ids in little-endian order and one
line break. Each shard is one folder; a shard that is already complete is not written again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.llm.common import text_blocks

LENGTH = 512
# Bytes that occur in no UTF-8 text.
END, PAD = 0xFF, 0xFE
# Records of one shard.
RECORDS = 65_536
ROUNDS = 6


@dataclass(frozen=True)
class Layout:
    """Where records are: ``count`` records of ``length`` one-byte ids, ``records`` to a shard."""

    count: int
    length: int = LENGTH
    records: int = RECORDS

    @property
    def stride(self) -> int:
        return self.length + 1

    @property
    def shards(self) -> int:
        return -(-self.count // self.records)

    def at(self, slot: int) -> tuple[int, int]:
        """Shard of a slot and the place of its record in the shard, in bytes."""
        return slot // self.records, slot % self.records * self.stride


def permuted(numbers: np.ndarray, count: int, key: int) -> np.ndarray:
    """Slot of each number in 0 .. count - 1 by a keyed permutation of that range."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(half), out[walking] & mask
        for r in range(ROUNDS):
            mixed = right + np.uint64(key & (1 << 64) - 1) + np.uint64(0x9E3779B97F4A7C15 * (r + 1) & (1 << 64) - 1)
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(31))) & mask)
        out[walking] = (left << np.uint64(half)) | right
        # A value beyond the range is permuted again until it falls inside.
        walking = walking[out[walking] >= np.uint64(count)]
    return out.astype(np.int64)


def records(docs: DataFrame, key: int, length: int = LENGTH, per_shard: int = RECORDS) -> tuple[DataFrame, Layout]:
    """(doc_id, slot, n_tokens, record) for every sequence, and the layout.

    Token ids are the UTF-8 bytes of the texts, each followed by END; a null text is empty. The texts of a
    partition are one stream, cut into sequences of ``length``; only its last sequence is filled up, with
    PAD. ``doc_id`` is that of the text in which the sequence begins. Sequences are numbered by partition of
    ``docs`` and place in it: sizes per partition are summed first (a number per partition), so ``docs`` must
    be a stored table, whose partitions and their rows are the same each time it is read; a change is
    noticed and refused. Repeated rows are written each time; columns other than doc_id and text are ignored.
    """
    rows = docs.select("doc_id", "text")
    tokens = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    counted = rows.groupBy(F.spark_partition_id().alias("p")).agg(tokens.alias("n")).collect()
    sizes = {r["p"]: -(-r["n"] // length) for r in counted}
    places = sorted(sizes)
    first = dict(zip(places, (np.cumsum([0, *[sizes[p] for p in places]])[:-1]).tolist()))
    layout = Layout(sum(sizes.values()), length, per_shard)
    changed = "the table's partitions changed between two reads; store it first"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, end = first.get(part, 0), first.get(part, 0) + sizes.get(part, 0)
        rest, rest_id = np.zeros(0, np.uint8), None

        def batch_of(ids: pa.Array, flat: np.ndarray, filled: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            n = len(filled)
            slots = permuted(number + np.arange(n), layout.count, key)
            number += n
            if number > end:
                raise RuntimeError(changed)
            ends = np.arange(n + 1, dtype=np.int32) * length
            raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            return pa.RecordBatch.from_arrays([ids, pa.array(slots), pa.array(filled.astype(np.int32)), raw], names=["doc_id", "slot", "n_tokens", "record"])

        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                n = np.diff(offsets)
                start = len(rest) + offsets[:-1] + np.arange(len(n))
                stream = np.empty(len(rest) + len(data) + len(n), np.uint8)
                stream[: len(rest)] = rest
                stream[np.arange(len(data)) + np.repeat(start - offsets[:-1], n)] = data
                stream[start + n] = END
                ids, begin = batch.column(0).slice(lo, hi - lo), start
                if len(rest):
                    ids, begin = pa.concat_arrays([rest_id, ids]), np.append(0, start)
                whole = len(stream) // length
                owner = np.searchsorted(begin, np.arange(whole + 1) * length, side="right") - 1
                if whole:
                    yield batch_of(ids.take(pa.array(owner[:-1])), stream[: whole * length].copy(), np.full(whole, length))
                rest = stream[whole * length :]
                rest_id = ids.slice(int(owner[-1]), 1)
        if len(rest):
            yield batch_of(rest_id, np.append(rest, np.full(length - len(rest), PAD, np.uint8)), np.array([len(rest)]))
        if number != end:
            raise RuntimeError(changed)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, slot bigint, n_tokens int, record binary"), layout


def _complete(spark: SparkSession, folder: str, layout: Layout) -> set[int]:
    """Shards whose folder holds one file of the right size."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return set()
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    found = listed.select(F.regexp_extract("path", r"/shard=(\d+)/", 1).cast("int").alias("shard"), "length").groupBy("shard").agg(F.sum("length").alias("bytes"))
    want = lambda s: (min(layout.count, (s + 1) * layout.records) - s * layout.records) * layout.stride
    return {r["shard"] for r in found.collect() if r["bytes"] == want(r["shard"])}


def write_shards(found: DataFrame, layout: Layout, folder: str) -> int:
    """Write the shards of ``found`` that ``folder`` does not hold complete; returns how many were written.

    Each shard is one task, whose number is the shard's: rows go there without sampling or sorting the whole.
    A shard that was left incomplete is replaced. Memory of a task is that of a sort of one shard.
    """
    spark = found.sparkSession
    done = _complete(spark, folder, layout)
    todo = [s for s in range(layout.shards) if s not in done]
    if not todo:
        return 0
    shard = (F.col("slot") / layout.records).cast("int")
    rows = found.select(shard.alias("shard"), "slot", F.col("record").cast("string").alias("value"))
    if done:
        rows = rows.where(~F.col("shard").isin([int(s) for s in done]))
    rows = rows.repartitionById(layout.shards, F.col("shard")).sortWithinPartitions("shard", "slot").select("shard", "value")
    # Only the folders of shards that are written are replaced.
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").text(folder)
    return len(todo)


def read_shards(spark: SparkSession, layout: Layout, folder: str) -> DataFrame:
    """(shard, slot, n_tokens, record) of every record, read back by stride from the shards' files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    shards = files.select(F.regexp_extract("path", r"/shard=(\d+)/", 1).cast("int").alias("shard"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                flat = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, layout.stride)
                for lo in range(0, len(flat), 4096):
                    part = np.ascontiguousarray(flat[lo : lo + 4096, : layout.length])
                    n = len(part)
                    ends = np.arange(n + 1, dtype=np.int32) * layout.length
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, shard, np.int32)),
                            pa.array(np.arange(n) + lo + shard * layout.records),
                            pa.array((part != PAD).sum(axis=1).astype(np.int32)),
                            pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(part)]),
                        ],
                        names=["shard", "slot", "n_tokens", "record"],
                    )

    return shards.mapInArrow(run, "shard int, slot bigint, n_tokens int, record binary")
