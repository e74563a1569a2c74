"""Near copies by word shingles: SimHash links first, then an exact similarity join.

Two texts are near copies if the Jaccard similarity of their sets of word shingles is at least
``SIMILAR``. The SimHash trie finds most of them cheaply; what it proposes is confirmed on the sets. It
cannot find all, since texts of that similarity differ in some ten bits of 64, so a prefix join completes
it: in any fixed order of all shingles, two similar sets meet in their prefixes, the first
n - ceil(SIMILAR * n) + 1 shingles of a set of n. The order puts shingles that a sample of the texts
repeats last, so that common passages are rarely in a prefix, and before them those of frequent words: they are
what texts share by chance, in numbers that grow with the square of the texts. Any order finds all pairs.

One pass over the texts writes, for every row, a key of its words, the size of its set, a fingerprint, the
prefix and a bitmap of the set; all that follows reads those narrow rows. Size and bitmap bound the overlap of
two sets from above, so only pairs that pass are compared as sets, and only their texts are read again. A large
set fills the bitmap, so it has another one of a bit a shingle, which goes with its pairs alone.
Texts of a shingle that few share all meet, as far as its place in either prefix and folded bitmaps leave room; those of a crowded one meet first its text of smallest key, which
joins groups of copies by as many comparisons as they have members, and then, where they are not connected
yet, each other in blocks of bounded size.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.llm import simhash_trie
from quorate.llm.common import fresh, materialise, span_hashes, text_blocks
from quorate.llm.components import components
from quorate.session import Scratch, broadcast_if_small

WIDTH = 5
# Similarity as a fraction of integers.
SIMILAR = (4, 5)
# Texts whose shingles are counted for the order: one in SHARE, but SAMPLE at least and SHARE times that at most; and how
# many repeated shingles it keeps.
SAMPLE = 8192
SHARE = 4
COMMON = 50_000
# Frequent words that the order knows, and steps of the logarithm of their number to base 2.
WORDS = 50_000
STEPS = 16
# Words of 64 bits in the bitmap of a set.
BITMAP = 16
# Words of the folded bitmap that goes with every rare shingle.
SKETCH = 4
# Bits that SimHash links may differ in.
MAX_BITS = 7
# Rows with one shingle that all meet, and texts of a block beyond.
FEW = 32
BLOCK = 2048
# Shingles sent to all tasks at most, 8 to 16 bytes each.
SHINGLES = 2_000_000

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_STEP = np.uint64(0xD6E8FEB86659FD93)


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all words of a block of texts, A-Z lower-cased, in order."""
    low = _LOWER[data]
    inside = ~_BLANK[low]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    start[heads] |= inside[heads]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | start[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return span_hashes(low, s, e), np.searchsorted(offsets, s, side="right") - 1


def block_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, shingle, text) of a block: the key of the words of each text, and its distinct shingles, ascending text by text.

    A text of fewer words than ``width`` is one shingle; one without words has none and key 0.
    """
    return weighed_sets(data, offsets, width, np.zeros(0, np.uint64), np.zeros(0, np.int64))[:3]


def _listed(values: np.ndarray, listed: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Numbers of the values in a sorted list; 0 for others."""
    if not len(listed):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
    return np.where(listed[at] == values, numbers[at], 0)


def weighed_sets(data: np.ndarray, offsets: np.ndarray, width: int, known: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``block_sets`` and the weight of each shingle: the sum over its words, of which ``known`` (sorted) have one; 0 for shorter texts."""
    words, owner = text_words(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(owner, minlength=n)
    first = np.cumsum(counts) - counts
    keys = np.where(counts > 0, span_hashes(words, first, first + counts), np.uint64(0))
    runs = max(0, len(words) - width + 1)
    value = np.zeros(runs, np.uint64)
    weight = np.zeros(runs, np.int64)
    each = _listed(words, known, weights)
    for j in range(width):
        value = value * _STEP + words[j : j + runs]
        weight += each[j : j + runs]
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(29)
    whole = owner[:runs] == owner[width - 1 :] if runs else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < width))
    value, text = np.concatenate((value[whole], keys[short])), np.concatenate((owner[:runs][whole], short))
    weight = np.concatenate((weight[whole], np.zeros(len(short), np.int64)))
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return keys, value[new], text[new], weight[order][new]


def _prefixes(value: np.ndarray, text: np.ndarray, weight: np.ndarray, sizes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, number for each text): of every set those that a near copy must share one of; ``common`` is sorted."""
    up, down = SIMILAR
    # A shingle's place in the order is its own, the same in every text.
    rank = (_listed(value, common, counts) << 32) + weight
    order = np.lexsort((value, rank, text))
    lengths = np.where(sizes > 0, sizes - -(-up * sizes // down) + 1, 0)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(value)) - np.repeat(first, sizes)
    return value[order[place < np.repeat(lengths, sizes)]], lengths


def _bitmaps(value: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """(text, word): every shingle flips one bit, so sets differ in at least as many elements as their bitmaps in bits."""
    out = np.zeros(n * BITMAP, np.uint64)
    bit = value & np.uint64(64 * BITMAP - 1)
    np.bitwise_xor.at(out, text * BITMAP + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(n, BITMAP)


def _wide_bitmaps(value: np.ndarray, text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, number for each text): a bitmap of a bit a shingle at least, a power of two, for sets that fill ``_bitmaps``; none for others."""
    large = sizes > 64 * BITMAP
    words = np.where(large, 1 << np.ceil(np.log2(np.maximum(sizes, 1) / 64)).clip(0).astype(np.int64), 0)
    out = np.zeros(int(words.sum()), np.uint64)
    first = np.cumsum(words) - words
    own = large[text]
    value, text = value[own], text[own]
    at = (value >> np.uint64(6)).astype(np.int64) & (words[text] - 1)
    np.bitwise_xor.at(out, first[text] + at, np.uint64(1) << (value & np.uint64(63)))
    return out, words


def wide_apart(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which wide bitmaps differ, the longer one folded: at most the elements in which the sets do; 0 if one is missing."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum()) if len(a) else 0


def _fingerprints(value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash of each set; 0 for an empty one."""
    out = np.zeros(len(sizes), np.uint64)
    first = np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes)
    for bit in range(64):
        ones = np.add.reduceat((value >> np.uint64(bit) & np.uint64(1)).astype(np.int32), first[some]) if len(some) else np.zeros(0, int)
        out[some] |= (2 * ones > sizes[some]).astype(np.uint64) << np.uint64(bit)
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are near copies; two empty sets are."""
    up, down = SIMILAR
    if min(len(a), len(b)) * down < max(len(a), len(b)) * up:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * down >= (len(a) + len(b) - both) * up


def most_apart(n: int | np.ndarray | Column, m: int | np.ndarray | Column) -> int | np.ndarray | Column:
    """Elements in which near copies of ``n`` and ``m`` shingles may differ at most."""
    up, down = SIMILAR
    least = F.ceil((n + m) * up / (up + down)) if isinstance(n, Column) else -(-(n + m) * up // (up + down))
    return n + m - 2 * least


def _sized(n: str, m: str) -> Column:
    up, down = SIMILAR
    return F.least(n, m) * down >= F.greatest(n, m) * up


def _close(a: str, b: str) -> Column:
    """Whether sizes and bitmaps of two structs (key, n, bits) leave room for the wanted overlap."""
    apart = F.aggregate(F.zip_with(f"{a}.bits", f"{b}.bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return _sized(f"{a}.n", f"{b}.n") & (apart <= most_apart(F.col(f"{a}.n"), F.col(f"{b}.n")))


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values.view(np.int64)))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def sampled_texts(docs: DataFrame) -> DataFrame:
    """(text): SAMPLE texts or a few times as many, chosen by hash; they serve the order alone."""
    n = docs.count()
    every = max(1, min(n // SAMPLE, max(SHARE, n // (SHARE * SAMPLE))))
    return docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)


def sampled_shingles(texts: DataFrame, width: int) -> DataFrame:
    """(s, key): the shingles of the texts, by their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                keys, value, text = block_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays([_signed(value), _signed(keys[text])], names=["s", "key"])

    return texts.mapInArrow(run, "s bigint, key bigint")


def _sorted(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of a small table (s, count), sorted."""
    table = counted.toArrow()
    values, counts = table.column("s").to_numpy().view(np.uint64), table.column("count").to_numpy()
    order = np.argsort(values)
    return values[order], counts[order]


def common_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sampled texts have, sorted, with their numbers of texts; at most COMMON."""
    # Dealt by shingle, equal pairs and counts need no further shuffle.
    counted = sampled_shingles(texts, width).repartition("s").distinct().groupBy("s").count().where("count > 1")
    return _sorted(counted.orderBy(F.desc("count"), "s").limit(COMMON))


def frequent_words(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words of sampled texts, sorted, with weights that grow with the logarithm of their number; at most WORDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                words, counts = np.unique(text_words(data, offsets)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(words), pa.array(counts.astype(np.int64))], names=["s", "n"])

    counted = texts.mapInArrow(run, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("count"))
    words, counts = _sorted(counted.where("count > 1").orderBy(F.desc("count"), "s").limit(WORDS))
    return words, np.rint(STEPS * np.log2(counts.astype(np.float64))).astype(np.int64)


def described(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, h, key, n, fp, bits, prefix, wide) of every row of ``docs``; ``h`` is Spark's own hash of the text."""
    sampled = sampled_texts(docs)
    common, counts = common_shingles(sampled, width)
    known, weights = frequent_words(sampled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(2)):
                keys, value, text, weight = weighed_sets(data, offsets, width, known, weights)
                sizes = np.bincount(text, minlength=hi - lo)
                prefix, lengths = _prefixes(value, text, weight, sizes, common, counts)
                rows = [batch.column(i).slice(lo, hi - lo) for i in (0, 1)]
                bits = _bitmaps(value, text, hi - lo).reshape(-1)
                wide, words = _wide_bitmaps(value, text, sizes)
                lists = [_lists(np.full(hi - lo, BITMAP), bits), _lists(lengths, prefix), _lists(words, wide)]
                columns = [*rows, _signed(keys), pa.array(sizes.astype(np.int32)), _signed(_fingerprints(value, sizes)), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "key", "n", "fp", "bits", "prefix", "wide"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, h bigint, key bigint, n int, fp bigint, bits array<bigint>, prefix array<bigint>, wide array<bigint>")


def wanted_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(key, set) of the texts whose ``h`` is in ``wanted``; a task returns each key once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(0)):
                keys, value, text = block_sets(data, offsets, width)
                listed = _lists(np.bincount(text, minlength=hi - lo), value)
                new = [i for i, k in enumerate(keys.tolist()) if k not in seen and not seen.add(k)]
                at = pa.array(new, pa.int64())
                yield pa.RecordBatch.from_arrays([_signed(keys).take(at), listed.take(at)], names=["key", "set"])

    texts = docs.select(F.xxhash64("text").alias("h"), "text").join(broadcast_if_small(wanted.select("h").distinct()), "h", "left_semi")
    return texts.select("text").mapInArrow(run, "key bigint, set array<bigint>").dropDuplicates(["key"])


def _listed_arrays(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column of whole numbers."""
    starts = column.offsets.to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return [flat[p - starts[0] : q - starts[0]] for p, q in zip(starts[:-1], starts[1:])]


def not_ruled_out(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of text keys whose wide bitmaps leave room for the wanted overlap."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = most_apart(*(batch.column(c).to_numpy().astype(np.int64) for c in ("n", "m")))
            apart = [wide_apart(x, y) for x, y in zip(_listed_arrays(batch.column("x")), _listed_arrays(batch.column("y")))]
            yield batch.select(["a", "b"]).filter(pa.array(np.array(apart, np.int64) <= most, pa.bool_()))

    met = pairs.join(texts.select(F.col("key").alias("a"), "n", F.col("wide").alias("x")), "a")
    met = met.join(texts.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("wide").alias("y")), "b")
    return met.select("a", "b", "n", "m", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def confirmed(pairs: DataFrame, texts: DataFrame, docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of text keys whose whole sets are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(x, y) for x, y in zip(_listed_arrays(batch.column(2)), _listed_arrays(batch.column(3)))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = scratch.store(not_ruled_out(pairs, texts))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = scratch.store(wanted_sets(docs, texts.join(broadcast_if_small(wanted), "key", "left_semi"), width))
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("t")), "a")
    both = both.join(sets.select(F.col("key").alias("b"), F.col("set").alias("u")), "b")
    return scratch.store(both.select("a", "b", "t", "u").mapInArrow(compare, "a bigint, b bigint"))


def simhash_pairs(texts: DataFrame) -> DataFrame:
    """(a, b): pairs that the SimHash trie proposes, by their keys."""
    named = texts.groupBy("fp").agg(F.min("key").alias("first"))
    equal = texts.join(named, "fp").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    found = simhash_trie.links(named.select("fp"), MAX_BITS)
    found = found.join(named.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(named.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return equal.unionByName(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _with_one(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that pass by size and bitmap."""
    one = texts.select("key", F.struct("key", "n", "bits").alias("t"))
    met = pairs.join(one.select(F.col("key").alias("a"), F.col("t").alias("x")), "a").join(one.select(F.col("key").alias("b"), F.col("t").alias("y")), "b")
    return met.where(_close("x", "y")).select("a", "b")


def sketch(bits: Column) -> list[Column]:
    """``bits`` folded to SKETCH words: sets differ in at least as many elements as their sketches in bits."""
    return [functools.reduce(lambda x, y: x.bitwiseXOR(y), [F.get(bits, F.lit(i)) for i in range(k, BITMAP, SKETCH)]).alias(f"f{k}") for k in range(SKETCH)]


def few_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): all pairs of texts that share a shingle of few texts, as far as sizes, sketches and the shingle's places allow.

    What two sets share comes, from their first common shingle on, out of the rests of both; at a later common
    one these are shorter. So a pair that the places at its first one rule out is not similar.
    """
    up, down = SIMILAR
    met = shared.groupBy("s").agg(F.collect_list(F.struct("key", "n", "at", *[f"f{k}" for k in range(SKETCH)])).alias("g"))

    def near(x: Column, y: Column) -> Column:
        apart = most_apart(x["n"], y["n"])
        rest = F.least(x["n"] - x["at"], y["n"] - y["at"])
        bits = functools.reduce(lambda p, q: p + q, [F.bit_count(x[f"f{k}"].bitwiseXOR(y[f"f{k}"])) for k in range(SKETCH)])
        return (F.least(x["n"], y["n"]) * down >= F.greatest(x["n"], y["n"]) * up) & (x["n"] + y["n"] - apart <= 2 * rest) & (bits <= apart)

    def with_later(x: Column, i: Column) -> Column:
        later = F.filter(F.slice("g", i + 2, F.size("g")), lambda y: near(x, y))
        return F.transform(later, lambda y: F.struct(F.least(x["key"], y["key"]).alias("a"), F.greatest(x["key"], y["key"]).alias("b")))

    return met.select(F.inline(F.flatten(F.transform("g", with_later)))).distinct()


def unconnected(shared: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of ``shared`` (s, key, root, n) that share a shingle, have different roots and pass by size and bitmap.

    Texts meet inside size bands, dealt into blocks, each of which meets the others as one bounded task.
    """
    up, down = SIMILAR
    apart = shared.groupBy("s").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("s")
    # A near copy is in the same band or the next: bands are a trifle wider than sizes may differ.
    band = F.floor(F.log(down / up * (1 + 1e-9), F.greatest(F.col("n"), F.lit(1)).cast("double"))).cast("int")
    rows = shared.join(broadcast_if_small(apart, SHINGLES), "s", "left_semi").withColumn("own", band)
    rows = scratch.store(rows.withColumn("band", F.explode(F.array("own", F.col("own") + 1))))
    crowds = rows.groupBy("s", "band").agg(F.count("*").alias("m"), F.min("root").alias("x"), F.max("root").alias("y")).where("x < y")
    crowds = scratch.store(crowds.select("s", "band", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    many = rows.join(broadcast_if_small(crowds, SHINGLES), ["s", "band"]).withColumn("guest", F.col("own") != F.col("band"))
    many = many.select("s", "band", "blocks", "key", "root", "n", "guest").join(texts.select("key", "bits"), "key")
    block = F.when(~F.col("guest"), F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    many = many.withColumn("block", block)
    # Own texts meet their block and the ones before it; guests meet every block.
    many = many.select("s", "band", "root", "key", "n", "bits", "block", F.explode(F.sequence(F.lit(0), F.coalesce("block", F.col("blocks") - 1))).alias("at"))
    many = many.withColumn("left", F.coalesce("block", F.lit(-1)) == F.col("at"))

    def meet(table: pa.Table) -> pa.Table:
        key, root, n = (table.column(c).to_numpy() for c in ("key", "root", "n"))
        bits = table.column("bits").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, BITMAP)
        left = np.flatnonzero(np.asarray(table.column("left").to_pylist(), bool))
        found = [np.zeros((2, 0), np.int64)]
        for lo in range(0, len(key), 64):
            right = np.arange(lo, min(lo + 64, len(key)))
            apart = np.bitwise_count(bits[left][:, None, :] ^ bits[right][None]).sum(axis=2)
            a, b = n[left][:, None].astype(np.int64), n[right][None].astype(np.int64)
            good = (apart <= most_apart(a, b)) & (np.minimum(a, b) * down >= np.maximum(a, b) * up) & (root[left][:, None] != root[right][None])
            i, j = np.nonzero(good)
            x, y = key[left[i]], key[right[j]]
            found.append(np.stack((np.minimum(x, y), np.maximum(x, y))))
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.table({"a": a, "b": b})

    return many.groupBy("s", "band", "at").applyInArrow(meet, "a bigint, b bigint").distinct()


def links(rows: DataFrame, docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(a, b): links between text keys that connect all near copies, and no other texts. ``rows`` as ``described``."""
    texts = rows.groupBy("key").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bits").alias("bits"), F.first("wide").alias("wide"), F.min("h").alias("h"))
    texts = scratch.store(texts)
    postings = rows.select("key", "n", *sketch(F.col("bits")), F.posexplode("prefix").alias("at", "s"))
    # Combined before the shuffle: a shingle of very many texts is one row of each task.
    met = postings.groupBy("s").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("rows")).where("least < most")
    met = scratch.store(met.select("s", "least", (F.col("rows") > FEW).alias("crowded")))
    shared = scratch.store(postings.join(broadcast_if_small(met, SHINGLES), "s").distinct())
    stars = shared.where("crowded and key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    first = simhash_pairs(texts).unionByName(few_pairs(shared.where("not crowded"))).unionByName(stars)
    first = scratch.store(first.distinct())
    found = confirmed(_with_one(first, texts), texts, docs, width, scratch)
    roots = components(found)
    named = shared.where("crowded").join(broadcast_if_small(roots), shared["key"] == roots["node"], "left").select("s", "key", "n", F.coalesce("root", "key").alias("root"))
    rest = unconnected(scratch.store(named), texts, scratch).join(first, ["a", "b"], "left_anti")
    return found.unionByName(confirmed(rest, texts, docs, width, scratch))


def redundant(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, h): the rows that go when one document of each group of near copies is kept. Stored."""
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.store(described(docs, width))
        least = rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")).alias("first"), F.min("h").alias("x"), F.max("h").alias("y"), F.count("*").alias("rows"))
        least = scratch.store(least)
        roots = scratch.store(components(links(rows, docs, width, scratch)))
        named = least.join(roots, least["key"] == roots["node"], "left").select("key", F.coalesce("root", "key").alias("root"), "first", "rows", "node")
        # Only texts that are linked or stand in several rows can lose a row.
        named = scratch.store(named.where(F.col("node").isNotNull() | (F.col("rows") > 1)))
        keepers = named.groupBy("root").agg(F.min("first").alias("keeper"))
        named = scratch.store(named.join(keepers, "root").select("key", "keeper"))
        told = rows.select("key", "doc_id", "h").join(broadcast_if_small(named), "key")
        stays = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("h") == F.col("keeper.h"))
        return materialise(told.where(~stays).select("doc_id", "h").distinct())


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of ``docs`` that stay when one document of each group of near copies is kept.

    Groups are the components of the near copies; texts without words are copies of each other. The
    document with the smallest doc_id of its group stays; of several rows with that doc_id in one group, one
    (by the hash of the text). Rows without doc_id in a group that has one go; if none has one, one row
    stays. Of rows that repeat both doc_id and text one stays. All columns are returned unchanged; an empty
    table gives no rows. ``docs`` must be a stored table or read alike each time.
    """
    key, gone_id, gone_h = fresh(docs, "row_key", "gone_id", "gone_h")
    gone = redundant(docs, width).select(F.col("doc_id").alias(gone_id), F.col("h").alias(gone_h))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    kept = keyed.join(broadcast_if_small(gone), keyed["doc_id"].eqNullSafe(gone[gone_id]) & (keyed[key] == gone[gone_h]), "left_anti")
    repeated = docs.select("doc_id", F.xxhash64("text").alias(key)).groupBy("doc_id", key).count().where("count > 1")
    repeated = materialise(repeated.select(F.col("doc_id").alias(gone_id), F.col(key).alias(gone_h)))
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    # Equal rows are combined before the shuffle; other rows are not moved.
    again = keyed["doc_id"].eqNullSafe(repeated[gone_id]) & (keyed[key] == repeated[gone_h])
    single = kept.join(broadcast_if_small(repeated), again, "left_anti")
    several = kept.join(broadcast_if_small(repeated), again, "left_semi").dropDuplicates(["doc_id", key])
    return single.unionByName(several).select(*docs.columns)
