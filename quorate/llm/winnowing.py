"""Benchmark decontamination by winnowing.

Training and test texts are reduced to fingerprints: of every run of ``w`` neighbouring k-gram hashes
the smallest is kept, with ``k + w - 1`` equal to the window length, so two texts that share a window
share a fingerprint inside it. Fingerprints are joined; a hit is extended to every window of words
that contains it, and windows are joined by their own hash, which decides.

Items shorter than the window are one window of their own length; each such length has its own
fingerprints by the same rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import fresh, materialise, text_blocks
from quorate.session import broadcast_if_small

WINDOW = 13
# A document is contaminated if at least one word in so many lies in a benchmark window.
SHARE = 20

_U = np.uint64
_MASK = (1 << 64) - 1
# Odd 64-bit multipliers: of bytes in a word, and of words in a run.
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BYTE_INVERSE = pow(_BYTE, -1, 1 << 64)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
# Digits, letters and everything beyond ASCII belong to words.
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for the next block."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 20), base, dtype=_U)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 1 << 22:
            _POWERS[base] = known
    return known[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block of texts, and the text that each word belongs to."""
    low = _LOWER[data]
    inside = _IN_WORD[low]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    # A text begins a new word even if the one before it ends inside a word.
    heads = offsets[:-1][offsets[:-1] < len(data)]
    start[heads] |= inside[heads]
    end = np.ones(len(data), bool)
    end[:-1] = ~inside[1:] | start[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(inside & end) + 1
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((low.astype(_U) + _U(1)) * _powers(_BYTE, len(data)), out=sums[1:])
    hashes = _mixed((sums[e] - sums[s]) * _powers(_BYTE_INVERSE, len(data) + 1)[s])
    return hashes, np.searchsorted(offsets, s, side="right") - 1


def _runs(hashes: np.ndarray, length: int, salt: int) -> np.ndarray:
    """Hash of every run of ``length`` words, by place of its first word."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    out = np.zeros(n, dtype=_U)
    for j in range(length):
        out = out * _U(_WORD) + hashes[j : j + n]
    return _mixed(out ^ _U(salt))


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Smallest or largest of every ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[:-step], values[step:])
        have += step
    return values


def winnow(hashes: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, fingerprint, windows) of the kept k-grams of a block for windows of ``length`` words.

    ``windows`` has a row per kept k-gram with the hashes of the windows that contain it, the first
    starting ``w - 1`` words before it; 0 where no window of the same text starts there.
    """
    k = (length + 1) // 2
    w = length - k + 1
    n = len(hashes) - k + 1
    if len(hashes) < length:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros((0, w), _U)
    grams = np.minimum(_runs(hashes, k, 2 * length), _U(_MASK - 1))
    grams[owner[:n] != owner[k - 1 :]] = _U(_MASK)
    windows = np.maximum(_runs(hashes, length, 2 * length + 1), _U(1))
    windows[owner[: len(windows)] != owner[length - 1 :]] = 0
    least = _sliding(grams, w, np.minimum)
    # A k-gram is kept if it is the smallest of a window that lies in one text.
    least = np.where(windows != 0, least, 0)
    pad = np.zeros(w - 1, _U)
    kept = _sliding(np.concatenate((pad, least, pad)), w, np.maximum) == grams
    places = np.flatnonzero(kept & (grams != _U(_MASK)))
    wide = np.concatenate((pad, windows, pad))
    return places, grams[places], np.stack([wide[places + j] for j in range(w)], axis=1) if len(places) else np.zeros((0, w), _U)


def _fingerprints(rows: DataFrame, lengths: list[int], whole: bool) -> DataFrame:
    """(row columns, n_words, len, start, fp, windows): a header with start -1 for each row, then its fingerprints.

    ``rows`` has the text last; the other columns name the row. ``whole`` adds, for a text shorter
    than WINDOW, its single window of its own length, and leaves other lengths out of it.
    """
    names = rows.columns[:-1]
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(len(names))):
                hashes, owner = word_hashes(data, offsets)
                counts = np.bincount(owner, minlength=hi - lo)
                first = np.cumsum(counts) - counts
                for length in [0, *lengths]:
                    if length:
                        at, fp, windows = winnow(hashes, owner, length)
                        if whole:
                            right = np.minimum(counts[owner[at]], WINDOW) == length
                            at, fp, windows = at[right], fp[right], windows[right]
                        doc, start = owner[at], at - first[owner[at]]
                    else:
                        doc, start = np.arange(hi - lo), np.full(hi - lo, -1)
                        # Spread headers over the partitions of a shuffled join.
                        fp, windows = _mixed(np.arange(hi - lo).astype(_U)), np.zeros((hi - lo, 0), _U)
                    own = [batch.column(i).take(pa.array(lo + doc)) for i in range(len(names))]
                    size = windows.shape[1]
                    lists = pa.ListArray.from_arrays(
                        pa.array((np.arange(len(doc) + 1) * size).astype(np.int32)), pa.array(windows.reshape(-1).view(np.int64))
                    )
                    yield pa.RecordBatch.from_arrays(
                        [*own, pa.array(counts[doc]), pa.array(np.full(len(doc), length, np.int32)), pa.array(start.astype(np.int32)), pa.array(fp.view(np.int64)), lists],
                        names=[*names, "n_words", "len", "start", "fp", "windows"],
                    )

    return rows.mapInArrow(run, ", ".join([*kinds, "n_words bigint", "len int", "start int", "fp bigint", "windows array<bigint>"]))


def _opened(hits: DataFrame) -> DataFrame:
    """One row per window that contains a hit, with the place of its first word."""
    back = F.transform("windows", lambda v, i: F.struct(v.alias("window"), (F.col("start") - F.size("windows") + 1 + i).alias("at")))
    return hits.withColumn("w", F.explode_outer(F.filter(back, lambda s: s["window"] != 0)))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, h, n_rows, n_words, n_hit, items): overlap of every distinct (doc_id, text) with the benchmark.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. ``h`` is
    the hash of the text, ``n_rows`` the number of equal rows. ``items`` holds the ids of items with a
    window in the text, sorted as strings. Null texts have no words; items without id or words take
    part in nothing; repeated items count once. Without items every document has n_hit 0.
    """
    wanted = benchmark.where("item_id is not null").select("item_id", "text")
    found = materialise(_fingerprints(wanted, list(range(1, WINDOW + 1)), whole=True))
    # At most WINDOW values.
    lengths = sorted(r["len"] for r in found.where("start >= 0").select("len").distinct().collect())
    windows = _opened(found.where("start >= 0")).select("len", "w.window", F.col("item_id").cast("string").alias("item")).distinct()
    # Windows with the same items share one class, so a passage that many items repeat is met once.
    classes = windows.groupBy("len", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    classes = materialise(classes.withColumn("class", F.xxhash64("items")))
    tests = found.where("start >= 0").select("len", "fp").distinct()

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    marks = _fingerprints(rows, lengths, whole=False)
    known = tests.withColumn("known", F.lit(True))
    marks = marks.join(broadcast_if_small(known), ["len", "fp"], "left").where("known or start < 0")
    spots = _opened(marks).select("doc_id", "h", "n_words", "start", F.col("len").alias("len"), "w.at", "w.window")
    spots = spots.join(broadcast_if_small(classes.select("len", "window", "class")), ["len", "window"], "left")
    span = F.when(F.col("class").isNotNull(), F.struct(F.col("at").alias("lo"), (F.col("at") + F.col("len")).alias("hi")))
    # One group holds at most the windows of one text.
    each = spots.groupBy("doc_id", "h").agg(
        F.count(F.when(F.col("start") < 0, True)).alias("n_rows"),
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(span)).alias("spans"),
        F.collect_set("class").alias("classes"),
    )
    each = materialise(each.withColumn("n_hit", _covered(F.col("spans"))).drop("spans"))
    named = each.select("doc_id", "h", F.explode("classes").alias("class"))
    named = named.join(broadcast_if_small(classes.select("class", "items").distinct()), "class")
    named = named.groupBy("doc_id", "h").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    named = named.select(F.col("doc_id").alias("its_id"), F.col("h").alias("its_h"), "items")
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("h") == F.col("its_h"))
    items = F.coalesce("items", F.array().cast("array<string>")).alias("items")
    return each.join(named, same, "left").select("doc_id", "h", "n_rows", "n_words", "n_hit", items)


def _covered(spans: Column) -> Column:
    """Number of words in the union of sorted spans."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))

    def add(acc: Column, s: Column) -> Column:
        upto = F.greatest(acc["upto"], s["hi"].cast("bigint"))
        fresh_words = F.greatest(upto - F.greatest(acc["upto"], s["lo"].cast("bigint")), F.lit(0).cast("bigint"))
        return F.struct((acc["n"] + fresh_words).alias("n"), upto.alias("upto"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"])


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))


def overlap(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Like ``hits`` with the verdict, one row for every row of ``docs``."""
    found = hits(docs, benchmark).withColumn("contaminated", contaminated())
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_rows")))).drop("copy")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not contaminated; all columns unchanged."""
    key, gone_id, gone_key = fresh(docs, "text_key", "gone_id", "gone_key")
    gone = hits(docs, benchmark).where(contaminated()).select(F.col("doc_id").alias(gone_id), F.col("h").alias(gone_key))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(gone[gone_id]) & (keyed[key] == gone[gone_key])
    return keyed.join(gone, same, "left_anti").select(*docs.columns)
