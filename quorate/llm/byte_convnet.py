"""Quality classifier: a small convolutional network over the bytes of a text, in numpy.

Bytes are embedded; filters of eight bytes run every four bytes over overlapping chunks that cover the
whole text. Each filter is max-pooled inside a chunk; the chunks of a text are combined by their mean and
their maximum, and a logistic output turns both into one probability. All weights are learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import text_blocks

DIM = 8
FILTERS = 24
STRIDE = 4
CHUNK = 256
# Chunks overlap by one stride, so every filter position of the text lies in exactly one chunk.
HOP = CHUNK - STRIDE
SPOTS = CHUNK // STRIDE - 1
# Bounds of the sample that the network is fitted on: rows, and chunks of each (evenly spaced if a text has more).
TRAIN_ROWS = 2000
TRAIN_CHUNKS = 16
STEPS = 400
BATCH = 32
RATE = 0.02
THRESHOLD = 0.5


@dataclass
class Network:
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # 2 STRIDE DIM x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 FILTERS + 1

    def activations(self, chunks: np.ndarray) -> np.ndarray:
        """Filter outputs (chunk, spot, filter) before pooling."""
        x = self.embed[chunks].reshape(-1, STRIDE * DIM)
        half = STRIDE * DIM
        shape = (len(chunks), SPOTS + 1, FILTERS)
        head, tail = (x @ self.filters[:half]).reshape(shape), (x @ self.filters[half:]).reshape(shape)
        return head[:, :-1] + tail[:, 1:]

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        return np.maximum(self.activations(chunks).max(axis=1) + self.bias, 0)

    def combine(self, pooled: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
        mean = np.add.reduceat(pooled, first, axis=0) / counts[:, None]
        return np.concatenate((mean, np.maximum.reduceat(pooled, first, axis=0)), axis=1)

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = features.astype(np.float64) @ self.out[:-1] + self.out[-1]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each text of a block."""
        chunks, counts = cut(data, offsets)
        pooled = np.concatenate([self.pooled(chunks[lo : lo + 1024]) for lo in range(0, len(chunks), 1024)])
        return self.probability(self.combine(pooled, np.cumsum(counts) - counts, counts))


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all texts of a block, zero-filled at their ends, and the number of chunks of each (at least 1)."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-(sizes - STRIDE) // HOP))
    first = np.cumsum(counts) - counts
    out = np.zeros((int(counts.sum()), CHUNK), np.uint8)
    for i in range(len(sizes)):
        n, k = int(sizes[i]), int(counts[i])
        flat = np.zeros(k * HOP + STRIDE, np.uint8)
        flat[:n] = data[offsets[i] : offsets[i] + n]
        out[first[i] : first[i] + k] = np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::HOP]
    return out, counts


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 17) -> Network | None:
    """Train by Adam on the cross-entropy; the same sample gives the same network. None without labels."""
    if not len(texts):
        return None
    rng = np.random.default_rng(seed)
    samples = []
    for text in texts:
        chunks, _ = cut(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        if len(chunks) > TRAIN_CHUNKS:
            chunks = chunks[np.linspace(0, len(chunks) - 1, TRAIN_CHUNKS).astype(int)]
        samples.append(chunks)
    y = np.asarray(labels, np.float64)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    net = Network(
        rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        rng.normal(0, 0.25, (2 * STRIDE * DIM, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        np.append(rng.normal(0, 0.1, 2 * FILTERS), np.log(share / (1 - share))),
    )
    names = ("embed", "filters", "bias", "out")
    mean = {k: np.zeros(getattr(net, k).shape) for k in names}
    square = {k: np.zeros(getattr(net, k).shape) for k in names}
    for step in range(1, STEPS + 1):
        # Half of a batch from each class, so the rarer one is learned too.
        zeros, ones = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
        both = [rng.choice(c, BATCH // 2) for c in (zeros, ones) if len(c)]
        pick = np.concatenate(both)
        weight = np.where(y[pick] == 1, 1.0, 0.5) / len(pick)
        grads = _gradients(net, [samples[i] for i in pick], y[pick], weight)
        rate = RATE * (1 - (step - 1) / STEPS)
        for k in names:
            mean[k] = 0.9 * mean[k] + 0.1 * grads[k]
            square[k] = 0.99 * square[k] + 0.01 * grads[k] ** 2
            move = rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
            setattr(net, k, (getattr(net, k) - move).astype(getattr(net, k).dtype))
    return net


def _gradients(net: Network, samples: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    counts = np.array([len(s) for s in samples])
    first = np.cumsum(counts) - counts
    chunks = np.concatenate(samples)
    acts = net.activations(chunks)
    spot = acts.argmax(axis=1)
    raw = np.take_along_axis(acts, spot[:, None], axis=1)[:, 0] + net.bias
    pooled = np.maximum(raw, 0)
    features = net.combine(pooled, first, counts)
    dz = (net.probability(features) - y) * weight
    out = np.append(features.T @ dz, dz.sum()) + 1e-4 * np.append(net.out[:-1], 0)
    df = dz[:, None] * net.out[None, :-1]
    owner = np.repeat(np.arange(len(samples)), counts)
    dpool = (df[:, :FILTERS] / counts[:, None])[owner]
    top = pooled == features[owner, FILTERS:]
    dpool = (dpool + np.where(top, df[owner, FILTERS:], 0)) * (raw > 0)
    # Only the winning spot of each filter has a gradient.
    place = spot[:, :, None] * STRIDE + np.arange(2 * STRIDE)
    seen = np.take_along_axis(chunks, place.reshape(len(chunks), -1), axis=1).reshape(place.shape)
    dfilter = np.einsum("kf,kfod->odf", dpool, net.embed[seen]).reshape(net.filters.shape)
    back = np.einsum("kf,odf->kfod", dpool, net.filters.reshape(2 * STRIDE, DIM, FILTERS))
    flat = seen.ravel()
    dembed = np.stack([np.bincount(flat, weights=back[..., d].ravel(), minlength=256) for d in range(DIM)], axis=1)
    return {"embed": dembed, "filters": dfilter, "bias": dpool.sum(axis=0), "out": out}


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Network | None:
    """Fit on at most ``rows`` labelled documents, those with the smallest hash of doc_id.

    Rows of ``labels`` with a null doc_id or label are ignored, as are held-out documents; several labels
    of one document are averaged (1 from one half on). Choosing happens among the ids; only the chosen
    documents' texts are read to the driver, each cut to evenly spaced chunks.
    """
    wanted = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    wanted = wanted.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    wanted = wanted.join(docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct(), "doc_id", "left_semi")
    # At most ``rows`` short rows.
    chosen = F.broadcast(wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    size = TRAIN_CHUNKS * CHUNK

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text longer than the sample takes is cut to its evenly spaced chunks here, inside the task."""
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode()
                if len(data) > size:
                    starts = np.linspace(0, len(data) - CHUNK, TRAIN_CHUNKS).astype(int)
                    # One hop each: cut again by the driver, chunks start at these places.
                    data = b"".join(data[s : s + HOP] for s in starts)
                out.append(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], names=["doc_id", "data", "y"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "y")
    # Rows that repeat a doc_id could exceed the bound: one text of each is taken.
    table = found.mapInArrow(sample, f"doc_id {kind}, data binary, y int").groupBy("doc_id").agg(F.min(F.struct("data", "y")).alias("v"))
    got = table.select("doc_id", "v.data", "v.y").toArrow().sort_by("doc_id")
    return fit([bytes(v) for v in got.column("data").to_pylist()], got.column("y").to_numpy())


def with_scores(docs: DataFrame, net: Network | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``score``, the probability of label 1 of the whole text.

    A null text scores like an empty one. Without a network (no labelled document) every score is 0.5.
    """
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _scores(net, batch.column(n))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found)], names=[*keep, "score"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*kinds, "score double"]))


def _scores(net: Network | None, texts: pa.Array) -> np.ndarray:
    if net is None or not len(texts):
        return np.full(len(texts), 0.5)
    return np.concatenate([net.scores(data, offsets) for _, _, data, offsets in text_blocks(texts)])


def keep_good(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose score reaches the threshold, all columns unchanged, in one pass."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.greater_equal(pa.array(_scores(net, batch.column(at))), threshold))

    return docs.mapInArrow(run, docs.schema)
