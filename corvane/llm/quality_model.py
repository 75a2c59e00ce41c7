"""A quality classifier: random-indexing word vectors pooled per document, then a small network.

Each word, and each word's shape (its runs of small and capital letters, digits and other characters), falls into one of
2**14 buckets by hash. A bucket has a sparse random index vector; its word vector is the sum of the index vectors of the
words around its occurrences, and its own. Documents pool the mean vectors of words and of shapes, with a few counts. A
network of two layers gives a score, whose temperature is fitted on training rows that it wasn't trained on.

The model is fitted on at most ``MAX_TRAIN`` labelled rows; every row is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import written
from corvane.llm.hashing import texts_words

BUCKETS, SIZE, AROUND, SPARSE = 1 << 14, 32, 2, 4
#: Labelled rows that the model is fitted on at most, picked by a hash of the id.
MAX_TRAIN = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 3e-3, 1e-4
THRESHOLD = 0.3

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = ord("l")
_CLASS[65:91] = ord("u")
_CLASS[48:58] = ord("0")


def index_vectors() -> np.ndarray:
    """A sparse vector of ones and minus ones for each bucket."""
    rng = np.random.Generator(np.random.PCG64(7))
    out = np.zeros((BUCKETS, SIZE), dtype=np.int32)
    for k in range(BUCKETS):
        out[k, rng.choice(SIZE, SPARSE, replace=False)] = rng.choice([-1, 1], SPARSE)
    return out


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(50)).astype(np.int64)


def shapes_of(column: pa.Array) -> pa.Array:
    """The texts with each character replaced by its class and runs of one class by one sign; blanks stay."""
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = _CLASS[np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]]] if raw is not None else np.empty(0, np.uint8)
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[1:] != data[:-1]) | (data[1:] <= 32)
    at = offsets[:-1] - offsets[0]
    keep[at[at < len(data)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(total[offsets - offsets[0]].astype(np.int64)), pa.py_buffer(data[keep].tobytes()))


def contexts(column: pa.Array, index: np.ndarray) -> np.ndarray:
    """Sums of the index vectors around each bucket's occurrences; words of one text only are neighbours."""
    out = np.zeros((BUCKETS, SIZE), dtype=np.int64)
    for _, words, bounds in texts_words(column):
        bucket = _bucket(words)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        around = np.zeros((len(bucket), SIZE), dtype=np.int32)
        for k in range(1, AROUND + 1):
            same = (text[k:] == text[:-k])[:, None]
            around[k:] += index[bucket[:-k]] * same
            around[:-k] += index[bucket[k:]] * same
        for d in range(SIZE):
            out[:, d] += np.bincount(bucket, weights=around[:, d], minlength=BUCKETS).astype(np.int64)
    return out


def word_vectors(context: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Unit context vectors, and a share of the index vector, which alone stands for a bucket that was never met."""
    norm = np.sqrt((context.astype(float) ** 2).sum(axis=1, keepdims=True))
    return (context / np.where(norm > 0, norm, 1) + 0.5 * index / np.sqrt(SPARSE)).astype(np.float32)


def _pooled(column: pa.Array, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean vectors, and (words, distinct words, distinct windows of five), by text."""
    mean, count = np.zeros((len(column), SIZE), np.float32), np.zeros((len(column), 3), np.float32)
    for first, words, bounds in texts_words(column):
        n = np.diff(bounds)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        sums = np.add.reduceat(vectors[_bucket(words)], bounds[:-1][some], axis=0)
        mean[first + some] = sums / n[some, None]
        for k in some:
            own = words[bounds[k] : bounds[k + 1]]
            windows = own[:-4] + own[1:-3] * np.uint64(3) + own[2:-2] * np.uint64(9) + own[3:-1] * np.uint64(27) + own[4:] * np.uint64(81) if len(own) > 4 else own[:0]
            count[first + k] = len(own), len(np.unique(own)), len(np.unique(windows)) / len(windows) if len(windows) else 1
    return mean, count


def features(column: pa.Array, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    mean, count = _pooled(column, words)
    shape, shape_count = _pooled(shapes_of(column), shapes)
    n = np.maximum(count[:, 0], 1)
    extra = np.stack([np.log1p(count[:, 0]), count[:, 1] / n, count[:, 2], np.log1p(shape_count[:, 1]), (1 - count[:, 2]) * np.log1p(count[:, 0])], axis=1)
    return np.concatenate([mean, shape, extra.astype(np.float32)], axis=1)


@dataclass
class Model:
    words: np.ndarray
    shapes: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def score(self, column: pa.Array) -> np.ndarray:
        x = (features(column, self.words, self.shapes) - self.shift) / self.scale
        return _sigmoid(_forward(self.layers, x)[1] / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _forward(layers: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden, hidden @ w2 + b2


def train(x: np.ndarray, y: np.ndarray, seed: int = 11) -> tuple:
    """Two layers by Adam on the cross entropy; the same rows give the same layers."""
    rng = np.random.Generator(np.random.PCG64(seed))
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            own = order[at : at + BATCH]
            hidden, z = _forward(params, x[own])
            dz = (_sigmoid(z) - y[own]) / len(own)
            dh = np.outer(dz, params[2]) * (1 - hidden**2)
            grads = [x[own].T @ dh + DECAY * params[0], dh.sum(axis=0), hidden.T @ dz + DECAY * params[2], np.array([dz.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - RATE * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return params[0], params[1], params[2], float(params[3][0])


def calibrate(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature, on a geometric grid, with the least cross entropy."""
    grid = np.geomspace(0.25, 8, 61)
    loss = [-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() for p in (np.clip(_sigmoid(z / t), 1e-9, 1 - 1e-9) for t in grid)]
    return float(grid[int(np.argmin(loss))])


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows that aren't held out. Ids with several labels count by their mean; null labels
    don't count. With labels of one kind, or none, every score is that kind's share (0.5 without labels)."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    n = marks.count()
    if n > MAX_TRAIN:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * MAX_TRAIN / n))
    # MAX_TRAIN rows, give or take: a bounded table
    sample = written(documents.select("doc_id", "text").join(F.broadcast(marks), "doc_id").repartition(16, "doc_id"), "labelled")
    index = index_vectors()
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS, SIZE), dtype=np.int64)
        for batch in batches:
            text = batch.column("text")
            total[0] += contexts(text, shared.value)
            total[1] += contexts(shapes_of(text), shared.value)
        chunks = total.astype(np.int32).reshape(32, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(32), pa.int32()), pa.array([c.tobytes() for c in chunks], pa.binary())], ["chunk", "sums"])

    def add(blocks: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in blocks.column("sums").to_pylist())
        return pa.table({"chunk": blocks.column("chunk").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    context = np.zeros((32, 2 * BUCKETS * SIZE // 32), dtype=np.int64)
    for r in sample.mapInArrow(gather, "chunk int, sums binary").groupBy("chunk").applyInArrow(add, "chunk int, sums binary").collect():
        context[r[0]] = np.frombuffer(r[1], np.int64)
    context = context.reshape(2, BUCKETS, SIZE)
    words, shapes = word_vectors(context[0], index), word_vectors(context[1], index)
    vectors = documents.sparkSession.sparkContext.broadcast((words, shapes))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"), *vectors.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    rows = sample.mapInArrow(pool, "doc_id bigint, y double, x binary").orderBy("doc_id", "x").collect()
    width = 2 * SIZE + 5
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]).astype(float) if rows else np.zeros((0, width))
    y = np.array([r["y"] for r in rows])
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return Model(words, shapes, np.zeros(width), np.ones(width), (np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share)))), 1.0)
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - shift) / scale
    apart = np.random.Generator(np.random.PCG64(5)).random(len(x)) < 0.15  # training rows for the temperature
    layers = train(x[~apart], y[~apart]) if 0 < y[~apart].mean() < 1 else train(x, y)
    temperature = calibrate(_forward(layers, x[apart])[1], y[apart]) if apart.any() else 1.0
    return Model(words, shapes, shift, scale, layers, temperature)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; null and empty texts are scored as texts without words."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                value = shared.value.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(value.astype(float))], ["doc_id", "score"])

    scored = documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_model_digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, fit(documents, labels))
