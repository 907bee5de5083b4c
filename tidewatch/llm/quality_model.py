"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network with
temperature-calibrated probabilities.

Every token is seen as two words, its text and its shape (letters by case, digits, other characters as they are); a word
is hashed to one of BUCKETS places. A place has a sparse random index vector; its word vector adds the index vectors of
its neighbours in all documents (random indexing). A document is the mean of its word vectors, the lengths of both means
(texts that repeat themselves have long ones), and a few rates. The network is trained on a bounded sample of labelled documents; a temperature
is fitted on a part of the sample that the network has not seen.

Null and empty texts pool to zeros and are scored as such. Labels of repeated ids count once; without labels of both kinds
every score is the share of positive labels (0.5 without labels). Extra columns are ignored; long texts are pooled whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, written

BUCKETS, WIDTH = 1 << 14, 24
#: Words of a text that are pooled at once.
CHUNK = 1 << 16
#: Words whose neighbours are counted at once, about.
GATHERED = 1 << 18
_SHAPE = bytearray(range(256))
for _c in range(256):
    _SHAPE[_c] = ord("A") if 65 <= _c <= 90 else ord("0") if 48 <= _c <= 57 else ord("a") if 97 <= _c <= 122 or _c >= 128 else _c
_SHAPE = bytes(_SHAPE)


def index_vectors() -> np.ndarray:
    """Sparse ternary random index vectors: four places of each row are 1 or -1."""
    rng = np.random.default_rng(7)
    table = np.zeros((BUCKETS, WIDTH), np.float32)
    rows = np.arange(BUCKETS)
    for _ in range(4):
        table[rows, rng.integers(0, WIDTH, BUCKETS)] += rng.choice(np.array([-1, 1], np.float32), BUCKETS)
    return table


def places(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint32, len(words)) & (BUCKETS - 1)


def pooled(text: str, vectors: np.ndarray) -> np.ndarray:
    """2 * WIDTH means, two lengths and five rates."""
    data = text.encode("utf-8", "replace")
    words, shapes = data.split(), data.translate(_SHAPE).split()
    out = np.zeros(2 * WIDTH + 7)
    n = len(words)
    if not n:
        return out
    same, kinds = 0, set()
    for a in range(0, n, CHUNK):
        w, s = places(words[a : a + CHUNK]), places(shapes[a : a + CHUNK])
        out[:WIDTH] += vectors[w].sum(axis=0)
        out[WIDTH : 2 * WIDTH] += vectors[s].sum(axis=0)
        same += int((w[1:] == w[:-1]).sum())
        kinds.update(np.unique(w).tolist())
    out[: 2 * WIDTH] /= n
    lines = [x for x in data.split(b"\n") if x.strip()]
    out[-7] = np.linalg.norm(out[:WIDTH])
    out[-6] = np.linalg.norm(out[WIDTH : 2 * WIDTH])
    out[-5] = math.log1p(n) / 10
    out[-4] = same / n
    out[-3] = len(kinds) / min(n, BUCKETS)
    out[-2] = 1 - len(set(lines)) / max(1, len(lines))
    out[-1] = min(2.0, sum(map(len, words)) / n / 10)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scale: np.ndarray = field(default_factory=lambda: np.ones(1))
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    prior: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ w1 + b1) @ w2 + b2[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def context_vectors(sample: DataFrame) -> np.ndarray:
    """Word vectors: index vectors plus what the neighbours within two places add, normalised.

    Neighbours are counted over whole texts of all rows. The sums are of integers, so they agree in any order; Spark adds
    them up, and at most BUCKETS rows reach the driver.
    """
    index = index_vectors()
    # The places of each index vector that are not 0 and their values, as lists of equal length.
    most = int((index != 0).sum(axis=1).max())
    columns = np.argsort(-np.abs(index), axis=1, kind="stable")[:, :most]
    values = np.take_along_axis(index, columns, axis=1).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * WIDTH)

        def add(at: np.ndarray, neighbours: np.ndarray) -> None:
            """Adds the neighbours' index vectors at the words' places; sums of small integers are exact as floats."""
            for k in range(most):
                total[:] += np.bincount(at * WIDTH + columns[neighbours, k], values[neighbours, k], BUCKETS * WIDTH)

        def flush(words: list[np.ndarray]) -> None:
            # Two empty places part the texts, so no word has a neighbour in another text.
            w = np.concatenate([x for t in words for x in (t, [-1, -1])]).astype(np.int64)
            for gap in (1, 2):
                left, right = w[:-gap], w[gap:]
                both = (left >= 0) & (right >= 0)
                add(left[both], right[both])
                add(right[both], left[both])

        waiting, size = [], 0
        for batch in batches:
            for text in batch.column("text"):
                data = (text.as_py() or "").encode("utf-8", "replace")
                for words in (data.split(), data.translate(_SHAPE).split()):
                    for a in range(0, len(words), CHUNK):
                        waiting.append(places(words[max(0, a - 2) : a + CHUNK]).astype(np.int64))
                        size += len(waiting[-1])
                        if size >= GATHERED:
                            flush(waiting)
                            waiting, size = [], 0
        if waiting:
            flush(waiting)
        total = total.astype(np.int64).reshape(BUCKETS, WIDTH)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, k]) for k in range(WIDTH))], names=["place", *(f"v{k}" for k in range(WIDTH))])

    schema = "place long, " + ", ".join(f"v{k} long" for k in range(WIDTH))
    sums = sample.select("text").mapInArrow(run, schema).groupBy("place").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(WIDTH)])
    rows = np.array([tuple(r) for r in sums.collect()], np.float64).reshape(-1, WIDTH + 1)
    total = np.zeros((BUCKETS, WIDTH))
    total[rows[:, 0].astype(np.int64)] = rows[:, 1:]
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    vectors = index / np.maximum(np.linalg.norm(index, axis=1, keepdims=True), 1e-9) + 0.5 * total
    return vectors.astype(np.float32)


def train(model: Model, x: np.ndarray, y: np.ndarray, hidden: int = 24, steps: int = 400, rate: float = 0.02, decay: float = 1e-3) -> None:
    """Adam over the whole sample, on four fifths of it; the temperature on the rest."""
    model.prior = float(y.mean()) if len(y) else 0.5
    if not 0 < y.sum() < len(y):
        return
    rng = np.random.default_rng(11)
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    held, seen = order[:cut], order[cut:]
    if not 0 < y[seen].sum() < len(seen):
        seen = order
    model.mean, model.scale = x[seen].mean(axis=0), x[seen].std(axis=0) + 1e-6
    z, t = np.clip((x[seen] - model.mean) / model.scale, -6, 6), y[seen]
    layers = [rng.normal(0, 1 / math.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for step in range(1, steps + 1):
        w1, b1, w2, b2 = layers
        h = np.tanh(z @ w1 + b1)
        p = 1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -30, 30)))
        d = (p - t) / len(t)
        back = np.outer(d, w2) * (1 - h * h)
        grads = [z.T @ back + decay * w1, back.sum(axis=0), h.T @ d + decay * w2, np.array([d.sum()])]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model.layers = layers
    logits, t = model.logits(x[held]), y[held]
    if 0 < t.sum() < len(t):
        temperatures = np.geomspace(0.25, 8, 60)
        losses = [np.mean(np.logaddexp(0, np.where(t > 0, -logits, logits) / c)) for c in temperatures]
        model.temperature = float(temperatures[int(np.argmin(losses))])


def fit(docs: DataFrame, labels: DataFrame, rows: int = 6_000, folds: int = 3, held_out: int = 1) -> Model:
    """Word vectors from all documents; network and temperature from at most `rows` labelled ones outside the held-out fold."""
    sample = written(labelled_sample(docs, labels, "quality", folds, held_out, rows), "quality-sample")
    model = Model(context_vectors(docs))
    vectors = docs.sparkSession.sparkContext.broadcast(model.vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [pooled(t, vectors.value).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(out, pa.binary())], names=["doc_id", "y", "v"])

    table = sample.mapInArrow(run, "doc_id long, y int, v binary").orderBy("doc_id", "v").collect()
    if table:
        train(model, np.stack([np.frombuffer(r["v"]) for r in table]), np.array([float(r["y"] > 0) for r in table]))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                x = np.stack([pooled(t.as_py() or "", m.vectors) for t in batch.column("text")])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(m.probability(x), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
