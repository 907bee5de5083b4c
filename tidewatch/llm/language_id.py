"""Language ID: nearest of several clustered centroids per language, by cosine of normalised TF-IDF n-gram vectors.

An n-gram is 1 to 3 bytes of the lower-cased text with everything but letters turned into single blanks; it is hashed to
one of DIMENSIONS places. Document frequencies come from every learnable document; centroids from spherical k-means over
a bounded sample of each language. The score is the cosine with the nearest centroid, from 0 to 1; a document further from
it than nearly all of that language's sample is marked rejected.

Null texts and texts without a letter are "und" with score 0, not rejected. Null languages teach nothing. Without any
learnable document every text is "und". Of equally near centroids the first by language name wins. Rows that repeat an id
are all predicted, and teach each by its text; rows that repeat both are one row of the sample, so every language with a
learnable row has a centroid, however its ids are dealt. Extra columns are ignored. Long texts are counted whole, CHUNK
characters at a time. The model grows with the languages, so their number is counted first: more than `most_languages` are a
ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, written

DIMENSIONS = 4096
CHUNK = 1 << 20


NOT_LETTERS = re.compile(r"[\W\d_]+")


@cache
def _numbers() -> dict[int, str]:
    """Characters that the expression above lets through and that are no letters, such as a half or a superscript two."""
    return {ord(c): " " for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()}


def letters_of(text: str) -> str:
    """The lower-cased text with everything but letters turned into single blanks."""
    words = NOT_LETTERS.sub(" ", text.lower())
    if words and not words.replace(" ", "a").isalpha():
        words = re.sub(" +", " ", words.translate(_numbers()))
    return words


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))



def counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a text."""
    total = np.zeros(DIMENSIONS)
    words = letters_of(text)
    for a in range(0, len(words), CHUNK):
        b = np.frombuffer((" " + words[a : a + CHUNK] + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
        two = b[:-1] * 257 + b[1:]
        three = two[:-1] * 257 + b[2:]
        for k, grams in enumerate((b, two, three)):
            total += np.bincount((grams * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(20), minlength=DIMENSIONS)
    return total


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(text)) * idf
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]  # one per centroid
    centroids: np.ndarray
    furthest: np.ndarray  # least cosine that is not rejected, per centroid


def learnable(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    ok = F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != held_out)
    return docs.where(ok).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each place; summed by Spark, at most DIMENSIONS + 1 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                total[:-1] += counts(text.as_py()) > 0
                total[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1)), pa.array(total)], names=["place", "n"])

    rows = docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(DIMENSIONS + 1)
    for place, n in rows:
        total[place] = n
    return int(total[-1]), total[:-1]


def k_means(x: np.ndarray, k: int, turns: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from a farthest-first start; centroids and each row's cosine with its own."""
    picked = [0]
    near = x @ x[0]
    while len(picked) < min(k, len(x)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    centroids = x[picked]
    for _ in range(turns):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else centroids[j] for j in range(len(centroids))])
        fresh = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if np.allclose(fresh, centroids):
            break
        centroids = fresh
    return centroids, (x @ centroids.T).argmax(axis=1)


def fit(docs: DataFrame, per_language: int = 300, clusters: int = 4, folds: int = 3, held_out: int = 1, reject: float = 0.001, most_languages: int = 1_000) -> Model:
    """Learns from rows outside the held-out fold: all of them for the frequencies, at most `per_language` texts of each
    language, chosen by hash of id and text, for the centroids. The model has `clusters` vectors of 32 KB for each language."""
    train = learnable(docs, folds, held_out)
    n, df = document_frequencies(train)
    idf = np.log((n + 1.0) / (df + 1.0)) + 1.0
    mark = F.pmod(F.xxhash64("doc_id", "text", F.lit("centroids")), F.lit(1 << 30))
    sizes = train.groupBy("lang").agg(F.approx_count_distinct(mark).alias("size"), F.min(mark).alias("first"))
    # A hash limit per language keeps about per_language rows; what falls under it is sampled before any shuffle of texts.
    share = F.least(F.lit(1.0), (1.5 * per_language + 30) / F.col("size"))
    # The smallest hash is always under the limit.
    limits = written(sizes.select(F.col("lang").alias("__lang"), F.greatest(share * (1 << 30), F.col("first") + 1.0).alias("__most")), "language-limits")
    if (found := limits.count()) > most_languages:
        raise ValueError(f"{found} languages; a model holds at most {most_languages}")
    picked = train.join(F.broadcast(limits), F.col("lang") == F.col("__lang")).where(mark < F.col("__most")).select("doc_id", "lang", mark.alias("mark"), "text")
    sample = written(picked.dropDuplicates(["lang", "mark"]), "language-sample")

    def vectors(batches):
        for batch in batches:
            found = [vector(t, idf).astype(np.float32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("mark"), pa.array(found, pa.binary())], names=["doc_id", "lang", "mark", "v"])

    def clustered(table: pa.Table) -> pa.Table:
        """One language: its centroids, and the least cosine of each that is not rejected."""
        table = table.sort_by([("mark", "ascending"), ("doc_id", "ascending"), ("v", "ascending")]).slice(0, per_language)
        x = np.stack([np.frombuffer(v, np.float32) for v in table.column("v").to_pylist()]).astype(np.float64)
        found, own = k_means(x, clusters)
        cosine = (x * found[own]).sum(axis=1)
        least = [float(np.quantile(cosine[own == j], reject)) * 0.9 if (own == j).any() else 0.0 for j in range(len(found))]
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(found), pa.string()), "j": pa.array(range(len(found)), pa.int32()), "centroid": pa.array([c.tobytes() for c in found], pa.binary()), "least": pa.array(least, pa.float64())})

    per_text = written(sample.mapInArrow(vectors, "doc_id long, lang string, mark long, v binary"), "language-vectors")
    rows = per_text.groupBy("lang").applyInArrow(clustered, "lang string, j int, centroid binary, least double").orderBy("lang", "j").collect()
    centroids = np.array([np.frombuffer(r["centroid"]) for r in rows]).reshape(len(rows), DIMENSIONS)
    return Model(idf, [r["lang"] for r in rows], centroids, np.array([r["least"] for r in rows]))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row, whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            langs, scores, rejected = [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                if text is None or not len(m.languages) or not has_letter(text):
                    langs.append("und"), scores.append(0.0), rejected.append(False)
                    continue
                cosines = m.centroids @ vector(text, m.idf)
                j = int(cosines.argmax())
                langs.append(m.languages[j])
                scores.append(float(min(1.0, max(0.0, cosines[j]))))
                rejected.append(bool(cosines[j] < m.furthest[j]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
