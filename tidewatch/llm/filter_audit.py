"""Filter interaction audit on a packed bitmap index: what each filter removes alone, after others, and in any order.

Every partition packs what its documents fail, their labels and their parts into NumPy bitsets, one block of at most BLOCK
documents per row. For each subset of filters that an order can begin with, the documents that are left are the AND-NOT of
its bitsets; ANDed with a part and a label and popcounted they give counts, which are summed over partitions. All figures
of all orders follow from these sums, of which there are 2 ** filters per part, whatever the number of documents.

`document_flags` has the five filters of the audit: A under 200 words, B under half of the words distinct, C more than 3 %
capitals, D a sign of SIGNS, E a text that a smaller doc_id has too. Null text counts as empty, so null and empty texts are
equal. A row without id has no smaller id and is nobody's; rows that repeat an id don't fail E for each other. A null lang
is the part ''. A document has a label if any row of `labels` with its id has it. Extra columns are ignored. An empty table
has no part, so no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FILTERS = ("A", "B", "C", "D", "E")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = b"#$%&*|"
#: Documents of a block, the unit of the index.
BLOCK = 1 << 20


def _own_failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: the filters that a text alone decides, and its digest."""
    for batch in batches:
        texts = batch.column("text").fill_null("")
        flags, digests = [], []
        for value, points in zip(texts.cast(pa.large_binary()), pc.utf8_length(texts).to_pylist()):
            text = value.as_py()
            words = text.split()
            capitals, signs = (len(text) - len(text.translate(None, x)) for x in (CAPITALS, SIGNS))
            flags.append((len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * points, signs > 0))
            digests.append(hashlib.sha256(text).digest())
        columns = [pa.array([f[k] for f in flags], pa.bool_()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), *columns], names=["doc_id", "part", "digest", *FILTERS[:4]])


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, quality, toxic) of every document.

    Texts are read once and stay where they are. Copies are found by SHA-256 digests, whose groups are summed map-side; the
    short rows are joined with the groups of several rows, where a hot digest may be split by the adaptive skew join.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    rows = written(own.mapInArrow(_own_failures, "doc_id long, part string, digest binary, A boolean, B boolean, C boolean, D boolean"), "audit-flags")
    # Tables of their own: a join with an aggregation's result is one that Spark can't split by skew.
    firsts = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "audit-copies")
    marks = {name: F.max(F.coalesce(F.col(name) == 1, F.lit(False))).alias(name) for name in ("quality", "toxic")}
    marked = written(labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*marks.values()), "audit-labels")
    copies = rows.join(firsts, "digest", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    return copies.join(marked, "doc_id", "left").select("part", *FILTERS, *[F.coalesce(name, F.lit(False)).alias(name) for name in marks])


INDEX = "n long, filters array<binary>, labels array<binary>, parts array<struct<part: string, first: long, bits: binary>>"


def bitmap_index(flags: DataFrame, filters: Sequence[str] = FILTERS, labels: Sequence[str] = ("quality", "toxic"), part: str = "part") -> DataFrame:
    """One row per block of documents: the bitset of every filter (set: fails it), label and part.

    Documents stand by part within a block, so a part's bitset is stored from its first byte to its last only, and all
    parts of a block together are as long as one bitset.
    """
    names = [*filters, *labels]

    def packed(codes: np.ndarray, columns: list[np.ndarray], parts: list[str]) -> pa.RecordBatch:
        order = np.argsort(codes, kind="stable")
        bits = [np.packbits(c[order]).tobytes() for c in columns]
        ends = np.cumsum(np.bincount(codes, minlength=len(parts)))
        spans = []
        for name, begin, end in zip(parts, [0, *ends[:-1].tolist()], ends.tolist()):
            first = begin >> 3
            own = np.zeros(8 * (-(-end // 8) - first), bool)
            own[begin - 8 * first : end - 8 * first] = True
            spans.append({"part": name, "first": first, "bits": np.packbits(own).tobytes()})
        k = len(filters)
        kind = pa.list_(pa.struct([("part", pa.string()), ("first", pa.int64()), ("bits", pa.binary())]))
        return pa.RecordBatch.from_arrays([pa.array([len(codes)], pa.int64()), pa.array([bits[:k]], pa.list_(pa.binary())), pa.array([bits[k:]], pa.list_(pa.binary())), pa.array([spans], kind)], names=["n", "filters", "labels", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = [], {}
        n = 0
        for batch in batches:
            codes = np.array([parts.setdefault(p, len(parts)) for p in batch.column(part).to_pylist()], np.int64)
            held.append((codes, [batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in names]))
            n += len(codes)
            if n >= BLOCK:
                yield packed(np.concatenate([c for c, _ in held]), [np.concatenate(x) for x in zip(*[c for _, c in held])], list(parts))
                held, parts, n = [], {}, 0
        if n:
            yield packed(np.concatenate([c for c, _ in held]), [np.concatenate(x) for x in zip(*[c for _, c in held])], list(parts))

    return flags.select(part, *names).mapInArrow(run, INDEX)


def subset_counts(index: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """(part, mask, kept, good, toxic): the documents that pass all filters of the mask (bit k: filter k), and those of them
    with the first and the second label; popcounts of a partition's blocks, summed over partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                failed = [np.frombuffer(b, np.uint8) for b in row["filters"]]
                alive = np.empty((1 << filters, len(failed[0])), np.uint8)
                alive[0] = 255
                for mask in range(1, 1 << filters):
                    last = mask.bit_length() - 1
                    np.bitwise_and(alive[mask ^ (1 << last)], ~failed[last], out=alive[mask])
                marks = [np.frombuffer(b, np.uint8) for b in row["labels"]]
                names, counts = [], []
                for own in row["parts"]:
                    bits = np.frombuffer(own["bits"], np.uint8)
                    at = slice(own["first"], own["first"] + len(bits))
                    left = alive[:, at] & bits
                    names.append(own["part"])
                    counts.append([np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (left, *(left & m[at] for m in marks))])
                kept, good, toxic = (np.concatenate([c[k] for c in counts]) for k in range(3))
                masks = np.tile(np.arange(1 << filters, dtype=np.int32), len(names))
                parts = pa.array(np.repeat(np.array(names, object), 1 << filters), pa.string())
                yield pa.RecordBatch.from_arrays([parts, pa.array(masks), pa.array(kept), pa.array(good), pa.array(toxic)], names=["part", "mask", "kept", "good", "toxic"])

    found = index.mapInArrow(run, "part string, mask int, kept long, good long, toxic long")
    return found.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")])


def _mask(letters: Column, names: Sequence[str]) -> Column:
    out = F.lit(0)
    for k, name in enumerate(names):
        out = out + F.when(F.contains(letters, F.lit(name)), 1 << k).otherwise(0)
    return out


def audit(counts: DataFrame, names: Sequence[str] = FILTERS) -> DataFrame:
    """One row per part, order of the one-letter filters and step, from the counts of the subsets."""
    alive = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("kept", "good", "toxic")))).alias("alive"))
    orders = alive.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(names)])))
    steps = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step"))
    steps = steps.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    steps = steps.withColumn("own", _mask(F.col("letter"), names)).withColumn("before", _mask(F.substring("filter_order", F.lit(1), F.col("step") - 1), names))
    left = lambda mask: F.element_at("alive", mask)
    every = (1 << len(names)) - 1
    before, after = left(F.col("before")), left(F.col("before") + F.col("own"))
    failing = left(F.lit(0))["kept"] - left(F.col("own"))["kept"]
    rows = steps.select(
        "part", "filter_order", "step", "letter", after["kept"].alias("kept"), (before["kept"] - after["kept"]).alias("removed"), failing.alias("failing"),
        (left(F.lit(every) - F.col("own"))["kept"] - left(F.lit(every))["kept"]).alias("unique_fails"), (before["good"] - after["good"]).alias("good_lost"), (before["toxic"] - after["toxic"]).alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return rows.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters; the index is written in the shared folder."""
    return audit(subset_counts(written(bitmap_index(document_flags(docs, labels)), "audit-index")))
