"""Spelling variant grouping: words that differ by one edit, found by the parities of their letters.

A word's mask has one bit per letter, set if the letter occurs an odd number of times. One inserted or deleted letter flips
one bit and a replaced one two, so of three bands that the bits are dealt into one is equal in both words. Words meet by
equal band; the length filter lets a pair of words meet only in the class of the longer one's length. As an edit leaves the
first or the second half of the longer word's letters as they are, words meet by that half as well: a band of a large
vocabulary is shared by a share of all words, and a band with a half by few. Pairs are verified inside the join by their
masks and then letter by letter, and a pair counts only under the first band and half that it shares, so it comes once.

Words are runs of LETTERS of whole texts with A-Z in lower case, counted in each task before they are shuffled. Per document
and run, `h` is the crc32 of '<doc_id>:<run>'; where 31 divides it, the letter at h % length is left out (misspelt copies of
known place, which the contract asks for). A null id is written as nothing: ':<run>'. Null and empty texts have no words; rows
that repeat an id are counted each. Extra columns are ignored. Empty tables give empty tables.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: What latin-1 bytes become: letters in lower case, all others a blank. À to ÿ are letters and keep their case.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
BANDS = 3
#: Distinct words that a task holds before it hands their counts on.
HELD = 400_000


def document_words(text: str | None, doc_id: int | None, least: int, every: int) -> Iterator[tuple[bytes, int]]:
    """(word as latin-1, occurrences) of a text: every letter fits in a byte, and what is none becomes '?' or a blank."""
    runs = Counter(w for w in (text or "").encode("latin-1", "replace").translate(LETTERS).split() if len(w) >= least)
    lead = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
    for word, n in runs.items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), lead)
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < least:
                continue
        yield word, n


def word_counts(docs: DataFrame, least: int = 7, twice: int = 2, every: int = 31) -> DataFrame:
    """(word, n): words of at least `least` letters and `twice` occurrences in all documents."""

    def handed(counts: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for word, n in document_words(text.as_py(), doc_id, least, every):
                    counts[word] = counts.get(word, 0) + n
                if len(counts) >= HELD:
                    yield handed(counts)
                    counts = {}
        yield handed(counts)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


def parity_mask(word: Column) -> Column:
    """64 bits: bit 0 to 25 for a to z, the others in turn for the letters beyond."""
    code = lambda c: F.when(F.ascii(c) < 128, F.ascii(c) - 97).otherwise(26 + (F.ascii(c) - 0xC0) % 38)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), code(c).cast("int"))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, c: mask.bitwiseXOR(bit(c)))


def band(mask: Column, k: int) -> Column:
    """The bits k, k + BANDS, ... of a mask."""
    own = sum(1 << j for j in range(k, 64, BANDS))
    return mask.bitwiseAND(F.lit(own - (1 << 64) if own >= 1 << 63 else own).cast("long"))


def half(word: Column, size: Column, longest: Column, side: int) -> Column:
    """The first or last floor(longest / 2) letters: one of them outlives any edit of a word of `longest` letters."""
    k = F.floor(longest / 2).cast("int")
    return F.substring(word, F.lit(1), k) if side == 0 else F.substring(word, size - k + 1, k)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), a < b: all pairs of words that differ by one inserted, deleted or replaced letter, each once."""
    size = F.length("word")
    masked = words.select("word", "n", size.cast("int").alias("size"), parity_mask(F.col("word")).alias("mask"))
    met = masked.withColumn("longest", F.explode(F.array(F.col("size"), F.col("size") + 1)))
    # The tag says which band and half a row is for; the hash stands for both values, and other values that share it fail the tests.
    keys = [F.struct(F.lit(2 * k + side).alias("tag"), F.xxhash64(band(F.col("mask"), k), half(F.col("word"), F.col("size"), F.col("longest"), side)).alias("h")) for k in range(BANDS) for side in (0, 1)]
    rows = met.select("word", "n", "size", "mask", "longest", F.explode(F.array(*keys)).alias("key")).select("word", "n", "size", "mask", "longest", "key.tag", "key.h")
    a, b = rows.alias("a"), rows.alias("b")
    of = lambda side, name: F.col(f"{side}.{name}")
    flipped = of("a", "mask").bitwiseXOR(of("b", "mask"))
    first_band = F.when(band(flipped, 0) == 0, 0).when(band(flipped, 1) == 0, 1).otherwise(2)
    first_side = F.when(half(of("a", "word"), of("a", "size"), of("a", "longest"), 0) == half(of("b", "word"), of("b", "size"), of("b", "longest"), 0), 0).otherwise(1)
    test = (
        (of("a", "h") == of("b", "h")) & (of("a", "longest") == of("b", "longest")) & (of("a", "tag") == of("b", "tag")) & (of("a", "word") < of("b", "word"))
        & (F.greatest(of("a", "size"), of("b", "size")) == of("a", "longest")) & (F.bit_count(flipped) <= 2) & (of("a", "tag") == 2 * first_band + first_side)
        & (F.levenshtein(of("a", "word"), of("b", "word"), 1) == 1)
    )
    return a.join(b, test).select(of("a", "word").alias("a"), of("a", "n").alias("n_a"), of("b", "word").alias("b"), of("b", "n").alias("n_b"))


def roots(forms: DataFrame, most: int, times: int) -> DataFrame:
    """(word, root) from (word, form): forms are followed by doubling until the last, in rounds that the largest count bounds,
    as every form is `times` times as frequent as its word."""
    depth = max(1, math.ceil(math.log(max(2, most), times)))
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(1, depth.bit_length())):
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = written(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return found


def variants(docs: DataFrame, least: int = 7, twice: int = 2, every: int = 31, times: int = 10) -> DataFrame:
    """One row per word: word, n, n_near, form (the near word of largest n, of ties the first, if it is `times` times as
    frequent), form_n, root (the last form of the chain, or the word itself)."""
    words = written(word_counts(docs, least, twice, every), "words")
    pairs = near_pairs(words).select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = written(pairs.groupBy("word", "n").agg(F.count("*").alias("n_near"), best), "near-words")
    near = near.withColumn("form", F.when(-F.col("best.less") >= times * F.col("n"), F.col("best.near"))).withColumn("form_n", F.when(F.col("form").isNotNull(), -F.col("best.less")))
    most = words.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    last = roots(near.where("form is not null").select("word", "form"), most, times)
    known = near.select("word", "n_near", "form", "form_n").join(last, "word", "left")
    return words.join(known, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
