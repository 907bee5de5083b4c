"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside the groups.

Texts are equal when identical after every run of white space became one space. Null text counts as empty; empty texts
are equal to each other. A null doc_id never stays if its group has another id; a group of null ids keeps one null id
and all its rows count as kept. Rows that repeat an id share its fate: all of them are kept when the id is kept.
Extra columns are ignored by `classes` and carried along by `drop_copies`. Empty tables give empty tables.

Hashes are counted first, on short rows. Those that occur again are marked in a map of BITS bits, which is broadcast and has
the same bound at every size; only texts whose bit is set are sent to be compared. A bit that other hashes set as well costs
the shuffle of a text, never a wrong answer: with far more repeated hashes than bits, all texts are sent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name, written


#: Bits of the map of repeated hashes; it is broadcast as at most BITS / 64 rows of two longs.
BITS = 1 << 26


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def content_hash(norm: Column) -> Column:
    """128 bits as 16 bytes."""
    return F.unhex(F.md5(norm.cast("binary")))


def _bit(h: Column) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(BITS))


def repeated_hashes(rows: DataFrame) -> DataFrame:
    """(word, mask): the map of the hashes that several rows hold."""
    repeated = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("h")).bitwiseAND(F.lit(63)).cast("int"))
    return repeated.groupBy(F.shiftright(_bit(F.col("h")), 6).alias("word")).agg(F.bit_or(mask).alias("mask"))


def marked(rows: DataFrame, h: str, bits: DataFrame, name: str) -> DataFrame:
    """Adds whether the row's hash may be repeated."""
    word, mask = (free_name(rows, c) for c in ("word", "mask"))
    words = F.broadcast(bits.select(F.col("word").alias(word), F.col("mask").alias(mask)))
    found = rows.join(words, F.shiftright(_bit(F.col(h)), 6) == F.col(word), "left")
    is_set = F.getbit(F.coalesce(F.col(mask), F.lit(0).cast("long")), _bit(F.col(h)).bitwiseAND(F.lit(63)).cast("int")) == 1
    return found.withColumn(name, is_set).drop(word, mask)


def _hashed(docs: DataFrame, hashed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, digest of the text) of all rows, and the map of repeated hashes, both written."""
    norm = normalised(F.col("text"))
    rows = written(docs.select("doc_id", hashed(norm).alias("h"), F.unhex(F.sha2(norm, 256)).alias("digest")), "exact-rows")
    return rows, written(repeated_hashes(rows), "exact-repeated")


def classes(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The texts of repeated hashes are compared as bytes by grouping on (hash, text): copies meet in the map-side partial
    aggregate, so a hot group reaches its reducer as one row per task, and a hash that holds two texts shows as two rows.
    Only the short (doc_id, hash, digest) rows are joined back, where a hot hash may be split by the adaptive skew join.
    Rows of a colliding hash are joined on the text as well.
    """
    return _classes(docs, hashed, *_hashed(docs, hashed))


def _classes(docs: DataFrame, hashed: Callable[[Column], Column], rows: DataFrame, bits: DataFrame) -> DataFrame:
    base = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("h", hashed(F.col("norm")))
    texts = marked(base, "h", bits, "again").where("again").groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    per_hash = texts.groupBy("h").agg(F.count("*").alias("n_texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    per_hash = written(per_hash.where("group_size > 1"), "exact-classes")
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    grouped = F.col("n_texts").isNotNull()
    found = rows.join(per_hash, "h", "left").where(~grouped | (F.col("n_texts") == 1)).select(
        "doc_id", F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), sha
    )
    if not per_hash.where("n_texts > 1").isEmpty():
        clash = base.join(per_hash.where("n_texts > 1").select("h"), "h", "left_semi")
        exact = clash.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        found = found.unionByName(clash.join(exact, ["h", "norm"]).select("doc_id", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256")))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each class of equal texts, that of the smallest id; all columns.

    Rows whose hash is not repeated stay where they are. `classes` has compared the bytes of the others, so they are picked
    by (id, digest): the list of pairs that go is the hashed side, so no text is sorted. Only where a pair that stays has
    several rows is one of them chosen.
    """
    hashes, bits = _hashed(docs, content_hash)
    decided = _classes(docs.select("doc_id", "text"), content_hash, hashes, bits).where("group_size > 1")
    decided = written(decided.groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("kept").alias("__kept")).agg(F.count("*").alias("__rows")), "exact-decided")
    h, digest, again = (free_name(docs, c) for c in ("h", "digest", "again"))
    rows = marked(docs.withColumn(h, content_hash(normalised(F.col("text")))), h, bits, again)
    several = rows.where(F.col(again)).withColumn(digest, F.sha2(normalised(F.col("text")), 256))
    gone = decided.where("not __kept").hint("shuffle_hash")
    several = several.join(gone, several["doc_id"].eqNullSafe(gone["__id"]) & (several[digest] == gone["__sha"]), "left_anti")
    if not decided.where("__kept and __rows > 1").isEmpty():
        several = several.dropDuplicates(["doc_id", digest])
    return rows.where(~F.col(again)).drop(h, again).unionByName(several.drop(h, again, digest))
