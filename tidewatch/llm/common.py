"""What the operators share: the shared scratch folder, written tables, words and stable id folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch, shared_root, written

__all__ = ["fold", "free_name", "labelled_sample", "n_words", "read", "scratch", "shared_root", "written"]

#: A word is a run of other characters than these; the same text serves Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: The same six characters for trim().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def n_words(text: Column) -> Column:
    """Number of words as long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """(doc_id, text, y): at most `rows` labelled documents outside the held-out fold, chosen by hash of the id.

    The chosen ids are at most `rows` pairs of a long and an int, so that side is broadcast and no text is shuffled.
    Rows of one id agree on the largest label; null ids and labels teach nothing; null texts count as empty.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & (fold(F.col("__id"), folds) != held_out))
        .groupBy("__id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("__id", F.lit("sample")), "__id").limit(rows)
    )
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["__id"]).select("doc_id", "text", "y")
