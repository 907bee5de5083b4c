"""Files as tables: reading trees and tables, the size gate, decoding, discovery limits, sinks."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import paths, text

# Limits per target.
MAX_FILE_BYTES, MAX_ENTRIES, MAX_FILES, MAX_TOTAL_BYTES = 2_000_000, 100_000, 20_000, 100_000_000


def read_source_tree(spark: SparkSession, root: str) -> DataFrame:
    """raw_files (target_id, path, length, content) under root: the first part below root is the target.

    binaryFile follows no links out of a store; content is read only where a plan uses it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inner = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/")
    base = "/" + root.split("://")[-1].removeprefix("file:").strip("/") + "/"
    relative = F.expr(f"substring(__p, locate({base!r}, __p) + {len(base)})")
    return files.withColumn("__p", inner).withColumn("__r", relative).select(F.substring_index("__r", "/", 1).alias("target_id"), F.regexp_replace("__r", r"^[^/]*/", "").alias("path"), "length", "content")


def read_sources(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table of sources (target_id, path, language, content); language is found where it is missing."""
    df = spark.read.format(fmt).load(path)
    found = paths.detect_language(F.col("path"))
    language = F.coalesce("language", found) if "language" in df.columns else found
    return df.select("target_id", "path", language.alias("language"), "content")


@F.pandas_udf(StringType())
def _decode_utf16(content: pd.Series) -> pd.Series:
    """Rows with a UTF-16 mark only; the JVM's decoder fails the job on malformed input."""

    def one(raw: bytes | None) -> str | None:
        try:
            return None if raw is None else bytes(raw).decode("utf-16")
        except UnicodeDecodeError:
            return None

    return content.map(one)


def decode_text(content: Column) -> Column:
    """Text of a file's bytes; null where they are no text."""
    wide = F.substring(content, 1, 2).isin(F.unhex(F.lit("FFFE")), F.unhex(F.lit("FEFF")))
    binary = F.contains(F.substring(content, 1, 8192), F.unhex(F.lit("00")))
    plain = F.try_validate_utf8(content.cast("string"))
    plain = F.when(plain.startswith("﻿"), F.substring(plain, 2, 2_147_483_647)).otherwise(plain)
    return F.when(wide, _decode_utf16(F.when(wide, content))).when(binary, F.lit(None).cast("string")).otherwise(plain)


def discover(raw_files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Supported files outside ignored directories with status: ok, file_too_large or undecodable_text.

    The size is tested before the content is touched. `content` is null unless the status is ok.
    """
    found = raw_files.where(~paths.in_ignored_directory(F.col("path"))).withColumn("language", paths.detect_language(F.col("path"))).where("language is not null")
    decoded = F.when(F.col("length") <= max_bytes, decode_text(F.col("content")))
    status = F.when(F.col("length") > max_bytes, "file_too_large").when(F.col("decoded").isNull(), "undecodable_text").otherwise("ok")
    return found.withColumn("decoded", decoded).select("target_id", "path", "language", "length", F.col("decoded").alias("content"), status.alias("status"))


def split_discovered(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, skipped) of discover()."""
    sources = found.where("status = 'ok'").select("target_id", "path", "language", "content")
    return sources, found.where("status <> 'ok'").select("target_id", text.redact_text(F.col("path")).alias("path"), F.col("status").alias("reason"))


def discovery_limits(raw_files: DataFrame, found: DataFrame, entries: int = MAX_ENTRIES, files: int = MAX_FILES, total: int = MAX_TOTAL_BYTES) -> DataFrame:
    """(target_id, reason) of targets beyond the limits; the first reason wins. Directories count as entries."""
    dirs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(paths.parts(F.col("path"))) - 1, F.lit(1))), lambda n: F.array_join(F.slice(paths.parts(F.col("path")), 1, n), "/"))
    seen = raw_files.where(~paths.in_ignored_directory(F.col("path"))).select("target_id", "path")
    nested = seen.where(F.contains(F.replace("path", F.lit("\\"), F.lit("/")), F.lit("/"))).select("target_id", F.explode(dirs).alias("path")).distinct()
    n = seen.unionByName(nested).groupBy("target_id").agg(F.count("*").alias("entries"))
    sizes = found.groupBy("target_id").agg(F.sum((F.col("status") == "ok").cast("long")).alias("files"), F.sum(F.when(F.col("status") != "file_too_large", F.col("length"))).alias("bytes"))
    both = n.join(sizes, "target_id", "full_outer")
    reason = F.when(F.col("entries") > entries, "too_many_entries").when(F.col("bytes") > total, "too_many_bytes").when(F.col("files") > files, "too_many_files")
    return both.withColumn("reason", reason).where("reason is not null").select("target_id", "reason")


VERSIONS = "version long, folder string"


def write_version(tables: dict[str, DataFrame], path: str, partition_by: dict[str, tuple[str, ...]] | None = None) -> int:
    """Writes tables together as the next version under path, and returns its number.

    The tables go into a new folder; only when all are there does one row of the table of versions name it, so a reader has
    all tables of one version, a rerun replaces what was there, and a run that fails changes nothing. One writer at a time;
    folders of earlier versions stay until the owner of the path removes them.
    """
    spark = next(iter(tables.values())).sparkSession
    number = (_versions(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    folder = f"version-{number}-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.partitionBy(*(partition_by or {}).get(name, ())).parquet(f"{path}/{folder}/{name}")
    spark.createDataFrame([(number, folder)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return number


def _versions(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(VERSIONS).parquet(f"{path}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSIONS)


def read_version(spark: SparkSession, path: str, table: str, version: int | None = None) -> DataFrame:
    """A table of a version, or of the latest; without any version it is a ValueError."""
    found = _versions(spark, path)
    last = (found if version is None else found.where(F.col("version") == version)).orderBy(F.desc("version")).first()
    if last is None:
        raise ValueError(f"no such version under {path}")
    return spark.read.parquet(f"{path}/{last['folder']}/{table}")


def write_findings(findings: DataFrame, path: str) -> int:
    return write_version({"findings": findings}, path, {"findings": ("severity",)})


def write_dependencies(dependencies: DataFrame, path: str) -> int:
    return write_version({"dependencies": dependencies}, path, {"dependencies": ("ecosystem",)})
