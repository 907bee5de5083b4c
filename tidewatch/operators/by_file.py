"""Rows that a Python helper makes of each file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def file_rows(files: DataFrame, helper: Callable[[str, str], list], schema: str, *keep: str) -> DataFrame:
    """The rows of helper(path, content) for every file, a null content as an empty one.

    A plain function and no batch of Arrow's: Spark gives it 100 files at a time, so what a task's Python holds is bounded by
    them. Arrow's batches are 10,000 files, whose bytes grow with the table until they are full.
    """
    rows = F.udf(helper, ArrayType(StructType.fromDDL(schema)), useArrow=False)
    found = files.select("target_id", "path", "language", *keep, F.explode(rows(F.col("path"), F.coalesce("content", F.lit("")))).alias("row"))
    return found.select("target_id", "path", "language", *keep, "row.*")
