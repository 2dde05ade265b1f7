"""Raw JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value, file_path and block_start of every line; gzip and zstd files are read by their ending.

    Files are split by size as Spark sees fit, never inside a line; a missing path is an error.
    """
    rows = spark.read.text(paths)
    return rows.select("value", F.col("_metadata.file_name").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"))


def count_lines(spark: SparkSession, paths: str | list[str]) -> int:
    return spark.read.text(paths).count()


def write_json(events: DataFrame, path: str, mode: str = "error") -> None:
    """Events as JSON lines, fields in declaration order."""
    from ..functions.expr import event_json

    events.select(event_json().alias("value")).write.mode(mode).text(path)
