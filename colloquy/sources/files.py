"""Folders of texts and line lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.text import not_comment, regex_trim

# Text formats that are read. Binary formats need a decoder outside.
EXTENSIONS = ("txt", "md")


def _pattern(exts) -> str:
    return "*.{" + ",".join(e.lstrip(".") for e in exts) + "}"


def scan_documents(spark: SparkSession, path: str, exts=EXTENSIONS) -> DataFrame:
    """Every file below ``path`` with one of the extensions, one row per file."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=_pattern(exts))
    return files.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("value").alias("text"),
    )


def drop_comments(df: DataFrame, col: str) -> DataFrame:
    """Drop blank and ``#`` lines, trim the rest."""
    return df.where(not_comment(col)).withColumn(col, regex_trim(col))


def scan_line_list(spark: SparkSession, path: str) -> DataFrame:
    return drop_comments(spark.read.text(path), "value")
