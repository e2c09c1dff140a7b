"""Preparing documents and keeping the books of an ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.ordered import RUN_ROWS, arrange

# The frame around table texts and the rows of one write batch.
TABLE_OPEN = "\n\n--- TABLE CONTENT ---\n\n"
TABLE_CLOSE = "\n\n--- END TABLE CONTENT ---"
BATCH_ROWS = 100


def append_tables(df: DataFrame, text: str = "text", tables: str = "tables") -> DataFrame:
    """Append the non-empty ``detailed_content`` of a document's tables to its text."""
    contents = F.filter(F.col(tables)["detailed_content"], lambda c: c.isNotNull() & (c != ""))
    block = F.concat(F.col(text), F.lit(TABLE_OPEN), F.array_join(contents, "\n\n"), F.lit(TABLE_CLOSE))
    return df.withColumn(text, F.when(F.size(contents) > 0, block).otherwise(F.col(text)))


def scalar_metadata(df: DataFrame, json_col: str, out: str = "metadata") -> DataFrame:
    """Metadata as ``map<string,string>`` of its scalar and null values.

    Arrays and objects are dropped; a boolean counts as a number and stays.
    """
    raw = F.from_json(F.col(json_col), "map<string,variant>")
    kind = F.schema_of_variant
    flat = F.map_filter(raw, lambda k, v: ~kind(v).startswith("ARRAY") & ~kind(v).startswith("OBJECT"))
    return df.withColumn(out, F.transform_values(flat, lambda k, v: v.cast("string")))


def assign_batches(df: DataFrame, order_cols, size: int = BATCH_ROWS, run_rows: int = RUN_ROWS) -> DataFrame:
    """Number rows in order into batches: ``batch_num`` of ``total_batches``."""
    rows = arrange(df, [], order_cols, run_rows)
    total = -(-rows.longest // size)
    numbered = rows.running_sum(F.lit(1), "_no").result()
    return numbered.select(
        *df.columns,
        (F.floor((F.col("_no") - 1) / size) + 1).cast("bigint").alias("batch_num"),
        F.lit(total).cast("bigint").alias("total_batches"),
    )


def ingest_report(docs: DataFrame, chunks: DataFrame, by=(), seconds: float | None = None) -> DataFrame:
    """Documents read and chunks created, in all or per ``by`` column of both."""
    by = [by] if isinstance(by, str) else list(by)
    read = docs.select(*by, F.lit(1).alias("_d"), F.lit(0).alias("_c"))
    made = chunks.select(*by, F.lit(0).alias("_d"), F.lit(1).alias("_c"))
    return read.unionByName(made).groupBy(*by).agg(
        F.coalesce(F.sum("_d"), F.lit(0)).alias("documents"),
        F.coalesce(F.sum("_c"), F.lit(0)).alias("chunks"),
        F.lit(seconds).cast("double").alias("seconds"),
    )
