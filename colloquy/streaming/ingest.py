"""Incremental ingestion: unchanged files and unchanged chunks are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.plans.ingestion import build_chunks, prepare_documents
from colloquy.sources.files import EXTENSIONS, _pattern
from colloquy.sources.store import CHUNKS, open_chunks


def ingest_stream(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, exts=EXTENSIONS,
    files_per_batch: int = 10_000, **settings,
) -> StreamingQuery:
    """Process the files that are new since the last run, then stop.

    The stream checkpoint remembers files, the collection's fingerprints remember
    chunks. Each micro-batch overwrites a folder of its own, so a batch repeated
    after a failure does not store anything twice.
    """
    files = (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .text(in_dir, wholetext=True, recursiveFileLookup=True, pathGlobFilter=_pattern(exts))
        .select(
            F.xxhash64("_metadata.file_path").alias("doc_id"),
            F.col("value").alias("text"),
            F.to_json(F.struct(
                F.col("_metadata.file_path").alias("file_path"),
                F.col("_metadata.file_name").alias("file_name"),
                F.col("_metadata.file_size").alias("file_size"),
            )).alias("metadata"),
        )
    )

    def store(batch: DataFrame, number: int) -> None:
        target = f"{out_dir.rstrip('/')}/batch={number}"
        known = open_chunks(spark, out_dir, f"{CHUNKS}, batch bigint").where(F.col("batch") != number)
        build_chunks(prepare_documents(batch), known, **settings).write.mode("overwrite").parquet(target)

    return (
        files.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
