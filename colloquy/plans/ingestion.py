"""From documents to a stored collection of embedded chunks."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.chunking import (
    BREAK_PERCENTILE, BUFFER_SIZE, CHUNK_OVERLAP, CHUNK_SIZE, chunk_documents, chunk_fingerprint, new_chunks,
)
from colloquy.operators.documents import append_tables, scalar_metadata
from colloquy.operators.embedding import DIM, embed
from colloquy.runtime import materialize, small_side
from colloquy.sources.store import CHUNKS, open_chunks


def prepare_documents(docs: DataFrame) -> DataFrame:
    """Move table texts into the documents and reduce metadata to scalars.

    ``docs(doc_id, text[, tables, metadata])`` with metadata as a JSON string.
    """
    if "tables" in docs.columns:
        docs = append_tables(docs)
    if "metadata" in docs.columns:
        docs = scalar_metadata(docs, "metadata")
    else:
        docs = docs.withColumn("metadata", F.lit(None).cast("map<string,string>"))
    return docs.select("doc_id", "text", "metadata")


def build_chunks(
    docs: DataFrame, seen: DataFrame | None = None, embedder=None, chunk_size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP, buffer_size: int = BUFFER_SIZE, pct: float = BREAK_PERCENTILE, dim: int = DIM,
) -> DataFrame:
    """Chunks of prepared documents that their document does not have in ``seen``, with embeddings.

    Rows of one id and text are one document (the smallest metadata as text is taken); rows of one id with different
    texts each give their chunks. Documents without an id are told apart by their text.
    """
    docs = _single(docs)
    cut = chunk_documents(docs, "doc_id", "text", chunk_size, overlap, buffer_size, pct, dim, ("metadata", "doc_key"))
    settings = {
        "chunk_size": chunk_size, "overlap": overlap, "buffer_size": buffer_size, "pct": pct, "dim": dim,
        "embedder": getattr(embedder, "__name__", "hashed"),
    }
    named = chunk_fingerprint(cut, settings).withColumn(
        "chunk_id", F.concat_ws("-", "doc_key", "chunk_no", "part", F.substring("content_hash", 1, 12))
    )
    if seen is not None:
        named = materialize(named)  # the split runs once, although known fingerprints are looked for first
        named = new_chunks(named, seen, on=("doc_id", "content_hash"))
    return embed(named, "text", embedder, dim).select(
        "chunk_id", "doc_id", F.col("chunk_no").alias("pos"), "text", "n_tokens", "content_hash", "embedding", "metadata"
    )


def _single(docs: DataFrame) -> DataFrame:
    """Each (id, text) once, with the key that chunks are named by; texts move only if some are repeated.

    The key is the id. A text without an id, or with one that other texts have as well, adds its hash.
    """
    told = docs.select("doc_id", F.xxhash64("text").alias("h"))
    repeated = told.groupBy("doc_id", "h").count().where("count > 1")
    if not repeated.isEmpty():
        docs = docs.groupBy("doc_id", "text").agg(
            F.min_by("metadata", F.coalesce(F.to_json("metadata"), F.lit(""))).alias("metadata"))
    named = F.col("doc_id").cast("string")
    hashed = F.hex(F.xxhash64("text"))
    shared = told.distinct().where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("_shared"))
    if shared.isEmpty():
        return docs.withColumn("doc_key", F.coalesce(named, hashed))
    both = docs.join(small_side(shared), "doc_id", "left")
    key = F.when(F.col("doc_id").isNull(), hashed).when(F.col("_shared"), F.concat_ws("-", named, hashed)).otherwise(named)
    return both.withColumn("doc_key", key).drop("_shared")


def update_collection(spark: SparkSession, docs: DataFrame, path: str, wipe: bool = False, **settings) -> tuple[int, int]:
    """Chunk and store ``docs``; returns documents read and chunks created.

    New chunks are written to a batch folder of their own below the collection, as
    the stream of ingestion does, so both may feed one collection, a repeated run
    never leaves half a file and reading stays one scan.
    """
    seen = None if wipe else open_chunks(spark, path)
    made = build_chunks(prepare_documents(docs), seen, **settings)
    return docs.count(), _store(spark, made, path, wipe)


def _store(spark: SparkSession, made: DataFrame, path: str, wipe: bool) -> int:
    before = 0 if wipe else open_chunks(spark, path).count()
    # the stream numbers its batches from 0 up
    batch = made.withColumn("batch", F.lit(-time.time_ns()))
    batch.write.mode("overwrite" if wipe else "append").partitionBy("batch").parquet(path)
    return open_chunks(spark, path, CHUNKS).count() - before
