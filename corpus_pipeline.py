"""From documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, written as Parquet to the shared folder and read again
as the next one's docs. All but the last return the columns of documents. Repeated rows, null ids and null texts
pass through as the operators define it: a null or letterless text is rejected by the language stage, rows of one
doc_id count as one document in the near-duplicate stage, and a null doc_id is linked with nothing there.

All stages run in the same executors, whose memory keeps what the widest batch has taken. So texts reach Python in
Arrow batches of ``BATCH_BYTES``, unless the session has set a size, and each text only once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import decontaminate, language_mix, near_dups, packing, queries, toxicity
from colloquy.runtime import materialize, shared_dir, small_side

MIN_SHARE = 0.35  # a document whose first language has less is no text of a language
TOXIC = 0.3
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"  # Spark's default is 64m, held several times over by each task in the JVM and in Python


def _bound_batches(spark: SparkSession) -> None:
    """Plans read the size when they run, which is after a stage has returned; so it stays set."""
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, BATCH_BYTES)


def _rows(docs: DataFrame) -> DataFrame:
    """Other columns as one value beside what an operator reads, so that columns of any names survive."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*others).alias("__row")] if others else []))


def _restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, in their order, from what an operator made of ``_rows``."""
    return found.select(*(F.col(c) if c in ("doc_id", "text") else F.col("__row").getField(c).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in some language; the model is learned from the rows that are not held out."""
    _bound_batches(spark)
    model = language_mix.train(docs.where(queries.crc_mod(3) != 1).select("text", "lang"))
    found = language_mix.identify(_rows(docs), model)
    return _restored(found.where((F.col("lang_pred") != language_mix.UNKNOWN) & (F.col("score") >= MIN_SHARE)), docs)


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not predicted toxic."""
    _bound_batches(spark)
    grammar = queries.toxicity_grammar(docs, queries.table(spark, sf_dir, "labels"))
    return _restored(toxicity.score_toxicity(_rows(docs), grammar).where(F.col("score") < TOXIC), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, the one of the smallest id."""
    _bound_batches(spark)
    found = materialize(near_dups.near_duplicates(docs))
    dropped = found.where("not kept").select("doc_id").distinct()
    kept = docs.join(small_side(dropped), "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not repeated.isEmpty():  # rows of one id are one document
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).union(kept.where("doc_id is null"))
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a benchmark item."""
    _bound_batches(spark)
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))  # also tells rows of a null id apart
    leaks = materialize(decontaminate.find_leaks(keyed, queries.table(spark, sf_dir, "benchmark"), id_col="__key"))
    return keyed.join(small_side(leaks.select(F.col("doc_id").alias("__key")).distinct()), "__key", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of 4096 tokens."""
    _bound_batches(spark)
    return queries.packed_pieces(docs)


STAGES = [
    ("language ID", language),
    ("toxicity", clean_language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packed),
]

# models are learned on the way, which SQL cannot express; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/colloquy/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
