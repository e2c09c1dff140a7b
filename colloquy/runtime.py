"""Shared folder, written intermediate tables and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when a count has shown it to be at most this long.
BROADCAST_ROWS = 200_000
# Characters of text in a partition whose words become rows.
TASK_CHARS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A session in local mode without the setting gets a temporary folder. A
    cluster without it is an error, since a machine-local folder would be lost
    with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="colloquy-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage and fixes row placement, so that every branch of a later plan
    sees the same rows even if executors are lost. Parquet keeps column pruning
    and filter pushdown for the branches, which an RDD checkpoint would not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/colloquy/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def within(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than needed."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the size check passes, else leave the join to AQE."""
    return F.broadcast(df) if within(df, rows) else df


def text_tasks(df: DataFrame, text: str, chars: int = TASK_CHARS) -> int:
    """Partitions that texts need to have about ``chars`` characters each, at least one for each core.

    For texts that are taken apart: a number that is fixed, or chosen by the size of the texts as they are, would make
    tasks grow with the input, which then spill. One pass over the lengths.
    """
    total = df.agg(F.sum(F.length(text).cast("bigint"))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-total // chars))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, for row-wise work on an input with few splits.

    A table of one or two row groups would keep one or two cores busy. An input
    with at least as many splits as cores is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
