"""The pluggable chunk store: commit, abort, overwrite, and filters that reach it."""

import glob

import pytest
from pyspark.sql import functions as F

from colloquy.sources import plugin
from colloquy.sources.store import CHUNKS


@pytest.fixture()
def store(spark, tmp_path):
    plugin.register(spark)
    return str(tmp_path / "store")


def rows(spark, ids):
    return spark.createDataFrame([(f"c{i}", i, 0, f"t{i}", 1, "h", [float(i or 0)], {"a": "b"}) for i in ids], CHUNKS)


def write(df, path, mode="append"):
    df.write.format(plugin.FORMAT).mode(mode).option("path", path).save()


def read(spark, path):
    return spark.read.format(plugin.FORMAT).option("path", path).load()


def test_append_overwrite_and_null_ids(spark, store):
    assert read(spark, store).collect() == [] and plugin.manifest(store) == (0, [])
    write(rows(spark, range(6)).repartition(3), store)
    write(rows(spark, [None, 9]), store)
    got = read(spark, store)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text, r.embedding, r.metadata["a"]) for r in got.collect()) == sorted(
        (i if i is not None else -1, f"t{i}", [float(i or 0)], "b") for i in [*range(6), None, 9])
    write(rows(spark, [7]), store, "overwrite")
    assert [r.doc_id for r in read(spark, store).collect()] == [7] and plugin.manifest(store)[0] == 3


def test_a_failed_write_leaves_nothing(spark, store):
    write(rows(spark, [1]), store)
    bad = rows(spark, range(8)).repartition(2).withColumn("text", F.when(F.col("doc_id") == 5, F.raise_error("no").cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no"):
        write(bad, store)
    assert [r.doc_id for r in read(spark, store).collect()] == [1] and plugin.manifest(store)[0] == 1


def test_filters_reach_the_store(spark, store):
    write(rows(spark, [*range(100), None]).repartitionByRange(5, "doc_id"), store)
    assert len(plugin.manifest(store)[1]) == len(glob.glob(f"{store}/chunks/*.parquet")) == 5
    for condition, want in (("doc_id = 42", [42]), ("doc_id IN (3, 97, 500)", [3, 97]), ("doc_id >= 98", [98, 99]), ("doc_id < 2", [0, 1]),
                            ("doc_id > 10 AND doc_id <= 12", [11, 12]), ("doc_id > 95 AND text = 't97'", [97]), ("doc_id IS NULL", [None])):
        asked = read(spark, store).where(condition)
        assert sorted((r.doc_id for r in asked.collect()), key=str) == want, condition
    asked = read(spark, store).where("doc_id = 42")
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter (" not in plan, plan  # the store has taken the filter over
    assert asked.rdd.getNumPartitions() == 1 and read(spark, store).rdd.getNumPartitions() == 5  # files that cannot hold it are not read
