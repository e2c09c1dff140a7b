"""Inputs that the given tables lack: nulls, maps, ties, long keywords, both ways of ingestion."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import chunking, dialogue, gating, retrieval, signals, transcripts
from colloquy.plans.ingestion import update_collection
from colloquy.sources.store import CHUNKS, insert_new, open_chunks
from colloquy.streaming.ingest import ingest_stream


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("text", ["", "a short one", "x" * 70, ("the long keyword goes on and on, " * 4) + "end", "zz" + "abcdefgh " * 9])
def test_keyword_of_any_length(spark, text):
    keyword = "abcdefgh " * 8 + "and more"  # 80 characters
    got = transcripts.partial_ratio(spark.createDataFrame([(text,)], "t string"), "t", keyword).first()
    short, long = sorted([text, keyword], key=len)
    windows = {long[max(0, s):max(0, s) + min(len(short), len(short) + s)] for s in range(-len(short) + 1, len(long))}
    want = max((200 * lcs(short, w) / (len(short) + len(w)) for w in windows if w), default=0.0)
    assert got["score"] == pytest.approx(want)


def test_documents_without_id_stay(spark):
    docs = spark.createDataFrame([(None, "One. Two."), (None, "Three."), (None, "Three."), (1, "Four.")], "doc_id bigint, text string")
    got = chunking.semantic_chunks(docs)
    assert got.where("doc_id IS NULL AND text = 'Three.'").count() == 2
    assert got.where("doc_id IS NULL").select("text").distinct().count() >= 2 and got.where("doc_id = 1").count() == 1


def test_insert_new_into_the_collection(spark):
    row = ("a", 1, 0, "t", 1, "h", [1.0], {"k": "v"})
    old = spark.createDataFrame([row], CHUNKS)
    more = spark.createDataFrame([row, ("b", *row[1:]), ("b", *row[1:-1], {"k": "w"})], CHUNKS)
    assert sorted(r["chunk_id"] for r in insert_new(old, more, "chunk_id").collect()) == ["a", "b"]


def test_latest_of_equal_moments(spark):
    rows = [(1, 5, float(i)) for i in range(50)]
    for parts in (1, 3, 7):
        df = spark.createDataFrame(rows, "k int, at bigint, s double").repartition(parts)
        assert signals.latest_score(df, "k", "at", "s").first()["s"] == 49.0


def test_null_and_unequal_vectors(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 1.0])], "chunk_id int, embedding array<float>")
    asked = spark.createDataFrame([(7, None), (8, [1.0, 0.1])], "query_id int, embedding array<float>")
    assert [(r["query_id"], r["chunk_id"]) for r in retrieval.topk_search(chunks, asked, 1).collect()] == [(8, 1)]
    assert {r["query_id"] for r in retrieval.lsh_topk(chunks, asked, 1).collect()} <= {8}
    with pytest.raises(ValueError):
        retrieval.topk_search(chunks, asked.union(spark.createDataFrame([(9, [1.0])], asked.schema)), 1)


def test_map_columns_pass_through(spark):
    df = spark.createDataFrame([(1, 1, 0.9, "trigger", {"a": "b"}), (1, 2, 0.8, "answer", {"c": "d"})], "k int, s int, p double, e string, m map<string,string>")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    assert [r["m"] for r in gating.debounce(df, "k", "ts", "p", 0.5, 10.0).collect()] == [{"a": "b"}]
    assert {str(r["m"]) for r in dialogue.replay_states(df, "k", "ts", "e").collect()} == {"{'a': 'b'}", "{'c': 'd'}"}


def test_stream_and_batch_ingestion_share_a_collection(spark, tmp_path):
    texts, store = tmp_path / "texts", str(tmp_path / "store")
    texts.mkdir()
    (texts / "a.txt").write_text("Robots are kind. They help.")
    ingest_stream(spark, str(texts), store, str(tmp_path / "state")).awaitTermination()
    before = open_chunks(spark, store).count()
    docs = spark.createDataFrame([(5, "Something else. Entirely.")], "doc_id bigint, text string")
    read, made = update_collection(spark, docs, store)
    assert read == 1 and made > 0 and open_chunks(spark, store).count() == before + made
    assert update_collection(spark, docs, store) == (1, 0)
