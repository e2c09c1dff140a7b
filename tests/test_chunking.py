import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import chunking
from colloquy.operators.embedding import embed, hash_embed, to_dense


def texts(n, seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["été", "straße"]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randrange(1, 25)):
            length = rnd.choice([1, 3, 5, 9, 40])
            parts.append(" ".join(rnd.choice(vocabulary) for _ in range(length)) + rnd.choice(".!?"))
        out.append((i, rnd.choice([" ", "\n", ""]).join(parts) + rnd.choice(["", " ", "\n"])))
    return out


def pack_by_hand(units, size, shared):
    """One unit at a time, as a plain loop."""
    chunks, start = [], 0
    while start < len(units):
        end, total = start, 0
        while end < len(units) and total + units[end] <= size:
            total += units[end]
            end += 1
        chunks.append((start, end))
        if end == len(units):
            break
        nxt, kept = end, 0
        while nxt > start and kept + units[nxt - 1] <= min(shared, size - units[end]):
            kept += units[nxt - 1]
            nxt -= 1
        start = nxt
    return chunks


@pytest.mark.parametrize("size,shared", [(12, 4), (20, 0), (7, 6)])
def test_packing_equals_a_loop(spark, size, shared):
    import re

    rows = texts(40)
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {}
    for r in chunking.pack_sentences(df, chunk_size=size, overlap=shared).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_tokens))
        assert r.n_tokens <= size
    for i, text in rows:
        units = []
        for s in re.findall(r"[^.!?]+[.!?]*", text):
            ws = re.findall(r"\s*\S+(?:\s+$)?", s)
            cut = [ws[a:a + size] for a in range(0, len(ws), size)] if len(ws) > size else [ws]
            units += [("".join(w), len(w)) if len(ws) > size else (s, len(w)) for w in cut]
        want = pack_by_hand([n for _, n in units], size, shared)
        assert got[i] == [("".join(t for t, _ in units[a:b]), sum(n for _, n in units[a:b])) for a, b in want]


def test_chunks_without_overlap_rebuild_the_text(spark):
    rows = texts(30, seed=5)
    df = spark.createDataFrame(rows, "doc_id int, text string")
    for cut in (
        chunking.pack_sentences(df, chunk_size=15, overlap=0),
        chunking.semantic_chunks(df).withColumnRenamed("chunk_no", "pos"),
        chunking.token_windows(df, "doc_id", "text", 6),
    ):
        whole = cut.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "text")))["text"], "").alias("t"))
        assert {r.doc_id: r.t for r in whole.collect()} == dict(rows)


def test_few_sentences(spark):
    df = spark.createDataFrame([(1, "Only one."), (2, "a b. a b. a b. a b."), (3, ""), (4, "...")], "doc_id int, text string")
    got = {(r.doc_id, r.chunk_no): r.text for r in chunking.semantic_chunks(df).collect()}
    # equal distances break nothing; a text without a sentence gives no chunk
    assert got == {(1, 0): "Only one.", (2, 0): "a b. a b. a b. a b."}


def test_break_where_the_subject_changes(spark):
    text = "red blue. red blue. red blue. one two. one two. one two."
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = [r.text for r in chunking.semantic_chunks(df, buffer_size=0).orderBy("chunk_no").collect()]
    assert got == ["red blue. red blue. red blue.", " one two. one two. one two."]


def test_windows_overlap_and_stop_at_the_end(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j")], "id int, text string")
    got = [r.text for r in chunking.token_windows(df, "id", "text", 4, 2).orderBy("pos").collect()]
    assert got == ["a b c d", " c d e f", " e f g h", " g h i j"]


def test_new_chunks_keep_copies_and_survive_a_hot_text(spark, monkeypatch):
    rows = [(str(i), "same" if i % 3 else f"t{i}") for i in range(60)]
    df = chunking.chunk_fingerprint(spark.createDataFrame(rows, "chunk_id string, text string"), {"a": 1})
    seen = df.where("text IN ('t0', 't3')")
    want = sorted(r[0] for r in rows if r[1] not in ("t0", "t3"))
    assert sorted(r.chunk_id for r in chunking.new_chunks(df, seen).collect()) == want
    monkeypatch.setattr(chunking, "within", lambda *_: False)
    assert sorted(r.chunk_id for r in chunking.new_chunks(df, seen).collect()) == want
    assert chunking.new_chunks(df, df.where("text = 'same'")).count() == 20
    other = chunking.chunk_fingerprint(df.drop("content_hash"), {"a": 2})
    assert chunking.new_chunks(other, seen).count() == 60


def test_both_forms_of_the_embedding_agree(spark):
    df = spark.createDataFrame(texts(20) + [(99, "123 --"), (100, "")], "id int, text string")
    dense = {r.id: r.embedding for r in embed(df, "text", dim=32).collect()}
    sparse = {r.id: r.embedding for r in to_dense(hash_embed(df, "id", "text", 32), "id", 32).collect()}
    assert {i: v for i, v in dense.items() if any(v)} == sparse
    assert dense[99] == dense[100] == [0.0] * 32


def test_own_embedder(spark):
    import pandas as pd
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def lengths(s: pd.Series) -> pd.Series:
        return s.str.len().map(lambda n: [float(n), 1.0])

    df = spark.createDataFrame([(1, "abc")], "id int, text string")
    assert embed(df, "text", lengths).first().embedding == [3.0, 1.0]


@pytest.mark.parametrize("buffer_size", [0, 1, 2])
def test_distances_of_joined_sentences(spark, buffer_size):
    import hashlib
    import math
    import re
    from collections import Counter

    rows = texts(15, seed=9) + [(90, "123. 456. abc."), (91, "one.")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {
        (r.doc_id, r.pos): r.distance
        for r in chunking.adjacent_distance(chunking.sentence_counts(df, dim=16), buffer_size=buffer_size).collect()
    }
    want = {}
    for i, text in rows:
        sents = re.findall(r"[^.!?]+[.!?]*", text)
        vectors = []
        for p in range(len(sents)):
            joined = "".join(sents[max(0, p - buffer_size): p + buffer_size + 1]).lower()
            found = re.findall(r"[^\W\d_]+", joined)
            vectors.append(Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16 for w in found))
        for p in range(1, len(sents)):
            a, b = vectors[p - 1], vectors[p]
            norm = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
            want[(i, p)] = round(1 - (sum(a[k] * b[k] for k in a) / norm if norm else 0.0), 9)
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("buffer_size", [0, 1, 2])
def test_both_forms_of_the_distances_agree(spark, monkeypatch, buffer_size):
    """Inside the row, in stretches shorter than a document, as in long form; breaks as from the threshold."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(chunking, "_TILE", 16 * 4)
    rows = texts(25, seed=3) + [(90, "123. 456. abc."), (91, "one."), (92, "..!"), (93, "Ab cd. ab cd! ab CD? x. ab")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    long = chunking.adjacent_distance(chunking.sentence_counts(df, dim=16), buffer_size=buffer_size)
    want = {}
    for r in long.orderBy("doc_id", "pos").collect():
        want.setdefault(r.doc_id, []).append(r.distance)
    limits = {r.doc_id: r.threshold for r in chunking.breakpoint_threshold(long, pct=70).collect()}
    far = chunking.neighbour_distances(chunking.sentences_of("text"), buffer_size, 16)
    got = df.withColumn("far", far).withColumn("breaks", chunking.semantic_breaks(F.col("far"), 70)).collect()
    assert {r.doc_id: r.far for r in got if r.far} == want
    assert {r.doc_id: r.breaks for r in got if r.far} == {
        i: [p for p, d in enumerate(ds, 1) if d > limits[i]] for i, ds in want.items()}


def test_tasks_of_the_split_do_not_grow_with_the_input(spark, monkeypatch):
    """Partitions follow the characters, and no sort, window or aggregate of words is left in the split."""
    from colloquy import runtime
    from colloquy.operators import embedding

    df = spark.createDataFrame([(i, "Some words here. Others there! " * 40) for i in range(300)], "doc_id int, text string")
    assert runtime.text_tasks(df, "text", 10_000) == -(-300 * 31 * 40 // 10_000)
    for module in (chunking, embedding):
        monkeypatch.setattr(module, "text_tasks", lambda *_: 37)
    plan = chunking.chunk_documents(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "37" in plan
    assert "37" in embedding.hash_embed(df, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
