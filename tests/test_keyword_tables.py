import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_transcripts import plain_ratio

from colloquy.operators import keyword_tables as tables
from colloquy.operators import transcripts


def grams(s, q):
    return [s[i: i + q] for i in range(len(s) - q + 1)]


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", min_size=2, max_size=24), st.text("abcd", min_size=1, max_size=24), st.sampled_from([70, 75, 80, 90, 95, 100]))
def test_pairs_at_the_cutoff_share_the_least_number_of_grams(a, b, cutoff):
    short, long = sorted((a, b), key=len)
    if plain_ratio(long, short)[0] < cutoff:
        return
    for q in tables.GRAMS:
        if tables.shared_share(q, cutoff) > 0:
            there = set(grams(long, q))
            assert sum(g in there for g in grams(short, q)) >= tables.least_shared(len(short), q, cutoff)


def test_gram_lengths_follow_the_cutoff():
    assert tables.gram_length(60) is None and tables.gram_length(75) == 2 and tables.gram_length(90) == 3 and tables.gram_length(96) == 4


def tables_of(spark, seed, texts=60, phrases=90):
    """Phrases of 1 to 70 letters and texts that hold damaged copies of them."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstuvwé") for _ in range(rnd.randrange(1, 8)))
    listed = [" ".join(word() for _ in range(rnd.choice([1, 2, 3, 4, 12]))) for _ in range(phrases)]
    said = []
    for _ in range(texts):
        keep = list(rnd.choice(listed))
        for _ in range(rnd.randrange(0, 4)):
            at = rnd.randrange(len(keep) + 1)
            keep[at: at + rnd.randrange(2)] = rnd.choice(["", "x", "é"])
        cut = slice(rnd.randrange(3), None) if rnd.random() < 0.3 else slice(None)
        said.append(" ".join(word() for _ in range(rnd.choice([0, 1, 20]))) + "".join(keep)[cut] + rnd.choice(["", " " + word()]))
    return said, listed


@pytest.mark.parametrize("cutoff", [60, 75, 90, 97])
def test_matches_equal_all_pairs(spark, cutoff):
    said, listed = tables_of(spark, cutoff)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "id int, text string")
    keys = spark.createDataFrame([(p,) for p in listed], "phrase string")
    got = {(r.text, r.phrase): (r.score, r.end) for r in tables.keyword_matches(df, "text", keys, cutoff=cutoff).collect()}
    best, end = transcripts.partial_ratio_batch(said, listed)
    want = {(t, p): (best[w, i], end[w, i]) for i, t in enumerate(said) for w, p in enumerate(listed) if t and best[w, i] >= cutoff}
    assert got == want and want


def test_grams_leave_out_most_pairs(spark):
    said, listed = tables_of(spark, 5, 200, 300)
    texts = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(said)], "tid long, text string, n int")
    phrases = spark.createDataFrame([(i, p, len(p)) for i, p in enumerate(listed)], "kid long, phrase string, m int")
    assert tables.candidates(texts, phrases, 90).count() < 0.02 * len(said) * len(listed)
    assert tables.candidates(texts, phrases, 60) is None


def test_best_equals_the_list_form(spark):
    said, listed = tables_of(spark, 9)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "id int, text string")
    ranked = list(dict.fromkeys(listed))
    keys = spark.createDataFrame(list(enumerate(ranked)), "no int, words string")
    got = {tuple(r) for r in tables.best_of_table(df, "text", keys, "words", "no", 80).collect()}
    want = {tuple(r) for r in transcripts.best_keyword(df, "text", ranked, 80).collect()}
    assert got == want


def test_a_small_table_under_a_weak_bound_is_scored_without_grams(spark, monkeypatch):
    said, listed = tables_of(spark, 11, 40, 25)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "id int, text string")
    keys = spark.createDataFrame(list(enumerate(dict.fromkeys(listed))), "no int, words string")
    asked, plain = [], tables._by_grams
    monkeypatch.setattr(tables, "_by_grams", lambda *args: asked.append(1) or plain(*args))
    want = {tuple(r) for r in transcripts.best_keyword(df, "text", list(dict.fromkeys(listed)), 80).collect()}
    assert {tuple(r) for r in tables.best_of_table(df, "text", keys, "words", "no", 80).collect()} == want and not asked
    monkeypatch.setattr(tables, "BLOCK", 8)  # a table of several blocks
    assert {tuple(r) for r in tables.best_of_table(df, "text", keys, "words", "no", 80).collect()} == want and asked


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, "hello robot", 0.5), (1, "hello robot", 0.5), (2, None, 0.0), (3, "", 0.0), (4, "quite another thing", 1.0), (5, "Hello robot " * 4000, 0.0)],
        "id int, text string, score double",
    )
    keys = spark.createDataFrame([("Hello Robot", 2), ("hello robot", None), ("HELLO ROBOT", 1), (None, 0), ("", 0)], "phrase string, rank int")
    got = [tuple(r) for r in tables.best_of_table(df, "text", keys, rank="rank").orderBy("id").collect()]
    long = transcripts.partial_ratio_batch(["Hello robot " * 4000], ["hello robot"])
    assert [r[2:] for r in got] == [("HELLO ROBOT", 100.0, 11)] * 2 + [(None, None, None)] * 3 + [("HELLO ROBOT", long[0][0, 0], long[1][0, 0])]
    assert tables.best_of_table(df, "text", keys, rank="rank").columns == ["id", "text", "keyword", "score", "end"]
    none = tables.best_of_table(df, "text", keys.where("false"))
    assert none.count() == 6 and none.where(F.col("keyword").isNotNull()).count() == 0
    assert tables.best_of_table(df.where("false"), "text", keys).count() == 0
    with pytest.raises(ValueError):
        tables.best_of_table(df, "text", keys, cutoff=0)
