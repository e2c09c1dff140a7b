import random

from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.operators import transcripts


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def plain_ratio(text, word):
    """Every window by the definition."""
    if not text:
        return 0.0, 0
    short, long = (text, word) if len(text) < len(word) else (word, text)
    n, found = len(short), []
    for start in range(1 - n, len(long)):
        lo, hi = max(start, 0), min(start + n, len(long))
        end = len(text) if len(text) < len(word) else hi
        found.append((-200.0 * lcs(short, long[lo:hi]) / (n + hi - lo), end))
    score, end = min(found)
    return -score, end


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc é", max_size=40), min_size=1, max_size=6), st.text("abcdé ", min_size=1, max_size=9))
def test_ratio_equals_the_definition(texts, word):
    best, end = transcripts.partial_ratio_batch(texts, [word])
    assert [(best[0, i], end[0, i]) for i in range(len(texts))] == [plain_ratio(t, word) for t in texts]


def test_long_keyword_and_blocks():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcdef ") for _ in range(rnd.randrange(0, 300))) for _ in range(400)]
    word = "abcdef abcdef abcdef abcdef abcdef abc"
    best, end = transcripts.partial_ratio_batch(texts, [word, "fade"])
    for i in rnd.sample(range(400), 40):
        assert (best[0, i], end[0, i]) == plain_ratio(texts[i], word)
        assert (best[1, i], end[1, i]) == plain_ratio(texts[i], "fade")


def test_strip(spark):
    df = spark.createDataFrame(
        [(1, "  Hello Robot, what time is it? "), (2, "Nothing to see HERE"), (3, "helo robot! yes"), (4, ""), (5, None)],
        "id int, text string",
    )
    got = {r.id: (r.matched, r.rest) for r in transcripts.strip_wakeword(df, "text", ["Hello Robot", "Good morning Computer"]).collect()}
    assert got[1] == (True, "what time is it?")
    assert got[2] == (False, "nothing to see here")
    assert got[3] == (True, "yes")
    assert got[4] == (False, "") and got[5][0] is False


def test_first_keyword_wins_and_cutoff(spark):
    df = spark.createDataFrame([(1, "abcabc"), (2, "zzz")], "id int, text string")
    got = {r.id: (r.keyword, r.score, r.end) for r in transcripts.best_keyword(df, "text", ["cab", "abc", "bca"]).collect()}
    assert got == {1: ("cab", 100.0, 5), 2: (None, None, None)}


def test_capitals_cost_score_if_not_folded(spark):
    df = spark.createDataFrame([(1, "hello robot")], "id int, text string")
    folded = transcripts.best_keyword(df, "text", ["Hello Robot"], 0).first().score
    kept = transcripts.best_keyword(df, "text", ["Hello Robot"], 0, fold_keywords=False).first().score
    assert folded == 100.0 and kept < 100.0


def test_transcript_without_tokens(spark):
    segments = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "id int, no int, text string")
    tokens = spark.createDataFrame([(1, 0.5), (1, 1.0), (1, 0.0)], "id int, prob double")
    got = {r.id: (r.text, r.prob) for r in transcripts.assemble_transcript(segments, tokens, "id", "no").collect()}
    assert got == {1: ("ab", 0.5), 2: ("c", 0.0)}


def test_query_looks_for_every_greeting_with_every_name():
    from colloquy.plans import catalog

    names = {f"{g} {n}" for g in ("Hello", "Hey", "Good morning", "Good afternoon", "Good evening") for n in ("Robot", "Computer")}
    assert names | set(catalog.WAKE_PHRASES) == set(catalog.KEYWORDS) and len(catalog.KEYWORDS) == 11
