"""The partitioned Jaccard join against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import jaccard_join, near_dups
from colloquy.llm.jaccard_join import Bands, join_links
from test_llm_queries import groups


def expected(texts):
    return groups(texts, words=3, percent=90)


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def varied(seed, families, members, sizes, vocabulary):
    """Texts in families: a random text and edited copies of it, among others that share words."""
    draw, texts, n = random.Random(seed), {}, 0
    for _ in range(families):
        base = [f"w{draw.randrange(vocabulary)}" for _ in range(draw.randrange(*sizes))]
        for _ in range(members):
            copy = list(base)
            for _ in range(draw.randrange(3)):
                at = draw.randrange(len(copy))
                copy[at:at + draw.randrange(2)] = [f"x{draw.randrange(50)}"] * draw.randrange(2)
            texts[n], n = " ".join(copy), n + 1
    return texts


def test_shingles_are_those_of_the_plain_form():
    texts = ["", None, "a", "A b", " x\x0by \x0c z\tq\n", "É a b É a b É", "a b a b a b a b"]
    tokens, offsets = jaccard_join.shingles(pa.array(texts), 3)
    for i, t in enumerate(texts):
        assert (tokens[offsets[i]:offsets[i + 1]] == near_dups.shingle_set(t, 3)).all()


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_bands_leave_no_link_out(percent):
    """Linked sizes lie in one band or two neighbouring ones, and differ by less than the band has segments."""
    bands = Bands(percent)
    for a in range(1, 400):
        for b in range(a, 100 * a // percent + 1):
            low, high = bands.of(np.array([a, b]))
            assert high - low <= 1 and (high == low or bands.below(np.array([b]))[0] == low)
            most = (100 - percent) * (a + b) // (100 + percent)
            assert most < max(1, bands.segments[low])


@pytest.mark.parametrize("sizes, vocabulary", [((9, 30), 4000), ((40, 300), 100_000)])
def test_equals_all_pairs(spark, sizes, vocabulary):
    texts = varied(1, 60, 6, sizes, vocabulary)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    found = got(join_links(docs, block=16))
    assert found == expected(texts) and any(k != c for k, (_, c) in found.items())


def test_popular_segments_are_given_up(spark, monkeypatch):
    """Many small sets without a shingle in one of their segments: allocation takes place and loses nothing."""
    draw, bands = random.Random(2), Bands(90)
    pool = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(11)) for _ in range(60_000)]
    tokens, offsets = jaccard_join.shingles(pa.array(pool), 3)
    first, _, _, _, _, sizes = jaccard_join.partitioned(tokens, offsets, bands.of(np.diff(offsets)), bands)
    bare = [t for t, a, b in zip(pool, first[:-1], first[1:], strict=True) if (sizes[a:b] == 0).any()]
    assert len(bare) > 150
    texts = dict(enumerate(x for t in bare for x in (t, t + " end")))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    seen, plain = [], jaccard_join.allocate

    def watched(*args):
        out = plain(*args)
        seen.append(out[1])
        return out

    monkeypatch.setattr(jaccard_join, "allocate", watched)
    assert got(join_links(docs)) == expected(texts)
    assert seen[0], "no band raised a segment"


def test_one_large_family(spark):
    """Neighbours are linked, ends are not: a chain through components, in small blocks."""
    draw = random.Random(3)
    words = [f"w{draw.randrange(10**6)}" for _ in range(200)]
    texts = {i: " ".join(words[:i * 2] + [f"n{k}" for k in range(i * 2, 60)] + words[60:]) for i in range(31)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert got(join_links(docs, block=4)) == expected(texts)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a B"), (None, "a b"), (6, long), (7, long + " end"), (8, "c d e"), (8, long), (8, "c d e")]
    docs = spark.createDataFrame([(a, b, 0, 0) for a, b in rows], "doc_id long, text string, node int, key int")
    out = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in join_links(docs).collect())
    assert out == [(-1, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 29998, 6), (7, 29999, 6), (8, 1, 6), (8, 1, 6), (8, 29998, 6)]
    assert join_links(docs.where("false")).collect() == []


def test_members_of_a_large_family_stay_in_few_lists(spark, monkeypatch):
    """Copies with many edits: a member stands in its segments' lists, not under each deletion of what all share."""
    draw = random.Random(4)
    base, texts = [f"w{k}" for k in range(150)], {}
    for i in range(400):
        copy = list(base)
        for _ in range(draw.randrange(12)):
            copy[draw.randrange(len(copy))] = f"n{draw.randrange(10**6)}"
        texts[i] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    rows, plain = [], jaccard_join.linked

    def watched(lists, *args):
        rows.append(lists.count())
        return plain(lists, *args)

    monkeypatch.setattr(jaccard_join, "linked", watched)
    assert got(join_links(docs)) == expected(texts)
    bands = Bands(90)
    assert rows[0] <= len(texts) * (bands.segments[bands.of(np.array([148]))[0]] + bands.segments[bands.of(np.array([148]))[0] - 1])
