"""Fuzzy matching against a whole table of phrases.

A phrase and a window of a text whose ratio reaches the cutoff share a least number of their q-grams. Pairs that
share fewer are left out by an equi-join on grams and a count; every other pair is scored in full, so no match is
lost. Strings too short for the count to say anything meet in blocks. So do the phrases of a table that is one block
where the bound is weak: most texts share the one or two grams it asks for, and the grams of a text cost more than the
block.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.operators.transcripts import SCORE_CUTOFF, partial_ratio_batch
from colloquy.runtime import BROADCAST_ROWS, materialize, small_side, within

GRAMS = (4, 3, 2)    # lengths of grams, the most selective first
POWER = 0.4          # shared grams per character from which a longer gram is worth its weaker bound
BLOCK = 256          # phrases that meet a text at once where grams say nothing
SHORTEST = 8         # pieces of a text are at least this long

_PAIR = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("end", T.IntegerType())])


def shared_share(q: int, cutoff: float) -> float:
    """The slope ``a`` of the bound: strings of which the shorter has ``m`` characters and whose ratio reaches the
    cutoff share at least ``a * m - (q - 1)`` of the shorter one's q-grams, counted by position.

    With ``t`` as the cutoff's share, a window of ``w <= m`` characters keeps ``l >= t * (m + w) / 2`` of them in order.
    Each of the ``m - l`` lost characters breaks at most ``q`` grams and each of the ``w - l`` inserted ones ``q - 1``.
    That is linear in ``w``, so its least value stands at ``w = m`` or at the shortest window, where ``w = l``.
    """
    t = cutoff / 100.0
    return min(1 - (2 * q - 1) * (1 - t), 1 - q * (1 - t / (2 - t)))


def gram_length(cutoff: float) -> int | None:
    """The longest gram with a strong bound, else 2 if it says anything, else none."""
    strong = [q for q in GRAMS if shared_share(q, cutoff) >= POWER]
    if strong:
        return strong[0]
    return 2 if shared_share(2, cutoff) > 1e-9 else None


def least_shared(m: int, q: int, cutoff: float) -> int:
    """Grams that a pair must share if the shorter string has ``m`` characters; below 1 the bound says nothing."""
    return math.ceil(shared_share(q, cutoff) * m - (q - 1) - 1e-9)


def shortest_filtered(q: int, cutoff: float) -> int:
    """The least length from which ``least_shared`` is at least 1."""
    m = max(1, math.floor((q - 1) / shared_share(q, cutoff)))
    while least_shared(m, q, cutoff) < 1:
        m += 1
    return m


def _counted(source: DataFrame, keys: list, piece: str, q: int, counted: Column, weight: str) -> DataFrame:
    """Distinct grams of a piece; ``weight`` is how often a gram stands there, or 1 where ``counted`` is false."""
    grams = source.select(*keys, counted.alias("_counted"), F.expr(
        f"transform(sequence(1, length({piece}) - {q - 1}), i -> substring({piece}, i, {q}))").alias("_all"))
    times = F.transform(F.array_distinct("_all"), lambda g: F.struct(
        g.alias("gram"),
        F.when(F.col("_counted"), F.size(F.filter("_all", lambda x: x == g))).otherwise(1).alias(weight)))
    return grams.select(*keys, F.inline(times))


def _wide(length: Column) -> Column:
    """The power of two that holds a phrase: its class. Pieces of a text overlap by as much."""
    return F.greatest(F.lit(SHORTEST), F.pow(F.lit(2), F.ceil(F.log2(length))).cast("int"))


def _pieces(texts: DataFrame, wide: int, q: int) -> DataFrame:
    """Pieces of two widths that start one width apart, so that each window of a width lies whole in one of them."""
    cut = texts.select("tid", "n", F.expr(f"regexp_extract_all(text, '(?s).{{1,{wide}}}', 0)").alias("_cut"))
    paired = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("_cut") - 1, F.lit(1))),
        lambda i: F.struct(i.alias("piece"), F.concat(F.element_at("_cut", i), F.coalesce(F.get("_cut", i), F.lit(""))).alias("part")),
    )
    return cut.select("tid", "n", F.lit(wide).alias("wide"), F.inline(paired)).where(F.length("part") >= q)


def _by_grams(texts: DataFrame, phrases: DataFrame, widths: list, q: int, cutoff: float) -> DataFrame:
    """(tid, kid) of pairs that share enough grams within one piece."""
    least = shortest_filtered(q, cutoff)
    texts, phrases = texts.where(F.col("n") >= least), phrases.where(F.col("m") >= least)
    # a piece's own counts matter only for a text shorter than the phrase, which is a single piece
    sides = [
        _counted(_pieces(texts, w, q), ["tid", "n", "wide", "piece"], "part", q, F.col("n") < w, "text_times") for w in widths
    ]
    left = sides[0]
    for side in sides[1:]:
        left = left.union(side)
    right = _counted(phrases.withColumn("wide", _wide(F.col("m"))), ["kid", "m", "wide"], "phrase", q, F.lit(True), "phrase_times")
    met = left.join(small_side(right), ["wide", "gram"])
    shorter = F.least("n", "m")
    need = F.ceil(shorter * F.lit(shared_share(q, cutoff)) - (q - 1) - F.lit(1e-9))
    shared = met.groupBy("tid", "kid", "wide", "piece", "n", "m").agg(
        F.sum(F.when(F.col("n") < F.col("m"), F.col("text_times")).otherwise(F.col("phrase_times"))).alias("shared"))
    return shared.where(F.col("shared") >= need).select("tid", "kid").distinct()


def _scored(pairs: DataFrame, texts: DataFrame, phrases: DataFrame, cutoff: float) -> DataFrame:
    """(tid, kid, score, end) of candidate pairs at the cutoff; pairs of one phrase are scored together."""

    @F.pandas_udf(_PAIR)
    def score(text: pd.Series, phrase: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"score": 0.0, "end": 0}, index=range(len(text)))
        for key, at in phrase.reset_index(drop=True).groupby(phrase.to_numpy()).indices.items():
            best, end = partial_ratio_batch([text.iloc[i] for i in at], [key])
            out.loc[at, "score"], out.loc[at, "end"] = best[0], end[0]
        return out.astype({"end": "int32"})

    met = pairs.join(texts.select("tid", "text"), "tid").join(small_side(phrases.select("kid", "phrase")), "kid")
    return met.select("tid", "kid", score("text", "phrase").alias("_s")).select("tid", "kid", "_s.*").where(F.col("score") >= cutoff)


def _by_blocks(texts: DataFrame, phrases: DataFrame, cutoff: float) -> DataFrame:
    """(tid, kid, score, end) of pairs at the cutoff: the phrases as a query set, a block at a time against each text.

    Blocks are dealt by hash and hold some ``BLOCK`` phrases. A text goes out once for each block.
    """
    held = phrases.count()
    if not held:
        return texts.sparkSession.createDataFrame([], "tid long, kid long, score double, end int")
    many = -(-held // BLOCK)
    dealt = phrases.withColumn("block", F.pmod(F.xxhash64("phrase"), F.lit(many)).cast("int"))
    blocks = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("kid", "phrase"))).alias("held"))
    met = texts.select("tid", "text", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("block"))
    met = met.join(small_side(blocks, BROADCAST_ROWS // BLOCK), "block")
    found = T.ArrayType(T.StructType([T.StructField("no", T.IntegerType()), *_PAIR.fields]))

    @F.pandas_udf(found)
    def score(text: pd.Series, block: pd.Series, listed: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(text))]
        for at in block.reset_index(drop=True).groupby(block.to_numpy()).indices.values():
            best, end = partial_ratio_batch([text.iloc[i] for i in at], list(listed.iloc[at[0]]))
            for no, col in zip(*(best >= cutoff).nonzero()):
                out[at[col]].append({"no": int(no), "score": float(best[no, col]), "end": int(end[no, col])})
        return pd.Series(out)

    scored = met.select("tid", "held", F.inline(score("text", "block", F.col("held.phrase"))))
    return scored.select("tid", F.col("held")[F.col("no")]["kid"].alias("kid"), "score", "end")


def candidates(texts: DataFrame, phrases: DataFrame, cutoff: float) -> DataFrame | None:
    """(tid, kid) of the pairs left by the count of shared grams, for texts(tid, text, n) and phrases(kid, phrase, m).

    Only strings from ``shortest_filtered`` characters on take part. None if the cutoff is too low for a bound.
    """
    q = gram_length(cutoff)
    if q is None:
        return None
    least = shortest_filtered(q, cutoff)
    widths = [r[0] for r in phrases.where(F.col("m") >= least).select(_wide(F.col("m"))).distinct().collect()]  # powers of two: a few
    return _by_grams(texts, phrases, sorted(widths), q, cutoff) if widths else None


def keyword_matches(df: DataFrame, text: str, keywords: DataFrame, phrase: str = "phrase", cutoff: float = SCORE_CUTOFF, fold_keywords: bool = True) -> DataFrame:
    """(tid, text, kid, phrase, score, end) of every distinct text and phrase whose ratio reaches the cutoff.

    ``phrase`` is as matched. Null and empty texts and phrases match nothing; equal ones are compared once.
    """
    texts, phrases = _sides(df, text, keywords, phrase, None, fold_keywords)
    found = _found(texts, phrases, cutoff)
    return found.join(texts.select("tid", "text"), "tid").join(small_side(phrases.select("kid", "phrase")), "kid").select("tid", "text", "kid", "phrase", "score", "end")


def _sides(df: DataFrame, text: str, keywords: DataFrame, phrase: str, rank: str | None, fold: bool) -> tuple[DataFrame, DataFrame]:
    """Distinct texts(tid, text, n) and phrases(kid, phrase, m, place), written once so that their numbers stay.

    ``place`` orders equal scores: rank, without one last, then the phrase as given, which it also holds.
    """
    texts = df.select(F.col(text).alias("text")).where(F.length("text") > 0).distinct()
    ranked = F.lit(None).cast("long") if rank is None else F.col(rank)
    matched = F.lower(phrase) if fold else F.col(phrase)
    listed = keywords.select(matched.alias("phrase"), F.struct(ranked.isNull().alias("unranked"), ranked.alias("rank"), F.col(phrase).alias("given")).alias("place"))
    phrases = listed.where(F.length("phrase") > 0).groupBy("phrase").agg(F.min("place").alias("place"))
    return (
        materialize(texts.select(F.monotonically_increasing_id().alias("tid"), "text", F.length("text").alias("n"))),
        materialize(phrases.select(F.monotonically_increasing_id().alias("kid"), "phrase", F.length("phrase").alias("m"), "place")),
    )


def _found(texts: DataFrame, phrases: DataFrame, cutoff: float) -> DataFrame:
    """(tid, kid, score, end) of all pairs at the cutoff."""
    if not 0 < cutoff <= 100:
        raise ValueError("the cutoff lies above 0 and up to 100")
    q = gram_length(cutoff)
    if q is None or shared_share(q, cutoff) < POWER and within(phrases, BLOCK):
        return _by_blocks(texts, phrases, cutoff)
    least = shortest_filtered(q, cutoff)
    short = _by_blocks(texts, phrases.where(F.col("m") < least), cutoff)
    short = short.union(_by_blocks(texts.where(F.col("n") < least), phrases.where(F.col("m") >= least), cutoff))
    pairs = candidates(texts, phrases, cutoff)
    return short if pairs is None else short.union(_scored(pairs, texts, phrases, cutoff))


def best_of_table(
    df: DataFrame, text: str, keywords: DataFrame, phrase: str = "phrase", rank: str | None = None, cutoff: float = SCORE_CUTOFF,
    fold_keywords: bool = True,
) -> DataFrame:
    """As ``transcripts.best_keyword`` with the phrases as a table of any size: ``keyword``, ``score`` and ``end``.

    Equal scores go to the smaller ``rank`` (null last), then to the smaller phrase; phrases equal after folding are one. Columns
    of the three names are replaced. Null and empty texts, and texts without a match, have nulls; null and empty phrases
    are left out; without phrases every row has nulls. Repeated rows stay.
    """
    texts, phrases = _sides(df, text, keywords, phrase, rank, fold_keywords)
    ranked = _found(texts, phrases, cutoff).join(small_side(phrases.select("kid", "place")), "kid")
    best = ranked.groupBy("tid").agg(F.min(F.struct((-F.col("score")).alias("less"), "place", "end")).alias("_b"))
    hits = materialize(best.join(texts, "tid").select(
        F.col("text").alias("_text"), F.col("_b.place.given").alias("keyword"), (-F.col("_b.less")).alias("score"), F.col("_b.end").alias("end")))
    kept = [c for c in df.columns if c not in ("keyword", "score", "end")]
    rows = df.select(F.struct(*kept).alias("_row"), F.col(text).alias("_text"))
    return rows.join(small_side(hits), "_text", "left").select("_row.*", "keyword", "score", "end")
