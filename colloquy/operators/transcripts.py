"""Fuzzy keyword matching and transcript assembly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import clean_text, lstrip_set

# Fixed value: the score from which a phrase counts as found.
SCORE_CUTOFF = 75


WORD_BITS = 62    # longest keyword whose bits fit one machine word; longer ones take several
_BLOCK = 1 << 15  # characters whose windows advance together; stays in cache


def _lcs_step(v, hit, full, u, t):
    """One character of the bit-parallel common-subsequence length (Hyyrö 2004)."""
    np.bitwise_and(v, hit, out=u)
    np.add(v, u, out=t)
    np.subtract(v, u, out=v)
    np.bitwise_or(v, t, out=v)
    np.bitwise_and(v, full, out=v)


class _Keyword:
    def __init__(self, word: str):
        self.m = len(word)
        if not self.m:
            raise ValueError("a keyword is empty")
        self.kind = np.uint32 if self.m <= 31 else np.uint64
        letters = sorted(set(word))
        self.codes = np.array([ord(c) for c in letters], dtype=np.uint32)
        bits = [sum(1 << i for i, c in enumerate(word) if c == k) for k in letters]
        self.bits = np.array(bits, dtype=self.kind)
        self.full = self.kind((1 << self.m) - 1)

    def masks(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, points), len(self.codes) - 1)
        return np.where(self.codes[at] == points, self.bits[at], self.kind(0))

    def common(self, v: np.ndarray, width=None):
        return (self.m if width is None else width) - np.bitwise_count(v).astype(np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _in_long_texts(word: _Keyword, points: list):
    """Texts at least as long as the keyword: every window of every text at once."""
    m = word.m
    size = np.array([len(p) for p in points])
    room = size + m  # a text is followed by ``m`` places that match nothing
    begin = np.concatenate([[0], np.cumsum(room)[:-1]])
    masks = np.zeros(int(room.sum()) + m, dtype=word.kind)
    for p, b in zip(points, begin):
        masks[b: b + len(p)] = word.masks(p)
    total = len(masks) - m
    v = np.full(total, word.full)
    u, t = np.empty_like(v), np.empty_like(v)
    fronts = []
    for j in range(m):
        _lcs_step(v, masks[j: j + total], word.full, u, t)
        if j + 1 < m:  # windows cut off at the front of the text
            fronts.append(200.0 * word.common(v[begin]) / (m + j + 1))
    start = np.arange(total) - np.repeat(begin, room)
    limit = np.repeat(size, room)
    width = np.clip(limit - start, 0, m)
    score = np.where(width > 0, 200.0 * word.common(v) / (m + width), -1.0)
    best = np.maximum(np.maximum.reduceat(score, begin), np.max(fronts, axis=0) if fronts else -1.0)
    stop = np.where(score == np.repeat(best, room), start + width, np.iinfo(np.int64).max)
    end = np.minimum.reduceat(stop, begin)
    for j, front in enumerate(fronts):
        end = np.where(front == best, np.minimum(end, j + 1), end)
    return best, end


def _in_short_text(word: _Keyword, points: np.ndarray) -> float:
    """A text shorter than the keyword slides over it."""
    n, m = len(points), word.m
    low, high = np.maximum(np.arange(-n + 1, m), 0), np.minimum(np.arange(1, m + n), m)
    inside = np.array([(1 << int(b)) - (1 << int(a)) for a, b in zip(low, high)], dtype=word.kind)
    v, u, t = inside.copy(), np.empty_like(inside), np.empty_like(inside)
    for hit in word.masks(points):
        _lcs_step(v, hit & inside, inside, u, t)
    return float((200.0 * word.common(v, high - low) / (n + high - low)).max())


LIMB = 32  # bits of a long keyword that one array element holds, so that sums keep their carry


def _by_limbs(word: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """Best window of a text for a word of any length, and its end; the word's bits are spread over limbs.

    Windows are those of at most the word's length that the text's borders or the length cut off.
    """
    m, n = len(word), len(text)
    limbs = -(-m // LIMB)
    wide = min(m, n)
    start = np.concatenate([np.zeros(wide - 1, np.int64), np.arange(n)])
    width = np.concatenate([np.arange(1, wide), np.minimum(m, n - np.arange(n))])
    letters = np.unique(word)
    bits = np.zeros((len(letters) + 1, limbs), np.uint64)  # the last row is for other characters
    np.bitwise_or.at(bits, (np.searchsorted(letters, word), np.arange(m) // LIMB), np.uint64(1) << (np.arange(m) % LIMB).astype(np.uint64))
    at = np.minimum(np.searchsorted(letters, text), len(letters) - 1)
    code = np.where(letters[at] == text, at, len(letters))
    full = np.array([(1 << min(LIMB, m - LIMB * i)) - 1 for i in range(limbs)], np.uint64)
    v = np.tile(full, (len(start), 1))
    for j in range(int(width.max())):
        live = width > j
        hit = v[live] & bits[code[start[live] + j]]
        total, carry = np.empty_like(hit), np.zeros(len(hit), np.uint64)
        for i in range(limbs):
            s = v[live, i] + hit[:, i] + carry
            total[:, i], carry = s & np.uint64(2**LIMB - 1), s >> np.uint64(LIMB)
        v[live] = ((v[live] - hit) | total) & full
    score = 200.0 * (m - np.bitwise_count(v).sum(axis=1).astype(np.int64)) / (m + width)
    best = score.max()
    return float(best), int((start + width)[score == best].min())


def _in_any_text(word: str, points: np.ndarray) -> tuple[float, int]:
    """As ``_by_limbs``; a text shorter than the keyword slides over it and ends where it ends."""
    if len(points) < len(word):
        return _by_limbs(points, _points(word))[0], len(points)
    return _by_limbs(_points(word), points)


def partial_ratio_batch(texts: list, keywords: list):
    """Best partial ratio of each keyword in each text and where its window ends.

    Gives two arrays of shape (keywords, texts). Windows advance one keyword
    character per vector step. Of equal windows the one that ends, then starts,
    first wins. An empty text scores 0.
    """
    words = [_Keyword(k) if len(k) <= WORD_BITS else None for k in keywords]
    points = [_points(t) for t in texts]
    lengths = np.array([len(p) for p in points], dtype=np.int64)
    best = np.zeros((len(words), len(texts)))
    end = np.tile(lengths, (len(words), 1))
    for w, keyword in enumerate(keywords):
        if words[w] is None:
            for i in np.flatnonzero(lengths):
                best[w, i], end[w, i] = _in_any_text(keyword, points[i])
    block = np.cumsum(lengths) // _BLOCK
    for _, chosen in pd.Series(np.arange(len(texts))).groupby(block):
        rows = chosen.to_numpy()
        for w, word in enumerate(words):
            if word is None:
                continue
            long = rows[lengths[rows] >= word.m]
            if len(long):
                best[w, long], end[w, long] = _in_long_texts(word, [points[i] for i in long])
            for i in rows[(lengths[rows] < word.m) & (lengths[rows] > 0)]:
                best[w, i] = _in_short_text(word, points[i])
    return best, end


_MATCH = T.StructType([
    T.StructField("score", T.DoubleType()), T.StructField("end", T.IntegerType()), T.StructField("no", T.IntegerType()),
])


def _matcher(keywords: list, cutoff: float):
    """Arrow function: best keyword of each text, first of equals; null below the cutoff."""
    @F.pandas_udf(_MATCH)
    def match(texts: pd.Series) -> pd.DataFrame:
        known = texts.fillna("").tolist()
        scores, ends = partial_ratio_batch(known, keywords)
        no = scores.argmax(axis=0)  # the first of equal keywords
        score, end = scores[no, np.arange(len(known))], ends[no, np.arange(len(known))]
        out = pd.DataFrame({"score": score, "end": end, "no": no}).astype({"end": "Int32", "no": "Int32"})
        out.loc[(score < cutoff) | texts.isna().to_numpy()] = None
        return out

    return match


def partial_ratio(df: DataFrame, text: str, keyword: str) -> DataFrame:
    """Add ``score`` (0 to 100) and ``end`` of the best window of ``keyword``."""
    found = df.withColumn("_m", _matcher([keyword], -1.0)(F.col(text)))
    return found.withColumn("score", F.col("_m.score")).withColumn("end", F.col("_m.end")).drop("_m")


def best_keyword(
    df: DataFrame, text: str, keywords, cutoff: float = SCORE_CUTOFF, fold_keywords: bool = True
) -> DataFrame:
    """Add ``keyword``, ``score`` and ``end`` of the best phrase; null if none
    reaches the cutoff. ``fold_keywords=False`` leaves the phrases' capitals, which
    then cost score against a lower-cased text."""
    keywords = list(keywords)
    folded = [k.lower() for k in keywords] if fold_keywords else keywords
    found = df.withColumn("_m", _matcher(folded, cutoff)(F.col(text)))
    names = F.array(*[F.lit(k) for k in keywords])
    return found.select(
        *df.columns,
        F.get(names, F.col("_m.no")).alias("keyword"),
        F.col("_m.score").alias("score"),
        F.col("_m.end").alias("end"),
    )


def strip_wakeword(
    df: DataFrame, text: str, keywords, cutoff: float = SCORE_CUTOFF, fold_keywords: bool = True
) -> DataFrame:
    """Add ``matched`` and ``rest``: what follows the phrase, or the whole cleaned text."""
    cleaned = df.withColumn("_clean", clean_text(text))
    found = best_keyword(cleaned, "_clean", keywords, cutoff, fold_keywords)
    after = lstrip_set(F.substring(F.col("_clean"), F.col("end") + 1, F.length("_clean")))
    return found.select(
        *df.columns,
        F.col("score").isNotNull().alias("matched"),
        F.when(F.col("score").isNotNull(), after).otherwise(F.col("_clean")).alias("rest"),
    )


def assemble_transcript(segments: DataFrame, tokens: DataFrame, key: str, order: str, text: str = "text", prob: str = "prob") -> DataFrame:
    """Segment texts joined in order and the mean probability over all tokens.

    The mean is a plain partial aggregate over tokens, not a mean of segment
    means; without tokens it is 0.
    """
    joined = segments.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct(order, text)))[text], "").alias("text")
    )
    means = tokens.groupBy(key).agg(F.avg(prob).alias("prob"))
    return joined.join(means, key, "left").withColumn("prob", F.coalesce("prob", F.lit(0.0)))
