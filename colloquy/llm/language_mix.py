"""Languages of a document as a mixture: shares by expectation-maximisation, the set by penalised likelihood.

Letter trigrams within words, hashed into a fixed number of buckets, give each word a likelihood in every language.
A document's words are drawn from a mixture of languages; EM estimates the shares for all languages, then again
after the smallest share has been dropped, down to one language. The set with the best likelihood less a penalty for
each language wins. Trigram counts are summed over all labelled documents; the model's size is buckets x languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.token_ids import slices

BUCKET_BITS = 14
SMOOTHING = 0.5
STEPS = 6         # EM steps for each set of languages
PENALTY = 3.0     # times log(words) for each language beyond the first
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    log_likelihood: np.ndarray  # buckets x languages, float32


def letter_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each letter's trigram, first trigram of each word, first word of each text and the end)."""
    lowered = [(t or "").lower() + " " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    distinct, where = np.unique(points, return_inverse=True)
    letter = np.fromiter((chr(c).isalpha() for c in distinct.tolist()), bool, len(distinct))[where]
    values = np.where(letter, points, np.uint32(0))
    mixed = np.empty(len(values), np.uint32)
    left, right = np.concatenate([[0], values[:-1]]).astype(np.uint32), np.concatenate([values[1:], [0]]).astype(np.uint32)
    mixed = (left * np.uint32(0x9E3779B1)) ^ (values * np.uint32(0x85EBCA77)) ^ (right * np.uint32(0xC2B2AE3D))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    starts = letter & (left == 0)
    grams = (mixed >> np.uint32(32 - BUCKET_BITS))[letter]
    first = np.flatnonzero(starts[letter])
    ends = np.cumsum([len(t) for t in lowered])
    before = np.concatenate([[0], np.cumsum(starts)])
    return grams, first, np.concatenate([[0], before[ends]]).astype(np.int64)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Trigram counts of every labelled text, summed by Spark; null texts and labels take no part."""
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for at, texts in slices(batch.column("text"), 500_000):
                langs = np.array(batch.column("lang").slice(at, len(texts)).to_pylist(), object)
                values = texts.to_pylist()
                for name in set(langs.tolist()):
                    grams, _, _ = letter_words([v for v, k in zip(values, langs, strict=True) if k == name])
                    counts[name] = counts.get(name, 0) + np.bincount(grams, minlength=size)
        for name, row in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([row.tolist()], pa.list_(pa.int64()))], ["lang", "counts"])

    source = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    parts = source.mapInArrow(count, "lang string, counts array<long>")
    total = parts.select("lang", F.posexplode("counts").alias("bucket", "n")).where("n > 0").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(total["lang"].unique().tolist())
    table = np.zeros((size, len(names)))
    table[total["bucket"], [names.index(x) for x in total["lang"]]] = total["n"]
    table += SMOOTHING
    return LanguageModel(names, np.log(table / table.sum(axis=0)).astype(np.float32))


def mixtures(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """Shares of the languages (texts x languages); all zero for a text without a letter."""
    k = len(model.languages)
    shares = np.zeros((len(texts), k))
    grams, first, cuts = letter_words(texts)
    has = np.flatnonzero(np.diff(cuts))
    if not len(has) or not k:
        return shares
    words = np.add.reduceat(model.log_likelihood[grams], first, axis=0)
    sizes = np.diff(cuts)[has]
    doc = np.repeat(np.arange(len(has)), sizes)
    at = cuts[:-1][has]
    alone = np.add.reduceat(words.astype(np.float64), at, axis=0)
    top = words.max(axis=1, keepdims=True)
    likelihood = np.exp(words - top)
    base = np.add.reduceat(top[:, 0].astype(np.float64), at)
    best = alone.max(axis=1)
    chosen = np.eye(k)[alone.argmax(axis=1)]
    active = np.ones((len(has), k), np.float32)
    pi = np.full((len(has), k), 1 / k, np.float32)
    for left in range(k, 1, -1):
        for _ in range(STEPS):
            joint = likelihood * pi[doc]
            joint /= joint.sum(axis=1, keepdims=True) + 1e-30
            pi = np.add.reduceat(joint, at, axis=0) / sizes[:, None].astype(np.float32)
            pi = (pi + np.float32(1e-6)) * active
            pi /= pi.sum(axis=1, keepdims=True)
        value = base + np.add.reduceat(np.log((likelihood * pi[doc]).sum(axis=1) + 1e-30).astype(np.float64), at)
        value -= PENALTY * (left - 1) * np.log(sizes + 1)
        better = value > best
        best[better], chosen[better] = value[better], pi[better]
        smallest = np.where(active > 0, pi, np.inf).argmin(axis=1)
        active[np.arange(len(has)), smallest] = 0
        pi = pi * active + np.float32(1e-6) * active
        pi /= pi.sum(axis=1, keepdims=True)
    shares[has] = chosen
    return shares


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Columns of ``docs`` with lang_pred, score and languages; columns of those names are replaced.

    ``languages`` are the chosen ones with their shares, largest first; lang_pred is the first, score its share. A
    text that is null or has no letter, or a model without a language, gives ``und``, 0 and no languages. Ties go
    to the language that is first by name. Repeated rows give equal results; an empty table gives none.
    """
    source = docs.drop("lang_pred", "score", "languages")
    schema = f"{source._jdf.schema().toDDL()}, lang_pred string, score double, languages array<struct<lang: string, share: double>>"
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(text), 500_000):
                shares = mixtures(model, texts.to_pylist())
                found = []
                for row in shares:
                    order = [i for i in np.argsort(-row, kind="stable").tolist() if row[i] > 0]
                    found.append([{"lang": model.languages[i], "share": float(min(1.0, row[i]))} for i in order])
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([
                    *part.columns, pa.array([f[0]["lang"] if f else UNKNOWN for f in found]), pa.array([f[0]["share"] if f else 0.0 for f in found], pa.float64()), pa.array(found, kind),
                ], [*part.schema.names, "lang_pred", "score", "languages"])

    return source.mapInArrow(run, schema)
