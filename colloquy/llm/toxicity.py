"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon transducer turns words into classes with weights: insult, threat, target, negation, reported speech.
A clause transducer reads the classes and keeps what it has seen (a target, an open negation, reported speech); an
insult or a threat that it passes gives a match, weighted by that state. The two are composed: each word moves the
clause state. Matched clauses, not words, are what a document is scored by. Insult patterns (words, and stems with
any ending) are learned from labelled rows; the other classes are word lists.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 6000    # labelled rows that patterns and weights are fitted on: those of the smallest hashes of their ids
STEM = 3           # letters of the shortest stem
LONGEST_STEM = 9
PATTERNS = 500     # insult patterns that are kept, best first
NEGATION_SPAN = 3  # words that a negation reaches

# the word classes
THREAT = "kill killing murder hurt beat destroy burn stab shoot töte töten umbringen schlagen tuer frapper brûler matar golpear quemar".split()
TARGET = "you your yours he she they them his her their du dich dir ihr euch tu toi vous ton votre usted ustedes te tú".split()
NEGATION = "not never don't isn't aren't wasn't nicht niemals kein keine jamais nunca jamás".split()
REPORTED = "said says wrote claimed quoted reported according sagte schrieb behauptete laut dit écrit selon dijo escribió según".split()

CLAUSE = re.compile(r"[^.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
# weight of a match by what the clause has shown so far
TARGETED, NEGATED, QUOTED = 1.25, 0.4, 0.7


@dataclass
class Grammar:
    """Lexicon and the weights of a document's features."""

    insults: dict[str, float]  # a stem ends with *
    threats: float = 2.0
    coefficients: list[float] = field(default_factory=lambda: [-3.0, 1.5, 0.5, 1.0])

    def finder(self) -> str | None:
        """Expression for a word that may begin a match, to pass over texts without one; it reads ``lowered`` texts.

        It may find too much, never too little: what bounds a word in WORD is no letter to RE2, whose \\b knows ASCII only.
        """
        stems, words = [], []
        for w in [*self.insults, *THREAT]:
            (stems if w.endswith("*") else words).append(re.escape(lowered(w.removesuffix("*"))))
        # the class stands once behind all words, since RE2 takes no expression with hundreds of it
        either = [*stems, *([rf"(?:{'|'.join(words)})(?:$|[^\pL])"] if words else [])]
        return rf"(?:^|[^\pL])(?:{'|'.join(either)})" if either else None

    def classes(self, word: str) -> tuple[str, float]:
        """The lexicon transducer."""
        weight = self.insults.get(word)
        if weight is None:
            weight = max((self.insults[s] for n in range(STEM, min(len(word), LONGEST_STEM + 1)) if (s := word[:n] + "*") in self.insults), default=None)
        if weight is not None:
            return "insult", weight
        for name, words in (("threat", THREAT), ("target", TARGET), ("negation", NEGATION), ("reported", REPORTED)):
            if word in words:
                return name, self.threats if name == "threat" else 0.0
        return "other", 0.0

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of every matched clause, in code points of ``text``."""
        found = []
        for clause in CLAUSE.finditer(text):
            weight, pending, target, quoted, reach = 0.0, 0.0, False, False, 0
            for word in WORD.finditer(clause.group().lower()):
                kind, value = self.classes(word.group())
                reach = max(0, reach - 1)
                if kind == "negation":
                    reach = NEGATION_SPAN
                elif kind == "reported":
                    quoted = True
                elif kind == "target":
                    target = True
                    weight, pending = weight + pending * (TARGETED - 1), 0.0
                elif value:
                    value *= (NEGATED if reach else 1.0) * (QUOTED if quoted else 1.0)
                    weight += value * (TARGETED if target else 1.0)
                    pending += 0.0 if target else value
            if weight:
                found.append((clause.start(), clause.end(), weight))
        return found


def lowered(text: str) -> str:
    """As ``clauses`` lowers, but for the final sigma, which depends on what follows the clause."""
    return text.lower().replace("ς", "σ")


def features(clauses: list[tuple[int, int, float]]) -> list[float]:
    weights = [w for _, _, w in clauses]
    return [1.0, min(max(weights, default=0.0), 6.0), min(sum(weights), 30.0) ** 0.5, float(bool(weights))]


def patterns_of(text: str) -> set[str]:
    """Words and stems of a text, each once."""
    out = set()
    for word in set(WORD.findall(text.lower())):
        out.add(word)
        out.update(word[:n] + "*" for n in range(STEM, min(len(word), LONGEST_STEM + 1)))
    return out


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", rows: int = FIT_ROWS, key: str = "doc_id") -> Grammar:
    """Learn insult patterns and feature weights from at most ``rows`` labelled rows; nulls take no part.

    Rows are those of the smallest hash of ``key``; ``key`` is not a feature. Patterns are counted by Spark: first
    those of the toxic rows, then how often the others have them. Without rows of both labels the lists alone decide.
    """
    source = labelled.where(f"{text} is not null and {label} is not null").select(
        F.xxhash64(F.col(key)).alias("h"), F.col(text).alias("text"), F.col(label).cast("int").alias("label")
    ).orderBy("h", "text", "label").limit(rows).select("text", "label").persist()
    try:
        totals = {r["label"]: r["count"] for r in source.groupBy("label").count().collect()}
        toxic, clean = totals.get(1, 0), totals.get(0, 0)
        if not toxic or not clean:
            return Grammar({})

        def counted(held: frozenset[str] | None):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                counts: Counter[str] = Counter()
                for batch in batches:
                    for value in batch.column("text").to_pylist():
                        own = patterns_of(value)
                        counts.update(own if held is None else own & held)
                yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])
            return run

        schema = "pattern string, n long"
        prior = toxic / (toxic + clean)
        seen = source.where("label = 1").mapInArrow(counted(None), schema).groupBy("pattern").agg(F.sum("n").alias("n")).where("n >= 3").toPandas()
        bad = dict(zip(seen["pattern"], seen["n"], strict=True))
        other = source.where("label = 0").mapInArrow(counted(frozenset(bad)), schema).groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()
        good = dict(zip(other["pattern"], other["n"], strict=True))
        grammar = Grammar(choose_patterns(bad, good, prior))

        def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [features(grammar.clauses(t)) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.float64()))], ["label", "x"])

        fitted = source.mapInArrow(featured, "label int, x array<double>").toPandas()  # at most ``rows`` rows of four numbers
        x, y = np.stack(fitted["x"]), fitted["label"].to_numpy().astype(float)
    finally:
        source.unpersist()
    grammar.coefficients = logistic(x, y).tolist()
    return grammar


def choose_patterns(bad: dict[str, int], good: dict[str, int], prior: float) -> dict[str, float]:
    """Patterns whose toxic share cannot be chance, strongest first, without words and stems that repeat one another."""
    least = np.log(max(len(bad), 2)) + 3
    ranked = []
    for pattern, b in bad.items():
        n = b + good.get(pattern, 0)
        share = b / n
        surprise = b * np.log(share / prior) + ((n - b) * np.log((1 - share) / (1 - prior)) if b < n else 0.0)
        if share > 0.6 and surprise > least:
            ranked.append((surprise, len(pattern.removesuffix("*")), pattern, np.log((b + 0.5) / (n - b + 0.5)) - np.log(prior / (1 - prior))))
    ranked.sort(key=lambda r: (-round(r[0], 6), -r[1], r[2]))
    chosen: dict[str, float] = {}
    for _, _, pattern, weight in ranked:
        core = pattern.removesuffix("*")
        if any(core.startswith(c.removesuffix("*")) or c.startswith(core) for c in chosen):
            continue
        chosen[pattern] = float(min(weight, 5.0)) / 2
        if len(chosen) == PATTERNS:
            break
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """Columns of ``docs`` with score (0 to 1) and clauses (start, end, weight); columns of those names are replaced.

    Null and empty texts have no clause and the score of such a text. Whole texts are read; those without a word that
    could begin a match are passed over by one search. Repeated rows give equal results; an empty table gives none.
    """
    import pyarrow.compute as pc

    from colloquy.llm.token_ids import slices

    source = docs.drop("score", "clauses")
    schema = f"{source._jdf.schema().toDDL()}, score double, clauses array<struct<start: int, end: int, weight: double>>"
    finder = grammar.finder()
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(grammar.coefficients)
        for batch in batches:
            for at, texts in slices(batch.column(text), 4_000_000):
                texts = pc.fill_null(texts, "")
                may = pc.match_substring_regex(pa.array([lowered(t) for t in texts.to_pylist()], pa.large_string()), finder).to_pylist() if finder else [False] * len(texts)
                found = [grammar.clauses(t.as_py()) if m else [] for t, m in zip(texts, may, strict=True)]
                scores = 1 / (1 + np.exp(-np.array([features(f) for f in found]) @ w))
                part = batch.slice(at, len(texts))
                spans = [[{"start": a, "end": b, "weight": v} for a, b, v in f] for f in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array(spans, kind)], [*part.schema.names, "score", "clauses"])

    return source.mapInArrow(run, schema)
