"""Splitting texts into sentences, semantic chunks and size-limited chunks.

A document is one row, so its sentences are too: everything that needs only the
text of one document stays inside the row. The semantic split, which compares
hashed word counts of neighbouring sentences, moves each text once, to even out
its tasks, and shuffles nothing else.
``sentence_counts`` and ``adjacent_distance`` give the same comparison in long
form, for tables of sentences.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import words
from colloquy.operators.embedding import DIM, bucket, buckets, letters
from colloquy.runtime import text_tasks, within

SENTENCE = r"[^.!?]+[.!?]*"

# Default chunk size and overlap, the tighter pair used in
# deployment, semantic break percentile and sentence buffer.
CHUNK_SIZE, CHUNK_OVERLAP = 512, 128
DEPLOYED_CHUNK_SIZE, DEPLOYED_CHUNK_OVERLAP = 256, 32
BREAK_PERCENTILE = 90
BUFFER_SIZE = 1

_SALTS = 16
_TILE = 4_000_000  # counts of sentences held at once


def sentences_of(text) -> Column:
    """Ordered sentences of a text as an array."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def split_sentences(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    return df.select(id, F.posexplode(sentences_of(text)).alias("pos", "sentence"))


def buffer_sentences(
    df: DataFrame, id: str = "doc_id", buffer_size: int = BUFFER_SIZE, pos: str = "pos", sentence: str = "sentence"
) -> DataFrame:
    """Each sentence together with ``buffer_size`` neighbours on both sides."""
    near = Window.partitionBy(id).orderBy(pos).rowsBetween(-buffer_size, buffer_size)
    return df.withColumn("buffered", F.array_join(F.collect_list(sentence).over(near), ""))


def sentence_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", dim: int = DIM) -> DataFrame:
    """Word counts per sentence and bucket: (id, pos, bucket, n).

    Every sentence also has a row in bucket -1, which keeps those without words.
    """
    sents = docs.select(id, F.posexplode(sentences_of(text)).alias("pos", "_s"))
    found = sents.select(id, "pos", F.explode(F.concat(F.array(F.lit("")), letters(F.col("_s")))).alias("_w"))
    place = F.when(F.col("_w") == "", -1).otherwise(bucket(F.col("_w"), dim))
    return found.groupBy(id, "pos", place.alias("bucket")).agg(F.count("*").alias("n"))


def adjacent_distance(counts: DataFrame, id: str = "doc_id", buffer_size: int = BUFFER_SIZE) -> DataFrame:
    """``1 - cosine`` between each buffered sentence and the one before it: (id, pos, distance).

    Sentences end in their own terminator, so joining neighbours never merges two
    words and a buffer's counts are the sums of its sentences' counts. All products
    of buffers are therefore sums of products of single sentences at most
    ``2 * buffer_size + 1`` apart. Those come from one pass along each bucket, and no
    buffer is ever built. 1 if two buffers share no bucket or one has no words.
    Rounded to nine places so that equal texts give equal distances.
    """
    reach = 2 * buffer_size + 1
    along = Window.partitionBy(id, "bucket").orderBy("pos")
    n = F.col("n").cast("double")
    before = [
        c for k in range(1, reach + 1) for c in
        (F.lag("pos", k).over(along).alias(f"_p{k}"), F.lag(n, k).over(along).alias(f"_n{k}"))
    ]
    paired = counts.select(id, "pos", "bucket", n.alias("n"), *before)
    real = F.col("bucket") >= 0

    def products(apart: int) -> Column:
        """Product of the sentence with the one ``apart`` before it."""
        if apart == 0:
            return F.sum(F.when(real, n * n))
        hits = [
            F.when(real & (F.col(f"_p{k}") == F.col("pos") - apart), n * F.col(f"_n{k}")).otherwise(0.0)
            for k in range(1, apart + 1)
        ]
        return F.sum(sum(hits[1:], hits[0]))

    per_pos = paired.groupBy(id, "pos").agg(*[products(d).alias(f"_g{d}") for d in range(reach + 1)])
    by_pos = Window.partitionBy(id).orderBy("pos")

    def shifted(apart: int, offset: int) -> Column:
        moved = F.lead(f"_g{apart}", offset) if offset >= 0 else F.lag(f"_g{apart}", -offset)
        return F.coalesce(moved.over(by_pos), F.lit(0.0))

    def product(left: range, right: range) -> Column:
        terms = [shifted(abs(i - j), max(i, j)) for i in left for j in right]
        return sum(terms[1:], terms[0])

    here = range(-buffer_size, buffer_size + 1)
    prior = range(-buffer_size - 1, buffer_size)
    length = F.sqrt(product(here, here)) * F.sqrt(product(prior, prior))
    cosine = F.try_divide(product(prior, here), length)
    return per_pos.select(id, "pos", F.round(1 - F.coalesce(cosine, F.lit(0.0)), 9).alias("distance")).where("pos > 0")


def breakpoint_threshold(distances: DataFrame, id: str = "doc_id", pct: float = BREAK_PERCENTILE) -> DataFrame:
    """Interpolated percentile of the distances within each document.

    Rounded to three places more than the distances it is compared with, which
    takes away the last bits of the interpolation only.
    """
    return distances.groupBy(id).agg(
        F.round(F.percentile("distance", F.lit(pct / 100.0)), 12).alias("threshold")
    )


def _cosine_to_prior(buckets_: np.ndarray, ends: np.ndarray, doc: np.ndarray, buffer_size: int, dim: int) -> np.ndarray:
    """``1 - cosine`` of each buffered sentence and the one before it; 1 where its document begins.

    ``ends`` are the words up to and including each sentence, ``doc`` its document. Counts are dense for a stretch of
    sentences at a time, so a document of any length takes the same memory.
    """
    n, starts, out = len(doc), np.concatenate([[0], ends]), np.ones(len(doc))
    step = max(1, _TILE // dim)
    for a in range(0, n, step):
        e, first = min(n, a + step), max(0, a - 1)  # the sentence before the stretch has a buffer, too
        lo, hi = max(0, first - buffer_size), min(n, e + buffer_size)
        words = slice(starts[lo], starts[hi])
        cells = np.repeat(np.arange(hi - lo), np.diff(starts[lo:hi + 1])) * dim + buckets_[words]
        counts = np.bincount(cells, minlength=(hi - lo) * dim).reshape(hi - lo, dim).astype(np.float64)
        joined = np.zeros((e - first, dim))
        for k in range(-buffer_size, buffer_size + 1):
            at = np.arange(max(first, -k), min(e, n - k))  # sentences whose neighbour k away exists
            at = at[doc[at] == doc[at + k]]
            joined[at - first] += counts[at + k - lo]
        length = np.sqrt(np.einsum("ij,ij->i", joined, joined))
        product = np.einsum("ij,ij->i", joined[1:], joined[:-1])
        norms = length[1:] * length[:-1]
        same = (doc[first + 1:e] == doc[first:e - 1]) & (norms > 0)
        out[first + 1:e][same] = 1 - product[same] / norms[same]
    return out


def neighbour_distances(sentences: Column, buffer_size: int = BUFFER_SIZE, dim: int = DIM) -> Column:
    """``adjacent_distance`` inside the row: the distances of a document's second and later sentences, in order.

    Words are found by Spark; an Arrow function hashes and counts them. Counts are whole numbers, so both forms agree.
    """
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def compare(found: pa.Array) -> pa.Array:
        sizes = np.asarray(found.value_lengths().fill_null(0)).astype(np.int64)
        each = found.flatten()
        ends = np.cumsum(np.asarray(each.value_lengths().fill_null(0)), dtype=np.int64)
        far = _cosine_to_prior(buckets(each.flatten(), dim), ends, np.repeat(np.arange(len(sizes)), sizes), buffer_size, dim)
        later = np.ones(len(far), bool)
        later[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
        offsets = np.concatenate([[0], np.cumsum(np.maximum(sizes - 1, 0))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(far[later]))

    return F.transform(compare(F.transform(sentences, letters)), lambda d: F.round(d, 9))


def semantic_breaks(distances: Column, pct: float = BREAK_PERCENTILE) -> Column:
    """Positions in front of which a chunk starts, from the distances of the second and later sentences.

    The limit is that of ``breakpoint_threshold``.
    """
    def once(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), 0)  # worked out once, not for each element

    place = F.lit(pct / 100.0) * (F.size(distances) - 1)
    low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")

    def limit(ranked: Column) -> Column:
        below, above = F.get(ranked, low), F.get(ranked, high)
        return F.round(F.when(below == above, below).otherwise((high - place) * below + (place - low) * above), 12)

    def breaks(most: Column) -> Column:
        return F.filter(F.transform(distances, lambda d, i: F.when(d > most, i + 1)), lambda i: i.isNotNull())

    return once(once(F.array_sort(distances), limit), breaks)


def _with_breaks(
    docs: DataFrame, id: str, text: str, buffer_size: int, pct: float, dim: int, keep: tuple = ()
) -> DataFrame:
    """Sentences of each chunk of each row, with the ``keep`` columns of the row.

    Every row is split by itself, so rows of one id do not mix. Equal texts without an id are counted first and split
    once, so copies never meet in one task.
    """
    spoken = docs.where(F.col(text).rlike("[^.!?]")).select(id, text, *keep)
    named = spoken.where(F.col(id).isNotNull()).withColumn("_copies", F.lit(1).cast("bigint"))
    # columns of any type are compared as text
    unnamed = spoken.where(F.col(id).isNull()).groupBy(text, F.to_json(F.struct(F.lit(0).alias("_"), *keep)).alias("_kept")).agg(
        F.count("*").alias("_copies"), *[F.first(c).alias(c) for c in keep]
    )
    no_id = F.lit(None).cast(docs.schema[id].dataType).alias(id)
    rows = named.unionByName(unnamed.select(no_id, text, *keep, "_copies"))
    rows = rows.repartition(text_tasks(docs, text), id, F.xxhash64(text))  # of equal size, however few files there are
    cut = _broken(rows, text, buffer_size, pct, dim, (id, *keep, "_copies"))
    return cut.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).select(id, *keep, "chunk_no", "_units")


def _broken(docs: DataFrame, text: str, buffer_size: int, pct: float, dim: int, keep: tuple) -> DataFrame:
    """Each step has its column, so that the limit is worked out once for a document."""
    cut = docs.select(*keep, sentences_of(text).alias("_sents"))
    cut = cut.withColumn("_distances", neighbour_distances(F.col("_sents"), buffer_size, dim))
    cut = cut.withColumn("_breaks", semantic_breaks(F.col("_distances"), pct))
    starts, ends = F.concat(F.array(F.lit(0)), "_breaks"), F.concat("_breaks", F.array(F.size("_sents")))
    groups = F.transform(
        F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda p: F.slice(F.col("_sents"), p["s"] + 1, p["e"] - p["s"])
    )
    return cut.select(*keep, F.posexplode(groups).alias("chunk_no", "_units"))


def semantic_chunks(
    docs: DataFrame, id: str = "doc_id", text: str = "text",
    buffer_size: int = BUFFER_SIZE, pct: float = BREAK_PERCENTILE, dim: int = DIM,
) -> DataFrame:
    """Break after a sentence whose distance to the next is above the threshold."""
    grouped = _with_breaks(docs, id, text, buffer_size, pct, dim)
    return grouped.select(id, "chunk_no", F.array_join("_units", "").alias("text"))


def _window_starts(n: Column, size: int, overlap: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))


def token_windows(df: DataFrame, id: str, text: str, size: int, overlap: int = 0) -> DataFrame:
    """Cut a text into windows of ``size`` words that share ``overlap`` words."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    parts = df.select(id, words(text).alias("_w"))
    cut = F.transform(
        _window_starts(F.size("_w"), size, overlap), lambda i: F.slice(F.col("_w"), i + 1, size)
    )
    return parts.select(id, F.posexplode(cut).alias("pos", "_part")).where(F.size("_part") > 0).select(
        id, "pos", F.array_join("_part", "").alias("text"), F.size("_part").alias("n_tokens")
    )


_SPANS = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))


@F.pandas_udf(_SPANS)
def _spans(tokens: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    """Start and end unit of each packed chunk, from the units' lengths only."""
    def one(lengths, limit, shared):
        lengths = np.asarray(lengths, dtype=np.int64)
        n = len(lengths)
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.searchsorted(total, total[:-1] + limit, side="right") - 1
        room = np.minimum(shared, limit - lengths)
        begins = np.searchsorted(total, total[:-1] - room, side="left")
        out, s = [], 0
        while s < n:
            e = int(ends[s])
            out.append({"s": s, "e": e})
            if e >= n:
                break
            s = int(begins[e])
        return out

    return pd.Series([one(*row) for row in zip(tokens, size, overlap)])


def pack_units(df: DataFrame, keep: list, units: str, chunk_size: int, overlap: int) -> DataFrame:
    """Pack an array of units into chunks of at most ``chunk_size`` words.

    Only the unit lengths reach Python; texts are cut and joined inside the row.
    """
    if not 0 <= overlap < chunk_size:
        raise ValueError("overlap must be below chunk_size")
    measured = df.select(
        *keep, F.transform(F.col(units), lambda u: F.struct(u.alias("t"), words(u).alias("w"))).alias("_units")
    )
    fitted = F.flatten(
        F.transform(
            F.col("_units"),
            lambda u: F.when(
                F.size(u["w"]) > chunk_size,
                F.transform(
                    _window_starts(F.size(u["w"]), chunk_size, 0),
                    lambda i: F.struct(
                        F.array_join(F.slice(u["w"], i + 1, chunk_size), "").alias("t"),
                        F.size(F.slice(u["w"], i + 1, chunk_size)).alias("n"),
                    ),
                ),
            ).otherwise(F.array(F.struct(u["t"].alias("t"), F.size(u["w"]).alias("n")))),
        )
    )
    placed = measured.select(*keep, fitted.alias("_fit")).withColumn(
        "_spans", _spans(F.col("_fit.n"), F.lit(chunk_size), F.lit(overlap))
    )

    def chunk(span):
        inside = F.slice(F.col("_fit"), span["s"] + 1, span["e"] - span["s"])
        return F.struct(
            F.array_join(inside["t"], "").alias("text"),
            F.aggregate(inside["n"], F.lit(0), lambda a, x: a + x).alias("n_tokens"),
        )

    built = F.transform("_spans", chunk)
    return placed.select(*keep, F.posexplode(built).alias("part", "_c")).select(*keep, "part", "_c.*")


def pack_sentences(
    df: DataFrame, id: str = "doc_id", text: str = "text",
    chunk_size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Size-limited chunks of whole sentences: (id, pos, text, n_tokens).

    The next chunk starts with the longest run of closing sentences that has at
    most ``overlap`` words and leaves room for the next sentence. A sentence
    longer than ``chunk_size`` is cut into word windows first.
    """
    sents = df.select(id, sentences_of(text).alias("_units"))
    return pack_units(sents, [id], "_units", chunk_size, overlap).withColumnRenamed("part", "pos")


def chunk_documents(
    docs: DataFrame, id: str = "doc_id", text: str = "text",
    chunk_size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
    buffer_size: int = BUFFER_SIZE, pct: float = BREAK_PERCENTILE, dim: int = DIM, keep: tuple = (),
) -> DataFrame:
    """Semantic split, then size-limited split of each semantic chunk, with the row's ``keep`` columns."""
    grouped = _with_breaks(docs, id, text, buffer_size, pct, dim, keep)
    return pack_units(grouped, [id, *keep, "chunk_no"], "_units", chunk_size, overlap)


def chunk_fingerprint(df: DataFrame, settings: dict | None = None, text: str = "text") -> DataFrame:
    """Add ``content_hash``: the text together with the settings it was made with."""
    marks = [F.lit(f"{k}={settings[k]}") for k in sorted(settings or {})]
    return df.withColumn("content_hash", F.sha2(F.concat_ws("|", *marks, F.col(text)), 256))


def new_chunks(df: DataFrame, seen: DataFrame, id: str = "chunk_id", on: tuple = ("content_hash",)) -> DataFrame:
    """Rows whose fingerprint is not in ``seen``; copies within ``df`` all stay.

    ``on`` are the columns of the fingerprint. With the document's id among them,
    equal texts of two documents are both stored, in whatever runs they come. A null equals a null.

    Only fingerprints that are both incoming and known matter. They are found on
    pre-aggregated hashes, where a text with many copies counts once. If there are
    too many to broadcast, the rows are spread over salts, so the copies of one
    text do not meet in one task.
    """
    on, mark = list(on), "_fingerprint"

    def marked(rows: DataFrame) -> DataFrame:
        return rows.withColumn(mark, F.struct(*on))  # as one value, in which nulls are equal

    incoming = marked(df.select(*on)).select(mark).distinct()
    known = incoming.join(marked(seen.select(*on)).select(mark).distinct(), mark, "left_semi")
    if within(known):
        return marked(df).join(F.broadcast(known), mark, "left_anti").drop(mark)
    salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    spread = marked(df).withColumn("_salt", F.pmod(F.xxhash64(id), F.lit(_SALTS)).cast("int"))
    return spread.join(salted, [mark, "_salt"], "left_anti").drop("_salt", mark)
