"""Best-fit-decreasing packing with certified bin counts and exchange between partitions.

Pieces are dealt at random into partitions of a bounded number, each packed by best-fit decreasing. Dual-feasible
functions bound from below how many bins a partition needs; a partition that meets its bound is certified and gives only
its loosest bin to the exchange, the others give every bin that is not full. The exchange deals these documents
anew, into fewer partitions, which are packed again. What the exchange gathers shrinks from round
to round; it ends when the whole meets the bound of the whole, or when a round saves no bin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.token_ids import END_ID, batch_encoder, default_tokenizer, slices
from colloquy.runtime import materialize

CAPACITY = 4096
PARTITION_PIECES = 50_000
ROUNDS = 6
SLICE_BYTES = 1_000_000  # text that is held as words at a time
CACHE_WORDS = 60_000     # words whose ids a task remembers


def cut_documents(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, text: str = "text",
    keep: tuple[str, ...] = ("doc_id",), end_id: int = END_ID,
) -> DataFrame:
    """``keep`` columns, piece, start, length, ids: whole texts as ids with the end id, cut only beyond ``capacity``.

    A null or empty text is one piece of the end id. Repeated rows give repeated pieces.
    """
    path = tokenizer or default_tokenizer()
    source = docs.select(*keep, F.col(text).alias("__text"))
    schema = source.drop("__text").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = batch_encoder(path, CACHE_WORDS), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at, texts in slices(batch.column("__text"), SLICE_BYTES):
                ids, offsets = encode(texts)
                raw, sizes = ids.astype("<u4").tobytes(), np.diff(offsets) + 1
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                first = offsets[:-1][row] + start
                last = start + length == sizes[row]  # the piece that ends with the end id
                values = [raw[4 * a:4 * b] + (end if z else b"") for a, b, z in zip(first.tolist(), (first + length - last).tolist(), last.tolist(), strict=True)]
                kept = [batch.column(c).slice(at, len(texts)).take(pa.array(row)) for c in keep]
                yield pa.RecordBatch.from_arrays([
                    *kept, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(values, pa.binary()),
                ], [*keep, "piece", "start", "length", "ids"])
            pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece. Room left is a bit set, so the tightest bin that fits is its lowest bit from the length on."""
    bins = np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        left = room - size
        if left:
            if not open_bins[left]:
                rooms |= 1 << left
            open_bins[left].append(b)
        bins[i] = b
    return bins


def bins_needed(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Lower bound on the bins for ``counts`` pieces of distinct ``sizes``, by families of dual-feasible functions.

    f_t rounds pieces above capacity - t up to a full bin and drops those below t; g_k counts how many (k + 1)-ths
    a piece exceeds. The sum over f(size) of any such function cannot exceed the number of bins.
    """
    if not len(sizes):
        return 0
    order = np.argsort(sizes)
    sizes, counts = sizes[order].astype(np.int64), counts[order].astype(np.int64)
    best = -(-int((sizes * counts).sum()) // capacity)
    number, volume = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(sizes * counts)])
    t = np.unique(np.concatenate([sizes[2 * sizes <= capacity], [1]]))
    big, small = np.searchsorted(sizes, capacity - t, "right"), np.searchsorted(sizes, t, "left")
    best = max(best, int((number[-1] - number[big] - (-(volume[big] - volume[np.minimum(small, big)]) // capacity)).max()))
    for k in range(1, 21):
        whole = (k + 1) * sizes % capacity == 0
        value = np.where(whole, sizes * k, (k + 1) * sizes // capacity * capacity)  # in units of 1 / (k capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def _needed(lengths: np.ndarray, capacity: int) -> int:
    return bins_needed(*np.unique(lengths, return_counts=True), capacity)


def _fitter(capacity: int, r: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs one partition of round ``r`` and says which of its bins stay."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "key"], ascending=[False, True], ignore_index=True)
        sizes = rows["length"].to_numpy()
        bins = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        certified = len(fill) == _needed(sizes, capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.concatenate([[0], np.cumsum(np.bincount(bins))[:-1]])
        offset = np.empty(len(rows), np.int64)
        offset[order] = before - before[first[bins[order]]]
        return pd.DataFrame({
            "key": rows["key"], "length": sizes, "bin": bins, "round": np.int32(r), "part": rows["part"], "offset": offset,
            "closed": ((fill == capacity) | (certified & (np.arange(len(fill)) != fill.argmin())))[bins],
        })

    return fit


def pack(
    pieces: DataFrame, key: str, length: str = "length", capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """key, sequence_id, offset: places of all pieces in sequences of at most ``capacity``, gapless from 0.

    ``key`` is a unique long per piece, from 0 up. Lengths of null or below 1 take no part; one above the capacity is an
    error. Full pieces are sequences of their own. An empty table gives no rows. Only keys and lengths move.
    """
    items = pieces.select(F.col(key).cast("long").alias("key"), F.col(length).cast("long").alias("length")).where("length >= 1")
    items = items.withColumn("fits", F.when(F.col("length") <= capacity, True).otherwise(F.raise_error("a piece is longer than the capacity").cast("boolean"))).where("fits").drop("fits")
    full = items.where(F.col("length") == capacity).select("key", F.col("key").alias("bin"), F.lit(-1).alias("round"), F.lit(-1).alias("part"), F.lit(0).cast("long").alias("offset"))
    left, done = materialize(items.where(F.col("length") < capacity)), [full]
    # the histogram has one row per length below the capacity
    histogram = left.groupBy("length").count().toPandas()
    total = int(histogram["count"].sum())
    before = None
    for r in range(rounds):
        if not total:
            break
        parts = -(-total // partition_pieces)

        dealt = left.withColumn("part", F.pmod(F.xxhash64("key", F.lit(r)), F.lit(parts)).cast("int"))
        packed = materialize(dealt.groupBy("part").applyInPandas(_fitter(capacity, r), "key long, length long, bin long, round int, part int, offset long, closed boolean"))
        now, loose = packed.where("offset = 0").agg(F.count("*"), F.count(F.when(~F.col("closed"), 1))).first()
        if parts == 1 or r == rounds - 1 or now == bound_of(histogram, capacity) or (r > 1 and now >= before):
            done.append(packed.select("key", "bin", "round", "part", "offset"))
            break
        done.append(packed.where("closed").select("key", "bin", "round", "part", "offset"))
        left = materialize(packed.where("not closed").select("key", "length"))
        histogram = left.groupBy("length").count().toPandas()
        total, before = int(histogram["count"].sum()), loose
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    # 4 bits of round, 36 of partition, 24 of bin; full pieces count below zero
    number = F.when(F.col("round") < 0, -1 - F.col("key")).otherwise(
        F.shiftleft(F.col("round").cast("long"), 59) + F.shiftleft(F.col("part").cast("long"), 24) + F.col("bin"))
    return placed.select("key", number.alias("sequence_id"), "offset")


def bound_of(histogram: pd.DataFrame, capacity: int) -> int:
    return bins_needed(histogram["length"].to_numpy(), histogram["count"].to_numpy(), capacity)


def sequences(pieces: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """sequence_id, ids, doc_ids: the packed sequences themselves; a sequence is at most ``capacity`` ids."""
    rows = pieces.join(placed, pieces[key] == placed["key"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    return rows.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))
