"""Token ids as directly addressable codes, in files that give any token without decoding a block.

An id is split into chunks of 8 bits, lowest first. Level k holds the k-th chunk of every id that has one, a
bitmap that marks the ids with a further chunk, and a rank directory over the bitmap, so the place of an id's
next chunk is one rank query away. A file is a Parquet container of segments: each row is one self-contained
image (magic, document table, levels) of whole documents in ascending order. Spark's writer commits it, so lost
executors leave no partial files, and any store that Spark reaches will do.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm.token_ids import END_ID, batch_encoder, default_tokenizer, slices
from colloquy.runtime import small_side

MAGIC = b"DAC1"
SEGMENT_TOKENS = 1_000_000
NO_DOC = -(2**63)  # stands for a null doc_id inside an image
SEGMENTS = "shard int, segment int, shard_start long, n_tokens long, image binary"


def _rank_directory(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ones before each 512 bits, and before each 64 bits within them."""
    ones = np.bitwise_count(words).astype(np.int64)
    before = np.cumsum(ones) - ones
    blocks = before[::8]
    return blocks.astype("<u4"), (before - np.repeat(blocks, 8)[: len(before)]).astype("<u2")


def encode_image(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """One image of the documents' ids; ``starts`` has one more entry than there are documents."""
    parts = [struct.pack("<4sQQ", MAGIC, len(doc_ids), len(ids)), doc_ids.astype("<i8").tobytes(), starts.astype("<u8").tobytes()]
    rest = ids.astype(np.uint32)
    while True:
        further = rest >> 8
        bits = np.packbits(further > 0, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)])
        blocks, within = _rank_directory(bits.view("<u8"))
        more = bool((further > 0).any())
        parts += [struct.pack("<?Q", more, len(rest)), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), blocks.tobytes(), within.tobytes()]
        if not more:
            return b"".join(parts)
        rest = further[further > 0]


class Image:
    """Reader of one image. Nothing is decoded before it is asked for."""

    def __init__(self, raw: bytes):
        magic, docs, self.n_tokens = struct.unpack_from("<4sQQ", raw)
        if magic != MAGIC:
            raise ValueError("not an image of directly addressable codes")
        at = struct.calcsize("<4sQQ")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.starts, self.levels = take("<i8", docs), take("<u8", docs + 1).astype(np.int64), []
        more = True
        while more:
            more, n = struct.unpack_from("<?Q", raw, at)
            at += struct.calcsize("<?Q")
            chunks, words = take("u1", n), (n + 63) // 64
            self.levels.append((chunks, take("<u8", words), take("<u4", (words + 7) // 8), take("<u2", words)))

    def tokens(self, positions: np.ndarray) -> np.ndarray:
        """Ids at any positions, in any order."""
        at = np.asarray(positions, np.int64)
        out, live = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (chunks, words, blocks, within) in enumerate(self.levels):
            out[live] |= chunks[at].astype(np.uint32) << np.uint32(8 * level)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            value = words[word]
            goes_on = (value >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(value & ((np.uint64(1) << bit) - np.uint64(1)))
            at = (blocks[word >> 3].astype(np.int64) + within[word] + below)[goes_on]
            live = live[goes_on]
            if not len(live):
                break
        return out


def write_codes(
    docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text",
    end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS,
) -> None:
    """Encode whole texts and write them in ascending ``id_col`` order (nulls first, equal ids by their text).

    Texts are range-partitioned once, before they are encoded; each partition becomes a shard of segments of
    whole documents. A null or empty text is its end id alone, an empty table writes no segment, other columns
    are left out. Memory is bounded by a segment or by one document.
    """
    vocabulary = tokenizer or default_tokenizer()
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, shard = batch_encoder(vocabulary), TaskContext.get().partitionId()
        done = segment = 0
        names: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal done, segment, names, parts, sizes
            ids = np.concatenate(parts)
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            row = [[shard], [segment], [done], [len(ids)], [encode_image(np.concatenate(names), starts, ids)]]
            done, segment, names, parts, sizes = done + len(ids), segment + 1, [], [], []
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["shard", "segment", "shard_start", "n_tokens", "image"])

        for batch in batches:
            for at, texts in slices(batch.column("text"), 2_000_000):
                ids, offsets = encode(texts)
                names.append(np.asarray(batch.column("doc_id").slice(at, len(texts)).fill_null(NO_DOC)))
                parts.append(np.insert(ids, offsets[1:], end_id))
                sizes.append(np.diff(offsets) + 1)
                if sum(map(len, parts)) >= segment_tokens:
                    yield flush()
        if parts:
            yield flush()

    ordered.mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a written folder with ``start``: the ids before the segment over all shards.

    Shards are in order and one per partition, so their totals are few rows.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("shard", before.alias("base"))
    return segments.join(small_side(bases), "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base")


def stored_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit) of every stored document, through token access."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raw in zip(batch.column("start").to_pylist(), batch.column("image").to_pylist(), strict=True):
                image, at = Image(raw), 0
                while at < len(image.doc_ids):
                    end = max(at + 1, int(np.searchsorted(image.starts, image.starts[at] + 500_000, side="right")) - 1)
                    offset = image.starts[at]
                    ids = image.tokens(np.arange(offset, image.starts[end])).astype("<u4").tobytes()
                    cuts = 4 * (image.starts[at:end + 1] - offset)
                    names = image.doc_ids[at:end]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(names, pa.int64(), mask=names == NO_DOC), pa.array(start + image.starts[at:end], pa.int64()),
                        pa.array([ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary()),
                    ], ["doc_id", "start", "ids"])
                    at = end

    return segments.select("start", "image").mapInArrow(run, "doc_id long, start long, ids binary")


def tokens_at(segments: DataFrame, positions: DataFrame) -> DataFrame:
    """position, token for a table of ``position``: each goes to its segment by bucket, then to one chunk per level."""
    span = SEGMENT_TOKENS
    s = segments.select("start", "n_tokens", "image", F.explode(F.sequence(F.floor(F.col("start") / span), F.floor((F.col("start") + F.col("n_tokens") - 1) / span))).alias("bucket"))
    p = positions.select("position", F.floor(F.col("position") / span).alias("bucket"))
    near = p.groupBy("bucket").count().select("bucket").join(s, "bucket").select("start", "n_tokens", "image").distinct()
    wide = near.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / span), F.floor((F.col("start") + F.col("n_tokens") - 1) / span))))
    both = p.join(wide, "bucket").where("position >= start and position < start + n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [int(Image(raw).tokens(np.array([p - s]))[0]) for p, s, raw in zip(*(batch.column(c).to_pylist() for c in ("position", "start", "image")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("position"), pa.array(out, pa.int64())], ["position", "token"])

    return both.select("position", "start", "image").mapInArrow(run, "position long, token long")
