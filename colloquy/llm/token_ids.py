"""Whole texts to token ids with the tokenizers library, distinct words first.

A text is cut at plain spaces and line feeds, at which this family of tokenizers always cuts as well. Each batch
encodes its distinct pieces once and gathers the ids of all texts by position, so the library sees a word once
per batch and mostly once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 1
SLICE_BYTES = 6_000_000   # text that is held as words at a time
CACHE_WORDS = 400_000     # words whose ids a task remembers; it starts anew beyond


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of at most ``most`` bytes, or of one text, with their first row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    at = 0
    while at < len(column):
        end = at + 1 + int(np.searchsorted(np.cumsum(sizes[at + 1:]) + sizes[at], most, side="right"))
        yield at, column.slice(at, end - at)
        at = end


def batch_encoder(tokenizer: str, most_words: int = CACHE_WORDS) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function from texts to (all ids as uint32, first position of each text and the end)."""
    import array
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    model = library.model
    # byte-level alphabet of the vocabulary: printable bytes stand for themselves, the others follow from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    simple = re.compile("[a-zß-öø-ÿ]+|[.,;:!?*&$%#|()\"-]+")
    known: dict[str, bytes] = {"": b""}

    def encoded(word: str) -> bytes:
        if simple.fullmatch(word):  # one lower-case word or mark: nothing to normalize or to cut
            plain = word if word.isascii() else word.encode().decode("latin-1").translate(alphabet)
            ids = [x.id for x in model.tokenize(plain)]
        else:
            ids = library.encode(word, add_special_tokens=False).ids
        return array.array("I", ids).tobytes()

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        # beyond Latin-1, or with what may be a special token, a text is taken as it is
        rare = pc.match_substring_regex(texts, r"[^\x{00}-\x{ff}]|<\|")
        common = pc.replace_substring_regex(
            pc.utf8_lower(texts), pattern=r'([a-z\x{df}-\x{f6}\x{f8}-\x{ff}])([.,;:!?*&$%#|()"-])', replacement=r"\1 \2"
        )
        pieces = pc.split_pattern(pc.replace_substring(pc.if_else(rare, texts, common), "\n", " "), " ")
        coded = pieces.flatten().dictionary_encode()
        if len(known) > most_words:
            known.clear()
            known[""] = b""
        found = []
        for word in coded.dictionary.to_pylist():
            ids = known.get(word)
            if ids is None:
                ids = known[word] = encoded(word)
            found.append(ids)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        every = np.frombuffer(b"".join(found), "<u4")
        first = np.cumsum(lengths) - lengths
        at = np.asarray(coded.indices)
        counts = lengths[at]
        ends = np.cumsum(counts)
        ids = every[np.repeat(first[at] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
        offsets = np.asarray(pieces.offsets) - pieces.offsets[0].as_py()
        return ids, np.concatenate([[0], ends])[offsets]

    return encode


def encode_documents(
    docs: DataFrame, tokenizer: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    end_id: int = END_ID,
) -> DataFrame:
    """``keep`` columns and ``ids``: little-endian unsigned 32-bit ids of the whole text, then ``end_id``.

    A null or empty text gives the end id alone. Repeated rows give repeated results; an empty table gives none.
    Other columns are left out.
    """
    path = tokenizer or default_tokenizer()
    source = docs.select(*keep, F.col(text).alias("__text"))
    schema = source.drop("__text").schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = batch_encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at, texts in slices(batch.column("__text")):
                ids, offsets = encode(texts)
                raw = ids.astype("<u4").tobytes()
                values = [raw[4 * a:4 * b] + end for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                kept = [batch.column(c).slice(at, len(texts)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(values, pa.binary())], [*keep, "ids"])

    return source.mapInArrow(run, schema)
