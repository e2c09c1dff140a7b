"""Benchmark passages in documents, found through the CGK embedding and bit sampling.

Item and document are sequences of normalized words. The CGK random walk reads a sequence with a pointer that
stays or moves on by a coin for each (step, word), so two sequences at a small edit distance give outputs at a
small Hamming distance. Bit-sampling keys over the outputs collide with a known rate; repeated walks raise it to
the target recall. Each item-sized window of a document that could match is walked and looked up, and what
collides is decided by its exact edit distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from colloquy.llm.near_dups import mixed
from colloquy.llm.token_ids import slices
from colloquy.runtime import within

DISTANCE = 0.1       # allowed edits, as a share of an item's words
MIN_WORDS = 8        # shorter items would match everyday phrases; they take part only when equal, see find_leaks
RECALL = 0.998       # target over pairs at the allowed distance
SAMPLED = 4          # output positions in a key
STEPS = 3            # steps of a walk to a word; the pointer stays at every second one, so a walk passes the last word
CALIBRATION = 2000   # pairs per estimate of the collision rate
PART = 500_000       # words of the windows that are walked at once
INDEX_ITEMS = 20_000  # items that one pass over the documents holds; more items take more passes
SEED = 1


def split_words(texts: pa.Array) -> pa.ListArray:
    """Lower-cased runs of letters and digits of every text; null counts as empty, which is one empty word."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), pattern=r"[^\pL\pN]+", replacement=" ")
    return pc.split_pattern(pc.utf8_trim_whitespace(plain), " ")


def word_code(word: str) -> int:
    """64 bits for a word, never 0, which is the padding."""
    return xxh3_64_intdigest(word.encode()) or 1


def word_codes(text: str | None) -> np.ndarray:
    words = split_words(pa.array([text], pa.string()))[0].as_py()
    return np.array([word_code(w) for w in words if w], np.uint64)


def neighbours(codes: np.ndarray) -> np.ndarray:
    """A code for each pair of neighbouring words; 0 where one of them is 0."""
    both = mixed(codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]) | np.uint64(1)
    return np.where((codes[:-1] != 0) & (codes[1:] != 0), both, np.uint64(0))


def cgk_walk(windows: np.ndarray, lengths: np.ndarray, walk: int, steps: np.ndarray) -> np.ndarray:
    """Outputs of one walk over rows of word codes, at the ascending ``steps`` of each length (distinct lengths by samples).

    Rows ascend by length, and so do their steps; a row is left once its last step is read. The pointer reads a word
    and moves on if the coin of (step, word) says so; behind the last word it reads zeros. Coins are bits of a hash
    of the word, 64 steps to a hash.
    """
    rows, width = windows.shape
    padded = np.concatenate([windows, np.zeros((rows, 1), np.uint64)], axis=1)
    flat, at = padded.ravel(), np.arange(rows) * (width + 1)
    bounds = [*np.unique(lengths, return_index=True)[1].tolist(), rows]
    reads: dict[int, list[tuple[int, int]]] = {}
    for i, own in enumerate(steps.tolist()):
        for sample, step in enumerate(own):
            reads.setdefault(step, []).append((sample, i))
    out = np.zeros((steps.shape[1], rows), np.uint64)
    low = 0
    for step in range(int(steps.max(initial=-1)) + 1):
        if step % 64 == 0:
            coins = np.zeros_like(padded)
            coins[low:, :width] = mixed(padded[low:, :width] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED + 1_000_003 * (walk + 1) + step))
            coins = coins.ravel()  # the last column's coins are 0, so that the pointer stays there
        for sample, i in reads.get(step, ()):
            out[sample, bounds[i]:bounds[i + 1]] = flat[at[bounds[i]:bounds[i + 1]]]
            if sample == len(out) - 1:
                low = bounds[i + 1]
        moves = coins[at[low:]]
        moves >>= np.uint64(step % 64)
        moves &= np.uint64(1)
        at[low:] += moves.view(np.int64)
    return out


_STEPS_OF: dict[tuple[int, int], tuple[int, ...]] = {}
_WALKS_OF: dict[tuple[int, float, float], int] = {}


def sampled_steps(length: int, walk: int) -> tuple[int, ...]:
    """The walk's sampled output positions in order, at the same shares of the steps for windows of any length."""
    known = _STEPS_OF.get((length, walk))
    if known is None:
        shares = np.random.default_rng([SEED, walk]).random(SAMPLED)
        known = _STEPS_OF[length, walk] = tuple(sorted((shares * STEPS * max(1, length)).astype(int).tolist()))
    return known


def keys_of(windows: np.ndarray, lengths: np.ndarray, walk: int) -> np.ndarray:
    """One key per row, in ascending order of lengths, from the walk's outputs at the positions sampled for the length."""
    steps = np.array([sampled_steps(int(n), walk) for n in np.unique(lengths)], np.int64).reshape(-1, SAMPLED)
    key = mixed(lengths.astype(np.uint64) * np.uint64(1000) + np.uint64(walk))
    for column in cgk_walk(windows, lengths, walk, steps):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def parts_of(lengths: np.ndarray) -> Iterator[slice]:
    """Cuts rows of ascending length where they hold ``PART`` words, or where the length has doubled."""
    at = 0
    while at < len(lengths):
        end = int(np.searchsorted(lengths, 2 * lengths[at], "right"))
        end = min(end, at + max(1, PART // int(lengths[end - 1])))
        yield slice(at, end)
        at = end


def windows_of(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of the codes from each start, zeros behind each length."""
    column = np.arange(int(lengths.max(initial=1)))
    return np.where(column < lengths[:, None], codes[np.minimum(starts[:, None] + column, len(codes) - 1)], np.uint64(0))


def edits_allowed(length: int, distance: float) -> int:
    return int(math.floor(distance * length + 1e-9))


def edited_pairs(length: int, edits: int, within: int, draw: np.random.Generator, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of random words, and the same with so many edits among their first ``within`` words."""
    rows = draw.integers(1, 2**62, (pairs, length)).astype(np.uint64)
    changed = np.zeros_like(rows)
    for i, row in enumerate(rows):
        # a third of the edits substitute, the others delete and insert in pairs, the hardest for a window of equal length
        words = row.tolist()
        for e in range(edits):
            if e % 3 == 0:
                words[int(draw.integers(within))] = int(draw.integers(1, 2**62))
            elif e % 3 == 1:
                del words[int(draw.integers(within))]
            else:
                words.insert(int(draw.integers(within)), int(draw.integers(1, 2**62)))
        changed[i] = (words + draw.integers(1, 2**62, length).tolist())[:length]
    return rows, changed


def walks_for(length: int, distance: float, recall: float = RECALL) -> int:
    """Repeated walks that reach the target recall at the allowed distance, by simulation on random sequences.

    Edits spread over the whole sequence, over its first half and over a start of twice their number must each reach
    it. There is no limit: the last outputs of a walk are mostly zeros for both sequences, so each walk can meet.
    """
    edits = edits_allowed(length, distance)
    if not edits:
        return 1
    if (length, distance, recall) in _WALKS_OF:
        return _WALKS_OF[length, distance, recall]
    if edits > 10 and edits % 5:
        # lengths share the estimate of the next number of edits in steps of five, which is harder
        return walks_for(math.ceil((edits + 5 - edits % 5) / distance - 1e-9), distance, recall)
    # and lengths of one number of edits that of the shortest, likewise
    shorter = math.ceil(edits / distance - 1e-9) if edits > 10 else length - length % 5
    if shorter < length and edits_allowed(shorter, distance) == edits:
        return walks_for(shorter, distance, recall)
    draw = np.random.default_rng([SEED, length, edits])
    spreads = sorted({length - edits, max(1, (length - edits) // 2), min(2 * edits, length - edits) or 1})
    both = [edited_pairs(length, edits, max(1, within), draw, CALIBRATION) for within in spreads]
    rows, changed = np.concatenate([r for r, _ in both]), np.concatenate([c for _, c in both])
    lengths, missed = np.full(len(rows), length), np.ones(len(rows), bool)
    walk, most = 0, CALIBRATION
    while most + 2 * math.sqrt(most) > (1 - recall) * CALIBRATION:  # two deviations of the count above it
        for part in parts_of(lengths):
            left = np.flatnonzero(missed[part]) + part.start  # those that have met need no more walks
            if len(left):
                missed[left] = keys_of(rows[left], lengths[left], walk) != keys_of(changed[left], lengths[left], walk)
        walk, most = walk + 1, int(missed.reshape(len(spreads), -1).sum(axis=1).max())
    _WALKS_OF[length, distance, recall] = walk
    return walk


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> tuple[int, int]:
    """(Least edits between a and any prefix of b, the shortest such prefix); edits beyond ``most`` may read larger."""
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        new = np.concatenate([[i], new])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))  # insertions
        if row.min() > most:
            return most + 1, 0
    best = int(row.argmin())
    return int(row[best]), best


class ItemIndex:
    """Keys of all items by length, the vocabulary of the items, and their words for the exact check."""

    def __init__(self, items: list[tuple[int, str]], distance: float, min_words: int, recall: float):
        self.items: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            codes = word_codes(text)
            if len(codes):
                self.items.append((item, codes))
        self.distance, self.min_words = distance, min_words
        by_length: dict[int, list[int]] = {}
        for i, (_, codes) in enumerate(self.items):
            by_length.setdefault(len(codes), []).append(i)
        self.lengths: dict[int, tuple[int, int]] = {}  # allowed edits and walks
        for n in sorted(by_length):
            edits = edits_allowed(n, distance) if n >= min_words else 0
            self.lengths[n] = edits, walks_for(n, distance, recall) if edits else 1
        sizes = np.array([len(codes) for _, codes in self.items], np.int64)
        walks = np.array([self.lengths[n][1] for n in sizes.tolist()], np.int64)
        parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(int(walks.max(initial=0)))]
        ascending = np.argsort(sizes, kind="stable")
        for part in parts_of(sizes[ascending]):
            members = ascending[part]
            rows = np.zeros((len(members), int(sizes[members].max())), np.uint64)
            for row, i in zip(rows, members.tolist(), strict=True):
                row[:sizes[i]] = self.items[i][1]
            for walk in range(int(walks[members].max())):
                live = np.flatnonzero(walks[members] > walk)
                parts[walk].append((keys_of(rows[live], sizes[members[live]], walk), members[live]))
        self.keys: list[tuple[np.ndarray, np.ndarray]] = []  # sorted keys of each walk, and their items
        for found in parts:
            keys, owner = np.concatenate([k for k, _ in found]), np.concatenate([o for _, o in found])
            order = np.argsort(keys, kind="stable")
            self.keys.append((keys[order], owner[order]))
        self.margin = 2 * max(self.lengths, default=0)
        # words that no item has count as padding, which equals no word of an item
        self.words = sorted({w for words in split_words(pa.array([t for _, t in items], pa.string())).to_pylist() for w in words if w})
        self.word_codes = np.array([word_code(w) for w in self.words] + [0], np.uint64)
        # pairs of neighbouring words, and for each length whether an item of that length has them
        own = {n: np.unique(np.concatenate([neighbours(self.items[i][1]) for i in members])) for n, members in by_length.items()}
        self.pairs = np.unique(np.concatenate([*own.values(), np.zeros(0, np.uint64)]))
        self.has_pair = {n: np.isin(self.pairs, pairs) for n, pairs in own.items()}

    def search(self, codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, start, words, edits) of every item found in documents laid out one after the other.

        ``first`` are their first positions, ``last`` those behind their last words. ``margin`` zeros stand behind each document, which pad its last windows
        as items are padded and keep windows from reaching into the next one.
        """
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        pairs = neighbours(codes)
        at = np.flatnonzero(pairs)
        place = np.minimum(np.searchsorted(self.pairs, pairs[at]), max(0, len(self.pairs) - 1))
        known = self.pairs[place] == pairs[at] if len(self.pairs) else np.zeros(len(at), bool)
        at, place = at[known], place[known]
        places, lengths = [], []
        for n, (edits, _) in self.lengths.items():
            # an edit takes two of an item's neighbour pairs, so a window within k edits has n - 1 - 2k of them
            need = n - 1 - 2 * edits
            if need < 1:
                starts = np.flatnonzero(codes)
            else:
                held = at[self.has_pair[n][place]]
                # windows that hold the need: from each pair that has so many within reach
                ends = held[need - 1:] if len(held) >= need else held[:0]
                fits = ends - held[:len(ends)] <= n - 2
                low, high = np.maximum(ends[fits] - (n - 2), 0), held[:len(ends)][fits]
                sizes = high - low + 1
                starts = np.unique(np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum())))
            documents = np.searchsorted(first, starts, "right") - 1
            starts = starts[starts < last[documents]]  # not in the zeros behind a document
            places.append(starts)
            lengths.append(np.full(len(starts), n))
        starts, lengths = np.concatenate(places), np.concatenate(lengths)
        for part in parts_of(lengths):  # lengths ascend
            self._walk(codes, first, starts[part], lengths[part], best)
        return [(d, item, start - int(first[d]), used, edited) for (d, item), (edited, start, used) in sorted(best.items())]

    def _walk(self, codes: np.ndarray, first: np.ndarray, starts: np.ndarray, lengths: np.ndarray, best: dict) -> None:
        """Look up the windows in every walk and keep the best exact match of each document and item."""
        rows = windows_of(codes, starts, lengths)
        walks = np.array([self.lengths[n][1] for n in lengths.tolist()])
        met = []
        for walk, (keys, owner) in enumerate(self.keys):
            live = np.flatnonzero(walks > walk)
            if not len(live):
                break
            own = keys_of(rows[live], lengths[live], walk)
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            hits = high - low
            entry = np.repeat(low - (np.cumsum(hits) - hits), hits) + np.arange(int(hits.sum()))
            met.append(np.stack([np.repeat(live, hits), owner[entry]], axis=1))
        found, times = np.unique(np.concatenate(met), axis=0, return_counts=True)
        documents = np.searchsorted(first, starts, "right") - 1
        equal = [bool((rows[w, :lengths[w]] == self.items[i][1]).all()) if lengths[w] == len(self.items[i][1]) else False for w, i in found.tolist()]
        # those that met most often first: the others are mostly left after a few words, being worse than the best
        for k in np.lexsort((-times, ~np.array(equal, bool))).tolist():
            w, i = found[k].tolist()
            start, document, (item, words) = int(starts[w]), int(documents[w]), self.items[i]
            edits = self.lengths[len(words)][0]
            so_far = best.get((document, item), (edits + 1, 0, 0))
            if so_far[0] == 0 and so_far[1] <= start:
                continue
            edited, used = (0, len(words)) if equal[k] else edit_distance(words, codes[start:start + len(words) + edits], min(edits, so_far[0]))
            if edited <= edits and (edited, start) < so_far[:2]:
                best[document, item] = edited, start, used


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, distance: float = DISTANCE, min_words: int = MIN_WORDS, recall: float = RECALL,
    id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", index_items: int = INDEX_ITEMS,
) -> DataFrame:
    """doc_id, item_id, start, words, edits: every item found in a document, at its best and then first place.

    Words are lower-cased runs of letters and digits; ``start`` and ``words`` count them. An item is found where
    the edit distance to a passage is at most ``distance`` times the item's words; items below ``min_words`` words
    must stand word by word. Items without a word and null texts match nothing. Repeated rows give repeated results
    per document row and one per item; a null doc_id stays null. Empty tables give no rows. Other columns are left
    out.

    The items go along with the tasks; they are bounded by passes of ``index_items`` over the documents, cut by a
    hash of the item. A window is walked only if it holds as many neighbouring word pairs of the items of its
    length as every match has, so most of a document is never walked.
    """
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("t")).where("item_id is not null and t is not null").distinct()
    passes = 1 if within(items, index_items) else -(-items.count() * 2 // index_items)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for p in range(passes):
        held = [(r["item_id"], r["t"]) for r in items.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(passes)) == p).orderBy("item_id", "t").collect()]
        index = ItemIndex(held, distance, min_words, recall)
        found = source.mapInArrow(_searcher(index), "doc_id long, item_id long, start int, words int, edits int")
        out = found if out is None else out.union(found)
    return out


def _searcher(index: ItemIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(index.words, pa.string())
        for batch in batches:
            for at, texts in slices(batch.column("text"), 2_000_000) if index.lengths else ():
                words = split_words(texts)
                # the place behind the last word is the padding's
                place = pc.fill_null(pc.index_in(words.flatten().cast(pa.string()), value_set=vocabulary), len(vocabulary))
                codes = index.word_codes[np.asarray(place)]
                offsets = np.asarray(words.offsets) - words.offsets[0].as_py()
                first = offsets[:-1] + np.arange(len(texts)) * index.margin
                flat = np.zeros(len(codes) + len(texts) * index.margin, np.uint64)
                flat[np.arange(len(codes)) + np.repeat(first - offsets[:-1], np.diff(offsets))] = codes
                hits = index.search(flat, first, first + np.diff(offsets))
                if hits:
                    document, *rest = zip(*hits, strict=True)
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([
                        batch.column("doc_id").slice(at, len(texts)).take(pa.array(document)), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True)),
                    ], ["doc_id", "item_id", "start", "words", "edits"])

    return run
