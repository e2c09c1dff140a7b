"""Exact n-gram Jaccard join by partitions of the token universe and the pigeonhole principle.

Sets of like size form a band. For each band the universe of shingles is hashed into one segment more than two linked
sets can differ in shingles, so two linked sets are equal in at least one segment. Every set is indexed under the
subsets of its own band's segments and, as the larger one of a pair, of those of the band below.

A popular subset costs as many candidates as sets have it. A set may give such a segment up if it raises another one
that no other set shares to *one deletion*: then both sets' subsets without one shingle are indexed as well, which finds
every set that differs by one shingle there. The sum of (allowance + 1) over segments stays above the largest
difference, so the pigeonhole holds. Bands in which that saves more than it makes index rows do it. Subsets of no or one
shingle are popular by chance, more so the more sets there are. Larger ones are a passage that was copied: their sets
stay in as many lists under the deletions of what they share, so giving them up saves comparisons, but no rows.

Lists of sets under one subset are not expanded into pairs: members meet a leader, later another one, and only where a
list still holds several components, members of different components are compared in blocks, by parity bitmaps whose
Hamming distance bounds the sets' difference from below. What is left is verified on the full sets. Nothing is
estimated; all links count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.near_dups import _confirmed, components, mixed
from colloquy.llm.token_ids import slices
from colloquy.runtime import materialize, small_side

WORDS = 3
PERCENT = 90
BLOCK = 1024          # members of a list that are compared at a time
DRAWS = 2             # rounds with drawn leaders before members of different components are compared
CLOSEST = 4           # candidates of a member in another component given out at first
COPIED = 32           # candidates that share a passage and cost as much as an index row
SLICE_BYTES = 1_500_000
LARGEST = 1 << 31     # of a set
SIZE_BITS = 3         # of a key: the subset's size, cut at 7

SEGMENT, SUBSET = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


class Bands:
    """Sizes by band: a set links only with sets of its band and of the two beside it."""

    def __init__(self, percent: int):
        lows = [1]
        while lows[-1] <= LARGEST:
            lows.append(lows[-1] * 100 // percent + 1)
        self.percent = percent
        self.lows = np.array(lows, np.int64)
        self.highs = np.append(self.lows[1:] - 1, 1 << 62)
        largest = self.highs[:-1] * 100 // percent  # partner of a band's largest set
        differ = (100 - percent) * (self.highs[:-1] + largest) // (100 + percent)
        # sets that may not differ at all are linked only if they are equal, which classes tell
        self.segments = np.append(np.where(differ > 0, differ + 1, 0), 0)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, "right") - 1

    def below(self, sizes: np.ndarray) -> np.ndarray:
        """The band below, or -1 where none of its sets is large enough to be linked."""
        band = self.of(sizes) - 1
        return np.where((band >= 0) & (sizes * self.percent <= 100 * self.highs[np.maximum(band, 0)]), band, -1)


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts one after the other, first of each text and the end).

    Words are separated by ASCII white space; A-Z count as a-z. Fewer words than ``words`` are one shingle, none are
    the empty set.
    """
    from xxhash import xxh3_64_intdigest

    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    found = coded.dictionary.to_pylist()
    hashed = np.fromiter((xxh3_64_intdigest(w.encode()) for w in found), np.uint64, len(found))
    real = np.fromiter((bool(w) for w in found), bool, len(found))
    at = np.asarray(coded.indices)
    keep = real[at] if len(found) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    offsets = before[np.asarray(split.offsets) - split.offsets[0].as_py()]
    each, counts = (hashed[at] if len(found) else np.zeros(0, np.uint64))[keep], np.diff(offsets)
    width = np.minimum(words, counts)
    sizes = np.where(counts > 0, counts - width + 1, 0)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = offsets[:-1][owner] + np.arange(len(owner)) - starts[owner]
    out = np.zeros(len(owner), np.uint64)
    for i in range(words):
        inside = width[owner] > i
        out[inside] = out[inside] * np.uint64(0x9E3779B97F4A7C15) + each[first[inside] + i]
    out = mixed(out + width[owner].astype(np.uint64))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[starts]


def _finished(sums: np.ndarray, sizes: np.ndarray, band: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Index keys of subsets from the sums of their shingles' codes."""
    key = mixed(sums ^ mixed((band.astype(np.uint64) << np.uint64(34)) + segment.astype(np.uint64)))
    low = np.uint64((1 << SIZE_BITS) - 1)
    return ((key & ~low) | np.minimum(sizes, low).astype(np.uint64)).view(np.int64)


def partitioned(tokens: np.ndarray, offsets: np.ndarray, band: np.ndarray, bands: Bands):
    """(first segment of each set and the end, keys of all segments, segment place and code of each token, sums, sizes).

    ``band`` is the band whose segments a set is cut by; -1 gives none.
    """
    m = np.where(band >= 0, bands.segments[band], 0)
    first = np.concatenate([[0], np.cumsum(m)])
    owner = np.repeat(np.arange(len(m)), np.diff(offsets))
    share = mixed(tokens ^ SEGMENT) >> np.uint64(32)
    place = first[:-1][owner] + ((share * m[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    code = mixed(tokens + SUBSET)
    cut = m[owner] > 0
    sums, sizes = np.zeros(first[-1], np.uint64), np.zeros(first[-1], np.int64)
    np.add.at(sums, place[cut], code[cut])
    np.add.at(sizes, place[cut], 1)
    of = np.repeat(np.arange(len(m)), m)
    segment = np.arange(first[-1]) - first[:-1][of]
    return first, _finished(sums, sizes, band[of], segment), np.where(cut, place, -1), code, sums, sizes


def profiles(docs: DataFrame, words: int, percent: int, id_col: str, text: str) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band, keys in the own band (own) and in the one below (low)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        bands = Bands(percent)
        for batch in batches:
            for at, texts in slices(batch.column("text"), SLICE_BYTES):
                tokens, offsets = shingles(texts, words)
                sizes = np.diff(offsets)
                digests = [xxh3_128_digest(tokens[a:b].tobytes()) if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                band = np.where(sizes > 0, bands.of(sizes), -1)
                lists = []
                for own in (band, np.where(sizes > 0, bands.below(sizes), -1)):
                    first, keys, *_ = partitioned(tokens, offsets, own, bands)
                    lists.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(keys, pa.int64())))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, len(texts)), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(band, pa.int32()), *lists,
                ], ["doc_id", "n_shingles", "digest", "band", "own", "low"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, digest binary, band int, own array<long>, low array<long>")


def bitmap(tokens: np.ndarray, percent: int) -> bytes:
    """Parity of the number of shingles at each bit; at least 512 bits, and eight to each allowed difference."""
    bits = 512
    while bits < 8 * 2 * len(tokens) * (100 - percent) // (100 + percent):
        bits *= 2
    counts = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1 == 1).tobytes()


def full_sets(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """node, n, hashes, bits for a table of node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column("text"), SLICE_BYTES):
                tokens, offsets = shingles(part, words)
                sets = [tokens[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("node").slice(at, len(part)), pa.array(np.diff(offsets), pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([bitmap(s, percent) for s in sets], pa.binary()),
                ], ["node", "n", "hashes", "bits"])

    return texts.select("node", "text").mapInArrow(run, "node long, n long, hashes binary, bits binary")


def deletions(texts: DataFrame, raised: dict[int, list[int]], words: int, percent: int) -> DataFrame:
    """node, key, strong: subsets without one shingle in the ``raised`` segments of each band.

    ``texts`` (node, text, up_own, up_low) has the segments that the set itself raised, which makes its rows strong.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            for at, part in slices(batch.column("text"), SLICE_BYTES):
                tokens, offsets = shingles(part, words)
                sizes = np.diff(offsets)
                nodes = np.asarray(batch.column("node").slice(at, len(part)))
                for column, band in (("up_own", bands.of(sizes)), ("up_low", bands.below(sizes))):
                    first, _, place, code, sums, held = partitioned(tokens, offsets, band, bands)
                    ups = [set(x or ()) for x in batch.column(column).slice(at, len(part)).to_pylist()]
                    out = [], [], []
                    for i, b in enumerate(band.tolist()):
                        wanted = raised.get(b)
                        if not wanted:
                            continue
                        own = slice(int(offsets[i]), int(offsets[i + 1]))
                        segment = place[own] - first[i]
                        hit = np.flatnonzero(np.isin(segment, wanted))
                        keys = _finished(sums[place[own][hit]] - code[own][hit], held[place[own][hit]] - 1, np.full(len(hit), b), segment[hit])
                        out[0].extend([nodes[i]] * len(hit))
                        out[1].extend(keys.tolist())
                        out[2].extend(s in ups[i] for s in segment[hit].tolist())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["node", "key", "strong"])

    return texts.select("node", "text", "up_own", "up_low").mapInArrow(run, "node long, key long, strong boolean")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows node, key, strong of keys of several nodes, at least one of them strong."""
    several = rows.groupBy("key").agg(F.min("node").alias("l"), F.max("node").alias("h"), F.max("strong").alias("s"))
    return rows.join(several.where("l <> h and s").select("key"), "key", "left_semi")


def allocate(posted: DataFrame, classes: DataFrame) -> tuple[DataFrame | None, dict[int, list[int]]]:
    """(node, side, dropped segments, raised segments) where that pays, and all raised segments by band.

    The price of a raise is its look-ups: the segment's subset, and one for each of its shingles. A candidate counts as
    much as one of them, and where the subset is a passage, one in ``COPIED``. Free segments, shared by no other set, are raised from the lowest number up, so that the sets of a band raise few different ones.
    """
    average = F.col("n") / F.col("m")
    popular = posted.where(F.col("count") > 2 + 2 * average).select("node", "side").distinct()
    if popular.isEmpty():
        return None, {}
    per_set = posted.join(popular, ["node", "side"], "left_semi").groupBy("node", "side").agg(
        F.sort_array(F.collect_list(F.struct("count", "segment", "key")), asc=False).alias("s"), F.first("n").alias("n"), F.first("m").alias("m"))
    # a doc_id with several texts keeps all its rows strong
    several = classes.groupBy("node").count().where("count > 1").select("node")
    per_set = per_set.join(small_side(several), "node", "left_anti")
    keys = F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("low"))
    both = per_set.join(classes.select("node", "band", "own", "low"), "node").withColumn("keys", keys).withColumn("list_band", F.col("band") - F.col("side"))
    unshared = F.array_except(F.sequence(F.lit(0), F.col("m") - 1), F.col("s.segment"))
    # a subset of one shingle would meet all sets that have none there
    free = F.filter(unshared, lambda i: F.pmod(F.get("keys", i), F.lit(1 << SIZE_BITS)) >= 2)
    dear = F.filter("s", lambda x: x["count"] > 2 + 2 * average)
    t = F.least(F.size("free"), F.size("dear"))
    plan = both.withColumn("free", free).withColumn("dear", dear).withColumn("t", t).where("t > 0").select(
        "node", "side", "list_band", F.slice("dear", F.lit(1), F.col("t")).alias("d"), F.slice("free", F.lit(1), F.col("t")).alias("raised"),
        (F.col("n") / F.col("m")).alias("per"))
    worth = lambda x: F.when(F.pmod(x["key"], F.lit(1 << SIZE_BITS)) < 2, x["count"]).otherwise(x["count"] / COPIED)
    plan = materialize(plan.select("*", F.col("d.segment").alias("dropped"), F.aggregate("d", F.lit(0.0), lambda a, x: a + worth(x)).alias("saved")).drop("d"))
    # tables with a row for each band
    saved = plan.groupBy("list_band").agg(F.sum("saved").alias("saved"), F.array_distinct(F.flatten(F.collect_set("raised"))).alias("raised"), F.max("per").alias("per"))
    sets = {}
    for r in classes.groupBy("band").count().collect():
        for b in (r["band"], r["band"] - 1):
            sets[b] = sets.get(b, 0) + r["count"]
    raised = {}
    for r in saved.collect():
        if r["saved"] > sets.get(r["list_band"], 0) * len(r["raised"]) * (1 + r["per"]):
            raised[r["list_band"]] = sorted(r["raised"])
    return plan.where(F.col("list_band").isin(list(raised))), raised


def folded(bitmaps: list[bytes]) -> np.ndarray:
    """Parity bitmaps as rows at the smallest width among them: the halves of one add up to the next smaller one."""
    width, out = min(map(len, bitmaps)) // 8, []
    for raw in bitmaps:
        x = np.frombuffer(raw, np.uint64)
        while len(x) > width:
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
        out.append(x)
    return np.stack(out)


def near_members(node, group, strong, n, bits, left, right, same: bool, percent: int, closest: int) -> list[tuple[int, int, bool]]:
    """(a, b, more) for members of different components, of ``left`` and ``right``, that sizes and bitmaps leave open."""
    maps, out = folded(bits), []
    for i in left:
        others = right[node[right] > node[i]] if same else right
        others = others[(group[others] != group[i]) & (strong[others] | strong[i])]
        others = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
        if not len(others):
            continue
        apart = np.bitwise_count(maps[others] ^ maps[i]).sum(axis=1, dtype=np.int64)
        near = apart * (100 + percent) <= (100 - percent) * (n[others] + n[i])
        if not near.any():
            continue
        others, apart = others[near], apart[near]
        others = others[np.lexsort((apart, group[others]))]
        new = np.flatnonzero(np.concatenate([[True], group[others][1:] != group[others][:-1]])).tolist()
        for a, b in zip(new, [*new[1:], len(others)], strict=True):
            out.extend((int(min(node[i], node[j])), int(max(node[i], node[j])), b - a > closest) for j in others[a:min(b, a + closest)])
    return out


def _cross_pairs(lists: DataFrame, bits: DataFrame, percent: int, block: int, closest: int) -> DataFrame:
    """a, b, more: pairs of members of different components of a list that sizes and bitmaps leave open.

    Of a member's candidates in one other component, the ``closest`` are given; ``more`` tells that others are left.
    Lists (key, node, component, strong, n) of the same members count once. They are cut into blocks of about ``block``
    members; each pair of blocks is a group, and groups stream through the tasks, so no pair is a row before it has
    been compared. ``bits`` has the bitmap of each node.
    """
    members = [F.bit_xor(F.xxhash64("node", "strong")), F.bit_xor(F.xxhash64("strong", "node")), F.min("node"), F.max("node"), F.count("*")]
    told = lists.groupBy("key").agg(*[m.alias(f"m{i}") for i, m in enumerate(members)])
    single = told.groupBy("m0", "m1", "m2", "m3", "m4").agg(F.min("key").alias("key"))
    single = single.select("key", F.ceil(F.col("m4") / block).cast("int").alias("blocks"))
    cut = lists.join(single, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(bits, "node")
    place = ["key", "p", "q"]
    cut = cut.select("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "node", "component", "strong", "n", "bits")

    def compared(rows: pa.Table, cuts: list[int]) -> pa.RecordBatch:
        column = {c: rows.column(c).to_numpy() for c in ("p", "q", "mine", "node", "component", "strong", "n")}
        maps, out = rows.column("bits").to_pylist(), []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = {c: v[a:b] for c, v in column.items()}
            p, q = own["p"][0], own["q"][0]
            out += near_members(own["node"], own["component"], own["strong"], own["n"], maps[a:b], np.flatnonzero(own["mine"] == p),
                                np.flatnonzero(own["mine"] == q), p == q, percent, closest)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last group, which may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            if not rows.num_rows:
                continue
            marks = np.stack([rows.column(c).to_numpy() for c in place])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist()]
            yield compared(rows, cuts)
            rest = rows.slice(cuts[-1])
        if rest is not None:
            yield compared(rest, [0, rest.num_rows])

    return cut.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "a long, b long, more boolean")


def join_links(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK, id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``.

    Links documents whose shingle sets meet 100 * intersection >= ``percent`` * union; component_id is the smallest
    doc_id reachable. A null or empty text has no shingles and no link. Rows of one doc_id are one document: all
    links of its texts count. A null doc_id has a null component and no link. An empty table gives no rows. Texts of
    any length are taken whole. Other columns are left out.
    """
    found = materialize(profiles(docs, words, percent, id_col, text))
    own = found.where("doc_id is not null and digest is not null")
    classes = materialize(own.groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first(F.struct("n_shingles", "band", "own", "low")).alias("s")).select("digest", "node", F.col("s.n_shingles").alias("n"), "s.band", "s.own", "s.low"))

    def listed(column: str, side: int):
        return F.transform(column, lambda x, i: F.struct(x.alias("key"), F.lit(side).alias("side"), i.alias("segment"), F.size(column).alias("m")))

    # a node with several texts of one doc_id has the keys of all of them
    tokens = classes.select("node", "n", "band", F.explode(F.concat(listed("own", 0), listed("low", 1))).alias("t")).select("node", "n", "band", "t.*")
    counts = tokens.groupBy("key").count().where("count > 1")
    posted = materialize(tokens.join(counts, "key"))
    plan, raised = allocate(posted, classes)
    lists = posted.select("node", "key", F.lit(True).alias("strong"))
    if raised:
        lists = _reallocated(docs, classes, tokens, posted, plan, raised, words, percent, id_col, text)
    lists = materialize(_shared(lists.groupBy("node", "key").agg(F.max("strong").alias("strong"))))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text).alias("text"))
    sets = materialize(full_sets(texts.join(small_side(lists.select("node").distinct()), "node", "left_semi"), words, percent))
    edges, tree = linked(lists, sets, percent, block)
    return labelled(found, classes, edges, tree)


def _reallocated(docs, classes, tokens, posted, plan, raised, words, percent, id_col, text) -> DataFrame:
    """node, key, strong after allocation: dropped rows are weak; raised segments also have their deletions."""
    side_band = F.col("band") - F.col("side")
    ups = plan.groupBy("node").agg(
        F.first(F.when(F.col("side") == 0, F.col("raised")), ignorenulls=True).alias("up_own"),
        F.first(F.when(F.col("side") == 1, F.col("raised")), ignorenulls=True).alias("up_low"))
    members = classes.where(F.col("band").isin([b for r in raised for b in (r, r + 1)])).select("node").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text).alias("text")).join(small_side(members), "node", "left_semi").join(small_side(ups), "node", "left")
    cut = deletions(texts, raised, words, percent)
    dropped = plan.select("node", "side", F.explode("dropped").alias("segment"), F.lit(True).alias("gone"))
    rows = posted.join(small_side(dropped), ["node", "side", "segment"], "left").select("node", "key", F.col("gone").isNull().alias("strong"))
    spots = [(b, s) for b, segments in raised.items() for s in segments]
    spots = F.broadcast(plan.sparkSession.createDataFrame(spots, "list_band int, segment int"))  # as many as segments in all bands, at most
    inside = tokens.withColumn("list_band", side_band).join(spots, ["list_band", "segment"], "left_semi")
    up = plan.select("node", "side", F.explode("raised").alias("segment"), F.lit(True).alias("up"))
    inside = inside.join(small_side(up), ["node", "side", "segment"], "left").select("node", "key", F.coalesce("up", F.lit(False)).alias("strong"))
    return rows.unionByName(inside).unionByName(cut)


def linked(lists: DataFrame, sets: DataFrame, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(links a, b that span every component; node, component of the linked nodes) from lists node, key, strong."""
    whole = sets.select("node", "hashes")
    leaders = lists.groupBy("key").agg(F.min(F.when(F.col("strong"), F.col("node"))).alias("l"))
    met = lists.join(leaders, "key").where("node <> l").select(F.least("node", "l").alias("a"), F.greatest("node", "l").alias("b")).distinct()
    edges = materialize(_confirmed(met, whole, percent))
    tree = materialize(components(edges))

    def open_lists() -> DataFrame:
        """Members of lists that hold several components, one of them with a strong member."""
        placed = lists.join(tree, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = placed.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h"), F.max("strong").alias("s")).where("l <> h and s").select("key")
        return materialize(placed.join(several, "key", "left_semi"))

    tested = met
    for draw in range(DRAWS):
        left = open_lists()
        if left.isEmpty():
            return edges, tree
        drawn = left.where("strong").groupBy("key").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", "key", F.lit(draw))).alias("l"))
        met = left.join(drawn, "key").where("component <> l.component").select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()
        met = materialize(met.join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(met)
        edges = materialize(edges.union(_confirmed(met, whole, percent)))
        tree = materialize(components(edges))
    closest, sizes, bits = CLOSEST, sets.select("node", "n"), sets.select("node", "bits")
    while True:
        left = open_lists()
        if left.isEmpty():
            return edges, tree
        pairs = materialize(_cross_pairs(left.join(sizes, "node"), bits, percent, block, closest))
        more = materialize(_confirmed(pairs.select("a", "b").distinct(), whole, percent))
        if not more.isEmpty():
            edges = materialize(edges.union(more))
            tree = materialize(components(edges))
        if pairs.where("more").isEmpty():
            return edges, tree
        closest *= 8


def labelled(found: DataFrame, classes: DataFrame, edges: DataFrame, tree: DataFrame) -> DataFrame:
    """The component of every document: copies hang on their representative, it may hang on a component."""
    nodes = classes.select("digest", "node")
    members = found.select("doc_id", "n_shingles", "digest").join(nodes, "digest", "left")
    several = members.where("doc_id is not null and node is not null").groupBy("doc_id").agg(F.min("node").alias("l"), F.max("node").alias("h")).where("l <> h")
    if not several.isEmpty():  # texts of one doc_id that differ are linked through it
        inside = members.where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
        tree = materialize(components(edges.select("a", "b").union(inside)))
    placed = members.join(tree.toDF("node", "component"), "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"))
