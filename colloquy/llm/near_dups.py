"""Near-duplicates by an inverted join over MinHash signature coordinates.

A document's set is its distinct word shingles. Documents of one set form a class with one representative. Each
representative is posted under its (coordinate, value) pairs. A pair of documents is a candidate from ``matches``
equal coordinates on; of K coordinates it then shares one of the K - matches + 1 rarest of either side (prefix),
so only these are posted, values of a single document count as posted without a row, and a document with fewer
than ``matches`` shared values is skipped. Candidates are confirmed on the full sets.

Posting lists are not expanded into pairs. In the first round every member of a list meets the list's leader, in
further rounds another leader per list, drawn by hash, if it is not yet in that leader's component. Only in lists
that still hold several components, members of different components are compared, in blocks of bounded size and by
longer signatures; what these leave open is decided on the full sets, so no link between components is lost.

At similarity 0.75, 64 coordinates and 32 matches, a pair misses the threshold of matches with a probability
below 1e-5; the rate falls quickly above that similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.runtime import materialize, small_side

WORDS = 5
PERCENT = 75
COORDINATES = 64
MATCHES = 32
BLOCK = 1024
FINE = 2048  # coordinates, two bits each, that tell apart members of different components; a multiple of 64
DRAWS = 2    # rounds in which lists that hold several components draw a leader


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; fewer words are one shingle, none are the empty set.

    Words are separated by ASCII white space; A-Z count as a-z.
    """
    from xxhash import xxh3_64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(each))
    out = np.zeros(len(each) - width + 1, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + each[i:len(each) - width + 1 + i]
    return np.unique(mixed(out + np.uint64(width)))


def signature(hashes: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Smallest value of each permutation, as a long whose lowest bits are the coordinate."""
    k = np.arange(coordinates, dtype=np.uint64)
    seeds, factors = mixed(k + np.uint64(1)), mixed(k + np.uint64(1001)) | np.uint64(1)
    least = np.full(coordinates, 2**64 - 1, np.uint64)
    step = max(64, 262_144 // coordinates)
    for at in range(0, len(hashes), step):
        np.minimum(least, ((hashes[at:at + step, None] ^ seeds) * factors).min(axis=0), out=least)
    low = np.uint64((1 << max(1, (coordinates - 1).bit_length())) - 1)
    return ((mixed(least + seeds) & ~low) | k).view(np.int64)


def signatures(docs: DataFrame, words: int = WORDS, coordinates: int = COORDINATES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature; the last two are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, digests, found = [], [], []
                for value in part.column("text").to_pylist():
                    hashes = shingle_set(value, words)
                    counts.append(len(hashes))
                    digests.append(xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                    found.append(signature(hashes, coordinates) if len(hashes) else None)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int64())),
                ], ["doc_id", "n_shingles", "digest", "signature"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature array<long>")


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """node, hashes for a table of node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, words).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "hashes"])

    return docs.select("node", "text").mapInArrow(run, "node long, hashes binary")


def posted_signatures(nodes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """node, tokens: signature values that some other node has as well, rarest first; at least ``matches`` of them."""
    tokens = nodes.select("node", F.explode("signature").alias("token"))
    shared = tokens.groupBy("token").count().where("count > 1")
    ranked = tokens.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("t"))
    return ranked.where(F.size("t") >= matches).select("node", F.transform("t", lambda x: x["token"]).alias("tokens"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose full sets meet 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    keep.append(False)
                    continue
                at = np.searchsorted(p, q)
                common = int((p[np.minimum(at, len(p) - 1)] == q).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _enough(pairs: DataFrame, posted: DataFrame, matches: int) -> DataFrame:
    """Pairs a, b with at least ``matches`` equal coordinates."""
    left, right = posted.toDF("a", "s"), posted.toDF("b", "t")
    return pairs.join(left, "a").join(right, "b").where(F.size(F.array_intersect("s", "t")) >= matches).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node in the links ``edges`` (a, b).

    Alternates the large-star and small-star steps, each an aggregate and a join, until links stop changing.
    """
    links = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        links = materialize(small.where("u <> v").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def fine_signatures(sets: DataFrame, coordinates: int) -> DataFrame:
    """node, n, fine: two bits for each of many more permutations of a node's set, as two bit planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("hashes")]
            fine = []
            for hashes in found:
                values = signature(hashes, coordinates)
                fine.append(b"".join(np.packbits((values >> bit) & 1 == 1).tobytes() for bit in (20, 21)))
            sizes = pa.array([len(h) for h in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node"), sizes, pa.array(fine, pa.binary())], ["node", "n", "fine"])

    return sets.mapInArrow(run, "node long, n long, fine binary")


def _cross_pairs(lists: DataFrame, percent: int, coordinates: int, block: int) -> DataFrame:
    """a, b of different components that their sizes and fine signatures leave open, within a posting list.

    Lists (token, node, component, n, fine, prefix) are cut into blocks of about ``block`` nodes; each pair of blocks
    is a group. A pair is given out in the first list that both are in. The fine signature excludes a pair 4.5
    standard deviations below what the threshold lets expect.
    """
    sizes = lists.groupBy("token").count().select("token", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    cut = lists.join(sizes, "token").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("token", "node", "component", "n", "fine", "prefix", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    rate = percent / 100 + (1 - percent / 100) / 4  # two bits are equal by chance in a quarter of the others
    most = coordinates * (1 - rate) + 4.5 * (coordinates * rate * (1 - rate)) ** 0.5

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        first, second = np.frombuffer(b"".join(rows["fine"]), np.uint64).reshape(len(rows), 2, -1).swapaxes(0, 1)
        node, group, own, n = (rows[c].to_numpy() for c in ("node", "component", "own", "n"))
        prefix = [set(x.tolist()) for x in rows["prefix"]]
        token, p, q = rows["token"].iloc[0], rows["p"].iloc[0], rows["q"].iloc[0]
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        out = []
        for i in left:
            others = right[(node[right] > node[i]) | (p != q)]
            others = others[(group[others] != group[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))]
            for at in range(0, len(others), 4096):
                part = others[at:at + 4096]
                differing = (first[part] ^ first[i]) | (second[part] ^ second[i])
                for j in part[np.bitwise_count(differing).sum(axis=1, dtype=np.int64) <= most]:
                    if min(prefix[i] & prefix[j]) == token:
                        out.append((min(node[i], node[j]), max(node[i], node[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return cut.groupBy("token", "p", "q").applyInPandas(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES,
    block: int = BLOCK, id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Links documents whose shingle sets meet 100 * intersection >= ``percent`` * union; component_id is the smallest
    doc_id reachable. A null or empty text has no shingles and no link. Rows of one doc_id are one document: all
    links of its texts count. A null doc_id is kept, with a null component and no link. An empty table gives no
    rows. Other columns are left out.
    """
    found = materialize(signatures(docs, words, coordinates, id_col, text))
    classes = found.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"))
    posted = materialize(posted_signatures(classes, coordinates, matches))
    own = found.where("doc_id is not null and digest is not null").select("doc_id", "digest")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text).alias("text"))
    sets = materialize(shingle_sets(texts.join(small_side(posted.select("node")), "node", "left_semi"), words))
    prefix = F.slice("tokens", F.lit(1), F.size("tokens") - F.lit(matches - 1))
    lists = materialize(posted.select("node", F.explode(prefix).alias("token")))

    # texts of one doc_id that differ are linked through it
    inside = own.join(classes.select("digest", "node"), "digest").where("doc_id <> node").select(F.col("doc_id").alias("b"), F.col("node").alias("a"))
    leaders = lists.groupBy("token").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("token", "a")
    first = lists.join(leaders, "token").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    edges = materialize(_confirmed(_enough(first, posted, matches), sets, percent))
    tree = materialize(components(edges))

    def mixed_lists() -> DataFrame:
        """Members of lists that hold several components."""
        labelled = lists.join(tree, "node", "left").select("token", "node", F.coalesce("component", "node").alias("component"))
        several = labelled.groupBy("token").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l <> h").select("token")
        return materialize(labelled.join(several, "token", "left_semi"))

    for draw in range(DRAWS):
        open_lists = mixed_lists()
        if open_lists.isEmpty():
            break
        drawn = open_lists.groupBy("token").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", "token", F.lit(draw))).alias("l"))
        met = open_lists.join(drawn, "token").where("component <> l.component").select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()
        edges = materialize(edges.union(_confirmed(_enough(met, posted, matches), sets, percent)))
        tree = materialize(components(edges))
    else:
        open_lists = mixed_lists()
        fine = fine_signatures(sets.join(open_lists.select("node").distinct(), "node", "left_semi"), FINE)
        known = materialize(posted.select("node", prefix.alias("prefix")).join(fine, "node"))
        third = _cross_pairs(open_lists.join(known, "node"), percent, FINE, block)
        more = materialize(_confirmed(third, sets, percent))
        if not more.isEmpty():
            edges = edges.union(more)
            tree = materialize(components(edges))

    # exact copies hang on their representative; it may hang on a component
    members = found.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "node"), "digest", "left")
    repeated = own.join(classes.select("digest", "node"), "digest").groupBy("doc_id").agg(F.min("node").alias("l"), F.max("node").alias("h")).where("l <> h")
    if not repeated.isEmpty():
        tree = materialize(components(edges.select("a", "b").union(inside.select("a", "b"))))
    placed = members.join(tree.toDF("node", "component"), "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return placed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
