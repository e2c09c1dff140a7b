"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes come from several rotations learned on a bounded sample (iterative quantization: the rotation that brings the
centred vectors closest to the corners of a cube). A code is split into substrings of 16 bits, each indexed. A code
within a Hamming radius r of another is within r // m in one of m substrings (pigeonhole), so a query probes the
values at that distance in each table; codes that are met are kept within the radius and ranked by the inner product
of the original vectors. The radius is learned on the sample for a target recall.

Rows are dealt into blocks of bounded size and so are the queries; each pair of blocks builds its tables, probes
them and gives out k rows for each query, which a window narrows to k.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 8000        # vectors that rotations and radius are learned on: those of the smallest hashes
ROTATIONS = 4        # codes have so many bits for each dimension
ITERATIONS = 30
SUBSTRING = 16
TARGET = 0.99        # share of the sample's nearest that the radius reaches
BLOCK_ROWS = 20_000
BLOCK_QUERIES = 2_000


@dataclass
class Codes:
    """Centre and rotations of the codes, and the Hamming radius of a search."""

    mean: np.ndarray
    rotations: np.ndarray  # bits x dimensions
    radius: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Substring values, one column for each table."""
        bits = (vectors - self.mean) @ self.rotations.T > 0
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % SUBSTRING)))
        return np.packbits(bits, axis=1, bitorder="little").view("<u2")


def learn(sample: np.ndarray, k: int, rotations: int = ROTATIONS, target: float = TARGET, seed: int = 1) -> Codes:
    """Iterative quantization from several starts, then the radius that reaches the sample's own k nearest."""
    draw = np.random.default_rng(seed)
    mean, d = sample.mean(axis=0), sample.shape[1]
    centred, parts = sample - mean, []
    for _ in range(rotations):
        turn = np.linalg.qr(draw.normal(size=(d, d)))[0]
        for _ in range(ITERATIONS):
            u, _, v = np.linalg.svd(np.where(centred @ turn > 0, 1.0, -1.0).T @ centred)
            turn = (u @ v).T
        parts.append(turn.T)
    codes = Codes(mean, np.concatenate(parts), 0)
    own = codes.of(sample)
    asked = np.arange(min(len(sample), 300))
    scores = sample[asked] @ sample.T
    scores[asked, asked] = -np.inf
    k = min(k, len(sample) - 1)
    if k > 0:
        near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        apart = np.bitwise_count(own[asked][:, None, :] ^ own[near]).sum(axis=2)
        codes.radius = int(np.quantile(apart, target))
    return codes


class Tables:
    """The substring tables of one block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.asfortranarray(np.argsort(codes, axis=0, kind="stable"))
        values = np.take_along_axis(codes, self.order, axis=0)
        self.tables = []
        for t in range(codes.shape[1]):
            distinct, first = np.unique(values[:, t], return_index=True)
            self.tables.append((distinct, np.append(first, len(values))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of every code within the radius: pigeonhole probes of each table, then the whole distance.

        With r = q m + s, a code within r is within q in one of s + 1 tables or within q - 1 in one of the others.
        The values at a distance are those of the table that are so near, which is a probe of every one present.
        """
        m = len(self.tables)
        q, s = divmod(radius, m)
        seen = np.zeros(len(self.codes), bool)
        for t, (distinct, first) in enumerate(self.tables):
            reach = q if t <= s else q - 1
            hit = np.flatnonzero(np.bitwise_count(distinct ^ code[t]) <= reach) if reach >= 0 else np.zeros(0, np.int64)
            if len(hit):
                sizes = first[hit + 1] - first[hit]
                seen[self.order[np.repeat(first[hit] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum())), t]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part: an id, no null or non-finite component, not all zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine & F.exists("v", lambda x: x != 0))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE,
    block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k nearest found by inner product, itself (its id) left out.

    Ties go to the smaller id; repeated rows count once. All candidates are returned if there are fewer than k. Rows
    that are null, zero or hold null or non-finite components take no part on either side, nor do vectors of another
    length than the most frequent one (of equally frequent ones the longer). Empty tables give no rows. Where fewer than k
    codes lie within the radius in a block, that block is searched with ever wider radii. Memory is bounded by a pair of blocks.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows, asked = usable(vectors, id_col, vector), usable(queries, id_col, vector)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], out)
    dims, total = sizes
    rows, asked = rows.where(F.size("v") == dims), asked.where(F.size("v") == dims)
    learned = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()])
    codes = learn(np.unique(learned, axis=0), k)
    blocks, parts = math.ceil(total / block_rows), math.ceil(max(1, asked.count()) / block_queries)
    side = F.array(*[F.lit(i) for i in range(parts)])
    every = rows.select("vec_id", "v", F.lit(False).alias("asks"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(side).alias("part"))
    probes = asked.select("vec_id", "v", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int").alias("part"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["vec_id", "asks"])
        mine = group[~group["asks"]].sort_values("vec_id")
        wanted = group[group["asks"]]
        if not len(mine) or not len(wanted):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        ids, points = mine["vec_id"].to_numpy(), np.stack(mine["v"])
        tables = Tables(codes.of(points))
        found = []
        targets = np.stack(wanted["v"])
        for name, target, code in zip(wanted["vec_id"].to_numpy(), targets, codes.of(targets), strict=True):
            radius, most = codes.radius, len(codes.rotations)
            while True:
                near = tables.within(code, radius)
                near = near[ids[near] != name]
                if len(near) >= min(k, len(ids) - 1) or radius >= most:
                    break
                radius += max(4, radius // 8)
            scores = points[near] @ target
            best = np.lexsort((ids[near], -scores))[:k]
            found.append(pd.DataFrame({"query_id": name, "vec_id": ids[near][best], "score": scores[best]}))
        return pd.concat(found, ignore_index=True)

    met = every.union(probes).groupBy("block", "part").applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> float:
    """Share of the exact k nearest of ``queries`` (a few rows, held by each task) that ``found`` has."""
    asked = [(r["vec_id"], r["v"]) for r in usable(queries, id_col, vector).collect()]
    names, targets = np.array([a for a, _ in asked]), np.array([v for _, v in asked])

    def scan(batches):
        for rows in batches:
            points, ids = np.stack(rows["v"]), rows["vec_id"].to_numpy()
            scores = targets @ points.T
            for i, name in enumerate(names):
                others = np.flatnonzero(ids != name)
                best = others[np.argsort(-scores[i, others], kind="stable")[:k]]
                yield pd.DataFrame({"query_id": name, "vec_id": ids[best], "score": scores[i, best]})

    every = usable(vectors, id_col, vector).mapInPandas(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    exact = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    met = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("met")), ["query_id", "vec_id"], "left")
    return met.agg(F.avg(F.coalesce("met", F.lit(0)))).first()[0]
