"""Whitening of embeddings by eigenvectors found in single and corrected in higher precision.

Entries become whole numbers, so sums and centred products are exact and do not depend on how rows are dealt to tasks.
The covariance's eigenvectors are taken in float32 and corrected by the iteration of Ogita and Aishima: a few matrix
products in extended precision, each squaring the error. Eigenvalues that the current error cannot tell apart form a
cluster; the cluster's small shifted problem is solved by itself and turns its vectors, until the values part or agree
to the last digit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000   # x = floor(SCALE * c) + SHIFT
LARGEST = 2.0**40              # entries beyond it have no whole number that sums could hold
RANK = 1e-14                   # eigenvalues below this share of the trace count as zero
STEPS = 30                     # corrections at most; three to six are usual
WIDE = np.longdouble           # 64 bits of fraction on x86


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, vector as array of doubles, without null, empty, non-finite or too large entries (``LARGEST``)."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    # NaN is larger than any number in SQL, so one comparison leaves out NaN and infinities as well
    sound = F.forall("vector", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.coalesce(sound, F.lit(False)))


def whole(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """Rows of whole numbers of a batch of vectors of one length."""
    c = np.asarray(batch.column("vector").flatten(), np.float64).reshape(-1, dim)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def exact_products(y: np.ndarray) -> np.ndarray:
    """y'y as Python integers: float64 products of blocks whose sums stay below 2^53, larger numbers as they are."""
    most = int(np.abs(y).max(initial=0))
    if most >= 1 << 23:
        big = y.astype(object)
        return big.T @ big
    total, step = np.zeros((y.shape[1], y.shape[1]), object), (1 << 53) // max(1, most * most)
    for at in range(0, len(y), step):
        block = y[at:at + step].astype(np.float64)
        total = total + (block.T @ block).astype(np.int64).astype(object)
    return total


def _summed(rows: DataFrame, fn) -> dict[tuple[int, int], int]:
    """Sums by place over all tasks; ``fn`` gives a task's {(i, j): whole number}. Places are bounded by the dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = fn(batch)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            keep = i.ravel() <= j.ravel() if total.shape[0] == total.shape[1] else np.ones(total.size, bool)
            values = [Decimal(int(v)) for v, k in zip(total.ravel().tolist(), keep.tolist(), strict=True) if k]
            yield pa.RecordBatch.from_arrays([
                pa.array(i.ravel()[keep], pa.int32()), pa.array(j.ravel()[keep], pa.int32()), pa.array(values, pa.decimal128(38, 0)),
            ], ["i", "j", "v"])

    found = rows.mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r["i"], r["j"]): int(r["v"]) for r in found.collect()}


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``matrix`` takes centred vectors to components; all sizes are bounded by the dimension."""

    n: int
    sums: tuple[int, ...]         # of the whole numbers, by dimension
    values: np.ndarray            # eigenvalues of the covariance, falling
    vectors: np.ndarray           # unit eigenvectors, one a column
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        return (self.vectors / np.sqrt(self.values)).astype(np.float64)


def correct(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One Ogita-Aishima step on eigenvectors ``x`` of ``a``: (vectors, values, what a gap must exceed, largest change)."""
    product = a @ x
    gram, quotient = np.eye(len(a), dtype=WIDE) - x.T @ x, x.T @ product
    values = np.diag(quotient) / (1 - np.diag(gram))
    apart = 2 * (np.linalg.norm((quotient - np.diag(values)).astype(np.float64)) + np.linalg.norm(a.astype(np.float64)) * np.linalg.norm(gram.astype(np.float64)))
    apart = max(apart, len(a) * 1024 * float(np.finfo(WIDE).eps) * np.abs(values).max())  # closer ones are the sub-solves' part
    gap = values[None, :] - values[:, None]
    told = np.abs(gap) > apart
    e = np.where(told, (quotient + values[None, :] * gram) / np.where(told, gap, 1), gram / 2)
    return x + x @ e, values, float(apart), float(np.abs(e).max(initial=0))


def clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Groups of several eigenvalues, each within ``apart`` of the next."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > apart) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of a symmetric matrix, from float32 by correction."""
    a = a.astype(WIDE)
    size = np.abs(a).max(initial=0)
    if size == 0:
        return np.zeros(len(a), WIDE), np.eye(len(a), dtype=WIDE)
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    least = 8 * len(a) * float(np.finfo(WIDE).eps)
    for _ in range(STEPS):
        x, values, apart, change = correct(a, x)
        for group in clusters(values, apart):
            part = x[:, group]
            middle = values[group].mean()
            inner = part.T @ (a @ part - middle * part)  # the shift leaves the cluster's own differences
            inner = (inner + inner.T) / 2
            scale = np.abs(inner).max()
            if scale > 0:
                turn = np.linalg.eigh((inner / scale).astype(np.float64))[1]
                x[:, group] = part @ turn.astype(WIDE)
                off = np.abs(inner / scale - np.diag(np.diag(inner / scale))).max() * scale
                change = max(change, float(off) if off > least else 0.0)
        if change <= least:
            break
    for _ in range(2):  # steps that leave directions as they are
        x = x + x @ ((np.eye(len(a), dtype=WIDE) - x.T @ x) / 2)
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order] * size, x[:, order]


def fit(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Whitening of all usable vectors; None if there is none.

    Vectors of another length than the most frequent (then longest) take no part. Eigenvalues that are zero (``RANK``)
    have no component, so there may be fewer than asked.
    """
    rows = usable(vectors, id_col, vector)
    most = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return None
    dim, n = most["d"], most["count"]
    rows = rows.where(F.size("vector") == dim).select("vector")
    found = _summed(rows, lambda batch: whole(batch, dim).sum(axis=0, dtype=np.int64).astype(object)[None, :])
    sums = [found[0, j] for j in range(dim)]
    # centred on the nearest whole mean before multiplying; what remains of the mean, half a unit at most, is exact
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    found = _summed(rows, lambda batch: exact_products(whole(batch, dim) - centre))
    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    covariance = np.empty((dim, dim), WIDE)
    for (i, j), v in found.items():
        covariance[i, j] = covariance[j, i] = WIDE(n * v - rest[i] * rest[j]) / WIDE(n * n)
    values, x = eigenvectors(covariance)
    trace = sum(n * found[i, i] - rest[i] ** 2 for i in range(dim)) / (n * n)
    keep = min(components, int((values > RANK * trace).sum()))
    x = x[:, :keep]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(keep)] < 0, -1, 1)
    return Whitening(n, tuple(sums), values[:keep], x, float(trace))


def apply(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, deviation, whitened: one row per usable vector of the model's length.

    deviation is the sum over dimensions of (n x - S)^2, exact, and null where a long cannot hold it; whitened holds
    the components of x - S / n. Repeated rows give repeated results, a null id stays null, an empty table gives none.
    """
    dim, n, matrix = len(model.sums), model.n, model.matrix
    centre = np.array([(2 * s + n) // (2 * n) for s in model.sums], np.int64)
    rest = np.array([s - n * int(c) for s, c in zip(model.sums, centre, strict=True)], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = whole(batch, dim) - centre
            most = n * int(np.abs(y).max(initial=0)) + int(np.abs(rest).max())
            if dim * most * most < 1 << 62:
                d = n * y - rest.astype(np.int64)
                deviation = (d * d).sum(axis=1).tolist()
            else:
                d = n * y.astype(object) - rest
                deviation = [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]
            out = (d.astype(np.float64) / n) @ matrix
            offsets = pa.array(np.arange(len(out) + 1) * matrix.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), pa.float64())),
            ], ["id", "deviation", "whitened"])

    rows = usable(vectors, id_col, vector).where(F.size("vector") == dim)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def identity_error(applied: DataFrame, n: int, components: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((components + 1, components))
        for batch in batches:
            w = np.asarray(batch.column("whitened").flatten(), np.float64).reshape(-1, components)
            total += np.concatenate([w.sum(axis=0)[None, :], w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

    # one row for each place, whatever the number of tasks
    parts = applied.select("whitened").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("p", "v"))
    total = np.zeros((components + 1) * components)
    for r in parts.groupBy("p").agg(F.sum("v").alias("v")).collect():
        total[r["p"]] = r["v"]
    total = total.reshape(components + 1, components) / n
    covariance = total[1:] - np.outer(total[0], total[0])
    return float(np.abs(covariance - np.eye(components)).max(initial=0))
