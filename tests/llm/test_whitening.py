"""Whitening against numpy on exact numbers, and the correction of eigenvectors on hard spectra."""

import math
from fractions import Fraction

import numpy as np
import pytest

from colloquy.llm import queries
from colloquy.llm.whitening import WIDE, apply, eigenvectors, exact_products, fit, identity_error


def brute(rows):
    """(kept ids, deviations, covariance) from plain integers."""
    kept = [(k, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, dim = len(kept), len(kept[0][1])
    sums = [sum(x[j] for _, x in kept) for j in range(dim)]
    away = [[n * x[j] - sums[j] for j in range(dim)] for _, x in kept]
    covariance = [[float(Fraction(sum(a[i] * a[j] for a in away), n**3)) for j in range(dim)] for i in range(dim)]
    return [k for k, _ in kept], [sum(a * a for a in row) for row in away], np.array(covariance), np.array(away, float) / n


def test_query_equals_numpy(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, deviations, covariance, centred = brute(rows)
    values, x = np.linalg.eigh(covariance)
    values, x = values[::-1], x[:, ::-1]
    found = queries.QUERIES["op12_whitening"](spark, sf).collect()
    assert len(found) == 32 * len(ids) and {r["n"] for r in found} == {len(ids)}
    by_id = {k: (d, row) for k, d, row in zip(ids, deviations, centred, strict=True)}
    signs = {}
    for r in found:
        d, row = by_id[r["vec_id"]]
        j = r["component"] - 1
        assert r["deviation"] == d and abs(r["explained"] - values[j] / np.trace(covariance)) <= 1e-9
        want = row @ x[:, j] / np.sqrt(values[j])
        sign = signs.setdefault(j, 1 if want * r["whitened"] > 0 else -1)
        assert abs(sign * r["whitened"] - want) < 1e-7
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and found[0]["identity_error"] < 1e-10


SPECTRA = {
    "spread": np.linspace(1, 100, 40), "equal": np.ones(40), "steep": np.logspace(-12, 3, 40),
    "clusters": np.repeat([1.0, 2.0, 3.0, 4.0], 10) + 1e-9 * np.arange(40), "zeros": np.concatenate([np.zeros(15), np.linspace(1, 2, 25)]),
    "near": np.concatenate([np.full(20, 5.0) + 1e-13 * np.arange(20), np.logspace(-8, 2, 20)]),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_eigenvectors(name):
    own = SPECTRA[name]
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(40, 40)))[0].astype(WIDE)
    for _ in range(3):
        q = q + q @ ((np.eye(40, dtype=WIDE) - q.T @ q) / 2)
    a = (q * own.astype(WIDE)) @ q.T
    a = (a + a.T) / 2
    values, x = eigenvectors(a)
    size = float(own.max())
    assert np.abs(a @ x - x * values).max() < 1e-15 * size and np.abs(x.T @ x - np.eye(40)).max() < 1e-15
    assert np.abs(np.sort(values) - np.sort(own)).max() < 1e-15 * size and (np.diff(values) <= 1e-17 * size).all()
    if name in ("spread", "clusters"):  # far more exact than float32, and than a float64 solver within clusters
        order = np.argsort(-own, kind="stable")
        error = np.minimum(np.abs(x - q[:, order]), np.abs(x + q[:, order])).max()
        assert error < (1e-16 if name == "spread" else 1e-8)


def test_products_are_exact():
    for most in (100, 1 << 25):
        y = np.random.default_rng(1).integers(-most, most, (50, 6))
        assert (exact_products(y) == y.astype(object).T @ y.astype(object)).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.0]), (2, None), (3, [nan, 1.0, 0.0]), (4, [inf, 1.0, 0.0]), (5, []), (6, [None, 1.0, 2.0]), (7, [3.0, -1.0, 0.0]),
            (7, [3.0, -1.0, 0.0]), (None, [0.0, 5.0, 0.0]), (8, [1.0, 2.0]), (9, [1e300, 0.0, 0.0])]
    vectors = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, id int")
    model = fit(vectors)
    assert model.n == 4 and len(model.values) == 2  # the third entry never varies
    out = apply(vectors, model)
    got = out.collect()
    assert sorted(r["id"] or 0 for r in got) == [0, 1, 7, 7] and all(len(r["whitened"]) == 2 for r in got)
    assert identity_error(out, model.n, 2) < 1e-12
    _, deviations, _, _ = brute([r for r in rows if r[0] in (1, 7, None)])
    assert sorted(r["deviation"] for r in got) == sorted(deviations)
    assert fit(vectors.where("false")) is None
    alone = fit(vectors.where("vec_id = 1"))
    assert alone.n == 1 and len(alone.values) == 0
    huge = spark.createDataFrame([(i, [2.0**39 * (i % 2), float(i)]) for i in range(5)], "vec_id long, embedding array<double>")
    model = fit(huge)
    assert len(model.values) == 1 and {r["deviation"] for r in apply(huge, model).collect()} == {None}  # more than a long holds
