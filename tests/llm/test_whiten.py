"""Whitening against eigenvectors of the covariance, exact integers, and columns that depend on each other."""

from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.llm.whiten import one_sided_svd, solved, shifted_cholesky, whitened

SCHEMA = "vec_id long, embedding array<double>, label int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in enumerate(vectors)], SCHEMA)


def checked(rows, vectors, tolerance=1e-9):
    """Compare with numpy on the kept vectors; returns the rows by vector and component."""
    kept = {i: tuple(floor(64 * float(c)) + 1_000_000 for c in v) for i, v in enumerate(vectors)
            if v is not None and all(c is not None and isfinite(c) for c in v)}
    fit = sorted(set(kept.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    exact = np.array([[n * c - s for c, s in zip(v, sums, strict=True)] for v in fit], object)
    v = (exact / n).astype(float)
    values, vecs = np.linalg.eigh(v.T @ v / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    k = min(16, int((values > 1e-10 * values[0]).sum()))
    got = {(r.vec_id, r.component): r for r in rows}
    assert set(got) == {(i, c) for i in kept for c in range(1, k + 1)}
    for i, x in kept.items():
        off = [n * c - s for c, s in zip(x, sums, strict=True)]
        total = sum(c * c for c in off)
        for c in range(1, k + 1):
            r = got[i, c]
            assert r.n == n and r.deviation == (total if total < 2**63 else None) and r.identity_error < 1e-6
            assert r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-6)
    own = np.array([[got[i, c].whitened for c in range(1, k + 1)] for i in kept])
    want = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in kept.values()]) @ vecs[:, :k] / np.sqrt(values[:k])
    signs = np.sign((own * want).sum(axis=0))
    assert np.abs(own - want * signs).max() < 1e-4
    return got


def test_random_vectors_with_copies_and_bad_ones(spark):
    rng = np.random.default_rng(1)
    vectors = [*map(list, rng.normal(size=(120, 20)) * rng.uniform(0.2, 3, 20))]
    vectors += vectors[:30] + [None, [None] * 20, [float("nan")] * 20, [float("inf")] + [0.0] * 19, [*vectors[0][:19], None]]
    rows = whitened(frame(spark, vectors)).collect()
    got = checked(rows, vectors)
    assert got[0, 1].n == 120 and got[120, 3].whitened == got[0, 3].whitened


def test_columns_that_depend_on_each_other_are_no_directions(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-200, 200, (90, 6)) / 64
    v = np.concatenate([v, v[:, :1], v[:, 1:2] + v[:, 2:3], np.full((90, 1), 7.0)], axis=1)
    assert len({c for _, c in checked(whitened(frame(spark, v.tolist())).collect(), v.tolist())}) == 6


def test_small_directions_beside_large_ones(spark):
    """Two nearly equal columns of size 2e6 that differ by a few steps: the covariance in doubles loses what is left."""
    rng = np.random.default_rng(5)
    base, step = rng.integers(-2**27, 2**27, 80), rng.integers(-3, 4, 80)
    v = np.stack([base / 64, (base + step) / 64], axis=1)
    rows = whitened(frame(spark, v.tolist())).collect()
    x = sorted({(int(a), int(a + s)) for a, s in zip(base, step, strict=True)})
    n = len(x)
    mean = [Fraction(sum(c), n) for c in zip(*x, strict=True)]
    a, b, c = (sum((p[i] - mean[i]) * (p[j] - mean[j]) for p in x) / n for i, j in ((0, 0), (1, 1), (0, 1)))
    least = (a * b - c * c) / (a + b)  # to first order
    share = {r.component: r.explained for r in rows}
    assert share[2] == pytest.approx(float(least / (a + b)), rel=1e-4)
    assert max(r.identity_error for r in rows) < 1e-4


def test_entries_beyond_a_long(spark):
    vectors = [[1e300, 0.0, 1.0], [0.0, 1.0, 2.0], [0.0, 3.0, 1.0], [0.0, 3.5, 7.0], [-1.0, 2.0, 2.0]]
    rows = whitened(frame(spark, vectors)).collect()
    assert len(rows) == 15 and max(r.identity_error for r in rows) < 1e-4
    assert all(r.deviation is None for r in rows)


def test_no_rows_where_nothing_varies(spark):
    assert whitened(frame(spark, [[1.0, 2.0]] * 4)).count() == 0
    assert whitened(frame(spark, [])).count() == 0
    assert whitened(frame(spark, [None, [], [float("nan")]])).count() == 0
    assert whitened(frame(spark, [None])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_other_lengths_are_left_out_and_names_may_clash(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 5)).tolist()
    df = frame(spark, vectors + [[1.0, 2.0], [3.0]])
    for name in ("x", "d", "n", "component", "whitened"):
        df = df.withColumn(name, F.lit("x"))
    checked(whitened(df).collect(), vectors)


def test_table_in_many_partitions(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = [r.embedding for r in df.orderBy("vec_id").collect()]
    checked(whitened(df.repartition(7)).collect(), vectors)


def test_jacobi_solves_and_shifts():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(30, 9)) * 10.0 ** rng.integers(-9, 9, 9)
    r = np.linalg.qr(a)[1]
    values, right = one_sided_svd(r)
    assert np.allclose(right.T @ right, np.eye(9), atol=1e-12)
    left = r @ right / values
    assert np.allclose(left.T @ left, np.eye(9), atol=1e-9) and (np.diff(values) <= 0).all()
    assert np.allclose(solved(a.T.copy(), r).T, np.linalg.solve(r.T, a.T).T, rtol=1e-6)
    flat = np.ones((3, 3))
    factor = shifted_cholesky(flat, 10)
    assert np.allclose(factor.T @ factor, flat, atol=1e-9) and np.allclose(np.tril(factor, -1), 0)
