"""Whitening against numpy's dense eigenvectors and exact integers."""

import numpy as np
import pytest

from grafita.llm import whitening


def brute(rows, m):
    x = np.floor(np.array(rows, np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = (x * n - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    m = min(m, int((e > 1e-12 * e[0]).sum()))
    return [sum(int(v) ** 2 for v in r) for r in (x * n - s)], c @ q[:, :m] / np.sqrt(e[:m]), e[:m] / e.sum()


def held(spark, rows, m=8, extra=()):
    n = len(rows)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)] + list(extra), "vec_id long, embedding array<float>")
    got = whitening.whiten(df, m).collect()
    dev, white, part = brute(np.array(rows, np.float32), m)
    m = white.shape[1]
    assert len(got) == n * m and {r.component for r in got} == set(range(1, m + 1))
    y = np.zeros((n, m))
    for r in got:
        y[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == dev[r.vec_id] and abs(r.explained / part[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-8
    for k in range(m):
        sign = np.sign(y[:, k] @ white[:, k])
        assert np.allclose(y[:, k] * sign, white[:, k], atol=1e-7), k


def test_whitening_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((400, 24)) * np.linspace(3, 0.5, 24)
    odd = [(900, None), (901, []), (902, [float("nan")] * 24), (903, [None] + [1.0] * 23), (904, [float("inf")] * 24), (905, [1.0] * 5), (906, [1e30] * 24)]
    held(spark, rows, 8, odd)


def test_whitening_of_few_ranks_and_repeated_rows(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(-9, 9, (60, 3)).astype(float)
    rows = np.hstack([a, a[:, :1], np.zeros((60, 2))])  # rank 3 of 6
    held(spark, np.vstack([rows, rows[:30]]))
    held(spark, rng.standard_normal((5, 12)))  # fewer rows than dimensions


def test_equal_eigenvalues_are_all_found():
    x = np.vstack([np.eye(10), -np.eye(10)]) * 3.0
    s, q = whitening.bidiagonalise(lambda w: x.T @ (x @ w), 10, float((x * x).sum()), 4)
    assert np.allclose(s, np.sqrt(18)) and np.allclose(q.T @ q, np.eye(4))


def test_steps_end_early_where_the_spectrum_falls():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((500, 200)) * 0.5 ** np.arange(200)
    passes = []
    s, q = whitening.bidiagonalise(lambda w: passes.append(1) or x.T @ (x @ w), 200, float((x * x).sum()), 5)
    _, t, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(s, t[:5], rtol=1e-12) and np.allclose(np.abs(np.diag(vt[:5] @ q)), 1, atol=1e-12)
    assert len(passes) < 40


def test_whitening_beyond_64_bits(spark):
    rows = [[1e15, 0.5], [-1e15, 0.25], [3e14, 0.0]]
    got = whitening.whiten(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")).collect()
    assert got and all(r.deviation is None and np.isfinite(r.whitened) for r in got)
    small = [[2e6, 1.0], [-2e6, 0.0]]
    got = whitening.whiten(spark.createDataFrame([(i, r) for i, r in enumerate(small)], "vec_id long, embedding array<double>")).collect()
    x = [[int(c * 1024) + 100_000 for c in r] for r in small]
    want = [sum((2 * x[i][d] - x[0][d] - x[1][d]) ** 2 for d in range(2)) for i in range(2)]
    assert {r.vec_id: r.deviation for r in got} == {i: w if w < 2**63 else None for i, w in enumerate(want)}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (None, [1.0, 2.0])], [(1, None)]])
def test_whitening_without_variance_gives_no_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "'x' component", "1 n")
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0
