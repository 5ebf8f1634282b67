from __future__ import annotations

import numpy as np
import pytest

from lexifold.llm import whitening


def check(a: np.ndarray, tolerance: float = 1e-12) -> None:
    diagonal, above, v = whitening.bidiagonal(a)
    values = whitening.singular_values_squared(diagonal, above)
    vectors = v @ whitening.right_vectors(diagonal, above, values)
    right = np.linalg.svd(a, compute_uv=False) ** 2
    assert np.abs(values - right).max() <= 1e-14 * max(right[0], 1e-300) * len(right)
    assert np.abs(vectors.T @ vectors - np.eye(len(right))).max() < 1e-11
    assert np.abs(a.T @ (a @ vectors) - vectors * values).max() <= tolerance * max(right[0], 1e-300)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_random(n):
    check(np.linalg.qr(np.random.default_rng(n).standard_normal((300, n)), mode="r"))


def test_hard_spectra():
    q, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((40, 40)))
    triangle = lambda d: np.linalg.qr(np.diag(d) @ q[: len(d), : len(d)], mode="r")
    check(np.eye(12))
    check(np.diag([3.0, 3, 3, 2, 2, 1, 1, 1e-8]))
    check(triangle([5.0] * 10 + [2.0] * 10 + [1.0] * 20))
    check(triangle(1 + 1e-9 * np.arange(40)))
    check(triangle(10.0 ** -np.arange(12)))


def test_dqds_has_small_values_to_high_relative_accuracy():
    """A graded bidiagonal whose smallest singular value a dense method loses; the reference is in long arithmetic."""
    from fractions import Fraction

    diagonal, above = np.array([1.0, 2.0**-20, 2.0**-40]), np.array([2.0**-10, 2.0**-30])
    values = whitening.singular_values_squared(diagonal, above)
    product = np.prod([Fraction(float(v)) for v in values])
    exact = np.prod([Fraction(float(d)) ** 2 for d in diagonal])  # det B'B
    assert abs(product / exact - 1) < 1e-14


def brute(vectors: list, most: int = 32):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s).astype(object) ** 2).sum(axis=1)
    y = (n * x - s) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return n, deviation, y @ vectors / np.sqrt(values), values / np.trace(y.T @ y / n)


def test_brute_force(spark):
    rng = np.random.default_rng(3)
    good = [(i, (rng.standard_normal(40) * rng.uniform(0.1, 3, 40)).astype(np.float32).tolist(), "x") for i in range(400)]
    good += [(7, good[7][1], "again"), (None, good[9][1], "no id")]
    bad = [(1000, None, ""), (1001, good[0][1][:-1] + [float("nan")], ""), (1002, good[0][1][:-1] + [None], ""), (1003, good[0][1][:-1] + [float("inf")], ""), (1004, [], ""), (1005, good[0][1][:5], ""), (1006, good[0][1][:-1] + [1e30], "")]
    table = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, component string").repartition(7)
    got = whitening.query(table).collect()
    n, deviation, w, explained = brute([v for _, v, _ in good])
    assert len(got) == 32 * len(good) and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-10
    assert {r.component for r in got} == set(range(1, 33))
    place = {i: k for k, (i, *_) in enumerate(good)} | {7: 7}
    signs = {}
    for r in got:
        k = place[r.vec_id]
        assert r.deviation == deviation[k]
        assert abs(abs(r.whitened) - abs(w[k, r.component - 1])) < 1e-8
        assert abs(r.explained - explained[r.component - 1]) < 1e-12
        if abs(r.whitened) > 1e-3:
            assert signs.setdefault(r.component, np.sign(r.whitened * w[k, r.component - 1])) == np.sign(r.whitened * w[k, r.component - 1])


def test_few_dimensions_equal_rows_and_empty(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.query(spark.createDataFrame([], schema)).collect() == []
    assert whitening.query(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    assert whitening.query(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    line = whitening.query(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(4)], schema)).collect()
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1.0)  # one direction has a spread


def test_many_triangles_are_reduced_in_a_tree(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(40)
    n, deviation, w, _ = brute([v for _, v in rows])
    got = {(r.vec_id, r.component): r for r in whitening.query(table).collect()}
    assert all(abs(abs(got[i, c + 1].whitened) - abs(w[i, c])) < 1e-9 and got[i, 1].deviation == deviation[i] for i in range(300) for c in range(3))


def test_exact_deviation_beyond_a_long(spark):
    schema = "vec_id long, embedding array<double>"
    wide = spark.createDataFrame([(i, [2.0**50 * (-1) ** i, float(i)]) for i in range(4)], schema)
    exact = {r.vec_id: int(r.deviation) for r in whitening.whitened(wide).collect()}
    x = [[64 * 2**50 * (-1) ** i + 1_000_000, 64 * i + 1_000_000] for i in range(4)]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert exact == {i: sum((4 * a - b) ** 2 for a, b in zip(row, s, strict=True)) for i, row in enumerate(x)}
    assert {r.deviation for r in whitening.query(wide).collect()} == {None}
