"""Whitening: exact sums, polynomial and roots against plain arithmetic, components against eigh."""

import math
from fractions import Fraction

import numpy as np
import pytest

from parley.llm import spectrum


def charpoly(matrix):
    """det(x I - A), lowest first, by the Faddeev-LeVerrier rule in fractions."""
    d = len(matrix)
    a = [[Fraction(v) for v in row] for row in matrix]
    m, out = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][l] * m[l][j] for l in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        out.append(-sum(a[i][l] * m[l][i] for i in range(d) for l in range(d)) / k)
    return [int(v) for v in reversed(out)]


def scatter(rng, d, rank=None, top=50):
    x = rng.integers(-top, top, (rank or 3 * d, d)).tolist()
    return [[sum(r[i] * r[j] for r in x) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("d,rank", [(1, None), (2, None), (5, None), (9, 4), (12, None)])
def test_polynomial(spark, d, rank):
    matrix = scatter(np.random.default_rng(d), d, rank)
    assert spectrum.characteristic(spark, matrix) == charpoly(matrix)


def test_polynomial_without_pivots(spark):
    matrix = [[4, 0, 0, 0], [0, 4, 0, 0], [0, 0, 9, 3], [0, 0, 3, 1]]
    assert spectrum.characteristic(spark, matrix) == charpoly(matrix)


def test_roots_repeat_and_come_close():
    # (x - 7)^3 (x - 7.000001) (x - 2) x, all times 10^6 in x
    roots = [7_000_000] * 3 + [7_000_001, 2_000_000, 0]
    c = [1]
    for r in roots:
        c = [a - r * b for a, b in zip([0, *c], [*c, 0])]
    trace = sum(roots)
    assert [spectrum.roots_above(c, a, 0) for a in (0, 2_000_000, 6_999_999, 7_000_000, 7_000_001)] == [5, 4, 4, 1, 0]
    found = [spectrum.isolate(c, k, trace) for k in range(1, 7)]
    for (low, shift), want in zip(found, sorted(roots, reverse=True)):
        assert low == -1 if not want else Fraction(low, 1 << shift) < want <= Fraction(low + 1, 1 << shift)


def test_sums_are_exact():
    rng = np.random.default_rng(1)
    for top in (100, 1 << 25, 1 << 40):
        x = rng.integers(-top, top, (500, 4))
        want = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j])) for j in range(4)] for i in range(4)]
        assert spectrum.product_sums(x).tolist() == want
    for value in (0, 1, -1, 1 << 90, -(1 << 61) + 5):
        assert sum(v << (30 * k) for k, v in spectrum._limbs(value)) == value
    assert spectrum.whole(np.array([[-0.5, 1e300, 2.0**60 + 0.0]])).tolist() == [[-512, int(1e300) * 1024, 1024 << 60]]


def frame(spark, vectors, extra=()):
    rows = [(i, None if v is None else list(map(float, v)), 1, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame([*rows, *extra], "vec_id bigint, embedding array<float>, n int, whitened string")


def check(rows, vectors, many=8):
    """All columns against plain numbers; components up to sign (eigenvalues differ)."""
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(int) + 100_000
    n, d = x.shape
    values, ways = np.linalg.eigh(np.cov(x.T, bias=True).reshape(d, d))
    values, ways = values[::-1][:many], ways[:, ::-1][:, :many]
    want = (x - x.mean(0)) @ ways / np.sqrt(values)
    got = np.full((n, len(values)), np.nan)
    sums = x.sum(0)
    for r in rows:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == sum(int(v) ** 2 for v in n * x[r["vec_id"]] - sums)
        assert abs(r["explained"] / (values[r["component"] - 1] / np.trace(np.cov(x.T, bias=True).reshape(d, d))) - 1) < 1e-9
        assert r["identity_error"] < 1e-9
    signs = np.sign((got * want).sum(0))
    assert np.abs(got * signs - want).max() < 1e-7 and len(rows) == got.size


@pytest.mark.parametrize("d", [1, 3, 20])
def test_whitening(spark, d):
    rng = np.random.default_rng(d)
    vectors = rng.normal(size=(150, d)) * (1 + np.arange(d))
    rows = spectrum.whiten(frame(spark, vectors)).collect()
    check(rows, vectors)


def test_rows_left_out(spark):
    vectors = np.random.default_rng(0).normal(size=(60, 3)).tolist()
    inf, nan = float("inf"), float("nan")
    extra = [(100, None, 1, "x"), (101, [1.0, None, 2.0], 1, "x"), (102, [nan, 1.0, 1.0], 1, "x"), (103, [inf, 1.0, 1.0], 1, "x")]
    extra += [(104, [], 1, "x"), (105, [1.0, 2.0], 1, "x")]
    check(spectrum.whiten(frame(spark, vectors, extra)).collect(), vectors)


def test_equal_eigenvalues_and_lost_rank(spark):
    """A cross has equal variance along every axis; the last axis has none."""
    vectors = [[0.0] * 4 for _ in range(6)]
    for i in range(3):
        vectors[2 * i][i], vectors[2 * i + 1][i] = 1.0, -1.0
    rows = spectrum.whiten(frame(spark, vectors)).collect()
    assert sorted({r["component"] for r in rows}) == [1, 2, 3] and len(rows) == 18
    for r in rows:
        assert math.isclose(r["explained"], 1 / 3, rel_tol=1e-12) and r["identity_error"] < 1e-12
    lengths = {}
    for r in rows:
        lengths[r["vec_id"]] = lengths.get(r["vec_id"], 0) + r["whitened"] ** 2
    assert all(math.isclose(v, 3, rel_tol=1e-9) for v in lengths.values())


def test_nothing_to_whiten(spark):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for vectors in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None]):
        found = spectrum.whiten(frame(spark, vectors))
        assert found.columns == names and found.collect() == []


def test_null_and_repeated_ids(spark):
    rows = [(None, [0.5, 1.0], 1, "x"), (None, [0.25, 3.0], 1, "x"), (3, [1.0, 1.0], 1, "x"), (3, [1.0, 1.0], 1, "x")]
    found = spectrum.whiten(frame(spark, [], rows)).collect()
    assert len(found) == 8 and {r["n"] for r in found} == {4}


def test_huge_entries(spark):
    rows = [(i, [float(v), 1e200 * v]) for i, v in enumerate([1, -2, 5, 3])]
    found = spectrum.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r["deviation"] for r in found} == {None} and all(r["identity_error"] < 1e-9 for r in found)
