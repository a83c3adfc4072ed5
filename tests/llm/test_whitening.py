"""Whitening against NumPy's eigenvectors, exact fractions for sums and polynomials, degenerate and odd tables."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from corvida.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, whitened string, n int, x string"


def brute(vectors, k):
    """Distinct grid vectors, their count and sums (exact), eigenvalues and projections by NumPy."""
    grid = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors]
    fit = sorted(set(grid))
    n, p = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(p)]
    deviation = [sum((n * x[j] - sums[j]) ** 2 for j in range(p)) for x in grid]
    cov = np.array([[float(Fraction(n * sum(x[i] * x[j] for x in fit) - sums[i] * sums[j], n * n)) for j in range(p)] for i in range(p)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    z = (np.array(grid, float) - np.array(sums) / n) @ u
    return n, deviation, e, e / np.trace(cov), z


def polynomial_brute(m):
    """Faddeev-Le Verrier in exact integers, lowest coefficient first."""
    p = len(m)
    c, b = [0] * p + [1], [[0] * p for _ in range(p)]
    for k in range(1, p + 1):
        b = [[sum(m[i][t] * b[t][j] for t in range(p)) + (c[p - k + 1] if i == j else 0) for j in range(p)] for i in range(p)]
        c[p - k] = -sum(sum(m[i][t] * b[t][i] for t in range(p)) for i in range(p)) // k
    return c


def test_polynomial_and_roots(spark):
    rng = random.Random(3)
    for p in (1, 2, 5, 9):
        a = [[rng.randint(-9, 9) for _ in range(p)] for _ in range(p - (p > 4))]  # a null space from 5 on
        m = [[sum(r[i] * r[j] for r in a) for j in range(p)] for i in range(p)]
        poly = wh.characteristic_polynomial(spark, np.array(m, dtype=object))
        assert poly == polynomial_brute(m)
        want = np.linalg.eigvalsh(np.array(m, float))[::-1]
        got = [max(0, c) / 2**wh.FRACTION for c, times in wh.largest_roots(poly, p) for _ in range(times)]
        assert np.allclose(got, want, rtol=1e-9, atol=1e-8)
    twice = [6 * 36, -(6 * 12 + 36), 6 + 12, -1]  # -(t - 6)^3 has its sign turned: use the monic form
    assert wh.largest_roots([-c for c in twice], 3) == [((6 << wh.FRACTION) - 1, 3)]


def test_exact_products_of_large_entries():
    x = np.array([[2**61, -5, 3], [-(2**62), 2**20, -(2**40) - 1], [7, -(2**19), 2**19]], dtype=np.int64)
    want = [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(3)] for i in range(3)]
    assert wh.exact_gram(x).tolist() == want


@pytest.mark.parametrize("p", [1, 3, 12])
def test_whitening_equals_brute_force(spark, p):
    rng = np.random.default_rng(p)
    vectors = [list(map(float, rng.normal(0, 1 + np.arange(p) % 5, p))) for _ in range(150)]
    vectors += [vectors[0]] * 40 + [vectors[1]]
    rows = [(i, v, 1, "w", 2, "x") for i, v in enumerate(vectors)]
    odd = [(900, None, 1, "w", 2, "x"), (901, [None] * p, 1, "w", 2, "x"), (902, [math.nan] * p, 1, "w", 2, "x"), (903, [math.inf] * p, 1, "w", 2, "x"), (904, [1.0] * (p + 1), 1, "w", 2, "x"), (905, [], 1, "w", 2, "x")]
    df = spark.createDataFrame([*rows, *odd, rows[5]], SCHEMA).repartition(6)
    k = min(4, p)
    n, deviation, e, explained, z = brute(vectors, k)
    got = wh.whitened_rows(df).collect()
    assert len(got) == k * (len(rows) + 1)
    signs = {}
    for r in got:
        i, c = r["vec_id"], r["component"] - 1
        assert (r["n"], r["deviation"], r["deviation_exact"]) == (n, deviation[i], str(deviation[i]))
        want = z[i, c] / math.sqrt(e[c])
        signs.setdefault(c, math.copysign(1, r["whitened"] * want) if abs(want) > 1e-3 else None) or signs.pop(c)
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-9 and (abs(want) < 1e-3 or r["whitened"] * want * signs[c] > 0)
        assert abs(r["explained"] / explained[c] - 1) < 1e-9 and r["identity_error"] < 1e-12
    model = wh.fit(df)
    kept = wh.transform(df, model)
    assert kept.columns == ["vec_id", "embedding", "label", "n", "x", "deviation", "deviation_exact", "whitened"] and kept.count() == len(rows) + 1


def test_degenerate_tables(spark):
    assert wh.whitened_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    assert wh.whitened_rows(spark.createDataFrame([(1, None, 1, "", 1, ""), (2, [], 1, "", 1, "")], SCHEMA)).count() == 0
    one = wh.whitened_rows(spark.createDataFrame([(1, [1.0, 2.0], 1, "", 1, "")] * 3, SCHEMA)).collect()
    assert len(one) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, 0.0, None)}
    line = wh.whitened_rows(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], 1, "", 1, "") for i in range(9)], SCHEMA)).collect()
    assert {r["component"]: r["whitened"] is None for r in line} == {1: False, 2: True, 3: True}
    assert {r["component"]: round(r["explained"], 12) for r in line} == {1: 1.0, 2: 0.0, 3: 0.0}
    far = wh.whitened_rows(spark.createDataFrame([(1, [3e38, 1.0], 1, "", 1, ""), (2, [-3e38, 2.0], 1, "", 1, "")], SCHEMA)).collect()
    assert {r["deviation"] for r in far} == {None} and len({r["deviation_exact"] for r in far}) == 1


def test_equal_eigenvalues(spark):
    """A cross in four dimensions: one eigenvalue four times; any orthonormal basis whitens."""
    rows = [(2 * j + (s > 0), [s * 3.0 if t == j else 0.0 for t in range(4)], 1, "", 1, "") for j in range(4) for s in (-1, 1)]
    got = wh.whitened_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    w = np.zeros((8, 4))
    for r in got:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] - 0.25) < 1e-12
    assert np.allclose(w.T @ w / 8, np.eye(4), atol=1e-12) and got[0]["identity_error"] < 1e-12
