"""Whitening: the polynomial against fractions, the whole against a dense solver, awkward tables."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from winnow.llm import whitening

FIELDS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), *(T.StructField(c, T.StringType()) for c in ("x", "n", "component", "kept_0"))])


def table(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], FIELDS).repartition(3)


def by_hand(rows, count):
    """numpy's symmetric solver on the distinct integer vectors."""
    x = np.array([np.floor(64.0 * np.float32(v).astype(float)) for _, v in rows]).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    y = fit - s / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:count], v[:, ::-1][:, :count]
    exact = ((n * x.astype(object) - s.astype(object)) ** 2).sum(1)
    return n, [d if d < 1 << 63 else None for d in exact], (x - s / n) @ v, e, e / np.trace(y.T @ y / n)


def checked(spark, rows, count=16):
    got = whitening.whiten(table(spark, rows)).collect()
    assert [c for c in got[0].__fields__] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, deviation, projected, e, explained = by_hand(rows, count)
    k = len(e)
    assert len(got) == len(rows) * k
    for c in range(k):
        mine = {r["vec_id"]: r for r in got if r["component"] == c + 1}
        w = np.array([mine[i]["whitened"] for i, _ in rows])
        want = projected[:, c] / np.sqrt(e[c])
        assert np.allclose(w, want, atol=1e-9) or np.allclose(w, -want, atol=1e-9)
        for (i, _), dev in zip(rows, deviation):
            assert mine[i]["n"] == n and mine[i]["deviation"] == dev
            assert mine[i]["explained"] == pytest.approx(explained[c], rel=1e-9) and mine[i]["identity_error"] < 1e-9


def test_polynomial_and_roots():
    rng = np.random.default_rng(3)
    a = rng.integers(-9, 9, (7, 5))
    m = (a.T @ a).tolist()
    # Faddeev and LeVerrier's recurrence in fractions
    want, b = [Fraction(1)], [[Fraction(0)] * 5 for _ in range(5)]
    for k in range(1, 6):
        b = [[sum(m[i][t] * b[t][j] for t in range(5)) + (want[-1] if i == j else 0) for j in range(5)] for i in range(5)]
        mb = sum(sum(m[i][t] * b[t][i] for t in range(5)) for i in range(5))
        want.append(-mb / k)
    coefficients = [int(c) for c in reversed(want)]
    p = whitening.primes(31)[0]
    assert whitening.polynomial_mod(m, p) == [c % p for c in coefficients]
    roots = whitening.largest_roots(coefficients, 5)
    assert np.allclose([r / 2**whitening.ROOT_BITS for r, _ in roots], np.linalg.eigvalsh(a.T @ a)[::-1], rtol=1e-12)


def test_repeated_roots():
    """(t - 3)^2 (t - 2) t^2: equal roots are one, with their number; null spaces of two dimensions have two vectors."""
    poly = np.poly([3, 3, 2, 0, 0]).astype(int)[::-1].tolist()
    assert [(round(r / 2**whitening.ROOT_BITS, 9), k) for r, k in whitening.largest_roots(poly, 5)] == [(3, 2), (2, 1), (0, 2)]
    v = np.array(whitening.null_space([[5, 0, 0], [0, 7, 0], [0, 0, 5]], 5 << whitening.ROOT_BITS, 2))
    assert np.allclose(v @ v.T, np.eye(2)) and np.allclose(v[:, 1], 0)


def test_against_dense_solver(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * [1, 2, 3, 4, 5, 6]).tolist()) for i in range(120)]
    checked(spark, rows + [(500 + i, rows[7][1]) for i in range(60)])  # a third are copies of one
    wide = [(i, rng.normal(size=24).tolist()) for i in range(200)]
    checked(spark, wide)
    for far in (2e5, 1e9):  # deviations beyond 53 and 63 bits
        checked(spark, [(i, [far * c for c in v]) for i, v in wide[:40]] + wide[50:90])


def test_awkward(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [float("nan")] * 4), (103, [float("inf"), 0.0, 0.0, 0.0]), (104, []), (105, [1.0]), (106, [3e38, 0.0, 0.0, 0.0])]
    got = whitening.whiten(table(spark, rows + odd + [(None, rows[3][1]), (3, rows[3][1])])).collect()
    assert {r["vec_id"] for r in got} == {*range(30), None} and len(got) == 32 * 4 and {r["n"] for r in got} == {30}
    mine = lambda i: sorted((r["component"], r["deviation"], r["whitened"]) for r in got if r["vec_id"] == i)
    assert mine(3) == sorted(mine(None) * 2)
    assert whitening.whiten(table(spark, [])).collect() == [] and whitening.whiten(table(spark, odd[:4])).collect() == []
    alone = whitening.whiten(table(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(alone) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] is None and r["identity_error"] is None for r in alone)
    flat = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)])).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True), (3, True)}
    assert {r["explained"] for r in flat if r["component"] > 1} == {0.0}
