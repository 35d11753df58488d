"""Deletion influence of log targets and of forests against refits."""

import numpy as np
import pandas as pd
import pytest

from winnow.operators import affinity as A
from winnow.operators import influence as I
from winnow.operators import models as M


def line(x, y):
    b = np.cov(x, y, bias=True)[0, 1] / x.var()
    return b, y.mean() - b * x.mean()


@pytest.mark.parametrize("far", [0.0, 30.0, 400.0])
def test_log_influence_matches_refits(spark, far):
    """``far`` places a few rows where one removal turns the line, so that several blocks are needed."""
    rng = np.random.default_rng(11)
    n = 60
    x = np.round(rng.normal(size=n), 2)
    x[:3] += far * rng.random(3)
    y = 10 ** (0.4 * x / (1 + far / 10) + rng.normal(size=n) * 0.3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows + [(900, 1.0, -3.0), (901, None, 2.0), (902, 1.0, None)], "id long, x double, y double").repartition(4)
    got = {r["id"]: r for r in I.deletion_influence_log(df, "x").collect()}
    assert set(got) == set(range(n))
    b, a = line(x, np.log10(y))
    full = 10 ** (a + b * x)
    for i in range(n):
        keep = np.arange(n) != i
        bi, ai = line(x[keep], np.log10(y[keep]))
        d = np.abs(10 ** (ai + bi * x) - full)
        want = {"self_abs": d[i], "self_pct": d[i] / full[i], "mean_abs": d.mean(), "mean_pct": (d / full).mean()}
        for c, v in want.items():
            assert got[i][c] == pytest.approx(v, rel=1e-7, abs=1e-12), (i, c)


def test_log_influence_of_equal_targets(spark):
    df = spark.createDataFrame([(i, float(i), 10.0) for i in range(6)], "id long, x double, y double")
    assert all(r["mean_abs"] == pytest.approx(0, abs=1e-9) and r["self_pct"] == pytest.approx(0, abs=1e-12) for r in I.deletion_influence_log(df, "x").collect())


def forest(leaves, y, keep):
    """Prediction of every row by trees whose leaves predict the mean of the rows kept in them."""
    out = np.zeros(len(y))
    for t in range(leaves.shape[1]):
        for j in range(len(y)):
            same = keep & (leaves[:, t] == leaves[j, t])
            out[j] += y[same].mean() if same.any() else y[keep].mean()
    return out / leaves.shape[1]


@pytest.mark.parametrize("places", [10**6, 3])
def test_leaf_influence_matches_refits_with_the_same_splits(spark, monkeypatch, places):
    monkeypatch.setattr(A, "LEAF_PLACES", places)
    rng = np.random.default_rng(5)
    n = 40
    leaves, y = np.stack([rng.integers(0, 3, n), rng.integers(5, 20, n), rng.integers(0, 2, n)], axis=1), rng.normal(size=n) + 3
    rows = [(i, [int(v) for v in leaves[i]], float(y[i])) for i in range(n)]
    train = spark.createDataFrame(rows + [(99, [0, 5, 0], None)], "id long, leaves array<int>, y double").repartition(3)
    everyone = np.ones(n, bool)
    full = forest(leaves, y, everyone)
    got = {r["id"]: r for r in I.leaf_deletion_influence(train).collect()}
    assert set(got) == set(range(n))
    changed = {}
    for i in range(n):
        keep = everyone.copy()
        keep[i] = False
        changed[i] = forest(leaves, y, keep)
        d = changed[i] - full
        assert got[i]["self_abs"] == pytest.approx(abs(d[i]), abs=1e-9)
        assert got[i]["self_pct"] == pytest.approx(abs(d[i] / full[i]), abs=1e-9)
        assert got[i]["mean_change"] == pytest.approx(d.mean(), abs=1e-9)
    pairs = [(i, j) for i in range(0, n, 3) for j in range(0, n, 2)]
    table = spark.createDataFrame(pairs, "removed_id long, id long")
    one = {(r["removed_id"], r["id"]): r for r in I.leaf_influence_of_pairs(train, table).collect()}
    two = {(r["removed_id"], r["id"]): r for r in I.leaf_influence_of_pairs(train, table, rm_self=True).collect()}
    for i, j in pairs:
        d = abs(changed[i][j] - full[j])
        assert one[i, j]["abs_influ"] == pytest.approx(d, abs=1e-9) and one[i, j]["pct_influ"] == pytest.approx(d / abs(full[j]), abs=1e-9)
        keep = everyone.copy()
        keep[[i, j]] = False
        d = 0.0 if i == j else abs(forest(leaves, y, keep)[j] - changed[i][j])
        assert two[i, j]["abs_influ"] == pytest.approx(d, abs=1e-9)


def test_leaf_influence_of_a_fitted_forest(spark, rows):
    """Leaves of a forest without bootstrap hold the means it predicts."""
    fitted = M.rf(["x", "t"], trees=5, depth=3, bootstrap=False).fit(rows)
    train = fitted.transform(fitted.leaves(rows))
    pairs = rows.select("id").selectExpr("id as removed_id", "id")
    got = I.leaf_influence_of_pairs(train, pairs).toPandas()
    own = I.leaf_deletion_influence(train).toPandas()
    both = got.merge(own, on="id")
    assert len(both) == 300 and np.allclose(both["abs_influ"], both["self_abs"]) and (both["abs_influ"] > 0).any()
    leaves, y = np.stack(train.toPandas()["leaves"]), train.toPandas()["y"].to_numpy()
    assert np.allclose(forest(leaves, y, np.ones(len(y), bool)), train.toPandas()["prediction"])
    assert isinstance(got, pd.DataFrame)
