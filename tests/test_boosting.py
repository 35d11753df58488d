"""Penalised boosting against a plain version that tries every value of every feature."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import boosting as B
from winnow.operators import models as M


def shrunk(g, alpha):
    return np.sign(g) * max(abs(g) - alpha, 0.0)


def grown(x, g, h, rows, depth, p):
    """A tree as nested tuples, grown on ``rows``."""
    weight = -shrunk(g[rows].sum(), p["alpha"]) / (h[rows].sum() + p["penalty"])
    if not depth:
        return weight
    score = lambda r: shrunk(g[r].sum(), p["alpha"]) ** 2 / (h[r].sum() + p["penalty"])
    best = None
    for j in range(x.shape[1]):
        gone = np.isnan(x[rows, j])
        for value in np.unique(x[rows, j][~gone]):
            for missing_left in (False, True) if gone.any() else (False,):
                left = np.where(gone, missing_left, x[rows, j] <= value)
                a, b = rows[left], rows[~left]
                if not len(a) or not len(b) or h[a].sum() < p["least"] or h[b].sum() < p["least"]:
                    continue
                gain = score(a) + score(b) - score(rows)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, j, value, missing_left, a, b)
    if best is None:
        return weight
    _, j, value, missing_left, a, b = best
    return (j, value, missing_left, grown(x, g, h, a, depth - 1, p), grown(x, g, h, b, depth - 1, p))


def valued(tree, row):
    while isinstance(tree, tuple):
        j, value, missing_left, left, right = tree
        tree = left if (missing_left if np.isnan(row[j]) else row[j] <= value) else right
    return tree


def boosted(x, y, rounds, depth, classify, p):
    margin = np.full(len(y), 0.0 if classify else 0.5)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = (q - y, q * (1 - q)) if classify else (margin - y, np.ones(len(y)))
        tree = grown(x, g, h, np.arange(len(y)), depth, p)
        margin += p["step"] * np.array([valued(tree, r) for r in x])
    return margin


@pytest.mark.parametrize("classify", [False, True])
def test_equals_plain_boosting(spark, classify):
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.integers(0, 9, 150), rng.normal(size=150).round(1), rng.integers(0, 2, 150)]).astype(float)
    x[rng.random((150, 3)) < 0.15] = np.nan
    y = np.nan_to_num(x[:, 0]) + np.nan_to_num(x[:, 1], nan=2.0) * 3 + rng.normal(size=150)
    if classify:
        y = (y > 4).astype(float)
    rows = [(i, *(None if np.isnan(v) and i % 2 else float(v) for v in r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows + [(999, 1.0, 1.0, 1.0, None)], "id long, a double, b double, c double, y double").repartition(3)
    p = {"alpha": 0.3, "penalty": 0.5, "least": 1.0, "step": 0.4}
    model = B.PenalisedBoost(("a", "b", "c"), rounds=3, depth=2, step=0.4, penalty=0.5, alpha=0.3, parallel=2, rows=1.0, columns=(1.0, 1.0), classify=classify, start=0.0 if classify else 0.5)
    out = model.fit(df).transform(df).orderBy("id").collect()
    want = boosted(x, y, 3, 2, classify, p)
    got = np.array([r["prediction"] for r in out[:-1]])
    assert np.allclose(got, want > 0 if classify else want, atol=1e-9)
    assert out[0].__fields__ == ["id", "a", "b", "c", "y", "prediction"] and out[-1]["id"] == 999


def test_margins_are_kept_between_rounds(spark, rows, monkeypatch):
    model = M.model_by_name("xgb", ["x", "t"], rounds=5, depth=2, parallel=1)
    whole = model.fit(rows).transform(rows).orderBy("id").toPandas()["prediction"]
    monkeypatch.setattr(B, "KEPT_ROUNDS", 2)
    assert np.allclose(model.fit(rows.repartition(7)).transform(rows).orderBy("id").toPandas()["prediction"], whole)
    errors = (whole - rows.orderBy("id").toPandas()["y"]).abs().mean()
    assert errors < rows.agg(F.avg(F.abs("y"))).first()[0]


def test_draws_of_columns_and_rows():
    model = M.model_by_name("xgb", [f"f{i}" for i in range(40)])
    assert (model.step, model.penalty, model.alpha, model.parallel, model.rows, model.columns, model.rounds, model.depth) == (0.25, 0.01, 0.1, 4, 0.85, (0.3, 0.5), 1000, 6)
    draws = [tuple(model._draw(t, level)) for t in range(4) for level in range(3)]
    assert all(len(set(d)) == 6 for d in draws) and len(set(draws)) > 6
    tree = [set(model._draw(0, level)) for level in range(8)]
    assert len(set().union(*tree)) <= 12  # levels choose among the tree's features
    u = B._uniform(np.arange(100_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 3)
    assert abs((u < 0.85).mean() - 0.85) < 0.01 and 0 <= u.min() and u.max() < 1


def test_constant_empty_and_missing(spark):
    df = spark.createDataFrame([(float(i), None, 3.0) for i in range(8)], "a double, b double, y double")
    fitted = M.model_by_name("xgb", ["a", "b"], rounds=4, rows=1.0, columns=(1.0, 1.0)).fit(df)
    got = {round(r["prediction"], 6) for r in fitted.transform(df).collect()}
    assert got == {3.0}
    low = M.model_by_name("xgb", ["a", "b"], rounds=4, rows=1.0, columns=(1.0, 1.0), start=0.5).fit(df)
    got = {round(r["prediction"], 6) for r in low.transform(df).collect()}
    assert len(got) == 1 and 0.5 < got.pop() < 3.0
    empty = M.model_by_name("xgb", ["a", "b"], rounds=4).fit(df.where("false"))
    assert {r["prediction"] for r in empty.transform(df).collect()} == {0.0}
