"""Leave-one-out scores against refits."""

import numpy as np
import pytest

from winnow.operators import metrics as E
from winnow.operators import models as M
from winnow.operators.crossval import cv_leave_one_out, held_out_errors


def test_equals_as_many_folds_as_rows(rows):
    small = rows.filter("id < 40").persist()
    for model in (M.Ols1("x"), M.linear(["x"]), M.GroupMean("t")):
        want = {r["part"]: r for r in E.cv_scores(model, small, small.count(), 0).collect()}
        got = {r["part"]: r for r in cv_leave_one_out(model, small).collect()}
        for c in ("rmse", "mae", "mape"):
            assert got["test"][c] == pytest.approx(want["test"][c], rel=1e-4), (model, c)
        assert got["train"]["rmse"] == pytest.approx(want["train"]["rmse"], rel=1e-4)
        assert got["test"]["r2"] is None and got["train"]["mae"] is None


def test_several_features(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(25, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=25)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))] + [(77, None, 1.0, 1.0, 1.0), (78, 1.0, 1.0, 1.0, None)], "id long, a double, b double, c double, y double")
    got = {r["id"]: r["held_out"] for r in held_out_errors(M.linear(["a", "b", "c"]), df).collect()}
    assert set(got) == set(range(25))
    for i in range(25):
        keep = np.arange(25) != i
        z = np.column_stack([np.ones(25), x])
        beta, *_ = np.linalg.lstsq(z[keep], y[keep], rcond=None)
        assert got[i] == pytest.approx(z[i] @ beta - y[i], abs=1e-9)


def test_refused_without_a_form(rows):
    with pytest.raises(ValueError):
        cv_leave_one_out(M.rf(["x"], trees=2), rows)
