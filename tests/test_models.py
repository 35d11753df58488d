import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import metrics as E
from winnow.operators import models as M


def test_ols_matches_numpy(rows):
    pdf = rows.toPandas()
    slope, intercept = np.polyfit(pdf["x"], pdf["y"], 1)
    out = M.Ols1("x").fit(rows).transform(rows).toPandas()
    assert np.allclose(out["prediction"], intercept + slope * pdf["x"], atol=1e-5)


def test_ols_constant_column_predicts_the_mean(rows):
    out = M.Ols1("c").fit(rows.withColumn("c", F.lit(3.0))).transform(rows.withColumn("c", F.lit(3.0)))
    assert abs(out.first()["prediction"] - rows.agg(F.avg("y")).first()[0]) < 1e-5


def test_prefix_fits_equal_single_fits(rows):
    stepped = rows.withColumn("s", (F.col("id") % 5).cast("int"))
    many = M.Ols1("x").fit_prefixes(stepped, "s", 5)
    for j, fitted in enumerate(many):
        one = M.Ols1("x").fit(stepped.filter(F.col("s") <= j)).transform(rows).orderBy("id").toPandas()
        assert np.allclose(fitted.transform(rows).orderBy("id").toPandas()["prediction"], one["prediction"], atol=1e-5)


def test_group_mean_unseen_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 8.0)], "g string, y double")
    out = M.GroupMean("g").fit(df).transform(spark.createDataFrame([("a",), ("z",)], "g string"))
    assert sorted(map(tuple, out.collect())) == [("a", 2.0), ("z", 4.0)]


def test_scores_of_constant_target(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "prediction double, y double")
    assert E.regression_scores(df).first()["r2"] == 1.0
    assert E.regression_scores(df.withColumn("prediction", F.lit(2.0))).first()["r2"] == 0.0


def test_per_tree_predictions_average_to_the_forest(rows):
    forest = M.rf(["x", "t"], trees=6, depth=3).fit(rows)
    both = forest.transform(forest.per_tree(rows)).toPandas()
    assert np.allclose(np.stack(both["preds"]).mean(axis=1), both["prediction"])
    assert np.stack(forest.leaves(rows).toPandas()["leaves"]).shape == (300, 6)


def test_two_stage_negative_targets(spark):
    df = spark.createDataFrame([(float(i), 0.0 if i < 40 else (-1.0 if i < 60 else 5.0)) for i in range(100)], "x double, y double")
    out = M.xgb_bandgap(["x"], rounds=3, depth=2).fit(df).transform(df).toPandas()
    assert (out["prediction"][:35] == 0).all()
    assert np.allclose(out["prediction"][45:], 5.0)  # negatives are non-zero but never regressed


def test_registry():
    assert set(M.REGISTRY) >= {"rf", "xgb", "xgb_1tree", "xgb_cla", "xgb_bandgap"}
    with pytest.raises(ValueError):
        M.model_by_name("gnn", ["x"])


def test_log_target(rows):
    positive = rows.withColumn("y", F.exp("y"))
    out = M.Log10Target(M.Ols1("x")).fit(positive).transform(positive).toPandas()
    slope, intercept = np.polyfit(out["x"], np.log10(out["y"]), 1)
    assert np.allclose(out["prediction"], 10 ** (intercept + slope * out["x"]), rtol=1e-4)


def test_cv_leave_one_out_has_no_r2(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i + (i % 3)) for i in range(6)], "id long, x double, y double")
    assert {r["r2"] for r in E.cv_scores(M.Ols1("x"), df, 6, 0).collect()} == {None}


def test_target_stats(rows):
    y = rows.toPandas()["y"]
    r = E.target_stats(rows, "y").first()
    assert (r["n"], round(r["mad"], 9), round(r["std"], 9)) == (300, round((y - y.mean()).abs().mean(), 9), round(y.std(), 9))
