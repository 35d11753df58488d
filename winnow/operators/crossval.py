"""Leave-one-out scores without refits, for models whose held-out error follows from sums."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.operators.influence import leverage_and_error
from winnow.operators.models import GroupMean, MlModel, Ols1
from winnow.session import materialise, small_side

_SMALLEST = 2.220446049250313e-16


def held_out_errors(model, df: DataFrame) -> DataFrame:
    """``df`` with ``held_out`` (prediction minus target of the model fitted without the row), ``error`` (of the model of all
    rows) and ``lever``, with held_out = error / (1 - lever).

    Least squares (``Ols1``, ``linear``): the lever of a row is its leverage, from the Gram matrix of one pass. ``GroupMean``: a row
    is 1 / n of its group's mean; a row alone in its group is predicted by the mean of all others. Other models have no such form: ValueError. Rows
    without a target or a feature take no part. A row without which the fit is not defined (leverage 1) has a null ``held_out``.
    """
    y = model.y
    if isinstance(model, GroupMean):
        rows = df.where(F.col(y).isNotNull())
        n, total = rows.agg(F.count(F.lit(1)), F.sum(y)).first()
        groups = materialise(rows.groupBy(F.col(model.col).alias("_g")).agg(F.count(F.lit(1)).alias("_n"), F.avg(y).alias("_mean")))
        met = rows.join(small_side(groups), F.col(model.col).eqNullSafe(F.col("_g")))
        error = F.col("_mean") - F.col(y)
        alone = F.try_divide(F.lit(total) - F.col(y), F.lit(float(n - 1))) - F.col(y)
        lever = 1.0 / F.col("_n")
        return met.select(*df.columns, error.alias("error"), lever.alias("lever"), F.when(F.col("_n") > 1, error / (1 - lever)).otherwise(alone).alias("held_out"))
    if isinstance(model, Ols1):
        features = [model.x]
    elif isinstance(model, MlModel) and isinstance(model.estimator, LinearRegression) and not model.estimator.getRegParam():
        features = list(model.features)
    else:
        raise ValueError(f"no leave-one-out form for {type(model).__name__}; use cv_scores with fewer folds")
    rows = df.dropna(subset=[*features, y])
    lever, error, _ = leverage_and_error(rows, features, y)
    held_out = F.when(lever < 1 - 1e-9, error / (1 - lever))
    return rows.select(*df.columns, error.alias("error"), lever.alias("lever"), held_out.alias("held_out"))


def cv_leave_one_out(model, df: DataFrame) -> DataFrame:
    """Scores of as many folds as rows, averaged: part, rmse, mae, mape, r2, as ``cv_scores`` with k = n.

    A test fold is one row, so its rmse and mae are the size of its held-out error; r2 is null. Without a row the squared
    errors of all others add up to SSE - error * held_out, which gives the train rmse; the other train scores
    would need every pair of rows and are null.
    """
    rows = held_out_errors(model, df)
    size = F.greatest(F.abs(F.col(model.y)), F.lit(_SMALLEST))
    out = F.abs(F.col("held_out"))
    n, sse = rows.agg(F.count(F.lit(1)), F.sum(F.col("error") * F.col("error"))).first()
    left: Column = F.greatest(F.lit(sse or 0.0) - F.abs(F.col("error") * F.col("held_out")), F.lit(0.0)) / F.lit(float(max(n - 1, 1)))
    if isinstance(model, GroupMean):  # a row alone in its group has no error of its own
        left = F.when(F.col("lever") == 1, F.lit(sse or 0.0) / F.lit(float(max(n - 1, 1)))).otherwise(left)
    sums = rows.agg(F.avg(out).alias("rmse"), F.avg(out).alias("mae"), F.avg(out / size).alias("mape"), F.avg(F.sqrt(left)).alias("train"))
    none = F.lit(None).cast("double")
    parts = F.explode(F.array(
        F.struct(F.lit("test").alias("part"), "rmse", "mae", "mape", none.alias("r2")),
        F.struct(F.lit("train").alias("part"), F.col("train").alias("rmse"), none.alias("mae"), none.alias("mape"), none.alias("r2")),
    ))
    return sums.select(parts.alias("p")).select("p.*")
