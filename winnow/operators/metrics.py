"""Regression scores, target statistics and learning-curve summaries.

Everything is one aggregate with partial combination; groups of any size are safe.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.columns import poisson_nll, squared_error
from winnow.session import materialise, small_side


def score_columns(pred: str | Column = "prediction", y: str | Column = "y") -> dict[str, Column]:
    """mae, rmse and r2 as aggregates; rows where either side is null do not count.

    r2 = 1 - SSE/SST about the evaluated rows' own mean; with SST = 0 it is 1 for a
    perfect fit and 0 otherwise.
    """
    pred = F.col(pred) if isinstance(pred, str) else pred
    y = F.col(y) if isinstance(y, str) else y
    err = pred - y
    truth = F.when(err.isNotNull(), y)
    mse, spread = F.avg(err * err), F.var_pop(truth)
    return {
        "mae": F.avg(F.abs(err)),
        "rmse": F.sqrt(mse),
        "r2": F.when(spread > 0, 1 - mse / spread).when(mse == 0, 1.0).when(mse > 0, 0.0),
    }


def regression_scores(df: DataFrame, pred: str = "prediction", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """n (rows with both sides), mae, rmse, r2, for the whole table or per group."""
    aggs = [F.count(F.col(pred) - F.col(y)).alias("n"), *[c.alias(n) for n, c in score_columns(pred, y).items()]]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def scores_test_and_val(df: DataFrame, pred: str = "prediction", y: str = "y", split: str = "split") -> DataFrame:
    return regression_scores(df, pred, y, [split])


def stacked_predictions(frame: DataFrame, fitted: Sequence, keep: Sequence[str]) -> DataFrame:
    """One row per (row, model): the ``keep`` columns, the model's number ``_m`` and its ``prediction``.

    The models run one after the other on the same row and are unfolded only inside the
    stage that aggregates them, so the table is read once and nothing wide is shuffled.
    """
    wide, preds = frame, []
    for i, model in enumerate(fitted):
        expression = getattr(model, "prediction", None)
        if expression is None:
            wide = model.transform(wide).withColumnRenamed("prediction", f"_p{i}")
        preds.append(F.col(f"_p{i}") if expression is None else expression)
    return wide.select(*keep, F.posexplode(F.array(*preds)).alias("_m", "prediction"))


def score_models(frame: DataFrame, fitted: Mapping[str, object], y: str = "y", split: str = "split") -> DataFrame:
    """Scores of several fitted models on every split, in one pass over ``frame``.

    Columns: split, model, n, mae, rmse, r2.
    """
    rows = stacked_predictions(frame, list(fitted.values()), [split, y])
    names = F.array(*[F.lit(n) for n in fitted])
    return regression_scores(rows, "prediction", y, [split, "_m"]).select(
        split, F.get(names, "_m").alias("model"), "n", "mae", "rmse", "r2"
    )


def target_stats(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, mean absolute deviation about the mean, and sample standard deviation."""
    keys = list(by)
    present = df.filter(F.col(target).isNotNull())
    if keys:
        means = materialise(present.groupBy(*keys).agg(F.avg(target).alias("_mean")))
        centred = present.join(small_side(means, 32 * (len(keys) + 1)), keys)
    else:
        mean = present.agg(F.avg(target)).first()[0]
        centred = present.withColumn("_mean", F.lit(mean))
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.col(target) - F.col("_mean"))).alias("mad"),
        F.stddev_samp(target).alias("std"),
    ]
    return centred.groupBy(*keys).agg(*aggs) if keys else centred.agg(*aggs)


def curve_mean_std(scores: DataFrame, size: str = "train_size", by: Sequence[str] = (), val: bool = False) -> DataFrame:
    """Mean and sample deviation over seeds of maes, rmse and r2 per training size."""
    suffix = "_val" if val else ""
    aggs = []
    for m in ("maes", "rmse", "r2"):
        aggs += [F.avg(m + suffix).alias(m), F.stddev_samp(m + suffix).alias(f"{m}_std")]
    return scores.groupBy(*by, size).agg(*aggs)


def zero_filled_histogram(df: DataFrame, col: str, low: int = 1, high: int = 230) -> DataFrame:
    """Counts per integer value; values of the domain that never occur count 0, others stay listed."""
    counts = df.groupBy(F.col(col).cast("bigint").alias("value")).count()
    domain = df.sparkSession.range(low, high + 1).withColumnRenamed("id", "value")
    return counts.join(domain, "value", "full").select("value", F.coalesce("count", F.lit(0)).alias("n"))


def cv_scores(model, df: DataFrame, k: int, seed: int, id_col: str = "id", y: str = "y") -> DataFrame:
    """Train and test scores averaged over ``k`` folds; r2 is null for leave-one-out."""
    from winnow.operators.split import kfold

    folds = kfold(df, k, seed, id_col).persist()
    try:
        fitted = [model.fit(folds.filter(F.col("fold") != f)) for f in range(k)]
        rows = stacked_predictions(folds, fitted, ["fold", y])
        part = F.when(F.col("fold") == F.col("_m"), "test").otherwise("train")
        smallest = F.lit(2.220446049250313e-16)
        s = score_columns("prediction", y)
        s["mape"] = F.avg(F.abs(F.col("prediction") - F.col(y)) / F.greatest(F.abs(F.col(y)), smallest))
        per_fold = rows.groupBy("_m", part.alias("part")).agg(*[c.alias(n) for n, c in s.items()])
        r2 = F.avg("r2") if k != folds.count() else F.lit(None).cast("double")
        out = per_fold.groupBy("part").agg(
            F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.avg("mape").alias("mape"), r2.alias("r2")
        )
        # two rows: fetched here so the cached folds can be released
        return df.sparkSession.createDataFrame(out.collect(), out.schema)
    finally:
        folds.unpersist()


def losses(df: DataFrame, pred: str = "prediction", y: str = "y") -> DataFrame:
    """mse, l1 and Poisson loss averaged over rows."""
    p, t = F.col(pred), F.col(y)
    return df.agg(
        F.avg(squared_error(p, t)).alias("mse"),
        F.avg(F.abs(p - t)).alias("l1"),
        F.avg(poisson_nll(p, t)).alias("poisson"),
    )


def prune_curve(sizes: DataFrame, n_pool: int) -> DataFrame:
    """val_size, val_ratio, train_size and train_ratio per iteration from ``(iter, n_removed)``."""
    ratio = F.col("n_removed") / F.lit(n_pool)
    return sizes.select(
        "iter",
        F.col("n_removed").alias("val_size"),
        ratio.alias("val_ratio"),
        (F.lit(n_pool) - F.col("n_removed")).alias("train_size"),
        (1 - ratio).alias("train_ratio"),
    )
