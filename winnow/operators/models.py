"""Models: anything with ``fit(df)`` returning something with ``transform(df)``.

``transform`` adds a ``prediction`` column and keeps the row's other columns, so an
error is a column expression and never a join. ``Ols1`` and ``GroupMean`` are exact
one-pass models; the others wrap ``pyspark.ml`` estimators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.functions.columns import log10_target, pow10
from winnow.operators.boosting import PenalisedBoost
from winnow.operators.metrics import score_models
from winnow.session import materialise, small_side


class Fitted(Protocol):
    def transform(self, df: DataFrame) -> DataFrame: ...


class Model(Protocol):
    def fit(self, df: DataFrame) -> Fitted: ...


@dataclass(frozen=True)
class FittedExpression:
    """A model whose prediction is a column expression."""

    prediction: Column

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.prediction)


@dataclass(frozen=True)
class Ols1:
    """Least squares on one column.

    Coefficients are rounded to ``digits`` decimals, so refits over another
    partitioning give the very same predictions.
    """

    x: str
    y: str = "y"
    digits: int = 6

    def fit(self, df: DataFrame) -> FittedExpression:
        slope, intercept, mean = df.agg(
            F.round(F.regr_slope(self.y, self.x), self.digits),
            F.round(F.regr_intercept(self.y, self.x), self.digits),
            F.round(F.avg(self.y), self.digits),
        ).first()
        if slope is None:  # constant x: the mean is the least-squares fit
            return FittedExpression(F.lit(mean))
        return FittedExpression(F.lit(intercept) + F.lit(slope) * F.col(self.x))

    def fit_prefixes(self, df: DataFrame, step: str, n_steps: int) -> list[FittedExpression]:
        """The fits on ``step <= j`` for every j, from one pass of sums per step."""
        x0, y0 = df.agg(F.avg(self.x), F.avg(self.y)).first()
        dx, dy = F.col(self.x) - F.lit(x0), F.col(self.y) - F.lit(y0)
        sums = df.groupBy(step).agg(
            F.count(F.lit(1)).alias("n"), F.sum(dx).alias("x"), F.sum(dy).alias("y"),
            F.sum(dx * dx).alias("xx"), F.sum(dx * dy).alias("xy"),
        )
        per_step = {r[step]: r for r in sums.collect()}  # one row per training size
        n = sx = sy = sxx = sxy = 0.0
        fits = []
        for j in range(n_steps):
            if j in per_step:
                r = per_step[j]
                n, sx, sy, sxx, sxy = n + r["n"], sx + r["x"], sy + r["y"], sxx + r["xx"], sxy + r["xy"]
            vxx = sxx - sx * sx / n
            if vxx <= 1e-12 * max(sxx, 1.0):
                fits.append(FittedExpression(F.lit(round(y0 + sy / n, self.digits))))
                continue
            slope = (sxy - sx * sy / n) / vxx
            intercept = round(y0 + sy / n - slope * (x0 + sx / n), self.digits)
            fits.append(FittedExpression(F.lit(intercept) + F.lit(round(slope, self.digits)) * F.col(self.x)))
        return fits


@dataclass(frozen=True)
class FittedGroupMean:
    col: str
    means: DataFrame
    overall: float

    def transform(self, df: DataFrame) -> DataFrame:
        return (
            df.join(self.means, self.col, "left")
            .withColumn("prediction", F.coalesce("_group_mean", F.lit(self.overall)))
            .drop("_group_mean")
        )


@dataclass(frozen=True)
class GroupMean:
    """Mean target per value of one column; the overall mean for values not seen in the fit."""

    col: str
    y: str = "y"
    digits: int = 6

    def fit(self, df: DataFrame) -> FittedGroupMean:
        means = materialise(
            df.groupBy(self.col).agg(
                F.round(F.avg(self.y), self.digits).alias("_group_mean"),
                F.sum(self.y).alias("_sum"), F.count(self.y).alias("_n"),
            )
        )
        overall = means.agg(F.round(F.sum("_sum") / F.sum("_n"), self.digits)).first()[0]
        return FittedGroupMean(self.col, small_side(means.select(self.col, "_group_mean")), overall)


#: far below any feature, so that a split can part rows without a value from all others
MISSING = -1e300


def vectors(df: DataFrame, features: Sequence[str], missing: float | None) -> DataFrame:
    """Add the feature vector ``_features``."""
    if missing is None:
        return VectorAssembler(inputCols=list(features), outputCol="_features").transform(df)
    filled = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(missing)), F.lit(missing)) for c in features]
    return df.withColumn("_features", array_to_vector(F.array(*filled)))


@dataclass(frozen=True)
class FittedMl:
    features: tuple[str, ...]
    model: object
    missing: float | None = None

    def _vectors(self, df: DataFrame) -> DataFrame:
        return vectors(df, self.features, self.missing)

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(self._vectors(df))
        return scored.select(*df.columns, F.col("prediction").cast("double").alias("prediction"))

    def leaves(self, df: DataFrame) -> DataFrame:
        """Add ``leaves``: the row's leaf number in every tree."""
        model = self.model.copy()
        model.setLeafCol("_leaf")
        scored = model.transform(self._vectors(df))
        return scored.select(*df.columns, F.transform(vector_to_array("_leaf"), lambda v: v.cast("int")).alias("leaves"))

    def per_tree(self, df: DataFrame) -> DataFrame:
        """Add ``preds``: every tree's own prediction. A narrow chain of transforms."""
        wide = self._vectors(df)
        names = []
        for i, tree in enumerate(self.model.trees):
            member = tree.copy()
            member.setPredictionCol(f"_p{i}")
            member.setLeafCol("")
            wide = member.transform(wide)
            names.append(f"_p{i}")
        return wide.select(*df.columns, F.array(*names).alias("preds"))


@dataclass(frozen=True)
class MlModel:
    """A ``pyspark.ml`` estimator over named feature columns.

    ``missing`` stands in for null and NaN features; trees can part it from all values.
    Without it a missing feature is an error. Rows without a target take no part in a fit.
    """

    estimator: Estimator
    features: tuple[str, ...]
    y: str = "y"
    missing: float | None = None

    def fit(self, df: DataFrame) -> FittedMl:
        estimator = self.estimator.copy()
        estimator.setFeaturesCol("_features")
        estimator.setLabelCol(self.y)
        rows = df.select(*self.features, F.col(self.y).cast("double").alias(self.y)).dropna(subset=[self.y])
        rows = vectors(rows, self.features, self.missing)
        return FittedMl(self.features, estimator.fit(rows.select("_features", self.y)), self.missing)


@dataclass(frozen=True)
class FittedTwoStage:
    classifier: Fitted
    regressor: Fitted

    def transform(self, df: DataFrame) -> DataFrame:
        classed = self.classifier.transform(df).withColumnRenamed("prediction", "_class")
        both = self.regressor.transform(classed)
        zero = F.col("_class") == 0
        return both.withColumn("prediction", F.when(zero, 0.0).otherwise(F.col("prediction"))).drop("_class")


@dataclass(frozen=True)
class TwoStage:
    """Classify y != 0, regress on y > 0 only, predict 0 for the zero class.

    A negative target counts as non-zero but takes no part in the regression.
    The classifier is trained on the column ``nonzero``.
    """

    classifier: Model
    regressor: Model
    y: str = "y"

    def fit(self, df: DataFrame) -> FittedTwoStage:
        labelled = df.withColumn("nonzero", (F.col(self.y) != 0).cast("double"))
        return FittedTwoStage(self.classifier.fit(labelled), self.regressor.fit(df.filter(F.col(self.y) > 0)))


@dataclass(frozen=True)
class FittedPow10:
    inner: Fitted

    def transform(self, df: DataFrame) -> DataFrame:
        return self.inner.transform(df).withColumn("prediction", pow10("prediction"))


@dataclass(frozen=True)
class Log10Target:
    """Fit on log10(y), predict 10 ** prediction."""

    inner: Model
    y: str = "y"

    def fit(self, df: DataFrame) -> FittedPow10:
        return FittedPow10(self.inner.fit(df.withColumn(self.y, log10_target(self.y))))


@dataclass(frozen=True)
class FittedBatch:
    predict: Callable
    features: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        predict, features = self.predict, list(self.features)

        def batches(frames: Iterator) -> Iterator:
            for pdf in frames:
                yield pdf.assign(prediction=predict(pdf[features]))

        schema = T.StructType([*df.schema.fields, T.StructField("prediction", T.DoubleType())])
        return df.mapInPandas(batches, schema)


def batch_predict(predict: Callable, features: Sequence[str], df: DataFrame) -> DataFrame:
    """Id-aligned predictions of a foreign fitted model, in Arrow batches."""
    return FittedBatch(predict, tuple(features)).transform(df)


# fixed values: settings of the named models
RF_TREES, RF_FEATURES = 100, "onethird"
BOOST_ROUNDS, BOOST_STEP = 1000, 0.25
BOOST_SETTINGS = {"step": BOOST_STEP, "penalty": 0.01, "alpha": 0.1, "rows": 0.85, "columns": (0.3, 0.5), "parallel": 4}


def rf(features, seed=0, y="y", trees=RF_TREES, depth=30, bootstrap=True):
    return MlModel(
        RandomForestRegressor(numTrees=trees, featureSubsetStrategy=RF_FEATURES, maxDepth=depth, bootstrap=bootstrap, seed=seed),
        tuple(features), y,
    )


def xgb(features, seed=0, y="y", rounds=BOOST_ROUNDS, depth=6, **settings):
    """Boosted trees with penalties, row and column sampling and parallel trees."""
    return PenalisedBoost(tuple(features), y, rounds=rounds, depth=depth, seed=seed, **(BOOST_SETTINGS | settings))


def xgb_1tree(features, seed=0, y="y", rounds=BOOST_ROUNDS, depth=6):
    """Boosted trees without any sampling; its leaves feed the affinity variance."""
    return MlModel(GBTRegressor(maxIter=rounds, stepSize=BOOST_STEP, maxDepth=depth, seed=seed), tuple(features), y, MISSING)


def xgb_cla(features, seed=0, y="y", rounds=BOOST_ROUNDS, depth=6, **settings):
    """The same for a target of 0 and 1; predicts the class."""
    return PenalisedBoost(tuple(features), y, rounds=rounds, depth=depth, seed=seed, classify=True, **(BOOST_SETTINGS | settings))


def xgb_bandgap(features, seed=0, y="y", rounds=BOOST_ROUNDS, depth=6, **settings):
    return TwoStage(xgb_cla(features, seed, "nonzero", rounds, depth, **settings), xgb(features, seed, y, rounds, depth, **settings), y)


def linear(features, seed=0, y="y"):
    return MlModel(LinearRegression(), tuple(features), y)


REGISTRY: dict[str, Callable] = {
    "rf": rf, "xgb": xgb, "xgb_1tree": xgb_1tree, "xgb_cla": xgb_cla, "xgb_bandgap": xgb_bandgap, "linear": linear,
}


def model_by_name(name: str, features: Sequence[str], seed: int = 0, **settings):
    if name not in REGISTRY:
        raise ValueError(f"unknown model: {name}")
    return REGISTRY[name](features, seed, **settings)


def fit_scores(model: Model, df: DataFrame, split: str = "split", train: str = "train", y: str = "y") -> DataFrame:
    """Fit on the ``train`` split, score every other split."""
    fitted = model.fit(df.filter(F.col(split) == train))
    held_out = df.filter(F.col(split) != train)
    return score_models(held_out, {"m1": fitted}, y, split).drop("model")
