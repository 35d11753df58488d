"""Pruning: iteratively remove rows whose label the model already predicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.operators.metrics import prune_curve, score_columns, score_models
from winnow.operators.rank import first_k, hash_cuts, hash_key, redundancy_ranking
from winnow.operators.split import train_rows
from winnow.session import hold, observed
from winnow.sources.state import RunState

#: fixed values: iterations at most, and rows that must remain
MAX_ITER, MIN_REMAINING = 2000, 300
#: errors are compared after rounding, so tied copies are ordered by id everywhere
ERR_DIGITS = 6


@dataclass
class PruneResult:
    """``membership(id, iter_removed, err)``: null ``iter_removed`` for kept rows.
    ``proposed(id, iter, err)``: every iteration's choice, the last one included even
    where the run ended before applying it. ``scores(iter, split, model, n, mae, rmse,
    r2)`` with splits ``test`` and ``removed``; ``curve``: sizes per iteration."""

    membership: DataFrame
    proposed: DataFrame
    scores: DataFrame
    curve: DataFrame
    stopped: bool
    n_iter: int

    def ranking(self) -> DataFrame:
        return redundancy_ranking(self.membership)


def prune_threshold(model, pool: DataFrame, test: DataFrame, y: str = "y") -> float:
    """Half the mean absolute error of a model fitted on the full pool."""
    scored = model.fit(pool).transform(test)
    return scored.agg(F.round(score_columns("prediction", y)["mae"] / 2, ERR_DIGITS)).first()[0]


def prune(
    model,
    pool: DataFrame,
    test: DataFrame,
    threshold: float,
    train_size: float,
    *,
    min_drop: int | None = None,
    max_iter: int = MAX_ITER,
    drop_max_err: int | None = None,
    model_test=None,
    join_model: bool = False,
    threshold2: float | None = None,
    fixed_train: DataFrame | None = None,
    retrain: bool = True,
    min_remaining: int = MIN_REMAINING,
    run_dir: str | None = None,
    resume: bool = True,
    id_col: str = "id",
    y: str = "y",
) -> PruneResult:
    """Remove rows that are predicted within ``threshold`` from the remaining others.

    Iteration i splits what remains by a draw with seed i, fits on ``train_size`` of it
    and looks at the errors on the rest. Rows under the threshold go; when fewer than
    ``min_drop`` (default 1 % of the pool) would go, the ``min_drop`` smallest errors go
    instead; ``drop_max_err`` adds the largest ones. With ``join_model`` both models must
    be within their own threshold, and the fallback and ``drop_max_err`` follow the
    second model's errors. The run ends when fewer than ``min_remaining`` rows would
    remain, or when no row has an error; the rows chosen by an ending iteration are proposed
    but not removed. A row without a prediction has no error and stays.

    The pool is partitioned and sorted by id once. An iteration brings the ids removed
    so far into the same order (only these move), so its passes merge the two without a
    shuffle, and everything chosen is a comparison with a few numbers: no id list
    reaches the driver. When half of the table in hand is gone, the rest is held anew, so
    late iterations of a long run cost what is left; removed rows are only scored.
    """
    if join_model and (model_test is None or threshold2 is None):
        raise ValueError("join_model needs model_test and threshold2")
    n_pool = pool.count()
    base, test = hold(pool, id_col, n_pool), test.persist(StorageLevel.MEMORY_AND_DISK)
    if min_drop is None:
        min_drop = n_pool // 100
    settings = {
        "model": model, "threshold": threshold, "train_size": train_size, "min_drop": min_drop, "drop_max_err": drop_max_err,
        "model_test": model_test, "join_model": join_model, "threshold2": threshold2, "retrain": retrain, "min_remaining": min_remaining, "y": y,
    }
    tables = {"pool": pool, "test": test} | ({"fixed_train": fixed_train} if fixed_train is not None else {})
    state = RunState.open(pool, run_dir, id_col, resume, settings, tables)
    history = state.done() if resume else []
    removed_so_far = sum(h["n_chosen"] for h in history)
    start, stopped, i = len(history), False, len(history)

    def with_fixed(df: DataFrame) -> DataFrame:
        return df if fixed_train is None else df.unionByName(fixed_train.select(*df.columns))

    # rows removed before the table in hand was last made smaller, and the size of that table
    archive, n_base, held = None, n_pool, [base]
    for i in range(start, max_iter):
        gone_ids = hold(state.members(i).select(id_col, F.lit(True).alias("_removed")), id_col, n_base) if i else None
        try:
            tagged = base.join(gone_ids, id_col, "left") if i else base.withColumn("_removed", F.lit(None).cast("boolean"))
            remaining = tagged.filter(F.col("_removed").isNull()).drop("_removed")
            n_remaining = n_pool - removed_so_far
            if n_remaining <= n_base // 2:
                left = tagged.filter("_removed").drop("_removed").persist(StorageLevel.MEMORY_AND_DISK)
                smaller = hold(remaining, id_col, n_remaining)
                left.count(), smaller.count()  # both stand before the table they come from is released
                held += [left, smaller]
                archive = left if archive is None else archive.unionByName(left)
                base.unpersist()
                base, n_base = smaller, n_remaining
                remaining, tagged = base, base.withColumn("_removed", F.lit(None).cast("boolean"))
            (cut,) = hash_cuts(remaining, i, [train_rows(train_size, n_remaining)], id_col, n_remaining)
            in_train = hash_key(i, id_col) <= cut
            train, fresh = remaining.filter(in_train), remaining.filter(~in_train)

            def error(prediction: str):
                return F.round(F.abs(F.col(prediction) - F.col(y)), ERR_DIGITS)

            fitted = model.fit(with_fixed(train))
            errors = fitted.transform(fresh).withColumn("err", error("prediction")).drop("prediction")
            keep = [id_col, "err"]
            is_small = F.col("err") < F.lit(threshold)
            driving = "err"
            if join_model:
                second = model_test.fit(with_fixed(train))
                errors = second.transform(errors).withColumn("err2", error("prediction"))
                is_small = is_small & (F.col("err2") < F.lit(threshold2))
                keep, driving = [id_col, "err", "err2"], "err2"
            errors, seen = observed(errors.select(*keep), n_small=F.count_if(is_small), n_err=F.count(driving))
            choice, n_chosen = is_small, seen["n_small"]
            if n_chosen < min_drop:
                choice, n_chosen = first_k(errors, [driving, id_col], min_drop, seen["n_err"]).column(), min(min_drop, seen["n_err"])
            if drop_max_err:
                choice = choice | first_k(errors, [f"-{driving}", id_col], drop_max_err, seen["n_err"]).column()
            chosen = errors.filter(choice).select(id_col, F.col(driving).alias("err"))
            if drop_max_err:  # the two choices may overlap
                n_chosen = chosen.count()
            # where no row has an error (a feature is missing everywhere) no iteration will choose any
            if n_chosen > n_remaining - min_remaining or (n_chosen == 0 and min_drop > 0):
                stopped = True
                break
            final = model.fit(with_fixed(remaining)) if retrain else fitted
            models = {"m1": final}
            if model_test is not None:
                models["m2"] = model_test.fit(with_fixed(remaining))
            frame = test.withColumn("split", F.lit("test"))
            if i:
                gone = tagged.filter(F.col("_removed")).drop("_removed")
                gone = (gone if archive is None else gone.unionByName(archive)).withColumn("split", F.lit("removed"))
                frame = frame.select(*gone.columns).unionByName(gone)
            history.append(state.commit(i, chosen, n_remaining, n_chosen, score_models(frame, models, y)))
            removed_so_far += n_chosen
        finally:
            if gone_ids is not None:
                gone_ids.unpersist()

    for table in held:
        table.unpersist()
    test.unpersist()
    n_iter = len(history)
    proposed = state.members(n_iter)
    applied = proposed if stopped else proposed.filter(F.col("iter") < n_iter - 1)
    membership = pool.select(id_col).join(
        applied.select(id_col, F.col("iter").alias("iter_removed"), "err"), id_col, "left"
    )
    sizes = pool.sparkSession.createDataFrame(
        [(h["iter"], n_pool - h["n_before"]) for h in history], "iter int, n_removed long"
    )
    return PruneResult(
        membership, proposed, state.scores(n_iter), prune_curve(sizes, n_pool), stopped, n_iter
    )


def guided_prune(guide, guided, pool: DataFrame, test: DataFrame, train_size: float = 0.8, **settings) -> PruneResult:
    """Prune by the ``guide`` at half its own error, and watch how ``guided`` fares on what is left."""
    y = settings.get("y", "y")
    return prune(guide, pool, test, prune_threshold(guide, pool, test, y), train_size, model_test=guided, **settings)
