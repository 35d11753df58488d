"""Growing: iteratively add the rows a model knows least about."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.operators.affinity import choose_trees, topk_variance, weighted_variance
from winnow.operators.metrics import score_models
from winnow.operators.rank import batch_rule, cuts_for, ensemble_interval, first_k, hash_key
from winnow.operators.split import frac_sample, interval_number, quantile_seeds, seed_sample
from winnow.session import hold, materialise, observed
from winnow.sources.state import NOT_CHOSEN, RunState, write_iteration

ERR_DIGITS = 6


@dataclass
class GrowResult:
    """``curve(iter, model, train_ratio, maes, rmse, r2, train_size)`` on the test rows,
    ``pool_curve`` the same on the rows not yet chosen (where a policy scores them), and
    ``membership(id, iter_added, err)``, the start set being iteration 0."""

    curve: DataFrame
    membership: DataFrame
    pool_curve: DataFrame | None = None


def _curve(scores: DataFrame, sizes: DataFrame, n: int, split: str) -> DataFrame:
    return scores.filter(F.col("split") == split).join(F.broadcast(sizes), "iter").select(
        "iter", "model",
        F.round(F.col("train_size") / F.lit(n), 3).alias("train_ratio"),
        F.round("mae", 4).alias("maes"), F.round("rmse", 4).alias("rmse"), F.round("r2", 4).alias("r2"),
        "train_size",
    )


def step_sizes(n: int, step_frac: float, stop_frac: float, score_full: bool = False) -> list[int]:
    """Training sizes of a run: steps of int(n*step), the last one clamped, below n*stop.

    With ``stop_frac`` 1 the full set is not scored unless ``score_full`` asks for it.
    """
    step = max(1, int(n * step_frac))
    sizes = list(range(step, n, step)) + [n]
    kept = [s for s in sizes if s < n * stop_frac]
    if score_full and stop_frac >= 1 and kept[-1:] != [n]:
        kept.append(n)
    return kept


def grow_random(
    models: Mapping[str, object], pool: DataFrame, test: DataFrame, step_frac: float = 0.01, stop_frac: float = 1.0,
    seed: int = 0, score_full: bool = False, id_col: str = "id", y: str = "y",
) -> GrowResult:
    """Add int(step*n) random rows per round and score every model each round.

    All rounds are prefixes of one random order, so a single pass finds every round's
    cut and no state is carried.
    """
    n = pool.count()
    cuts, sizes = cuts_for(pool, seed, lambda rows: step_sizes(rows, step_frac, stop_frac, score_full), id_col, n)
    stepped = pool.withColumn("_step", interval_number(hash_key(seed, id_col), cuts))
    stepped = stepped.persist(StorageLevel.MEMORY_AND_DISK)
    scores, frame = None, test.withColumn("split", F.lit("test"))
    for batch in fitted_prefixes(models, stepped, "_step", len(sizes)):
        now = materialise(score_models(frame, {f"{i}:{name}": f for (name, i), f in batch.items()}, y))
        scores = now if scores is None else scores.unionByName(now)
    stepped.unpersist()
    parts = F.split("model", ":", 2)
    scores = scores.withColumn("iter", parts[0].cast("int")).withColumn("model", parts[1])
    frame = pool.sparkSession.createDataFrame(list(enumerate(sizes)), "iter int, train_size long")
    members = stepped.filter(F.col("_step") < len(sizes)).select(
        id_col, F.col("_step").alias("iter_added"), F.lit(None).cast("double").alias("err")
    )
    return GrowResult(_curve(scores, frame, n, "test"), members)


def fitted_prefixes(models: Mapping[str, object], df: DataFrame, step: str, n_steps: int) -> Iterator[dict]:
    """Every model fitted on ``step <= j`` for each j, as batches ``{(name, j): fitted}`` to be scored together.

    Models that fit all prefixes in one pass are small and come as one batch. Others come
    one by one, so that one at a time is held and scored, however many rounds there are.
    """
    closed = {name: model for name, model in models.items() if hasattr(model, "fit_prefixes")}
    together = {(name, j): f for name, model in closed.items() for j, f in enumerate(model.fit_prefixes(df, step, n_steps))}
    if together:
        yield together
    for name, model in models.items():
        if name not in closed:
            for j in range(n_steps):
                yield {(name, j): model.fit(df.filter(F.col(step) <= j).drop(step))}


def committee(fitted: Mapping[str, object], rest: DataFrame, train: DataFrame, _round: int) -> DataFrame:
    """Disagreement of the first two models."""
    first, second = list(fitted.values())[:2]
    both = second.transform(first.transform(rest).withColumnRenamed("prediction", "_p1"))
    return both.withColumn("err", F.round(F.abs(F.col("_p1") - F.col("prediction")), ERR_DIGITS))


def forest_spread(percentile: float = 90.0) -> Callable:
    """Distance between the percentiles of the first model's trees."""

    def score(fitted, rest, train, _round):
        preds = next(iter(fitted.values())).per_tree(rest)
        return ensemble_interval(preds, "preds", percentile).withColumn("err", F.round("uncertainty", ERR_DIGITS))

    return score


def leaf_affinity(
    model, tree_frac: float = 1.0, mode: str = "weighted", k: int = 100, seed: int = 0, id_col: str = "id", y: str = "y"
) -> Callable:
    """Variance of the target over training rows that share leaves, by a third model.

    ``mode="topk"`` looks at the k most similar training rows; ``"weighted"`` at all of
    them weighted by affinity, which stays linear in the data.
    """
    if mode not in ("weighted", "topk"):
        raise ValueError(f"unknown mode: {mode}")

    def score(_fitted, rest, train, round_no):
        third = model.fit(train)
        trees = choose_trees(len(third.model.trees), tree_frac, seed + round_no)
        val, known = third.leaves(rest), third.leaves(train)
        if mode == "weighted":
            spread_of = weighted_variance(val, known, trees, id_col, y)
        else:
            spread_of = topk_variance(val, known, k, trees, id_col, y)
        return spread_of.withColumn("err", F.round(F.coalesce("variance", F.lit(0.0)), ERR_DIGITS))

    return score


def grow_by_uncertainty(
    models: Mapping[str, object],
    pool: DataFrame,
    test: DataFrame,
    uncertainty: Callable,
    step_frac: float = 0.01,
    stop_frac: float = 1.0,
    seed: int = 0,
    score_full: bool = False,
    max_rounds: int | None = None,
    run_dir: str | None = None,
    resume: bool = True,
    curve_path: str | None = None,
    run_id: str = "run",
    id_col: str = "id",
    y: str = "y",
) -> GrowResult:
    """Start at random, then add the int(step*n) most uncertain rows per round.

    ``uncertainty(fitted, rest, train, round)`` returns the rest rows with a column
    ``err``; the models already fitted for scoring are passed in, not fitted again. Rows
    whose ``err`` is null are not chosen, so a round may choose fewer than asked for.
    With ``curve_path`` each round's rows of the curve are written there under ``run_id``.
    """
    n = pool.count()
    base = hold(pool, id_col, n)
    sizes = step_sizes(n, step_frac, stop_frac, score_full)[:max_rounds]
    settings = {"models": models, "uncertainty": uncertainty, "step_frac": step_frac, "seed": seed, "y": y}
    state = RunState.open(pool, run_dir, id_col, resume, settings, {"pool": pool, "test": test})
    history = state.done() if resume else []
    if history and history[-1]["n_chosen"] == NOT_CHOSEN and len(history) - 1 < len(sizes):
        history.pop()  # the run goes on: its last round is done again and chooses
    test = test.withColumn("split", F.lit("test")).persist(StorageLevel.MEMORY_AND_DISK)
    if not history and sizes:
        start = seed_sample(base, sizes[0], seed, id_col, n).withColumn("err", F.lit(None).cast("double"))
        history = [state.commit(0, start, 0, sizes[0], None)]
    trained = [sum(max(h["n_chosen"], 0) for h in history[: r + 1]) for r in range(len(history))]
    for r in range(len(history) - 1, len(sizes)):
        known = hold(state.members(r + 1).select(id_col, F.lit(True).alias("_known")), id_col, n)
        try:
            tagged = base.join(known, id_col, "left")
            train = tagged.filter("_known").drop("_known")
            rest = tagged.filter(F.col("_known").isNull()).drop("_known")
            fitted = {name: model.fit(train) for name, model in models.items()}
            scores = score_models(test, fitted, y)
            batch = min(sizes[0], n - trained[r])
            if r + 1 < len(sizes) and batch > 0:
                rated, seen = observed(uncertainty(fitted, rest, train, r).select(id_col, "err").dropna(subset=["err"]), n=F.count(F.lit(1)))
                n_rated = seen["n"]
                chosen = rated.filter(first_k(rated, ["-err", id_col], batch, n_rated).column())
                history.append(state.commit(r + 1, chosen, trained[r], min(batch, n_rated), scores))
            else:
                none = base.select(id_col, F.lit(0.0).alias("err")).limit(0)
                history.append(state.commit(r + 1, none, trained[r], NOT_CHOSEN, scores))
            trained.append(trained[r] + max(history[-1]["n_chosen"], 0))
            if curve_path is not None:
                size = pool.sparkSession.createDataFrame([(r, trained[r])], "iter int, train_size long")
                now = state.scores(r + 2).filter(F.col("iter") == r + 1).withColumn("iter", F.col("iter") - 1)
                write_iteration(_curve(now, size, n, "test").drop("iter"), curve_path, run_id, r)
        finally:
            known.unpersist()
    base.unpersist()
    test.unpersist()
    rounds = len(sizes)
    # scores of round r are committed together with the batch it chose
    scores = state.scores(rounds + 1).withColumn("iter", F.col("iter") - 1)
    frame = pool.sparkSession.createDataFrame(list(enumerate(trained[:rounds])), "iter int, train_size long")
    members = state.members(rounds + 1).select(id_col, F.col("iter").alias("iter_added"), "err")
    return GrowResult(_curve(scores, frame, n, "test"), members)


def grow_committee(models, pool, test, **settings) -> GrowResult:
    """Add the rows the two models disagree on most."""
    return grow_by_uncertainty(models, pool, test, committee, **settings)


def grow_rf_uncertainty(models, pool, test, percentile: float = 90.0, **settings) -> GrowResult:
    """Add the rows on which the trees of the first model (a forest) spread most."""
    return grow_by_uncertainty(models, pool, test, forest_spread(percentile), **settings)


def grow_leaf_affinity(
    models, pool, test, affinity_model, tree_frac: float = 1.0, mode: str = "weighted", k: int = 100, **settings
) -> GrowResult:
    """Add the rows with the largest leaf-affinity variance under a third model."""
    keys = {c: settings[c] for c in ("id_col", "y") if c in settings}
    rule = leaf_affinity(affinity_model, tree_frac, mode, k, settings.get("seed", 0), **keys)
    return grow_by_uncertainty(models, pool, test, rule, **settings)


def grow_by_error(
    model,
    pool: DataFrame,
    test: DataFrame,
    n_iter: int = 50,
    subsample: float = 1.0,
    batch_sizes: Sequence[int] | None = None,
    criterion: str = "max_err",
    val: DataFrame | str | None = None,
    run_dir: str | None = None,
    resume: bool = True,
    curve_path: str | None = None,
    run_id: str = "run",
    id_col: str = "id",
    y: str = "y",
) -> GrowResult:
    """Start at quantiles of the target, then add the rows with the largest or smallest error.

    Round r scores the test rows and all rows not chosen, and takes ``batch_sizes[r]``
    of a ``subsample`` drawn with seed r; entry 0 also sizes the start set. ``val`` is
    handed to models whose ``fit`` takes it (``"pool"``: the rows not chosen). Ends
    when a batch would exceed the pool. With ``curve_path`` each round's row of the test curve is written there under ``run_id``.
    """
    pick = batch_rule(criterion)
    n = pool.count()
    base = hold(pool, id_col, n)
    sizes = list(batch_sizes) if batch_sizes else [max(1, n // n_iter)] * (n_iter + 1)
    settings = {"model": model, "subsample": subsample, "batch": sizes[0], "criterion": criterion, "val": val if isinstance(val, str) else val is not None, "y": y}
    state = RunState.open(pool, run_dir, id_col, resume, settings, {"pool": pool, "test": test} | ({"val": val} if isinstance(val, DataFrame) else {}))
    history = state.done() if resume else []
    test = test.withColumn("split", F.lit("test")).persist(StorageLevel.MEMORY_AND_DISK)
    if not history:
        start, seen = observed(quantile_seeds(base, y, sizes[0], id_col).withColumn("err", F.lit(None).cast("double")), n=F.count(F.lit(1)))
        history = [state.commit(0, start, 0, seen["n"], None)]
    n_train = sum(max(h["n_chosen"], 0) for h in history)
    trained = [0]
    for h in history:
        trained.append(trained[-1] + max(h["n_chosen"], 0))
    ended = history[-1]["n_chosen"] == NOT_CHOSEN
    for r in range(len(history) - 1, len(sizes)):
        if ended:
            break
        known = hold(state.members(r + 1).select(id_col, F.lit(True).alias("_known")), id_col, n)
        try:
            tagged = base.join(known, id_col, "left")
            train = tagged.filter("_known").drop("_known")
            rest = tagged.filter(F.col("_known").isNull()).drop("_known")
            if val is None:
                fitted = model.fit(train)
            else:
                fitted = model.fit(train, val=rest if isinstance(val, str) else val)
            frame = test.select(*rest.columns, "split").unionByName(rest.withColumn("split", F.lit("pool")))
            scores = score_models(frame, {"m1": fitted}, y)
            ended = n_train + sizes[r] > n
            if ended:
                chosen, n_chosen = base.select(id_col, F.lit(0.0).alias("err")).limit(0), NOT_CHOSEN
            else:
                candidates = fitted.transform(frac_sample(rest, subsample, r, id_col))
                rated, seen = observed(
                    candidates.select(id_col, F.round(F.abs(F.col("prediction") - F.col(y)), ERR_DIGITS).alias("err")), n=F.count("err")
                )
                n_chosen = min(sizes[r], seen["n"])
                chosen = pick(rated, "err", n_chosen, id_col)
            state.commit(r + 1, chosen, n_train, n_chosen, scores)
            if curve_path is not None:
                size = pool.sparkSession.createDataFrame([(r, n_train)], "iter int, train_size long")
                now = state.scores(r + 2).filter(F.col("iter") == r + 1).withColumn("iter", F.col("iter") - 1)
                write_iteration(_curve(now, size, n, "test").drop("iter"), curve_path, run_id, r)
            n_train += max(n_chosen, 0)
            trained.append(n_train)
        finally:
            known.unpersist()
    base.unpersist()
    test.unpersist()
    rounds = len(trained) - 1
    scores = state.scores(rounds).withColumn("iter", F.col("iter") - 1)
    frame = pool.sparkSession.createDataFrame(
        [(i, size) for i, size in enumerate(trained[1:])], "iter int, train_size long"
    )
    members = state.members(rounds).select(id_col, F.col("iter").alias("iter_added"), "err")
    return GrowResult(_curve(scores, frame, n, "test"), members, _curve(scores, frame, n, "pool"))
