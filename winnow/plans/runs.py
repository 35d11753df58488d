"""Random baselines and grids of runs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor, wait

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.operators.metrics import regression_scores, score_columns, stacked_predictions
from winnow.operators.rank import global_rank
from winnow.operators.split import TRAIN_FRACTIONS, load_pruned, nested_sizes
from winnow.plans.grow import (
    fitted_prefixes, grow_by_error, grow_committee, grow_leaf_affinity, grow_random, grow_rf_uncertainty,
)
from winnow.plans.prune import prune
from winnow.session import materialise
from winnow.sources.features import write_score_files


def _baseline_scores(frame: DataFrame, batch: Mapping, fractions: Sequence[float], sizes: Sequence[int], seed: int, y: str) -> DataFrame:
    """Scores of the fitted models ``{(name, fraction number): fitted}`` on test and unused rows, in one pass."""
    cells = F.array(*[
        F.struct(F.lit(name).alias("model"), F.lit(j).alias("j"), F.lit(float(fractions[j])).alias("train_size"),
                 F.lit(sizes[j]).cast("long").alias("n_train"))
        for name, j in batch
    ])
    scored = regression_scores(
        stacked_predictions(frame, list(batch.values()), ["step", y])
        .withColumn("_cell", F.get(cells, "_m"))
        .withColumn("_side", F.when(F.col("step").isNull(), "test").when(F.col("step") > F.col("_cell.j"), "val"))
        .filter(F.col("_side").isNotNull()),
        "prediction", y, ["_m", "_side"],
    )
    sides = []
    for suffix, side in (("", "test"), ("_val", "val")):
        for metric, column in (("mae", "maes"), ("rmse", "rmse"), ("r2", "r2")):
            sides.append(F.max(F.when(F.col("_side") == side, F.col(metric))).alias(column + suffix))
    return scored.groupBy("_m").agg(*sides).withColumn("_cell", F.get(cells, "_m")).select(
        "_cell.model", F.lit(seed).alias("seed"), "_cell.train_size", "_cell.n_train",
        "maes", "rmse", "r2", "maes_val", "rmse_val", "r2_val",
    )


def random_baseline(
    models: Mapping[str, object], pool: DataFrame, test: DataFrame, seeds: Sequence[int],
    fractions: Sequence[float] = TRAIN_FRACTIONS, order: Sequence[str] | None = None, id_col: str = "id", y: str = "y",
    save_to: str | None = None,
) -> DataFrame:
    """For every seed and training fraction: scores on the test rows and on the unused rest.

    Columns: model, seed, train_size (the fraction), n_train, maes, rmse, r2, maes_val,
    rmse_val, r2_val. The training sets of one seed are nested, so a seed needs one
    draw and one scoring pass however many fractions it has. With ``order`` nothing is
    drawn: the first int(f*n) rows in that order train. With ``save_to`` the scores of each
    model and seed are written there as score files as soon as the seed is done.
    """
    out = None
    for seed in seeds:
        if order is None:
            stepped, sizes = nested_sizes(pool, seed, fractions, id_col)
        else:
            n = pool.count()
            sizes = [int(f * n) for f in fractions]
            step = F.size(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s < F.col("_rank")))
            stepped = global_rank(pool, order, "_rank").withColumn("step", step).drop("_rank")
        stepped = stepped.persist(StorageLevel.MEMORY_AND_DISK)
        # test rows count for every size, pool rows only for sizes that left them out
        frame = test.withColumn("step", F.lit(None).cast("int")).select(*stepped.columns).unionByName(stepped)
        rows = None
        for batch in fitted_prefixes(models, stepped, "step", len(fractions)):
            now = materialise(_baseline_scores(frame, batch, fractions, sizes, seed, y))
            rows = now if rows is None else rows.unionByName(now)
        stepped.unpersist()
        if save_to is not None:
            for name in models:
                write_score_files(rows.filter(F.col("model") == name), save_to, name, seed)
        out = rows if out is None else out.unionByName(rows)
    return out


def train_on_pruned(model, pool: DataFrame, test: DataFrame, ranking: DataFrame, frac: float, id_col="id", y="y") -> DataFrame:
    """Scores of a model trained on the most informative int(frac*N) rows only."""
    small = load_pruned(pool, ranking, frac, id_col)
    s = score_columns("prediction", y)
    return model.fit(small).transform(test).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in s.items()])


def pending_runs(grid: DataFrame, done: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """Runs of the grid that have no result yet; all of them when forced."""
    return grid if force else grid.join(done.select(*keys).distinct(), list(keys), "left_anti")


CRITERIA: dict[str, Callable] = {
    "random": grow_random,
    "committee": grow_committee,
    "rf_uncertainty": grow_rf_uncertainty,
    "leaf_affinity": grow_leaf_affinity,
    "error": grow_by_error,
    "prune": prune,
}


def run_criterion(name: str, *args, **settings):
    if name not in CRITERIA:
        raise ValueError(f"unknown criterion: {name}")
    return CRITERIA[name](*args, **settings)


def run_grid(runs: Sequence[Mapping], start: Callable, parallel: int = 2) -> list:
    """Do independent runs side by side: ``start(**entry)`` for each entry of the short grid, results in its order.

    Every run has a job group and a scheduler pool of its own, which threads that it starts with
    ``inheritable_thread_target`` share; with ``spark.scheduler.mode`` FAIR the pools take turns. When a run fails, the jobs
    it left behind are cancelled, and only those; runs that go on finish, no new one begins, and the error is raised.
    """
    for entry in runs:
        if "criterion" in entry and entry["criterion"] not in CRITERIA:
            raise ValueError(f"unknown criterion: {entry['criterion']}")
    sc, name = SparkSession.active().sparkContext, f"grid-{uuid.uuid4().hex}"
    failed = threading.Event()

    def one(number: int, entry: Mapping):
        if failed.is_set():
            return None
        group = f"{name}-{number}"
        sc.setJobGroup(group, f"run {number}: {dict(entry)}", interruptOnCancel=True)
        sc.setLocalProperty("spark.scheduler.pool", group)
        try:
            return start(**entry)
        except BaseException:
            failed.set()
            sc.cancelJobGroup(group)
            raise
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)
            sc.setLocalProperty("spark.jobGroup.id", None)

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        tasks = [pool.submit(inheritable_thread_target(one), i, entry) for i, entry in enumerate(runs)]
        wait(tasks)
    errors = [t.exception() for t in tasks if t.exception() is not None]
    if errors:
        raise errors[0]
    return [t.result() for t in tasks]
