import pytest
from pyspark.sql import functions as F

from winnow.operators.models import GroupMean, Ols1
from winnow.plans import grow as G
from winnow.plans import prune as P
from winnow.plans import runs as R
from winnow.plans.prune import prune


@pytest.fixture
def data(rows):
    rows = rows.persist()
    return rows.filter("id % 4 <> 0"), rows.filter("id % 4 = 0")


def chosen(result):
    return sorted(map(tuple, result.proposed.select("iter", "id", "err").collect()))


def test_resume_equals_uninterrupted(data, tmp_path):
    pool, test = data
    settings = dict(threshold=0.4, train_size=0.6, min_remaining=5)
    whole = prune(Ols1("x"), pool, test, **settings, max_iter=4)
    folder = str(tmp_path / "run")
    for stop in (1, 2, 4):
        part = prune(Ols1("x"), pool, test, **settings, max_iter=stop, run_dir=folder)
    assert chosen(part) == chosen(whole)
    key = ["iter", "split", "model"]
    assert part.scores.orderBy(*key).collect() == whole.scores.orderBy(*key).collect()


def test_uncommitted_iteration_is_redone(spark, data, tmp_path):
    pool, test = data
    folder = str(tmp_path / "run")
    settings = dict(threshold=0.4, train_size=0.6, min_remaining=5, max_iter=3)
    first = chosen(prune(Ols1("x"), pool, test, **{**settings, "max_iter": 1}, run_dir=folder))
    # members written, scores not: a run that died in between
    spark.createDataFrame([(1, 0.0)], "id long, err double").write.parquet(f"{folder}/attempt=0/members/iter=1")
    again = prune(Ols1("x"), pool, test, **settings, run_dir=folder)
    assert chosen(again) == chosen(prune(Ols1("x"), pool, test, **settings))
    assert chosen(again)[: len(first)] == first


def test_membership_only_grows_and_fixed_rows_stay(data):
    pool, test = data
    fixed = pool.filter("t = 0")
    free = pool.filter("t <> 0")
    result = prune(Ols1("x"), free, test, 0.3, 0.5, max_iter=4, min_remaining=5, fixed_train=fixed)
    removed = [r["id"] for r in result.proposed.collect()]
    assert len(removed) == len(set(removed))
    assert not set(removed) & {r["id"] for r in fixed.collect()} and not set(removed) & {r["id"] for r in test.collect()}


def test_min_drop_fallback_and_zero(data):
    pool, test = data
    out = prune(Ols1("x"), pool, test, -1.0, 0.8, max_iter=2, min_drop=7, min_remaining=5)
    assert [r["count"] for r in out.proposed.groupBy("iter").count().orderBy("iter").collect()] == [7, 7]
    out = prune(Ols1("x"), pool, test, -1.0, 0.8, max_iter=2, min_drop=0, min_remaining=5)
    assert out.proposed.count() == 0 and out.n_iter == 2


def test_drop_max_err_counts_each_row_once(data):
    pool, test = data
    out = prune(Ols1("x"), pool, test, 100.0, 0.8, max_iter=1, drop_max_err=10, min_remaining=5)
    n = pool.count()
    assert out.proposed.count() == n - int(0.8 * n)


def test_stop_rule_and_last_choice_not_applied(data):
    pool, test = data
    n = pool.count()
    out = prune(Ols1("x"), pool, test, 100.0, 0.5, max_iter=10, min_remaining=n // 2 + 1)
    assert out.stopped and out.n_iter == 0 and out.membership.filter("iter_removed is not null").count() == 0
    out = prune(Ols1("x"), pool, test, 0.3, 0.5, max_iter=2, min_remaining=5)
    assert {r["iter_removed"] for r in out.membership.collect()} == {None, 0}
    assert sorted(r["rank"] for r in out.ranking().collect()) == list(range(1, n + 1))


def test_join_model_needs_both(data):
    pool, test = data
    one = prune(Ols1("x"), pool, test, 0.5, 0.5, max_iter=1, min_remaining=5, min_drop=0)
    both = prune(Ols1("x"), pool, test, 0.5, 0.5, max_iter=1, min_remaining=5, min_drop=0,
                 model_test=GroupMean("t"), join_model=True, threshold2=0.5)
    assert {r["id"] for r in both.proposed.collect()} < {r["id"] for r in one.proposed.collect()}
    with pytest.raises(ValueError):
        prune(Ols1("x"), pool, test, 0.5, 0.5, join_model=True)


def test_without_retrain(data):
    pool, test = data
    out = prune(Ols1("x"), pool, test, 0.3, 0.5, max_iter=1, min_remaining=5, retrain=False)
    assert out.scores.count() == 1


@pytest.mark.parametrize("n,step,stop,full,want", [
    (100, 0.25, 1.0, False, [25, 50, 75]), (100, 0.25, 1.0, True, [25, 50, 75, 100]), (100, 0.3, 0.6, False, [30]),
    (10, 0.01, 0.3, False, [1, 2]), (10, 0.5, 2.0, False, [5, 10]),
])
def test_step_sizes(n, step, stop, full, want):
    assert G.step_sizes(n, step, stop, full) == want


def test_random_growth_is_nested(data):
    pool, test = data
    out = G.grow_random({"m": Ols1("x")}, pool, test, step_frac=0.2)
    n = pool.count()
    sizes = [r["train_size"] for r in out.curve.orderBy("iter").collect()]
    assert sizes == [int(n * 0.2) * k for k in range(1, 6) if int(n * 0.2) * k < n]
    counts = dict(out.membership.groupBy("iter_added").count().collect())
    assert set(counts.values()) == {int(n * 0.2)}


def test_committee_resume(data, tmp_path):
    pool, test = data
    models = {"a": Ols1("x"), "b": GroupMean("t")}
    whole = G.grow_committee(models, pool, test, step_frac=0.1, max_rounds=3)
    folder = str(tmp_path / "run")
    G.grow_committee(models, pool, test, step_frac=0.1, max_rounds=2, run_dir=folder)
    resumed = G.grow_committee(models, pool, test, step_frac=0.1, max_rounds=3, run_dir=folder)
    for part in ("membership", "curve"):
        assert sorted(map(tuple, getattr(resumed, part).collect()), key=str) == sorted(map(tuple, getattr(whole, part).collect()), key=str)
    again = G.grow_committee(models, pool, test, step_frac=0.1, max_rounds=3, run_dir=folder)
    assert again.membership.count() == whole.membership.count()
    with pytest.raises(ValueError):
        G.grow_committee(models, pool.limit(50), test, step_frac=0.1, max_rounds=3, run_dir=folder)
    ids = [r["id"] for r in whole.membership.collect()]
    assert len(ids) == len(set(ids)) == 3 * int(0.1 * pool.count())


def test_error_growth_ends_at_the_pool(data):
    pool, test = data
    n = pool.count()
    out = G.grow_by_error(Ols1("x"), pool, test, batch_sizes=[n // 2, n // 3, n // 3])
    sizes = [r["train_size"] for r in out.curve.orderBy("iter").collect()]
    assert sizes[0] <= n // 2 and all(s <= n for s in sizes)
    assert out.pool_curve.count() == len(sizes)
    with pytest.raises(ValueError):
        G.grow_by_error(Ols1("x"), pool, test, criterion="both")


def test_validation_rows_reach_the_model(data):
    pool, test = data
    seen = []

    class Watching(Ols1):
        def fit(self, df, val=None):
            seen.append(val.count())
            return super().fit(df)

    G.grow_by_error(Watching("x"), pool, test, batch_sizes=[20], val="pool")
    assert seen[0] == pool.count() - 20


def test_baseline_without_shuffle(data):
    pool, test = data
    out = R.random_baseline({"m": Ols1("x")}, pool, test, [0], [0.3, 0.6], order=["t", "id"]).orderBy("train_size").collect()
    first = sorted((r["t"], r["id"], r["x"], r["y"]) for r in pool.collect())[: out[0]["n_train"]]
    assert out[0]["n_train"] == int(0.3 * pool.count())
    import numpy as np

    slope, icpt = np.polyfit([r[2] for r in first], [r[3] for r in first], 1)
    want = np.mean([abs(icpt + slope * r["x"] - r["y"]) for r in test.collect()])
    assert abs(out[0]["maes"] - want) < 1e-4


def test_grid(spark):
    grid = spark.createDataFrame([("a", 1), ("b", 1)], "k string, s int")
    done = spark.createDataFrame([("a", 1)], "k string, s int")
    assert R.pending_runs(grid, done, ["k", "s"]).collect() == [("b", 1)]
    assert R.pending_runs(grid, done, ["k", "s"], force=True).count() == 2
    assert R.run_grid([{"criterion": "random", "seed": 1}, {"criterion": "prune", "seed": 2}], lambda criterion, seed: (criterion, seed)) == [
        ("random", 1), ("prune", 2)]
    with pytest.raises(ValueError):
        R.run_grid([{"criterion": "nothing"}], lambda **k: None)
    with pytest.raises(ValueError):
        R.run_criterion("nothing")


def test_a_failing_run_ends_its_own_jobs_only(spark):
    """Run 0 fails while a job of its own still runs; that job is cancelled, run 1's job goes on, run 2 does not begin."""
    import threading
    import time

    from pyspark import inheritable_thread_target

    seen, started = {}, []

    def slow(seconds):
        def wait(batches):
            time.sleep(seconds)
            yield from batches

        return spark.range(1).mapInArrow(wait, "id long").count()

    def aside():
        try:
            seen["aside"] = slow(60)
        except Exception as err:  # noqa: BLE001
            seen["aside"] = type(err).__name__

    def start(number):
        started.append(number)
        if number == 0:
            thread = threading.Thread(target=inheritable_thread_target(aside))
            thread.start()
            seen["thread"] = thread
            time.sleep(3)
            raise KeyError("run 0")
        seen[number] = slow(8)

    begin = time.time()
    with pytest.raises(KeyError):
        R.run_grid([{"number": i} for i in range(3)], start, parallel=2)
    seen["thread"].join(30)
    assert time.time() - begin < 40
    assert seen["aside"] not in (None, 1) and seen[1] == 1 and sorted(started) == [0, 1]
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_missing_features_do_not_break_scores(data):
    pool, test = data
    holes = F.when(F.col("id") % 10 > 0, F.col("x"))
    out = G.grow_random({"m": Ols1("x")}, pool.withColumn("x", holes), test.withColumn("x", holes), step_frac=0.5)
    assert out.curve.filter("maes is null").count() == 0


def test_pruning_goes_on_over_missing_features(data):
    """Rows without a prediction have no error: they are never chosen, and the others are, each time."""
    pool, test = data
    gaps = pool.withColumn("x", F.when(F.col("id") % 10 > 0, F.col("x")))
    out = prune(Ols1("x"), gaps, test, 1e-9, 0.5, min_drop=5, max_iter=4, min_remaining=5)
    counts = dict(out.proposed.groupBy("iter").count().collect())
    assert counts == {0: 5, 1: 5, 2: 5, 3: 5} and out.proposed.filter("id % 10 = 0").count() == 0
    empty = prune(Ols1("x"), pool.withColumn("x", F.when(F.col("id") < 0, F.col("x"))), test, 0.1, 0.5, min_drop=5, max_iter=50)
    assert empty.stopped and empty.n_iter == 0


def test_a_fresh_run_in_an_old_folder(data, tmp_path):
    pool, test = data
    settings = dict(threshold=0.3, train_size=0.5, min_remaining=5, min_drop=5)
    folder = str(tmp_path / "run")
    whole = prune(Ols1("x"), pool, test, **settings, max_iter=4)
    prune(Ols1("x"), pool, test, **settings, max_iter=4, run_dir=folder)
    prune(Ols1("x"), pool, test, **settings, max_iter=1, run_dir=folder, resume=False)
    again = prune(Ols1("x"), pool, test, **settings, max_iter=4, run_dir=folder)
    assert sorted(map(tuple, again.proposed.collect())) == sorted(map(tuple, whole.proposed.collect()))
    with pytest.raises(ValueError):
        prune(Ols1("x"), pool, test, **{**settings, "threshold": 0.2}, max_iter=4, run_dir=folder)


def test_a_long_run_makes_its_table_smaller(data, monkeypatch):
    """Scores and choices are those of a run that keeps all rows in hand."""
    pool, test = data
    settings = dict(threshold=1.0, train_size=0.4, min_remaining=5, max_iter=6)
    sizes, real = [], P.hold
    monkeypatch.setattr(P, "hold", lambda df, key, rows: sizes.append(rows) or real(df, key, rows))
    short = prune(Ols1("x"), pool, test, **settings)
    assert min(sizes) <= pool.count() // 2
    monkeypatch.setattr(P, "hold", lambda df, key, rows: real(df, key, rows))
    whole = []
    n = pool.count()
    for r in short.scores.filter("split = 'removed'").orderBy("iter").collect():
        whole.append(r["n"])
    gone = {r["iter"]: r["count"] for r in short.proposed.groupBy("iter").count().collect()}
    assert whole == [sum(gone[j] for j in range(i)) for i in range(1, len(gone))] and sum(gone.values()) > n // 2
