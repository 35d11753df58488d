"""Exact-size, reproducible splits and samples.

Every random draw is a prefix of the order by ``md5(seed:id)``; only the cut hash is
computed by a job, and the split itself is a comparison on each row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.operators.rank import cuts_for, first_k, global_rank, hash_cuts, hash_key


def test_rows(frac: float, n: int) -> int:
    return math.ceil(frac * n)


def train_rows(frac: float, n: int) -> int:
    return math.floor(frac * n)


test_rows.__test__ = False


def random_split(
    df: DataFrame,
    seed: int,
    test_frac: float | None = None,
    train_frac: float | None = None,
    id_col: str = "id",
) -> DataFrame:
    """Add ``split``: ``test`` holds ceil(f*n) rows, or ``train`` holds floor(f*n) rows."""
    if (test_frac is None) == (train_frac is None):
        raise ValueError("give either test_frac or train_frac")
    if test_frac is not None:
        name, rest, drawn = "test", "train", lambda n: [test_rows(test_frac, n)]
    else:
        name, rest, drawn = "train", "test", lambda n: [train_rows(train_frac, n)]
    (cut,), _ = cuts_for(df, seed, drawn, id_col)
    return df.withColumn("split", F.when(hash_key(seed, id_col) <= cut, name).otherwise(rest))


def fixed_train_split(
    df: DataFrame, fixed: DataFrame, seed: int, test_frac: float, id_col: str = "id"
) -> DataFrame:
    """Rows listed in ``fixed`` get split ``fixed``; the others are split at random."""
    require_ids(df, fixed, id_col)
    ids = fixed.select(id_col).distinct()
    pool = random_split(df.join(ids, id_col, "left_anti"), seed, test_frac=test_frac, id_col=id_col)
    kept = df.join(ids, id_col, "left_semi").withColumn("split", F.lit("fixed"))
    return pool.unionByName(kept)


def require_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> None:
    """Raise when ``ids`` names a row that ``df`` does not hold."""
    missing = ids.select(id_col).join(df.select(id_col), id_col, "left_anti").head(5)
    if missing:
        raise ValueError(f"ids not in the table: {[r[0] for r in missing]}")


def rows_by_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows for a list of ids; an id listed twice gives its row twice, an unknown id raises."""
    require_ids(df, ids, id_col)
    return df.join(ids.select(id_col), id_col)


def split_by_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Add ``split``: ``train`` for the listed ids, ``val`` for all others."""
    listed = ids.select(id_col).distinct().withColumn("_listed", F.lit(True))
    return (
        df.join(listed, id_col, "left")
        .withColumn("split", F.when(F.col("_listed"), "train").otherwise("val"))
        .drop("_listed")
    )


def predefined_split(df: DataFrame, assignment: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows by a given ``(id, split)`` table; an id may be in several splits, an unknown id raises."""
    require_ids(df, assignment, id_col)
    return df.join(assignment.select(id_col, "split").distinct(), id_col)


def prefix_split(df: DataFrame, frac: float, order: Sequence[str], id_col: str = "id") -> DataFrame:
    """No shuffle: the first int(frac*n) rows by ``order`` train, the rest validate."""
    k = int(frac * df.count())
    first = first_k(df, [*order, id_col] if id_col not in order else list(order), k).column()
    return df.withColumn("split", F.when(first, "train").otherwise("val"))


def seed_sample(df: DataFrame, n: int, seed: int, id_col: str = "id", total: int | None = None) -> DataFrame:
    """Exactly ``n`` rows drawn without replacement."""
    (cut,) = hash_cuts(df, seed, [n], id_col, total)
    return df.filter(hash_key(seed, id_col) <= cut)


def frac_sample(df: DataFrame, frac: float, seed: int, id_col: str = "id") -> DataFrame:
    """round(frac*n) rows drawn without replacement."""
    if frac >= 1:
        return df
    (cut,), _ = cuts_for(df, seed, lambda n: [round(frac * n)], id_col)
    return df.filter(hash_key(seed, id_col) <= cut)


def kfold(df: DataFrame, k: int, seed: int, id_col: str = "id") -> DataFrame:
    """Add ``fold`` 0..k-1; the first n mod k folds hold one row more."""
    cuts, _ = cuts_for(df, seed, lambda n: [(f + 1) * (n // k) + min(f + 1, n % k) for f in range(k - 1)], id_col)
    return df.withColumn("fold", interval_number(hash_key(seed, id_col), cuts))


def interval_number(key: Column, cuts: Sequence[str]) -> Column:
    """How many of the ascending ``cuts`` lie below ``key``, by bisection: a few comparisons a row, however many cuts."""
    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key > F.lit(cuts[mid]), between(mid + 1, high)).otherwise(between(low, mid))

    return between(0, len(cuts))


#: fixed values: training fractions of the random baseline
TRAIN_FRACTIONS = (
    [i / 1000 for i in range(1, 10)]
    + [i / 100 for i in range(1, 10)]
    + [i / 100 for i in range(10, 30, 5)]
    + [i / 100 for i in range(30, 100, 10)]
)


def nested_sizes(
    df: DataFrame, seed: int, fractions: Sequence[float] = TRAIN_FRACTIONS, id_col: str = "id"
) -> tuple[DataFrame, list[int]]:
    """Add ``step``: the index of the smallest fraction whose training set holds the row.

    Training sets of one seed are nested, so one column serves every size: fraction
    ``j`` trains on ``step <= j``. Rows outside all of them get ``len(fractions)``.
    """
    cuts, sizes = cuts_for(df, seed, lambda n: [train_rows(f, n) for f in fractions], id_col)
    return df.withColumn("step", interval_number(hash_key(seed, id_col), cuts)), sizes


def train_size_grid(
    spark: SparkSession, seeds: Sequence[int], models: Sequence[str], fractions: Sequence[float] = TRAIN_FRACTIONS
) -> DataFrame:
    """One row per (model, seed, training fraction)."""
    rows = spark.createDataFrame([(list(models), list(seeds), [float(f) for f in fractions])],
                                 "models array<string>, seeds array<int>, fractions array<double>")
    return (
        rows.select(F.explode("models").alias("model"), "seeds", "fractions")
        .select("model", F.explode("seeds").alias("seed"), "fractions")
        .select("model", "seed", F.explode("fractions").alias("train_frac"))
    )


def ood_split(old: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """Train on the older snapshot, test on rows that are new in the later one."""
    fresh = new.join(old.select(id_col), id_col, "left_anti").withColumn("split", F.lit("test"))
    return old.withColumn("split", F.lit("train")).unionByName(fresh)


def quantile_seeds(df: DataFrame, target: str, n: int, id_col: str = "id", distinct: bool = True) -> DataFrame:
    """Start set at ``n`` evenly spaced quantiles 0..100 of ``target``.

    For each quantile the last row (by target, then id) whose target does not exceed
    the quantile value; rows without a target are left out. Quantiles inside one run of equal targets name the same row;
    ``distinct=False`` keeps those repeats. The interpolated quantile at position
    p = (N-1)*i/(n-1) lies between ranks floor(p) and floor(p)+1, so the wanted row is
    the last of the run that holds rank floor(p): no quantile value is needed.
    """
    df = df.filter(F.col(target).isNotNull())
    if n < 2:
        low = df.agg(F.min(target)).first()[0]
        return df.filter(F.col(target) == F.lit(low)).groupBy(target).agg(F.max(id_col).alias(id_col)).select(id_col)
    total = df.count()
    ranked = global_rank(df.select(id_col, target), [target, id_col], "_rank")
    # quantile i sits at rank floor((N-1)*i/(n-1)): count the i that name this rank
    span = max(total - 1, 1)
    first = F.expr(f"((_rank - 1) * {n - 1} + {span - 1}) div {span}")
    after = F.least(F.expr(f"(_rank * {n - 1} + {span - 1}) div {span}"), F.lit(n))
    hits = ranked.withColumn("_hits", F.greatest(after - first, F.lit(0))).filter("_hits > 0")
    runs = df.groupBy(target).agg(F.max(id_col).alias("_last"))
    seeds = hits.select(target, "_hits").join(runs, target).select(F.col("_last").alias(id_col), "_hits")
    if distinct:
        return seeds.select(id_col).distinct()
    return seeds.select(id_col, F.explode(F.sequence(F.lit(1), F.col("_hits").cast("int")))).select(id_col)


def load_pruned(df: DataFrame, ranking: DataFrame, frac: float, id_col: str = "id") -> DataFrame:
    """Rows of the most informative int(frac*N) ids of a redundancy ranking."""
    n = ranking.count()
    return df.join(ranking.filter(F.col("rank") <= int(frac * n)).select(id_col), id_col, "left_semi")
