import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from winnow.operators import split as S


@pytest.mark.parametrize("frac", [0.0, 0.1, 0.333, 0.9])
def test_random_split_sizes(rows, frac):
    split = dict(S.random_split(rows, 5, test_frac=frac).groupBy("split").count().collect())
    assert split.get("test", 0) == int(np.ceil(frac * 300)) and sum(split.values()) == 300
    split = dict(S.random_split(rows, 5, train_frac=frac).groupBy("split").count().collect())
    assert split.get("train", 0) == int(np.floor(frac * 300))


def test_split_ignores_partitioning(rows):
    one = S.random_split(rows, 1, test_frac=0.2)
    two = S.random_split(rows.repartition(11, "y"), 1, test_frac=0.2)
    assert sorted(map(tuple, one.select("id", "split").collect())) == sorted(map(tuple, two.select("id", "split").collect()))


def test_fixed_rows_never_test(rows):
    fixed = rows.filter("t = 0").select("id")
    out = S.fixed_train_split(rows, fixed, 0, 0.2)
    assert out.count() == 300
    assert {r["split"] for r in out.filter("t = 0").collect()} == {"fixed"}


def test_unknown_ids_raise(spark, rows):
    bad = spark.createDataFrame([(2,)], "id long")
    for call in (
        lambda: S.fixed_train_split(rows, bad, 0, 0.2),
        lambda: S.rows_by_ids(rows, bad),
        lambda: S.predefined_split(rows, bad.withColumn("split", F.lit("train"))),
    ):
        with pytest.raises(ValueError):
            call()


def test_val_may_equal_test(spark, rows):
    ids = rows.select("id").limit(5)
    both = ids.withColumn("split", F.lit("val")).unionByName(ids.withColumn("split", F.lit("test")))
    assert S.predefined_split(rows, both).count() == 10


def test_kfold_sizes(rows):
    sizes = dict(S.kfold(rows, 7, 2).groupBy("fold").count().collect())
    assert [sizes[f] for f in range(7)] == [43] * 6 + [42]


def test_samples(rows):
    assert S.seed_sample(rows, 31, 0).count() == 31
    assert S.seed_sample(rows, 999, 0).count() == 300
    assert S.frac_sample(rows, 0.25, 3).count() == 75


def test_nested_sizes_are_prefixes(rows):
    stepped, sizes = S.nested_sizes(rows, 0, [0.1, 0.5, 0.9])
    counts = dict(stepped.groupBy("step").count().collect())
    assert sizes == [30, 150, 270] and [counts[j] for j in range(4)] == [30, 120, 120, 30]


@pytest.mark.parametrize("col,n", [("y", 2), ("y", 11), ("t", 9), ("y", 300), ("y", 1)])
def test_quantile_seeds_match_their_definition(rows, col, n):
    s = rows.toPandas().set_index("id")[col]
    want = []
    for q in np.linspace(0, 100, n):
        value = s.quantile(q / 100)
        under = s[s <= value + 1e-12]
        want.append(max((v, i) for i, v in under.items())[1])
    raw = [r["id"] for r in S.quantile_seeds(rows, col, n, distinct=False).collect()]
    assert sorted(raw) == sorted(want)
    assert {r["id"] for r in S.quantile_seeds(rows, col, n).collect()} == set(want)


def test_prefix_split(rows):
    out = S.prefix_split(rows, 0.29, ["t"])
    train = [r["id"] for r in out.filter("split = 'train'").collect()]
    want = sorted((r["t"], r["id"]) for r in rows.collect())[:87]
    assert sorted(train) == sorted(i for _, i in want)


def test_train_size_grid(spark):
    assert S.train_size_grid(spark, range(10), ["a", "b"]).count() == 580
