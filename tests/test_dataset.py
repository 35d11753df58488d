import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from winnow.operators.clean import FeatureSpec
from winnow.operators.project import load_projection, project_2d
from winnow.plans.dataset import prepare

SPEC = FeatureSpec("id", "y", {"strict": ["x"], "loose": ["t"]})


@pytest.fixture
def table(rows):
    holed = F.when(F.col("id") < 30, float("inf")).otherwise(F.col("x"))
    return rows.withColumn("x", holed).withColumn("t", F.when(F.col("t") > 0, F.col("t"))).withColumn("other", F.lit(1.0))


def test_random(table):
    data = prepare(table, SPEC, "strict", 0.1, capped="y")
    n = table.filter("id >= 30 and y <= 5").count()
    assert data.test.count() == -(-n // 10) and data.pool.count() + data.test.count() == n
    mean, sigma = data.rows.agg(F.avg("x"), F.stddev_pop("x")).first()
    assert abs(mean) < 1e-9 and abs(sigma - 1) < 1e-9


def test_fixed_and_train_fit(table):
    fixed = table.filter("id between 30 and 60").select("id")
    data = prepare(table, SPEC, "strict", 0.2, fixed_ids=fixed, fit_on="train")
    assert data.fixed.count() == fixed.count()
    train = data.rows.filter("split <> 'test'")
    assert abs(train.agg(F.avg("x")).first()[0]) < 1e-9


def test_assignment_and_ranking(table):
    ids = table.filter("id >= 30").select("id")
    given = ids.withColumn("split", F.when(F.col("id") < 100, "val").otherwise("train"))
    data = prepare(table, SPEC, "strict", assignment=given, standardised=False)
    assert data.val.count() == given.filter("split = 'val'").count() and data.test.count() == 0
    ranking = ids.withColumn("rank", F.row_number().over(Window.orderBy("id")))
    small = prepare(table, SPEC, "strict", ranking=ranking, pruned_frac=0.5)
    assert small.rows.count() == ids.count() // 2
    with pytest.raises(ValueError):
        prepare(table, SPEC, "strict", fit_on="test")


def test_projection_is_reused(rows, tmp_path):
    first, model = project_2d(rows, ["x", "y", "t"], fit_frac=0.5, save_to=str(tmp_path / "pca"))
    again, _ = project_2d(rows, ["x", "y", "t"], model=load_projection(str(tmp_path / "pca")))
    assert first.columns == ["id", "0", "1"]
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
