import math

import pytest
from pyspark.sql import functions as F

from winnow.functions import columns as X
from winnow.operators import clean as C


@pytest.fixture
def dirty(spark):
    nan, inf = float("nan"), float("inf")
    return spark.createDataFrame(
        [(1, 1.0, 2.0), (2, nan, 2.0), (3, inf, 2.0), (4, -inf, 2.0), (5, None, None), (6, 7.0, 2.0)], "id long, a double, b double"
    )


def test_nan_null_inf(dirty):
    out = {r["id"]: r["a"] for r in C.inf_to_null(dirty, ["a"]).collect()}
    assert out == {1: 1.0, 2: None, 3: None, 4: None, 5: None, 6: 7.0}


def test_cap_drops_missing_and_ignores_absent_columns(dirty):
    fine = C.inf_to_null(dirty, ["a"])
    assert [r["id"] for r in C.cap(fine, "a").collect()] == [1]
    assert C.cap(fine, "zz").count() == 6


def test_report_and_drop(dirty):
    fine = C.inf_to_null(dirty, ["a"])
    assert tuple(C.failed_report(fine, ["a", "b"]).first()) == (6, 4, 2)
    assert C.drop_failed(fine, ["a", "b"]).count() == 2


def test_transfer_target_may_leave_target_null(dirty):
    fine = C.inf_to_null(dirty, ["a"])
    assert C.require_target(fine, "a").count() == 2
    assert C.require_target(fine, "a", "b").count() == 5


def test_standardise_population_sigma_and_constant_column(dirty):
    fine = C.inf_to_null(dirty, ["a"])
    out = {r["id"]: (r["a"], r["b"]) for r in C.standardise(fine, ["a", "b"]).collect()}
    assert out[1] == (-1.0, 0.0) and out[6] == (1.0, 0.0) and out[2] == (None, 0.0) and out[5] == (None, None)


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, o int, v string")
    assert sorted(map(tuple, C.dedupe(df, "k", ["o"]).collect())) == [("a", 1, "y"), ("b", 3, None)]


def test_placeholder(spark):
    out = C.with_placeholder_target(spark.range(2).withColumnRenamed("id", "key"), "y", "key")
    assert [tuple(r) for r in out.collect()] == [(0, -9999.0), (1, -9999.0)]


def test_geometry(spark):
    df = spark.createDataFrame([([[2.0, 0.0, 0.0], [0.0, 3.0, 0.0], [1.0, 0.0, 4.0]], [[1.25, -0.25, 0.5]])], "m array<array<double>>, p array<array<double>>")
    r = df.select(X.cell_volume("m").alias("v"), X.wrap_unit_cell("p").alias("p")).first()
    assert r["v"] == 24.0 and r["p"] == [[0.25, 0.75, 0.5]]


def test_poisson_loss(spark):
    r = spark.createDataFrame([(2.0, 3.0)], "p double, y double").select(X.poisson_nll(F.col("p"), F.col("y"))).first()[0]
    assert abs(r - (2 - 3 * math.log(2 + 1e-8) + 3 * math.log(3) - 3 + 0.5 * math.log(2 * math.pi * 3))) < 1e-12
