"""Every query with an SQL twin gives the same rows; the others give rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: training sets of one or two rows have no unique fit at the smallest scale
LARGER = {"baseline_scores", "score_files", "curve_mean_std", "prune_stop", "train_size_grid"}


@pytest.fixture(scope="module")
def connections():
    return {f: connect(f) for f in (SMALL, MIDDLE)}


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, connections, name):
    folder = MIDDLE if name in LARGER else SMALL
    df = entry.queries()[name](spark, folder)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.collect()
    else:
        n, problem = compare(connections[folder], df, sql)
        assert problem is None
    spark.catalog.clearCache()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["iter", "model", "train_ratio", "maes", "rmse", "r2", "train_size"]
