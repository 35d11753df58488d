import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from winnow.operators import rank as R


def digest(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.mark.parametrize("settle", [5, 500_000])
@pytest.mark.parametrize("total", [None, 300])
def test_hash_cuts_are_exact(rows, monkeypatch, settle, total):
    monkeypatch.setattr(R, "SETTLE_HASHES", settle)
    monkeypatch.setattr(R, "PREFIX_DIGITS", 1)
    ids = [r["id"] for r in rows.collect()]
    hashes = sorted(digest(3, i) for i in ids)
    sizes = [0, 1, 17, 150, 299, 300, 400]
    cuts = R.hash_cuts(rows, 3, sizes, total=total)
    assert [sum(h <= c for h in hashes) for c in cuts] == [0, 1, 17, 150, 299, 300, 300]


def test_hash_cut_ignores_partitioning(rows):
    assert R.hash_cuts(rows, 1, [40]) == R.hash_cuts(rows.repartition(13, "x"), 1, [40])


@pytest.mark.parametrize("settle", [10, 500_000])
@pytest.mark.parametrize("k", [0, 1, 60, 150, 299, 300, 500])
def test_first_k_with_heavy_ties(rows, monkeypatch, settle, k):
    monkeypatch.setattr(R, "SETTLE_ROWS", settle)
    got = {r["id"] for r in R.top_k(rows, "t", k).collect()}
    want = sorted(((-r["t"], r["id"]) for r in rows.collect()))[:k]
    assert got == {i for _, i in want}


def test_first_k_with_text_ids(spark, monkeypatch):
    monkeypatch.setattr(R, "SETTLE_ROWS", 10)
    df = spark.range(200).select(F.concat(F.lit("n"), F.col("id")).alias("id"), F.lit(1.0).alias("v"))
    got = sorted(r["id"] for r in R.bottom_k(df, "v", 33).collect())
    assert got == sorted(f"n{i}" for i in range(200))[:33]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(0, 70))
def test_bottom_k_property(spark, values, k):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double")
    got = {r["id"] for r in R.bottom_k(df, "v", k).collect()}
    assert got == {i for _, i in sorted((v, i) for i, v in enumerate(values))[:k]}


def test_global_rank_and_cumsum(rows):
    pdf = rows.toPandas().sort_values(["t", "id"])
    ranked = {r["id"]: r["rank"] for r in R.global_rank(rows, ["t", "id"]).collect()}
    assert ranked == {i: n + 1 for n, i in enumerate(pdf["id"])}
    run = {r["id"]: r["s"] for r in R.global_cumsum(rows, ["t", "id"], {"s": F.col("y")}).collect()}
    want = dict(zip(pdf["id"], pdf["y"].cumsum()))
    assert all(abs(run[i] - want[i]) < 1e-9 for i in want)


def test_drop_largest_lists_a_row_once(rows):
    got = [r["id"] for r in R.drop_largest(rows, "t", 10.0, 20).collect()]
    assert len(got) == len(set(got)) == 300


def test_interval_matches_numpy(spark):
    preds = np.random.default_rng(0).normal(size=(20, 7))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(preds)], "id long, preds array<double>")
    for r in R.ensemble_interval(df, percentile=80).collect():
        low, high = np.percentile(preds[r["id"]], [10, 90])
        assert abs(r["lower"] - low) < 1e-9 and abs(r["upper"] - high) < 1e-9
        assert r["lower"] <= r["upper"]


def test_ranking_is_a_permutation_kept_first(spark):
    members = spark.createDataFrame(
        [(1, 0, 0.5), (2, None, None), (3, 1, 0.1), (4, 0, 0.2), (5, None, None), (6, 1, 0.4)], "id long, iter_removed int, err double"
    )
    order = [r["id"] for r in R.redundancy_ranking(members).orderBy("rank").collect()]
    assert order == [2, 5, 6, 3, 1, 4]


def test_unknown_criterion():
    with pytest.raises(ValueError):
        R.batch_rule("middle_err")


@pytest.mark.parametrize("k", [1, 777, 25_000, 49_999])
def test_one_pass_cut_of_a_large_draw(spark, k):
    """A single cut of a table of known size is read from a bracket of hashes, and is that of the sorted hashes."""
    df = spark.range(50_000).repartition(7)
    hashes = sorted(hashlib.md5(f"3:{i}".encode()).hexdigest() for i in range(50_000))
    keyed = df.select(R.hash_key(3).alias("h"))
    assert R._bracketed(keyed, k, 50_000) == hashes[k - 1]
    assert R.hash_cuts(df, 3, [k], "id", 50_000) == R.hash_cuts(df, 3, [k], "id") == [hashes[k - 1]]
    assert R._bracketed(keyed.where(F.col("h") > "8"), k, 50_000) in (None, *hashes)
