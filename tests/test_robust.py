"""Missing values, empty groups and awkward files: defined results instead of failures, whatever the table's size."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.functions.columns import per_unit
from winnow.functions.structure import parse_poscar
from winnow.operators import columns as C
from winnow.operators import composition as D
from winnow.operators import metrics, models, rank, split
from winnow.operators.affinity import weighted_variance
from winnow.operators.influence import linear_influence, linear_influence_of_pairs
from winnow.sources import features as R


@pytest.mark.parametrize("settle", [10, 500_000])
def test_cuts_leave_missing_values_out(spark, monkeypatch, settle):
    monkeypatch.setattr(rank, "SETTLE_ROWS", settle)
    rows = spark.range(1000).select("id", F.when(F.col("id") % 50 > 0, F.col("id") % 97).cast("double").alias("v"))
    data = [(r["v"], r["id"]) for r in rows.collect() if r["v"] is not None]
    for k in (1, 10, 500, 980, 990, 2000):
        assert sorted((r["v"], r["id"]) for r in rank.bottom_k(rows, "v", k).collect()) == sorted(sorted(data)[:k])
        assert sorted((r["v"], r["id"]) for r in rank.top_k(rows, "v", k).collect()) == sorted(sorted(data, key=lambda x: (-x[0], x[1]))[:k])


def test_quantile_seeds_with_missing_targets(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(10, 20)] + [(i, None) for i in range(10)], "id long, y double")
    assert {r["id"] for r in split.quantile_seeds(rows, "y", 4).collect()} == {10, 13, 16, 19}


def test_many_cuts_at_once(spark):
    rows = spark.range(20_000)
    sizes = list(range(0, 20_000, 20))
    cuts = rank.hash_cuts(rows, 1, sizes)
    hashes = sorted(r[0] for r in rows.select(rank.hash_key(1)).collect())
    assert cuts == ["" if k == 0 else hashes[k - 1] for k in sizes]


def test_correlation_of_columns_that_never_meet(spark):
    rng = np.random.default_rng(3)
    data = [(float(a), None if i % 2 else float(b), float(a + c) if i % 2 else None, 1.0) for i, (a, b, c) in enumerate(rng.normal(size=(200, 3)))]
    df = spark.createDataFrame(data, "a double, b double, c double, k double")
    pdf = df.toPandas()
    for method in ("pearson", "spearman"):
        want = pdf.corr(method).abs()
        got = {(r["col_a"], r["col_b"]): r["r"] for r in C.corr_pairs(df, list("abck"), method).collect()}
        assert len(got) == 6
        for (x, y), r in got.items():
            w = want.loc[x, y]
            assert (r is None or math.isnan(r)) if math.isnan(w) else math.isclose(r, w, abs_tol=1e-9)
    means = {r["col"]: r["mean_r"] for r in C.corr_column_stats(C.corr_pairs(df, list("abck")), 4, 0.5).collect()}
    ac, ab = (pdf[["a", x]].corr().abs().iloc[0, 1] for x in "cb")
    assert math.isclose(means["a"], (ac + ab) / 3)  # its own 0 counts, the constant column does not


def test_division_by_nothing_is_null(spark):
    rows = spark.createDataFrame([(1.0, 2), (1.0, 0)], "e double, n int").select(per_unit("e", "n").alias("v"))
    assert [r["v"] for r in rows.collect()] == [0.5, None]
    bag = spark.createDataFrame([(1, "A", 0.0), (2, "A", 1.0)], "id long, member string, amount double")
    props = spark.createDataFrame([("A", 3.0)], "member string, p double")
    got = {r["id"]: r["p_mean"] for r in D.composition_features(bag, props, ["p"]).collect()}
    assert got == {1: None, 2: 3.0}


def test_scores_count_scored_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 2.0), (2.0, None)], "prediction double, y double")
    assert metrics.regression_scores(df).first()["n"] == 1


def test_poscar_modes(spark):
    cell = "2.0 0.0 0.0\n1.0 3.0 0.0\n0.0 0.0 4.0\nAl Fe\n1 1\n"
    texts = {
        "direct": f"c\n1.0\n{cell}Direct\n0.5 0.5 0.5\n0 0 0\n",
        "cartesian": f"c\n1.0\n{cell}Cartesian\n1.5 1.5 2.0\n0 0 0\n",
        "selective": f"c\n1.0\n{cell}Selective dynamics\nDirect\n0.5 0.5 0.5 T T F\n0 0 0 F F F\n",
        "volume": f"c\n-192.0\n{cell}Direct\n0.5 0.5 0.5\n0 0 0\n",
        "short": f"c\n1.0\n{cell}Direct\n0.5 0.5 0.5\n",
        "nonsense": "what",
        "words": f"c\nx\n{cell}Direct\n0.5 0.5 0.5\n0 0 0\n",
    }
    rows = spark.createDataFrame(list(texts.items()), "name string, t string").select("name", parse_poscar("t").alias("s"))
    got = {r["name"]: r["s"] for r in rows.collect()}
    for name in ("direct", "cartesian", "selective", "volume"):
        assert np.allclose(got[name]["coords"], [[0.5] * 3, [0] * 3]) and got[name]["elements"] == ["Al", "Fe"]
    assert np.allclose(got["volume"]["lattice"], np.array([[2, 0, 0], [1, 3, 0], [0, 0, 4]]) * 2)
    assert got["short"] is got["nonsense"] is got["words"] is None


def test_reference_is_the_last_row_of_the_manifest(spark, tmp_path):
    (tmp_path / "outfile").write_text("fid,energy,NIONS\n9,-1.0,1\n10,-2.0,1\n")
    for fid in (9, 10):
        (tmp_path / f"POSCAR.{fid}").write_text("c\n1\n1 0 0\n0 1 0\n0 0 1\nAl\n1\nDirect\n0 0 0\n")
    got = {r["fid"]: r["Ef_per_atom"] for r in R.read_run_folder(spark, str(tmp_path), reset_reference=True).collect()}
    assert got == {"9": 1.0, "10": 0.0}


def test_boosted_trees_take_missing_features(spark, rows):
    holes = rows.withColumn("x", F.when(F.col("id") % 7 > 0, F.col("x")))
    fitted = models.xgb(["x", "t"], rounds=3, depth=2).fit(holes.withColumn("y", F.when(F.col("id") % 5 > 0, F.col("y"))))
    assert fitted.transform(holes).filter("prediction is null").count() == 0


def test_small_sides_leave_the_large_one_where_it_is(spark, rows):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = rows.withColumn("g", F.col("id") % 4)
        leaves = wide.select("id", "y", F.array(F.col("g").cast("int")).alias("leaves"))
        bag = wide.select("id", F.col("g").cast("string").alias("member"), F.lit(1.0).alias("amount"))
        references = spark.createDataFrame([(str(i), float(i)) for i in range(4)], "member string, reference double")
        for df in (
            models.GroupMean("g").fit(wide).transform(wide),
            metrics.target_stats(wide, "y", ["g"]),
            weighted_variance(leaves, leaves),
            D.reference_subtracted(wide.select("id", "y"), bag, "y", references),
        ):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"(SortMergeJoin|ShuffledHashJoin) \[(g|member|tree)#", plan)
            assert "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_influence_of_several_features_equals_refits(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=40)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(40)], "id long, a double, b double, c double, y double")
    full = np.column_stack([np.ones(40), x])
    fit = lambda keep: full @ np.linalg.lstsq(full[keep], y[keep], rcond=None)[0]
    every = np.arange(40)
    change = np.array([fit(every != i) - fit(every >= 0) for i in range(40)])
    for r in linear_influence(df, ["a", "b", "c"]).collect():
        assert math.isclose(r["self_abs"], abs(change[r["id"], r["id"]]), rel_tol=1e-8)
        assert math.isclose(r["rms_abs"], math.sqrt((change[r["id"]] ** 2).mean()), rel_tol=1e-8)
    pairs = spark.createDataFrame([(i, j) for i in range(0, 40, 7) for j in range(0, 40, 3)], "removed_id long, id long")
    for r in linear_influence_of_pairs(df, pairs, ["a", "b", "c"]).collect():
        assert math.isclose(r["abs_influ"], abs(change[r["removed_id"], r["id"]]), rel_tol=1e-8)
