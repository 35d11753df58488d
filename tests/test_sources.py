import json
import math

import pytest
from pyspark.sql import functions as F

from winnow import session as S
from winnow.functions.structure import parse_structure
from winnow.sources import features as R
from winnow.sources import state as W

POSCAR = """comment
{scale}
2.0 0.0 0.0
0.0 2.0 0.0
0.0 0.0 2.0
{symbols}
{counts}
Direct
{coords}
"""


def poscar(symbols, counts, coords, scale="1.0"):
    return POSCAR.format(scale=scale, symbols=symbols, counts=counts, coords="\n".join(coords))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "initial_structures").mkdir()
    (tmp_path / "outfile").write_text("fid,energy,NIONS\n1,-8.0,2\n2,-4.0,1\n3,-9.0,1\n")
    files = {
        "1": poscar("Fe Al", "1 1", ["1.25 -0.25 0.0", "0.5 0.5 0.5 Al"]), "2": poscar("Al", "1", ["0 0 0"]),
        "3": poscar("Fe", "1", ["0 0 0"], "2.0"),
    }
    for fid, text in files.items():
        (tmp_path / f"POSCAR.{fid}").write_text(text)
    (tmp_path / "initial_structures" / "POSCAR.2").write_text(files["2"])
    return tmp_path


def test_run_folder(spark, folder):
    got = {r["fid"]: r for r in R.read_run_folder(spark, str(folder), True, reset_reference=True).collect()}
    assert got["1"]["elements"] == ["Al", "Fe"] and got["1"]["nelements"] == 2
    assert got["1"]["structure"]["coords"][0] == [0.25, 0.75, 0.0]
    assert got["1"]["e_per_atom"] == -4.0 and got["1"]["volume_per_atom"] == 4.0 and got["3"]["volume_per_atom"] == 64.0
    assert math.isclose(got["1"]["Ef_per_atom"], -4.0 - (0.5 * -4.0 + 0.5 * -9.0))
    assert got["1"]["structure_ini"] is None and got["2"]["structure_ini"]["elements"] == ["Al"]


def test_missing_file_is_an_error(spark, folder):
    (folder / "POSCAR.2").unlink()
    with pytest.raises(Exception, match="no file for id 2"):
        R.read_manifest(spark, f"{folder}/outfile", f"{folder}/POSCAR.*").collect()


def test_parse_structure(spark):
    text = "{'lattice_mat': ((1, 0, 0), (0, 1, 0), (0, 0, 1)), 'coords': [[0.5, 0, 0]], 'elements': ['Fe'], 'cartesian': 0}"
    rows = spark.createDataFrame([(text,), ("nonsense",)], "s string").select(parse_structure("s").alias("p")).collect()
    assert rows[0]["p"]["elements"] == ["Fe"] and rows[0]["p"]["coords"] == [[0.5, 0.0, 0.0]] and rows[1]["p"] is None


def test_predefined_split_file(spark, tmp_path):
    path = tmp_path / "split.json"
    path.write_text(json.dumps({"train": {"1": 0.5, "2": None}, "val": {"3": {"x": 1}}, "test": {"3": 1}}))
    got = sorted(map(tuple, R.read_predefined_split(spark, str(path), "bigint").collect()))
    assert got == [(1, "train"), (2, "train"), (3, "test"), (3, "val")]


def test_score_files_by_exact_name(spark, tmp_path):
    head = "train_size,maes,rmse,r2,maes_val,rmse_val,r2_val\n"
    for name, v in (("e_xgb_0", 1.0), ("e_xgb_1", 3.0), ("e_xgb_1tree_0", 99.0)):
        (tmp_path / f"{name}.csv").write_text(head + f"0.1,{v},1,1,1,1,1\n")
    got = R.read_score_files(spark, str(tmp_path), "e_xgb")
    assert sorted((r["seed"], r["maes"]) for r in got.collect()) == [(0, 1.0), (1, 3.0)]


def test_partition_is_rewritten_alone(spark, tmp_path):
    path = str(tmp_path / "curve")
    for i, v in ((0, 1.0), (1, 2.0), (1, 5.0)):
        W.write_iteration(spark.createDataFrame([(v,)], "mae double"), path, "r", i)
    assert sorted((r["iter"], r["mae"]) for r in spark.read.parquet(path).collect()) == [(0, 1.0), (1, 5.0)]


def test_history_appends(spark, tmp_path):
    path = str(tmp_path / "history")
    for v in (1.0, 2.0):
        W.write_history(spark.createDataFrame([(v,)], "loss double"), path)
    assert spark.read.json(path).count() == 2


def test_normalise_state(spark):
    old = spark.createDataFrame([(0, 1.0)], "iter int, maes double")
    new = spark.createDataFrame([(1, 2.0, 3.0)], "iter int, maes double, r2_m2 double")
    got = W.normalise_state(old, new).orderBy("iter").collect()
    assert got[0]["r2_m2"] is None and got[1]["r2_m2"] == 3.0 and len(got[0]) == 7


def test_checkpoint_folder_comes_from_the_session(spark):
    class Conf:
        def __init__(self, named):
            self.named = named

        def get(self, key, default=None):
            return self.named

    class Context:
        master = "spark://host:7077"

        def __init__(self, named):
            self.conf, self.dir = Conf(named), None

        def getConf(self):
            return self.conf

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, d):
            self.dir = d

    class Session:
        def __init__(self, named):
            self.sparkContext, self.conf = Context(named), Conf(named)

    assert S.checkpoint_dir(Session("hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        S.checkpoint_dir(Session(None))


def test_held_tables_join_without_exchange(spark):
    left = S.hold(spark.range(5000).withColumn("v", F.rand(1)), "id", 5000)
    right = S.hold(spark.range(0, 5000, 3).withColumn("w", F.lit(1)), "id", 5000)
    left.count(), right.count()
    # fewer partitions than the session shuffles into
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = left.join(right, "id", "left")
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" in plan
        physical = joined._jdf.queryExecution().executedPlan().toString()
        above_cache = [line for line in physical.split("InMemoryRelation")[0].splitlines() if "Exchange" in line]
        assert not above_cache and joined.filter("w = 1").count() == 1667
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        left.unpersist(), right.unpersist()
