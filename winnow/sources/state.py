"""Run state: one Parquet partition per iteration, so a stopped run resumes exactly.

Layout of a run folder: ``settings`` (one row per attempt: its number and what it ran
on), and for each attempt ``attempt=a/members/iter=i`` (ids chosen in iteration i) and
``attempt=a/scores/iter=i``. The scores are written last and are what counts: an iteration
without them is overwritten when the run resumes. A run that is not resumed starts
a new attempt, so nothing of an older one is read or has to be deleted.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.session import checkpoint_dir

UNSCORED = "split string, model string, n long, mae double, rmse double, r2 double"
SCORES = f"{UNSCORED}, n_before long, n_chosen long"
#: rows per written file of chosen ids
FILE_ROWS = 1_000_000


def new_run_dir(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


#: ``n_chosen`` of a round that was scored as the last one, without choosing a batch
NOT_CHOSEN = -1


def described(value) -> str:
    """A setting as text: plain values as they are, models by class and plain attributes."""
    if value is None or isinstance(value, (bool, int, float, str)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return f"[{', '.join(map(described, value))}]"
    if isinstance(value, dict):
        return f"{{{', '.join(f'{k}: {described(v)}' for k, v in sorted(value.items()))}}}"
    if callable(value) and hasattr(value, "__qualname__"):
        cells = [c.cell_contents for c in value.__closure__ or ()]
        return f"{value.__qualname__}({', '.join(described(c) for c in cells if not callable(c))})"
    if hasattr(value, "extractParamMap"):  # an estimator
        return type(value).__name__ + described({p.name: v for p, v in value.extractParamMap().items()})
    if hasattr(value, "__dataclass_fields__"):
        return type(value).__name__ + described({k: getattr(value, k) for k in value.__dataclass_fields__})
    plain = {k: v for k, v in vars(value).items() if isinstance(v, (bool, int, float, str, list, tuple))} if hasattr(value, "__dict__") else {}
    return f"{type(value).__name__}{described(plain)}"


def _print_of(df: DataFrame) -> list:
    """Rows and a sum of row hashes, whatever the order or partitioning."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first()
    return [row[0], str(row[1])]


@dataclass
class RunState:
    spark: SparkSession
    path: str
    id_col: str
    id_type: str

    @classmethod
    def open(
        cls, df: DataFrame, path: str | None, id_col: str = "id", resume: bool = False, settings: dict | None = None,
        tables: dict[str, DataFrame] | None = None,
    ) -> "RunState":
        """A run in ``path`` (default: a new folder).

        ``resume`` goes on with the last attempt in the folder, and is an error where that one
        ran on other ``settings`` or on other rows of ``tables``; otherwise a new attempt begins.
        """
        spark = df.sparkSession
        id_type = df.schema[id_col].dataType.simpleString()
        if path is None:
            return cls(spark, new_run_dir(spark), id_col, id_type)
        mark = json.dumps({"settings": described(settings or {}), **{n: _print_of(t) for n, t in (tables or {}).items()}}, sort_keys=True)
        try:
            attempts = spark.read.schema("attempt int, mark string").parquet(f"{path}/settings").collect()
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
            attempts = []
        last = max(attempts, key=lambda r: r["attempt"], default=None)
        if resume and last is not None:
            if last["mark"] != mark:
                raise ValueError(f"{path} holds a run on other settings or rows: {last['mark']}, not {mark}")
            number = last["attempt"]
        else:
            number = last["attempt"] + 1 if last else 0
            spark.createDataFrame([(number, mark)], "attempt int, mark string").coalesce(1).write.mode("append").parquet(f"{path}/settings")
        return cls(spark, f"{path}/attempt={number}", id_col, id_type)

    def _read(self, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, iter int").parquet(f"{self.path}/{part}")

    def done(self) -> list[dict]:
        """Committed iterations in order, with their sizes."""
        try:
            sizes = self._read("scores", SCORES).select("iter", "n_before", "n_chosen").distinct()
            rows = sizes.orderBy("iter").collect()
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
            return []
        return [r.asDict() for r in rows]

    def commit(self, i: int, chosen: DataFrame, n_before: int, n_chosen: int, scores: DataFrame | None) -> dict:
        """``chosen(id, err)``, then the scores of iteration ``i`` together with its sizes."""
        files = max(1, math.ceil(n_chosen / FILE_ROWS))
        # only the chosen rows move; the scan that finds them stays as wide as it is
        chosen.select(self.id_col, "err").repartition(files).write.mode("overwrite").parquet(f"{self.path}/members/iter={i}")
        if scores is None:
            scores = self.spark.createDataFrame([(None,) * 6], UNSCORED)
        (
            scores.select("split", "model", "n", "mae", "rmse", "r2")
            .withColumns({"n_before": F.lit(n_before).cast("long"), "n_chosen": F.lit(n_chosen).cast("long")})
            .coalesce(1).write.mode("overwrite").parquet(f"{self.path}/scores/iter={i}")
        )
        return {"iter": i, "n_before": n_before, "n_chosen": n_chosen}

    def members(self, before: int) -> DataFrame:
        """(id, err, iter) of the iterations before the given one."""
        schema = f"{self.id_col} {self.id_type}, err double"
        if before <= 0:
            return self.spark.createDataFrame([], f"{schema}, iter int")
        return self._read("members", schema).filter(F.col("iter") < before)

    def scores(self, before: int) -> DataFrame:
        if before <= 0:
            return self.spark.createDataFrame([], f"{UNSCORED}, iter int")
        rows = self._read("scores", SCORES).filter((F.col("iter") < before) & F.col("split").isNotNull())
        return rows.drop("n_before", "n_chosen")


def write_iteration(rows: DataFrame, path: str, run_id: str, iteration: int) -> None:
    """Curve rows or selected ids of one iteration; only that partition is rewritten."""
    rows.write.mode("overwrite").parquet(f"{path}/run_id={run_id}/iter={iteration}")


def write_history(scores: DataFrame, path: str) -> None:
    """Metric history as JSON lines, appended."""
    scores.write.mode("append").json(path)


#: columns of a score table; older layouts lack some of them
STATE_COLUMNS = "iter int, maes double, rmse double, r2 double, maes_m2 double, rmse_m2 double, r2_m2 double"


def normalise_state(*layouts: DataFrame) -> DataFrame:
    """Old and new score layouts in one table; metrics a layout lacks are null."""
    spark = layouts[0].sparkSession
    out = spark.createDataFrame([], STATE_COLUMNS)
    for layout in layouts:
        out = out.unionByName(layout, allowMissingColumns=True)
    return out
