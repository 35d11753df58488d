"""Readers: feature tables, manifests with one file per row, splits, score files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.columns import cell_volume, distinct_members, per_unit, wrap_unit_cell
from winnow.functions.structure import parse_poscar
from winnow.operators.clean import FeatureSpec
from winnow.operators.composition import member_counts, reference_subtracted

SPLIT_JSON = "map<string,map<string,string>>"


def read_features(spark: SparkSession, path: str, spec: FeatureSpec, extra: Sequence[str] = ()) -> DataFrame:
    """A featurised table, reading only the columns the spec names."""
    return spec.select(spark.read.parquet(path), *extra)


def split_rows(text: Column | str) -> Column:
    """Explodable (split, ids) entries of a ``{"train": {id: ...}, "val": ..., "test": ...}`` text."""
    return F.map_entries(F.from_json(text, SPLIT_JSON))


def parse_split(df: DataFrame, text: str = "value", id_type: str = "string", id_col: str = "id") -> DataFrame:
    """Split texts to (id, split); only the keys matter."""
    entries = df.select(F.explode(split_rows(text)).alias("e"))
    ids = entries.select(F.explode(F.map_keys("e.value")).alias(id_col), F.col("e.key").alias("split"))
    return ids.withColumn(id_col, F.col(id_col).cast(id_type))


def read_predefined_split(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    return parse_split(spark.read.text(path, wholetext=True), "value", id_type)


def _files_by_id(spark: SparkSession, glob: str, name: str) -> DataFrame:
    """One row per ``POSCAR.{fid}`` file, or folder with one written file: fid, text."""
    return spark.read.text(glob, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"/POSCAR\.([^/]+)(?:/[^/]+)?$", 1).alias("fid"), F.col("value").alias(name)
    )


def read_manifest(
    spark: SparkSession, csv: str, files_glob: str, initial_glob: str | None = None, schema: str | None = None
) -> DataFrame:
    """Manifest rows joined to one text file per id, and optionally to an initial one.

    The file must exist for every id; the initial file may be missing (null). ``position``
    is the place of the row in the manifest (``csv`` is one file).
    """
    reader = spark.read.option("header", True)
    rows = reader.schema(schema).csv(csv) if schema else reader.csv(csv)
    # rows of a file split into blocks keep their order in this number
    rows = rows.withColumn("fid", F.col("fid").cast("string")).withColumn("position", F.monotonically_increasing_id())
    joined = rows.join(_files_by_id(spark, files_glob, "text"), "fid", "left")
    lost = F.raise_error(F.concat(F.lit("no file for id "), F.col("fid"))).cast("string")
    joined = joined.withColumn("text", F.when(F.col("text").isNull(), lost).otherwise(F.col("text")))
    if initial_glob is None:
        return joined.withColumn("initial_text", F.lit(None).cast("string"))
    return joined.join(_files_by_id(spark, initial_glob, "initial_text"), "fid", "left")


def read_run_folder(
    spark: SparkSession, folder: str, include_initial: bool = False, reset_reference: bool = False
) -> DataFrame:
    """A run folder as a table: structures in the unit cell, members, per-atom energy,
    volume and formation energy, keyed by ``fid``."""
    raw = read_manifest(
        spark, f"{folder}/outfile", f"{folder}/POSCAR.*",
        f"{folder}/initial_structures/POSCAR.*" if include_initial else None,
    )

    def unit_cell(text: str) -> Column:
        s = parse_poscar(text)
        return F.when(
            F.col(text).isNotNull(),
            F.struct(s["lattice"].alias("lattice"), wrap_unit_cell(s["coords"]).alias("coords"), s["elements"].alias("elements")),
        )

    table = (
        raw.withColumn("energy", F.col("energy").cast("double")).withColumn("NIONS", F.col("NIONS").cast("int"))
        .withColumn("structure", unit_cell("text")).withColumn("structure_ini", unit_cell("initial_text"))
        .drop("text", "initial_text")
        .withColumn("elements", distinct_members("structure.elements"))
        .withColumn("nelements", F.size("elements"))
        .withColumn("e_per_atom", per_unit("energy", "NIONS"))
        .withColumn("volume_per_atom", per_unit(cell_volume(F.col("structure.lattice")), "NIONS"))
    )
    bag = member_counts(table.select("fid", F.col("structure.elements").alias("members")), "members", "fid")
    return reference_subtracted(table, bag, "e_per_atom", reset=reset_reference, id_col="fid", name="Ef_per_atom", position="position")


SCORE_COLUMNS = "train_size double, maes double, rmse double, r2 double, maes_val double, rmse_val double, r2_val double"


def read_score_files(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """Per-seed score files ``{prefix}_{seed}.csv``, or folders of that name as Spark writes them; the
    seed must be a number, so that a model name that merely begins alike is not read."""
    rows = spark.read.option("header", True).schema(SCORE_COLUMNS).csv(f"{folder}/{prefix}_*.csv")
    seed = F.regexp_extract(F.col("_metadata.file_path"), rf"/{re.escape(prefix)}_(\d+)\.csv(?:/[^/]+)?$", 1)
    return rows.select("*", seed.alias("seed")).filter(F.col("seed") != "").withColumn("seed", F.col("seed").cast("int"))


def write_score_files(scores: DataFrame, folder: str, prefix: str, seed: int) -> None:
    """Scores of one seed, one row per training size, where :func:`read_score_files` finds them."""
    columns = [c.split()[0] for c in SCORE_COLUMNS.split(", ")]
    scores.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{prefix}_{seed}.csv")
