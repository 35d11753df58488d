"""Checkpoint folder, lineage cuts and partition counts shared by every operator."""

from __future__ import annotations

import math
import tempfile

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and run state.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting gets a temporary folder; a cluster session without it is an error,
    because a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="winnow-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read on from there.

    Keeps partitioning and row order inside partitions, cuts the lineage, and
    survives the loss of executors.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialise``, and aggregates of the rows that the very same pass has seen, by name."""
    seen = Observation()
    out = materialise(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]))
    return out, seen.get


#: a table may be hinted for broadcast while rows times its row width stay below this
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, row_bytes: int = 64, rows: int | None = None) -> DataFrame:
    """``df`` hinted for broadcast if its rows, counted here unless given, are few enough, else as it is.

    So a large table meets a handful of group values, members or leaves without being
    shuffled on them. Count a materialised table, or what leads to it runs twice.
    """
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: rows per partition of a held table, as far as the session's shuffle partitions allow
HELD_ROWS = 100_000


def hold(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Cache ``df`` hash-partitioned and sorted by ``key``.

    Two tables held by the same key and for the same number of ``rows`` merge-join
    without any shuffle or sort. An explicit partition count keeps adaptive execution
    from coalescing them apart: the session's shuffle partitions, or fewer for small
    tables. A lost cache block is rebuilt from the lineage. The caller unpersists.
    """
    spark = df.sparkSession
    wanted = max(spark.sparkContext.defaultParallelism, math.ceil(rows / HELD_ROWS))
    parts = min(shuffle_partitions(spark), wanted)
    return df.repartition(parts, key).sortWithinPartitions(key).persist(StorageLevel.MEMORY_AND_DISK)
