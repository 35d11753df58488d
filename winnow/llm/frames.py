"""Spark-side helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.session import checkpoint_dir

#: a side may be broadcast when rows times its row width stay below this
BROADCAST_BYTES = 64 << 20
#: bytes of an Arrow batch between the JVM and a Python worker; each holds one or more copies of it per task
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of about ``BATCH_BYTES``, unless the session names a limit; else 10,000 texts, however long, go to a worker at once."""
    ours = spark.conf.get(_BATCH, None) is None
    if ours:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        if ours:
            spark.conf.unset(_BATCH)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it from there.

    Cuts the lineage and survives lost executors; partitioning is forgotten, so that joins
    of what is read can be split where a key is hot.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "snappy").parquet(path)
    return spark.read.parquet(path)


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are few enough, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def id_remainder(key: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (smallest node id reachable) of every node that has an edge.

    Alternating large-star and small-star steps: each replaces the edges of a node by edges
    to its smallest neighbour, until all are stars. Every step is an aggregate and a join over
    the edges and is written to the shared folder; the driver sees one count per round.
    """
    both = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    stars = written(both, "edges")
    state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while True:
        sides = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(sides.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = sides.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        large = written(large, "large")
        least = written(large.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("m")), "least")
        small = large.join(least, large["v"] == least["x"]).select("m", "u", "v")
        small = small.select(F.col("m").alias("u"), F.col("u").alias("v")).where("u < v").union(least.select(F.col("m").alias("u"), F.col("x").alias("v")))
        stars = written(small.distinct(), "edges")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return stars.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        stars.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
