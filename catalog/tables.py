"""Feature tables derived from the given tables, each with its SQL twin.

Sums of money are rounded to cents and averages to six decimals, so both engines
start from identical values whatever order they added in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.session import small_side


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


ORDER_FEATURES = ["n_lines", "qty", "avg_discount", "avg_tax", "avg_p_size", "avg_p_retail"]
STRUCTURAL, COMPOSITIONAL = ["qty", "avg_tax"], ["n_lines", "avg_discount", "avg_p_size", "avg_p_retail"]


def order_features(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order: features of its lines and parts, target y = total price."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    part = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    sent = small_side(part, 48)
    joined = lines.join(sent, lines.l_partkey == part.p_partkey)
    if sent is part:  # lines dealt by part are of other orders each: as rows they take less room than as sums
        joined = joined.repartition("l_orderkey")
    return (
        joined.groupBy(F.col("l_orderkey").alias("id"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("n_lines"),
            F.round(F.sum("l_quantity"), 2).alias("qty"),
            F.round(F.avg("l_discount"), 6).alias("avg_discount"),
            F.round(F.avg("l_tax"), 6).alias("avg_tax"),
            F.round(F.avg("p_size"), 6).alias("avg_p_size"),
            F.round(F.avg("p_retailprice"), 6).alias("avg_p_retail"),
            F.round(F.sum("l_extendedprice"), 2).alias("y"),
        )
    )


F1 = """f1 AS MATERIALIZED (
  SELECT l_orderkey AS id, CAST(count(*) AS DOUBLE) AS n_lines, round(sum(l_quantity), 2) AS qty,
         round(avg(l_discount), 6) AS avg_discount, round(avg(l_tax), 6) AS avg_tax,
         round(avg(p_size), 6) AS avg_p_size, round(avg(p_retailprice), 6) AS avg_p_retail,
         round(sum(l_extendedprice), 2) AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""


def document_features(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: word and line counts of the whole text, target y = characters."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.size(F.split("text", " ")).cast("double").alias("n_words"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
        "lang", "source",
        F.col("n_chars").cast("double").alias("y"),
    )


F2 = """f2 AS MATERIALIZED (
  SELECT doc_id AS id, CAST(len(string_split(text, ' ')) AS DOUBLE) AS n_words,
         CAST(len(string_split(text, chr(10))) AS DOUBLE) AS n_lines, lang, source, CAST(n_chars AS DOUBLE) AS y
  FROM documents)"""


def bag_by_type(spark: SparkSession, folder: str, member: str = "p_type") -> DataFrame:
    """Orders as compositions: (id, member, amount) with the ordered quantity as amount."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = table(spark, folder, "part").select("p_partkey", member)
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("id"), F.col(member).alias("member"), F.col("l_quantity").alias("amount")
    )


BAG = """bag AS MATERIALIZED (
  SELECT l_orderkey AS id, {member} AS member, sum(l_quantity) AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
BAG_TYPE, BAG_BRAND = BAG.format(member="p_type"), BAG.format(member="p_brand")


def member_properties(spark: SparkSession, folder: str, member: str = "p_type") -> DataFrame:
    return table(spark, folder, "part").groupBy(F.col(member).alias("member")).agg(
        F.round(F.avg("p_size"), 6).alias("p1"), F.round(F.avg("p_retailprice"), 6).alias("p2")
    )


PROPS = """props AS MATERIALIZED (
  SELECT p_type AS member, round(avg(p_size), 6) AS p1, round(avg(p_retailprice), 6) AS p2 FROM part GROUP BY 1)"""


def order_energy(spark: SparkSession, folder: str) -> DataFrame:
    """Average price per unit of each order: (id, e)."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    part = table(spark, folder, "part").select("p_partkey")
    return (
        lines.join(part, lines.l_partkey == part.p_partkey).groupBy(F.col("l_orderkey").alias("id"))
        .agg((F.round(F.sum("l_extendedprice"), 2) / F.sum("l_quantity")).alias("e"))
    )


ENERGY = """energy AS MATERIALIZED (
  SELECT l_orderkey AS id, round(sum(l_extendedprice), 2) / sum(l_quantity) AS e
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


def damaged_features(spark: SparkSession, folder: str) -> DataFrame:
    """Order features with missing, infinite and zero values where other columns are small."""
    return order_features(spark, folder).select(
        "id", "n_lines",
        F.when(F.col("avg_p_size") >= 15, F.col("qty")).alias("qty"),
        "avg_discount",
        F.when(F.col("avg_tax") == 0, F.lit(float("inf"))).otherwise(F.col("avg_tax")).alias("avg_tax"),
        "avg_p_size", "avg_p_retail",
        F.when(F.col("avg_p_size") >= 40, None).when(F.col("avg_discount") < 0.03, 0.0).otherwise(F.col("y")).alias("y"),
    )


F4 = F1 + """, f4 AS MATERIALIZED (
  SELECT id, n_lines, CASE WHEN avg_p_size >= 15 THEN qty END AS qty, avg_discount,
         CASE WHEN avg_tax = 0 THEN CAST('Infinity' AS DOUBLE) ELSE avg_tax END AS avg_tax,
         avg_p_size, avg_p_retail,
         CASE WHEN avg_p_size >= 40 THEN NULL WHEN avg_discount < 0.03 THEN 0.0 ELSE y END AS y
  FROM f1)"""
F4_FINITE = F4 + """, fin AS MATERIALIZED (
  SELECT * REPLACE (CASE WHEN isinf(avg_tax) OR isnan(avg_tax) THEN NULL ELSE avg_tax END AS avg_tax) FROM f4)"""


def class_scores(spark: SparkSession, folder: str, label: str) -> DataFrame:
    """Labelled documents with a score that grows with their length: (id, score, label)."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", label)
    score = F.col("n_chars") / (F.col("n_chars") + 2000.0)
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("id"), F.round(score, 6).alias("score"), F.col(label).alias("label")
    )


F5 = """f5 AS MATERIALIZED (
  SELECT l.doc_id AS id, round(n_chars / (n_chars + CAST(2000 AS DOUBLE)), 6) AS score, {label} AS label
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as sites: structure = label, coordinates = the first three dimensions."""
    e = F.col("embedding")
    return table(spark, folder, "embeddings").select(
        F.col("label").alias("gid"), F.col("vec_id").alias("site"),
        F.array(*[F.round(e[i].cast("double"), 6) for i in range(3)]).alias("c"),
    )


F7 = """f7 AS MATERIALIZED (
  SELECT label AS gid, vec_id AS site, round(CAST(embedding[1] AS DOUBLE), 6) AS x,
         round(CAST(embedding[2] AS DOUBLE), 6) AS y, round(CAST(embedding[3] AS DOUBLE), 6) AS z FROM embeddings)"""

DIMS = [f"d{i:02d}" for i in range(64)]


def embedding_columns(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), *[e[i].cast("double").alias(d) for i, d in enumerate(DIMS)]
    )
