"""Joins and set operations over id lists, run bookkeeping."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sqltext import drawn
from catalog.tables import F1, F2, document_features, order_features, table
from winnow.operators.clean import FeatureSpec
from winnow.operators.split import nested_sizes, rows_by_ids
from winnow.plans.runs import pending_runs
from winnow.sources.features import read_features
from winnow.sources.state import normalise_state


@query("SELECT p_partkey, p_retailprice, p_size FROM part")
def read_feature_table(spark, folder):
    return read_features(spark, f"{folder}/part.parquet", FeatureSpec("p_partkey", "p_retailprice", {"size": ["p_size"]}))


@query(f"""WITH {F1} SELECT id, y FROM f1 JOIN lineitem ON l_orderkey = id""")
def rows_by_repeated_ids(spark, folder):
    ids = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"))
    return rows_by_ids(order_features(spark, folder), ids).select("id", "y")


@query(f"""WITH {F1} SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM f1)""")
def ids_difference(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    return orders.join(order_features(spark, folder).select("id"), "id", "left_anti")


@query(f"""WITH {F1} SELECT id FROM f1 WHERE qty < 100 INTERSECT SELECT id FROM f1 WHERE y < 300000""")
def ids_intersection(spark, folder):
    f1 = order_features(spark, folder)
    return f1.filter("qty < 100").select("id").join(f1.filter("y < 300000").select("id"), "id", "left_semi")


@query(f"""WITH {F1}, a AS (SELECT id, qty FROM f1 WHERE qty < 100), b AS (SELECT id, y FROM f1 WHERE y < 300000)
SELECT coalesce(a.id, b.id) AS id, qty, y FROM a FULL JOIN b ON a.id = b.id""")
def columns_side_by_side(spark, folder):
    f1 = order_features(spark, folder)
    return f1.filter("qty < 100").select("id", "qty").join(f1.filter("y < 300000").select("id", "y"), "id", "full")


@query("""SELECT DISTINCT p_brand AS dataset, p_type AS target FROM part
WHERE (p_brand, p_type) NOT IN (SELECT p_brand, p_type FROM part WHERE p_size >= 45)""")
def pending_grid_runs(spark, folder):
    part = table(spark, folder, "part").select("p_size", F.col("p_brand").alias("dataset"), F.col("p_type").alias("target"))
    done = part.filter("p_size >= 45").select("dataset", "target")
    return pending_runs(part.select("dataset", "target").distinct(), done, ["dataset", "target"])


@query(f"""WITH {F2} SELECT CAST(n_lines AS INTEGER) AS iter, max(y) AS maes, avg(n_words) AS rmse, CAST(NULL AS DOUBLE) AS r2,
  CAST(NULL AS DOUBLE) AS maes_m2, CAST(NULL AS DOUBLE) AS rmse_m2, CAST(NULL AS DOUBLE) AS r2_m2 FROM f2 WHERE lang = 'en' GROUP BY 1
UNION ALL SELECT CAST(n_lines AS INTEGER), max(y), NULL, NULL, min(y), NULL, NULL FROM f2 WHERE lang <> 'en' GROUP BY 1""")
def state_union(spark, folder):
    docs = document_features(spark, folder)
    it = F.col("n_lines").cast("int").alias("iter")
    old = docs.filter("lang = 'en'").groupBy(it).agg(F.max("y").alias("maes"), F.avg("n_words").alias("rmse"))
    new = docs.filter("lang <> 'en'").groupBy(it).agg(F.max("y").alias("maes"), F.min("y").alias("maes_m2"))
    return normalise_state(old, new)


@query(f"""WITH {F1}, {drawn('d', 'f1', 0)}, s AS (
  SELECT id, CASE WHEN rk <= floor(CAST(0.1 AS DOUBLE) * n) THEN 0 WHEN rk <= floor(CAST(0.3 AS DOUBLE) * n) THEN 1 ELSE 2 END AS iter FROM d)
SELECT iter, count(*) AS n_ids, min(id) AS first_id, max(id) AS last_id FROM s GROUP BY iter""")
def accumulated_ids(spark, folder):
    stepped, _ = nested_sizes(order_features(spark, folder), 0, [0.1, 0.3])
    return stepped.groupBy(F.col("step").alias("iter")).agg(
        F.count(F.lit(1)).alias("n_ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )
