"""Cleaning queries."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import (
    COMPOSITIONAL, F1, F2, F4, F4_FINITE, ORDER_FEATURES, STRUCTURAL, damaged_features, document_features,
    order_features, table,
)
from winnow.functions.columns import distinct_members, per_unit
from winnow.operators.clean import (
    FeatureSpec, cap, clean, dedupe, failed_report, inf_to_null, require_target, standardise, with_placeholder_target,
)
from winnow.operators.metrics import score_models
from winnow.operators.models import Log10Target, Ols1
from winnow.operators.split import random_split
from catalog.sqltext import SCORES, drawn

SPEC = FeatureSpec("id", "y", {"structural": STRUCTURAL, "compositional": COMPOSITIONAL})


@query(f"""WITH {F4_FINITE}
SELECT count(*) AS total, count(*) FILTER (WHERE qty IS NULL OR avg_tax IS NULL) AS failed,
       count(*) FILTER (WHERE qty IS NOT NULL AND avg_tax IS NOT NULL) AS success FROM fin""")
def clean_report(spark, folder):
    return failed_report(inf_to_null(damaged_features(spark, folder), ORDER_FEATURES), STRUCTURAL)


@query(f"""WITH {F4_FINITE}
SELECT * FROM fin WHERE y IS NOT NULL AND qty IS NOT NULL AND avg_tax IS NOT NULL AND y <= 400000""")
def clean_rows(spark, folder):
    rows = clean(damaged_features(spark, folder), SPEC, "structural")
    return cap(rows, "y", 400_000.0)


@query(f"WITH {F4} SELECT id, y FROM f4 WHERE y <= 300000")
def cap_outliers(spark, folder):
    return cap(damaged_features(spark, folder), "y", 300_000.0).select("id", "y")


@query(f"WITH {F4} SELECT id, qty, y FROM f4 WHERE qty IS NOT NULL")
def transfer_target(spark, folder):
    return require_target(damaged_features(spark, folder), "y", "qty").select("id", "qty", "y")


@query(f"WITH {F1} SELECT id, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END, 6) AS {c}"
    for c in ORDER_FEATURES) + " FROM f1")
def standardise_all(spark, folder):
    z = standardise(order_features(spark, folder), ORDER_FEATURES)
    return z.select("id", *[F.round(c, 6).alias(c) for c in ORDER_FEATURES])


@query(f"""WITH {F1}, {drawn('d', 'f1', 0)}, s AS MATERIALIZED (
  SELECT *, CASE WHEN rk <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split FROM d),
st AS (SELECT avg(qty) AS m, stddev_pop(qty) AS sd FROM s WHERE split = 'train')
SELECT id, split, round((qty - m) / sd, 6) AS qty FROM s CROSS JOIN st""")
def standardise_on_train(spark, folder):
    rows = random_split(order_features(spark, folder), 0, test_frac=0.2)
    z = standardise(rows, ["qty"], fit_on=rows.filter("split = 'train'"))
    return z.select("id", "split", F.round("qty", 6).alias("qty"))


@query(f"""WITH {F1}, {drawn('d', 'f1', 0)}, s AS MATERIALIZED (
  SELECT *, CASE WHEN rk <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split FROM d),
m AS MATERIALIZED (SELECT round(regr_slope(log10(y), n_lines), 6) AS b, round(regr_intercept(log10(y), n_lines), 6) AS a
  FROM s WHERE split = 'train'),
p AS (SELECT split, y, pow(10, a + b * n_lines) AS pred FROM s CROSS JOIN m WHERE split = 'test')
SELECT split, count(*) AS n, {SCORES} FROM p GROUP BY split""")
def log_target_scores(spark, folder):
    rows = random_split(order_features(spark, folder), 0, test_frac=0.2)
    fitted = Log10Target(Ols1("n_lines")).fit(rows.filter("split = 'train'"))
    return rounded_scores(score_models(rows.filter("split = 'test'"), {"m": fitted}).drop("model"))


def rounded_scores(df):
    return df.withColumns({"mae": F.round("mae", 4), "rmse": F.round("rmse", 4), "r2": F.round("r2", 6)})


@query("SELECT min(doc_id) AS doc_id, min(n_chars) AS n_chars FROM documents GROUP BY text")
def dedupe_first(spark, folder):
    docs = table(spark, folder, "documents").select("text", "doc_id", "n_chars")
    return dedupe(docs, "text", ["doc_id"]).select("doc_id", "n_chars")


@query(f"WITH {F2} SELECT id, n_words, n_lines, lang, source, CAST(-9999 AS DOUBLE) AS y FROM f2")
def placeholder_target(spark, folder):
    rows = document_features(spark, folder).drop("y").withColumnRenamed("id", "doc_id")
    return with_placeholder_target(rows, "y", id_from="doc_id")


@query("""SELECT l_orderkey AS id, round(sum(l_extendedprice), 2) / sum(l_quantity) AS per_unit
FROM lineitem GROUP BY 1""")
def per_unit_values(spark, folder):
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("total"), F.sum("l_quantity").alias("units")
    )
    return lines.select("id", per_unit("total", "units").alias("per_unit"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(text, ' '))), ' ') AS members,
       CAST(len(list_distinct(string_split(text, ' '))) AS INTEGER) AS n_members FROM documents""")
def distinct_members_of_rows(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", distinct_members(F.split("text", " ")).alias("m"))
    return docs.select("doc_id", F.array_join("m", " ").alias("members"), F.size("m").alias("n_members"))
