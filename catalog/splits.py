"""Split and sampling queries."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sqltext import drawn
from catalog.tables import F1, F2, document_features, order_features
from winnow.operators import split as S
from winnow.operators.rank import bottom_k, drop_largest, global_rank, top_k
from winnow.sources.features import parse_split

D0 = f"WITH {F1}, {drawn('d', 'f1', 0)}"


@query(f"{D0} SELECT id, CASE WHEN rk <= ceil(CAST(0.1 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split FROM d")
def split_random(spark, folder):
    return S.random_split(order_features(spark, folder), 0, test_frac=0.1).select("id", "split")


@query(f"""WITH {F1}, free AS (SELECT * FROM f1 WHERE n_lines > 1), {drawn('d', 'free', 3)}
SELECT id, CASE WHEN rk <= ceil(CAST(0.1 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split FROM d
UNION ALL SELECT id, 'fixed' AS split FROM f1 WHERE n_lines = 1""")
def split_fixed(spark, folder):
    f1 = order_features(spark, folder)
    fixed = f1.filter("n_lines = 1").select("id")
    return S.fixed_train_split(f1, fixed, 3, 0.1).select("id", "split")


@query(f"""WITH {F1}, r AS (SELECT id, row_number() OVER (ORDER BY qty, id) AS rk, count(*) OVER () AS n FROM f1)
SELECT id, CASE WHEN rk <= floor(CAST(0.3 AS DOUBLE) * n) THEN 'train' ELSE 'val' END AS split FROM r""")
def split_prefix(spark, folder):
    return S.prefix_split(order_features(spark, folder), 0.3, ["qty"]).select("id", "split")


@query("""SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'train' WHEN 'de' THEN 'val' ELSE 'test' END AS split,
       CAST(n_chars AS DOUBLE) AS y FROM documents""")
def split_predefined(spark, folder):
    docs = document_features(spark, folder)
    name = F.when(F.col("lang") == "en", "train").when(F.col("lang") == "de", "val").otherwise("test")
    # the split file's format, one text per row
    entry = F.create_map(name, F.create_map(F.col("id").cast("string"), F.col("source")))
    texts = docs.select(F.to_json(entry).alias("value"))
    assignment = parse_split(texts, "value", "bigint")
    return S.predefined_split(docs, assignment).select("id", "split", "y")


@query(f"""{D0}, q AS (SELECT *, n // 5 AS base, n % 5 AS extra FROM d)
SELECT id, CAST(CASE WHEN rk <= extra * (base + 1) THEN (rk - 1) // (base + 1)
       ELSE extra + (rk - extra * (base + 1) - 1) // base END AS INTEGER) AS fold FROM q""")
def kfold(spark, folder):
    return S.kfold(order_features(spark, folder), 5, 0).select("id", "fold")


@query(f"""WITH {F1}, {drawn('d', 'f1', 7)} SELECT id FROM d WHERE rk <= floor(CAST(0.01 AS DOUBLE) * n)""")
def seed_sample(spark, folder):
    f1 = order_features(spark, folder)
    return S.seed_sample(f1, int(0.01 * f1.count()), 7).select("id")


@query(f"""WITH {F1}, {drawn('d', 'f1', 4)} SELECT id FROM d WHERE rk <= round_even(CAST(0.25 AS DOUBLE) * n, 0)""")
def frac_sample(spark, folder):
    return S.frac_sample(order_features(spark, folder), 0.25, 4).select("id")


@query(f"""WITH {F1}, {drawn('d', 'f1', 0)},
g AS (SELECT unnest([{", ".join(str(f) for f in S.TRAIN_FRACTIONS)}]::DOUBLE[]) AS train_frac)
SELECT train_frac, count(*) AS n_train, round(sum(y), 2) AS sum_y
FROM g JOIN d ON rk <= floor(train_frac * n) GROUP BY train_frac""")
def train_size_grid(spark, folder):
    stepped, _ = S.nested_sizes(order_features(spark, folder), 0)
    per_step = stepped.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    # one row per fraction, holding the steps up to its own: at most len(fractions) + 1
    at = F.array_position(F.array(*map(F.lit, S.TRAIN_FRACTIONS)), F.col("train_frac")) - 1
    grid = S.train_size_grid(spark, [0], ["m"]).select("train_frac", F.explode(F.sequence(F.lit(0).cast("long"), at)).alias("step"))
    return grid.join(per_step, "step").groupBy("train_frac").agg(F.sum("n").alias("n_train"), F.round(F.sum("s"), 2).alias("sum_y"))


@query(f"""WITH {F2} SELECT id, 'train' AS split FROM f2 WHERE lang <> 'en'
UNION ALL SELECT id, 'test' AS split FROM f2 WHERE lang = 'en'""")
def ood_split(spark, folder):
    later = document_features(spark, folder)
    older = later.filter("lang <> 'en'")
    return S.ood_split(older, later).select("id", "split")


@query(f"""WITH {F1} SELECT id, CASE WHEN n_lines >= 4 THEN 'train' ELSE 'val' END AS split FROM f1""")
def split_by_ids(spark, folder):
    f1 = order_features(spark, folder)
    return S.split_by_ids(f1, f1.filter("n_lines >= 4").select("id")).select("id", "split")


def quantile_sql(target: str, result: str) -> str:
    return f"""WITH {F1}, r AS MATERIALIZED (
  SELECT id, {target} AS t, row_number() OVER (ORDER BY {target}, id) - 1 AS pos, count(*) OVER () AS n FROM f1),
q AS (SELECT i, ((SELECT max(n) FROM r) - 1) * i // 99 AS pos FROM range(100) g(i)),
v AS (SELECT i, t FROM q JOIN r USING (pos)),
l AS (SELECT {target} AS t, max(id) AS id FROM f1 GROUP BY 1)
{result}"""


@query(quantile_sql("y", "SELECT DISTINCT id FROM v JOIN l USING (t)"))
def quantile_seeds(spark, folder):
    return S.quantile_seeds(order_features(spark, folder), "y", 100)


@query(quantile_sql("n_lines", "SELECT id, count(*) AS times FROM v JOIN l USING (t) GROUP BY 1"))
def quantile_seeds_repeated(spark, folder):
    seeds = S.quantile_seeds(order_features(spark, folder), "n_lines", 100, distinct=False)
    return seeds.groupBy("id").agg(F.count(F.lit(1)).alias("times"))


GAPS = "CASE WHEN avg_p_size >= 15 THEN qty END"


@query(quantile_sql("y", "SELECT DISTINCT id FROM v JOIN l USING (t)").replace("FROM f1)", "FROM f1 WHERE avg_p_size >= 25)").replace(
    "max(id) AS id FROM f1 GROUP", "max(id) AS id FROM f1 WHERE avg_p_size >= 25 GROUP"))
def quantile_seeds_with_nulls(spark, folder):
    gaps = order_features(spark, folder).withColumn("y", F.when(F.col("avg_p_size") >= 25, F.col("y")))
    return S.quantile_seeds(gaps, "y", 100)


def with_gaps(spark, folder):
    return order_features(spark, folder).withColumn("qty", F.when(F.col("avg_p_size") >= 15, F.col("qty")))


@query(f"WITH {F1} SELECT id, {GAPS} AS qty FROM f1 WHERE {GAPS} IS NOT NULL ORDER BY 2, id LIMIT 500")
def bottom_k_with_nulls(spark, folder):
    return bottom_k(with_gaps(spark, folder), "qty", 500).select("id", "qty")


@query(f"WITH {F1} SELECT id, {GAPS} AS qty FROM f1 WHERE {GAPS} IS NOT NULL ORDER BY 2 DESC, id LIMIT 500")
def top_k_with_nulls(spark, folder):
    return top_k(with_gaps(spark, folder), "qty", 500).select("id", "qty")


@query(f"WITH {F1} SELECT id, row_number() OVER (ORDER BY qty, id) AS rank FROM f1")
def exact_rank(spark, folder):
    return global_rank(order_features(spark, folder).select("id", "qty"), ["qty", "id"]).select("id", "rank")


@query(f"WITH {F1} SELECT id, qty FROM f1 ORDER BY qty DESC, id LIMIT 500")
def top_k_rows(spark, folder):
    return top_k(order_features(spark, folder), "qty", 500).select("id", "qty")


@query(f"WITH {F1} SELECT id, qty FROM f1 ORDER BY qty, id LIMIT 500")
def bottom_k_rows(spark, folder):
    return bottom_k(order_features(spark, folder), "qty", 500).select("id", "qty")


@query(f"""WITH {F1}, r AS (SELECT id, qty, row_number() OVER (ORDER BY qty DESC, id) AS down FROM f1)
SELECT id, qty FROM r WHERE qty < 40 OR down <= 25""")
def drop_largest_rows(spark, folder):
    return drop_largest(order_features(spark, folder), "qty", 40.0, 25).select("id", "qty")
