"""Column redundancy, deletion influence, projection."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import DIMS, F1, ORDER_FEATURES, embedding_columns, order_features
from winnow.operators import columns as C
from winnow.operators import influence as I
from winnow.operators.project import project_2d as project

PAIRS = [(a, b) for i, a in enumerate(sorted(ORDER_FEATURES)) for b in sorted(ORDER_FEATURES)[i + 1:]]
HOLES = {"avg_tax": "avg_discount < 0.02", "qty": "avg_p_size < 10"}


def holed(spark, folder):
    f1 = order_features(spark, folder)
    return f1.withColumns({c: F.expr(f"CASE WHEN {cond} THEN NULL ELSE {c} END") for c, cond in HOLES.items()})


HOLED = F1 + ", ho AS MATERIALIZED (SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN {cond} THEN NULL ELSE {c} END AS {c}" for c, cond in HOLES.items()) + ") FROM f1)"


@query(f"WITH {HOLED} " + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(abs(corr({a}, {b})), 6) AS r FROM ho" for a, b in PAIRS))
def corr_pairs(spark, folder):
    return C.corr_pairs(holed(spark, folder), ORDER_FEATURES).withColumn("r", F.round("r", 6))


EMBED = "e AS MATERIALIZED (SELECT " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS {d}" for i, d in enumerate(DIMS)) + " FROM embeddings)"
DIM_PAIRS = [(a, b) for i, a in enumerate(DIMS) for b in DIMS[i + 1:]]
CORR_ROW = f"WITH {EMBED}, c AS MATERIALIZED (SELECT " + ", ".join(
    f"corr({a}, {b}) AS {a}_{b}" for a, b in DIM_PAIRS) + " FROM e), u AS MATERIALIZED (SELECT unnest([" + ", ".join(
    f"{{'a': '{a}', 'b': '{b}', 'r': abs({a}_{b})}}" for a, b in DIM_PAIRS) + "]) AS s FROM c), " + \
    "p AS MATERIALIZED (SELECT s.a AS a, s.b AS b, s.r AS r FROM u), bo AS (SELECT a AS col, r FROM p UNION ALL SELECT b, r FROM p)"


@query(CORR_ROW + """ SELECT col, count(*) FILTER (WHERE r >= 0.1) AS n_high, round(max(r), 6) AS max_r, round(sum(r) / 64, 6) AS mean_r
FROM bo GROUP BY col""")
def corr_column_stats(spark, folder):
    pairs = C.corr_pairs(embedding_columns(spark, folder), DIMS)
    out = C.corr_column_stats(pairs, len(DIMS), 0.1)
    return out.withColumns({"max_r": F.round("max_r", 6), "mean_r": F.round("mean_r", 6)})


STEP = """SELECT list_filter(cols, lambda x: x <> worst) AS cols, list_append(dropped, worst) AS dropped FROM (
  SELECT cols, dropped, (SELECT arg_max(col, (n, mx, mn, col)) FROM (
      SELECT col, count(*) FILTER (WHERE r >= 0.2) AS n, max(round(r, 12)) AS mx, round(sum(round(r, 12)) / len(g.cols), 12) AS mn
      FROM bo2 WHERE list_contains(g.cols, col) AND list_contains(g.cols, oth) GROUP BY col) WHERE n > 0) AS worst FROM greedy g) WHERE worst IS NOT NULL"""


@query(f"WITH RECURSIVE {F1}, p AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM f1" for a, b in PAIRS) +
    "), bo2 AS MATERIALIZED (SELECT a AS col, b AS oth, r FROM p UNION ALL SELECT b, a, r FROM p), "
    f"greedy AS (SELECT [{', '.join(repr(c) for c in ORDER_FEATURES)}] AS cols, CAST([] AS VARCHAR[]) AS dropped UNION ALL {STEP}) "
    "SELECT array_to_string(cols, ',') AS kept, array_to_string(dropped, ',') AS dropped FROM greedy ORDER BY len(cols) LIMIT 1")
def drop_correlated(spark, folder):
    kept, dropped = C.drop_correlated(order_features(spark, folder), ORDER_FEATURES, 0.2)
    return spark.createDataFrame([(",".join(kept), ",".join(dropped))], "kept string, dropped string")


RANKED = F1 + ", rk AS MATERIALIZED (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / CAST(2 AS DOUBLE) AS {c}" for c in ORDER_FEATURES) + " FROM f1)"


@query(f"WITH {RANKED} " + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(abs(corr({a}, {b})), 6) AS r FROM rk" for a, b in PAIRS))
def corr_spearman(spark, folder):
    return C.corr_pairs(order_features(spark, folder), ORDER_FEATURES, "spearman").withColumn("r", F.round("r", 6))


def ranked_pair(a: str, b: str) -> str:
    """Both columns ranked among the rows that have both."""
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / CAST(2 AS DOUBLE)".format
    return f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(abs(corr(x, z)), 6) AS r
FROM (SELECT {rank(a)} AS x, {rank(b)} AS z FROM ho WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query(f"WITH {HOLED} " + " UNION ALL ".join(ranked_pair(a, b) for a, b in PAIRS))
def corr_spearman_with_gaps(spark, folder):
    return C.corr_pairs(holed(spark, folder), ORDER_FEATURES, "spearman").withColumn("r", F.round("r", 6))


# least squares without one row, from sums about the means
LOO = f"""WITH {F1}, z AS MATERIALIZED (SELECT count(*) AS n, avg(qty) AS mx, avg(y) AS my, var_pop(qty) * count(*) AS sxx,
  covar_pop(qty, y) * count(*) AS sxy FROM f1),
l AS MATERIALIZED (SELECT id, qty AS x, y, qty - mx AS dx, y - my AS dy, n, mx, my, sxx, sxy FROM f1, z),
m AS MATERIALIZED (SELECT id, x, y, (sxy - dx * dy * n / (n - 1)) / (sxx - dx * dx * n / (n - 1)) AS b,
  my - dy / (n - 1) - (sxy - dx * dy * n / (n - 1)) / (sxx - dx * dx * n / (n - 1)) * (mx - dx / (n - 1)) AS a FROM l),
r AS MATERIALIZED (SELECT sxy / sxx AS b0, my - sxy / sxx * mx AS a0 FROM z)"""


@query(f"""{LOO}, xs AS MATERIALIZED (SELECT qty AS xj, count(*) AS c FROM f1 GROUP BY 1),
d AS (SELECT id, abs(a - a0 + (b - b0) * x) AS self_abs, abs((a - a0 + (b - b0) * x) / (a0 + b0 * x)) AS self_pct,
  abs(a - a0 + (b - b0) * xj) AS dj, abs((a - a0 + (b - b0) * xj) / (a0 + b0 * xj)) AS pj, c FROM m, r, xs)
SELECT id, round(any_value(self_abs), 3) AS self_abs, round(any_value(self_pct), 6) AS self_pct, round(max(dj), 3) AS max_abs,
  round(sum(dj * c) / sum(c), 3) AS mean_abs, round(sum(pj * c) / sum(c), 6) AS mean_pct FROM d GROUP BY id""")
def influence_loo(spark, folder):
    out = I.deletion_influence(order_features(spark, folder).persist(), "qty")
    digits = {"self_abs": 3, "self_pct": 6, "max_abs": 3, "mean_abs": 3, "mean_pct": 6}
    return out.select("id", *[F.round(c, d).alias(c) for c, d in digits.items()])


# the same of log10(y): predictions are powers of ten
LOG_LOO = LOO.replace(f"WITH {F1}", f"WITH {F1}, g1 AS MATERIALIZED (SELECT * REPLACE (log10(y) AS y) FROM f1)").replace("sxy FROM f1)", "sxy FROM g1)").replace("sxy FROM f1, z)", "sxy FROM g1, z)")


@query(f"""{LOG_LOO}, xs AS MATERIALIZED (SELECT qty AS xj, count(*) AS c FROM g1 GROUP BY 1),
d AS (SELECT id, abs(10 ** (a + b * x) - 10 ** (a0 + b0 * x)) AS self_abs, abs(10 ** (a + b * x - a0 - b0 * x) - 1) AS self_pct,
  abs(10 ** (a + b * xj) - 10 ** (a0 + b0 * xj)) AS dj, abs(10 ** (a + b * xj - a0 - b0 * xj) - 1) AS pj, c FROM m, r, xs)
SELECT id, round(any_value(self_abs), 3) AS self_abs, round(any_value(self_pct), 6) AS self_pct,
  round(sum(dj * c) / sum(c), 3) AS mean_abs, round(sum(pj * c) / sum(c), 6) AS mean_pct FROM d GROUP BY id""")
def influence_loo_log(spark, folder):
    out = I.deletion_influence_log(order_features(spark, folder).persist(), "qty")
    digits = {"self_abs": 3, "self_pct": 6, "mean_abs": 3, "mean_pct": 6}
    return out.select("id", *[F.round(c, d).alias(c) for c, d in digits.items()])


TWO = f"""WITH {F1}, s AS (SELECT count(*) AS n, avg(qty) AS mx, avg(avg_p_size) AS mz, avg(y) AS my, count(*) * covar_pop(qty, qty) AS xx,
  count(*) * covar_pop(qty, avg_p_size) AS xz, count(*) * covar_pop(avg_p_size, avg_p_size) AS zz, count(*) * covar_pop(qty, y) AS xy,
  count(*) * covar_pop(avg_p_size, y) AS zy FROM f1),
b AS (SELECT *, xx * zz - xz * xz AS det, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS b2 FROM s),
e AS MATERIALIZED (SELECT id, n, qty - mx AS dx, avg_p_size - mz AS dz, my + b1 * (qty - mx) + b2 * (avg_p_size - mz) - y AS e, xx, xz, zz, det FROM f1, b),
h AS MATERIALIZED (SELECT *, CAST(1 AS DOUBLE) / n + (dx * dx * zz - 2 * dx * dz * xz + dz * dz * xx) / det AS h FROM e)"""


@query(f"{TWO} SELECT id, round(abs(h * e / (1 - h)), 4) AS self_abs, round(abs(e / (1 - h)) * sqrt(h / n), 4) AS rms_abs FROM h")
def influence_loo_two_features(spark, folder):
    out = I.linear_influence(order_features(spark, folder).persist(), ["qty", "avg_p_size"])
    return out.select("id", F.round("self_abs", 4).alias("self_abs"), F.round("rms_abs", 4).alias("rms_abs"))


def order_pairs(f1):
    """Each order with itself and with the order numbered next."""
    return f1.select(F.col("id").alias("removed_id"), "id").unionByName(
        f1.select((F.col("id") - 1).alias("removed_id"), "id").join(f1.select(F.col("id").alias("removed_id")), "removed_id", "left_semi")
    )


PAIR_ROWS = """pr AS (SELECT id AS removed_id, id FROM f1 UNION ALL SELECT a.id, b.id FROM f1 a JOIN f1 b ON b.id = a.id + 1)"""


@query(f"""{LOO}, {PAIR_ROWS}
SELECT removed_id, pr.id, round(abs(m.a + m.b * f.qty - a0 - b0 * f.qty), 3) AS abs_influ,
  round(abs((m.a + m.b * f.qty - a0 - b0 * f.qty) / (a0 + b0 * f.qty)), 6) AS pct_influ
FROM pr JOIN m ON m.id = removed_id JOIN f1 f ON f.id = pr.id CROSS JOIN r""")
def influence_pairs(spark, folder):
    f1 = order_features(spark, folder).persist()
    out = I.influence_of_pairs(f1, order_pairs(f1), "qty")
    return out.withColumns({"abs_influ": F.round("abs_influ", 3), "pct_influ": F.round("pct_influ", 6)})


@query(f"""{LOO}, {PAIR_ROWS}, j AS (SELECT removed_id, pr.id, i.dx + k.dx AS ax, i.dy + k.dy AS ay, i.sxx - i.dx ** 2 - k.dx ** 2 AS qx,
  i.sxy - i.dx * i.dy - k.dx * k.dy AS qxy, i.n - 2 AS h, i.mx, i.my, k.x AS xj FROM pr JOIN l i ON i.id = removed_id JOIN l k ON k.id = pr.id),
t AS (SELECT *, (qxy - ax * ay / h) / (qx - ax * ax / h) AS b2 FROM j),
v AS (SELECT t.removed_id, t.id, m.a + m.b * xj AS ref, CASE WHEN t.removed_id = t.id THEN m.a + m.b * xj
  ELSE my - ay / h - b2 * (mx - ax / h) + b2 * xj END AS val FROM t JOIN m ON m.id = t.removed_id)
SELECT removed_id, id, round(abs(val - ref), 3) AS abs_influ, round(abs((val - ref) / ref), 6) AS pct_influ FROM v""")
def influence_pairs_rm_self(spark, folder):
    f1 = order_features(spark, folder).persist()
    out = I.influence_of_pairs(f1, order_pairs(f1), "qty", rm_self=True)
    return out.withColumns({"abs_influ": F.round("abs_influ", 3), "pct_influ": F.round("pct_influ", 6)})


@query(f"""{TWO}, {PAIR_ROWS} SELECT removed_id, pr.id, round(abs((CAST(1 AS DOUBLE) / i.n + (i.dx * k.dx * i.zz - (i.dx * k.dz + i.dz * k.dx) * i.xz
  + i.dz * k.dz * i.xx) / i.det) * i.e / (1 - i.h)), 4) AS abs_influ FROM pr JOIN h i ON i.id = removed_id JOIN h k ON k.id = pr.id""")
def influence_pairs_two_features(spark, folder):
    f1 = order_features(spark, folder).persist()
    out = I.linear_influence_of_pairs(f1, order_pairs(f1), ["qty", "avg_p_size"])
    return out.withColumn("abs_influ", F.round("abs_influ", 4))


@query()
def project_2d(spark, folder):
    z, _ = project(embedding_columns(spark, folder), DIMS)
    return z
