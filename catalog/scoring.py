"""Score, statistics and classification queries."""

from pyspark.sql import functions as F

from catalog.cleaning import rounded_scores
from catalog.registry import query
from catalog.sqltext import SCORES, drawn, fit, predict
from catalog.tables import F1, F2, F5, class_scores, document_features, order_features
from winnow.operators import classify as C
from winnow.operators import metrics as M
from winnow.operators.crossval import cv_leave_one_out as leave_one_out
from winnow.operators.models import GroupMean, Ols1, fit_scores
from winnow.operators.split import TRAIN_FRACTIONS, random_split
from winnow.plans.runs import random_baseline

SPLIT = f"""WITH {F1}, {drawn('d', 'f1', 0)}, s AS MATERIALIZED (
  SELECT * EXCLUDE (rk, n), CASE WHEN rk <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split FROM d),
tr AS MATERIALIZED (SELECT * FROM s WHERE split = 'train'), te AS MATERIALIZED (SELECT * FROM s WHERE split = 'test')"""


def split_orders(spark, folder):
    return random_split(order_features(spark, folder).persist(), 0, test_frac=0.2)


@query(f"""{SPLIT}, {fit('m', 'tr', 'ols', 'n_lines')}
SELECT split, count(*) AS n, {SCORES} FROM ({predict('m', 'te', 'ols', 'n_lines')}) GROUP BY split""")
def scores_ols1(spark, folder):
    return rounded_scores(fit_scores(Ols1("n_lines"), split_orders(spark, folder)))


@query(f"""{SPLIT}, {fit('m', 'tr', 'gm', 'qty')}
SELECT split, count(*) AS n, {SCORES} FROM ({predict('m', 'te', 'gm', 'qty')}) GROUP BY split""")
def scores_group_mean(spark, folder):
    return rounded_scores(fit_scores(GroupMean("qty"), split_orders(spark, folder)))


@query(f"""{SPLIT}, {fit('m', 'tr', 'ols', 'qty')}
SELECT split, count(*) AS n, {SCORES} FROM ({predict('m', 's', 'ols', 'qty')}) GROUP BY split""")
def scores_test_and_val(spark, folder):
    rows = split_orders(spark, folder)
    fitted = Ols1("qty").fit(rows.filter("split = 'train'"))
    return rounded_scores(M.scores_test_and_val(fitted.transform(rows)))


@query(f"""WITH {F2}, s AS (SELECT lang, source, y, avg(y) OVER (PARTITION BY lang, source) AS m FROM f2)
SELECT lang, source, count(*) AS n, round(avg(abs(y - m)), 4) AS mad, round(stddev_samp(y), 4) AS std FROM s GROUP BY lang, source""")
def target_stats(spark, folder):
    out = M.target_stats(document_features(spark, folder), "y", ["lang", "source"])
    return out.withColumns({"mad": F.round("mad", 4), "std": F.round("std", 4)})


@query(f"""WITH {F1}, s AS (SELECT y, avg(y) OVER () AS m FROM f1)
SELECT count(*) AS n, round(avg(abs(y - m)), 4) AS mad, round(stddev_samp(y), 4) AS std FROM s""")
def target_stats_total(spark, folder):
    out = M.target_stats(order_features(spark, folder), "y")
    return out.withColumns({"mad": F.round("mad", 4), "std": F.round("std", 4)})


def baseline_sql(seeds: int, result: str) -> str:
    """Every seed and fraction: a fit on the first rows of the draw, scored on test and rest."""
    fractions = ", ".join(str(f) for f in TRAIN_FRACTIONS)
    return f"""WITH {F1}, {drawn('d0', 'f1', 0)},
te AS MATERIALIZED (SELECT id, n_lines, y FROM d0 WHERE rk <= ceil(CAST(0.1 AS DOUBLE) * n)),
pool AS MATERIALIZED (SELECT id, n_lines, y FROM d0 WHERE rk > ceil(CAST(0.1 AS DOUBLE) * n)),
g AS MATERIALIZED (SELECT s.seed, f.f, CAST(floor(f.f * (SELECT count(*) FROM pool)) AS BIGINT) AS n_train
  FROM range({seeds}) s(seed), (SELECT unnest([{fractions}]::DOUBLE[]) AS f) f),
d AS MATERIALIZED (SELECT seed, id, n_lines, y, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || id)) AS rk
  FROM pool, range({seeds}) s(seed)),
m AS MATERIALIZED (SELECT g.seed, f, n_train, round(regr_slope(y, n_lines), 6) AS b, round(regr_intercept(y, n_lines), 6) AS a
  FROM g JOIN d ON d.seed = g.seed AND rk <= n_train GROUP BY ALL),
st AS (SELECT seed, f, n_train, avg(abs(a + b * n_lines - y)) AS mae, sqrt(avg((a + b * n_lines - y) ** 2)) AS rmse,
  1 - avg((a + b * n_lines - y) ** 2) / var_pop(y) AS r2 FROM m, te GROUP BY ALL),
sv AS (SELECT m.seed, f, avg(abs(a + b * n_lines - y)) AS mae_v, sqrt(avg((a + b * n_lines - y) ** 2)) AS rmse_v,
  1 - avg((a + b * n_lines - y) ** 2) / var_pop(y) AS r2_v FROM m JOIN d ON d.seed = m.seed AND rk > n_train GROUP BY ALL),
sc AS (SELECT 'ols' AS model, CAST(st.seed AS INTEGER) AS seed, st.f AS train_size, n_train, mae AS maes, rmse, r2,
  mae_v AS maes_val, rmse_v AS rmse_val, r2_v AS r2_val FROM st JOIN sv ON st.seed = sv.seed AND st.f = sv.f)
{result}"""


def split_pool(spark, folder):
    rows = random_split(order_features(spark, folder).persist(), 0, test_frac=0.1)
    return rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split")


@query(baseline_sql(3, """SELECT model, seed, train_size, n_train, round(maes, 3) AS maes, round(rmse, 3) AS rmse, round(r2, 6) AS r2,
  round(maes_val, 3) AS maes_val, round(rmse_val, 3) AS rmse_val, round(r2_val, 6) AS r2_val FROM sc"""))
def baseline_scores(spark, folder):
    pool, test = split_pool(spark, folder)
    out = random_baseline({"ols": Ols1("n_lines")}, pool, test, range(3))
    digits = {"maes": 3, "rmse": 3, "r2": 6, "maes_val": 3, "rmse_val": 3, "r2_val": 6}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(baseline_sql(3, """SELECT train_size, round(avg(maes_val), 3) AS maes, round(stddev_samp(maes_val), 3) AS maes_std,
  round(avg(rmse_val), 3) AS rmse, round(stddev_samp(rmse_val), 3) AS rmse_std, round(avg(r2_val), 6) AS r2,
  round(stddev_samp(r2_val), 6) AS r2_std FROM sc GROUP BY train_size"""))
def curve_mean_std(spark, folder):
    pool, test = split_pool(spark, folder)
    scores = random_baseline({"ols": Ols1("n_lines")}, pool, test, range(3))
    out = M.curve_mean_std(scores, val=True)
    digits = {"maes": 3, "maes_std": 3, "rmse": 3, "rmse_std": 3, "r2": 6, "r2_std": 6}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(f"""WITH {F1}, h AS (SELECT CAST(qty AS BIGINT) AS value, count(*) AS c FROM f1 GROUP BY 1)
SELECT coalesce(h.value, g.v) AS value, coalesce(c, 0) AS n FROM h FULL JOIN range(1, 231) g(v) ON h.value = g.v""")
def zero_filled_hist(spark, folder):
    return M.zero_filled_histogram(order_features(spark, folder), "qty")


CV_SQL = f"""WITH {F1}, {drawn('d', 'f1', 0)}, q AS (SELECT *, n // 5 AS base, n % 5 AS extra FROM d),
k AS MATERIALIZED (SELECT n_lines, y, CASE WHEN rk <= extra * (base + 1) THEN (rk - 1) // (base + 1)
       ELSE extra + (rk - extra * (base + 1) - 1) // base END AS fold FROM q),
m AS (SELECT g.f, round(regr_slope(y, n_lines), 6) AS b, round(regr_intercept(y, n_lines), 6) AS a
  FROM range(5) g(f) JOIN k ON k.fold <> g.f GROUP BY g.f),
p AS (SELECT f, CASE WHEN fold = f THEN 'test' ELSE 'train' END AS part, y, a + b * n_lines AS pred FROM m, k),
s AS (SELECT f, part, sqrt(avg((pred - y) ** 2)) AS rmse, avg(abs(pred - y)) AS mae,
  avg(abs(pred - y) / greatest(abs(y), 2.220446049250313e-16)) AS mape, 1 - avg((pred - y) ** 2) / var_pop(y) AS r2 FROM p GROUP BY f, part)
SELECT part, round(avg(rmse), 3) AS rmse, round(avg(mae), 3) AS mae, round(avg(mape), 6) AS mape, round(avg(r2), 6) AS r2 FROM s GROUP BY part"""


@query(CV_SQL)
def cv_scores(spark, folder):
    out = M.cv_scores(Ols1("n_lines"), order_features(spark, folder), 5, 0)
    return out.withColumns({"rmse": F.round("rmse", 3), "mae": F.round("mae", 3), "mape": F.round("mape", 6), "r2": F.round("r2", 6)})


@query(f"""WITH {F1}, z AS MATERIALIZED (SELECT count(*) AS n, avg(n_lines) AS mx, avg(y) AS my, var_pop(n_lines) * count(*) AS sxx, covar_pop(n_lines, y) * count(*) AS sxy FROM f1),
e AS MATERIALIZED (SELECT y, my + sxy / sxx * (n_lines - mx) - y AS e, CAST(1 AS DOUBLE) / n + (n_lines - mx) ** 2 / sxx AS h, n FROM f1, z),
t AS (SELECT sum(e * e) AS sse FROM e)
SELECT 'test' AS part, round(avg(abs(e / (1 - h))), 4) AS rmse, round(avg(abs(e / (1 - h))), 4) AS mae, round(avg(abs(e / (1 - h)) / abs(y)), 6) AS mape, CAST(NULL AS DOUBLE) AS r2 FROM e
UNION ALL SELECT 'train', round(avg(sqrt((sse - e * e / (1 - h)) / (n - 1))), 4), NULL, NULL, NULL FROM e, t""")
def cv_leave_one_out(spark, folder):
    out = leave_one_out(Ols1("n_lines"), order_features(spark, folder).persist())
    return out.select("part", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("mape", 6).alias("mape"), "r2")



@query(f"""{SPLIT}, {fit('m', 'tr', 'ols', 'n_lines')}, p AS (SELECT y / 1000 AS y, greatest(a + b * n_lines, 1) / 1000 AS pred FROM te CROSS JOIN m)
SELECT round(avg((pred - y) ** 2), 4) AS mse, round(avg(abs(pred - y)), 4) AS l1,
  round(avg(pred - y * ln(pred + 1e-8) + CASE WHEN y > 1 THEN y * ln(y) - y + 0.5 * ln(2 * pi() * y) ELSE 0 END), 4) AS poisson FROM p""")
def losses(spark, folder):
    rows = split_orders(spark, folder)
    scored = Ols1("n_lines").fit(rows.filter("split = 'train'")).transform(rows.filter("split = 'test'"))
    small = scored.select((F.col("y") / 1000).alias("y"), (F.greatest("prediction", F.lit(1.0)) / 1000).alias("prediction"))
    out = M.losses(small)
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query(f"""WITH {F5.format(label='toxic')}, c AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp,
  count(*) FILTER (WHERE score >= 0.5 AND label <> 1) AS fp, count(*) FILTER (WHERE score < 0.5 AND label <> 1) AS tn,
  count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn FROM f5)
SELECT *, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM c""")
def confusion(spark, folder):
    out = C.confusion(class_scores(spark, folder, "toxic"))
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall")})


ROC = f"""WITH {F5.format(label='quality')}, c AS (SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS pos,
  count(*) FILTER (WHERE label <> 1) AS neg FROM f5 GROUP BY 1),
r AS (SELECT threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
  CAST(sum(pos) OVER () AS DOUBLE) AS p, CAST(sum(neg) OVER () AS DOUBLE) AS q FROM c WINDOW w AS (ORDER BY threshold DESC))"""


@query(f"{ROC} SELECT threshold, tp, fp, round(tp / p, 6) AS tpr, round(fp / q, 6) AS fpr FROM r")
def roc_curve(spark, folder):
    out = C.roc_curve(class_scores(spark, folder, "quality")).drop("pos", "neg")
    return out.withColumns({"tpr": F.round("tpr", 6), "fpr": F.round("fpr", 6)})


@query(f"""WITH {F5.format(label='quality')}, k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM f5),
t AS (SELECT sum(CAST(rk AS DOUBLE)) FILTER (WHERE label = 1) AS s, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS p,
  CAST(count(*) FILTER (WHERE label <> 1) AS DOUBLE) AS q FROM k)
SELECT round((s - p * (p + 1) / 2) / (p * q), 6) AS auc FROM t""")
def roc_auc(spark, folder):
    out = C.roc_auc(class_scores(spark, folder, "quality"))
    return out.select(F.round("auc", 6).alias("auc"))
