"""Tree models, ensemble spread, leaf affinity, and models of one's own."""

from pyspark.sql import functions as F

from catalog.cleaning import rounded_scores
from catalog.registry import query
from catalog.scoring import split_orders, split_pool
from catalog.sqltext import drawn
from catalog.tables import F1, F4, ORDER_FEATURES, damaged_features
from winnow.operators import models as M
from winnow.operators.affinity import topk_variance, weighted_variance
from winnow.operators.metrics import regression_scores, score_models
from winnow.operators.rank import ensemble_interval
from winnow.plans import grow as G

SMALL = {"trees": 10, "depth": 5}


def small_forest():
    return M.rf(ORDER_FEATURES, **SMALL)


def small_boost(name="xgb"):
    return M.model_by_name(name, ORDER_FEATURES, rounds=5, depth=3)


@query()
def scores_forest(spark, folder):
    return rounded_scores(M.fit_scores(small_forest(), split_orders(spark, folder)))


@query()
def scores_boosted(spark, folder):
    return rounded_scores(M.fit_scores(small_boost(), split_orders(spark, folder)))


@query()
def two_stage(spark, folder):
    rows = damaged_features(spark, folder).na.drop(subset=["y", "qty"]).replace(float("inf"), 0.0, ["avg_tax"])
    fitted = M.xgb_bandgap(ORDER_FEATURES, rounds=5, depth=3).fit(rows)
    return regression_scores(fitted.transform(rows))


@query()
def rf_interval(spark, folder):
    rows = split_orders(spark, folder)
    fitted = small_forest().fit(rows.filter("split = 'train'"))
    return ensemble_interval(fitted.per_tree(rows.filter("split = 'test'"))).select("id", "lower", "upper", "uncertainty")


@query()
def grow_rf_uncertainty(spark, folder):
    pool, test = split_pool(spark, folder)
    models = {"rf": small_forest(), "linear": M.linear(ORDER_FEATURES)}
    return G.grow_rf_uncertainty(models, pool, test, step_frac=0.1, max_rounds=2).curve


@query()
def grow_leaf_affinity(spark, folder):
    pool, test = split_pool(spark, folder)
    models = {"one": M.Ols1("n_lines"), "two": M.linear(ORDER_FEATURES)}
    return G.grow_leaf_affinity(models, pool, test, small_boost("xgb_1tree"), tree_frac=0.8, step_frac=0.1, max_rounds=2).curve


@query(f"WITH {F1} SELECT id, 30 * n_lines + qty AS prediction FROM f1")
def batch_predict(spark, folder):
    rows = split_orders(spark, folder)
    return M.batch_predict(lambda x: 30.0 * x["n_lines"] + x["qty"], ["n_lines", "qty"], rows).select("id", "prediction")


# member predictions of a given ensemble: every feature scaled to the target's range
PREDS = {"n_lines": 40000.0, "qty": 1500.0, "avg_discount": 2e6, "avg_tax": 4e6, "avg_p_size": 6000.0, "avg_p_retail": 170.0}


@query(f"""WITH {F1}, p AS (SELECT id, unnest([{", ".join(f"{c} * {k}" for c, k in PREDS.items())}]) AS v FROM f1),
q AS (SELECT id, quantile_cont(v, 0.05) AS lower, quantile_cont(v, 0.95) AS upper FROM p GROUP BY id)
SELECT id, round(lower, 4) AS lower, round(upper, 4) AS upper, round(upper - lower, 4) AS uncertainty FROM q""")
def interval_from_preds(spark, folder):
    from catalog.tables import order_features

    preds = F.array(*[F.col(c) * F.lit(k) for c, k in PREDS.items()])
    out = ensemble_interval(order_features(spark, folder).select("id", preds.alias("preds")))
    return out.select("id", *[F.round(c, 4).alias(c) for c in ("lower", "upper", "uncertainty")])


# a given leaf table: coarse buckets of the features stand in for trees
LEAVES = {"n_lines": 1.0, "qty": 0.02, "avg_discount": 50.0, "avg_tax": 50.0, "avg_p_size": 0.2, "avg_p_retail": 0.1}
LEAF_SQL = f"""WITH {F1}, {drawn('d', 'f1', 0)}, lf AS MATERIALIZED (
  SELECT id, y, rk <= ceil(CAST(0.1 AS DOUBLE) * n) AS is_val,
         {", ".join(f"CAST(floor({c} * {k}) AS INTEGER) AS l{i}" for i, (c, k) in enumerate(LEAVES.items()))} FROM d)"""


def leaf_tables(spark, folder):
    pool, test = split_pool(spark, folder)
    leaves = F.array(*[F.floor(F.col(c) * F.lit(k)).cast("int") for c, k in LEAVES.items()])
    return test.select("id", leaves.alias("leaves")), pool.select("id", "y", leaves.alias("leaves"))


@query(LEAF_SQL + f""", x AS (SELECT id, y, is_val, unnest([{", ".join(f"{{'t': {i}, 'l': l{i}}}" for i in range(len(LEAVES)))}]) AS u FROM lf),
s AS (SELECT u.t AS t, u.l AS l, count(*) AS n, sum(y) AS sy, sum(y * y) AS syy FROM x WHERE NOT is_val GROUP BY 1, 2),
g AS (SELECT id, CAST(sum(n) AS BIGINT) AS weight, sum(sy) AS a, sum(syy) AS b FROM x JOIN s ON s.t = u.t AND s.l = u.l WHERE is_val GROUP BY id)
SELECT v.id, round(a / weight, 3) AS mean, round(sqrt(b / weight - (a / weight) ** 2), 2) AS deviation, weight
FROM lf v LEFT JOIN g ON g.id = v.id WHERE v.is_val""")
def affinity_variance(spark, folder):
    val, train = leaf_tables(spark, folder)
    out = weighted_variance(val, train)
    return out.select("id", F.round("mean", 3).alias("mean"), F.round(F.sqrt("variance"), 2).alias("deviation"), "weight")


@query(LEAF_SQL + f""", pr AS (SELECT v.id, t.y, t.id AS tid, {" + ".join(f"CAST(v.l{i} = t.l{i} AS BIGINT)" for i in range(len(LEAVES)))} AS aff
  FROM lf v JOIN lf t ON v.is_val AND NOT t.is_val),
b AS (SELECT id, unnest(max(aff * 100000000 - tid, 100)) AS key FROM pr GROUP BY id),
k AS (SELECT b.id, CAST(ceil(key / CAST(100000000 AS DOUBLE)) AS BIGINT) AS aff, key FROM b),
j AS (SELECT k.id, aff, y FROM k JOIN lf t ON t.id = aff * 100000000 - key)
SELECT id, round(avg(y), 4) AS mean, round(var_pop(y) / 1000000, 3) AS variance, CAST(sum(aff) AS BIGINT) AS weight FROM j GROUP BY id""")
def affinity_topk(spark, folder):
    val, train = leaf_tables(spark, folder)
    out = topk_variance(val, train, 100)
    return out.select("id", F.round("mean", 4).alias("mean"), F.round(F.col("variance") / 1000000, 3).alias("variance"), "weight")
