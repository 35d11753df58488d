"""Pruning and growing loops, unrolled in SQL."""

from pyspark.sql import functions as F

from catalog.cleaning import rounded_scores
from catalog.registry import query
from catalog.scoring import split_pool
from catalog.sqltext import SCORES, drawn, fit, half_mae, predict, prune_sql
from catalog.tables import F1, F2, document_features, order_features
from winnow.operators.models import GroupMean, Ols1
from winnow.operators.split import random_split
from winnow.plans import grow as G
from winnow.plans.prune import guided_prune, prune, prune_threshold
from winnow.plans.runs import train_on_pruned
from winnow.sources.state import new_run_dir

GAP_OLS = ("ols", "qx")
OLS, GM = ("ols", "n_lines"), ("gm", "n_lines")
HALF = half_mae("full_a", OLS)


def chosen(result):
    return result.proposed.select("id", "iter", "err")


@query(prune_sql(F1, "f1", 1, 0.8, HALF, "SELECT * FROM chosen"))
def prune_iter0(spark, folder):
    pool, test = split_pool(spark, folder)
    model = Ols1("n_lines")
    return chosen(prune(model, pool, test, prune_threshold(model, pool, test), 0.8, max_iter=1))


def pruned_three(spark, folder, **settings):
    pool, test = split_pool(spark, folder)
    model = Ols1("n_lines")
    return prune(model, pool, test, prune_threshold(model, pool, test), 0.8, max_iter=3, **settings)


@query(prune_sql(F1, "f1", 3, 0.8, HALF, "SELECT * FROM chosen"))
def prune_3iter(spark, folder):
    return chosen(pruned_three(spark, folder))


@query(prune_sql(F1, "f1", 3, 0.8, HALF, "SELECT * FROM chosen"))
def prune_resumed(spark, folder):
    """One iteration, then the same run taken up again to three."""
    run = new_run_dir(spark)
    pool, test = split_pool(spark, folder)
    model = Ols1("n_lines")
    threshold = prune_threshold(model, pool, test)
    for until in (1, 3):
        result = prune(model, pool, test, threshold, 0.8, max_iter=until, run_dir=run)
    return chosen(result)


@query(prune_sql(F1 + ", g1 AS MATERIALIZED (SELECT *, CASE WHEN avg_p_size >= 20 THEN n_lines END AS qx FROM f1)", "g1", 3, 0.8,
                 "(SELECT 0.01)", "SELECT * FROM chosen", model=GAP_OLS, min_drop="5").replace("row_number() OVER (ORDER BY drv, id) AS up", "row_number() OVER (ORDER BY drv NULLS LAST, id) AS up")
       .replace("ELSE small END", "ELSE coalesce(small, false) END").replace("THEN up <= 5", "THEN up <= 5 AND drv IS NOT NULL"))
def prune_with_missing_features(spark, folder):
    """A feature is missing on many rows: these have no error and stay."""
    rows = order_features(spark, folder).withColumn("qx", F.when(F.col("avg_p_size") >= 20, F.col("n_lines")))
    rows = random_split(rows, 0, test_frac=0.1).persist()
    pool, test = rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split")
    return chosen(prune(Ols1("qx"), pool, test, 0.01, 0.8, min_drop=5, max_iter=3))


@query(prune_sql(F1, "f1", 3, 0.8, HALF, "SELECT * FROM scores", second=GM))
def prune_transfer(spark, folder):
    pool, test = split_pool(spark, folder)
    return rounded_scores(guided_prune(Ols1("n_lines"), GroupMean("n_lines"), pool, test, max_iter=3).scores)


@query(prune_sql(F1, "f1", 3, 0.8, HALF, """SELECT CAST(i AS INTEGER) AS iter, v AS val_size, v / p AS val_ratio,
  CAST(p AS BIGINT) - v AS train_size, 1 - v / p AS train_ratio FROM (SELECT i, (SELECT count(*) FROM chosen WHERE iter < i) AS v,
  (SELECT CAST(count(*) AS DOUBLE) FROM pool) AS p FROM range(3) g(i))"""))
def prune_curve(spark, folder):
    return pruned_three(spark, folder).curve


@query(prune_sql(F1, "f1", 2, 0.8, half_mae("full_a", OLS, 0.005), "SELECT * FROM chosen"))
def prune_min_drop(spark, folder):
    pool, test = split_pool(spark, folder)
    model = Ols1("n_lines")
    threshold = model.fit(pool).transform(test).agg(F.round(F.avg(F.abs(F.col("prediction") - F.col("y"))) * 0.005, 6)).first()[0]
    return chosen(prune(model, pool, test, threshold, 0.8, max_iter=2))


@query(prune_sql(F1, "f1", 2, 0.8, HALF, "SELECT * FROM chosen", drop_max=50))
def prune_drop_max(spark, folder):
    pool, test = split_pool(spark, folder)
    model = Ols1("n_lines")
    return chosen(prune(model, pool, test, prune_threshold(model, pool, test), 0.8, max_iter=2, drop_max_err=50))


@query(prune_sql(F1, "f1", 4, 0.3, half_mae("full_a", OLS, 2.0), "SELECT * FROM chosen", min_remaining=4000))
def prune_stop(spark, folder):
    pool, test = split_pool(spark, folder)
    model = Ols1("n_lines")
    threshold = model.fit(pool).transform(test).agg(F.round(F.avg(F.abs(F.col("prediction") - F.col("y"))) * 2.0, 6)).first()[0]
    return chosen(prune(model, pool, test, threshold, 0.3, max_iter=4, min_remaining=4000))


@query(prune_sql(F1, "f1", 2, 0.8, half_mae("full_a", OLS), "SELECT * FROM chosen", second=("ols", "qty"), join_model=True,
                 threshold2=half_mae("full_b", ("ols", "qty"))))
def prune_join_model(spark, folder):
    pool, test = split_pool(spark, folder)
    one, two = Ols1("n_lines"), Ols1("qty")
    return chosen(prune(one, pool, test, prune_threshold(one, pool, test), 0.8, max_iter=2, model_test=two, join_model=True,
                        threshold2=prune_threshold(two, pool, test)))


@query(prune_sql(F1, "f1", 2, 0.8, HALF, "SELECT * FROM chosen", fixed="n_lines = 1"))
def prune_fixed_train(spark, folder):
    f1 = order_features(spark, folder).persist()
    fixed = f1.filter("n_lines = 1")
    rows = random_split(f1.join(fixed.select("id"), "id", "left_anti"), 0, test_frac=0.1)
    pool, test = rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split")
    model = Ols1("n_lines")
    return chosen(prune(model, pool, test, prune_threshold(model, pool, test), 0.8, max_iter=2, fixed_train=fixed))


DOC = ("ols", "n_words")


@query(prune_sql(F2, "f2", 2, 0.8, half_mae("full_a", DOC), "SELECT * FROM chosen", model=DOC))
def prune_documents(spark, folder):
    rows = random_split(document_features(spark, folder), 0, test_frac=0.1).persist()
    pool, test = rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split")
    model = Ols1("n_words")
    return chosen(prune(model, pool, test, prune_threshold(model, pool, test), 0.8, max_iter=2))


RANKED = """, rk AS (SELECT p.id, c.iter, c.err, row_number() OVER (ORDER BY c.iter DESC NULLS FIRST, c.err DESC NULLS FIRST, p.id) AS rank
  FROM pool p LEFT JOIN (SELECT * FROM chosen WHERE iter < 2) c ON c.id = p.id)"""


def ranked_sql(result: str) -> str:
    return prune_sql(F1, "f1", 3, 0.8, HALF, f"{RANKED} {result}")


@query(ranked_sql("SELECT id, rank FROM rk"))
def redundancy_rank(spark, folder):
    return pruned_three(spark, folder).ranking().select("id", "rank")


@query(ranked_sql(f""", small AS MATERIALIZED (SELECT p.* FROM pool p JOIN rk ON rk.id = p.id
  WHERE rank <= floor(CAST(0.3 AS DOUBLE) * (SELECT count(*) FROM pool))), {fit('ft', 'small', *OLS)}
SELECT count(*) AS n, {SCORES} FROM ({predict('ft', 'test', *OLS)})"""))
def train_on_pruned_rows(spark, folder):
    pool, test = split_pool(spark, folder)
    model = Ols1("n_lines")
    result = prune(model, pool, test, prune_threshold(model, pool, test), 0.8, max_iter=3)
    return rounded_scores(train_on_pruned(model, pool, test, result.ranking(), 0.3))


POOL = f"""WITH {F1}, {drawn('d', 'f1', 0)},
test AS MATERIALIZED (SELECT * EXCLUDE (rk, n) FROM d WHERE rk <= ceil(CAST(0.1 AS DOUBLE) * n)),
pool AS MATERIALIZED (SELECT * EXCLUDE (rk, n) FROM d WHERE rk > ceil(CAST(0.1 AS DOUBLE) * n))"""
CURVE = """round(avg(abs(pred - y)), 4) AS maes, round(sqrt(avg((pred - y) * (pred - y))), 4) AS rmse,
  round(1 - avg((pred - y) * (pred - y)) / var_pop(y), 4) AS r2"""


def grow_error_sql(rounds: int, batch: int, direction: str, seeds: int, result: str, subsample: float = 1.0) -> str:
    ctes = [POOL, f"""sr AS MATERIALIZED (SELECT id, y, row_number() OVER (ORDER BY y, id) - 1 AS pos, count(*) OVER () AS n FROM pool),
sq AS (SELECT ((SELECT max(n) FROM sr) - 1) * i // {seeds - 1} AS pos FROM range({seeds}) g(i)),
mem0 AS MATERIALIZED (SELECT DISTINCT l.id, CAST(0 AS INTEGER) AS iter_added, CAST(NULL AS DOUBLE) AS err
  FROM sq JOIN sr USING (pos) JOIN (SELECT y, max(id) AS id FROM pool GROUP BY 1) l ON l.y = sr.y)"""]
    curve = []
    for r in range(rounds):
        ctes.append(f"tr{r} AS MATERIALIZED (SELECT * FROM pool WHERE id IN (SELECT id FROM mem{r}))")
        ctes.append(f"rest{r} AS MATERIALIZED (SELECT * FROM pool WHERE id NOT IN (SELECT id FROM mem{r}))")
        ctes.append(fit(f"m{r}", f"tr{r}", *OLS))
        curve.append(f"""SELECT CAST({r} AS INTEGER) AS iter, 'm1' AS model, CAST((SELECT count(*) FROM tr{r}) AS BIGINT) AS train_size,
  round((SELECT count(*) FROM tr{r}) / (SELECT CAST(count(*) AS DOUBLE) FROM pool), 3) AS train_ratio, {CURVE} FROM ({predict(f'm{r}', 'test', *OLS)})""")
        ctes.append(drawn(f"sub{r}", f"rest{r}", r))
        ctes.append(f"e{r} AS MATERIALIZED (SELECT id, round(abs(pred - y), 6) AS err FROM ({predict(f'm{r}', f'sub{r}', *OLS)}) WHERE rk <= round_even(CAST({subsample} AS DOUBLE) * n, 0))")
        ctes.append(f"""mem{r+1} AS MATERIALIZED (SELECT * FROM mem{r} UNION ALL
  (SELECT id, CAST({r+1} AS INTEGER) AS iter_added, err FROM e{r} ORDER BY err {direction}, id LIMIT {batch}))""")
    ctes.append(f"curve AS MATERIALIZED ({' UNION ALL '.join(curve)})")
    return ",\n".join(ctes) + "\n" + result.format(last=rounds)


@query(grow_error_sql(3, 300, "DESC", 300, "SELECT id, iter_added, err FROM mem{last}"))
def grow_max_err(spark, folder):
    pool, test = split_pool(spark, folder)
    return G.grow_by_error(Ols1("n_lines"), pool, test, batch_sizes=[300] * 3).membership


@query(grow_error_sql(3, 300, "ASC", 300, "SELECT id, iter_added, err FROM mem{last}", 0.5))
def grow_min_err(spark, folder):
    pool, test = split_pool(spark, folder)
    return G.grow_by_error(Ols1("n_lines"), pool, test, batch_sizes=[300] * 3, criterion="min_err", subsample=0.5).membership


@query(grow_error_sql(3, 300, "DESC", 300, "SELECT * FROM curve"))
def grow_max_err_curve(spark, folder):
    pool, test = split_pool(spark, folder)
    return G.grow_by_error(Ols1("n_lines"), pool, test, batch_sizes=[300] * 3).curve


@query(f"""{POOL}, {drawn('r', 'pool', 0)}, st AS (SELECT greatest(1, CAST(floor(CAST(0.01 AS DOUBLE) * (SELECT count(*) FROM pool)) AS BIGINT)) AS s),
z AS MATERIALIZED (SELECT CAST(i - 1 AS INTEGER) AS iter, least(i * s, (SELECT count(*) FROM pool)) AS train_size FROM st, range(1, 120) g(i)
  WHERE (i - 1) * s < (SELECT count(*) FROM pool) AND i * s < (SELECT count(*) FROM pool)),
ma AS (SELECT iter, train_size, round(regr_slope(y, n_lines), 6) AS b, round(regr_intercept(y, n_lines), 6) AS a FROM z JOIN r ON rk <= train_size GROUP BY ALL),
mb AS (SELECT iter, train_size, round(regr_slope(y, qty), 6) AS b, round(regr_intercept(y, qty), 6) AS a FROM z JOIN r ON rk <= train_size GROUP BY ALL),
p AS (SELECT 'one' AS model, iter, train_size, y, a + b * n_lines AS pred FROM ma, test
  UNION ALL SELECT 'two' AS model, iter, train_size, y, a + b * qty AS pred FROM mb, test)
SELECT iter, model, round(train_size / (SELECT CAST(count(*) AS DOUBLE) FROM pool), 3) AS train_ratio, {CURVE}, train_size FROM p GROUP BY iter, model, train_size""")
def grow_random(spark, folder):
    pool, test = split_pool(spark, folder)
    return G.grow_random({"one": Ols1("n_lines"), "two": Ols1("qty")}, pool, test).curve


def committee_sql(rounds: int, frac: float, result: str) -> str:
    two = ("ols", "qty")
    ctes = [POOL, drawn("r", "pool", 0), f"k AS MATERIALIZED (SELECT CAST(floor(CAST({frac} AS DOUBLE) * (SELECT count(*) FROM pool)) AS BIGINT) AS s)",
            "mem0 AS MATERIALIZED (SELECT id, CAST(0 AS INTEGER) AS iter_added, CAST(NULL AS DOUBLE) AS err FROM r WHERE rk <= (SELECT s FROM k))"]
    curve = []
    for i in range(rounds):
        ctes.append(f"tr{i} AS MATERIALIZED (SELECT * FROM pool WHERE id IN (SELECT id FROM mem{i}))")
        ctes.append(f"rest{i} AS MATERIALIZED (SELECT * FROM pool WHERE id NOT IN (SELECT id FROM mem{i}))")
        for name, m in (("a", OLS), ("b", two)):
            ctes.append(fit(f"{name}{i}", f"tr{i}", *m))
            curve.append(f"""SELECT CAST({i} AS INTEGER) AS iter, '{'one' if name == 'a' else 'two'}' AS model,
  round((SELECT count(*) FROM tr{i}) / (SELECT CAST(count(*) AS DOUBLE) FROM pool), 3) AS train_ratio, {CURVE},
  CAST((SELECT count(*) FROM tr{i}) AS BIGINT) AS train_size FROM ({predict(f'{name}{i}', 'test', *m)})""")
        ctes.append(f"pa{i} AS ({predict(f'a{i}', f'rest{i}', *OLS)})")
        ctes.append(f"pb{i} AS ({predict(f'b{i}', f'pa{i}', *two, pred='pred2')})")
        ctes.append(f"""mem{i+1} AS MATERIALIZED (SELECT * FROM mem{i} UNION ALL (SELECT id, CAST({i+1} AS INTEGER) AS iter_added,
  round(abs(pred - pred2), 6) AS err FROM pb{i} ORDER BY 3 DESC, id LIMIT (SELECT s FROM k)))""")
    ctes.append(f"curve AS MATERIALIZED ({' UNION ALL '.join(curve)})")
    return ",\n".join(ctes) + "\n" + result


COMMITTEE = {"one": Ols1("n_lines"), "two": Ols1("qty")}


@query(committee_sql(2, 0.05, "SELECT * FROM curve"))
def grow_committee(spark, folder):
    pool, test = split_pool(spark, folder)
    return G.grow_committee(COMMITTEE, pool, test, step_frac=0.05, max_rounds=2).curve


@query(committee_sql(3, 0.02, "SELECT id, iter_added, err FROM mem2"))
def committee_members(spark, folder):
    pool, test = split_pool(spark, folder)
    return G.grow_committee(COMMITTEE, pool, test, step_frac=0.02, max_rounds=3).membership


@query(committee_sql(3, 0.02, "SELECT id, iter_added, err FROM mem2"))
def grow_resumed(spark, folder):
    """Two rounds, then the same run taken up again to three."""
    run = new_run_dir(spark)
    pool, test = split_pool(spark, folder)
    for until in (2, 3):
        result = G.grow_committee(COMMITTEE, pool, test, step_frac=0.02, max_rounds=until, run_dir=run)
    return result.membership
