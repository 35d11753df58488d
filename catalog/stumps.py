"""Tree models small enough to write out in SQL: one split on a column of few values, and what is built on it."""

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from catalog.cleaning import rounded_scores
from catalog.columns import PAIR_ROWS, order_pairs
from catalog.registry import query
from catalog.scoring import SPLIT, split_orders, split_pool
from catalog.sqltext import SCORES, drawn
from catalog.tables import F1, order_features
from winnow.operators import influence as I
from winnow.operators import models as M
from winnow.operators.project import project_2d
from winnow.operators.rank import ensemble_interval
from winnow.plans import grow as G

STUMP = {"depth": 1}


def forest_stump():
    return M.rf(["n_lines"], trees=1, bootstrap=False, **STUMP)


def boosted_stump(rounds=1):
    return M.xgb_1tree(["n_lines"], rounds=rounds, **STUMP)


def stump(name: str, src: str, target: str = "y", x: str = "n_lines") -> str:
    """CTE ``name(t, lo, hi)``: the best split of ``src`` on ``x`` and the mean on either side (of all rows, if none)."""
    return f"""{name}_v AS MATERIALIZED (SELECT {x} AS x, count(*) AS n, sum({target}) AS s FROM {src} GROUP BY 1),
{name}_c AS (SELECT a.x AS t, sum(b.n) FILTER (WHERE b.x <= a.x) AS nl, sum(b.s) FILTER (WHERE b.x <= a.x) AS sl,
  sum(b.n) FILTER (WHERE b.x > a.x) AS nr, sum(b.s) FILTER (WHERE b.x > a.x) AS sr FROM {name}_v a, {name}_v b GROUP BY 1),
{name} AS MATERIALIZED (SELECT t, sl / nl AS lo, sr / nr AS hi FROM {name}_c WHERE nr > 0 ORDER BY sl * sl / nl + sr * sr / nr DESC LIMIT 1)"""


def value(name: str, x: str = "n_lines") -> str:
    return f"CASE WHEN {x} <= (SELECT t FROM {name}) THEN (SELECT lo FROM {name}) ELSE (SELECT hi FROM {name}) END"


@query(f"""{SPLIT}, {stump('m', 'tr')} SELECT split, count(*) AS n, {SCORES} FROM (SELECT *, {value('m')} AS pred FROM te) GROUP BY split""")
def scores_stump(spark, folder):
    return rounded_scores(M.fit_scores(forest_stump(), split_orders(spark, folder)))


@query(f"""{SPLIT}, {stump('m', 'tr')}, r AS MATERIALIZED (SELECT *, 2 * (y - {value('m')}) AS g FROM tr), {stump('k', 'r', 'g')}
SELECT split, count(*) AS n, {SCORES} FROM (SELECT *, {value('m')} + 0.25 * {value('k')} AS pred FROM te) GROUP BY split""")
def scores_two_rounds(spark, folder):
    """Two rounds of boosting: the second stump is fitted to the gradient left by the first."""
    return rounded_scores(M.fit_scores(boosted_stump(2), split_orders(spark, folder)))


GAPPED = SPLIT.replace("tr AS", "sg AS MATERIALIZED (SELECT * REPLACE (CASE WHEN avg_p_size >= 20 THEN n_lines ELSE -1e300 END AS n_lines) FROM s),\ntr AS").replace(
    "FROM s WHERE split = 'train'", "FROM sg WHERE split = 'train'").replace("FROM s WHERE split = 'test'", "FROM sg WHERE split = 'test'")


def penalised(name: str, src: str, x: str = "n_lines") -> str:
    """CTE ``name(t, lo, hi)``: the best split by gradients g and hessians h under the named models' penalties, and both weights."""
    shrunk = "sign({0}) * greatest(abs({0}) - 0.1, 0)".format
    return f"""{name}_v AS MATERIALIZED (SELECT {x} AS x, sum(g) AS g, sum(h) AS h FROM {src} GROUP BY 1),
{name}_c AS (SELECT a.x AS t, sum(b.g) FILTER (WHERE b.x <= a.x) AS gl, sum(b.h) FILTER (WHERE b.x <= a.x) AS hl,
  sum(b.g) FILTER (WHERE b.x > a.x) AS gr, sum(b.h) FILTER (WHERE b.x > a.x) AS hr FROM {name}_v a, {name}_v b GROUP BY 1),
{name} AS MATERIALIZED (SELECT t, 0.25 * -({shrunk('gl')}) / (hl + 0.01) AS lo, 0.25 * -({shrunk('gr')}) / (hr + 0.01) AS hi FROM {name}_c
  WHERE hl >= 1 AND hr >= 1 ORDER BY ({shrunk('gl')}) ** 2 / (hl + 0.01) + ({shrunk('gr')}) ** 2 / (hr + 0.01) DESC, t LIMIT 1)"""


#: the named models without draws, so that SQL can repeat them
UNDRAWN = {"rows": 1.0, "columns": (1.0, 1.0), "depth": 1, "rounds": 2}


@query(f"""{SPLIT}, a AS MATERIALIZED (SELECT *, 0.5 - y AS g, 1 AS h FROM tr), {penalised('m', 'a')},
b AS MATERIALIZED (SELECT *, 0.5 + {value('m')} - y AS g, 1 AS h FROM tr), {penalised('k', 'b')}
SELECT split, count(*) AS n, {SCORES} FROM (SELECT *, 0.5 + {value('m')} + {value('k')} AS pred FROM te) GROUP BY split""")
def scores_penalised_stump(spark, folder):
    """The named boosted regressor: two rounds of four parallel trees with both penalties."""
    return rounded_scores(M.fit_scores(M.model_by_name("xgb", ["n_lines"], start=0.5, **UNDRAWN), split_orders(spark, folder)))


RARE = "CASE WHEN qty > 130 AND avg_p_size > 20 THEN 1 ELSE 0 END"


@query(f"""{SPLIT}, c AS MATERIALIZED (SELECT * REPLACE ({RARE} AS y) FROM tr), a AS MATERIALIZED (SELECT *, 0.5 - y AS g, 0.25 AS h FROM c), {penalised('m', 'a')},
p AS MATERIALIZED (SELECT *, 1 / (1 + exp(-({value('m')}))) AS p FROM c), b AS MATERIALIZED (SELECT *, p - y AS g, p * (1 - p) AS h FROM p), {penalised('k', 'b')}
SELECT id, CASE WHEN {value('m')} + {value('k')} > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS prediction FROM te""")
def classes_penalised_stump(spark, folder):
    """The named boosted classifier."""
    rows = split_orders(spark, folder).withColumn("y", F.expr(RARE))
    fitted = M.model_by_name("xgb_cla", ["n_lines"], **UNDRAWN).fit(rows.filter("split = 'train'"))
    return fitted.transform(rows.filter("split = 'test'")).select("id", "prediction")


LEAF_MEANS = f"""WITH {F1}, {stump('m', 'f1')}, lf AS MATERIALIZED (SELECT id, y, n_lines <= (SELECT t FROM m) AS l0, CAST(floor(qty / 50) AS INTEGER) AS l1 FROM f1),
z AS (SELECT count(*) AS n, avg(y) AS my FROM f1), s0 AS (SELECT l0, count(*) AS n, sum(y) AS s FROM lf GROUP BY 1), s1 AS (SELECT l1, count(*) AS n, sum(y) AS s FROM lf GROUP BY 1),
v AS MATERIALIZED (SELECT id, y, lf.l0, lf.l1, s0.n AS n0, s0.s / s0.n AS m0, s1.n AS n1, s1.s / s1.n AS m1, z.n,
  CASE WHEN s0.n > 1 THEN (s0.s / s0.n - y) / (s0.n - 1) ELSE (z.n * my - y) / (z.n - 1) - y END AS d0,
  CASE WHEN s1.n > 1 THEN (s1.s / s1.n - y) / (s1.n - 1) ELSE (z.n * my - y) / (z.n - 1) - y END AS d1
  FROM lf JOIN s0 ON s0.l0 = lf.l0 JOIN s1 ON s1.l1 = lf.l1, z)"""


def leaf_rows(spark, folder):
    """Orders with their leaf in a fitted stump and in a given tree over the quantity."""
    rows = order_features(spark, folder)
    leaves = forest_stump().fit(rows).leaves(rows)
    return leaves.select("id", "y", F.concat("leaves", F.array(F.floor(F.col("qty") / 50).cast("int"))).alias("leaves")).persist()


@query(LEAF_MEANS + """SELECT id, round(abs(d0 + d1) / 2, 3) AS self_abs, round(abs((d0 + d1) / (m0 + m1)), 6) AS self_pct,
  round((d0 * n0 + d1 * n1) / 2 / n, 3) AS mean_change FROM v""")
def influence_of_leaves(spark, folder):
    out = I.leaf_deletion_influence(leaf_rows(spark, folder))
    return out.select("id", F.round("self_abs", 3).alias("self_abs"), F.round("self_pct", 6).alias("self_pct"), F.round("mean_change", 3).alias("mean_change"))


@query(LEAF_MEANS + f""", {PAIR_ROWS}, w AS (SELECT removed_id, pr.id, (CASE WHEN i.l0 = j.l0 THEN i.d0 ELSE 0 END + CASE WHEN i.l1 = j.l1 THEN i.d1 ELSE 0 END) / 2 AS d,
  (j.m0 + j.m1) / 2 AS ref FROM pr JOIN v i ON i.id = removed_id JOIN v j ON j.id = pr.id)
SELECT removed_id, id, round(abs(d), 3) AS abs_influ, round(abs(d / ref), 6) AS pct_influ FROM w""")
def influence_of_leaves_pairs(spark, folder):
    rows = leaf_rows(spark, folder)
    out = I.leaf_influence_of_pairs(rows, order_pairs(rows))
    return out.withColumns({"abs_influ": F.round("abs_influ", 3), "pct_influ": F.round("pct_influ", 6)})


@query(f"""{GAPPED}, {stump('m', 'tr')} SELECT split, count(*) AS n, {SCORES} FROM (SELECT *, {value('m')} AS pred FROM te) GROUP BY split""")
def scores_boosted_with_gaps(spark, folder):
    """A missing feature stands below all values."""
    rows = split_orders(spark, folder).withColumn("n_lines", F.when(F.col("avg_p_size") >= 20, F.col("n_lines")))
    return rounded_scores(M.fit_scores(boosted_stump(), rows))


@query(f"""WITH {F1}, z AS MATERIALIZED (SELECT * REPLACE (CASE WHEN n_lines <= 2 AND qty < 40 THEN 0.0 ELSE y END AS y) FROM f1),
w AS MATERIALIZED (SELECT *, CASE WHEN y <> 0 THEN 1.0 ELSE -1.0 END AS c FROM z), {stump('k', 'w', 'c')},
p AS MATERIALIZED (SELECT * FROM z WHERE y > 0), {stump('m', 'p')}
SELECT id, round(CASE WHEN {value('k')} > 0 THEN {value('m')} ELSE 0 END, 4) AS prediction FROM z""")
def two_stage_stumps(spark, folder):
    zeroed = F.when((F.col("n_lines") <= 2) & (F.col("qty") < 40), 0.0).otherwise(F.col("y"))
    rows = order_features(spark, folder).withColumn("y", zeroed)
    classifier = M.MlModel(GBTClassifier(maxIter=1, maxDepth=1), ("n_lines",), "nonzero")
    fitted = M.TwoStage(classifier, boosted_stump()).fit(rows)
    return fitted.transform(rows).select("id", F.round("prediction", 4).alias("prediction"))


@query(f"""{SPLIT}, {stump('m', 'tr')} SELECT id, round({value('m')}, 4) AS lower, round({value('m')}, 4) AS upper, CAST(0 AS DOUBLE) AS uncertainty FROM te""")
def interval_of_one_tree(spark, folder):
    rows = split_orders(spark, folder)
    fitted = forest_stump().fit(rows.filter("split = 'train'"))
    out = ensemble_interval(fitted.per_tree(rows.filter("split = 'test'")))
    return out.select("id", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"), "uncertainty")


@query(f"""{SPLIT}, {stump('m', 'tr')}, p AS MATERIALIZED (SELECT id, {value('m')} AS pred FROM te) SELECT CAST(count(*) AS BIGINT) AS rows,
  CAST(0 AS BIGINT) AS unlike_mean, CAST(0 AS BIGINT) AS upside_down FROM p""")
def forest_is_the_mean_of_its_trees(spark, folder):
    """A forest of ten trees predicts the mean of its trees, and its bounds are in order, for every row."""
    rows = split_orders(spark, folder)
    fitted = M.rf(["n_lines", "qty", "avg_tax"], trees=10, depth=5).fit(rows.filter("split = 'train'"))
    out = ensemble_interval(fitted.per_tree(fitted.transform(rows.filter("split = 'test'"))))
    mean = F.aggregate("preds", F.lit(0.0), lambda a, b: a + b) / F.size("preds")
    return out.agg(
        F.count("*").alias("rows"), F.count_if(F.abs(F.col("prediction") - mean) > 1e-6 * F.abs(mean)).alias("unlike_mean"),
        F.count_if(F.col("lower") > F.col("upper")).alias("upside_down"),
    )


POOL = f"""WITH {F1}, {drawn('d', 'f1', 0)},
pool AS MATERIALIZED (SELECT * EXCLUDE (rk, n) FROM d WHERE rk > ceil(CAST(0.1 AS DOUBLE) * n)), {drawn('r', 'pool', 0)},
k AS MATERIALIZED (SELECT CAST(floor(CAST(0.05 AS DOUBLE) * (SELECT count(*) FROM pool)) AS BIGINT) AS s),
mem0 AS MATERIALIZED (SELECT id, CAST(0 AS INTEGER) AS iter_added, CAST(NULL AS DOUBLE) AS err FROM r WHERE rk <= (SELECT s FROM k))"""


def grown_sql(err: str, fitted: bool, rounds: int = 3) -> str:
    ctes = [POOL]
    for i in range(rounds - 1):
        ctes.append(f"tr{i} AS MATERIALIZED (SELECT * FROM pool WHERE id IN (SELECT id FROM mem{i}))")
        ctes.append(f"rest{i} AS MATERIALIZED (SELECT * FROM pool WHERE id NOT IN (SELECT id FROM mem{i}))")
        if fitted:
            ctes.append(stump(f"m{i}", f"tr{i}"))
            ctes.append(f"va{i} AS MATERIALIZED (SELECT n_lines <= (SELECT t FROM m{i}) AS low, var_pop(y) AS v FROM tr{i} GROUP BY 1)")
        ctes.append(f"""mem{i+1} AS MATERIALIZED (SELECT * FROM mem{i} UNION ALL (SELECT id, CAST({i+1} AS INTEGER) AS iter_added,
  {err.format(i=i)} AS err FROM rest{i} ORDER BY 3 DESC, id LIMIT (SELECT s FROM k)))""")
    return ",\n".join(ctes) + f"\nSELECT id, iter_added, round(err / 1000000, 0) AS err FROM mem{rounds-1}"


def grown(result):
    return result.membership.select("id", "iter_added", F.round(F.col("err") / 1_000_000, 0).alias("err"))


class FittedPair:
    """Two fitted stumps as a forest: its trees and their mean."""

    def __init__(self, trees):
        self.trees = trees

    def per_tree(self, df):
        first, second = self.trees
        both = second.transform(first.transform(df).withColumnRenamed("prediction", "_a"))
        return both.select(*df.columns, F.array("_a", "prediction").alias("preds"))

    def transform(self, df):
        mean = (F.get("preds", F.lit(0)) + F.get("preds", F.lit(1))) / 2
        return self.per_tree(df).withColumn("prediction", mean).drop("preds")


class StumpPair:
    """Trees of one split each, on the number of lines and on the quantity in fifties."""

    def fit(self, df):
        return FittedPair([M.rf([c], trees=1, bootstrap=False, **STUMP).fit(df) for c in ("n_lines", "fifties")])


FIFTIES = "floor(qty / 50)"


def with_fifties(df):
    return df.withColumn("fifties", F.floor(F.col("qty") / 50).cast("double"))


SPREAD = f"round(0.9 * abs(({value('{a}')}) - ({value('{b}', FIFTIES)})), 6)"


@query(f"""{SPLIT}, {stump('m', 'tr')}, {stump('k', 'tr', x=FIFTIES)}, p AS (SELECT id, {value('m')} AS a, {value('k', FIFTIES)} AS b FROM te)
SELECT id, round(least(a, b) + 0.05 * abs(a - b), 4) AS lower, round(greatest(a, b) - 0.05 * abs(a - b), 4) AS upper, round(0.9 * abs(a - b), 4) AS uncertainty FROM p""")
def interval_of_two_trees(spark, folder):
    rows = with_fifties(split_orders(spark, folder))
    out = ensemble_interval(StumpPair().fit(rows.filter("split = 'train'")).per_tree(rows.filter("split = 'test'")))
    return out.select("id", *[F.round(c, 4).alias(c) for c in ("lower", "upper", "uncertainty")])


def grown_by_spread_sql(rounds: int = 3) -> str:
    ctes = [POOL]
    for i in range(rounds - 1):
        ctes.append(f"tr{i} AS MATERIALIZED (SELECT * FROM pool WHERE id IN (SELECT id FROM mem{i}))")
        ctes.append(f"rest{i} AS MATERIALIZED (SELECT * FROM pool WHERE id NOT IN (SELECT id FROM mem{i}))")
        ctes += [stump(f"m{i}", f"tr{i}"), stump(f"k{i}", f"tr{i}", x=FIFTIES)]
        spread = SPREAD.format(a=f"m{i}", b=f"k{i}")
        ctes.append(f"""mem{i+1} AS MATERIALIZED (SELECT * FROM mem{i} UNION ALL (SELECT id, CAST({i+1} AS INTEGER) AS iter_added,
  {spread} AS err FROM rest{i} ORDER BY 3 DESC, id LIMIT (SELECT s FROM k)))""")
    return ",\n".join(ctes) + f"\nSELECT id, iter_added, round(err, 3) AS err FROM mem{rounds-1}"


@query(grown_by_spread_sql())
def grow_rf_uncertainty_two_trees(spark, folder):
    """The rows go first on which two trees of different columns differ most."""
    pool, test = split_pool(spark, folder)
    result = G.grow_rf_uncertainty({"rf": StumpPair()}, with_fifties(pool), with_fifties(test), step_frac=0.05, max_rounds=3)
    return result.membership.select("id", "iter_added", F.round("err", 3).alias("err"))


@query(grown_sql("CAST(0 AS DOUBLE)", False))
def grow_rf_uncertainty_one_tree(spark, folder):
    """One tree has no spread: the rows of smallest id are taken."""
    pool, test = split_pool(spark, folder)
    return grown(G.grow_rf_uncertainty({"rf": forest_stump()}, pool, test, step_frac=0.05, max_rounds=3))


@query(grown_sql("round((SELECT v FROM va{i} WHERE low = (n_lines <= (SELECT t FROM m{i}))), 6)", True))
def grow_leaf_affinity_stump(spark, folder):
    """Two leaves: the rows of the one whose targets vary more are taken first."""
    pool, test = split_pool(spark, folder)
    return grown(G.grow_leaf_affinity({"one": M.Ols1("n_lines")}, pool, test, boosted_stump(), step_frac=0.05, max_rounds=3))


@query(f"""WITH {F1}, c AS (SELECT covar_samp(qty, qty) AS a, covar_samp(qty, avg_p_size) AS b, covar_samp(avg_p_size, avg_p_size) AS d FROM f1),
t AS (SELECT 0.5 * atan2(2 * b, a - d) AS th FROM c), v AS (SELECT cos(th) AS u, sin(th) AS w FROM t),
s AS (SELECT CASE WHEN abs(u) >= abs(w) THEN sign(u) ELSE sign(w) END AS s0, CASE WHEN abs(w) >= abs(u) THEN sign(-w) ELSE sign(u) END AS s1, u, w FROM v)
SELECT id, round(s0 * (qty * u + avg_p_size * w), 4) AS "0", round(s1 * (avg_p_size * u - qty * w), 4) AS "1" FROM f1, s""")
def project_two_columns(spark, folder):
    z, _ = project_2d(order_features(spark, folder), ["qty", "avg_p_size"])
    return z.select("id", F.round("0", 4).alias("0"), F.round("1", 4).alias("1"))
