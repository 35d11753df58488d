"""What runs write and read: score files, curves, histories, run folders, structure texts, grids, periodic cells."""

from pyspark.sql import functions as F

from catalog.cleaning import rounded_scores
from catalog.loops import COMMITTEE, HALF, committee_sql, pruned_three
from catalog.registry import ORACLES, query
from catalog.scoring import SPLIT, baseline_sql, split_orders, split_pool
from catalog.sqltext import SCORES, prune_sql
from catalog.tables import F1, points, table
from winnow.functions.columns import cell_volume
from winnow.functions.structure import parse_poscar, parse_structure
from winnow.operators import graph as G
from winnow.operators.models import Ols1, fit_scores, model_by_name
from winnow.plans import grow
from winnow.plans.runs import random_baseline, run_criterion, run_grid
from winnow.sources import features as R
from winnow.sources.state import new_run_dir, write_history

METRICS = ["maes", "rmse", "r2", "maes_val", "rmse_val", "r2_val"]


@query(baseline_sql(2, "SELECT seed, train_size, " + ", ".join(f"round({c}, 3) AS {c}" for c in METRICS) + " FROM sc"))
def score_files(spark, folder):
    """Each seed's scores are written when the seed is done, and read back from the files."""
    run = new_run_dir(spark)
    pool, test = split_pool(spark, folder)
    random_baseline({"ols": Ols1("n_lines")}, pool, test, seeds=[0, 1], save_to=run)
    found = R.read_score_files(spark, run, "ols")
    return found.select("seed", "train_size", *[F.round(c, 3).alias(c) for c in METRICS])


@query(committee_sql(2, 0.05, "SELECT *, 'a' AS run_id FROM curve"))
def curve_files(spark, folder):
    run = new_run_dir(spark)
    pool, test = split_pool(spark, folder)
    grow.grow_committee(COMMITTEE, pool, test, step_frac=0.05, max_rounds=2, curve_path=run, run_id="a")
    return spark.read.parquet(run)


@query(prune_sql(F1, "f1", 3, 0.8, HALF, "SELECT * FROM scores"))
def score_history(spark, folder):
    path = new_run_dir(spark)
    write_history(pruned_three(spark, folder).scores, path)
    found = spark.read.schema("iter int, split string, model string, n long, mae double, rmse double, r2 double").json(path)
    return rounded_scores(found)


GRID = [{"criterion": "random", "step_frac": 0.01}, {"criterion": "committee", "step_frac": 0.05, "max_rounds": 2}]


@query(f"SELECT 'random' AS criterion, * FROM ({ORACLES['grow_random']}) UNION ALL SELECT 'committee' AS criterion, * FROM ({ORACLES['grow_committee']})")
def grid_of_runs(spark, folder):
    pool, test = split_pool(spark, folder)
    results = run_grid(GRID, lambda criterion, **settings: run_criterion(criterion, COMMITTEE, pool, test, **settings))
    curves = [r.curve.select(F.lit(g["criterion"]).alias("criterion"), "*") for g, r in zip(GRID, results)]
    return curves[0].unionByName(curves[1])


@query(f"""{SPLIT}, m AS (SELECT regr_slope(y, n_lines) AS b, regr_intercept(y, n_lines) AS a FROM tr)
SELECT split, count(*) AS n, {SCORES.replace(', 4)', ', 2)')} FROM (SELECT te.*, a + b * n_lines AS pred FROM te, m) GROUP BY split""")
def registry_linear(spark, folder):
    out = fit_scores(model_by_name("linear", ["n_lines"]), split_orders(spark, folder))
    return out.withColumns({"mae": F.round("mae", 2), "rmse": F.round("rmse", 2), "r2": F.round("r2", 6)})


# the first embedding dimensions as a cell (a, b, c on the diagonal, one shear) with one site
CELLS = """WITH e AS (SELECT vec_id AS id, round(1 + abs(CAST(embedding[1] AS DOUBLE)), 4) AS a, round(1 + abs(CAST(embedding[2] AS DOUBLE)), 4) AS b,
  round(1 + abs(CAST(embedding[3] AS DOUBLE)), 4) AS c, round(CAST(embedding[4] AS DOUBLE), 4) AS x, round(CAST(embedding[5] AS DOUBLE), 4) AS y,
  round(CAST(embedding[6] AS DOUBLE), 4) AS z FROM embeddings)"""


def cells(spark, folder):
    e = F.col("embedding")
    side = [F.round(1 + F.abs(e[i].cast("double")), 4).alias(n) for i, n in enumerate("abc")]
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), *side, *[F.round(e[i + 3].cast("double"), 4).alias(n) for i, n in enumerate("xyz")])


def site(parsed):
    return parsed.select(
        "id", F.round(cell_volume(F.col("s.lattice")), 6).alias("volume"), F.array_join("s.elements", "-").alias("elements"),
        *[F.round(F.col("s.coords")[0][i], 6).alias(n) for i, n in enumerate("xyz")],
    )


@query(CELLS + " SELECT id, round(a * b * c, 6) AS volume, 'Fe' AS elements, x, y, z FROM e")
def structure_literals(spark, folder):
    text = F.format_string("{'lattice_mat': ((%.4f, 0, 0), (0.5, %.4f, 0), (0, 0, %.4f)), 'coords': [[%.4f, %.4f, %.4f]], 'elements': ['Fe'], 'cartesian': 0}", *"abcxyz")
    return site(cells(spark, folder).select("id", parse_structure(text).alias("s")))


@query(CELLS + """ SELECT id, round(CASE WHEN id % 4 = 1 THEN 8 * a * b * c WHEN id % 4 = 2 THEN 20 ELSE a * b * c END, 6) AS volume, 'Al-Al-Fe' AS elements,
  round(CASE WHEN id % 4 = 3 THEN (x - 0.5 * y / b) / a ELSE x END, 6) AS x, round(CASE WHEN id % 4 = 3 THEN y / b ELSE y END, 6) AS y,
  round(CASE WHEN id % 4 = 3 THEN z / c ELSE z END, 6) AS z FROM e WHERE id % 5 > 0
UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL FROM e WHERE id % 5 = 0""")
def poscar_texts(spark, folder):
    """Plain, scaled, by volume, Cartesian after selective dynamics; every fifth text is cut short."""
    kind = F.col("id") % 4
    scale = F.when(kind == 1, "2.0").when(kind == 2, "-20.0").otherwise("1.0")
    mode = F.when(kind == 3, "Selective dynamics\nCartesian").otherwise("Direct")
    text = F.concat(
        F.lit("cell\n"), scale, F.format_string("\n%.4f 0 0\n0.5 %.4f 0\n0 0 %.4f\nAl Fe\n2 1\n", *"abc"), mode,
        F.when(F.col("id") % 5 > 0, F.format_string("\n%.4f %.4f %.4f\n0 0 0\n0.5 0.5 0.5\n", *"xyz")).otherwise("\n0 0 0\n"),
    )
    return site(cells(spark, folder).select("id", parse_poscar(text).alias("s")))


MIXED = "CASE WHEN m = 1 THEN [3, 0] WHEN m = 2 THEN [0, 2] WHEN m = 3 THEN [1, 1] WHEN m = 4 THEN [2, 1] ELSE [1, 3] END"


@query(f"""WITH g AS (SELECT CAST(p_partkey % 5 + 1 AS INTEGER) AS m, round(avg(p_size), 3) AS a, round(avg(p_retailprice), 2) AS e FROM part GROUP BY 1),
r AS (SELECT *, {MIXED} AS n FROM g), t AS (SELECT *, n[1] + n[2] AS k, -e / (n[1] + n[2]) AS pa FROM r),
ref AS (SELECT max(pa) FILTER (WHERE m = 1) AS al, max(pa) FILTER (WHERE m = 2) AS fe FROM t)
SELECT CAST(m AS VARCHAR) AS fid, CAST(CASE WHEN n[1] > 0 AND n[2] > 0 THEN 2 ELSE 1 END AS INTEGER) AS nelements, round(pa, 6) AS e_per_atom,
  round(a * a * a / k, 4) AS volume_per_atom, round(pa - (n[1] * al + n[2] * fe) / k, 6) AS ef FROM t, ref""")
def run_folder(spark, folder):
    """A manifest and one structure file for each fifth of ``part``, written and read as a run folder."""
    run = new_run_dir(spark)
    rows = table(spark, folder, "part").groupBy((F.col("p_partkey") % 5 + 1).cast("int").alias("m")).agg(
        F.round(F.avg("p_size"), 3).alias("a"), F.round(F.avg("p_retailprice"), 2).alias("e"))
    rows = rows.withColumn("n", F.expr(MIXED.replace("[", "array(").replace("]", ")")))
    rows = rows.withColumn("k", F.col("n")[0] + F.col("n")[1]).withColumn("fid", F.col("m").cast("string")).cache()
    manifest = rows.select("fid", (-F.col("e")).alias("energy"), F.col("k").alias("NIONS")).orderBy("fid")
    manifest.coalesce(1).write.option("header", True).csv(f"{run}/outfile")
    members = F.when(F.col("n")[1] == 0, F.concat(F.lit("Al\n"), F.col("n")[0])).when(F.col("n")[0] == 0, F.concat(F.lit("Fe\n"), F.col("n")[1])).otherwise(
        F.concat(F.lit("Al Fe\n"), F.col("n")[0], F.lit(" "), F.col("n")[1]))
    text = F.concat(F.lit("part\n1.0\n"), F.format_string("%.3f 0 0\n0 %.3f 0\n0 0 %.3f\n", "a", "a", "a"), members, F.lit("\nDirect\n"),
                    F.array_join(F.transform(F.sequence(F.lit(1), "k"), lambda i: F.concat((i * 1.25).cast("string"), F.lit(" 0 -0.25"))), "\n"))
    for (fid,) in rows.select("fid").collect():  # five files
        rows.filter(F.col("fid") == fid).select(text.alias("value")).coalesce(1).write.text(f"{run}/POSCAR.{fid}")
    rows.unpersist()
    out = R.read_run_folder(spark, run, reset_reference=True)
    return out.select("fid", "nelements", F.round("e_per_atom", 6).alias("e_per_atom"), F.round("volume_per_atom", 4).alias("volume_per_atom"), F.round("Ef_per_atom", 6).alias("ef"))


@query("""WITH f AS MATERIALIZED (SELECT label AS gid, vec_id AS site, round(CAST(embedding[1] AS DOUBLE), 6) AS a, round(CAST(embedding[2] AS DOUBLE), 6) AS b,
  round(CAST(embedding[3] AS DOUBLE), 6) AS c FROM embeddings),
o AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k FROM range(-3, 4) x(i), range(-3, 4) y(j), range(-3, 4) z(k)),
im AS MATERIALIZED (SELECT gid, site, i, j, k, a + i + 0.2 * (b + j) AS x, 0.9 * (b + j) + 0.1 * (c + k) AS y, 1.1 * (c + k) AS z FROM f, o),
pr AS (SELECT s.gid, s.site AS src, t.site AS dst, t.i, t.j, t.k, sqrt((t.x - s.x) ** 2 + (t.y - s.y) ** 2 + (t.z - s.z) ** 2) AS d
  FROM im s JOIN im t ON s.gid = t.gid AND s.i = 0 AND s.j = 0 AND s.k = 0 AND abs(t.x - s.x) <= 0.3 AND abs(t.y - s.y) <= 0.3 AND abs(t.z - s.z) <= 0.3
  WHERE NOT (s.site = t.site AND t.i = 0 AND t.j = 0 AND t.k = 0)),
rk AS (SELECT *, rank() OVER (PARTITION BY gid, src ORDER BY round(d, 10)) AS r FROM pr WHERE d <= 0.3)
SELECT gid, src, dst, i || ',' || j || ',' || k AS image, round(d, 6) AS d FROM rk WHERE r <= 4""")
def periodic_edges(spark, folder):
    """Neighbours across the faces of a sheared cell."""
    lattice = F.array(*[F.array(*map(F.lit, row)) for row in ([1.0, 0.0, 0.0], [0.2, 0.9, 0.0], [0.0, 0.1, 1.1])])
    sites = points(spark, folder).select("gid", "site", F.col("c").alias("frac"), lattice.alias("lattice"))
    images = G.periodic_images(sites, 0.3).select("gid", "site", "c", "image")
    home = images.filter("image = array(0, 0, 0)").select("gid", "site", "c")
    out = G.neighbour_edges(home, 0.3, 4, images)
    return out.select("gid", "src", "dst", F.array_join(F.col("image").cast("array<string>"), ",").alias("image"), F.round("d", 6).alias("d"))
