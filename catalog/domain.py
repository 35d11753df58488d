"""Compositions, hulls and neighbour graphs."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import (
    BAG_TYPE, ENERGY, F7, PROPS, bag_by_type, member_properties, order_energy, points, table,
)
from winnow.functions.columns import wrap_unit_cell
from winnow.operators import composition as C
from winnow.operators import graph as G
from winnow.operators.ternary import energy_above_hull_3

FR = "fr AS MATERIALIZED (SELECT id, member, amount / sum(amount) OVER (PARTITION BY id) AS f FROM bag)"


def stats_sql(p: str) -> str:
    return f"""round(min({p}), 3) AS {p}_min, round(max({p}), 3) AS {p}_max, round(max({p}) - min({p}), 3) AS {p}_range,
  round(sum(f * {p}), 3) AS {p}_mean, round(sum(f * abs({p} - m_{p})), 3) AS {p}_avg_dev, round(min({p}) FILTER (WHERE f = top), 3) AS {p}_mode"""


@query(f"""WITH {BAG_TYPE}, {FR}, {PROPS}, j AS (SELECT id, f, p1, p2, max(f) OVER w AS top, sum(f * p1) OVER w AS m_p1, sum(f * p2) OVER w AS m_p2
  FROM fr JOIN props USING (member) WINDOW w AS (PARTITION BY id))
SELECT id, CAST(count(*) AS DOUBLE) AS norm_0, {", ".join(f"round(pow(sum(pow(f, {p})), 1.0 / {p}), 6) AS norm_{p}" for p in C.NORMS if p)},
  {stats_sql('p1')}, {stats_sql('p2')} FROM j GROUP BY id""")
def composition_features(spark, folder):
    out = C.composition_features(bag_by_type(spark, folder), member_properties(spark, folder), ["p1", "p2"])
    return out.select("id", *[F.round(c, 6 if c.startswith("norm") else 3).alias(c) for c in out.columns if c != "id"])


@query("""SELECT doc_id AS id, w AS member, CAST(count(*) AS DOUBLE) AS amount
FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1, 2""")
def member_counts(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.split("text", " ").alias("words"))
    return C.member_counts(docs, "words")


SINGLE = """single AS (SELECT id, min(member) AS member FROM bag GROUP BY id HAVING count(DISTINCT member) = 1),
refs AS MATERIALIZED (SELECT member, arg_max(e, id) AS reference FROM single JOIN energy USING (id) GROUP BY 1)"""


@query(f"""WITH {BAG_TYPE}, {FR}, {ENERGY}, {SINGLE}
SELECT id, round((any_value(e) - sum(f * reference)) / any_value(e), 6) AS ef_share FROM fr JOIN refs USING (member) JOIN energy USING (id) GROUP BY id""")
def reference_subtracted(spark, folder):
    bag, values = bag_by_type(spark, folder).persist(), order_energy(spark, folder)
    out = C.reference_subtracted(values, bag, "e", reset=True)
    return out.select("id", F.round(F.col("ef") / F.col("e"), 6).alias("ef_share"))


MEMBERS = "mem AS (SELECT DISTINCT p_type AS m FROM part)"
COMBOS = "WITH RECURSIVE " + MEMBERS + """, co AS (SELECT m AS system, m AS last, CAST(1 AS INTEGER) AS k FROM mem
  UNION ALL SELECT system || '-' || m, m, k + 1 FROM co JOIN mem ON m > last WHERE k < 5)"""


@query(f"""{COMBOS}, {BAG_TYPE}, s AS (SELECT system, count(*) AS c FROM (
  SELECT id, string_agg(member, '-' ORDER BY member) AS system FROM bag GROUP BY id) GROUP BY 1)
SELECT co.system, k, coalesce(c, 0) AS n_orders FROM co LEFT JOIN s ON s.system = co.system""")
def chemsys(spark, folder):
    bag = bag_by_type(spark, folder)
    systems = C.enumerate_systems(table(spark, folder, "part").select(F.col("p_type").alias("member")))
    seen = C.system_of(bag).groupBy("system").agg(F.count(F.lit(1)).alias("n_orders"))
    return systems.join(seen, "system", "left").select("system", "k", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query(COMBOS.replace("p_type", "p_brand") + " SELECT k, count(*) AS n FROM co GROUP BY k")
def system_sizes(spark, folder):
    return C.system_sizes(C.enumerate_systems(table(spark, folder, "part").select(F.col("p_brand").alias("member"))))


@query("""WITH mem AS (SELECT DISTINCT 'm' || lpad(CAST(p_partkey % 200 AS VARCHAR), 3, '0') AS m FROM part)
SELECT m AS system, CAST(1 AS INTEGER) AS k FROM mem UNION ALL
SELECT a.m || '-' || b.m, CAST(2 AS INTEGER) FROM mem a JOIN mem b ON a.m < b.m""")
def many_member_pairs(spark, folder):
    members = table(spark, folder, "part").select(F.concat(F.lit("m"), F.lpad((F.col("p_partkey") % 200).cast("string"), 3, "0")).alias("member"))
    return C.enumerate_systems(members, kmax=2)


# two-member orders: x = share of the later member; single-member orders are the terminal points
SYS = f"""WITH {BAG_TYPE}, {FR}, {ENERGY},
so AS MATERIALIZED (SELECT id, min(member) AS a, max(member) AS b, count(*) AS k, arg_max(f, member) AS f FROM fr GROUP BY id HAVING count(*) <= 2),
pt AS MATERIALIZED (SELECT id, a || '-' || b AS system, f AS x, e FROM so JOIN energy USING (id) WHERE k = 2),
el AS MATERIALIZED (SELECT a AS member, min(e) AS e FROM so JOIN energy USING (id) WHERE k = 1 GROUP BY 1),
sy AS (SELECT DISTINCT system, string_split(system, '-')[1] AS a, string_split(system, '-')[2] AS b FROM pt),
al AS MATERIALIZED (SELECT system, x, min(e) AS e FROM (SELECT system, x, e FROM pt
  UNION ALL SELECT system, CAST(0 AS DOUBLE), e FROM sy JOIN el ON member = a
  UNION ALL SELECT system, CAST(1 AS DOUBLE), e FROM sy JOIN el ON member = b) GROUP BY 1, 2),
ta AS (SELECT DISTINCT system, x FROM pt),
hu AS MATERIALIZED (SELECT t.system, t.x, min(CASE WHEN p.x = q.x THEN p.e ELSE p.e + (q.e - p.e) * (t.x - p.x) / (q.x - p.x) END) AS e_hull
  FROM ta t JOIN al p ON p.system = t.system AND p.x <= t.x JOIN al q ON q.system = t.system AND q.x >= t.x GROUP BY 1, 2),
ab AS MATERIALIZED (SELECT id, pt.system, pt.x, e, e_hull, greatest(e - e_hull, 0) AS above FROM pt JOIN hu ON hu.system = pt.system AND hu.x = pt.x)"""


def two_member_points(spark, folder):
    shares = C.fractions(bag_by_type(spark, folder))
    per_id = shares.groupBy("id").agg(
        F.min("member").alias("a"), F.max("member").alias("b"), F.count(F.lit(1)).alias("k"), F.max_by("frac", "member").alias("f")
    ).join(order_energy(spark, folder), "id").persist()
    pts = per_id.filter("k = 2").select("id", F.concat_ws("-", "a", "b").alias("system"), F.col("f").alias("x"), "e")
    pure = per_id.filter("k = 1").groupBy(F.col("a").alias("member")).agg(F.min("e").alias("e"))
    systems = per_id.filter("k = 2").select(F.concat_ws("-", "a", "b").alias("system"), "a", "b").distinct()
    ends = [
        systems.select("system", F.col(c).alias("member")).join(pure, "member").select("system", F.lit(x).alias("x"), "e")
        for c, x in (("a", 0.0), ("b", 1.0))
    ]
    return pts, ends[0].unionByName(ends[1])


@query(f"{SYS} SELECT id, system, x, round(e_hull, 4) AS e_hull, round(above, 4) AS e_above_hull FROM ab")
def hull_binary(spark, folder):
    pts, ends = two_member_points(spark, folder)
    out = C.energy_above_hull(pts, ends)
    return out.select("id", "system", "x", F.round("e_hull", 4).alias("e_hull"), F.round("e_above_hull", 4).alias("e_above_hull"))


# three-member orders: shares of the second and third member, in tenths
SYS3 = f"""WITH {BAG_TYPE}, {FR}, {ENERGY},
so AS MATERIALIZED (SELECT id, list(member ORDER BY member) AS m, list(f ORDER BY member) AS f FROM fr GROUP BY id HAVING count(*) IN (1, 3)),
pt AS MATERIALIZED (SELECT id, array_to_string(m, '-') AS system, m, CAST(floor(f[2] * 10) AS BIGINT) AS x, CAST(floor(f[3] * 10) AS BIGINT) AS y, e FROM so JOIN energy USING (id) WHERE len(m) = 3),
el AS MATERIALIZED (SELECT m[1] AS member, min(e) AS e FROM so JOIN energy USING (id) WHERE len(m) = 1 GROUP BY 1),
sy AS (SELECT DISTINCT system, m FROM pt),
al AS MATERIALIZED (SELECT system, x, y, min(e) AS e, row_number() OVER (PARTITION BY system ORDER BY x, y) AS k FROM (SELECT system, x, y, e FROM pt
  UNION ALL SELECT system, 0, 0, e FROM sy JOIN el ON member = m[1] UNION ALL SELECT system, 10, 0, e FROM sy JOIN el ON member = m[2]
  UNION ALL SELECT system, 0, 10, e FROM sy JOIN el ON member = m[3]) GROUP BY 1, 2, 3),
tr AS MATERIALIZED (SELECT a.system, a.x AS xa, a.y AS ya, a.e AS ea, b.x AS xb, b.y AS yb, b.e AS eb, c.x AS xc, c.y AS yc, c.e AS ec,
  (b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y) AS d FROM al a JOIN al b ON b.system = a.system AND b.k > a.k JOIN al c ON c.system = a.system AND c.k > b.k),
ta AS (SELECT DISTINCT system, x, y FROM pt),
sh AS (SELECT t.system, t.x, t.y, sign(d) * ((xb - t.x) * (yc - t.y) - (xc - t.x) * (yb - t.y)) AS da, sign(d) * ((xc - t.x) * (ya - t.y) - (xa - t.x) * (yc - t.y)) AS db,
  sign(d) * ((xa - t.x) * (yb - t.y) - (xb - t.x) * (ya - t.y)) AS dc, abs(d) AS d, ea, eb, ec FROM ta t JOIN tr ON tr.system = t.system AND d <> 0),
hu AS MATERIALIZED (SELECT system, x, y, min((da * ea + db * eb + dc * ec) / d) AS e_hull FROM sh WHERE da >= 0 AND db >= 0 AND dc >= 0 GROUP BY 1, 2, 3)"""


def three_member_points(spark, folder):
    shares = C.fractions(bag_by_type(spark, folder))
    per_id = shares.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("member", "frac"))).alias("m")).join(order_energy(spark, folder), "id").persist()
    three = per_id.filter(F.size("m") == 3).withColumn("system", F.array_join("m.member", "-"))
    tenth = lambda i: F.floor(F.col("m")[i]["frac"] * 10) / 10
    pts = three.select("id", "system", tenth(1).alias("x"), tenth(2).alias("y"), "e")
    pure = per_id.filter(F.size("m") == 1).groupBy(F.col("m")[0]["member"].alias("member")).agg(F.min("e").alias("e"))
    systems = three.select("system", F.col("m.member").alias("names")).distinct()
    ends = systems.select("system", F.posexplode("names").alias("i", "member")).join(pure, "member")
    return pts, ends.select("system", (F.col("i") == 1).cast("double").alias("x"), (F.col("i") == 2).cast("double").alias("y"), "e")


@query(f"""{SYS3} SELECT id, pt.system, round(e_hull, 4) AS e_hull, round(greatest(e - e_hull, 0), 4) AS e_above_hull
FROM pt JOIN hu ON hu.system = pt.system AND hu.x = pt.x AND hu.y = pt.y""")
def hull_ternary(spark, folder):
    pts, ends = three_member_points(spark, folder)
    out = energy_above_hull_3(pts, ends)
    return out.select("id", "system", F.round("e_hull", 4).alias("e_hull"), F.round("e_above_hull", 4).alias("e_above_hull"))


@query(f"""{SYS}, s AS (SELECT id, sum(-f * ln(f)) AS s FROM fr GROUP BY id)
SELECT id, round(above / (8.617333262e-5 * s) / 1000, 1) AS transition_t FROM ab JOIN s USING (id)""")
def transition_score(spark, folder):
    pts, ends = two_member_points(spark, folder)
    out = C.transition_score(C.energy_above_hull(pts, ends), bag_by_type(spark, folder))
    return out.select("id", F.round(F.col("transition_t") / 1000, 1).alias("transition_t"))


@query("""SELECT vec_id AS id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM (
  SELECT vec_id, x - floor(x) AS x, y - floor(y) AS y, z - floor(z) AS z FROM (
    SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y, CAST(embedding[3] AS DOUBLE) * 10 AS z FROM embeddings))""")
def wrap_cell(spark, folder):
    e = F.col("embedding")
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.array(F.array(*[e[i].cast("double") * 10 for i in range(3)])).alias("coords")
    ).withColumn("coords", wrap_unit_cell("coords"))
    return rows.select("id", *[F.round(F.col("coords")[0][i], 6).alias(c) for i, c in enumerate("xyz")])


EDGES = f"""WITH {F7}, pr AS (SELECT a.gid, a.site AS src, b.site AS dst, b.x - a.x AS rx, b.y - a.y AS ry, b.z - a.z AS rz FROM f7 a
  JOIN f7 b ON a.gid = b.gid AND a.site <> b.site),
di AS (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS d FROM pr),
ed AS MATERIALIZED (SELECT gid, src, dst, rx, ry, rz, d FROM (SELECT *, rank() OVER (PARTITION BY gid, src ORDER BY d) AS rk FROM di
  WHERE d <= 0.3) WHERE rk <= 4)"""


def edges(spark, folder):
    return G.neighbour_edges(points(spark, folder), cutoff=0.3, k=4)


def numbered(found):
    return found.select("gid", F.concat_ws(">", "src", "dst").alias("eid"), "src", "dst", "r")


@query(f"{EDGES} SELECT gid, src, dst, round(d, 6) AS d FROM ed")
def neighbour_edges(spark, folder):
    return edges(spark, folder).select("gid", "src", "dst", F.round("d", 6).alias("d"))


LINES = f"{EDGES}, li AS (SELECT a.gid, a.src || '>' || a.dst AS e1, b.src || '>' || b.dst AS e2, " \
        "-(a.rx * b.rx + a.ry * b.ry + a.rz * b.rz) / (a.d * b.d) AS c FROM ed a JOIN ed b ON a.gid = b.gid AND a.dst = b.src)"


@query(f"{LINES} SELECT gid, e1, e2 FROM li")
def line_graph(spark, folder):
    return G.line_graph(numbered(edges(spark, folder))).select("gid", "e1", "e2")


@query(f"{LINES} SELECT gid, e1, e2, round(greatest(-1, least(1, c)), 5) AS cos FROM li")
def bond_cosine(spark, folder):
    lines = G.line_graph(numbered(edges(spark, folder)))
    return G.bond_cosine(lines).select("gid", "e1", "e2", F.round("cos", 5).alias("cos"))
