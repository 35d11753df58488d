"""Affinity, influence, columns, composition, hull and graphs against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from winnow.operators import affinity as A
from winnow.operators import classify as K
from winnow.operators import columns as C
from winnow.operators import composition as D
from winnow.operators import graph as G
from winnow.operators import influence as I

rng = np.random.default_rng(11)


@pytest.fixture
def leaf_tables(spark):
    val = [(i, [int(v) for v in rng.integers(0, 3, 5)]) for i in range(40)]
    train = [(100 + i, [int(v) for v in rng.integers(0, 3, 5)], float(rng.normal())) for i in range(90)]
    return val, train, spark.createDataFrame(val, "id long, leaves array<int>"), spark.createDataFrame(train, "id long, leaves array<int>, y double")


@pytest.mark.parametrize("trees", [None, [0, 3]])
def test_weighted_affinity(leaf_tables, trees):
    val, train, v, t = leaf_tables
    pick = trees or range(5)
    got = {r["id"]: r for r in A.weighted_variance(v, t, trees).collect()}
    for i, leaves in val:
        ys = [y for _, tl, y in train for tree in pick if leaves[tree] == tl[tree]]
        assert got[i]["weight"] == len(ys)
        assert abs(got[i]["variance"] - np.var(ys)) < 1e-9 and abs(got[i]["mean"] - np.mean(ys)) < 1e-9


@pytest.mark.parametrize("trees", [None, [4, 1]])
@pytest.mark.parametrize("k", [1, 9, 70, 500])
def test_topk_affinity(leaf_tables, spark, trees, k):
    """Ties, rows alike in all leaves, a leaf that most rows share, leaves of one side only, rows without any shared leaf."""
    val, train, _, _ = leaf_tables
    hot = [(1000 + i, [0, i % 2, 0, 0, 0], float(i)) for i in range(60)]
    train = train + hot + [(2000, [8, 8, 8, 8, 8], 3.0)]
    val = val + [(50, [9, 9, 9, 9, 9]), (51, [0, 0, 0, 0, 0]), (52, [0, 0, 0, 0, 0]), (53, [8, 0, 7, 8, 8])]
    v, t = spark.createDataFrame(val, "id long, leaves array<int>").repartition(3), spark.createDataFrame(train, "id long, leaves array<int>, y double").repartition(3)
    pick = trees or range(5)
    got = {}
    for r in A.nearest_by_leaves(v, t, k, trees).collect():
        got.setdefault(r["id"], []).append((-r["affinity"], r["tid"], r["y"]))
        assert r["candidates"] <= len({tuple(x[1]) for x in train})
    summary = {r["id"]: r for r in A.topk_variance(v, t, k, trees).collect()}
    for i, leaves in val:
        best = sorted((-sum(leaves[p] == tl[p] for p in pick), j, y) for j, tl, y in train)[:k]
        assert sorted(got[i]) == best
        assert abs(summary[i]["variance"] - np.var([b[2] for b in best])) < 1e-9
        assert summary[i]["weight"] == -sum(b[0] for b in best)


def test_topk_affinity_ends_early(spark):
    """Rows with as many like ones as are asked for meet only those of their rarest leaf."""
    train = [(g * 100 + i, [g, g % 5, 0, 0], float(i)) for g in range(40) for i in range(10)]
    val = [(10_000 + g, [g, g % 5, 0, 0]) for g in range(40)]
    v, t = spark.createDataFrame(val, "id long, leaves array<int>"), spark.createDataFrame(train, "id long, leaves array<int>, y double")
    got = A.nearest_by_leaves(v, t, 10).collect()
    assert len(got) == 400 and {r["affinity"] for r in got} == {4} and {r["candidates"] for r in got} == {1}
    assert A.nearest_by_leaves(v, t.where("false"), 10).count() == 0


def test_topk_affinity_compares_few(spark):
    """Each choice of blanks brings k classes at most, however many share a leaf, with as many classes as rows."""
    g = np.random.default_rng(4)
    train = [(i, [int(v) for v in leaves], float(i)) for i, leaves in enumerate(np.unique(g.integers(0, 5, (4000, 6)), axis=0))]
    val = [(10_000 + i, [int(v) for v in g.integers(0, 5, 6)]) for i in range(30)]
    v, t = spark.createDataFrame(val, "id long, leaves array<int>"), spark.createDataFrame(train, "id long, leaves array<int>, y double")
    got = {}
    for r in A.nearest_by_leaves(v, t, 8).collect():
        got.setdefault(r["id"], []).append((-r["affinity"], r["tid"], r["y"]))
        assert r["candidates"] <= 8 * (1 + 6 + 15)
    for i, leaves in val:
        assert sorted(got[i]) == sorted((-sum(a == b for a, b in zip(leaves, tl)), j, y) for j, tl, y in train)[:8]


@pytest.mark.parametrize("n_trees", [4, 12])
@pytest.mark.parametrize("k", [6, 400])
def test_topk_affinity_with_gaps(spark, n_trees, k):
    """More trees than are searched by level; rows without a leaf, without leaves, without a target; ids that come twice."""
    g = np.random.default_rng(n_trees)
    drawn = lambda n, some: [[None if g.random() < 0.02 else int(x) for x in g.integers(0, some, n_trees)] for _ in range(n)]
    val = [(i // 2, leaves) for i, leaves in enumerate(drawn(40, 4) + [[9] * n_trees, [9] * n_trees])]
    train = [(500 + i, leaves, None if i % 9 == 0 else float(g.normal())) for i, leaves in enumerate(drawn(250, 4) + 5 * drawn(1, 2))]
    v = spark.createDataFrame(val + [(99, None)], "id long, leaves array<int>").repartition(3)
    t = spark.createDataFrame(train + [(1, None, 0.0)], "id long, leaves array<int>, y double").repartition(3)
    got, want = {}, {}
    for r in A.nearest_by_leaves(v, t, k).collect():
        got.setdefault(r["id"], []).append((r["affinity"] is None, -(r["affinity"] or 0), r["tid"], str(r["y"])))
    for i, leaves in val:
        lacks = lambda tl: None in leaves + tl
        want.setdefault(i, []).extend(sorted((lacks(tl), 0 if lacks(tl) else -sum(a == b for a, b in zip(leaves, tl)), j, str(y)) for j, tl, y in train)[:k])
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}


@pytest.mark.parametrize("sent", [True, False])
def test_order_features_with_parts_sent_or_dealt(spark, tmp_path, monkeypatch, sent):
    """A part table of few bytes goes to every task, lines stay where they are; both ways the same rows."""
    from catalog.tables import order_features
    from winnow import session

    lines = [(i % 37, i % 11 if i % 13 else None, float(i % 50), float(i), 0.01 * (i % 10) if i % 7 else None, 0.02) for i in range(400)]
    parts = [(i, i + 1, 900.0 + i) for i in range(9)] + [(3, 50, 1000.0), (None, 1, 1.0)]
    columns = "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(lines, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        if not sent:
            monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
        df = order_features(spark, str(tmp_path))
        got = {r["id"]: r for r in df.collect()}
        assert ("BroadcastHashJoin" in df._jdf.queryExecution().toString()) == sent
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    size = {}
    for key, s, _ in parts:
        size.setdefault(key, []).append(s)
    want = {}
    for o, key, q, *_ in lines:
        want.setdefault(o, []).extend((s, q) for s in size.get(key, []) if key is not None)
    want = {o: x for o, x in want.items() if x}
    assert set(got) == set(want)
    for o, x in want.items():
        assert got[o]["n_lines"] == len(x) and got[o]["qty"] == sum(q for _, q in x) and math.isclose(got[o]["avg_p_size"], np.mean([s for s, _ in x]), abs_tol=1e-6)


def fit(x, y):
    slope = np.cov(x, y, bias=True)[0, 1] / np.var(x)
    return slope, y.mean() - slope * x.mean()


def test_influence_matches_refits(rows):
    small = rows.filter("id < 150").persist()
    p = small.toPandas()
    b0, a0 = fit(p.x, p.y)
    ref = a0 + b0 * p.x
    got = {r["id"]: r for r in I.deletion_influence(small, "x").collect()}
    for k in range(len(p)):
        b, a = fit(p.x.drop(k), p.y.drop(k))
        delta = (a + b * p.x - ref).abs()
        r = got[p.id[k]]
        assert math.isclose(r["self_abs"], delta[k], abs_tol=1e-9) and math.isclose(r["max_abs"], delta.max(), abs_tol=1e-9)
        assert math.isclose(r["mean_abs"], delta.mean(), abs_tol=1e-9)
        assert math.isclose(r["mean_pct"], (delta / ref.abs()).mean(), rel_tol=1e-6)


@pytest.mark.parametrize("log", [False, True])
@pytest.mark.parametrize("rm_self", [False, True])
def test_pair_influence_matches_refits(spark, rows, log, rm_self):
    small = rows.filter("id < 40").withColumn("y", F.exp("y")).persist()
    p = small.toPandas().set_index("id")
    target = np.log10(p.y) if log else p.y
    pairs = [(int(i), int(j)) for i, j in itertools.product(p.index, p.index)]
    got = I.influence_of_pairs(small, spark.createDataFrame(pairs, "removed_id long, id long"), "x", rm_self=rm_self, log_target=log)

    def predict(drop, j):
        b, a = fit(p.x.drop(list(drop)), target.drop(list(drop)))
        value = a + b * p.x[j]
        return 10 ** value if log else value

    for r in got.collect():
        i, j = r["removed_id"], r["id"]
        if rm_self:
            ref, new = predict({i}, j), predict({i, j}, j)
        else:
            ref, new = predict(set(), j), predict({i}, j)
        assert math.isclose(r["abs_influ"], abs(new - ref), abs_tol=1e-8)
        assert math.isclose(r["pct_influ"], abs((new - ref) / ref), abs_tol=1e-8)


@pytest.fixture
def wide(spark):
    x = rng.normal(size=(200, 5))
    x[:, 3] = x[:, 0] + 0.1 * x[:, 3]
    x[:, 4] = x[:, 0] - x[:, 1]
    pdf = pd.DataFrame(x, columns=list("abcde"))
    pdf["k"] = 1.0
    return pdf, spark.createDataFrame(pdf)


def test_corr_pairwise_complete(spark, wide):
    pdf, _ = wide
    pdf = pdf.copy()
    pdf.loc[::7, "a"] = None
    pdf.loc[::5, "c"] = None
    df = spark.createDataFrame([[None if pd.isna(v) else float(v) for v in r] for r in pdf.values], ", ".join(f"{c} double" for c in pdf))
    want = pdf.corr().abs()
    for r in C.corr_pairs(df, list(pdf)).collect():
        w = want.loc[r["col_a"], r["col_b"]]
        assert (r["r"] is None and pd.isna(w)) or abs(r["r"] - w) < 1e-9


def test_spearman(wide):
    pdf, df = wide
    want = pdf.corr("spearman").abs()
    for r in C.corr_pairs(df, list("abcde"), "spearman").collect():
        assert abs(r["r"] - want.loc[r["col_a"], r["col_b"]]) < 1e-9


def test_spearman_with_gaps(spark):
    """Ties, columns with the same and with other gaps, a constant, an empty column, NaN as a gap; as many jobs for 4 columns as for 8."""
    g = np.random.default_rng(6)
    pdf = pd.DataFrame({c: g.normal(size=700) for c in "abcdefgh"})
    pdf["b"] = (pdf["a"] + pdf["b"]).round(0)
    pdf["c"] = g.integers(0, 3, 700).astype(float)
    pdf["d"] = np.where(g.random(700) < 0.4, 1.0, pdf["d"])  # one value in four of ten rows
    pdf["g"], pdf["h"] = 2.0, np.nan
    pdf.loc[::3, ["a", "e"]] = np.nan
    pdf.loc[1::4, "c"] = np.nan
    pdf.loc[g.random(700) < 0.2, "f"] = np.nan
    rows = [[float("nan") if pd.isna(v) and i % 2 else None if pd.isna(v) else float(v) for v in r] for i, r in enumerate(pdf.values)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf)).repartition(5)
    want = pdf.corr("spearman").abs()
    sc, used = spark.sparkContext, []
    for i, cols in enumerate(("abcf", "abcdefgh")):
        sc.setJobGroup(f"spearman-{i}", "")
        got = {(r["col_a"], r["col_b"]): r["r"] for r in C.corr_pairs(df, list(cols), "spearman").collect()}
        used.append(len(sc.statusTracker().getJobIdsForGroup(f"spearman-{i}")))
        pairs = [(x, y) for x in cols for y in cols if x < y]
        for x, y in pairs:
            w, r = want.loc[x, y], got.get((x, y))
            assert (r is None or math.isnan(r)) if math.isnan(w) else abs(r - w) < 1e-9, (x, y)
        assert set(got) == set(pairs)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert used[1] <= used[0] + 2


def test_drop_correlated_leaves_no_pair(wide):
    pdf, df = wide
    kept, dropped = C.drop_correlated(df, list("abcdek"), 0.6)
    table = pdf.corr().abs().to_numpy(copy=True)
    np.fill_diagonal(table, 0)
    table = pd.DataFrame(table, pdf.columns, pdf.columns)
    worst_first = []
    while True:
        now = table.drop(index=worst_first, columns=worst_first)
        stats = pd.DataFrame({"n": (now >= 0.6).sum(), "max": now.max(), "mean": now.mean()}).sort_values(["n", "max", "mean"])
        if stats["n"].iloc[-1] == 0:
            break
        worst_first.append(stats.index[-1])
    assert dropped == worst_first and dropped and sorted(kept + dropped) == sorted("abcdek")
    left = pdf[[c for c in kept if c != "k"]].corr().abs().to_numpy()
    np.fill_diagonal(left, 0)
    assert (left < 0.6).all()


def test_roc_with_ties(spark):
    s, y = rng.integers(0, 8, 80) / 8, rng.integers(0, 2, 80)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int")
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert abs(K.roc_auc(df).first()[0] - want) < 1e-12
    last = K.roc_curve(df).orderBy("threshold").first()
    assert last["tpr"] == 1.0 and last["fpr"] == 1.0
    assert K.roc_auc(df.withColumn("label", F.lit(1))).first()[0] is None


BAG = "id long, member string, amount double"


def test_composition_features(spark):
    bag = spark.createDataFrame([(1, "A", 1.0), (1, "B", 2.0), (1, "B", 1.0), (2, "A", 5.0), (3, "A", 1.0), (3, "Z", 1.0)], BAG)
    props = spark.createDataFrame([("A", 10.0), ("B", 20.0)], "member string, p double")
    got = {r["id"]: r for r in D.composition_features(bag, props, ["p"]).collect()}
    assert got[1]["norm_0"] == 2.0 and math.isclose(got[1]["norm_2"], math.sqrt(0.25**2 + 0.75**2))
    assert (got[1]["p_min"], got[1]["p_max"], got[1]["p_mean"], got[1]["p_avg_dev"], got[1]["p_mode"]) == (10, 20, 17.5, 3.75, 20)
    assert got[2]["p_avg_dev"] == 0 and got[3]["p_mean"] is None and got[3]["norm_0"] == 2.0


def test_reference_subtracted(spark):
    values = spark.createDataFrame([(1, -4.0), (2, -9.0), (3, -6.0)], "id long, e double")
    bag = spark.createDataFrame([(1, "Al", 2.0), (2, "Fe", 1.0), (3, "Al", 1.0), (3, "Fe", 3.0)], BAG)
    fixed = {r["id"]: r["ef"] for r in D.reference_subtracted(values, bag, "e").collect()}
    assert math.isclose(fixed[3], -6 - (0.25 * -3.74798896 + 0.75 * -8.23919192))
    reset = {r["id"]: r["ef"] for r in D.reference_subtracted(values, bag, "e", reset=True).collect()}
    assert reset[1] == 0 and math.isclose(reset[3], -6 - (0.25 * -4 + 0.75 * -9))
    with pytest.raises(Exception, match="no reference for member Xx"):
        D.reference_subtracted(values, bag.unionByName(spark.createDataFrame([(3, "Xx", 1.0)], BAG)), "e").collect()


def test_systems(spark):
    members = spark.createDataFrame([(m,) for m in "DBACEFA"], "member string")
    got = {(r["system"], r["k"]) for r in D.enumerate_systems(members).collect()}
    want = {("-".join(c), k) for k in range(1, 6) for c in itertools.combinations("ABCDEF", k)}
    assert got == want
    many = spark.range(129).select(F.format_string("m%03d", "id").alias("member")).unionByName(spark.createDataFrame([(None,)], "member string"))
    assert dict(map(tuple, D.system_sizes(D.enumerate_systems(many, kmax=2)).collect())) == {1: 129, 2: 129 * 64}


@pytest.mark.parametrize("slices", [None, (16, 4, 1)])
def test_hull(spark, slices):
    points = [(i, f"S{i % 3}", float(rng.integers(0, 40)) / 40, float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(points, "id long, system string, x double, e double")
    ends = spark.createDataFrame([(f"S{s}", float(x), 0.0) for s in range(3) for x in (0, 1)], "system string, x double, e double")
    corners = D.lower_hull(df.select("system", "x", "e").unionByName(ends), slices).toPandas()
    got = {r["id"]: r["e_above_hull"] for r in D.energy_above_hull(df, ends).collect()}
    for i, system, x, e in points:
        own = [(px, pe) for _, s, px, pe in points if s == system] + [(0.0, 0.0), (1.0, 0.0)]
        low = min(
            pe if qx == px else pe + (qe - pe) * (x - px) / (qx - px)
            for px, pe in own for qx, qe in own if px <= x <= qx and (px < qx or px == x)
        )
        assert math.isclose(got[i], e - low, abs_tol=1e-9)
        assert got[i] >= 0
    for system, part in corners.groupby("system"):
        part = part.sort_values("x")
        slopes = np.diff(part["e"]) / np.diff(part["x"])
        assert (np.diff(slopes) > 0).all()


def test_transition_score_of_single_member_is_null(spark):
    hull = spark.createDataFrame([(1, 0.1), (2, 0.1)], "id long, e_above_hull double")
    bag = spark.createDataFrame([(1, "A", 1.0), (2, "A", 1.0), (2, "B", 1.0)], BAG)
    got = {r["id"]: r["transition_t"] for r in D.transition_score(hull, bag).collect()}
    assert got[1] is None and math.isclose(got[2], 0.1 / (D.K_B * math.log(2)))


def brute_edges(sites, targets, cutoff, k):
    out = set()
    for gid, src, c in sites:
        near = []
        for g2, dst, image, p in targets:
            if g2 != gid or (dst == src and image == (0, 0, 0)):
                continue
            d = math.dist(c, p)
            if d <= cutoff:
                near.append((d, dst, image))
        near.sort()
        if len(near) > k:
            limit = near[k - 1][0]
            near = [n for n in near if n[0] <= limit + 1e-12]
        out |= {(gid, src, dst, image) for _, dst, image in near}
    return out


def test_neighbours_in_mixed_density(spark):
    dense = rng.normal(scale=0.01, size=(60, 3))
    sparse = rng.uniform(-4, 4, size=(40, 3))
    sites = [(i % 2, i, [float(v) for v in c]) for i, c in enumerate(np.concatenate([dense, sparse]))]
    df = spark.createDataFrame(sites, "gid int, site int, c array<double>")
    got = {(r["gid"], r["src"], r["dst"], tuple(r["image"])) for r in G.neighbour_edges(df, cutoff=2.0, k=5).collect()}
    assert got == brute_edges(sites, [(g, s, (0, 0, 0), c) for g, s, c in sites], 2.0, 5)


def test_piles_of_copies_stay_small(spark):
    dense = rng.normal(scale=1e-7, size=(300, 3))
    spots = [(0, i, [float(v) for v in c]) for i, c in enumerate(dense)]
    pile = [(1, 1000 + i, [0.5, 0.5, 0.5]) for i in range(500)] + [(1, i, [0.5, 0.5, 0.5 + i / 10]) for i in (1, 2, 3)]
    df = spark.createDataFrame(spots + pile, "gid int, site int, c array<double>")
    found = G.neighbour_edges(df, cutoff=2.0, k=4).collect()
    got = {(r["gid"], r["src"], r["dst"], tuple(r["image"])) for r in found if r["gid"] == 0}
    assert got == brute_edges(spots, [(g, s, (0, 0, 0), c) for g, s, c in spots], 2.0, 4)
    piled = {(r["src"], r["dst"], r["n_src"], r["n_dst"]) for r in found if r["gid"] == 1}
    # the pile's own copies are its nearest; each single site sees nearer singles, then the pile
    assert (1000, 1000, 500, 499) in piled and not any(a == 1000 and b != 1000 for a, b, _, _ in piled)
    assert {e for e in piled if e[0] == 3} == {(3, 2, 1, 1), (3, 1, 1, 1), (3, 1000, 1, 500)}
    place = {(r["gid"], r["site"]): r["place"] for r in G.place_sites(df).collect()}
    assert len(place) == len(spots) + len(pile) and {place[1, 1000 + i] for i in range(500)} == {1000}
    lines = G.line_graph(G.neighbour_edges(df, cutoff=2.0, k=4).withColumn("eid", F.monotonically_increasing_id()).filter("gid = 1"))
    assert lines.agg(F.max("n_paths")).first()[0] == 500 * 499 * 499


def test_periodic_neighbours(spark):
    lattice = [[3.0, 0.0, 0.0], [0.5, 2.5, 0.0], [0.0, 0.3, 4.0]]
    frac = [(0, 0, [0.1, 0.2, 0.3]), (0, 1, [0.6, 0.7, 0.9]), (1, 0, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(g, s, f, lattice) for g, s, f in frac], "gid int, site int, frac array<double>, lattice array<array<double>>")
    images = G.periodic_images(df, 5.0)
    home = images.filter("image = array(0, 0, 0)").select("gid", "site", "c")
    got = {(r["gid"], r["src"], r["dst"], tuple(r["image"])) for r in G.neighbour_edges(home, 5.0, 12, images.select("gid", "site", "c", "image")).collect()}
    cells, m = range(-5, 6), np.array(lattice)
    targets = [(g, s, (a, b, c), list((np.array(f) + (a, b, c)) @ m)) for g, s, f in frac for a in cells for b in cells for c in cells]
    sites = [(g, s, list(np.array(f) @ m)) for g, s, f in frac]
    want = brute_edges(sites, targets, 5.0, 12)
    assert got == want


def test_bond_cosine(spark):
    edges = spark.createDataFrame(
        [(0, "a", 1, 2, [1.0, 0.0, 0.0]), (0, "b", 2, 3, [0.0, 2.0, 0.0]), (0, "c", 2, 1, [-1.0, 0.0, 0.0])],
        "gid int, eid string, src int, dst int, r array<double>")
    got = {(r["e1"], r["e2"]): r["cos"] for r in G.bond_cosine(G.line_graph(edges)).collect()}
    assert got == {("a", "b"): 0.0, ("a", "c"): 1.0, ("c", "a"): 1.0}
