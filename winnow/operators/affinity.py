"""Leaf affinity: how many trees put two rows into the same leaf, and the spread of
the target over a row's most similar training rows."""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.session import materialise


def choose_trees(n_trees: int, frac: float, seed: int) -> list[int]:
    """A reproducible subset of tree numbers."""
    order = sorted(range(n_trees), key=lambda t: hashlib.md5(f"{seed}:{t}".encode()).hexdigest())
    return sorted(order[: max(1, round(frac * n_trees))])


def _leaf_rows(df: DataFrame, trees: Sequence[int] | None) -> DataFrame:
    out = df.select("*", F.posexplode("leaves").alias("tree", "leaf")).drop("leaves")
    return out.filter(F.col("tree").isin(list(trees))) if trees is not None else out


#: leaf sums are looked up by place where their numbers span at most this many places in all, 32 bytes each
LEAF_PLACES = 500_000


def leaf_sums(train: DataFrame, y: str, trees: Sequence[int] | None = None) -> DataFrame:
    """``n``, ``s`` and ``ss``: rows, sum and sum of squares of ``y`` per (tree, leaf)."""
    return _leaf_rows(train.select("leaves", y), trees).groupBy("tree", "leaf").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("ss")
    )


def with_leaf_sums(df: DataFrame, train: DataFrame, y: str, trees: Sequence[int] | None = None) -> DataFrame:
    """Add ``stats`` to ``df``: the ``leaf_sums`` of ``train`` for the row's leaf in every tree, null where no row of ``train`` is.

    Trees number their leaves from 0, so the sums are one small table of arrays, sent to every task, and a row reads its
    own by place. Leaves numbered too far apart for that (``LEAF_PLACES``) are joined instead.
    """
    sums = materialise(leaf_sums(train, y, trees))
    spans = {r["tree"]: (r["low"], r["high"]) for r in sums.groupBy("tree").agg(F.min("leaf").alias("low"), F.max("leaf").alias("high")).collect()}
    picked = list(trees) if trees is not None else list(range(max(spans, default=-1) + 1))
    if sum(high - low + 1 for low, high in spans.values()) <= LEAF_PLACES:
        table: dict[int, list] = {t: [None] * (high - low + 1) for t, (low, high) in spans.items()}
        for r in sums.collect():
            table[r["tree"]][r["leaf"] - spans[r["tree"]][0]] = (r["n"], r["s"], r["ss"])
        rows = [(0, [table.get(t, []) for t in picked], [spans[t][0] if t in spans else 0 for t in picked], picked)]
        one = df.sparkSession.createDataFrame(rows, "_one long, _table array<array<struct<n:double,s:double,ss:double>>>, _low array<int>, _trees array<int>")
        place = F.sequence(F.lit(0), F.lit(len(picked) - 1)) if picked else F.array().cast("array<int>")
        stats = F.transform(place, lambda i: F.get(F.get("_table", i), F.get("leaves", F.get("_trees", i)) - F.get("_low", i)))
        # every row has the key 0, so a hash table of one row serves all
        return df.withColumn("_one", F.pmod(F.xxhash64("leaves"), F.lit(1))).join(F.broadcast(one), "_one").select(*df.columns, stats.alias("stats"))
    keyed = df.withColumn("_row", F.monotonically_increasing_id())
    keyed = materialise(keyed)
    places = F.posexplode(F.transform(F.array(*[F.lit(t) for t in picked]), lambda t: F.get("leaves", t)))
    apart = keyed.select("_row", places.alias("_i", "leaf")).withColumn("tree", F.get(F.array(*[F.lit(t) for t in picked]), "_i"))
    met = apart.join(sums, ["tree", "leaf"], "left").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_i", F.when(F.col("n").isNotNull(), F.struct("n", "s", "ss")).alias("v")))).alias("_all"))
    return keyed.join(met, "_row").select(*df.columns, F.transform("_all", lambda e: e["v"]).alias("stats"))


def weighted_variance(
    val: DataFrame, train: DataFrame, trees: Sequence[int] | None = None, id_col: str = "id", y: str = "y"
) -> DataFrame:
    """Mean and variance of the target over all training rows, weighted by affinity.

    Linear: training rows shrink to (n, sum, sum of squares) per (tree, leaf), so a leaf holding a third of all training
    rows is one row; a validation row adds up those of its leaves, without any shuffle. Columns: id, mean, variance, weight.
    """
    centre = train.agg(F.avg(y)).first()[0] or 0.0  # against cancellation
    centred = train.select("leaves", (F.col(y) - F.lit(centre)).alias("t"))
    rows = with_leaf_sums(val.select(id_col, "leaves"), centred, "t", trees)
    none = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "s", "ss")])
    add = lambda a, s: F.struct(*[(a[c] + F.coalesce(s[c], F.lit(0.0))).alias(c) for c in ("n", "s", "ss")])
    rows = rows.select(id_col, F.aggregate("stats", none, add).alias("_sum"))
    weight = F.when(F.col("_sum.n") > 0, F.col("_sum.n"))
    mean = F.col("_sum.s") / weight
    return rows.select(
        id_col,
        (mean + F.lit(centre)).alias("mean"),
        F.when(weight > 0, F.greatest(F.col("_sum.ss") / weight - mean * mean, F.lit(0.0))).alias("variance"),
        weight.cast("long").alias("weight"),
    )


#: keys of a row at one level of blanks hold at most this many leaves in all; up to 8 trees are searched level by level to the end
KEY_LEAVES = 600


def _classes(train: DataFrame, k: int) -> DataFrame:
    """``c``, ``leaves``, ``rows``: rows alike in all leaves, of which the ``k`` of smallest ``tid`` matter, in that order."""
    rank = Window.partitionBy("leaves").orderBy("tid")
    members = train.where(F.col("leaves").isNotNull()).withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)
    rows = members.groupBy("leaves").agg(F.sort_array(F.collect_list(F.struct("place", "tid", "y"))).alias("rows"))
    rows = rows.withColumn("c", F.monotonically_increasing_id())
    # in the order of these structs rows of equal tid have one order everywhere
    return materialise(rows.select("c", "leaves", F.transform("rows", lambda e: F.struct(e["tid"], F.col("c"), e["place"], e["y"])).alias("rows")))


def _keyed(n_trees: int, blanks: int) -> Column:
    """The row's leaves with every choice of ``blanks`` of them set to null."""
    places = F.array(*[F.array(*[F.lit(t) for t in chosen]).cast("array<int>") for chosen in itertools.combinations(range(n_trees), blanks)])
    return F.explode(F.transform(places, lambda chosen: F.transform("leaves", lambda leaf, t: F.when(~F.array_contains(chosen, t), leaf)))).alias("key")


def _first_alike(todo: DataFrame, classes: DataFrame, k: int, n_trees: int, blanks: int) -> DataFrame:
    """``v`` and ``e``: training rows with as many equal leaves as there are places without a blank, or more, each row at least once.

    All rows with more equal leaves are there if they are fewer than ``k``, and of those with exactly as many the
    first in order that can be among the k best: a row has one key in common with them, and under that key it
    stands behind fewer than k others, so k rows of each key are enough.
    """
    if not blanks:
        return todo.join(classes.select("leaves", "rows"), "leaves").select("v", F.explode("rows").alias("e"))
    asked = materialise(todo.select("v", _keyed(n_trees, blanks)))
    posted = classes.select("c", _keyed(n_trees, blanks), F.get("rows", F.lit(0)).alias("head"), F.element_at("rows", -1).alias("tail"), F.size("rows").alias("n"))
    posted = posted.join(asked.select("key").distinct(), "key", "left_semi")
    # behind k heads no class has a row among the first k; nor has one behind the first tails that make up k rows
    posted = posted.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("head"))).where(F.col("_r") <= k)
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("tail").rowsBetween(Window.unboundedPreceding, 0))
    posted = posted.withColumn("_upto", upto)
    last = F.min(F.when(F.col("_upto") >= k, F.col("tail"))).over(Window.partitionBy("key"))
    posted = posted.select("key", "c", last.alias("last")).join(classes.select("c", "rows"), "c")
    rows = F.filter("rows", lambda e: F.col("last").isNull() | (e <= F.col("last")))
    lists = posted.groupBy("key").agg(F.slice(F.sort_array(F.flatten(F.collect_list(rows))), 1, k).alias("rows"))
    lists = materialise(lists)
    # a full list bounds what its row needs of the others
    full = lists.where(F.size("rows") == k).select("key", F.element_at("rows", -1).alias("last"))
    bound = asked.join(full, "key").groupBy("v").agg(F.min("last").alias("last"))
    met = asked.join(bound, "v", "left").join(lists, "key")
    return met.select("v", F.explode(rows).alias("e"))


def _best(met: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each ``v``, with ``n``, the rows it has met, and ``candidates``, the classes these are of."""
    once = met.repartition("v").groupBy("v", "c", "place").agg(F.max("affinity").alias("affinity"), F.first("tid").alias("tid"), F.first("y").alias("y"))
    own = Window.partitionBy("v")
    ranked = once.withColumns({
        "_r": F.row_number().over(own.orderBy(F.desc("affinity"), "tid", "c", "place")),
        "n": F.count(F.lit(1)).over(own),
        # a class is met from its first row on
        "candidates": F.sum((F.col("place") == 1).cast("long")).over(own),
    })
    return ranked.where(F.col("_r") <= k).select("v", "affinity", "tid", "c", "place", "y", "n", "candidates")


def _met(rows: DataFrame, affinity: Column) -> DataFrame:
    return rows.select("v", affinity.cast("long").alias("affinity"), "e.tid", "e.c", "e.place", "e.y")


def _first(classes: DataFrame, k: int) -> DataFrame:
    """``e``: the ``k`` rows of smallest ``tid``."""
    return F.broadcast(classes.select(F.explode("rows").alias("e")).orderBy("e").limit(k))


def _by_postings(todo: DataFrame, classes: DataFrame, k: int, n_trees: int) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """The k best of the rows that share a leaf, the rows met by those that have met fewer, and the ``todo`` of these.

    A class looks its leaves up in postings, those with the fewest classes first. After its m rarest leaves, a row not
    met yet shares at most trees - m leaves, so the search ends where the k-th best is above that; only what is still
    open goes on to more leaves. A leaf that holds a third of all rows is looked up last, mostly never.
    """
    postings = materialise(classes.select("c", F.posexplode("leaves").alias("tree", "leaf")))
    sizes = postings.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("size"))
    looked = todo.select("v", F.posexplode("leaves").alias("tree", "leaf")).join(sizes, ["tree", "leaf"], "left")
    looked = looked.groupBy("v").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("size", F.lit(0)).alias("size"), "tree", "leaf"))).alias("rarest"))
    todo = materialise(looked.join(todo.select("v", "leaves"), "v"))
    own, found, m = Window.partitionBy("v"), [], min(n_trees, max(1, -(-n_trees // 4)))
    heads = classes.select("c", F.col("leaves").alias("_t"), F.get("rows", F.lit(0)).alias("head"))
    while True:
        lists = todo.select("v", F.explode(F.slice("rarest", 1, m)).alias("p")).select("v", "p.tree", "p.leaf")
        met = lists.join(postings, ["tree", "leaf"]).select("v", "c").distinct()
        same = F.aggregate(F.zip_with("leaves", "_t", lambda a, b: (a == b).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
        scored = met.join(heads, "c").join(todo.select("v", "leaves"), "v").select("v", "c", same.alias("affinity"), "head")
        # behind k classes no class has a row among the k best
        near = scored.withColumns({"_r": F.row_number().over(own.orderBy(F.desc("affinity"), "head")), "candidates": F.count(F.lit(1)).over(own)})
        near = near.where(F.col("_r") <= k).join(classes.select("c", "rows"), "c").select("v", "affinity", "candidates", F.explode("rows").alias("e"))
        top = near.withColumns({"_r": F.row_number().over(own.orderBy(F.desc("affinity"), "e")), "n": F.count(F.lit(1)).over(own)})
        top = materialise(top.where(F.col("_r") <= k).select("v", "affinity", "e.tid", "e.c", "e.place", "e.y", "n", "candidates"))
        settled = top.where(F.col("n") >= k).groupBy("v").agg(F.min("affinity").alias("least")).where(F.col("least") > n_trees - m).select("v")
        found.append(top.join(settled, "v", "left_semi"))
        todo = materialise(todo.join(settled, "v", "left_anti"))
        if m == n_trees or todo.isEmpty():
            return found, top.where(F.col("n") < k).select("v", "affinity", "tid", "c", "place", "y"), todo
        m = min(n_trees, 2 * m)


def nearest_by_leaves(
    val: DataFrame, train: DataFrame, k: int, trees: Sequence[int] | None = None, id_col: str = "id", y: str = "y"
) -> DataFrame:
    """The ``k`` training rows that share the most leaves with each validation row, ties to the smaller training id.

    Columns: id, affinity, tid, y, candidates (classes of training rows compared with the row). Rows alike in all
    leaves are one class on either side, of which the k rows of smallest id matter. The search goes level by level:
    rows alike in all leaves, then in all but one, and so on, until k are found (``_first_alike``), and no level forms
    pairs of rows beyond k for each choice of blanks. Where many trees make too many choices (``KEY_LEAVES``), the
    classes still open look their leaves up in postings (``_by_postings``). What shares no leaf comes by id after
    these. Where either row lacks a leaf the affinity is null, which comes last.
    """
    spark = val.sparkSession
    def picked(df: DataFrame) -> DataFrame:
        if trees is None:
            return df
        return df.withColumn("leaves", F.array(*[F.get("leaves", F.lit(t)) for t in trees]))

    val, train = picked(val.select(F.col(id_col).alias("id"), "leaves")), picked(train.select(F.col(id_col).alias("tid"), F.col(y).cast("double").alias("y"), "leaves"))
    classes = _classes(train, k)
    (n_trees,) = classes.agg(F.max(F.size("leaves"))).first()
    out = "id {0}, affinity long, tid {1}, y double, candidates long".format(val.schema["id"].dataType.simpleString(), train.schema["tid"].dataType.simpleString())
    if not n_trees:
        return spark.createDataFrame([], out)
    asked = val.where(F.col("leaves").isNotNull()).select("leaves").distinct().withColumn("v", F.monotonically_increasing_id())
    asked = materialise(asked)
    whole = (F.size("leaves") == n_trees) & ~F.exists("leaves", lambda leaf: leaf.isNull())
    todo, alike = asked.where(whole), classes.where(whole)
    none, nothing = F.lit(None), F.lit(0)
    done = [_best(_met(asked.where(~whole).join(_first(classes, k)), none), k)]
    known, blanks = None, 0
    while blanks < n_trees and (not blanks or math.comb(n_trees, blanks) * n_trees <= KEY_LEAVES) and not todo.isEmpty():
        met = _met(_first_alike(todo, alike, k, n_trees, blanks), F.lit(n_trees - blanks))
        top = materialise(_best(met if known is None else known.union(met), k))
        done.append(top.where(F.col("n") >= k))
        known = top.where(F.col("n") < k).select(*met.columns)
        todo = materialise(todo.join(done[-1].select("v").distinct(), "v", "left_anti").select(*todo.columns))
        blanks += 1
    if blanks < n_trees and not todo.isEmpty():
        found, known, todo = _by_postings(todo, alike, k, n_trees)
        done += found
    if known is not None and not todo.isEmpty():
        rest = _met(todo.join(_first(alike, k)), nothing).union(_met(todo.join(_first(classes.where(~whole), k)), none))
        done.append(_best(known.union(rest), k))
    hits = functools.reduce(DataFrame.union, (d.select("v", "affinity", "tid", "y", "candidates") for d in done))
    return val.join(asked, "leaves").select("id", "v").join(hits, "v").select("id", "affinity", "tid", "y", "candidates")


def topk_variance(
    val: DataFrame, train: DataFrame, k: int, trees: Sequence[int] | None = None, id_col: str = "id", y: str = "y"
) -> DataFrame:
    """Mean and population variance of the target over the ``k`` most similar training rows (``nearest_by_leaves``),
    ``weight``, their affinities added up, and ``candidates``, the classes of training rows that were compared."""
    hits = nearest_by_leaves(val, train, k, trees, id_col, y)
    return hits.groupBy(F.col("id").alias(id_col)).agg(
        F.avg("y").alias("mean"), F.var_pop("y").alias("variance"), F.sum("affinity").alias("weight"), F.max("candidates").alias("candidates")
    )
