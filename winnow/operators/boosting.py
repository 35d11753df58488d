"""Boosted trees with penalties, parallel trees and column samples, grown from histograms.

Features become bin numbers once. A level of all trees of a round is one job: every task evaluates the trees
grown so far on its rows, adds up gradients and hessians per (tree, node, feature, bin), and these partial
histograms are summed by node; the best split of each node is found where its histogram is. The driver holds cuts,
splits and leaf weights, never rows or histograms.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.session import materialise

#: rounds between two tables of margins, so that a task evaluates a bounded number of trees
KEPT_ROUNDS = 10


@dataclass
class Tree:
    """Nodes by number: a split has a feature, the greatest bin that goes left and where missing values (bin 0) go; a leaf has a weight."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    weight: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, last: int, missing_left: bool, weights: tuple[float, float]) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.missing_left[node] = feature, last, missing_left
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for w in weights:
            for column, value in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.weight, w)):
                column.append(value)
        return self.left[node], self.right[node]

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row of bin numbers ends in."""
        feature, last, missing = np.array(self.feature), np.array(self.bin), np.array(self.missing_left)
        left, right = np.array(self.left), np.array(self.right)
        at = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            b = bins[inner, feature[node]]
            goes_left = np.where(b == 0, missing[node], b <= last[node])
            at[inner] = np.where(goes_left, left[node], right[node])

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.weight)[self.nodes(bins)]


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers: 0 for a missing value, else 1 + the number of cuts below the value."""
    out = np.empty(x.shape, np.int16)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(c, x[:, j], side="left"))
    return out


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names]
    return np.column_stack(columns) if columns else np.zeros((batch.num_rows, 0))


@dataclass(frozen=True)
class FittedBoost:
    features: tuple[str, ...]
    cuts: list
    trees: list
    base: float
    classify: bool

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``: the sum of the base and all trees, or for a classifier 1.0 where its margin is above 0."""
        names = [f"_f{i}" for i in range(len(self.features))]
        shared = df.sparkSession.sparkContext.broadcast((self.cuts, self.trees))
        base, classify = self.base, self.classify

        @F.pandas_udf(T.DoubleType())
        def predict(rows: pd.DataFrame) -> pd.Series:
            cuts, trees = shared.value
            bins = _binned(rows.to_numpy(dtype=float, na_value=np.nan), cuts)
            margin = np.full(len(bins), base)
            for tree in trees:
                margin += tree.values(bins)
            return pd.Series((margin > 0).astype(float) if classify else margin)

        columns = F.struct(*[F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(n) for f, n in zip(self.features, names)])
        return df.withColumn("prediction", predict(columns))


def _gain(g: np.ndarray, h: np.ndarray, penalty: float, alpha: float) -> np.ndarray:
    kept = np.maximum(np.abs(g) - alpha, 0.0)
    return np.divide(kept * kept, h + penalty, out=np.zeros_like(kept), where=h + penalty > 0)


def _weight(g: float, h: float, penalty: float, alpha: float) -> float:
    return -math.copysign(max(abs(g) - alpha, 0.0), g) / (h + penalty) if h + penalty > 0 else 0.0


def best_split(rows: pd.DataFrame, penalty: float, alpha: float, least: float) -> tuple | None:
    """Best split of one node from its histogram (feature, bin, g, h): gain, feature, last bin to the left, whether missing
    values go left, weights of both sides; None if no split gains anything. Ties go to the first feature and lowest bin."""
    best = None
    for feature, part in rows.groupby("feature", sort=True):
        part = part.sort_values("bin")
        g, h, b = part["g"].to_numpy(), part["h"].to_numpy(), part["bin"].to_numpy()
        sg, sh = g.sum(), h.sum()
        there = b > 0
        gone = g[~there].sum(), h[~there].sum()
        lg, lh = np.cumsum(g[there]), np.cumsum(h[there])
        if not len(lg):
            continue
        parent = _gain(np.array([sg]), np.array([sh]), penalty, alpha)[0]
        for missing_left in (False, True) if (~there).any() else (False,):
            gl, hl = (lg + gone[0], lh + gone[1]) if missing_left else (lg, lh)
            gr, hr = sg - gl, sh - hl
            if missing_left or not (~there).any():  # all to the left is no split
                gl, hl, gr, hr = gl[:-1], hl[:-1], gr[:-1], hr[:-1]
            gain = _gain(gl, hl, penalty, alpha) + _gain(gr, hr, penalty, alpha) - parent
            gain = np.where((hl >= least) & (hr >= least), gain, -np.inf)
            if len(gain) and (k := int(gain.argmax())) >= 0 and gain[k] > 1e-9 * max(1.0, parent) and (best is None or gain[k] > best[0] * (1 + 1e-12)):
                sides = (_weight(gl[k], hl[k], penalty, alpha), _weight(gr[k], hr[k], penalty, alpha))
                best = (float(gain[k]), int(feature), int(b[there][k]), missing_left, sides)
    return best


@dataclass(frozen=True)
class PenalisedBoost:
    """Gradient boosting of squared error, or of log loss if ``classify``.

    Each round grows ``parallel`` trees from the same gradients, each worth ``step / parallel`` of its leaf weights, which are
    -T(g) / (h + ``penalty``) with T the sum of gradients shrunk by ``alpha``; a split's gain has the same penalties. ``rows`` is
    the share of rows drawn for a tree, ``columns`` the shares of features drawn for a tree and then for a level. Null and NaN
    features are missing and go to the side where they gain more. Features are cut at ``bins`` quantiles, so with fewer different values
    every split is tried. Rows without a target take no part; a row's draw depends on its features and target, so equal
    rows share it. Levels without any split end a round early. Margins begin at ``start``, by default the mean target, or 0 for a classifier.
    """

    features: tuple[str, ...]
    y: str = "y"
    rounds: int = 1000
    depth: int = 6
    step: float = 0.25
    penalty: float = 0.01
    alpha: float = 0.1
    parallel: int = 4
    rows: float = 0.85
    columns: tuple[float, float] = (0.3, 0.5)
    least: float = 1.0
    bins: int = 256
    classify: bool = False
    seed: int = 0
    start: float | None = None

    def _draw(self, tree: int, level: int) -> list[int]:
        """Features offered to a tree at a level: a hashed order, cut twice; at least one."""
        def first(of: list[int], share: float, name: str) -> list[int]:
            order = sorted(of, key=lambda j: hashlib.md5(f"{self.seed}:{name}:{j}".encode()).hexdigest())
            return sorted(order[: max(1, int(share * len(of)))])

        return first(first(list(range(len(self.features))), self.columns[0], f"tree {tree}"), self.columns[1], f"level {tree} {level}")

    def _cuts(self, rows: DataFrame) -> list[np.ndarray]:
        """Upper bounds of the bins of each feature but the last: quantiles, without repeats."""
        share = [i / self.bins for i in range(1, self.bins)]
        found = rows.agg(*[F.percentile_approx(f"_f{j}", share, 100 * self.bins).alias(f"q{j}") for j in range(len(self.features))]).first()
        return [np.unique(np.array(found[j] if found[j] is not None else [], float)) for j in range(len(self.features))]

    def fit(self, df: DataFrame) -> FittedBoost:
        names = [f"_f{j}" for j in range(len(self.features))]
        target = F.nanvl(F.col(self.y).cast("double"), F.lit(None))
        rows = df.select(*[F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(n) for f, n in zip(self.features, names)], target.alias("_y")).where("_y is not null")
        rows = rows.withColumn("_draw", F.xxhash64(F.lit(self.seed), *names, "_y"))
        base = self.start
        if base is None:
            base = 0.0 if self.classify else rows.agg(F.avg("_y")).first()[0] or 0.0
        rows = materialise(rows.withColumn("_margin", F.lit(base)))
        cuts, trees, done = self._cuts(rows), [], 0
        for number in range(self.rounds):
            grown = self._round(rows, cuts, trees[done:], number)
            if grown is None:
                break
            trees += grown
            if len(trees) - done >= KEPT_ROUNDS * self.parallel and number + 1 < self.rounds:
                rows = materialise(self._advanced(rows, cuts, trees[done:]))
                done = len(trees)
        return FittedBoost(self.features, cuts, trees, base, self.classify)

    def _advanced(self, rows: DataFrame, cuts, trees: list[Tree]) -> DataFrame:
        fitted = FittedBoost(tuple(f"_f{j}" for j in range(len(self.features))), cuts, trees, 0.0, False)
        return fitted.transform(rows).withColumn("_margin", F.col("_margin") + F.col("prediction")).drop("prediction")

    def _round(self, rows: DataFrame, cuts, before: list[Tree], number: int) -> list[Tree] | None:
        """The trees of one round, level by level; None if not even one root gains from a split or has a weight."""
        trees = [Tree() for _ in range(self.parallel)]
        open_nodes = {k: [0] for k in range(self.parallel)}
        for level in range(self.depth):
            offered = {k: self._draw(number * self.parallel + k, level) for k in open_nodes}
            found = self._histograms(rows, cuts, before, trees, open_nodes, offered, number)
            following: dict[int, list[int]] = {}
            for r in found.collect():  # a row per open node
                tree = trees[r["tree"]]
                if level == 0:
                    tree.weight[0] = r["own"] * self.step / self.parallel
                if r["feature"] is not None:
                    scaled = tuple(w * self.step / self.parallel for w in (r["left"], r["right"]))
                    following.setdefault(r["tree"], []).extend(tree.split(r["node"], r["feature"], r["bin"], r["missing_left"], scaled))
            open_nodes = {k: sorted(v) for k, v in following.items()}
            if not open_nodes:
                break
        if all(len(t.feature) == 1 and t.weight[0] == 0.0 for t in trees):
            return None
        return trees

    def _histograms(self, rows: DataFrame, cuts, before, trees, open_nodes, offered, number: int) -> DataFrame:
        """The best split of every open node: tree, node, own (its weight), feature, bin, missing_left, left, right."""
        names = [f"_f{j}" for j in range(len(self.features))]
        shared = rows.sparkSession.sparkContext.broadcast((cuts, before, trees))
        classify, share, parallel = self.classify, self.rows, self.parallel
        penalty, alpha, least = self.penalty, self.alpha, self.least

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cuts, before, trees = shared.value
            width = max(len(c) for c in cuts) + 2
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                bins = _binned(_matrix(batch, names), cuts)
                y, draw = batch.column("_y").to_numpy(), batch.column("_draw").to_numpy().astype(np.uint64)
                margin = batch.column("_margin").to_numpy().copy()
                for tree in before:
                    margin += tree.values(bins)
                if classify:
                    p = 1 / (1 + np.exp(-margin))
                    g, h = p - y, p * (1 - p)
                else:
                    g, h = margin - y, np.ones(len(y))
                for k, nodes in open_nodes.items():
                    at = trees[k].nodes(bins)
                    drawn = _uniform(draw, number * parallel + k) < share
                    for node in nodes:
                        here = np.flatnonzero(drawn & (at == node))
                        if not len(here):
                            continue
                        if (k, node) not in sums:
                            sums[k, node] = np.zeros((len(offered[k]), width, 2))
                        for i, j in enumerate(offered[k]):
                            b = bins[here, j]
                            sums[k, node][i, :, 0] += np.bincount(b, g[here], width)
                            sums[k, node][i, :, 1] += np.bincount(b, h[here], width)
            for (k, node), table in sums.items():
                i, b = np.nonzero(table[:, :, 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), k, np.int32)), pa.array(np.full(len(i), node, np.int32)), pa.array(np.array(offered[k], np.int32)[i]), pa.array(b.astype(np.int32)), pa.array(table[i, b, 0]), pa.array(table[i, b, 1])],
                    ["tree", "node", "feature", "bin", "g", "h"],
                )

        def settled(part: pd.DataFrame) -> pd.DataFrame:
            one = part[part["feature"] == part["feature"].min()]
            own = _weight(one["g"].sum(), one["h"].sum(), penalty, alpha)
            best = best_split(part, penalty, alpha, least)
            row = {"tree": part["tree"].iloc[0], "node": part["node"].iloc[0], "own": own, "feature": None, "bin": None, "missing_left": None, "left": None, "right": None}
            if best is not None:
                row |= {"feature": best[1], "bin": best[2], "missing_left": best[3], "left": best[4][0], "right": best[4][1]}
            return pd.DataFrame([row])

        totals = rows.select(*names, "_y", "_draw", "_margin").mapInArrow(partial, "tree int, node int, feature int, bin int, g double, h double")
        totals = totals.groupBy("tree", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        return totals.groupBy("tree", "node").applyInPandas(settled, "tree int, node int, own double, feature int, bin int, missing_left boolean, left double, right double")


def _uniform(draw: np.ndarray, tree: int) -> np.ndarray:
    """A number in [0, 1) for every row's draw and a tree."""
    z = draw + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)
