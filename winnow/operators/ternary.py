"""Lower hulls of systems of three members, and distances above them.

A composition is (x, y): the shares of the second and third member; the corners (0, 0), (1, 0), (0, 1) are the pure
members. The hull is a set of planes; as it is convex, its energy at a composition is the highest of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.session import materialise, small_side

CORNERS = ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0))
#: slices of either share per level, and distinct compositions that need no finer level
SLICES, DIRECT = (256, 16, 1), 200_000


def lower_facets(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Facets of the lower hull of rows (x, y, e), each composition once and all corners among them: triples of row numbers,
    and planes (a, b, c) with energy a + b x + c y.

    Starts from the corners' plane. The point farthest below a facet is a corner of the hull: the facets that it lies below
    go, and their outer edges are joined to it; each point still below is kept by one facet. Triangles without
    area, where a point lies on the line of an outer edge, are no facets.
    """
    x, y, e = points.T
    spread = float(np.ptp(e)) if len(e) else 0.0
    tol = 1e-12 * (spread + float(np.abs(e).max(initial=0.0)) + 1e-300)

    def plane(tri: tuple[int, int, int]) -> np.ndarray | None:
        i, j, k = tri
        det = (x[j] - x[i]) * (y[k] - y[i]) - (x[k] - x[i]) * (y[j] - y[i])
        if abs(det) < 1e-13:
            return None
        b = ((e[j] - e[i]) * (y[k] - y[i]) - (e[k] - e[i]) * (y[j] - y[i])) / det
        c = ((x[j] - x[i]) * (e[k] - e[i]) - (x[k] - x[i]) * (e[j] - e[i])) / det
        return np.array([e[i] - b * x[i] - c * y[i], b, c])

    def depth(p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return p[0] + p[1] * x[rows] + p[2] * y[rows] - e[rows]

    first = tuple(int(np.flatnonzero((x == u) & (y == v))[0]) for u, v in CORNERS)
    everyone = np.arange(len(e))
    start = plane(first)
    facets: list[tuple[tuple, np.ndarray, np.ndarray]] = [(first, start, everyone[depth(start, everyone) > tol])]
    while (at := next((i for i, f in enumerate(facets) if len(f[2])), None)) is not None:
        _, p, below = facets[at]
        s = int(below[depth(p, below).argmax()])
        planes = np.array([f[1] for f in facets])
        seen = planes[:, 0] + planes[:, 1] * x[s] + planes[:, 2] * y[s] - e[s] > tol
        edges: dict[tuple[int, int], int] = {}
        left = [below]
        for i in np.flatnonzero(seen):
            (a, b, c), _, rows = facets[i]
            left.append(rows)
            for u, v in ((a, b), (b, c), (c, a)):
                edges[min(u, v), max(u, v)] = edges.get((min(u, v), max(u, v)), 0) + 1
        facets = [f for i, f in enumerate(facets) if not seen[i]]
        rows = np.setdiff1d(np.concatenate(left), [s])
        for (u, v), times in edges.items():
            if times > 1 or s in (u, v) or (p := plane((u, v, s))) is None:
                continue
            under = depth(p, rows) > tol
            facets.append(((u, v, s), p, rows[under]))
            rows = rows[~under]
    return np.array([f[0] for f in facets]), np.array([f[1] for f in facets])


def _with_corners(points: pd.DataFrame) -> np.ndarray | None:
    """Lowest energy of each composition, or None where a corner is missing."""
    low = points.groupby(["x", "y"], as_index=False)["e"].min().to_numpy()
    there = {(u, v) for u, v, _ in low}
    return low if all(c in there for c in CORNERS) else None


def hull_planes(points: DataFrame, terminals: DataFrame, slices: Sequence[int] | None = None) -> DataFrame:
    """``planes(a, b, c)`` of the lower hull of each system: system, planes, an array.

    ``points(system, x, y, e)`` and ``terminals`` of the same columns, the corners; systems without all three have no hull.
    A corner of the hull is one of its own slice of compositions together with the terminals, so slices are
    reduced first, in parallel, and wider ones see only what is left: a system that holds a third of all rows is spread over its slices.
    """
    level = materialise(points.select("system", "x", "y", "e").groupBy("system", "x", "y").agg(F.min("e").alias("e")))
    corners = terminals.groupBy("system", "x", "y").agg(F.min("e").alias("e"))
    corners = materialise(corners.where(" or ".join(f"(x = {u} and y = {v})" for u, v in CORNERS)))
    if slices is None:
        slices = SLICES if level.count() > DIRECT else (1,)
    last = "system string, planes array<struct<a:double,b:double,c:double>>"

    def reduced(key, mine: pd.DataFrame, pure: pd.DataFrame) -> pd.DataFrame:
        low = _with_corners(pd.concat([mine, pure])[["x", "y", "e"]])
        if low is None or mine.empty:
            return pd.DataFrame({"system": pd.Series([], dtype=object), "x": [], "y": [], "e": []})
        kept = low[np.unique(lower_facets(low)[0])]
        return pd.DataFrame({"system": key[0], "x": kept[:, 0], "y": kept[:, 1], "e": kept[:, 2]})

    def settled(key, mine: pd.DataFrame, pure: pd.DataFrame) -> pd.DataFrame:
        low = _with_corners(pd.concat([mine, pure])[["x", "y", "e"]])
        if low is None:
            return pd.DataFrame({"system": [], "planes": []}, dtype=object)
        planes = lower_facets(low)[1]
        return pd.DataFrame({"system": [key[0]], "planes": [[dict(zip("abc", map(float, p))) for p in planes]]})

    for n in slices:
        if n == 1:
            break
        cell = lambda c: F.floor(F.col(c) * n).cast("int")
        sliced = level.withColumns({"i": cell("x"), "j": cell("y")})
        cells = sliced.select("system", "i", "j").distinct()
        pure = cells.join(corners, "system").select(F.col("system").alias("of"), F.col("i").alias("k"), F.col("j").alias("l"), "x", "y", "e")
        level = sliced.groupBy("system", "i", "j").cogroup(pure.groupBy("of", "k", "l")).applyInPandas(reduced, "system string, x double, y double, e double")
        level = materialise(level.groupBy("system", "x", "y").agg(F.min("e").alias("e")))
    return level.groupBy("system").cogroup(corners.groupBy("system")).applyInPandas(settled, last)


def energy_above_hull_3(points: DataFrame, terminals: DataFrame, slices: Sequence[int] | None = None) -> DataFrame:
    """Distance of each three-member point above its system's lower hull: adds ``e_hull`` and ``e_above_hull``.

    ``points(id, system, x, y, e)`` with shares x, y >= 0 and x + y <= 1; ``terminals(system, x, y, e)`` the pure members.
    Both are null in a system without all three terminals. The planes of a system, as many as its hull has facets, travel
    to its rows.
    """
    planes = materialise(hull_planes(points, terminals, slices))
    count, most = planes.agg(F.count(F.lit(1)), F.max(F.size("planes"))).first()
    met = points.join(small_side(planes, 64 + 32 * (most or 0), count), "system", "left")
    height = F.transform("planes", lambda p: p["a"] + p["b"] * F.col("x") + p["c"] * F.col("y"))
    return met.withColumn("e_hull", F.array_max(height)).withColumn(
        "e_above_hull", F.when(F.col("e_hull").isNotNull(), F.greatest(F.col("e") - F.col("e_hull"), F.lit(0.0)))
    ).select(*points.columns, "e_hull", "e_above_hull")
