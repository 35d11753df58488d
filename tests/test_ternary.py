"""Hulls of three members against every triple of points."""

from itertools import combinations

import numpy as np
import pytest

from winnow.operators import ternary as H


def by_triples(points, x, y):
    best = np.inf
    for a, b, c in combinations(points, 3):
        m = np.array([[a[0], b[0], c[0]], [a[1], b[1], c[1]], [1, 1, 1]])
        if abs(np.linalg.det(m)) < 1e-12:
            continue
        share = np.linalg.solve(m, [x, y, 1])
        if (share >= -1e-9).all():
            best = min(best, share @ [a[2], b[2], c[2]])
    return best


def cloud(rng, n, grid):
    xy = rng.dirichlet([1, 1, 1], n)[:, :2]
    if grid:
        xy = np.floor(xy * grid) / grid
    e = rng.normal(size=n) - 3 * xy.prod(axis=1) * rng.random(n)
    pure = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.5), (0.0, 1.0, 0.2)]
    return pure, [(float(x), float(y), float(v)) for (x, y), v in zip(xy, e)]


@pytest.mark.parametrize("grid,edge", [(0, False), (4, False), (10, True)])
def test_facets(grid, edge):
    rng = np.random.default_rng(grid + edge)
    for _ in range(6):
        pure, points = cloud(rng, 18, grid)
        if edge:  # many points in one line and on the sides
            points += [(k / 10, 0.0, float(rng.normal())) for k in range(1, 10)] + [(k / 10, 1 - k / 10, float(rng.normal())) for k in range(1, 10)]
        low = {}
        for x, y, e in pure + points:
            low[x, y] = min(e, low.get((x, y), np.inf))
        table = np.array([(x, y, e) for (x, y), e in low.items()])
        _, planes = H.lower_facets(table)
        assert (table @ [0, 0, 1] >= (planes @ np.column_stack([np.ones(len(table)), table[:, :2]]).T).max(axis=0) - 1e-9).all()
        for x, y, _ in table[:12]:
            assert (planes @ [1, x, y]).max() == pytest.approx(by_triples(table, x, y), abs=1e-9)


@pytest.mark.parametrize("slices", [None, (8, 2, 1)])
def test_distances(spark, slices):
    rng = np.random.default_rng(3)
    rows, pure_rows, truth = [], [], {}
    for s in ("a-b-c", "a-b-d"):
        pure, points = cloud(rng, 25, 6)
        pure_rows += [(s, *p) for p in pure]
        low = {}
        for x, y, e in pure + points:
            low[x, y] = min(e, low.get((x, y), np.inf))
        table = [(x, y, e) for (x, y), e in low.items()]
        for x, y, e in points:
            truth[len(rows)] = e - by_triples(table, x, y)
            rows.append((len(rows), s, x, y, e))
    rows.append((len(rows), "x-y-z", 0.2, 0.2, 1.0))
    pure_rows += [("x-y-z", 0.0, 0.0, 1.0), ("q-r-s", 0.0, 0.0, 1.0)]
    points, ends = spark.createDataFrame(rows, "id long, system string, x double, y double, e double").repartition(3), spark.createDataFrame(pure_rows, "system string, x double, y double, e double")
    got = {r["id"]: r for r in H.energy_above_hull_3(points, ends, slices).collect()}
    assert len(got) == len(rows) and got[len(rows) - 1]["e_hull"] is None and got[len(rows) - 1]["e_above_hull"] is None
    for i, d in truth.items():
        assert got[i]["e_above_hull"] == pytest.approx(max(d, 0.0), abs=1e-9)
    assert H.energy_above_hull_3(points.where("false"), ends).count() == 0
