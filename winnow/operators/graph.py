"""Neighbour graphs of point sets, and their line graphs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.columns import cartesian, cross3, dot3, norm3
from winnow.session import materialise

#: grid levels tried per round: cell edge is cutoff / 2**level
LEVELS = 8
#: a cell with more than this many times k points is refined further
CROWDED = 16
#: finest grid level; doubles resolve little beyond
MAX_LEVEL = 40
#: significant digits to which distances are compared
TIE_DIGITS = 11


def periodic_images(sites: DataFrame, cutoff: float, frac: str = "frac", lattice: str = "lattice") -> DataFrame:
    """Every site repeated in each lattice cell that can hold neighbours within ``cutoff``.

    Adds ``image`` (array of three cell offsets) and ``c`` (Cartesian point). The
    number of cells per axis follows from the distance between lattice planes.
    """
    m = F.col(lattice)
    volume = F.abs(dot3(m[0], cross3(m[1], m[2])))
    out = sites
    for axis in range(3):
        normal = norm3(cross3(m[(axis + 1) % 3], m[(axis + 2) % 3]))
        reach = (F.ceil(F.lit(cutoff) * normal / volume) + 1).cast("int")
        out = out.withColumn(f"_o{axis}", F.explode(F.sequence(-reach, reach)))
    image = F.array(*[F.col(f"_o{a}") for a in range(3)])
    moved = F.array(*[F.col(frac)[a] + F.col(f"_o{a}") for a in range(3)])
    return out.withColumn("c", cartesian(moved, m)).withColumn("image", image).drop("_o0", "_o1", "_o2")


ORIGIN = (0, 0, 0)
CELL = ["gid", "level", "g0", "g1", "g2"]


def _image(offsets: tuple[int, int, int] = ORIGIN) -> Column:
    return F.array(*[F.lit(o) for o in offsets])


def _with_cells(frame: DataFrame, point: str, cutoff: float) -> DataFrame:
    """Grid cell of ``point`` at the row's ``level``."""
    edge = F.lit(cutoff) / F.pow(F.lit(2.0), F.col("level").cast("double"))
    return frame.select("*", *[F.floor(F.col(point)[a] / edge).cast("long").alias(f"g{a}") for a in range(3)])


def _fitting_level(places: DataFrame, targets: DataFrame, cutoff: float, k: int) -> DataFrame:
    """Per place the finest grid level whose cell holds more than ``k`` points: gid, src, fit.

    Counts are one row per cell. Levels are tried in rounds; a further round looks at
    the places whose finest cell is still crowded, so dense regions are resolved
    without trying all levels for everyone. Places in no such cell are left out.
    """
    out, first = None, 0
    here, there = places.select("gid", "src", "sc"), targets.select("gid", "tc", "n_dst")
    while True:
        last = min(first + LEVELS, MAX_LEVEL)
        levels = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("level")
        cells = (
            _with_cells(there.select("gid", "tc", "n_dst", levels), "tc", cutoff)
            .groupBy(*CELL).agg(F.sum("n_dst").alias("held")).filter(F.col("held") > k)
        )
        found = materialise(
            _with_cells(here.select("gid", "src", "sc", levels), "sc", cutoff).join(cells, CELL)
            .groupBy("gid", "src").agg(F.max("level").alias("fit"), F.max_by("held", "level").alias("held"))
        )
        out = found if out is None else out.unionByName(found)
        crowded = found.filter((F.col("fit") == last) & (F.col("held") > CROWDED * k))
        if last == MAX_LEVEL or not crowded.head(1):
            return out.groupBy("gid", "src").agg(F.max("fit").alias("fit"))
        keys = crowded.select("gid", "src")
        here = here.join(keys, ["gid", "src"], "left_semi")
        busy = cells.filter((F.col("level") == last) & (F.col("held") > CROWDED * k)).select(*CELL)
        there = _with_cells(there.withColumn("level", F.lit(last)), "tc", cutoff).join(busy, CELL, "left_semi").select("gid", "tc", "n_dst")
        first = last + 1


def neighbour_edges(
    sites: DataFrame, cutoff: float = 8.0, k: int = 12, images: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` nearest neighbours of each site within ``cutoff``; ties at the k-th distance stay.

    ``sites(gid, site, c)`` with ``c`` an array of three coordinates; ``images(gid,
    site, c, image)`` adds periodic copies as possible neighbours (without it each
    structure is taken as it stands). Columns: gid, src, dst, image, r (array), d,
    n_src, n_dst.

    Sites at the very same place are one place, named by its smallest site and counted
    in ``n_src`` and ``n_dst`` (1 for ordinary structures); its other sites appear as an
    edge of length 0 to itself. A pile of copies therefore costs one row, not all pairs;
    :func:`place_sites` names the place of every site, so that no id is lost.

    Ties are judged on the distance rounded to ``TIE_DIGITS``: in crystals they are the rule.

    Pairs are never enumerated per structure. A place whose grid cell holds more than k
    points has its k nearest within that cell's diagonal, so the finest such cell gives
    a proven search radius; the place then meets only points of the cells around it, at
    the grid level that fits this radius. Dense regions use fine grids, sparse ones
    coarse, and nothing is cut off.
    """
    places = sites.groupBy("gid", F.col("c").alias("sc")).agg(
        F.min("site").alias("src"), F.count(F.lit(1)).alias("n_src")
    )
    if images is None:
        targets = places.select("gid", F.col("src").alias("dst"), F.col("sc").alias("tc"), _image().alias("image"),
                                F.col("n_src").alias("n_dst"))
    else:
        targets = images.groupBy("gid", F.col("c").alias("tc"), "image").agg(
            F.min("site").alias("dst"), F.count(F.lit(1)).alias("n_dst")
        )
    places, targets = materialise(places), materialise(targets)
    fitting = _fitting_level(places, targets, cutoff, k)
    placed = places.join(fitting, ["gid", "src"], "left")
    edge = F.lit(cutoff) / F.pow(F.lit(2.0), F.col("fit").cast("double"))
    radius = F.least(F.lit(cutoff), F.coalesce(edge * math.sqrt(3), F.lit(cutoff)))
    # cells one level up are at least as wide as the radius (2 > sqrt 3)
    level = F.greatest(F.coalesce(F.col("fit") - 1, F.lit(0)), F.lit(0))
    placed = placed.withColumn("radius", radius).withColumn("level", level)
    around = _with_cells(placed, "sc", cutoff)
    for a in range(3):
        around = around.withColumn(f"g{a}", F.explode(F.sequence(F.col(f"g{a}") - 1, F.col(f"g{a}") + 1)))
    used = placed.select("gid", "level").distinct()
    near = _with_cells(targets.join(used, "gid"), "tc", cutoff)
    r = F.array(*[F.col("tc")[a] - F.col("sc")[a] for a in range(3)])
    home = (F.col("src") == F.col("dst")) & (F.col("image") == _image())
    others = F.when(home, F.col("n_dst") - 1).otherwise(F.col("n_dst"))
    found = (
        around.join(near, CELL)
        .select("gid", "src", "dst", "image", r.alias("r"), norm3(r).alias("d"), "radius", "n_src", others.alias("n_dst"))
        .filter((F.col("n_dst") > 0) & (F.col("d") <= F.col("radius") * (1 + 1e-12)) & (F.col("d") <= F.lit(cutoff)))
    )
    unit = F.pow(F.lit(10.0), F.floor(F.log10("d")) - (TIE_DIGITS - 1))
    found = found.withColumn("_d", F.when(F.col("d") > 0, F.round(F.col("d") / unit) * unit).otherwise(0.0))
    of_place = Window.partitionBy("gid", "src").orderBy("_d")
    at_most = F.sum("n_dst").over(of_place.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    tied = F.sum("n_dst").over(of_place.rangeBetween(Window.currentRow, Window.currentRow))
    return (
        found.withColumn("_nearer", at_most - tied).filter(F.col("_nearer") < k).drop("_nearer", "radius", "_d")
    )


def place_sites(sites: DataFrame) -> DataFrame:
    """The place of every site, named by its smallest site: gid, site, place."""
    named = sites.groupBy("gid", "c").agg(F.min("site").alias("place"))
    return sites.join(named, ["gid", "c"]).select("gid", "site", "place")


def line_graph(edges: DataFrame) -> DataFrame:
    """Edges become nodes, joined where one ends and the next starts.

    ``edges(gid, eid, src, dst, r)``; columns: gid, e1, e2, r1, r2. With neighbour
    lists of length k each edge meets about k others, so the result stays linear in
    the edges however many edges end at one site. Where edges carry ``n_src`` and
    ``n_dst``, ``n_paths`` says how many pairs of site edges the row stands for: choices
    of a first site, of the site between, and of a last one.
    """
    if {"n_src", "n_dst"} <= set(edges.columns):
        first = edges.select("gid", F.col("eid").alias("e1"), F.col("dst").alias("via"), F.col("r").alias("r1"),
                             F.col("n_src").alias("_a"), F.col("n_dst").alias("_b"))
        second = edges.select("gid", F.col("eid").alias("e2"), F.col("src").alias("via"), F.col("r").alias("r2"), F.col("n_dst").alias("_c"))
        return first.join(second, ["gid", "via"]).withColumn("n_paths", F.col("_a") * F.col("_b") * F.col("_c")).drop("via", "_a", "_b", "_c")
    first = edges.select("gid", F.col("eid").alias("e1"), F.col("dst").alias("via"), F.col("r").alias("r1"))
    second = edges.select("gid", F.col("eid").alias("e2"), F.col("src").alias("via"), F.col("r").alias("r2"))
    return first.join(second, ["gid", "via"]).drop("via")


def bond_cosine(lines: DataFrame) -> DataFrame:
    """Cosine of the angle between two consecutive bonds at their shared site, within [-1, 1]."""
    back = F.transform("r1", lambda v: -v)
    cos = F.try_divide(dot3(back, F.col("r2")), norm3(F.col("r1")) * norm3(F.col("r2")))
    return lines.withColumn("cos", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))
