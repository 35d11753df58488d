"""Composition tables: ``bag(id, member, amount)`` with properties per member."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.session import materialise, small_side

#: fixed values: total energy per atom of the pure elements
PURE_ENERGY = {
    "Al": -3.74798896,
    "Fe": -8.23919192,
    "Si": -5.425396365,
    "Ni": -5.46770387,
    "Cu": -3.73300732,
    "Mn": -8.97873597827586,
    "Co": -7.036824315,
    "Cr": -9.48494376,
}
#: fixed value: Boltzmann constant in eV/K
K_B = 8.617333262e-5
#: fixed values: orders of the stoichiometry norms
NORMS = (0, 2, 3, 5, 7, 10)


def member_counts(df: DataFrame, members: str, id_col: str = "id") -> DataFrame:
    """Occurrences of each member of an array column: id, member, amount."""
    return (
        df.select(id_col, F.explode(members).alias("member"))
        .groupBy(id_col, "member").agg(F.count(F.lit(1)).cast("double").alias("amount"))
    )


def _merged(bag: DataFrame, id_col: str) -> DataFrame:
    """One row per (id, member); combined on the map side, so a hot id shrinks first."""
    return bag.groupBy(id_col, "member").agg(F.sum("amount").alias("amount"))


def fractions(bag: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per (id, member) with ``frac``, its share of the id's total amount.

    Totals are an aggregate joined back rather than a window, so an id with very many
    members is never gathered in one task.
    """
    merged = _merged(bag, id_col)
    totals = merged.groupBy(id_col).agg(F.sum("amount").alias("_total"))
    return merged.join(totals, id_col).withColumn("frac", F.try_divide("amount", "_total")).drop("_total")


def composition_features(
    bag: DataFrame, props: DataFrame, properties: Sequence[str], norms: Sequence[int] = NORMS, id_col: str = "id"
) -> DataFrame:
    """Stoichiometry norms and property statistics per composition.

    ``norm_p`` is (sum frac^p)^(1/p), with ``norm_0`` the number of members. For each
    property: min, max, range, mean (weighted), avg_dev (weighted mean absolute
    deviation) and mode (smallest value among the most abundant members). A member
    without a property value makes that property's statistics null.
    """
    known = materialise(props.select("member", *properties))
    rows = _merged(bag, id_col).join(small_side(known, 32 + 8 * len(properties)), "member", "left")
    total = F.sum("amount")
    per_id = rows.groupBy(id_col).agg(
        total.alias("_total"), F.max("amount").alias("_top"),
        *[F.try_divide(F.sum(F.col("amount") * F.col(p)), total).alias(f"_mean_{p}") for p in properties],
    )
    shares = rows.join(per_id, id_col).withColumn("frac", F.try_divide("amount", "_total"))
    aggs: list[Column] = []
    for p in norms:
        norm = F.count_if(F.col("frac") > 0).cast("double") if p == 0 else F.pow(F.sum(F.pow("frac", F.lit(float(p)))), F.lit(1.0 / p))
        aggs.append(norm.alias(f"norm_{p}"))
    for p in properties:
        complete = F.count(p) == F.count(F.lit(1))
        stats = {
            "min": F.min(p),
            "max": F.max(p),
            "range": F.max(p) - F.min(p),
            "mean": F.sum(F.col("frac") * F.col(p)),
            "avg_dev": F.sum(F.col("frac") * F.abs(F.col(p) - F.col(f"_mean_{p}"))),
            "mode": F.min(F.when(F.col("amount") == F.col("_top"), F.col(p))),
        }
        aggs += [F.when(complete, value).alias(f"{p}_{name}") for name, value in stats.items()]
    return shares.groupBy(id_col).agg(*aggs)


def pure_energies(df: DataFrame) -> DataFrame:
    """The fixed pure-element energies as (member, reference)."""
    return df.sparkSession.createDataFrame(list(PURE_ENERGY.items()), "member string, reference double")


def references_from_pure(values: DataFrame, bag: DataFrame, value: str, id_col: str = "id", position: str | None = None) -> DataFrame:
    """Reference per member from the rows made of that member alone; the last by ``position`` (default: the id) wins."""
    single = (
        bag.groupBy(id_col).agg(F.min("member").alias("member"), F.max("member").alias("_other"))
        .filter(F.col("member") == F.col("_other")).drop("_other")
    )
    rows = values.select(id_col, F.col(value).alias("_value"), F.col(position or id_col).alias("_position"))
    return single.join(rows, id_col).groupBy("member").agg(F.max_by("_value", "_position").alias("reference"))


def reference_subtracted(
    values: DataFrame, bag: DataFrame, value: str, references: DataFrame | None = None, reset: bool = False,
    id_col: str = "id", name: str = "ef", position: str | None = None,
) -> DataFrame:
    """Per-unit value minus the weighted references of the row's members.

    ``reset`` takes the references from single-member rows, otherwise they are given
    or the fixed pure-element energies. A member without reference is an error.
    """
    if reset:
        references = references_from_pure(values, bag, value, id_col, position)
    elif references is None:
        references = pure_energies(values)
    found = fractions(bag, id_col).join(small_side(materialise(references)), "member", "left")
    missing = F.raise_error(F.concat(F.lit("no reference for member "), F.col("member")))
    known = F.when(F.col("reference").isNull(), missing.cast("double")).otherwise(F.col("reference"))
    base = found.groupBy(id_col).agg(F.sum(F.col("frac") * known).alias("_base"))
    return values.join(base, id_col).withColumn(name, F.col(value) - F.col("_base")).drop("_base")


def enumerate_systems(members: DataFrame, kmax: int = 5, col: str = "member") -> DataFrame:
    """Every combination of 1..kmax distinct members: system (sorted, joined by ``-``), k.

    Each level joins the one before with the members that follow its last one, so the
    work follows the result, which is what the caller asked for.
    """
    names = materialise(members.select(F.col(col).alias("_next")).dropna().distinct())
    level = names.select(F.col("_next").alias("system"), F.col("_next").alias("_last"))
    out = level.select("system", F.lit(1).alias("k"))
    for k in range(2, kmax + 1):
        level = level.join(names, F.col("_last") < F.col("_next")).select(
            F.concat_ws("-", "system", "_next").alias("system"), F.col("_next").alias("_last")
        )
        out = out.unionByName(level.select("system", F.lit(k).alias("k")))
    return out


def system_sizes(systems: DataFrame) -> DataFrame:
    return systems.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def system_of(bag: DataFrame, id_col: str = "id") -> DataFrame:
    """The system each row belongs to: id, system, k."""
    members = F.array_sort(F.collect_set("member"))
    return bag.groupBy(id_col).agg(F.array_join(members, "-").alias("system"), F.size(members).alias("k"))


def configurational_entropy(bag: DataFrame, id_col: str = "id") -> DataFrame:
    """S = -sum(c ln c) over member fractions: id, entropy."""
    c = F.col("frac")
    return fractions(bag, id_col).groupBy(id_col).agg(F.sum(-c * F.ln(c)).alias("entropy"))


def transition_score(hull: DataFrame, bag: DataFrame, e_above: str = "e_above_hull", id_col: str = "id") -> DataFrame:
    """e_above_hull / (kB * S); null for single-member rows, whose entropy is zero."""
    scored = hull.join(configurational_entropy(bag, id_col), id_col)
    entropy = F.when(F.col("entropy") > 1e-12, F.col("entropy"))
    return scored.withColumn("transition_t", F.try_divide(F.col(e_above), F.lit(K_B) * entropy))


def _lower_hull(points: Iterator[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the lower convex hull of points that come sorted by x, each x once."""
    corners: list[tuple[float, float]] = []
    for x, e in points:
        while len(corners) >= 2:
            (xa, ea), (xb, eb) = corners[-2], corners[-1]
            if (eb - ea) * (x - xa) < (e - ea) * (xb - xa):
                break
            corners.pop()
        corners.append((x, e))
    return corners


def _sorted_hull(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hull corners per group of a stream sorted by (group, x); holds one group's corners only."""
    key, corners = None, []

    def emit():
        names, parts = key
        return pd.DataFrame(
            {"system": names, "part": parts, "x": [c[0] for c in corners], "e": [c[1] for c in corners]}
        )

    for pdf in frames:
        for (system, part), rows in pdf.groupby(["system", "part"], sort=False):
            if key is not None and (system, part) != key:
                yield emit()
                corners = []
            key = (system, part)
            corners = _lower_hull([*corners, *zip(rows["x"], rows["e"])])
    if key is not None:
        yield emit()


#: x slices per level of the hull; each level works on what the finer one kept
HULL_SLICES = (4096, 64, 1)
#: points that are few enough for one sorted stream per system
HULL_DIRECT = 1_000_000


def lower_hull(points: DataFrame, slices: Sequence[int] | None = None) -> DataFrame:
    """Corners of the lower convex hull of each system: system, x, e.

    A corner of a system is a corner of its own x slice, so slices are reduced in
    parallel first and the next, wider slices see only their corners. Each task reads
    its slice as a sorted stream and keeps the corners alone, so a system holding a
    third of the rows is spread over all slices. Few distinct points skip the finer
    levels.
    """
    level = materialise(points.groupBy("system", "x").agg(F.min("e").alias("e")))
    if slices is None:
        slices = HULL_SLICES if level.count() > HULL_DIRECT else (1,)
    for n in slices:
        part = F.floor(F.col("x") * n).cast("long")
        if n == 1:
            part = F.lit(0).cast("long")
        level = (
            level.withColumn("part", part).repartition("system", "part")
            .sortWithinPartitions("system", "part", "x")
            .select("system", "part", "x", "e")
            .mapInPandas(_sorted_hull, "system string, part long, x double, e double")
            .drop("part")
        )
    return level


def energy_above_hull(points: DataFrame, terminals: DataFrame | None = None, slices: int = 64) -> DataFrame:
    """Distance of each two-member point above its system's lower hull.

    ``points(id, system, x, e)`` with x in [0, 1]; ``terminals(system, x, e)`` are the
    pure references. Hull edges are keyed by the x slices they span, so a point meets
    the edges of its own slice only. Adds ``e_hull`` and ``e_above_hull``.
    """
    own = points.select("system", "x", "e")
    corners = materialise(lower_hull(own.unionByName(terminals.select("system", "x", "e")) if terminals is not None else own))
    along = Window.partitionBy("system").orderBy("x")
    edges = corners.select(
        "system", F.col("x").alias("xa"), F.col("e").alias("ea"),
        F.lead("x").over(along).alias("xb"), F.lead("e").over(along).alias("eb"), F.lag("x").over(along).alias("_prev"),
    ).filter(F.col("xb").isNotNull() | F.col("_prev").isNull())
    at = lambda c: F.floor(c * F.lit(slices)).cast("int")
    spread = edges.withColumn("slice", F.explode(F.sequence(at(F.col("xa")), at(F.coalesce("xb", "xa"))))).drop("_prev")
    distinct = own.select("system", "x").distinct().withColumn("slice", at(F.col("x")))
    span = F.col("xb") - F.col("xa")
    line = F.coalesce(F.col("ea") + (F.col("eb") - F.col("ea")) * F.try_divide(F.col("x") - F.col("xa"), span), F.col("ea"))
    inside = (F.col("x") >= F.col("xa")) & (F.col("x") <= F.coalesce("xb", "xa"))
    hull = (
        distinct.join(spread, ["system", "slice"]).filter(inside)
        .groupBy("system", "x").agg(F.min(line).alias("e_hull"))
    )
    return points.join(hull, ["system", "x"]).withColumn(
        "e_above_hull", F.greatest(F.col("e") - F.col("e_hull"), F.lit(0.0))
    )
