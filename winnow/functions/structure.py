"""Structures as columns: ``struct<lattice, coords, elements>`` from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ATOMS = "struct<lattice_mat:array<array<double>>,coords:array<array<double>>,elements:array<string>>"


def parse_structure(text: Column | str) -> Column:
    """A dict literal or JSON text with lattice_mat, coords, elements; null when it does not parse."""
    text = F.col(text) if isinstance(text, str) else text
    # Python literals: single quotes and tuples
    json = F.translate(text, "'()", '"[]')
    parsed = F.from_json(json, ATOMS)
    whole = parsed["lattice_mat"].isNotNull() & parsed["coords"].isNotNull() & parsed["elements"].isNotNull()
    return F.when(
        whole,
        F.struct(
            parsed["lattice_mat"].alias("lattice"), parsed["coords"].alias("coords"), parsed["elements"].alias("elements")
        ),
    )


def _numbers(row: Column) -> Column:
    return F.transform(F.slice(row, 1, 3), lambda v: v.try_cast("double"))


def _det(m: Column) -> Column:
    a, b, c = m[0], m[1], m[2]
    return a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])


def _fractional(point: Column, m: Column, det: Column) -> Column:
    """``point`` in units of the rows of ``m``, by Cramer's rule."""
    def swapped(i: int) -> Column:
        return _det(F.array(*[point if j == i else m[j] for j in range(3)]))

    return F.array(*[F.try_divide(swapped(i), det) for i in range(3)])


def parse_poscar(text: Column | str) -> Column:
    """A POSCAR file's text as a structure with fractional coordinates; null when it does not parse.

    The scale multiplies the lattice; a negative one is the volume of the cell. A
    "Selective dynamics" line is passed over. Cartesian coordinates, scaled like the
    lattice, are converted.
    """
    text = F.col(text) if isinstance(text, str) else text
    lines = F.transform(F.split(text, r"\r?\n"), lambda line: F.split(F.trim(line), r"\s+"))
    raw = F.transform(F.slice(lines, 3, 3), _numbers)
    given = F.get(F.get(lines, F.lit(1)), F.lit(0)).try_cast("double")
    scale = F.when(given < 0, F.pow(F.try_divide(-given, F.abs(_det(raw))), F.lit(1 / 3))).otherwise(given)
    counts = F.transform(F.get(lines, F.lit(6)), lambda v: v.try_cast("int"))
    n = F.aggregate(counts, F.lit(0), lambda a, b: a + b)
    elements = F.flatten(F.transform(F.arrays_zip(F.get(lines, F.lit(5)).alias("el"), counts.alias("n")), lambda z: F.array_repeat(z["el"], z["n"])))
    first = F.lower(F.substring(F.get(F.get(lines, F.lit(7)), F.lit(0)), 1, 1))
    skip = F.when(first == "s", 1).otherwise(0)
    mode = F.lower(F.substring(F.get(F.get(lines, 7 + skip), F.lit(0)), 1, 1))
    points = F.transform(F.slice(lines, 9 + skip, F.greatest(n, F.lit(0))), _numbers)
    cartesian = mode.isin("c", "k")
    det = _det(raw)
    coords = F.when(cartesian, F.transform(points, lambda p: _fractional(p, raw, det))).otherwise(points)
    lattice = F.transform(raw, lambda row: F.transform(row, lambda v: v * scale))
    whole = (
        (F.size(raw) == 3) & F.forall(raw, lambda r: (F.size(r) == 3) & F.forall(r, lambda v: v.isNotNull())) & scale.isNotNull()
        & F.forall(counts, lambda c: c >= 0) & (F.size(points) == n) & F.forall(points, lambda p: (F.size(p) == 3) & F.forall(p, lambda v: v.isNotNull()))
    )
    return F.when(whole, F.struct(lattice.alias("lattice"), coords.alias("coords"), elements.alias("elements")))
