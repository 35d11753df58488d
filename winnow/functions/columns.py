"""Row-level column expressions: all JVM-side, none of them shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(col: Column | str) -> Column:
    """The value, or null where it is NaN or infinite."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def log10_target(col: Column | str) -> Column:
    return F.log10(col)


def pow10(col: Column | str) -> Column:
    return F.pow(F.lit(10.0), col)


def per_unit(total: Column | str, n: Column | str) -> Column:
    total = F.col(total) if isinstance(total, str) else total
    n = F.col(n) if isinstance(n, str) else n
    """``total`` per unit; null where there is no unit."""
    return F.try_divide(total, n)


def percent_change(value: Column, reference: Column) -> Column:
    """|value - reference| / |reference|, null where the reference is zero."""
    return F.abs(F.try_divide(value - reference, reference))


def distinct_members(arr: Column | str) -> Column:
    """Sorted distinct members of an array."""
    return F.array_sort(F.array_distinct(arr))


def wrap_unit_cell(coords: Column | str) -> Column:
    """Fractional coordinates (array of points) moved into [0, 1)."""
    return F.transform(coords, lambda point: F.transform(point, wrap01))


def wrap01(x: Column) -> Column:
    return x - F.floor(x)


def dot3(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm3(a: Column) -> Column:
    return F.sqrt(dot3(a, a))


def cross3(a: Column, b: Column) -> Column:
    return F.array(
        a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]
    )


def cell_volume(lattice: Column | str) -> Column:
    """|det| of a 3 x 3 lattice given as array of row vectors."""
    m = F.col(lattice) if isinstance(lattice, str) else lattice
    return F.abs(dot3(m[0], cross3(m[1], m[2])))


def cartesian(frac: Column, lattice: Column) -> Column:
    """Fractional point times lattice rows."""
    return F.array(
        *[frac[0] * lattice[0][k] + frac[1] * lattice[1][k] + frac[2] * lattice[2][k] for k in range(3)]
    )


def squared_error(pred: Column, y: Column) -> Column:
    return (pred - y) * (pred - y)


def poisson_nll(pred: Column, y: Column, eps: float = 1e-8) -> Column:
    """Poisson negative log likelihood of a plain (not log) rate, with Stirling's term for y > 1."""
    stirling = F.when(y > 1, y * F.ln(y) - y + 0.5 * F.ln(2 * F.pi() * y)).otherwise(F.lit(0.0))
    return pred - y * F.ln(pred + F.lit(eps)) + stirling
