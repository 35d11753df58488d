"""Cleaning of id-keyed feature tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.columns import finite

#: fixed value: rows above this formation energy are removed
MAX_TARGET = 5.0
#: fixed value: target given to rows that only need a prediction
PLACEHOLDER = -9999.0


@dataclass(frozen=True)
class FeatureSpec:
    """Names the columns of a feature table; nothing is found by position."""

    id: str = "id"
    target: str = "y"
    groups: dict[str, list[str]] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [c for cols in self.groups.values() for c in cols]

    def select(self, df: DataFrame, *extra: str) -> DataFrame:
        return df.select(self.id, self.target, *extra, *self.features)


def inf_to_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in cols})


def require_target(df: DataFrame, target: str, target2transfer: str | None = None) -> DataFrame:
    """Keep rows whose target is present; with ``target2transfer`` that column decides instead."""
    return df.filter(F.col(target2transfer or target).isNotNull())


def any_null(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def drop_failed(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Drop rows with any null in a named feature group."""
    return df.dropna("any", subset=list(group))


def failed_report(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row: total, failed and successful rows of a feature group."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(any_null(group)).alias("failed"),
        F.count_if(~any_null(group)).alias("success"),
    )


def cap(df: DataFrame, col: str, maximum: float = MAX_TARGET) -> DataFrame:
    """Keep ``col <= maximum`` where the column exists; missing values go."""
    return df.filter(F.col(col) <= F.lit(maximum)) if col in df.columns else df


def standardise(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """z = (x - mean) / population sigma; nulls are ignored in the fit and kept; sigma 0 divides by 1.

    Fitted on the whole table unless ``fit_on`` names other rows. The two numbers per
    column travel as literals: bounded by the column count, no join.
    """
    stats = (fit_on if fit_on is not None else df).agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    scaled = {}
    for i, c in enumerate(cols):
        mean, sigma = stats[f"m{i}"], stats[f"s{i}"]
        if mean is not None:
            scaled[c] = (F.col(c) - F.lit(mean)) / F.lit(sigma if sigma else 1.0)
    return df.withColumns(scaled) if scaled else df


def dedupe(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row per key by ``order``.

    ``min_by`` over the whole row combines on the map side, so a key holding most of
    the table sends one candidate per task instead of its rows.
    """
    rest = [c for c in df.columns if c != key]
    row = F.struct(*rest)
    return (
        df.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("_row")).select(key, "_row.*").select(*df.columns)
    )


def with_placeholder_target(df: DataFrame, target: str, id_from: str | None = None, id_col: str = "id") -> DataFrame:
    """Constant target for rows to be predicted; optionally names the id column."""
    out = df.withColumn(target, F.lit(PLACEHOLDER))
    return out.withColumnRenamed(id_from, id_col) if id_from else out


def clean(
    df: DataFrame, spec: FeatureSpec, strict_group: str, target2transfer: str | None = None, capped: str | None = None
) -> DataFrame:
    """The standard chain: inf to null, target present, strict group complete, capped."""
    numeric = [spec.target, *([target2transfer] if target2transfer else []), *spec.features]
    out = inf_to_null(df, numeric)
    out = require_target(out, spec.target, target2transfer)
    out = drop_failed(out, spec.groups[strict_group])
    return cap(out, capped) if capped else out
