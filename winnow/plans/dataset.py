"""From a stored feature table to pool and test rows in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.operators.clean import FeatureSpec, clean, standardise
from winnow.operators.split import fixed_train_split, load_pruned, predefined_split, random_split


@dataclass
class Dataset:
    """``rows`` is the cleaned table with its ``split``; the parts drop that column."""

    rows: DataFrame

    def part(self, name: str) -> DataFrame:
        return self.rows.filter(F.col("split") == name).drop("split")

    @property
    def pool(self) -> DataFrame:
        return self.part("train")

    @property
    def test(self) -> DataFrame:
        return self.part("test")

    @property
    def val(self) -> DataFrame:
        return self.part("val")

    @property
    def fixed(self) -> DataFrame:
        return self.part("fixed")


def prepare(
    df: DataFrame,
    spec: FeatureSpec,
    strict_group: str,
    test_frac: float = 0.1,
    seed: int = 0,
    *,
    target2transfer: str | None = None,
    capped: str | None = None,
    standardised: bool = True,
    fit_on: str = "all",
    fixed_ids: DataFrame | None = None,
    assignment: DataFrame | None = None,
    ranking: DataFrame | None = None,
    pruned_frac: float = 0.3,
) -> Dataset:
    """Clean, standardise and split a feature table.

    The split is random; or random around ``fixed_ids`` that always train; or given as
    ``assignment(id, split)``. A redundancy ``ranking`` first keeps only the most
    informative ``pruned_frac`` of its ids. Standardising fits on all cleaned rows, or
    with ``fit_on="train"`` on the training rows alone.
    """
    if fit_on not in ("all", "train"):
        raise ValueError(f"fit_on must be all or train, not {fit_on!r}")
    rows = clean(df, spec, strict_group, target2transfer, capped)
    if standardised and fit_on == "all":
        rows = standardise(rows, spec.features)
    if ranking is not None:
        rows = load_pruned(rows, ranking, pruned_frac, spec.id)
    if fixed_ids is not None:
        rows = fixed_train_split(rows, fixed_ids, seed, test_frac, spec.id)
    elif assignment is not None:
        rows = predefined_split(rows, assignment, spec.id)
    else:
        rows = random_split(rows, seed, test_frac=test_frac, id_col=spec.id)
    if standardised and fit_on == "train":
        rows = standardise(rows, spec.features, rows.filter(F.col("split").isin("train", "fixed")))
    return Dataset(rows)
