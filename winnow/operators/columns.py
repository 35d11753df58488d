"""Redundant columns: correlation matrix and greedy removal."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.operators.rank import global_cumsum
from winnow.session import materialise


def corr_pairs(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Absolute correlation of every pair of columns: col_a < col_b, r.

    Pearson is pairwise complete: each pair uses the rows where both are present. One
    pass; every task multiplies its batches into p x p partial sums (p columns, not
    rows), which are added up by pair. Values are centred first against cancellation.
    Spearman is pairwise complete too: columns without nulls are ranked once together,
    a pair with a null in it on the rows that have both.
    """
    cols = list(cols)
    if method == "spearman":
        return _spearman(df, cols)
    if method != "pearson":
        raise ValueError(f"unknown method: {method}")
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    centred = df.select(
        *[(F.col(c).cast("double") - F.lit(means[f"m{i}"] or 0.0)).alias(f"c{i}") for i, c in enumerate(cols)]
    )
    upper = np.triu_indices(len(cols), 1)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = None
        for pdf in frames:
            x = pdf.to_numpy(dtype=float, na_value=np.nan)
            seen = ~np.isnan(x)
            x = np.where(seen, x, 0.0)
            seen = seen.astype(float)
            sq = x * x
            now = [seen.T @ seen, x.T @ seen, seen.T @ x, sq.T @ seen, seen.T @ sq, x.T @ x]
            sums = now if sums is None else [a + b for a, b in zip(sums, now)]
        if sums is not None:
            yield pd.DataFrame(
                {"a": upper[0].astype("int32"), "b": upper[1].astype("int32"), **{m: s[upper] for m, s in zip(_SUMS, sums)}}
            )

    return _r_of_sums(centred.mapInPandas(partial, _SUM_SCHEMA), cols)


_SUMS = ["n", "sa", "sb", "saa", "sbb", "sab"]
_SUM_SCHEMA = "a int, b int, " + ", ".join(f"{c} double" for c in _SUMS)


def _r_of_sums(parts: DataFrame, cols: Sequence[str]) -> DataFrame:
    """|r| of every pair of columns from partial sums by pair."""
    total = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n = F.when(F.col("n") > 0, F.col("n"))  # two columns may never be present together
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va = F.col("saa") - F.col("sa") * F.col("sa") / n
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / n
    names = F.array(*[F.lit(c) for c in cols])
    first, second = F.get(names, "a"), F.get(names, "b")
    r = F.try_divide(cov, F.sqrt(va * vb))
    return total.select(
        F.least(first, second).alias("col_a"), F.greatest(first, second).alias("col_b"), F.abs(r).alias("r")
    )


def _spearman(df: DataFrame, cols: list[str]) -> DataFrame:
    holes = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first().asDict()
    holed = [c for c in cols if holes[c]]
    if holed:
        return _spearman_with_gaps(df, cols)
    rows = VectorAssembler(inputCols=cols, outputCol="v").transform(df).select("v")
    matrix = np.abs(Correlation.corr(rows, "v", "spearman").first()[0].toArray())
    pairs = [
        (*sorted((cols[i], cols[j])), float(matrix[i, j])) for i in range(len(cols)) for j in range(i + 1, len(cols))
    ]
    return df.sparkSession.createDataFrame(pairs, "col_a string, col_b string, r double")


def _spearman_with_gaps(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise complete rank correlations of columns with nulls, in a number of jobs that does not depend on the columns.

    For a pair (a, b) a value of a is ranked among the rows that have b too. Columns with the same gaps rank alike, so
    each value needs one rank per kind of gaps only. All columns are sorted as one run of (column, value); how many rows of
    each kind stand before a value are running sums of counts per distinct value, so ties are one row. A
    row then holds the ranks of its values, and every task adds up its products of ranks by pair.
    """
    p = len(cols)
    rows = materialise(df.select(F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in cols]).alias("v")).withColumn("_row", F.monotonically_increasing_id()))
    there = [F.get("v", F.lit(i)).isNotNull() for i in range(p)]
    mark = F.xxhash64("_row").cast("decimal(38,0)")
    seen = rows.agg(*[F.struct(F.count_if(t).alias("n"), F.sum(F.when(t, mark)).alias("s")).alias(f"k{i}") for i, t in enumerate(there)]).first()
    kinds: dict[tuple, int] = {}
    kind = [kinds.setdefault((r["n"], r["s"]), len(kinds)) for r in seen]
    firsts = [kind.index(g) for g in range(len(kinds))]

    present = F.array(*[there[i].cast("double") for i in firsts])
    loose = rows.select("_row", present.alias("g"), F.posexplode("v").alias("col", "value")).where(F.col("value").isNotNull())
    counts = loose.groupBy("col", "value").agg(*[F.sum(F.get("g", F.lit(j))).alias(f"c{j}") for j in range(len(kinds))])
    run = materialise(global_cumsum(counts, ["col", "value"], {f"r{j}": F.col(f"c{j}") for j in range(len(kinds))}))
    # the run goes over all columns: what stands before a column is taken off
    ends = {r["col"]: r for r in run.groupBy("col").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(len(kinds))]).collect()}
    before, total = [], [0.0] * len(kinds)
    for i in range(p):
        before.append(list(total))
        total = [t + (ends[i][f"c{j}"] if i in ends else 0.0) for j, t in enumerate(total)]
    start = F.array(*[F.array(*[F.lit(x) for x in b]) for b in before])
    rank = [F.col(f"r{j}") - F.get(F.get(start, "col"), F.lit(j)) - F.col(f"c{j}") + (F.col(f"c{j}") + 1) / 2 for j in range(len(kinds))]
    ranked = loose.select("_row", "col", "value").join(run.select("col", "value", F.array(*rank).alias("ranks")), ["col", "value"])
    ranked = ranked.groupBy("_row").agg(F.collect_list(F.struct("col", "ranks")).alias("all"))
    upper = np.triu_indices(p, 1)
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, p, p))
        some = False
        for batch in batches:
            lists = batch.column("all")
            flat, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
            row, col = np.repeat(np.arange(len(size)), size), flat.field("col").to_numpy()
            values = flat.field("ranks").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(kinds))
            for at in range(0, len(size), 512):  # rows at once, p x p numbers each
                inside = (row >= at) & (row < at + 512)
                held = np.full((min(512, len(size) - at), p, len(kinds)), np.nan)
                held[row[inside] - at, col[inside]] = values[inside]
                r = held[:, :, kind]  # rank of column a among rows with column b
                both = ~np.isnan(held[:, :, 0])
                both = both[:, :, None] & both[:, None, :]
                r = np.where(both, r, 0.0)
                t = r.transpose(0, 2, 1)
                sums += [both.sum(0), r.sum(0), t.sum(0), (r * r).sum(0), (t * t).sum(0), (r * t).sum(0)]
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), *(pa.array(s[upper]) for s in sums)], ["a", "b", *_SUMS])

    return _r_of_sums(ranked.select("all").mapInArrow(partial, _SUM_SCHEMA), cols)


def corr_column_stats(pairs: DataFrame, n_cols: int, cutoff: float) -> DataFrame:
    """Per column: how many others reach ``cutoff``, the largest and the mean |r| (own 0 included)."""
    both = pairs.select(F.col("col_a").alias("col"), "r").unionByName(pairs.select(F.col("col_b").alias("col"), "r"))
    return both.groupBy("col").agg(
        F.count_if(F.col("r") >= F.lit(cutoff)).alias("n_high"),
        F.max("r").alias("max_r"),
        # columns without a correlation to this one (constant, never present together) do not count
        (F.sum("r") / (F.count("r") + 1)).alias("mean_r"),
    )


def drop_correlated(
    df: DataFrame, cols: Sequence[str], cutoff: float = 0.6, method: str = "pearson",
    by: Sequence[str] = ("Count", "Max", "Mean"), digits: int = 12,
) -> tuple[list[str], list[str]]:
    """Greedy removal: while any column has |r| >= cutoff with a remaining one, drop the worst.

    "Worst" is the last by ``by`` over the remaining columns, then by name. Returns
    (kept, dropped in order). Only the p x p matrix reaches the driver: its size
    depends on the number of columns alone.
    """
    cols = list(cols)
    at = {c: i for i, c in enumerate(cols)}
    r = np.zeros((len(cols), len(cols)))
    for a, b, value in corr_pairs(df, cols, method).collect():
        r[at[a], at[b]] = r[at[b], at[a]] = np.nan if value is None else round(value, digits)
    dropped: list[str] = []
    left = list(range(len(cols)))
    while left:
        sub = r[np.ix_(left, left)]
        stats = {
            "Count": (sub >= cutoff).sum(axis=0), "Max": np.nanmax(sub, axis=0), "Mean": np.nanmean(sub, axis=0).round(digits),
        }
        worst = max(range(len(left)), key=lambda i: (*[stats[b][i] for b in by], cols[left[i]]))
        if stats["Count"][worst] == 0:
            break
        dropped.append(cols[left.pop(worst)])
    return [cols[i] for i in left], dropped
