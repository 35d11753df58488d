"""Exact ranks, cuts and top-k without a window over the whole table.

Two kinds of order occur. *Hash order* (every random draw) sorts by
``md5(seed:id)``: the k-th hash is found by counting hash prefixes, and the draw is
then a comparison of each row's hash with that one value. *Value order* (errors,
uncertainties, targets) finds the k-th row by narrowing a bracket of approximate
quantiles, and is again a comparison per row. Neither needs a join, and only one key
per cut reaches the driver. Where every row needs its own rank, a range-partitioned
sort plus per-partition offsets gives it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.session import materialise

#: rows a single task may sort to settle a cut exactly
SETTLE_ROWS = 500_000
#: the same for hashes, where one more counting pass is cheaper than sorting many texts
SETTLE_HASHES = 20_000
#: hex digits counted per pass: at most 16**3 = 4096 counts per prefix reach the driver
PREFIX_DIGITS = 3
#: above every hex digest, so that a cut of "all rows" compares true
AFTER_ALL = "g"


def hash_key(seed: int | str, id_col: str = "id") -> Column:
    """Sort key of a random draw; depends on seed and id only, not on partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))


def _count_prefixes(keyed: DataFrame, digits: int, inside: Sequence[str]) -> dict[str, int]:
    """Rows per hash prefix of ``digits`` digits, within the given shorter prefixes."""
    scope = keyed.filter(F.substring("h", 1, digits - PREFIX_DIGITS).isin(list(inside))) if inside else keyed
    return {r["p"]: r["count"] for r in scope.groupBy(F.substring("h", 1, digits).alias("p")).count().collect()}


#: a bracket of this many standard deviations of a rank around its expected place
_DEVIATIONS = 8.0


def _hash_at(share: float) -> str:
    """The hash below which ``share`` of all hashes lie, to 15 digits."""
    return AFTER_ALL if share >= 1 else f"{int(max(share, 0.0) * 16**15):015x}"


def _bracketed(keyed: DataFrame, k: int, total: int) -> str | None:
    """The k-th of ``total`` hashes from one pass, which counts those below a bracket and brings those inside; None if it is not among them.

    Hashes are uniform, so the k-th lies within a few deviations of k / total; the caller bounds how many that are.
    """
    spread = _DEVIATIONS * (k * (total - k) / total) ** 0.5 + 50
    low, high = _hash_at((k - spread) / total), _hash_at((k + spread) / total)
    inside = F.when((F.col("h") >= low) & (F.col("h") < high), F.col("h"))
    below, found = keyed.where(F.col("h") < high).agg(F.count_if(F.col("h") < low), F.sort_array(F.collect_list(inside))).first()
    return found[k - below - 1] if 0 < k - below <= len(found) else None


def cuts_for(
    df: DataFrame, seed: int | str, sizes_of: Callable[[int], Sequence[int]], id_col: str = "id", total: int | None = None
) -> tuple[list[str], list[int]]:
    """Cuts and sizes of a draw whose sizes depend on the row count, as ``sizes_of(n)``.

    For each size k the cut is the hash h_k such that exactly k rows have ``hash_key <=
    h_k``. Counts rows per hash prefix, which also gives n, extends only the prefixes
    that hold a cut until each holds at most ``SETTLE_HASHES`` rows, then ranks inside
    those. Hashes are uniform, so the prefixes stay balanced whatever the ids look like.
    ``total``, the row count where it is known, saves the counting pass on small tables.
    """
    keyed = df.select(hash_key(seed, id_col).alias("h"))
    digits = 0 if total is not None else PREFIX_DIGITS
    counts = {"": total} if total is not None else _count_prefixes(keyed, digits, [])
    n = sum(counts.values())
    sizes = list(sizes_of(n))
    cuts: list[str | None] = ["" if k <= 0 else AFTER_ALL if k >= n else None for k in sizes]
    # open targets: index -> (prefix holding the cut, rank inside that prefix)
    targets = {i: ("", k) for i, k in enumerate(sizes) if cuts[i] is None}
    if total is not None and len(targets) == 1 and SETTLE_HASHES < n and _DEVIATIONS * n**0.5 <= SETTLE_HASHES:
        ((i, (_, k)),) = targets.items()
        if (cut := _bracketed(keyed, k, n)) is not None:
            cuts[i] = cut
            return cuts, sizes
    while targets:
        ordered = sorted(counts)
        until = list(accumulate(counts[p] for p in ordered))
        for i, (prefix, left) in targets.items():
            at = bisect_left(ordered, prefix)
            before = until[at - 1] if at else 0
            place = bisect_left(until, before + left)
            targets[i] = (ordered[place], before + left - (until[place - 1] if place else 0))
        if all(counts[p] <= SETTLE_HASHES for p, _ in targets.values()):
            break
        digits += PREFIX_DIGITS
        counts = _count_prefixes(keyed, digits, sorted({p for p, _ in targets.values()}))
    if targets:
        wanted: dict[tuple[str, int], list[int]] = {}
        for i, place in targets.items():
            wanted.setdefault(place, []).append(i)
        by_prefix = Window.partitionBy("p").orderBy("h")
        hits = (
            keyed.withColumn("p", F.substring("h", 1, digits))
            .filter(F.col("p").isin(sorted({p for p, _ in wanted})))
            .withColumn("rank", F.row_number().over(by_prefix))
            .filter(F.concat_ws(":", "p", "rank").isin([f"{p}:{r}" for p, r in wanted]))
            .collect()
        )
        for row in hits:
            for i in wanted[(row["p"], row["rank"])]:
                cuts[i] = row["h"]
    return cuts, sizes


def hash_cuts(
    df: DataFrame, seed: int | str, sizes: Sequence[int], id_col: str = "id", total: int | None = None
) -> list[str]:
    """The cuts of a draw of given sizes."""
    return cuts_for(df, seed, lambda _n: sizes, id_col, total)[0]


@dataclass(frozen=True)
class Cut:
    """Key of the k-th row of an order; ``column()`` is true for the first k rows.

    A row without a value in the order comes after all others and is never among them.
    """

    order: tuple[str, ...]
    key: tuple | None
    everything: bool = False

    def column(self) -> Column:
        if self.everything:
            return reduce(lambda a, b: a & b, [F.expr(e).isNotNull() for e in self.order])
        if self.key is None:
            return F.lit(False)
        steps = []
        for i, (expr, value) in enumerate(zip(self.order, self.key)):
            last = i == len(self.order) - 1
            tied = [F.expr(e) == F.lit(v) for e, v in zip(self.order[:i], self.key[:i])]
            step = F.expr(expr) <= F.lit(value) if last else F.expr(expr) < F.lit(value)
            steps.append(reduce(lambda a, b: a & b, [*tied, step]))
        return F.coalesce(reduce(lambda a, b: a | b, steps), F.lit(False))


def first_k(df: DataFrame, order: Sequence[str], k: int, total: int | None = None) -> Cut:
    """Cut after the first ``k`` rows of ``df`` sorted ascending by the ``order`` expressions.

    Rows where an expression is null are left out, so the cut holds fewer than ``k`` rows
    where fewer have a value. ``total`` is the number of rows that have one, where it is known.

    ``order`` must identify rows (end it with the id). Narrows the scope to a bracket
    of approximate quantiles of the leading expression; a run of equal values is
    settled on the next expression, so heavy ties stay distributed.
    """
    order = tuple(order)
    if k <= 0:
        return Cut(order, None)
    names = [f"k{i}" for i in range(len(order))]
    scope = df.select(*[F.expr(e).alias(n) for e, n in zip(order, names)]).dropna("any")
    total = scope.count() if total is None else total
    if k >= total:
        return Cut(order, None, everything=True)
    fixed = 0
    while total > SETTLE_ROWS and fixed < len(names):
        name = names[fixed]
        if not isinstance(scope.schema[name].dataType, T.NumericType):
            break
        margin = 2 / 10_000
        share = k / total
        low, high = scope.agg(
            F.percentile_approx(name, [max(0.0, share - margin), min(1.0, share + margin)], 10_000).alias("q")
        ).first()["q"]
        below, inside = scope.agg(
            F.count_if(F.col(name) < F.lit(low)), F.count_if(F.col(name).between(low, high))
        ).first()
        if not below < k <= below + inside:
            break
        k -= below
        shrunk = inside < total
        scope, total = scope.filter(F.col(name).between(low, high)), inside
        if low == high:
            fixed += 1
        elif not shrunk:
            break
    if total <= SETTLE_ROWS:
        # k <= total <= SETTLE_ROWS: a bounded top-k, never a whole-table sort
        row = scope.orderBy(*names).limit(k).orderBy(*[F.desc(n) for n in names]).first()
    else:
        row = global_rank(scope, names, "r").filter(F.col("r") == k).select(*names).first()
    return Cut(order, tuple(row))


def bottom_k(df: DataFrame, value: str, k: int, id_col: str = "id") -> DataFrame:
    """The ``k`` rows with the smallest ``value``; ties go to the smaller id."""
    return df.filter(first_k(df, [value, id_col], k).column())


def top_k(df: DataFrame, value: str, k: int, id_col: str = "id") -> DataFrame:
    """The ``k`` rows with the largest ``value``; ties go to the smaller id."""
    return df.filter(first_k(df, [f"-{value}", id_col], k).column())


def drop_largest(df: DataFrame, value: str, threshold: float, m: int, id_col: str = "id") -> DataFrame:
    """Rows under ``threshold`` plus the ``m`` largest, each row once."""
    largest = first_k(df, [f"-{value}", id_col], m).column()
    return df.filter((F.col(value) < F.lit(threshold)) | largest)


def _range_sorted(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Globally sorted and materialised, with its partition number in ``_pid``."""
    return materialise(df.orderBy(*order)).withColumn("_pid", F.spark_partition_id())


def _offsets(parts: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Totals of every earlier partition; one row per partition, so small by nature."""
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_pid").agg(*[c.alias(n) for n, c in sums.items()])
    return totals.select(
        "_pid", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums]
    )


def global_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in the global ``order``.

    One range-partitioned sort; ``order`` should identify rows, which also lets the
    range partitioner split a run of tied values.
    """
    parts = _range_sorted(df, order)
    offsets = _offsets(parts, {"n": F.count(F.lit(1))})
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (
        parts.withColumn("_local", local)
        .join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_local") + F.col("_before_n"))
        .drop("_pid", "_local", "_before_n")
    )


def global_cumsum(
    df: DataFrame, order: Sequence[str | Column], sums: dict[str, Column]
) -> DataFrame:
    """Add inclusive running sums (``name -> summand``) along the global ``order``."""
    names = {n: f"_x{i}" for i, n in enumerate(sums)}
    parts = _range_sorted(df.select("*", *[sums[n].alias(x) for n, x in names.items()]), order)
    offsets = _offsets(parts, {x: F.sum(x) for x in names.values()})
    run = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        parts.join(F.broadcast(offsets), "_pid")
        .select(
            *df.columns,
            *[
                (F.coalesce(F.sum(x).over(run), F.lit(0)) + F.col(f"_before_{x}")).alias(n)
                for n, x in names.items()
            ],
        )
    )


def ensemble_interval(df: DataFrame, preds: str = "preds", percentile: float = 90.0) -> DataFrame:
    """Per row: lower and upper percentile over an array of predictions, and their distance.

    Linear interpolation between the two nearest members, computed on the row's own
    sorted array, so nothing is shuffled.
    """
    down = (100.0 - percentile) / 2.0

    def at(q: float) -> Column:
        pos = (F.size("_sorted") - 1) * F.lit(q / 100.0)
        i = F.floor(pos).cast("int")
        low = F.get("_sorted", i)
        high = F.coalesce(F.get("_sorted", i + 1), low)
        return low + (high - low) * (pos - i)

    return (
        df.withColumn("_sorted", F.array_sort(preds))
        .withColumn("lower", at(down))
        .withColumn("upper", at(100.0 - down))
        .withColumn("uncertainty", F.col("upper") - F.col("lower"))
        .drop("_sorted")
    )


def redundancy_ranking(membership: DataFrame, id_col: str = "id") -> DataFrame:
    """Rank ids from most to least informative.

    ``membership(id, iter_removed, err)`` has null ``iter_removed`` for kept rows.
    Kept rows come first, then the last removed, and the first removed come last;
    inside one iteration the larger error is the more informative.
    """
    order = [F.desc_nulls_first("iter_removed"), F.desc_nulls_first("err"), F.col(id_col)]
    return global_rank(membership, order, "rank")


def batch_rule(criterion: str):
    """Batch choice by name: ``max_err`` or ``min_err``."""
    rules = {"max_err": top_k, "min_err": bottom_k}
    if criterion not in rules:
        raise ValueError(f"criterion must be one of {sorted(rules)}, not {criterion!r}")
    return rules[criterion]
