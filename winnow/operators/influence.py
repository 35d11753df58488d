"""Deletion diagnostics of least-squares models, without refits.

Leaving rows out changes five sums, so the model without any given row follows from
one pass. The full table of effects (every removed row on every observed row) grows
with the square of the data; it is offered for given pairs, and exactly summed up for
every removed row, but never written out.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.columns import percent_change
from winnow.operators.affinity import with_leaf_sums
from winnow.operators.rank import global_cumsum


@dataclass(frozen=True)
class _Fit:
    """Least squares about the table's means, minus some rows."""

    n: float
    x0: float
    y0: float
    sxx: float
    sxy: float

    @classmethod
    def of(cls, df: DataFrame, x: str, y: str) -> "_Fit":
        n, x0, y0, vx, cxy = df.agg(
            F.count(F.lit(1)), F.avg(x), F.avg(y), F.var_pop(x), F.covar_pop(x, y)
        ).first()
        return cls(float(n), x0, y0, vx * n, cxy * n)

    def without(self, *rows: tuple[Column, Column]) -> tuple[Column, Column]:
        """(slope, intercept) after leaving out ``rows`` given as (x, y) columns."""
        dx = [x - F.lit(self.x0) for x, _ in rows]
        dy = [y - F.lit(self.y0) for _, y in rows]
        left = self.n - len(rows)
        sx, sy = -sum(dx[1:], dx[0]), -sum(dy[1:], dy[0])
        sxx = F.lit(self.sxx) - sum([a * a for a in dx[1:]], dx[0] * dx[0]) - sx * sx / left
        sxy = F.lit(self.sxy) - sum([a * b for a, b in zip(dx[1:], dy[1:])], dx[0] * dy[0]) - sx * sy / left
        slope = F.try_divide(sxy, sxx)
        intercept = F.lit(self.y0) + sy / left - slope * (F.lit(self.x0) + sx / left)
        return slope, intercept

    @property
    def line(self) -> tuple[Column, Column]:
        slope = self.sxy / self.sxx
        return F.lit(slope), F.lit(self.y0 - slope * self.x0)


def _target(df: DataFrame, y: str, log_target: bool) -> DataFrame:
    return df.withColumn(y, F.log10(y)) if log_target else df


def deletion_models(df: DataFrame, x: str, y: str = "y", id_col: str = "id") -> DataFrame:
    """For each row the slope and intercept of the model fitted without it."""
    fit = _Fit.of(df, x, y)
    slope, intercept = fit.without((F.col(x), F.col(y)))
    return df.select(id_col, x, y, slope.alias("slope"), intercept.alias("intercept"))


def deletion_influence(df: DataFrame, x: str, y: str = "y", id_col: str = "id") -> DataFrame:
    """Effect of removing each row, over all observed rows.

    Columns: id, self_abs and self_pct (effect on its own prediction), max_abs and
    mean_abs (absolute change of the prediction), mean_pct (relative change).

    The change da + db*x is linear in x, so its sign flips at one x only; sums of
    absolute values are running sums of the observed rows read at that point. One
    global sort of observed rows and flip points replaces N*N comparisons.
    """
    fit = _Fit.of(df, x, y)
    slope, intercept = fit.line
    observed = df.groupBy(F.col(x).alias("x")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    weight = F.try_divide(F.lit(1.0), F.abs(intercept + slope * F.col("x")))
    low, high = df.agg(F.min(x), F.max(x)).first()

    slope_i, intercept_i = fit.without((F.col(x), F.col(y)))
    flips = (
        df.select(id_col, F.col(x).alias("own_x"), (intercept_i - intercept).alias("da"), (slope_i - slope).alias("db"))
        .withColumn("x", F.try_divide(-F.col("da"), F.col("db")))
        # no flip: one side holds every observed row
        .withColumn("x", F.coalesce("x", F.lit(high)))
    )
    both = observed.withColumn("kind", F.lit(0)).unionByName(
        flips.withColumn("kind", F.lit(1)), allowMissingColumns=True
    )
    c, w = F.coalesce("c", F.lit(0.0)), F.coalesce(weight, F.lit(0.0))
    sums = {
        "n_l": c, "x_l": c * F.col("x"), "w_l": c * w, "wx_l": c * w * F.col("x"),
    }
    placed = global_cumsum(both, ["x", "kind", id_col], sums).filter("kind = 1")
    n, sx, sw, swx = observed.agg(
        F.sum("c"), F.sum(F.col("c") * F.col("x")), F.sum(F.col("c") * weight), F.sum(F.col("c") * weight * F.col("x"))
    ).first()
    da, db = F.col("da"), F.col("db")

    def both_sides(left0, left1, all0, all1):
        return F.abs(da * left0 + db * left1) + F.abs(da * (F.lit(all0) - left0) + db * (F.lit(all1) - left1))

    own = da + db * F.col("own_x")
    own_ref = intercept + slope * F.col("own_x")
    return placed.select(
        id_col,
        F.abs(own).alias("self_abs"),
        F.abs(F.try_divide(own, own_ref)).alias("self_pct"),
        F.greatest(F.abs(da + db * F.lit(low)), F.abs(da + db * F.lit(high))).alias("max_abs"),
        (both_sides(F.col("n_l"), F.col("x_l"), n, sx) / n).alias("mean_abs"),
        (both_sides(F.col("w_l"), F.col("wx_l"), sw, swx) / n).alias("mean_pct"),
    )


#: half a block's width in natural units of the largest change of slope, and the error bound of its series
_HALF, _TOLERANCE = 1.0, 1e-13


def _terms(reach: float) -> int:
    """Terms of exp's series about 0 that leave out less than ``_TOLERANCE`` of it up to ``reach``."""
    k, left = 1, reach * math.exp(reach)
    while left > _TOLERANCE:
        k += 1
        left *= reach / k
    return k


def deletion_influence_log(df: DataFrame, x: str, y: str = "y", id_col: str = "id") -> DataFrame:
    """As ``deletion_influence`` for a model of log10(y), whose predictions are 10^(a + b x).

    Columns: id, self_abs and self_pct, mean_abs and mean_pct over all observed rows. Rows without x, or without a positive
    y, take no part.

    Without row i the prediction at x is the full one times 10^(da + db x). The change has one sign on either side of
    one x, but the sums of powers to either side depend on db, so no running sum gives them. Observed x are cut
    into blocks so narrow that |db| ln 10 times half a width stays below ``_HALF``; in a block the power is a series in
    (x - middle), so moments about the middle, summed once for all rows, give the sum for any db. The terms
    kept leave out at most ``_TOLERANCE`` of it. A row reads whole blocks from a small table (one entry
    per block) and the moments up to its flip point from one global running sum.
    """
    base = _target(df, y, True).where(F.col(y).isNotNull() & F.col(x).isNotNull())
    fit = _Fit.of(base, x, y)
    slope, intercept = fit.line
    slope_i, intercept_i = fit.without((F.col(x), F.col(y)))
    ln10 = math.log(10.0)
    # change of the exponent at x: alpha + beta * x, in natural units
    rows = base.select(F.col(id_col), F.col(x).alias("own_x"), (F.lit(ln10) * (intercept_i - intercept)).alias("alpha"), (F.lit(ln10) * (slope_i - slope)).alias("beta"))
    low, high = base.agg(F.min(x), F.max(x)).first()
    (steepest,) = rows.agg(F.max(F.abs("beta"))).first()
    width = (high - low) or 1.0
    blocks = max(1, math.ceil((steepest or 0.0) * width / 2 / _HALF))
    step = width / blocks
    terms = _terms((steepest or 0.0) * step / 2)

    def block(value: Column) -> Column:
        return F.greatest(F.least(F.floor((value - F.lit(low)) / F.lit(step)), F.lit(blocks - 1)), F.lit(0)).cast("int")

    observed = base.groupBy(F.col(x).alias("x")).agg(F.count(F.lit(1)).cast("double").alias("c")).withColumn("b", block(F.col("x")))
    off = F.col("x") - (F.lit(low) + (F.col("b") + 0.5) * F.lit(step))
    weights = {"w": F.coalesce("c", F.lit(0.0)) * F.pow(F.lit(10.0), intercept + slope * F.col("x")), "c": F.coalesce("c", F.lit(0.0))}
    moments = {f"{n}{k}": w * F.pow(off, F.lit(float(k))) for n, w in weights.items() for k in range(terms + 1)}

    found = {r["b"]: r for r in observed.groupBy("b").agg(*[F.sum(m).alias(n) for n, m in moments.items()]).collect()}
    table, before = [], dict.fromkeys(moments, 0.0)
    for b in range(blocks):
        here = {n: found[b][n] if b in found else 0.0 for n in moments}
        table.append({"x0": low + (b + 0.5) * step} | {f"{p}{n}": [v[f"{n}{k}"] for k in range(terms + 1)] for n in weights for p, v in (("", here), ("before_", before))})
        before = {n: before[n] + here[n] for n in moments}
    (total,) = observed.agg(F.sum("c")).first()
    fields = ", ".join(["x0: double", *(f"{p}{n}: array<double>" for n in weights for p in ("", "before_"))])
    literal = F.from_json(F.lit(json.dumps(table)), f"array<struct<{fields}>>")

    flips = rows.withColumn("x", F.coalesce(F.try_divide(-F.col("alpha"), F.col("beta")), F.lit(high))).withColumn("b", block(F.col("x")))
    both = observed.withColumn("kind", F.lit(0)).unionByName(flips.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    # a flip point is no observed row: its own count is null, so 0
    placed = global_cumsum(both, ["x", "kind", id_col], {f"run_{n}": m for n, m in moments.items()}).filter("kind = 1")
    placed = placed.withColumn("blocks", literal).withColumn("here", F.get("blocks", F.col("b")))

    def change(at: Column, moment) -> Column:
        """Sum of weight * (10^(change of the exponent) - 1) over rows near ``at`` with the given moments."""
        a = F.col("alpha") + F.col("beta") * at
        out, factor = F.expm1(a) * moment(0), F.lit(1.0)
        for k in range(1, terms + 1):
            factor = factor * F.col("beta") / F.lit(float(k))
            out = out + F.exp(a) * factor * moment(k)
        return out

    def mean(n: str) -> Column:
        own = lambda k: F.col(f"run_{n}{k}") - F.get(F.col("here")[f"before_{n}"], F.lit(k))
        rest = lambda k: F.get(F.col("here")[n], F.lit(k)) - own(k)
        left, right = change(F.col("here")["x0"], own), change(F.col("here")["x0"], rest)
        if blocks > 1:
            whole = lambda acc, t: acc + change(t["x0"], lambda k: F.get(t[n], F.lit(k)))
            left = left + F.aggregate(F.slice("blocks", F.lit(1), F.col("b")), F.lit(0.0), whole)
            right = right + F.aggregate(F.slice("blocks", F.col("b") + 2, F.lit(blocks)), F.lit(0.0), whole)
        return (F.abs(left) + F.abs(right)) / F.lit(total)

    own = F.abs(F.expm1(F.col("alpha") + F.col("beta") * F.col("own_x")))
    return placed.select(
        id_col, (own * F.pow(F.lit(10.0), intercept + slope * F.col("own_x"))).alias("self_abs"), own.alias("self_pct"),
        mean("w").alias("mean_abs"), mean("c").alias("mean_pct"),
    )


def influence_of_pairs(
    df: DataFrame, pairs: DataFrame, x: str, y: str = "y", id_col: str = "id",
    rm_self: bool = False, log_target: bool = False,
) -> DataFrame:
    """Effect of removing ``removed_id`` on the prediction at ``id``, for the given pairs.

    Without ``rm_self`` the reference is the model on all rows. With it, the model
    without i is compared with the model without i and j at j; a row paired with
    itself changes nothing. Columns: removed_id, id, abs_influ, pct_influ.
    """
    base = _target(df, y, log_target)
    fit = _Fit.of(base, x, y)
    removed = base.select(F.col(id_col).alias("removed_id"), F.col(x).alias("xi"), F.col(y).alias("yi"))
    seen = base.select(F.col(id_col).alias("id"), F.col(x).alias("xj"), F.col(y).alias("yj"))
    rows = pairs.select("removed_id", "id").join(removed, "removed_id").join(seen, "id")
    i, j = (F.col("xi"), F.col("yi")), (F.col("xj"), F.col("yj"))

    def predicted(line):
        value = line[1] + line[0] * F.col("xj")
        return F.pow(F.lit(10.0), value) if log_target else value

    if rm_self:
        reference = predicted(fit.without(i))
        same = F.col("removed_id") == F.col("id")
        changed = F.when(same, reference).otherwise(predicted(fit.without(i, j)))
    else:
        reference, changed = predicted(fit.line), predicted(fit.without(i))
    return rows.select(
        "removed_id", "id",
        F.abs(changed - reference).alias("abs_influ"),
        percent_change(changed, reference).alias("pct_influ"),
    )


def linear_influence(df: DataFrame, features: Sequence[str], y: str = "y", id_col: str = "id") -> DataFrame:
    """Effect of removing each row from a least-squares model of several features, without refits.

    Columns: id, self_abs (change of its own prediction), rms_abs (root of the mean squared
    change over all observed rows, itself included). One pass gives the Gram matrix about the
    means (features, not rows, decide its size); a removal is a rank-one update of it, so both
    follow from the row's leverage h and error e: the change at z is z' G^-1 x e / (1 - h).
    """
    leverage, error, n = leverage_and_error(df, features, y)
    change = F.try_divide(error, 1 - leverage)
    return df.select(
        id_col, F.abs(leverage * change).alias("self_abs"), (F.abs(change) * F.sqrt(leverage / F.lit(n))).alias("rms_abs")
    )


def linear_influence_of_pairs(df: DataFrame, pairs: DataFrame, features: Sequence[str], y: str = "y", id_col: str = "id") -> DataFrame:
    """Change of the prediction at ``id`` when ``removed_id`` is left out, for the given pairs: removed_id, id, abs_influ."""
    names = list(features)
    leverage, error, _ = leverage_and_error(df, names, y)
    inverse, means, n = _gram(df, names, y)[:3]
    centred = [F.col(c) - F.lit(means[c]) for c in names]
    pull = [sum((F.lit(float(inverse[i][j])) * centred[j] for j in range(len(names))), F.lit(0.0)) for i in range(len(names))]
    removed = df.select(F.col(id_col).alias("removed_id"), F.array(*pull).alias("_u"), F.try_divide(error, 1 - leverage).alias("_c"))
    seen = df.select(F.col(id_col).alias("id"), F.array(*centred).alias("_z"))
    rows = pairs.select("removed_id", "id").join(removed, "removed_id").join(seen, "id")
    dot = F.aggregate(F.zip_with("_u", "_z", lambda a, b: a * b), F.lit(1.0 / n), lambda a, b: a + b)
    return rows.select("removed_id", "id", F.abs(dot * F.col("_c")).alias("abs_influ"))


def _gram(df: DataFrame, names: Sequence[str], y: str):
    """Inverse of the centred Gram matrix, means, row count and coefficients."""
    pairs = [(a, b) for i, a in enumerate(names) for b in [*names[i:], y]]
    row = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{i}") for i, c in enumerate([*names, y])],
        *[F.covar_pop(a, b).alias(f"c_{i}") for i, (a, b) in enumerate(pairs)],
    ).first()
    n = float(row["n"])
    sums = {p: row[f"c_{i}"] * n for i, p in enumerate(pairs)}
    gram = np.array([[sums[(a, b)] if (a, b) in sums else sums[(b, a)] for b in names] for a in names])
    inverse = np.linalg.inv(gram)
    return inverse, {c: row[f"m_{i}"] for i, c in enumerate([*names, y])}, n, inverse @ np.array([sums[(a, y)] for a in names])


def leverage_and_error(df: DataFrame, features: Sequence[str], y: str) -> tuple[Column, Column, float]:
    """Leverage and error of each row under the model of all rows, and the row count."""
    names = list(features)
    inverse, means, n, slopes = _gram(df, names, y)
    centred = [F.col(c) - F.lit(means[c]) for c in names]
    square = F.lit(1.0 / n)
    fitted = F.lit(means[y])
    for i, a in enumerate(centred):
        fitted = fitted + F.lit(float(slopes[i])) * a
        for j, b in enumerate(centred):
            square = square + F.lit(float(inverse[i][j])) * a * b
    return square, fitted - F.col(y), n


def _leaf_rows(train: DataFrame, id_col: str, y: str) -> tuple[DataFrame, int, float]:
    """Per row ``stats``, the (rows, sum of the centred target) of its leaf in every tree; number of rows and mean target."""
    n, mean = train.agg(F.count(y), F.avg(y)).first()
    centred = train.where(F.col(y).isNotNull()).select(id_col, (F.col(y) - F.lit(mean or 0.0)).alias("t"), "leaves")
    return with_leaf_sums(centred, centred, "t"), n, mean or 0.0


def leaf_deletion_influence(train: DataFrame, id_col: str = "id", y: str = "y") -> DataFrame:
    """Effect of removing each row from a forest whose splits stay: id, self_abs, self_pct, mean_change.

    ``train`` has ``leaves``, the row's leaf in every tree; a tree predicts the mean target of the rows in a leaf, the
    forest the mean of its trees. Leaving a row out changes the means of its own leaves only, by (mean - y) / (rows - 1),
    so (rows, sum) per (tree, leaf) are all that is needed. ``self_*`` is the effect on the row's own prediction, ``mean_change`` the
    signed effect averaged over all rows. A leaf left empty predicts the mean of all other rows. Rows without a
    target take no part.
    """
    rows, n, mean = _leaf_rows(train, id_col, y)
    shifts = F.transform("stats", lambda s: _left_out(s, F.col("t"), n) - s["s"] / s["n"])
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    trees = F.size("stats")
    own = total(shifts) / trees
    reference = total(F.transform("stats", lambda s: s["s"] / s["n"])) / trees + F.lit(mean)
    everywhere = total(F.zip_with(shifts, "stats", lambda d, s: d * s["n"])) / trees / F.lit(float(n or 1))
    return rows.select(id_col, F.abs(own).alias("self_abs"), F.abs(F.try_divide(own, reference)).alias("self_pct"), everywhere.alias("mean_change"))


def _left_out(s: Column, t: Column, n: int) -> Column:
    """Centred mean of a leaf without one of its rows, whose centred target is ``t``."""
    return F.when(s["n"] > 1, (s["s"] - t) / (s["n"] - 1)).otherwise(-t / F.lit(float(max(n - 1, 1))))


def leaf_influence_of_pairs(train: DataFrame, pairs: DataFrame, id_col: str = "id", y: str = "y", rm_self: bool = False) -> DataFrame:
    """Change of the forest's prediction at ``id`` when ``removed_id`` is left out, for the given pairs, splits kept:
    removed_id, id, abs_influ, pct_influ.

    ``rm_self`` compares the forest without ``removed_id`` to the one without both; a row paired with itself changes nothing.
    """
    rows, n, mean = _leaf_rows(train, id_col, y)
    removed = rows.select(F.col(id_col).alias("removed_id"), F.col("leaves").alias("li"), F.col("t").alias("ti"))
    seen = rows.select(F.col(id_col).alias("id"), F.col("leaves").alias("lj"), F.col("t").alias("tj"), "stats")
    both = pairs.select("removed_id", "id").join(removed, "removed_id").join(seen, "id")

    def predicted(without: Column, s: Column, gone: Column, rows: int) -> Column:
        """Of a leaf that the ``without`` (rows n and sum t) leave; if none is left, the mean without ``rows`` of sum ``gone``."""
        left = s["n"] - without["n"]
        return F.when(left > 0, (s["s"] - without["t"]) / left).otherwise(-gone / F.lit(float(max(n - rows, 1))))

    def part(i: Column, t: Column) -> Column:
        return F.struct(i.cast("double").alias("n"), (i.cast("double") * t).alias("t"))

    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.size("stats") + F.lit(mean)
    place = F.sequence(F.lit(0), F.size("stats") - 1)
    same = lambda k: (F.get("li", k) == F.get("lj", k)).cast("int")
    other = F.col("removed_id") != F.col("id")
    without = total(F.transform(place, lambda k: predicted(part(same(k), F.col("ti")), F.get("stats", k), F.col("ti"), 1)))
    if rm_self:
        reference = without
        pair = lambda k: F.struct((1 + same(k)).cast("double").alias("n"), (F.col("tj") + same(k) * F.col("ti")).alias("t"))
        changed = F.when(other, total(F.transform(place, lambda k: predicted(pair(k), F.get("stats", k), F.col("ti") + F.col("tj"), 2)))).otherwise(reference)
    else:
        reference = total(F.transform("stats", lambda s: s["s"] / s["n"]))
        changed = without
    return both.select("removed_id", "id", F.abs(changed - reference).alias("abs_influ"), percent_change(changed, reference).alias("pct_influ"))
