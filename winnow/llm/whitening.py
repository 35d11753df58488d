"""Whitening of embeddings by an exact eigendecomposition.

Entries become integers, so the scatter matrix of the distinct vectors is an integer matrix and exact. Its
characteristic polynomial is found modulo many primes by Hessenberg reduction, a task per group of primes, and put together by the
Chinese remainder theorem. All roots are real, so the changes of sign of the shifted polynomial count the
roots above any number: bisection isolates them, to far more digits than a double has. The component of a root
spans the null space of the matrix less the root, found by inverse iteration in fixed-point integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.frames import written

#: entries become floor(STEPS * entry) + SHIFT; components returned
STEPS, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: bits after the binary point of roots, bits of fixed-point numbers, bits of a limb of a shuffled sum and their number
ROOT_BITS, POINT_BITS, LIMB, LIMBS = 64, 320, 32, 6
#: a 31-bit prime keeps products of two residues in 62 bits
PRIME_BITS = 31
_MASK = (1 << LIMB) - 1


def integers(vector: Column) -> Column:
    """The vector as longs; null where it is null or empty, or holds an entry that is null, not finite or beyond a long."""
    fits = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < 2.0**56))
    longs = F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS) + F.lit(SHIFT).cast("long"))
    return F.when(fits & (F.size(vector) > 0), longs)


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, d)


def _exact(a: np.ndarray, bound: int) -> np.ndarray:
    """``a`` as int64 if numbers up to ``bound`` fit, else as Python's unbounded integers."""
    return a if bound < 1 << 62 else a.astype(object)


def _limbs(value: int) -> list[int]:
    return [*((value >> LIMB * i) & _MASK for i in range(LIMBS - 1)), value >> LIMB * (LIMBS - 1)]


def summed(vectors: DataFrame, d: int, centre: list[int] | None) -> tuple[int, list[int], list[list[int]]]:
    """Number, sum and, around an integer ``centre``, sum of outer products of the ``x`` of ``vectors``, all exact.

    Each task adds up its rows and emits one row per entry of the sums, in limbs; the driver gets d or d^2 rows.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, outer = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                x = _matrix(batch.column("x").slice(i, 4096), d)
                most = max(abs(int(x.max())), abs(int(x.min())))
                if centre is not None:
                    x = _exact(x, most + max(map(abs, centre))) - np.array(centre, object if most + max(map(abs, centre)) >= 1 << 62 else np.int64)
                    most = max(abs(int(x.max())), abs(int(x.min())))
                    y = _exact(x, most * most * len(x))
                    outer += (y.T @ y).astype(object)
                n += len(x)
                total += _exact(x, most * len(x)).sum(0).astype(object)
        if not n:
            return
        entries = [(-1, 0, n), *((-2, j, int(v)) for j, v in enumerate(total))]
        if centre is not None:
            entries += [(i, j, int(outer[i, j])) for i in range(d) for j in range(i, d)]
        limbs = np.array([_limbs(v) for *_, v in entries], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([e[0] for e in entries], pa.int32()), pa.array([e[1] for e in entries], pa.int32()), *(pa.array(limbs[:, k]) for k in range(LIMBS))],
            ["i", "j", *(f"l{k}" for k in range(LIMBS))],
        )

    parts = vectors.select("x").mapInArrow(partial, "i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS)))
    sums = {}
    for r in parts.groupBy("i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS))).collect():
        sums[r["i"], r["j"]] = sum(r[f"l{k}"] << LIMB * k for k in range(LIMBS))
    outer = [[sums.get((min(i, j), max(i, j)), 0) for j in range(d)] for i in range(d)]
    return sums.get((-1, 0), 0), [sums.get((-2, j), 0) for j in range(d)], outer


def _is_prime(n: int) -> bool:
    """Miller and Rabin's test, with bases that settle every number of 32 bits."""
    if n % 2 == 0:
        return n == 2
    s = ((n - 1) & -(n - 1)).bit_length() - 1
    for a in (2, 7, 61):
        x = pow(a, (n - 1) >> s, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes of ``PRIME_BITS`` bits whose product has more than ``bits`` bits."""
    found, have, n = [], 0.0, (1 << PRIME_BITS) - 1
    while have <= bits + 1:
        if _is_prime(n):
            found.append(n)
            have += math.log2(n)
        n -= 2
    return found


def polynomial_mod(m: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(t I - m) modulo the prime p, the constant first, by reduction to Hessenberg form."""
    d = len(m)
    h = np.array([[v % p for v in row] for row in m], np.int64)
    for k in range(1, d - 1):
        rows = np.flatnonzero(h[k:, k - 1])
        if not len(rows):
            continue
        pivot = k + int(rows[0])
        if pivot != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        u = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - u[:, None] * h[k] % p) % p
        right = h[:, k + 1 :]  # by halves of u, so that sums of products stay in 64 bits
        h[:, k] = (h[:, k] + ((right @ (u >> 16) % p) << 16) + right @ (u & 0xFFFF)) % p
    polys = [np.array([1], np.int64)]
    for k in range(d):
        new = np.zeros(k + 2, np.int64)
        new[1:] = polys[k]
        new[:-1] = (new[:-1] - h[k, k] * polys[k]) % p
        below = 1
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            new[: i + 1] = (new[: i + 1] - below * int(h[i, k]) % p * polys[i]) % p
        polys.append(new % p)
    return [int(v) for v in polys[d]]


def characteristic(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """The coefficients of det(t I - m), constant first, of a symmetric integer matrix without negative roots.

    Coefficient d - k is at most C(d, k) (trace / d)^k, which bounds the primes needed; they are dealt to tasks.
    """
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    bits = max(math.log2(math.comb(d, k)) + k * math.log2(max(1.0, -(-trace // d))) for k in range(d + 1))
    chosen = primes(math.ceil(bits) + 2)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("p").to_pylist():
                yield pa.RecordBatch.from_pylist([{"p": p, "c": polynomial_mod(m, p)}])

    tasks = min(len(chosen), 4 * spark.sparkContext.defaultParallelism)
    found = spark.createDataFrame([(p,) for p in chosen], "p long").repartition(tasks).mapInArrow(reduced, "p long, c array<long>").collect()
    product = reduce(lambda a, r: a * r["p"], found, 1)
    parts = [(product // r["p"] * pow(product // r["p"], -1, r["p"]), r["c"]) for r in found]
    out = [sum(w * c[k] for w, c in parts) % product for k in range(d + 1)]
    return [v - product if v > product // 2 else v for v in out]


def _above(poly: list[int], at: int) -> int:
    """How many roots of a polynomial with real roots only are above ``at``: the sign changes of it shifted there."""
    c = list(poly)
    d = len(c) - 1
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _at(poly: list[int], x: int) -> int:
    return reduce(lambda total, c: total * x + c, reversed(poly), 0)


def largest_roots(poly: list[int], count: int) -> list[tuple[int, int]]:
    """The largest roots, falling, each with its multiplicity, until ``count`` are reached: (root * 2^ROOT_BITS, floored).

    Roots that agree in all these digits are one.
    """
    d = len(poly) - 1
    scaled = [c << ROOT_BITS * (d - k) for k, c in enumerate(poly)]
    top = 1 << (max(2, -poly[d - 1] + 2).bit_length() + ROOT_BITS) if d else 1  # roots add up to -poly[d - 1], none is negative
    out, found = [], 0
    todo = [(-1, top, d)]  # roots in (low, high]
    while todo and found < count:
        low, high, inside = todo.pop()
        if high - low == 1:
            out.append((high, inside))
            found += inside
        elif inside == 1:  # alone: the sign tells the side
            positive = _at(scaled, high) >= 0
            if _at(scaled, high) == 0:
                low = high - 1
            while high - low > 1:
                mid = (low + high) >> 1
                value = _at(scaled, mid)
                if value == 0:
                    low, high = mid - 1, mid
                elif (value > 0) == positive:
                    high = mid
                else:
                    low = mid
            out.append((high, 1))
            found += 1
        else:
            mid = (low + high) >> 1
            upper = _above(scaled, mid) - _above(scaled, high)
            if inside - upper:
                todo.append((low, mid, inside - upper))
            if upper:
                todo.append((mid, high, upper))
    return out


def null_space(m: list[list[int]], root: int, size: int) -> list[list[float]]:
    """``size`` orthogonal unit vectors that m (nearly) multiplies by root / 2^ROOT_BITS.

    Inverse iteration on fixed-point integers of ``POINT_BITS``: one elimination with row exchanges, then solves
    until a vector stands still; vectors of one root are made orthogonal to each other.
    """
    d, one = len(m), 1 << POINT_BITS
    a = [[(v << POINT_BITS) - ((root << (POINT_BITS - ROOT_BITS)) if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(m)]
    order = list(range(d))
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[best] = a[best], a[k]
        order[k], order[best] = order[best], order[k]
        if a[k][k] == 0:
            a[k][k] = 1  # the smallest number there is
        top, pivot = a[k], a[k][k]
        for row in a[k + 1 :]:
            if row[k]:
                row[k] = f = (row[k] << POINT_BITS) // pivot
                for j in range(k + 1, d):
                    row[j] -= f * top[j] >> POINT_BITS

    def unit(v: list[int]) -> list[int]:
        most = max(map(abs, v)) or 1
        v = [(x << POINT_BITS) // most for x in v]
        for other in done:
            dot = sum(x * y for x, y in zip(v, other)) >> POINT_BITS
            v = [x - (dot * y >> POINT_BITS) for x, y in zip(v, other)]
        length = math.isqrt(sum(x * x for x in v)) or 1
        return [(x << POINT_BITS) // length for x in v]

    done: list[list[int]] = []
    for s in range(size):
        v = unit([one // (1 + (i * (2 * s + 3) + s) % 17) for i in range(d)])
        for _ in range(40):
            z = [v[i] for i in order]
            for i in range(d):
                z[i] -= sum(a[i][j] * z[j] for j in range(i)) >> POINT_BITS
            for i in range(d - 1, -1, -1):
                z[i] = ((z[i] - (sum(a[i][j] * z[j] for j in range(i + 1, d)) >> POINT_BITS)) << POINT_BITS) // a[i][i]
            z = unit(z)
            if sum(x * y for x, y in zip(z, v)) < 0:
                z = [-x for x in z]
            moved = max(abs(x - y) for x, y in zip(z, v))
            v = z
            if moved < one >> 80:
                break
        done.append(v)
    return [[x / one for x in v] for v in done]


def components_of(spark: SparkSession, m: list[list[int]], count: int) -> tuple[list[float], np.ndarray]:
    """The largest eigenvalues of ``m``, falling, and their unit eigenvectors as rows; a task for each distinct root."""
    roots = largest_roots(characteristic(spark, m), count)

    def iterated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, root, size in zip(*(batch.column(c).to_pylist() for c in ("i", "root", "size"))):
                found = null_space(m, int(root), size)
                yield pa.RecordBatch.from_arrays([pa.array([i] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(found, pa.list_(pa.float64()))], ["i", "s", "v"])

    rows = spark.createDataFrame([(i, str(r), size) for i, (r, size) in enumerate(roots)], "i int, root string, size int")
    found = sorted(rows.repartitionById(len(roots), "i").mapInArrow(iterated, "i int, s int, v array<double>").collect(), key=lambda r: (r["i"], r["s"]))[:count]
    return [roots[r["i"]][0] / (1 << ROOT_BITS) for r in found], np.array([r["v"] for r in found])


def whiten(vectors: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), count: int = COMPONENTS) -> DataFrame:
    """For each vector and component 1 to ``count`` (fewer if vectors are shorter): ``keep``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Vectors that are null or hold null or non-finite entries are left out; so are those not of the most frequent length (the longer of equally
    frequent ones) and those with an entry of 2^56 or more, which has no long. Every distinct integer vector
    counts once in the fit, repeated rows are all returned. A component without variance has a null ``whitened``
    and is no part of ``identity_error``; without any variance ``explained`` is null too. A deviation beyond a long is null.
    """
    spark = vectors.sparkSession
    named = {c: f"kept_{i}" for i, c in enumerate(keep)}
    rows = vectors.select(*(F.col(c).alias(k) for c, k in named.items()), integers(F.col(vector)).alias("x")).where("x is not null")
    kinds = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    out = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in named.values()), "component int, n long, deviation long, whitened double, explained double, identity_error double"])
    final = lambda df: df.select(*(F.col(k).alias(c) for c, k in named.items()), "component", "n", "deviation", "whitened", "explained", "identity_error")
    if not kinds:
        return final(spark.createDataFrame([], out))
    d = kinds[0]["d"]
    rows = rows.where(F.size("x") == d)
    distinct = written(rows.select("x").distinct(), "vectors")

    n, total, _ = summed(distinct, d, None)
    centre = [(2 * s + n) // (2 * n) for s in total]
    _, rest, outer = summed(distinct, d, centre)  # rest: what the centre is off the mean, n times
    scatter = [[n * outer[i][j] - rest[i] * rest[j] for j in range(d)] for i in range(d)]  # n^2 times the covariance
    trace = sum(scatter[i][i] for i in range(d))
    if trace:
        values, directions = components_of(spark, scatter, min(count, d))
    else:
        values, directions = [0.0] * min(count, d), np.eye(d)[: min(count, d)]
    values = np.array(values) / n / n
    scale = np.divide(1.0, np.sqrt(values), out=np.full(len(values), np.nan), where=values > 0)
    explained = [float(v) * n * n / trace if trace else None for v in values]
    project = directions.T * scale

    def deviations(x: np.ndarray) -> np.ndarray:
        """n x - S, exact, around the centre."""
        far = max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, centre))
        y = _exact(x, far) - np.array(centre, object if far >= 1 << 62 else np.int64)
        bound = n * max(abs(int(y.max())), abs(int(y.min()))) + max(map(abs, rest))
        return _exact(y, bound) * n - np.array(rest, object if bound >= 1 << 62 else np.int64)

    def whitened_of(y: np.ndarray) -> np.ndarray:
        # Python's division of integers rounds once
        return (np.array([[v / n for v in row] for row in y], float) if y.dtype == object else y / n) @ project

    def covariance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        rows_seen, first, second = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                w = np.nan_to_num(whitened_of(deviations(_matrix(batch.column("x").slice(i, 4096), d))))
                rows_seen, first, second = rows_seen + len(w), first + w.sum(0), second + w.T @ w
        if rows_seen:
            flat = np.concatenate([first, second.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], ["i", "v"])

    k = len(values)
    sums = np.zeros(k + k * k)
    for r in distinct.mapInArrow(covariance, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums[r["i"]] = r["v"]
    mean = sums[:k] / n
    real = values > 0
    off = (sums[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k))[np.ix_(real, real)]
    error = float(np.abs(off).max()) if real.any() else None

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                y = deviations(_matrix(part.column("x"), d))
                bound = d * max(abs(int(y.max())), abs(int(y.min()))) ** 2
                squares = (_exact(y, bound) ** 2).sum(1)
                squares = [int(s) if s < 1 << 63 else None for s in squares]
                w = whitened_of(y).ravel()
                at = pa.array(np.repeat(np.arange(part.num_rows), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).take(at) for c in named.values()), pa.array(np.tile(np.arange(1, k + 1), part.num_rows), pa.int32()), pa.array(np.full(len(w), n)),
                        pa.array(squares, pa.int64()).take(at), pa.array(w, mask=np.isnan(w)), pa.array(explained * part.num_rows, pa.float64()), pa.array([error] * len(w), pa.float64()),
                    ],
                    [*named.values(), "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return final(rows.mapInArrow(projected, out))
