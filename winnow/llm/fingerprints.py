"""Document fingerprints from closed syncmers of words. DataFrame functions only.

A run of four words is an anchor if the least of its three inner word pairs (by hash) is the
first or the last. Whether a run is one depends on nothing around it, so a passage keeps its
anchors wherever it stands. The fingerprint is all anchors with their positions. Two fingerprints
are matched by the anchors that both have and by the longest stretch of them that is shifted as one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: anchors kept in a fingerprint (None: all); words of an anchor
ANCHORS, WORDS = None, 4
#: bits of an anchor's number below its hash that hold its position
_PLACE = 1 << 24


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` refers to it inside lambdas."""
    return F.transform(F.array(value), use)[0]


def anchors(text: Column) -> Column:
    """Sorted longs (hash * 2^24 + word position) of all anchors, each hash once, where it is first.

    A text of one to three words has itself as its anchor, a text without words has none.
    """
    hashes = F.transform(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def number(h: Column, i: Column) -> Column:
        return F.pmod(h, F.lit(1 << 32)) * _PLACE + i

    def from_pairs(p: Column) -> Column:
        # p[i] stands for words i and i + 1; a run has pairs i, i + 1, i + 2
        runs = F.slice(p, 1, F.greatest(F.size(p) - (WORDS - 1), F.lit(0)))
        found = F.transform(
            runs, lambda a, i: F.when((F.get(p, i + 1) >= a) | (F.get(p, i + 1) >= F.get(p, i + 2)), number(F.xxhash64(a, F.get(p, i + 2)), i.cast("long")))
        )
        return F.sort_array(F.filter(found, lambda x: x.isNotNull()))

    def once(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 24) != F.shiftright(F.get(s, i - 1), 24)))

    def of_words(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)))
        long_text = _bound(_bound(pairs, from_pairs), once)
        short_text = F.filter(F.array(number(F.xxhash64(F.array_join(h.cast("array<string>"), " ")), F.lit(0).cast("long"))), lambda _: F.size(h) > 0)
        return F.when(F.size(h) >= WORDS, long_text).otherwise(short_text)

    return _bound(hashes, of_words)


def as_string(numbers: Column) -> Column:
    """Eight hex digits of the hash, a dot, and the word position, for each anchor."""
    return F.array_join(F.transform(numbers, lambda x: F.concat(F.lpad(F.lower(F.hex(F.floor(x / _PLACE))), 8, "0"), F.lit("."), F.lower(F.hex(x % _PLACE)))), " ")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: of the least hashes of both together, as many as the longer has, the share that both have. Two without anchors are alike."""
    def of(ha: Column, hb: Column) -> Column:
        least = F.slice(F.sort_array(F.array_union(ha, hb)), 1, F.greatest(F.size(ha), F.size(hb)))
        common = F.array_intersect(F.array_intersect(ha, hb), least)
        return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(F.size(common) / F.size(least))

    def hashes(x: Column) -> Column:
        return F.transform(x, lambda v: F.floor(v / _PLACE))

    return _bound(hashes(a), lambda ha: _bound(hashes(b), lambda hb: of(ha, hb)))


def matched(a: Column, b: Column) -> Column:
    """Struct of ``shared`` (anchors of both over anchors of either; 1 if neither has any) and ``stretch``: word runs
    from the first to the last anchor of the longest stretch of ``a`` that ``b`` has at one shift.

    Within a stretch each anchor begins at most ``WORDS`` words after the one before.
    """
    place = _PLACE - 1

    def side(x: Column, flag: int) -> Column:
        return F.transform(x, lambda v: F.shiftleft(F.shiftright(v, 24), 25) + flag * _PLACE + v.bitwiseAND(place))

    def meet(both: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            other = F.get(both, i + 1)
            shift = other.bitwiseAND(place) - x.bitwiseAND(place) + _PLACE
            return F.when(F.shiftright(x, 25) == F.shiftright(other, 25), F.shiftleft(shift, 24) + x.bitwiseAND(place))

        return F.sort_array(F.filter(F.transform(both, one), lambda x: x.isNotNull()))

    def measured(met: Column) -> Column:
        heads = F.filter(F.transform(met, lambda x, i: F.when((i == 0) | (x - F.get(met, i - 1) > WORDS), i)), lambda i: i.isNotNull())
        longest = _bound(heads, lambda h: F.array_max(F.transform(h, lambda s, j: F.get(met, F.coalesce(F.get(h, j + 1), F.size(met)) - 1) - F.get(met, s) + 1)))
        either = F.size(a) + F.size(b) - F.size(met)
        return F.struct(F.when(either == 0, F.lit(1.0)).otherwise(F.size(met) / either).alias("shared"), F.coalesce(longest, F.lit(0).cast("long")).alias("stretch"))

    return _bound(_bound(F.sort_array(F.concat(side(a, 0), side(b, 1))), meet), measured)


def _bounds_below(bounds: list, value: Column) -> Column:
    """How many of the ascending ``bounds`` lie below ``value``: first among every s-th of them, then in between."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    every = F.array(*map(F.lit, bounds))
    before = F.size(F.filter(F.array(*map(F.lit, bounds[step - 1 :: step])), lambda b: b < value)) * step
    return before + F.size(F.filter(F.slice(every, before + 1, step), lambda b: b < value))


def with_next(docs: DataFrame, key: str, column: str, derived: dict[str, Column]) -> DataFrame:
    """Each row, with ``derived`` columns, and ``next_<c>`` of ``column`` and of these from the row that follows
    by ``key`` (ties by a hash of ``column``; after the last: the first).

    Rows are dealt into ranges of the key; the first row of each range is also sent to the end
    of the range before it. The driver sees the bounds and first keys of the ranges only.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / ranges for i in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx(key, steps, 100 * ranges).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    place = _bounds_below(bounds, F.col(key))
    columns = [column, *derived]
    dealt = docs.withColumn("_range", F.when(F.col(key).isNull(), 0).otherwise(place)).withColumn("_tie", F.xxhash64(column))
    firsts = dealt.groupBy("_range").agg(F.min(F.struct(F.col(key).isNotNull().alias("known"), F.col(key).alias("key"), F.col("_tie").alias("tie"))).alias("f"))
    heads = sorted(((r["_range"], r["f"]["key"], r["f"]["tie"]) for r in firsts.collect()), key=lambda h: h[0])
    if not heads:
        return docs.withColumns(derived).select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    before = [heads[i - 1][0] for i in range(len(heads))]
    sent = spark.createDataFrame([(k, t, b) for (_, k, t), b in zip(heads, before)], f"_key {docs.schema[key].dataType.simpleString()}, _t long, _to int")
    extra = dealt.join(F.broadcast(sent), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_tie") == F.col("_t"))).withColumn("_range", F.col("_to"))
    extra = extra.dropDuplicates(["_range", "_tie"]).select(*docs.columns, "_range", "_tie", F.lit(1).alias("_extra"))
    # derived after the few heads were found, so nothing is derived twice
    every = dealt.select("*", F.lit(0).alias("_extra")).withColumns(derived).union(extra.withColumns(derived))
    order = Window.partitionBy("_range").orderBy("_extra", F.col(key).asc_nulls_first(), "_tie")
    return every.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).where("_extra = 0").drop("_range", "_tie", "_extra")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``anchors`` (numbers) and ``fingerprint`` of every whole text; null counts as empty, empty gives ''."""
    found = docs.select(key, anchors(F.coalesce(F.col(text), F.lit(""))).alias("anchors"))
    return found.withColumn("fingerprint", as_string(F.col("anchors")))


def edit_study(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """How fingerprints follow an edit: the last quarter of each text is replaced by the head of the next document.

    Returns ``key``, ``n_chars``, ``edited_sha256``, both fingerprints, their likeness ``near_edited`` and ``near_next``
    (to the next document's fingerprint), and ``shared`` and ``stretch`` of both (see ``matched``). Null texts are empty;
    null ids come first; rows of one id follow each other by a hash of their texts.
    """
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    n = F.length("_text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.col("_text").substr(F.lit(1), n - quarter), F.col("next__text").substr(F.lit(1), quarter))
    both = with_next(rows, key, "_text", {}).select(key, n.cast("long").alias("n_chars"), "_text", "next__text", edited.alias("_edited"))
    # all anchors of a text are as long as the text, so they are derived after the shuffle
    both = both.select(key, "n_chars", "_edited", anchors(F.col("_text")).alias("_own"), anchors(F.col("next__text")).alias("_next"), anchors(F.col("_edited")).alias("_changed"))
    both = both.select("*", matched(F.col("_own"), F.col("_changed")).alias("_m"), matched(F.col("_own"), F.col("_next")).alias("_n"))
    return both.select(
        key, "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), as_string(F.col("_own")).alias("fingerprint"), as_string(F.col("_changed")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_changed")).alias("near_edited"), likeness(F.col("_own"), F.col("_next")).alias("near_next"),
        F.col("_m.shared").alias("shared_edited"), F.col("_m.stretch").alias("stretch_edited"), F.col("_n.shared").alias("shared_next"), F.col("_n.stretch").alias("stretch_next"),
    )
