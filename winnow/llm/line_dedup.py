"""Cross-site boilerplate: lines that stand on many sites are removed after their first occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.frames import small_side, written

#: a line on at least this many sites is boilerplate
MIN_SITES = 10
#: sketch size (2^LOG_K registers, a relative error of 1.04 / sqrt(2^LOG_K)) and the band around
#: the threshold, six such errors, inside which sites are counted exactly
LOG_K, BAND = 12, 0.1

_LAST = (1 << 63) - 1


def lines_of(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """``k`` (row identity), ``id`` (rank of the document), ``site``, ``pos`` and ``h`` of every line with content.

    A line is compared without the spaces around it. A null site is a site of its own, a null id ranks last.
    """
    rows = docs.where(F.col(text).isNotNull()).select(
        F.xxhash64(key, text).alias("k"), F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("id"),
        F.xxhash64(site).alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    )
    return rows.select("k", "id", "site", "pos", F.trim("line").alias("line")).where("line <> ''").select("k", "id", "site", "pos", F.xxhash64("line").alias("h"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, log_k: int = LOG_K, band: float = BAND) -> DataFrame:
    """``h`` and ``first`` (the smallest document with it) of lines on at least ``min_sites`` distinct sites.

    One sketch of sites per line and map task, merged by the aggregation. Only lines whose
    estimate is near the threshold get their sites counted one by one.
    """
    sketched = lines.groupBy("h").agg(F.hll_sketch_agg("site", log_k).alias("sketch"), F.min("id").alias("first"))
    spread = sketched.select("h", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - band))
    spread = written(spread, "spread")
    unsure = F.col("sites") <= min_sites * (1 + band)
    near = spread.where(unsure)
    exact = lines.join(small_side(near.select("h"), near.count(), 16), "h", "left_semi").groupBy("h").agg(F.count_distinct("site").alias("exact"))
    sure = spread.where(~unsure).select("h", "first")
    return sure.union(near.join(exact.where(F.col("exact") >= min_sites), "h").select("h", "first"))


def remove_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and ``n_lines`` and ``n_removed``.

    The first occurrence of a line in the corpus (smallest id, then first line) stays, so that
    no passage is lost altogether. Every row of the input is returned: one that loses all lines
    has an empty text, a null text stays null with no lines. Rows alike in id and text are
    treated alike. Columns of ``docs`` named like the two counts give way to them.
    """
    lines = lines_of(docs, key, text, site)
    found = written(boilerplate(lines, min_sites), "boilerplate")
    hits = lines.join(small_side(found, found.count(), 24), "h").groupBy("k", "h").agg(F.collect_set("pos").alias("at"), F.min("pos").alias("top"), F.first(F.col("id") == F.col("first")).alias("keeper"))
    # a document that holds the first occurrence keeps the topmost one
    gone = hits.select("k", F.when(F.col("keeper"), F.array_except("at", F.array("top"))).otherwise(F.col("at")).alias("at"))
    gone = gone.groupBy("k").agg(F.flatten(F.collect_list("at")).alias("gone"))
    taken = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.xxhash64(key, text).alias("k"))
    joined = taken.join(gone, "k", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    parts = F.split("text", "\n")
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("gone", i)), "\n"))
    counts = {"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)), "n_removed": F.size("gone")}
    same = [c for c in docs.columns if c not in counts]
    return joined.select(*(kept.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in same), *(v.alias(c) for c, v in counts.items()))
