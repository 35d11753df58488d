"""Benchmark items inside documents: size-partitioned MinHash containment search, exactly verified.

An item whose share of shingles in a document must reach a threshold can miss only so many;
one more than that of its least hashes (its bottom MinHash sketch) therefore always meets the
document. Items are partitioned by their size, which sets the length of their sketch and, for
items shorter than a shingle, the length of the words compared. Documents are probed against the
sketches however long they are, and candidates are verified on the shingles themselves.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.frames import small_side, written

#: words of a shingle, and the least share of an item's shingles that must be in a document
WORDS, CONTAINMENT = 5, 0.8
_BREAKS = r"[^\p{L}\p{M}\p{N}]+"


def word_list(text: str) -> Column:
    """Lower-case runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(F.col(text)), _BREAKS), lambda w: w != "")


def shingle_hashes(text: str, k: int) -> Column:
    """Hashes of all runs of k words. The array is bound once, so that no element evaluates it again."""
    def runs(a: Column) -> Column:
        every = F.transform(a, lambda x, i: F.xxhash64(x, *(F.get(a, i + j) for j in range(1, k))))
        return F.slice(every, 1, F.greatest(F.size(a) - (k - 1), F.lit(0)))

    return F.transform(F.array(F.transform(word_list(text), lambda w: F.xxhash64(w))), runs)[0]


def shingle_texts(words: Column, k: int) -> Column:
    """The distinct runs of k words."""
    def runs(a: Column) -> Column:
        every = F.transform(a, lambda x, i: F.concat_ws(" ", x, *(F.get(a, i + j) for j in range(1, k))))
        return F.array_distinct(F.slice(every, 1, F.greatest(F.size(a) - (k - 1), F.lit(0))))

    return F.transform(F.array(words), runs)[0]


def sketches(items: DataFrame, item_key: str, text: str, k: int, containment: float) -> DataFrame:
    """``item``, ``n`` (distinct shingles) and one row for each hash ``h`` of its sketch."""
    hashed = items.select(F.col(item_key).alias("item"), F.array_sort(F.array_distinct(shingle_hashes(text, k))).alias("s"))
    n = F.size("s")
    enough = F.ceil(n * containment - 1e-9)
    return hashed.where(n > 0).select("item", n.alias("n"), F.explode(F.slice("s", 1, (n - enough + 1).cast("int"))).alias("h"))


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """One row for each document and item with enough of the item's shingles in the document:
    ``key``, ``item_key``, ``n_shingles`` (of the item), ``matched``, ``containment``, and ``row``,
    which identifies the row of ``docs`` by id and text.

    Items of fewer than k words are one shingle of all their words. Null and empty texts match
    nothing. Rows with a null id are searched like all others; repeated rows give one row.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.xxhash64(key, text).alias("row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    tested = items.select(item_key, F.col(item_text).alias("_item")).dropDuplicates().withColumn("_len", F.least(F.size(word_list("_item")), F.lit(k)))
    tested = written(tested.where("_len > 0").withColumn("_id", F.xxhash64(item_key, "_item")), "items")
    out = None
    for length in sorted(r["_len"] for r in tested.select("_len").distinct().collect()):  # at most k lengths
        part = tested.where(F.col("_len") == length)
        index = written(sketches(part, "_id", "_item", length, containment), "sketches")
        probe = rows.select("row", F.explode(shingle_hashes("_text", length)).alias("h"))
        found = probe.join(small_side(index.select("item", "h"), index.count(), 32), "h").select("row", "item").distinct()
        found = written(found, "candidates")
        wanted = found.groupBy("row").agg(F.collect_set("item").alias("items"))
        long_texts = rows.join(small_side(wanted, found.count(), 48), "row").dropDuplicates(["row"])
        shingled = long_texts.select("row", "_key", shingle_texts(word_list("_text"), length).alias("d"), F.explode("items").alias("_id"))
        whole = part.select("_id", item_key, shingle_texts(word_list("_item"), length).alias("s"))
        sure = shingled.join(whole, "_id").select(
            F.col("_key").alias(key), item_key, F.size("s").alias("n_shingles"), F.size(F.array_intersect("s", "d")).alias("matched"), "row"
        )
        sure = sure.where(F.col("matched") >= F.ceil(F.col("n_shingles") * containment - 1e-9))
        out = sure if out is None else out.union(sure)
    if out is None:  # no item with a word
        out = rows.where("false").select(F.col("_key").alias(key), F.lit(None).cast(items.schema[item_key].dataType).alias(item_key), F.lit(0).alias("n_shingles"), F.lit(0).alias("matched"), "row")
    return out.withColumn("containment", F.col("matched") / F.col("n_shingles"))


def clean_of(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those that hold an item; all columns are kept."""
    found = written(contained(docs, items, key, text, **options).select("row").distinct(), "contaminated")
    found = small_side(found, found.count(), 16)
    return docs.join(found, F.xxhash64(docs[key], docs[text]) == found["row"], "left_anti")
