"""Jaccard join of documents on word n-grams by prefix filters under several token orders.

Two sets that are similar enough share tokens within a short prefix, whatever the global
order the tokens are sorted by. Three orders are used, from cheap to sharp, each on what the
one before left:

1. and 2. two hash orders: a document stays only if enough of its prefix tokens stand in the
   prefix of another one (documents, not pairs, are filtered here);
3. rarest tokens first, with counts over the documents still left: pairs must share a prefix
   token at positions that leave room for the overlap.

A pair is verified on its whole sets, after its prefixes under orders 1 and 2 were found to
meet as well. Equal sets are one class from the start. In a bucket of documents that share a
prefix token, each is first compared with one pivot only; documents that are linked by then
need no further comparison with each other, so a group of thousands of near copies costs one
pair per document and token, and only pairs across groups are tried one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.frames import components, small_side, written
from winnow.llm.text import chunks, distinct, list_array, mix, shingles, word_hashes, words

#: bytes of a row of two longs in a broadcast hash table
_PAIR_BYTES = 32
_SECOND = np.uint64(0x5851F42D4C957F2D)


def needed(n, percent: int):
    """Tokens a set of n must share with any partner."""
    return (n * percent + 99) // 100


def slack(n):
    """Shared prefix tokens asked for under the hash orders; grows with n, so a smaller partner asks for no more."""
    return 1 + n // 20


def _needed(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100)


def _prefix(n: Column, percent: int) -> Column:
    return n - _needed(n, percent) + 1


def sets_of(docs: DataFrame, key: str, text: str, k: int, percent: int, whole: bool) -> DataFrame:
    """``id``, ``n`` (distinct shingles), two sums ``s1``, ``s2`` that identify the set and, if ``whole``, all its ``tokens``,
    else its prefixes ``p1``, ``p2`` under the two hash orders."""
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            w = words(chunk)
            rows = len(chunk.offsets) - 1
            h, row = distinct(*shingles(word_hashes(chunk, w), w.first, k, short_whole=True))
            n = np.bincount(row, minlength=rows)
            ids, size = chunk.rows.column("id"), pa.array(n, pa.int64())
            h2 = mix(h ^ _SECOND)
            total = np.zeros((2, len(h) + 1), np.uint64)
            total[0, 1:], total[1, 1:] = np.cumsum(h), np.cumsum(h2)
            ends = np.cumsum(n)
            s1, s2 = (pa.array((t[ends] - t[ends - n]).view(np.int64)) for t in total)
            if whole:
                yield pa.RecordBatch.from_arrays([ids, size, s1, s2, list_array(h.view(np.int64), n, pa.int64())], ["id", "n", "s1", "s2", "tokens"])
                continue
            take = np.minimum(n - needed(n, percent) + slack(n), n)
            inside = np.arange(len(h)) - np.repeat(ends - n, n) < np.repeat(take, n)
            order = np.lexsort((h2, row))
            yield pa.RecordBatch.from_arrays(
                [ids, size, s1, s2, list_array(h[inside].view(np.int64), take, pa.int64()), list_array(h[order][inside].view(np.int64), take, pa.int64())],
                ["id", "n", "s1", "s2", "p1", "p2"],
            )

    if whole:
        return source.mapInArrow(run, "id long, n long, s1 long, s2 long, tokens array<long>")
    return source.mapInArrow(run, "id long, n long, s1 long, s2 long, p1 array<long>, p2 array<long>")


#: what a text of a row is known by
SET = ["id", "n", "s1", "s2"]


def further_texts(real: DataFrame) -> DataFrame | None:
    """Numbers ``uid`` above all ids for the sets of an id with several different ones, but for its least set; None if there are none.

    So every set is a document of its own, and an id's sets are linked to each other at the end.
    """
    least = real.groupBy("id").agg(F.min(F.struct("n", "s1", "s2")).alias("least"), F.max(F.struct("n", "s1", "s2")).alias("most"))
    several = written(least.where("least <> most").select("id", "least"), "several")
    if several.isEmpty():
        return None
    (top,) = real.agg(F.max("id")).first()
    if top >= 1 << 61:
        raise ValueError(f"ids with several texts need room above the largest id, which is {top}")
    more = real.select(*SET).distinct().join(several, "id").where(F.struct("n", "s1", "s2") != F.col("least"))
    return written(more.select(*SET, (F.lit(max(top, 0) + 1) + F.monotonically_increasing_id()).alias("uid")), "further")


def numbered(sets: DataFrame, further: DataFrame | None) -> DataFrame:
    """``sets`` with ``uid``: the id, or the number of a further text."""
    if further is None:
        return sets.withColumn("uid", F.col("id"))
    return sets.join(small_side(further, further.count(), 96), SET, "left").withColumn("uid", F.coalesce("uid", "id"))


def shared(tokens: DataFrame, name: str) -> DataFrame:
    """Tokens ``h`` of more than one row of (id, h), with the number ``df`` of rows.

    They grow with the corpus, so joins on them shuffle at every size; as a written table, a hot token can be split.
    """
    return written(tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), name)


def survivors(sets: DataFrame, prefix: str, percent: int) -> DataFrame:
    """``id`` of the sets with enough prefix tokens that stand in another prefix too."""
    tokens = sets.select("id", "n", F.explode(prefix).alias("h"))
    counted = tokens.join(shared(tokens, prefix), "h").groupBy("id", "n").agg(F.count("*").alias("c"))
    # the smallest partner of n has needed(n) tokens and asks for slack of that many
    least = 1 + F.floor(_needed(F.col("n"), percent) / 20)
    found = written(counted.where(F.col("c") >= least).select("id").distinct(), "survivors")
    return small_side(found, found.count(), _PAIR_BYTES)


def _room(i, n, j, m, percent: int) -> Column:
    """Whether the first shared token, at places i of n and j of m, leaves room for the similarity."""
    most = F.least(n - i + 1, m - j + 1)
    union = F.greatest(n + j - 1, m + i - 1)
    return most * 100 >= union * percent


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose prefixes under both hash orders meet and whose sets are similar enough."""
    def side(name):
        return sets.select(F.col("id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n", "tokens", "q1", "q2")))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.arrays_overlap("a_q1", "b_q1") & F.arrays_overlap("a_q2", "b_q2"))
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    both = both.select("a", "b", (F.col("a_n") + F.col("b_n")).alias("n"), common.alias("c"))
    return both.where(F.col("c") * 100 >= (F.col("n") - F.col("c")) * percent).select("a", "b").distinct()


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """For each row: ``key``, ``n_shingles`` and ``component_id``, the smallest id reachable over links.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; fewer than k of them are one shingle.
    Two documents link if 100 * intersection >= percent * union. Without words (also null text)
    there are no links; a null id has none and a null component. Rows of one id are one document
    with several texts: each row has its own size, links of all of them count.
    """
    found = written(sets_of(docs, key, text, k, percent, whole=False), "sets")
    further = further_texts(found.where("n > 0 and id is not null"))
    # from here on, id is the number of a set
    sets = numbered(found, further).withColumn("doc", F.col("id")).withColumn("id", F.when(F.col("n") > 0, F.col("uid")).otherwise(F.col("id"))).drop("uid")
    real = sets.where("n > 0 and id is not null")
    copies = written(real.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "copies")
    member = real.select("id", "n", "s1", "s2").join(small_side(copies, copies.count(), 64), ["n", "s1", "s2"])
    member = written(member.where("id <> rep").select("id", "n", "s1", "s2", "rep").distinct(), "member")
    sames = small_side(member.select("id", "n", "s1", "s2"), member.count(), 64)
    heads = real.join(sames, ["id", "n", "s1", "s2"], "left_anti")

    left = heads.join(survivors(heads, "p1", percent), "id", "left_semi")
    last = survivors(left, "p2", percent)
    wanted = last if further is None else last.select("id").union(further.join(last, further["uid"] == last["id"], "left_semi").select("id"))
    chosen = docs.select(F.col(key).cast("long").alias(key), text).join(wanted.select(F.col("id").alias(key)), key, "left_semi")
    tokens = numbered(sets_of(chosen, key, text, k, percent, whole=True), further).select(F.col("uid").alias("id"), "n", "tokens")
    if further is not None:
        tokens = tokens.join(last, "id", "left_semi")
    tokens = written(tokens.dropDuplicates(["id"]), "tokens")
    loose = tokens.select("id", "n", F.explode("tokens").alias("h"))
    rare = shared(loose, "df")
    met = loose.join(rare, "h")
    able = written(met.groupBy("id", "n").agg(F.count("*").alias("c")).where(F.col("c") >= _needed(F.col("n"), percent)), "able")
    able_small = small_side(able, able.count(), 48)
    ranked = loose.join(able_small, ["id", "n"]).join(rare, "h").groupBy("id", "n", "c").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("t"))
    prefixes = heads.join(able_small.drop("c"), ["id", "n"]).select("id", "n", F.slice("p1", 1, _prefix(F.col("n"), percent).cast("int")).alias("q1"), F.slice("p2", 1, _prefix(F.col("n"), percent).cast("int")).alias("q2"))
    full = ranked.select("id", "n", (F.col("n") - F.col("c")).alias("u"), F.col("t.h").alias("tokens")).join(prefixes.dropDuplicates(["id", "n"]), ["id", "n"])
    full = written(full, "ranked")

    room = (_prefix(F.col("n"), percent) - F.col("u")).cast("int")
    place = full.select("id", "n", "u", F.posexplode(F.slice("tokens", 1, room)).alias("i", "h")).select("h", "id", "n", (F.col("i") + F.col("u") + 1).alias("i"))
    place = written(place, "places")
    pivots = written(place.groupBy("h").agg(F.min(F.struct("i", "id", "n")).alias("v"), F.count("*").alias("c")).where("c > 1").select("h", F.col("v.i").alias("j"), F.col("v.id").alias("pivot"), F.col("v.n").alias("m")), "pivots")
    pairs = place.join(pivots, "h").where(F.col("id") != F.col("pivot")).where(_room(F.col("i"), F.col("n"), F.col("j"), F.col("m"), percent))
    first = written(pairs.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(), "pairs")
    links = written(verified(first, full, percent), "links")

    # what the pivots left apart: rows of another group than their bucket's pivot, against the whole bucket
    grouped = written(components(links), "groups")
    group = grouped.select(F.col("node").alias("id"), "component")
    of = written(place.join(group, "id", "left").select("h", "id", "n", "i", F.coalesce("component", "id").alias("g")), "grouped")
    lead = pivots.select("h", "pivot").join(group.withColumnRenamed("id", "pivot"), "pivot", "left").select("h", F.coalesce("component", "pivot").alias("lead"))
    odd = of.join(lead, "h").where("g <> lead").select("h", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("g").alias("g2"))
    odd = written(odd, "odd")
    across = of.join(odd, "h").where("g <> g2").where(_room(F.col("i"), F.col("n"), F.col("i2"), F.col("n2"), percent))
    across = across.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = verified(written(across, "across"), full, percent)

    stars = grouped.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    links = stars.union(more)
    if further is not None:  # the texts of one id hold together, and each with its class
        own = further.select(F.col("id").alias("a"), F.col("uid").alias("b"))
        ends = own.select(F.col("a").alias("id")).union(own.select(F.col("b").alias("id"))).distinct()
        links = links.union(own).union(member.join(ends, "id").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    final = components(links).select(F.col("node").alias("rep"), "component")

    out = sets.select("doc", *SET).join(member.dropDuplicates(SET), SET, "left")
    out = out.select("doc", "n", F.coalesce("rep", "id").alias("rep")).join(final, "rep", "left")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def first_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group (null ids stay); all columns are kept."""
    later = similar_groups(docs, key, text, k, percent).where(F.col("component_id") < F.col(key)).select(F.col(key).alias("later")).distinct()
    later = written(later, "later")
    later = small_side(later, later.count(), _PAIR_BYTES)
    return docs.join(later, docs[key].cast("long") == later["later"], "left_anti")
