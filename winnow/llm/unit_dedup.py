"""Repeated passages: digests of paragraphs, lines and sentences are grouped globally, the earliest unit stays.

Whole paragraphs are compared first, then the lines of what is left, then the sentences of what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.frames import small_side, written
from winnow.llm.text import NOT_WORD, chunks, mix, word_hashes, words

#: units of fewer words are never removed: short ones repeat by chance
MIN_WORDS = 6

_LAST = (1 << 63) - 1
#: levels from coarse to fine; bit i of ``levels`` is set where a span is a unit of level i
LEVELS = ("paragraph", "line", "sentence")
_COLUMNS = "id long, k long, start long, end long, byte_start long, byte_end long, d1 long, d2 long, levels long, paragraph long, line long"


def units_of(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """``id`` (null: last), ``k`` (hash of the text), span in characters and bytes, 128-bit digest and ``levels`` of
    every unit, and ``paragraph`` and ``line``, the starts of those it stands in. A span that is a unit of several levels is one row.

    Paragraphs end at blank lines, lines at line ends, sentences there or where ``.``, ``!`` or ``?`` is followed by
    white space. A unit is normalised to its words: runs of letters and digits, ASCII letters in lower case.
    """
    source = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("k"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            w = words(chunk, NOT_WORD)
            m = len(w.start)
            if not m:
                continue
            data, row = chunk.data, np.repeat(np.arange(len(chunk.offsets) - 1), np.diff(w.first))

            def counted(mask: np.ndarray) -> np.ndarray:
                total = np.zeros(len(data) + 1, np.int64)
                np.cumsum(mask, out=total[1:])
                return total

            newline, space = data == 0x0A, (data == 0x20) | ((data >= 9) & (data <= 13))
            stop = (data == 0x2E) | (data == 0x21) | (data == 0x3F)
            stop[:-1] &= space[1:]
            # a line end is blank if only white space stands between it and the one before
            ends = np.flatnonzero(newline)
            blank = np.zeros(len(data), bool)
            solid = counted(~space)
            blank[ends[1:]] = solid[ends[1:]] == solid[ends[:-1]]

            def heads(mask: np.ndarray) -> np.ndarray:
                breaks = counted(mask)
                head = np.ones(m, bool)
                head[1:] = (row[1:] != row[:-1]) | (breaks[w.start[1:]] > breaks[w.end[:-1]])
                return head

            marks = [heads(blank), heads(newline), heads(newline | stop)]
            spans_of = [(f, np.append(f[1:], m)) for f in map(np.flatnonzero, marks)]
            # from the coarsest, each span once
            place = np.concatenate([f * (m + 1) + z for f, z in spans_of])
            bit = np.repeat([1 << i for i in range(len(LEVELS))], [len(f) for f, _ in spans_of])
            place, one, inverse = np.unique(place, return_index=True, return_inverse=True)
            levels = np.zeros(len(place), np.int64)
            np.add.at(levels, inverse, bit)
            first, last = place // (m + 1), place % (m + 1)
            digests = []
            for seed in (0, 1):  # two hashes of every word, each mixed with the word's place in the unit
                h = word_hashes(chunk, w, seed=seed)
                sums = [np.add.reduceat(mix(h ^ mix(np.arange(m) - np.repeat(f, z - f))), f) for f, z in spans_of]
                digests.append(mix(np.concatenate(sums)[one] + (last - first).astype(np.uint64)))
            keep = last - first >= min_words
            # a unit reaches to the white space after its last word
            gaps = np.append(np.flatnonzero(space), len(data))
            start, end = w.start[first], w.end[last - 1]
            end = np.minimum(gaps[np.searchsorted(gaps, end)], chunk.offsets[row[first] + 1])
            chars = counted((data & 0xC0) != 0x80)
            base = chunk.offsets[row[first]]
            inside = [f[np.searchsorted(f, first, side="right") - 1] for f, _ in spans_of[:2]]
            within = [chars[w.start[f]] - chars[base] for f in inside]
            spans = [chars[start] - chars[base], chars[end] - chars[base], start - base, end - base]
            at = pa.array(row[first][keep])
            yield pa.RecordBatch.from_arrays(
                [chunk.rows.column("id").take(at), chunk.rows.column("k").take(at), *(pa.array(s[keep]) for s in spans), *(pa.array(d[keep].view(np.int64)) for d in digests), *(pa.array(x[keep]) for x in (levels, *within))],
                [c.split()[0] for c in _COLUMNS.split(", ")],
            )

    return source.mapInArrow(run, _COLUMNS)


def repeated_units(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each unit that stands earlier too: ``key``, its span in the original text (``start``, ``end`` in
    characters, ``byte_start``, ``byte_end``), ``digest``, and ``kept_<key>``, ``kept_start``, where the earliest one is.

    Paragraphs come first; lines are compared where no paragraph was repeated, sentences where no line was, so spans
    don't overlap and what is kept of a unit stands in no repeated one of a coarser level.
    Rank is id, then a hash of the text, then place; null ids rank last. Rows alike in id and text are one document.
    Null and empty texts and units of fewer than ``min_words`` words give no row.
    """
    units = written(units_of(docs, key, text, min_words), "units")
    rank = F.struct("id", "k", "start")
    left, found = units, None
    for i, level in enumerate(LEVELS):
        here = left.where(F.col("levels").bitwiseAND(1 << i) > 0)
        firsts = written(here.groupBy("d1", "d2").agg(F.min(rank).alias("f"), F.count("*").alias("n")).where("n > 1").select("d1", "d2", "f"), "firsts")
        later = here.join(firsts, ["d1", "d2"]).where(rank != F.col("f"))
        if level != LEVELS[-1]:
            later = written(later, f"later-{level}")
            gone = later.select("id", "k", F.col("start").alias(level)).distinct()
            left = left.where(F.col("levels") >= 2 << i).join(small_side(gone, later.count(), 24), ["id", "k", level], "left_anti").select(units.columns)
        found = later.select(*units.columns, "f") if found is None else found.union(later.select(*units.columns, "f"))
    plain = lambda c: F.when(c == _LAST, F.lit(None)).otherwise(c)
    return found.select(
        plain(F.col("id")).alias(key), "start", "end", "byte_start", "byte_end", F.concat(F.hex("d1"), F.lit("-"), F.hex("d2")).alias("digest"),
        plain(F.col("f.id")).alias(f"kept_{key}"), F.col("f.start").alias("kept_start"), F.col("k").alias("text_hash"),
    )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated units cut out of ``text``; every row stays."""
    gone = repeated_units(docs, key, text, min_words).select(F.coalesce(key, F.lit(_LAST)).alias("id"), F.col("text_hash").alias("k"), "start", "end")
    gone = gone.groupBy("id", "k").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("gone"))
    taken = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("k"))
    both = taken.join(gone, ["id", "k"], "left")

    def piece(s, i):
        after = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("gone", i - 1)["end"])
        return F.col("text").substr((after + 1).cast("int"), (s["start"] - after).cast("int"))

    tail = F.col("text").substr((F.element_at("gone", -1)["end"] + 1).cast("int"), F.length("text"))
    cut = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform("gone", piece), ""), tail))
    return both.select(*(cut.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))
