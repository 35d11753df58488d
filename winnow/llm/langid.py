"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.text import Chunk, chunks, codepoints, letters, per_row

#: n-gram lengths, hash buckets, smoothing, and the bound of labelled rows per language to learn from
ORDERS, BUCKETS, ALPHA, FIT_ROWS = (1, 2, 3), 1 << 15, 0.1, 5_000
#: the log-probability matrix is broadcast; more languages than fit this are an error
MATRIX_BYTES = 64 << 20
_MULTIPLIER = np.uint32(0x9E3779B1)


class Model(NamedTuple):
    langs: list[str]
    prior: np.ndarray  # log share of each language
    logp: np.ndarray  # languages x buckets


def grams(chunk: Chunk, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: bucket of every n-gram that holds a letter, and row offsets in them.

    Letters are lower-cased, all else is a space; n-grams never cross rows.
    """
    chars, offsets = codepoints(chunk)
    c = letters()[chars]
    n = len(c)
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(n)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    letter = c != 0x20
    for k in ORDERS:
        h = np.full(max(n - k + 1, 0), k * 0x1000193, np.uint32)
        has = np.zeros(len(h), bool)
        for j in range(k):
            h = (h ^ c[j : j + len(h)]) * _MULTIPLIER
            h ^= h >> np.uint32(15)
            has |= letter[j : j + len(h)]
        keep = has & (at[: len(h)] + k <= row_end[: len(h)])
        counted = np.zeros(n + 1, np.int64)
        np.cumsum(keep, out=counted[1 : len(h) + 1])
        counted[len(h) + 1 :] = counted[len(h)]
        yield ((h * _MULTIPLIER) >> shift)[keep].astype(np.int64), counted[offsets]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample_key: Column | None = None, fit_rows: int = FIT_ROWS, buckets: int = BUCKETS) -> Model:
    """Learn from at most about ``fit_rows`` rows of each language, drawn by hash of ``sample_key``.

    Rows with a null text or language are not learned from; without any other the model knows no language. Raises if there are
    more languages than ``MATRIX_BYTES`` holds (256 at the default number of buckets).
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(sample_key if sample_key is not None else F.col(text)).alias("draw"))
    rows = rows.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros(0), np.zeros((0, buckets)))
    langs = sorted(sizes)
    if len(langs) * buckets * 8 > MATRIX_BYTES:
        raise ValueError(f"{len(langs)} languages of {buckets} buckets are more than {MATRIX_BYTES} bytes")
    share = F.element_at(F.create_map(*[F.lit(x) for p in langs for x in (p, min(1.0, fit_rows / sizes[p]))]), F.col("lang"))
    drawn = rows.where(F.pmod("draw", F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text").repartition(16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {p: i for i, p in enumerate(langs)}
        total = np.zeros(len(langs) * buckets, np.int64)
        for chunk in chunks(batches):
            row_lang = np.array([index[p] for p in chunk.rows.column("lang").to_pylist()])
            for bucket, offsets in grams(chunk, buckets):
                total += np.bincount(np.repeat(row_lang, np.diff(offsets)) * buckets + bucket, minlength=len(total))
        cell = np.flatnonzero(total)
        for i in range(0, len(cell), 1 << 16):
            part = cell[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["cell", "n"])

    counts = drawn.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.full(len(langs) * buckets, ALPHA)
    table[counts["cell"].to_numpy(np.int64)] += counts["n"].to_numpy(np.float64)
    table = table.reshape(len(langs), buckets)
    all_rows = sum(sizes.values())
    return Model(langs, np.log([sizes[p] / all_rows for p in langs]), np.log(table / table.sum(axis=1, keepdims=True)))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score``, the posterior probability of that language.

    A text that is null or has no letter gets ``und`` and 0, as does every text if the model knows no language. Ties go
    to the language that sorts first. A row's score does not depend on other rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col(text).alias("_text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, logp = shared.value
        names = np.array([*langs, "und"], object)
        for chunk in chunks(batches, "_text"):
            if not langs:
                none = pa.array(["und"] * chunk.rows.num_rows)
                yield pa.RecordBatch.from_arrays([*(chunk.rows.column(c) for c in keep), none, pa.array(np.zeros(len(none)))], [*keep, "lang_pred", "score"])
                continue
            total = np.tile(prior, (chunk.rows.num_rows, 1))
            for bucket, offsets in grams(chunk, logp.shape[1]):
                for i, row in enumerate(logp):
                    total[:, i] += per_row(row[bucket], offsets)
            total -= total.max(axis=1, keepdims=True)
            best = total.argmax(axis=1)
            p = 1 / np.exp(total).sum(axis=1)
            has = np.array(chunk.rows.column("_letter").to_pylist(), bool)
            best, p = np.where(has, best, len(langs)), np.where(has, p, 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(chunk.rows.column(c) for c in keep), pa.array(names[best], pa.string()), pa.array(p)], [*keep, "lang_pred", "score"]
            )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema] + ["lang_pred string", "score double"])
    return source.mapInArrow(score, schema)
