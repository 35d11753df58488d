"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are hashed n-grams of character shapes (case, digit, space, line end, each
punctuation mark) and of letters, and words that repeat the words before them. Log counts weighted by inverse document frequency are
projected on the leading singular directions of a labelled sample. Every text is compared
with every labelled vector by blocked matrix products, and the most similar ones vote with
weights that rise with similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.text import Chunk, chunks, codepoints, letters, word_hashes, words

#: bound of labelled rows to learn from, hash buckets of the terms, latent dimensions, voters
FIT_ROWS, BUCKETS, DIMENSIONS, VOTERS = 4_000, 1024, 48, 25
#: a text passes with at least this score
CUT = 0.7
#: weight of a voter is similarity to this power
SHARPNESS = 8
_MULTIPLIER = np.uint32(0x9E3779B1)
#: terms for words that repeat what stands before them
REPEATS = 3


class Model(NamedTuple):
    idf: np.ndarray
    directions: np.ndarray  # buckets x dimensions
    vectors: np.ndarray  # labelled rows x dimensions, unit length
    labels: np.ndarray
    prior: float


@lru_cache(maxsize=1)
def shapes() -> np.ndarray:
    """Shape class of each code point."""
    table = np.full(0x110000, 1, np.uint32)
    known = letters()
    alpha = known != 0x20
    table[alpha] = 2
    table[alpha & (known != np.arange(0x110000))] = 3  # upper case
    table[[0x20, 0x09, 0x0B, 0x0C, 0xA0]] = 4
    table[[0x0A, 0x0D]] = 5
    table[0x30:0x3A] = 6
    for i, c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
        table[ord(c)] = 8 + i
    return table


def term_counts(chunk: Chunk, buckets: int) -> np.ndarray:
    """Counts of hashed terms per row, and of words that go on a repetition."""
    chars, offsets = codepoints(chunk)
    n, rows = len(chars), len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    out = np.zeros(rows * buckets)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    for kind, base, orders in ((1, shapes()[chars], (1, 2, 3)), (2, letters()[chars], (2,))):
        for k in orders:
            m = n - k + 1
            if m <= 0:
                continue
            h = np.full(m, kind * 97 + k, np.uint32)
            for j in range(k):
                h = (h ^ base[j : j + m]) * _MULTIPLIER
                h ^= h >> np.uint32(15)
            whole = row[:m] == row[k - 1 :]
            bucket = ((h * _MULTIPLIER) >> shift).astype(np.int64)
            out += np.bincount((row[:m] * buckets + bucket)[whole], minlength=len(out))
    w = words(chunk)
    h, word_row = word_hashes(chunk, w), np.repeat(np.arange(rows), np.diff(w.first))
    extra = np.zeros((rows, REPEATS))
    for i, lags in enumerate(((1, 2), (2, 4), (3, 6))):  # a run of one word, of a pair, of three words
        if len(h) > lags[1]:
            m = len(h) - lags[1]
            same = (word_row[:m] == word_row[lags[1] :]) & (h[lags[1] :] == h[lags[0] : lags[0] + m]) & (h[lags[1] :] == h[:m])
            extra[:, i] = np.bincount(word_row[:m][same], minlength=rows)
    return np.hstack([out.reshape(rows, buckets), extra])


def project(counts: np.ndarray, idf: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Unit latent vectors; the zero vector for a text without terms."""
    weights = np.log1p(counts) * idf
    weights /= np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-12)
    latent = weights @ directions
    return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)


def vote(latent: np.ndarray, model: Model, voters: int = VOTERS, block: int = 256) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors, block by block."""
    out = np.full(len(latent), model.prior)
    k = min(voters, len(model.labels))
    for at in range(0, len(latent), block):
        similarity = latent[at : at + block] @ model.vectors.T
        near = np.argpartition(-similarity, k - 1, axis=1)[:, :k] if k < similarity.shape[1] else np.tile(np.arange(k), (len(similarity), 1))
        weight = np.maximum(np.take_along_axis(similarity, near, 1), 0) ** SHARPNESS
        total = weight.sum(axis=1)
        share = (weight * model.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
        out[at : at + block] = np.where(total > 1e-9, share, model.prior)
    return np.clip(out, 0.0, 1.0)


def labelled(docs: DataFrame, labels: DataFrame, allowed: Column, key: str, text: str, label: str, fit_rows: int) -> DataFrame:
    """``text`` and ``label`` of at most about ``fit_rows`` labelled rows, drawn by hash of the id.

    A label that is null or contradicted by another row of the same id is not learned from;
    of several texts of one id the first in order is.
    """
    votes = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("y")).where("k is not null and y is not null")
    votes = votes.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top")
    rows = votes.withColumnRenamed("k", key).where(allowed).select(F.col(key).alias("k"), "y").withColumn("draw", F.pmod(F.xxhash64("k"), F.lit(1 << 20)))
    n = rows.count()
    chosen = rows.where(F.col("draw") < min(1.0, fit_rows / max(n, 1)) * (1 << 20)).select("k", "y")
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    # about fit_rows rows of two numbers, so the hint is within its bound at any size
    return texts.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("text").alias("text")).select("k", "text", "y")


def fit(rows: DataFrame, buckets: int = BUCKETS, dimensions: int = DIMENSIONS) -> Model:
    """Learn from the bounded rows of :func:`labelled`. Without any row every score is 0.5."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            counts = term_counts(chunk, buckets).astype(np.float32)
            yield pa.RecordBatch.from_arrays([chunk.rows.column("k").cast(pa.int64()), pa.array([r.tobytes() for r in counts], pa.binary()), chunk.rows.column("y")], ["k", "terms", "y"])

    table = rows.mapInArrow(count, "k long, terms binary, y double").toPandas().sort_values("k")
    if not len(table):
        return Model(np.ones(buckets + REPEATS), np.zeros((buckets + REPEATS, 1)), np.zeros((1, 1)), np.full(1, 0.5), 0.5)
    counts = np.stack([np.frombuffer(t, np.float32) for t in table["terms"]]).astype(np.float64)
    y = table["y"].to_numpy()
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.2
    weights = np.log1p(counts) * idf
    weights /= np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-12)
    _, axes = np.linalg.eigh(weights.T @ weights)
    directions = axes[:, ::-1][:, :dimensions]
    return Model(idf, directions, project(counts, idf, directions), y, float(y.mean()))


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """Makes a column of texts one of scores (0 to 1); null and empty texts get the prior share of label 1.

    Only the text goes to Python and only the score comes back, so that the other columns of a row stay in the JVM.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for chunk in chunks(pa.RecordBatch.from_arrays([t], ["text"]) for t in texts):
            yield pa.array(vote(project(term_counts(chunk, len(m.idf) - REPEATS), m.idf, m.directions), m))

    return F.arrow_udf(run, "double")


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` of :func:`scorer` of every whole text."""
    return docs.select(*keep, scorer(docs.sparkSession, model)(F.col(text)).alias("score"))
