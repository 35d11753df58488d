"""A training-data pipeline over ``documents``: reject poor texts, drop boilerplate lines, keep one of each
group of near copies, drop documents that hold benchmark items, and pack the rest into sequences.

``STAGES`` are run one after the other; what a stage returns is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from winnow.llm.frames import table, written
from winnow.llm.queries import word_bpe


def quality_classifier(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows that score at least ``quality.CUT``; null and empty texts score the share of good labels. Repeated rows share their fate."""
    rows = quality.labelled(docs, table(spark, folder, "labels"), F.lit(True), "doc_id", "text", "quality", quality.FIT_ROWS)
    return docs.where(quality.scorer(spark, quality.fit(rows))(F.col("text")) >= quality.CUT)


def line_spread(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All rows; lines that stand on many sites are kept where they stand first, ``n_chars`` follows the text. Null texts stay null; a null
    source is a site, a null id comes last; repeated rows keep the same lines."""
    cut = line_dedup.remove_boilerplate(docs)
    return cut.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The row of smallest id of every group linked by five-word shingles at a similarity of 0.8. Null and empty texts are linked with
    nothing and stay, as do rows without an id; rows of one id stay or go together."""
    return jaccard_join.first_of_each_group(docs, k=5, percent=80)


def containment_search(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows without any benchmark item, at a containment of 0.8 of its five-word shingles. Null and empty texts hold none and stay;
    a row is judged by its own text, so repeated rows share their fate."""
    return decontaminate.clean_of(docs, table(spark, folder, "benchmark"))


def mixture_packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, mixed like the corpus left. A null or empty text is its end id alone, repeated rows are packed each."""
    return packing.pack(docs, word_bpe)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_spread),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", containment_search),
    ("packing", mixture_packing),
]

#: a trained classifier and a tokenizer are beyond SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
