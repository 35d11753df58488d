"""Two-class scores: thresholded counts and the ROC curve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.operators.rank import global_cumsum


def confusion(df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """One row: tp, fp, tn, fn, accuracy, precision, recall."""
    hit, true = F.col(score) >= F.lit(threshold), F.col(label) == 1
    counts = df.agg(
        F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"),
        F.count_if(~hit & ~true).alias("tn"), F.count_if(~hit & true).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        "*",
        F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
    )


def roc_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One point per distinct score, from strict to lenient: threshold, tp, fp, tpr, fpr.

    Scores are counted before they are sorted, so tied scores shrink to one row.
    """
    counts = df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    run = global_cumsum(counts, [F.desc("threshold")], {"tp": F.col("pos"), "fp": F.col("neg")})
    total = counts.agg(F.sum("pos"), F.sum("neg")).first()
    return run.select(
        "threshold", "tp", "fp",
        F.try_divide(F.col("tp"), F.lit(total[0])).alias("tpr"),
        F.try_divide(F.col("fp"), F.lit(total[1])).alias("fpr"),
        "pos", "neg",
    )


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve by the trapezoid rule; null when a class is absent.

    The step at one threshold spans ``neg`` to the right between heights tp - pos and
    tp, so each point carries its own trapezoid and no neighbour is needed.
    """
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return roc_curve(df, score, label).agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("auc"))
