"""Classification metrics computed as aggregates (no driver-side loops over rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import prefix_sums


def confusion(df: DataFrame, label="label", pred="prediction") -> DataFrame:
    """TP, FP, TN, FN in one aggregate."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    return df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"))


def exact_auc(df: DataFrame, score="score", label="label") -> float:
    """ROC AUC with ties counted one half (Mann-Whitney with mid-ranks).

    Scores are reduced to distinct values with their positive / negative
    counts (map-side combined), then a distributed prefix sum gives the
    negatives below each score.
    """
    y = F.col(label).cast("int")
    per = df.groupBy(F.col(score).alias("s")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    cum = prefix_sums(per, "s", ["neg"])
    row = cum.agg(F.sum(F.col("pos") * (F.col("cum_neg") + F.col("neg") / F.lit(2.0))).alias("u"),
                  F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    if not row["p"] or not row["n"]:
        return None
    return float(row["u"]) / (float(row["p"]) * float(row["n"]))


def classification_metrics(df: DataFrame, label="label", score="score", threshold: float = 0.5) -> dict:
    """A10: accuracy, precision, recall, F1 (positive class) and exact ROC AUC."""
    scored = df.withColumn("_pred", (F.col(score) >= F.lit(threshold)).cast("int"))
    c = confusion(scored, label, "_pred").first()
    tp, fp, tn, fn = c["tp"], c["fp"], c["tn"], c["fn"]
    n = tp + fp + tn + fn
    precision = tp / (tp + fp) if tp + fp else 0.0
    recall = tp / (tp + fn) if tp + fn else 0.0
    f1 = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
    return {"n": n, "tp": tp, "fp": fp, "tn": tn, "fn": fn, "accuracy": (tp + tn) / n if n else None,
            "precision": precision, "recall": recall, "f1": f1, "roc_auc": exact_auc(df, score, label)}
