"""Label audit (confident learning) and curriculum segments.

Class probabilities are an ``array<double>`` column ``probs`` (index = class).
The issue finder follows "prune by noise rate" (Northcutt et al.,
arXiv:1911.00068): per-class thresholds, the confident joint, its
calibration to the label counts, and per (given, other) class the rows with
the largest margin. Everything that is per row stays distributed; only
K-sized and K x K tables reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import rank_in_groups

# Quality threshold of the curriculum and the alert texts
# (the spelling of the escalation text is the reference's own).
QUALITY_THRESHOLD = 0.9
ALERT_ISSUES = "Esclate for human review"
ALERT_OK = "Data Quality check passed"
THRESHOLD_SLACK = 1e-6


def with_probs(df: DataFrame, cols=("p0", "p1"), out="probs") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))


def self_confidence(probs="probs", label="label"):
    """L3: probability given to the row's own label."""
    return F.element_at(F.col(probs), F.col(label).cast("int") + 1)


def argmax(probs="probs"):
    """Index of the first largest probability."""
    return (F.array_position(F.col(probs), F.array_max(F.col(probs))) - 1).cast("int")


def _half_up(x: float) -> int:
    return int(math.floor(x + 0.5))


def label_issues(df: DataFrame, label="label", key="id", probs="probs") -> DataFrame:
    """L2: (key, is_issue) for every row."""
    # (1) per-class thresholds (mean self-probability over rows of that label), label
    # counts and the number of classes in one aggregate: one row per label.
    per_label = df.groupBy(F.col(label).cast("int").alias("_y")).agg(
        F.avg(self_confidence(probs, label)).alias("t"), F.count(F.lit(1)).alias("n"),
        F.max(F.size(probs)).alias("k")).collect()
    k = max(r["k"] for r in per_label)
    th = {r["_y"]: r["t"] for r in per_label}
    label_n = {r["_y"]: r["n"] for r in per_label}
    thresholds = F.array(*[F.lit(float(th.get(c, 1.0)) - THRESHOLD_SLACK) for c in range(k)])
    # (2) candidate = most probable class among those at or above their threshold.
    masked = F.zip_with(F.col(probs), thresholds, lambda p, t: F.when(p >= t, p).otherwise(F.lit(-1.0)))
    cand = F.when(F.array_max(masked) >= 0, (F.array_position(masked, F.array_max(masked)) - 1).cast("int"))
    scored = df.select(key, F.col(label).cast("int").alias("_y"), probs, cand.alias("_c"))
    # (3) confident joint C[y][c]; (4) rows scaled to the label counts, rounded half-up.
    joint = {(r[0], r[1]): r[2] for r in scored.where(F.col("_c").isNotNull())
             .groupBy("_y", "_c").count().collect()}
    prune = []
    for y in range(k):
        row_sum = sum(joint.get((y, j), 0) for j in range(k))
        if row_sum == 0:
            continue
        for j in range(k):
            if j != y:
                n = _half_up(joint.get((y, j), 0) * label_n.get(y, 0) / row_sum)
                if n > 0:
                    prune.append((y, j, n))
    spark = df.sparkSession
    if not prune:
        return df.select(key, F.lit(False).alias("is_issue"))
    quota = spark.createDataFrame(prune, "_y int, _j int, _n bigint")
    # (5) per (given y, other j): the n_yj rows labelled y with the largest p[j] - p[y].
    pairs = scored.join(F.broadcast(quota), "_y").withColumn(
        "_m", F.element_at(probs, F.col("_j") + 1) - F.element_at(probs, F.col("_y") + 1))
    ranked = rank_in_groups(pairs, ["_y", "_j"], [F.col("_m").desc(), F.col(key)], rank_col="_r")
    flagged = ranked.where(F.col("_r") <= F.col("_n")).select(key).distinct().withColumn("_f", F.lit(True))
    out = df.select(key, label, probs).join(flagged, key, "left")
    # (6) never flag a row whose argmax is its given label.
    issue = F.coalesce(F.col("_f"), F.lit(False)) & (argmax(probs) != F.col(label).cast("int"))
    return out.select(key, issue.alias("is_issue"))


def label_report(df: DataFrame, label="label", key="id", probs="probs") -> DataFrame:
    """L4: id, original label, argmax label, max probability, quality score, is_issue."""
    base = df.select(
        F.col(key).alias(key), F.col(label).alias("original_label"), argmax(probs).alias("predicted_label"),
        F.array_max(probs).alias("confidence_score"), self_confidence(probs, label).alias("quality_score"))
    return base.join(label_issues(df, label, key, probs), key)


def quality_alert(report: DataFrame) -> DataFrame:
    """L5 + A7: issue count, score range and the alert text."""
    agg = report.agg(F.count_if("is_issue").alias("issue_count"), F.count(F.lit(1)).alias("row_count"),
                     F.min("quality_score").alias("min_quality"), F.max("quality_score").alias("max_quality"))
    return agg.withColumn("message", F.when(F.col("issue_count") > 0, F.lit(ALERT_ISSUES)).otherwise(F.lit(ALERT_OK)))


def join_quality(train: DataFrame, quality: DataFrame, key="id") -> DataFrame:
    """Left join of rows to (key, quality_score); the score side must be unique on key."""
    dup = quality.groupBy(key).count().where("count > 1").limit(1).count()
    if dup:
        raise ValueError("quality scores are not unique per key")
    return train.join(quality.select(key, "quality_score"), key, "left")


def segment(df: DataFrame, threshold: float = QUALITY_THRESHOLD, col="segment") -> DataFrame:
    """P10: high when quality_score >= threshold; low otherwise (null included)."""
    q = F.col("quality_score")
    return df.withColumn(col, F.when(q.isNotNull() & (q >= F.lit(threshold)), "high").otherwise("low"))
