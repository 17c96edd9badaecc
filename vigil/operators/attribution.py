"""Attribution tables: top drivers, influence labels, global importance, group shares.

Attributions are long rows ``(id, feature, phi)``. Per-row work groups by
``id``; a group holds one row per model feature, so its size is fixed by the
model, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import influence_bucket

TOP_K = 5
# Share of the total influence above which the sensitive group counts as significant.
SENSITIVE_SHARE = 0.1

# Feature groups of the account model (fixed values, upper-case feature names).
FEATURE_GROUPS = {
    "traceability_only": ["ID"],
    "demographic_sensitive": ["SEX", "EDUCATION", "MARRIAGE", "AGE"],
    "credit_capacity": ["LIMIT_BAL"],
    "repayment_history": ["PAY_0", "PAY_2", "PAY_3", "PAY_4", "PAY_5", "PAY_6"],
    "billing_behavior": ["BILL_AMT1", "BILL_AMT2", "BILL_AMT3", "BILL_AMT4", "BILL_AMT5", "BILL_AMT6"],
    "repayment_amounts": ["PAY_AMT1", "PAY_AMT2", "PAY_AMT3", "PAY_AMT4", "PAY_AMT5", "PAY_AMT6"],
}


def top_drivers_long(phi: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k largest |phi| per id (ties by feature name), signed value kept.

    The rows are dealt by id before they are sorted: a scan task makes every feature's row of its ids, and the limit that the
    planner puts in front of the shuffle would sort all of them there.
    """
    w = Window.partitionBy("id").orderBy(F.abs("phi").desc(), F.col("feature"))
    dealt = phi.repartition(int(phi.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    return dealt.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "id", F.col("rank").cast("int").alias("rank"), "feature", "phi")


def pack_drivers(phi: DataFrame, k: int = TOP_K) -> DataFrame:
    """T1 packed: (id, drivers array<struct<feature, phi>>) in rank order.

    One hash aggregate per id; the sort key (-|phi|, feature) rides in the
    struct so array_sort gives the rank order.
    """
    ranked = F.array_sort(F.collect_list(F.struct((-F.abs("phi")).alias("k"), F.col("feature"), F.col("phi"))))
    top = F.slice(ranked, 1, k)
    return phi.groupBy("id").agg(
        F.transform(top, lambda s: F.struct(s["feature"].alias("feature"), s["phi"].alias("phi"))).alias("drivers"))


def local_drivers(phi: DataFrame, k: int = TOP_K) -> DataFrame:
    """Per row, the feature -> value map, the top-k pairs and the risk factors."""
    packed = phi.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "phi"))).alias("local"))
    drivers = pack_drivers(phi, k)
    return packed.join(drivers, "id").withColumn(
        "risk_factors", F.transform("drivers", lambda d: d["feature"]))


def influence_graph(phi: DataFrame, scale: float = 1.0) -> DataFrame:
    """Strength label per (id, feature); ``scale`` = 2 for GBT margins (log-odds)."""
    return phi.select("id", "feature", influence_bucket(F.col("phi") * F.lit(scale)).alias("strength"))


def global_importance(phi: DataFrame) -> DataFrame:
    """Mean |phi| per feature."""
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))


def feature_group_table(spark) -> DataFrame:
    rows = [(f, g) for g, fs in FEATURE_GROUPS.items() for f in fs]
    return spark.createDataFrame(rows, "feature string, feature_group string")


def group_share(phi: DataFrame, threshold: float = SENSITIVE_SHARE) -> DataFrame:
    """Share of total |phi| per feature group ('ungrouped' for engineered features); the sensitive group is flagged
    where its share exceeds ``threshold``.

    The group table has one row per model feature, so it is broadcast.
    """
    groups = feature_group_table(phi.sparkSession)
    tagged = phi.join(F.broadcast(groups), "feature", "left").withColumn(
        "feature_group", F.coalesce("feature_group", F.lit("ungrouped")))
    per = tagged.groupBy("feature_group").agg(F.sum(F.abs("phi")).alias("total_abs"))
    w = Window.partitionBy(F.lit(0))
    return per.withColumn("share", F.col("total_abs") / F.sum("total_abs").over(w)).withColumn(
        "flagged", F.coalesce((F.col("feature_group") == "demographic_sensitive") & (F.col("share") > threshold), F.lit(False)))
