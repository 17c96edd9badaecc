"""Derived features, class balance and z-scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_positive, safe_ratio
from . import quality as Q

TARGET = "default_payment_next_month"
# Numeric columns that are scaled, then the engineered ones (fixed lists).
NUMERIC_COLUMNS = (["limit_bal", "age"] + Q.PAY_STATUS_COLUMNS
                   + [f"bill_amt{i}" for i in range(1, 7)] + [f"pay_amt{i}" for i in range(1, 7)])
ENGINEERED_COLUMNS = ["utilization_rate", "total_months_late"]
IMBALANCE_RATIO = 1.1


def add_months_late(df: DataFrame, columns=Q.PAY_STATUS_COLUMNS) -> DataFrame:
    """total_months_late = number of repayment-status columns > 0."""
    return df.withColumn("total_months_late", count_positive(Q.present(df, columns)))


def add_utilization(df: DataFrame, bill="bill_amt1", limit="limit_bal") -> DataFrame:
    """utilization_rate = latest bill / credit limit (null when the limit is 0)."""
    return df.withColumn("utilization_rate", safe_ratio(F.col(bill).cast("double"), F.col(limit).cast("double")))


def clean_accounts(df: DataFrame) -> DataFrame:
    """The cleaning chain of the assurance job."""
    out = Q.trim_columns(df)
    out = Q.recode_categories(out)
    out = Q.clip_pay(out)
    return Q.impute_missing(out)


def engineer(df: DataFrame) -> DataFrame:
    """F1 + F2."""
    return add_utilization(add_months_late(df))


def class_balance(df: DataFrame, target=TARGET, by=None) -> DataFrame:
    """A1: rows and percentage per class (optionally within groups ``by``).

    The total per group comes from a window over the already grouped rows
    (a handful per group), not over the table.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    counts = df.groupBy(*by, target).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(w), 6))


def imbalance(df: DataFrame, target=TARGET, threshold=IMBALANCE_RATIO) -> DataFrame:
    """A2: rows of the largest class / rows of the smallest, and whether it exceeds the threshold."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.round(F.max("n").cast("double") / F.min("n"), 6).alias("imbalance_ratio"),
                      F.count(F.lit(1)).alias("n_classes")).withColumn(
        "is_imbalanced", F.col("imbalance_ratio") > F.lit(threshold))


def label_domain(df: DataFrame, label="label") -> DataFrame:
    """A5: distinct labels (one row each); ``require_two_labels`` raises below two."""
    return df.select(label).where(F.col(label).isNotNull()).distinct()


def require_two_labels(df: DataFrame, label="label") -> int:
    n = df.agg(F.count_distinct(label)).first()[0]
    if n < 2:
        raise ValueError(f"need at least two classes in {label!r}, found {n}")
    return n


def scale_columns(df: DataFrame, columns=None) -> list[str]:
    return Q.present(df, columns or (NUMERIC_COLUMNS + ENGINEERED_COLUMNS))


def zscore_fit(df: DataFrame, columns=None) -> DataFrame:
    """A3: mean and sample std of every scaled column, in one aggregate, long form."""
    cols = scale_columns(df, columns)
    wide = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                  *[F.stddev_samp(c).alias(f"s_{i}") for i, c in enumerate(cols)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"m_{i}").alias("mean"), F.col(f"s_{i}").alias("std"))
        for i, c in enumerate(cols)])).alias("p")).select("p.*")


def zscore_params(params: DataFrame) -> dict:
    """S7 read: the parameter table is one row per column, so it is bounded."""
    return {r["column_name"]: (r["mean"], r["std"]) for r in params.collect()}


def zscore_transform(df: DataFrame, params) -> DataFrame:
    """A4: (x - mean) / std with fitted or saved parameters; std 0 gives null."""
    p = zscore_params(params) if isinstance(params, DataFrame) else params
    exprs = {}
    for c, (mean, std) in p.items():
        if c in df.columns:
            exprs[c] = F.try_divide(F.col(c).cast("double") - F.lit(mean), F.lit(std))
    return df.withColumns(exprs)


def dataset_profile(df: DataFrame, split_col="split") -> DataFrame:
    """Row and column count per split group."""
    ncols = len([c for c in df.columns if c != split_col])
    return df.groupBy(F.col(split_col).alias("split_group")).agg(
        F.count(F.lit(1)).alias("row_count")).withColumn("col_count", F.lit(ncols))
