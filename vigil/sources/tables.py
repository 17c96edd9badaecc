"""Readers for the driver's parquet tables and for account files.

Reads are plain ``spark.read.parquet``: Catalyst prunes columns and pushes
filters into the scan, so callers select only what they use.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, e.g. ``table(spark, "/root/testdata/sf0.01", "orders")``."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    return spark.read.parquet(path)


def in_file_order(scan: DataFrame, name: str = "position") -> DataFrame:
    """A scan of files with ``name``: a struct that orders its rows as they stand in the input (file, start of the split, row).

    Two rows are compared by the last part only within one split, which one task reads from start to end, so the order doesn't
    depend on how the scan is divided. It has to stand right on the scan.
    """
    return scan.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias(name))


# Raw account schema of the credit table: integers everywhere except the
# credit limit (fixed values from the account feature configuration).
RAW_ACCOUNT_COLUMNS = (
    ["ID", "LIMIT_BAL", "SEX", "EDUCATION", "MARRIAGE", "AGE",
     "PAY_0", "PAY_2", "PAY_3", "PAY_4", "PAY_5", "PAY_6"]
    + [f"BILL_AMT{i}" for i in range(1, 7)]
    + [f"PAY_AMT{i}" for i in range(1, 7)]
    + ["default_payment_next_month"]
)


def account_schema(columns=RAW_ACCOUNT_COLUMNS) -> T.StructType:
    fields = []
    for c in columns:
        if c == "LIMIT_BAL":
            dtype = T.DoubleType()
        elif c == "default_payment_next_month":
            dtype = T.IntegerType()
        else:
            dtype = T.LongType()
        fields.append(T.StructField(c, dtype, True))
    return T.StructType(fields)


def read_accounts_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """S1 for the reference's CSV layout: explicit schema, header, no inference.

    A missing path raises, as the reference's loader does.
    """
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
    reader = reader.option("ignoreTrailingWhiteSpace", True)
    return reader.schema(schema or account_schema()).csv(path)
