"""Order-insensitive dataset fingerprints (F4-F6) as a bounded-fan-in hash tree.

Row hash = SHA-256 of the canonical row. Equal rows are counted first, before any
list is made, so the leaves are (row hash, count) and a table of equal rows has
one. Level 1 groups leaves by the hash's first six hex digits and hashes the
sorted concatenation; level 2 groups
those by three hex digits; the root hashes the level-2 hashes in order. Every
group is a shuffle partition's worth of small strings (about n / 16.7M rows at
level 1, at most 4096 children above), so no group grows with the table the
way a single sorted concatenation would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import canonical_row

LEVEL1_DIGITS = 6
LEVEL2_DIGITS = 3


def _sorted_hash(col: str):
    return F.sha2(F.array_join(F.array_sort(F.collect_list(col)), ""), 256)


def row_hashes(df: DataFrame, columns=None, scale: int = 6) -> DataFrame:
    return df.select(F.sha2(canonical_row(df, columns, scale), 256).alias("h"))


def fingerprint(df: DataFrame, columns=None, scale: int = 6) -> DataFrame:
    """one-row (fingerprint, row_count)."""
    h = row_hashes(df, columns, scale)
    leaves = h.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    l1 = leaves.select(F.concat_ws(":", "h", "n").alias("leaf"), "h", "n").groupBy(F.substring("h", 1, LEVEL1_DIGITS).alias("b")).agg(
        _sorted_hash("leaf").alias("bh"), F.sum("n").alias("n"))
    l2 = l1.groupBy(F.substring("b", 1, LEVEL2_DIGITS).alias("b2")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "bh"))), lambda s: s["bh"]), ""),
               256).alias("b2h"), F.sum("n").alias("n"))
    return l2.agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b2", "b2h"))), lambda s: s["b2h"]), ""),
               256).alias("fingerprint"), F.sum("n").cast("bigint").alias("row_count"))
