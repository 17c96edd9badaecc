"""Exact ranks inside a few large groups, without one task per group.

``row_number() over (partition by label order by h)`` sends each label to a
single task: with two labels, half the table lands in one task. Here the
rows are range-partitioned on (group, order) across many tasks, each task
numbers its rows locally, and a small table of per-task counts (tasks x
groups rows) turns local numbers into global ranks. The sorted, numbered
rows are checkpointed to the shared checkpoint folder so both passes read
the same partitioning, also after an executor loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def rank_in_groups(df: DataFrame, groups, order, rank_col: str = "rank", partitions: int | None = None) -> DataFrame:
    """Add ``rank_col`` = 1-based position of each row within its group under ``order``.

    ``order`` must be a total order within a group (add a unique key).
    """
    groups = [groups] if isinstance(groups, str) else list(groups)
    order = [order] if isinstance(order, str) else list(order)
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in groups] + [o if not isinstance(o, str) else F.col(o) for o in order]
    numbered = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_local", F.monotonically_increasing_id()))
    # monotonically_increasing_id = (partition << 33) + index within partition.
    numbered = numbered.withColumn("_local", F.col("_local") - F.shiftleft(F.col("_pid").cast("bigint"), 33))
    numbered = written(numbered, "ranks")
    # Per (group, task): first local index and row count; tasks x groups rows.
    spans = numbered.groupBy(*groups, "_pid").agg(F.min("_local").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    # One row per (task, group): with many groups it grows with the data, so there is no broadcast hint. The planner
    # broadcasts it where its measured size allows, and else joins by (task, group), a key no hot group can fill.
    s = spans.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_pid").alias("_spid"),
                     "_first", "_offset")
    cond = [F.col("_pid") == F.col("_spid")] + [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    ranked = numbered.join(s, cond, "inner").drop("_spid", *[f"_g{i}" for i in range(len(groups))])
    ranked = ranked.withColumn(rank_col, (F.col("_offset") + F.col("_local") - F.col("_first") + 1).cast("bigint"))
    return ranked.drop("_pid", "_local", "_first", "_offset")


def prefix_sums(df: DataFrame, order, sum_cols, exclusive: bool = True, partitions: int | None = None) -> DataFrame:
    """Running sums of ``sum_cols`` in ``order`` over the whole table, without a global window.

    Rows are range-partitioned on the order and sorted inside each task; a
    task computes its local running sums (pandas ``cumsum`` over Arrow
    batches) and a table with one total per task gives each task its offset.
    Adds ``cum_<col>`` (sum of the rows before, or up to and including with
    ``exclusive=False``).
    """
    from pyspark import TaskContext
    from pyspark.sql import types as T

    order = [order] if isinstance(order, str) else list(order)
    sum_cols = [sum_cols] if isinstance(sum_cols, str) else list(sum_cols)
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    fields = list(df.schema.fields) + [T.StructField("_pid", T.IntegerType())] + \
        [T.StructField(f"_loc_{c}", T.DoubleType()) for c in sum_cols]
    excl = exclusive

    def local(batches):
        pid = TaskContext.get().partitionId()
        carry = {c: 0.0 for c in sum_cols}
        for pdf in batches:
            extra = {"_pid": pid}
            for c in sum_cols:
                v = pdf[c].astype("float64").fillna(0.0)
                cs = v.cumsum() + carry[c]
                carry[c] = float(cs.iloc[-1]) if len(cs) else carry[c]
                extra[f"_loc_{c}"] = cs - v if excl else cs
            yield pdf.assign(**extra)

    staged = written(ordered.mapInPandas(local, T.StructType(fields)), "sums")
    totals = staged.groupBy("_pid").agg(*[F.sum(F.col(c).cast("double")).alias(f"_tot_{c}") for c in sum_cols])
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_tot_{c}").over(w), F.lit(0.0)).alias(f"_off_{c}")
                                      for c in sum_cols])
    # One row per task: bounded.
    out = staged.join(F.broadcast(offsets), "_pid", "left")
    return out.select(*df.columns, *[(F.col(f"_loc_{c}") + F.coalesce(F.col(f"_off_{c}"), F.lit(0.0))).alias(f"cum_{c}")
                                     for c in sum_cols])
