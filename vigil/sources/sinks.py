"""Sinks: tables, JSON reports and append-only audit tables.

Every write goes to a path the caller names (on a cluster: the shared
warehouse or checkpoint folder); helpers return the table read back so a job
can continue from durable data rather than from lineage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Overwrite (or append) a table, optionally partitioned."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.save(path)


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> DataFrame:
    """S2 for splits: one table, one folder per split value."""
    write_table(df, path, partition_by=split_col)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def json_reports(df: DataFrame, key: str, path: str | None = None) -> DataFrame:
    """S3: one JSON document per row (key, report); written as JSON lines when a path is given."""
    payload = [c for c in df.columns if c != key]
    out = df.select(F.col(key), F.to_json(F.struct(*payload)).alias("report"))
    if path:
        out.select("report").write.mode("overwrite").text(path)
    return out


def append_events(events: DataFrame, path: str, time_col: str = "created_at") -> DataFrame:
    """Append audit events, partitioned by event date; returns the table read back."""
    dated = events.withColumn("event_date", F.to_date(F.col(time_col)))
    # Clustered by (agent, phase) inside each date so lookups skip row groups by min/max (C4).
    sort_cols = [c for c in ("agent_name", "phase", time_col) if c in events.columns]
    # No repartition by date: a burst day stays spread over the writing tasks.
    dated.sortWithinPartitions("event_date", *sort_cols).write.mode("append").partitionBy("event_date").parquet(path)
    # Read back with the writer's schema: an empty append leaves no file to infer it from.
    return events.sparkSession.read.schema(dated.schema).parquet(path)


def natural_key_id(*cols):
    """Deterministic artifact id: sha2 over the natural key."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols]), 256)


def append_artifacts(frames: dict, path: str, key_cols: dict) -> DataFrame:
    """Rows of several artifact tables with different columns, one append.

    ``frames`` maps table name -> DataFrame; columns missing in one table are
    null (``unionByName(allowMissingColumns=True)``). Each row gets
    ``artifact_id`` = sha2 of its natural key and its ``table_name``.
    """
    tagged = [df.withColumn("table_name", F.lit(name)).withColumn("artifact_id", natural_key_id(*key_cols[name]))
              for name, df in frames.items()]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    merged.write.mode("append").partitionBy("table_name").parquet(path)
    return merged.sparkSession.read.schema(merged.schema).parquet(path)


def save_params(params: DataFrame, path: str) -> None:
    """S7 write: scaling parameters (column_name, mean, std)."""
    params.coalesce(1).write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    """S7 read."""
    return spark.read.parquet(path)


def artifact_key(kind, txn, path):
    """Object-store key type/txn/filename, 'global' without a transaction."""
    return F.concat_ws("/", F.col(kind), F.coalesce(F.col(txn), F.lit("global")),
                       F.element_at(F.split(F.col(path), "/"), -1))
