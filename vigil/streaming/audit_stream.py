"""Streaming audit ingest (W1): events arrive as files in any order, repeats are
dropped by event id however late they come, every micro-batch is appended to the
audit table and escalations are emitted for low-confidence policy decisions.

The table is partitioned by event date and, within a day, by batch. A repeat has
the event's own time, so a batch is compared with the stored ids of its days
only, and the scan lists no other day's files; no event is dropped for its age.
When two deliveries of one id in a batch disagree, the least by time and then
by the other columns in order is kept; against a stored event of the same day the
stored one stays.

``trigger(availableNow=True)`` processes what is there and stops, so the same
code serves tests, backfills and scheduled runs; the checkpoint folder makes
it restartable after a failure (exactly-once file source + idempotent
per-batch writes keyed by batch id).
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.audit import payload_field
from ..operators.quality import dedupe_keep_first
from ..functions.columns import escalation_id

MIN_CONFIDENCE = 0.7


def escalations_from_events(batch: DataFrame) -> DataFrame:
    """Escalation records for policy evaluations below the confidence threshold."""
    conf = payload_field().cast("double") / 100
    low = batch.where((F.col("event_type") == "POLICY_EVALUATION_COMPLETED") & (conf < F.lit(MIN_CONFIDENCE)))
    return low.select(escalation_id("client_transaction_id", "created_at").alias("escalation_id"), "event_id",
                      "client_transaction_id", conf.alias("confidence"), F.lit("Human review required").alias("action"),
                      F.col("created_at").cast("timestamp_ntz").alias("escalated_at"))


def stored(spark: SparkSession, sink_dir: str, schema: T.StructType, days: list | None = None) -> DataFrame:
    """The stored events with event_date and batch, of these days (None among them: events without a time) or of all.
    Without a table yet there are none."""
    full = T.StructType([*schema.fields, T.StructField("event_date", T.DateType()), T.StructField("batch", T.LongType())])
    try:
        out = spark.read.schema(full).parquet(sink_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)
    if days is None:
        return out
    dated = [d for d in days if d is not None]
    wanted = F.col("event_date").isin(dated) if dated else F.lit(False)
    return out.where(wanted | F.col("event_date").isNull() if None in days else wanted)


def run(spark: SparkSession, source_dir: str, schema, sink_dir: str, escalation_dir: str, checkpoint: str) -> None:
    """Drain the source folder once (available-now) into the two sinks."""
    stream = spark.readStream.schema(schema).parquet(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, batch_id, schema, sink_dir, escalation_dir)

    q = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def append_batch(batch: DataFrame, batch_id: int, schema, sink_dir: str, escalation_dir: str) -> None:
    """One micro-batch; running a batch id again replaces what it wrote with the same rows."""
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c not in ("event_id", "created_at")]
    rows = dedupe_keep_first(batch, ["event_id"], ["created_at", *rest]).withColumn("event_date", F.to_date("created_at"))
    days = [r[0] for r in batch.select(F.to_date("created_at")).distinct().collect()]  # one row per day of the batch
    known = stored(spark, sink_dir, schema, days).where(F.col("batch") != batch_id).select("event_id")
    rows = rows.join(known, "event_id", "left_anti").withColumn("batch", F.lit(batch_id).cast("long"))
    # A day's folder of this batch is overwritten, all others stay.
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch").parquet(sink_dir)
    new = stored(spark, sink_dir, schema, days).where(F.col("batch") == batch_id)
    escalations_from_events(new).write.mode("overwrite").parquet(os.path.join(escalation_dir, f"batch={batch_id}"))


def compact(spark: SparkSession, sink_dir: str, schema, target_dir: str, rows_per_file: int = 5_000_000) -> None:
    """A copy of the table with one batch folder per day (the day's last batch id), for readers and later batches to
    switch to; the table itself stays as it is, so a broken-off compaction leaves nothing half done."""
    events = stored(spark, sink_dir, schema)
    last = events.groupBy(F.col("event_date").alias("_day")).agg(F.max("batch").alias("_last"))  # one row per day
    merged = events.join(last, F.col("event_date").eqNullSafe(F.col("_day"))).select(*schema.names, "event_date", F.col("_last").alias("batch"))
    merged.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("event_date", "batch").parquet(target_dir)
