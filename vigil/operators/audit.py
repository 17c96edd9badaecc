"""Audit tables: constraints, lookups, payload fields, metrics, as-of model lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import exact_quantile_cont, non_null_counts

# Declared constraints of the audit store (fixed values).
PRIMARY_KEYS = {"audit_event": ["event_id"], "evidence_pointer": ["evidence_id"], "event_link": ["link_id"]}
NOT_NULL = {
    "audit_event": ["event_id", "created_at", "agent_name", "phase", "event_type"],
    "evidence_pointer": ["evidence_id", "created_at", "kind", "dvc_path"],
    "event_link": ["link_id", "event_id"],
}
LINK_TARGETS = ["policy_id", "dataset_id", "evidence_id"]


def payload_field(payload="extra_payload", field="k"):
    """one field of the JSON payload (as text)."""
    return F.get_json_object(F.col(payload), f"$.{field}")


def unique_violations(tables: dict) -> DataFrame:
    """Per table and key, the number of key values held by more than one row."""
    parts = []
    for name, df in tables.items():
        keys = PRIMARY_KEYS[name]
        dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        parts.append(dup.agg(F.count(F.lit(1)).alias("duplicate_keys")).select(
            F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"), "duplicate_keys"))
    return reduce(DataFrame.unionByName, parts)


def not_null_violations(tables: dict) -> DataFrame:
    """Nulls in NOT NULL columns, one aggregate per table, long form."""
    parts = []
    for name, df in tables.items():
        cols = NOT_NULL[name]
        agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        parts.append(agg.select(F.explode(F.array(*[
            F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col(c).alias("null_count"))
            for c in cols])).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, parts)


def link_check_violations(links: DataFrame) -> DataFrame:
    """Links that point at nothing."""
    return links.where(F.coalesce(*[F.col(c) for c in LINK_TARGETS]).isNull())


def fk_violations(links: DataFrame, parents: dict) -> DataFrame:
    """Link keys without a parent row (nulls are allowed), via left anti joins."""
    parts = []
    for column, (parent, parent_key) in parents.items():
        keys = parent.select(F.col(parent_key).alias(column)).distinct()
        bad = links.where(F.col(column).isNotNull()).join(keys, column, "left_anti")
        parts.append(bad.select("link_id", F.lit(column).alias("fk_column"), F.col(column).alias("value")))
    return reduce(DataFrame.unionByName, parts)


def latest_by_time(evidence: DataFrame, kind: str = "TRAINED_MODEL") -> DataFrame:
    """Newest evidence of a kind (ties by id): a TakeOrdered of one row."""
    return (evidence.where(F.col("kind") == kind)
            .orderBy(F.col("created_at").desc(), F.col("evidence_id").desc()).limit(1))


def as_of_latest(facts: DataFrame, fact_time: str, events: DataFrame, event_time: str, event_value: str,
                 out: str) -> DataFrame:
    """J4 batch form: for every fact, the newest event value at or before its time.

    Facts and events are tagged, unioned and range-partitioned on time, so
    every task holds one contiguous time slice (a burst of rows at one time
    spreads over several tasks). Each task forward-fills the event value
    through its sorted slice (``mapInPandas``); the value carried into a
    slice comes from a table with one row per task. No pairs are formed.
    Ties: events at a fact's own time count; among events at one time the
    largest value wins.
    """
    import pandas as pd
    from pyspark import TaskContext
    from pyspark.sql import types as T

    from ..session import written

    spark = facts.sparkSession
    cols = facts.columns
    fx = facts.select(*cols, F.col(fact_time).alias("_t"), F.lit(1).alias("_tag"), F.lit(None).cast("string").alias("_v"))
    ev = events.select(*[F.lit(None).cast(t).alias(c) for c, t in facts.dtypes], F.col(event_time).alias("_t"),
                       F.lit(0).alias("_tag"), F.col(event_value).cast("string").alias("_v"))
    merged = fx.unionByName(ev)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = merged.repartitionByRange(n, "_t", "_tag", "_v").sortWithinPartitions("_t", "_tag", "_v")
    schema = T.StructType(merged.schema.fields + [T.StructField("_pid", T.IntegerType()),
                                                  T.StructField("_in", T.StringType())])

    def fill(batches):
        pid = TaskContext.get().partitionId()
        last = None
        for pdf in batches:
            v = pdf["_v"].where(pdf["_tag"] == 0)
            filled = v.ffill()
            if last is not None:
                filled = filled.fillna(last)
            if len(filled) and filled.iloc[-1] is not None and not pd.isna(filled.iloc[-1]):
                last = filled.iloc[-1]
            yield pdf.assign(_pid=pid, _in=filled.where(filled.notna(), None))

    staged = written(ordered.mapInPandas(fill, schema), "filled")
    # Last event value per task, then the value carried into each task.
    tails = staged.where(F.col("_tag") == 0).groupBy("_pid").agg(
        F.max_by("_v", F.struct("_t", "_v")).alias("_tail"))
    pids = spark.range(n).select(F.col("id").cast("int").alias("_pid"))
    wc = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = pids.join(tails, "_pid", "left").withColumn(
        "_carry", F.last("_tail", ignorenulls=True).over(wc)).select("_pid", "_carry")
    # One row per task: a bounded broadcast.
    return (staged.where(F.col("_tag") == 1).join(F.broadcast(carry), "_pid", "left")
            .select(*cols, F.coalesce("_in", "_carry").alias(out)))


def ops_metrics(events: DataFrame, pass_threshold: float = 0.7) -> DataFrame:
    """Event and error counts, policy pass rate, exact p95 latency, span."""
    is_policy = F.col("event_type") == "POLICY_EVALUATION_COMPLETED"
    conf = payload_field().cast("double") / 100
    base = events.agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "ERROR").alias("n_errors"),
        F.count_if(is_policy).alias("policy_checks"),
        F.avg(F.when(is_policy, (conf >= F.lit(pass_threshold)).cast("double"))).alias("policy_pass_rate"),
        (F.unix_micros(F.max(F.col("created_at").cast("timestamp")))
         - F.unix_micros(F.min(F.col("created_at").cast("timestamp")))).alias("_span"))
    n = non_null_counts(events, ["latency_ms"])["latency_ms"]
    p95 = exact_quantile_cont(events, "latency_ms", 0.95, n)
    return base.select("n_events", "n_errors", "policy_checks", "policy_pass_rate",
                       F.lit(p95).cast("double").alias("latency_p95_ms"),
                       (F.col("_span") / 1e6).alias("span_seconds"))


def agent_activity(events: DataFrame) -> DataFrame:
    """Events per (transaction, agent)."""
    return events.groupBy("client_transaction_id", "agent_name").agg(F.count(F.lit(1)).alias("event_count"))


def event_timeline(events: DataFrame, limit: int = 10) -> DataFrame:
    """First ``limit`` events of every transaction by (time, id).

    ``row_number() <= limit`` lets Spark insert a partial WindowGroupLimit
    before the shuffle, so a hot transaction ships at most ``limit`` rows per
    map task.
    """
    w = Window.partitionBy("client_transaction_id").orderBy("created_at", "event_id")
    return events.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def run_status(events: DataFrame) -> DataFrame:
    """C20: outcome events per agent: success versus ERROR / *_FAILED."""
    failed = (F.col("event_type") == "ERROR") | F.col("event_type").endswith("_FAILED")
    return events.groupBy("agent_name").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(failed).alias("failures"),
        F.count_if(~failed).alias("successes"))


def trace_rollup(events: DataFrame) -> DataFrame:
    """Per trace id: time span, event count, sorted distinct phases."""
    return events.groupBy("trace_id").agg(
        F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
        F.count(F.lit(1)).alias("event_count"),
        F.array_join(F.array_sort(F.collect_set("phase")), ",").alias("phases")).withColumn(
        "duration_seconds",
        (F.unix_micros(F.col("last_at").cast("timestamp")) - F.unix_micros(F.col("first_at").cast("timestamp"))) / 1e6)
