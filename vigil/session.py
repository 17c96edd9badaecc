"""Spark session defaults shared by jobs, tests and the bench.

Everything that changes results (time zone, ANSI arithmetic) is pinned here.
Everything that only changes speed (AQE, skew handling, partition sizes) is
set to values that hold on a large cluster; local runs only lower the
shuffle partition count.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that fix the meaning of a query.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Settings that only steer the physical plan.
PHYSICAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Post-shuffle partitions are coalesced towards this size; on a cluster set
    # spark.sql.shuffle.partitions to about (shuffled bytes / 256 MB) and let AQE merge.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    # Auto-broadcast stays on with Spark's 10 MB bound; explicit broadcasts in
    # this package are only used for sides with a fixed size (rule tables).
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "vigil", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the package defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SEMANTIC_CONF, **PHYSICAL_CONF}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    apply_semantics(spark)
    return spark


def apply_semantics(spark: SparkSession) -> None:
    """Pin the result-defining settings on a session we did not build."""
    for key, value in SEMANTIC_CONF.items():
        spark.conf.set(key, value)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    On a cluster this comes from ``spark.checkpoint.dir`` (a shared file
    system). Only when the session names none (local tests) do we create a
    scratch folder and register it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="vigil-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in the shared folder: later steps and lost executors read it instead of repeating the plan.

    Unlike ``checkpoint()``, which runs the last stage once to count and once more to save, this runs every stage once.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a written intermediate."""
    return os.path.join(checkpoint_dir(spark), name)
