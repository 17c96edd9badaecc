"""Curriculum plan, gradient-boosted fits per phase, and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Curriculum schedule (fixed values): epochs per phase.
PHASES = [("high_only", 3), ("high_plus_sample", 3), ("high_plus_all", 4)]
LOW_SAMPLE_PERCENT = 30
ROWS_PER_PARTITION = 200_000


def curriculum_plan(spark: SparkSession, seg: DataFrame, sampled_low: DataFrame) -> DataFrame:
    """One row per epoch with the rows it trains on.

    Only three distinct datasets exist (high, high + sample, high + low); the
    counts come from one aggregate each, the ten epochs from a 10-row range.
    """
    c = seg.agg(F.count_if(F.col("segment") == "high").alias("nh"),
                F.count_if(F.col("segment") == "low").alias("nl")).first()
    ns = sampled_low.count()
    low_for = {"high_only": 0, "high_plus_sample": ns, "high_plus_all": c["nl"]}
    bounds, start = [], 0
    for phase, n in PHASES:
        bounds.append((start, start + n, phase))
        start += n
    r = F.col("id")
    phase = None
    for lo, hi, name in bounds:
        phase = F.when(r < hi, name) if phase is None else phase.when(r < hi, name)
    low = None
    for _, hi, name in bounds:
        low = F.when(r < hi, F.lit(low_for[name])) if low is None else low.when(r < hi, F.lit(low_for[name]))
    epochs = spark.range(start).select((r + 1).cast("int").alias("epoch"), phase.alias("phase"),
                                       F.lit(c["nh"]).cast("bigint").alias("n_high"), low.cast("bigint").alias("n_low"))
    return epochs.withColumn("n_rows", F.col("n_high") + F.col("n_low"))


def curriculum_datasets(seg: DataFrame, percent: int = LOW_SAMPLE_PERCENT) -> dict:
    """The three distinct training sets of the ten epochs (U1 unions)."""
    from .sampling import sample_exact
    high = seg.where(F.col("segment") == "high")
    low = seg.where(F.col("segment") == "low")
    sample = sample_exact(low, percent)
    return {"high_only": high, "high_plus_sample": high.unionByName(sample), "high_plus_all": high.unionByName(low)}


def curriculum_train(spark: SparkSession, seg: DataFrame, val: DataFrame, features, label: str,
                     percent: int = LOW_SAMPLE_PERCENT, **gbt_overrides):
    """One fit per epoch on its phase's rows, seeded by the epoch (``seed`` + epoch - 1), validated on ``val``.

    Subsampling is seeded per partition, so rows are hashed on ``id`` to a number of partitions that follows from
    the row count alone and ordered inside: the same rows give the same model on any cluster.
    Returns (epochs DataFrame, {epoch: model}, best epoch: highest AUC, the first on ties).
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import StorageLevel

    from .boosting import gbt_fits
    from .model import GBT_PARAMS, evaluate, require_features

    params = {**GBT_PARAMS, **gbt_overrides}
    seed = params.pop("seed")
    val = val.persist(StorageLevel.MEMORY_AND_DISK)
    staged, rows_of, seeds_of, epoch = {}, {}, {}, 0
    datasets = curriculum_datasets(seg, percent)
    for phase, count in PHASES:
        data = datasets[phase]
        require_features(data, features)
        rows_of[phase] = data.count()
        parts = max(2, -(-rows_of[phase] // ROWS_PER_PARTITION))
        staged[phase] = data.repartition(parts, "id").sortWithinPartitions("id").persist(StorageLevel.MEMORY_AND_DISK)
        seeds_of[phase] = list(range(seed + epoch, seed + epoch + count))
        epoch += count

    phases = [phase for phase, count in PHASES for _ in range(count)]
    # The fits are independent, so they grow together: a job adds up a tree level of all ten.
    models = gbt_fits([(staged[phase], seeds_of[phase]) for phase, _ in PHASES], features, label, **params)

    def evaluate_one(epoch, phase, model):
        m = evaluate(model, val, label)
        return model, (epoch, phase, rows_of[phase], m["accuracy"], m["f1"], m["roc_auc"])

    with ThreadPoolExecutor(max_workers=len(phases)) as pool:
        done = list(pool.map(evaluate_one, range(1, len(phases) + 1), phases, models))
    for data in [*staged.values(), val]:
        data.unpersist()
    rows = [row for _, row in done]
    epochs = spark.createDataFrame(rows, "epoch int, phase string, n_rows bigint, val_acc double, val_f1 double, "
                                         "val_roc_auc double")
    best = max(rows, key=lambda r: (r[5] if r[5] is not None else -1.0, -r[0]))
    return epochs, {row[0]: model for model, row in done}, best[0]


def best_epoch(epochs: DataFrame) -> DataFrame:
    """The epoch with the highest validation AUC, the first on ties."""
    from pyspark.sql import Window
    w = Window.orderBy(F.col("val_roc_auc").desc_nulls_last(), F.col("epoch"))
    return epochs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
