"""Model frame, gradient-boosted trees (MLlib), scoring chain and curriculum training.

The model is an MLlib ``PipelineModel`` (VectorAssembler + GBTClassifier):
training is distributed by MLlib, scoring is ``transform`` (JVM-side), and
probabilities leave the vector through ``vector_to_array``.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as FE
from . import quality as Q
from ..session import written
from .metrics import classification_metrics
from .preparation import VAL_PER_MILLE, AccountPreparation, AccountPreparationModel
from .sampling import hash_split

TARGET = FE.TARGET
# Model features: every account column except the key and the target, plus the two derived ones.
FEATURES = (["limit_bal", "sex", "education", "marriage", "age"] + Q.PAY_STATUS_COLUMNS
            + [f"bill_amt{i}" for i in range(1, 7)] + [f"pay_amt{i}" for i in range(1, 7)]
            + ["total_months_late", "utilization_rate"])
# Boosting settings of the reference runs (fixed values).
GBT_PARAMS = dict(stepSize=0.05, maxIter=200, maxDepth=3, subsamplingRate=0.9, seed=42)
FOREST_PARAMS = dict(numTrees=100, seed=42)
FOREST_ROWS_PER_PARTITION = 50_000


def model_frame(accounts: DataFrame, fit_on: str = "train", preparation: AccountPreparationModel | None = None) -> DataFrame:
    """L14 preparation: clean -> features -> split -> z-scale, by a fitted ``preparation`` or one fitted on these rows."""
    preparation = preparation or AccountPreparation(fitOn=fit_on).fit(accounts)
    df = hash_split(preparation.transform(accounts), "id", cuts=((VAL_PER_MILLE, "val"),))
    cols = [c for c in FEATURES if c in df.columns]
    return df.fillna(0.0, subset=cols).select("id", "split", *cols, F.col(TARGET).cast("int").alias(TARGET))


def model_sha256(model: PipelineModel, trees: tuple[list, list]) -> str:
    """Hash of what decides a model's scores: the preparation's fitted values, and the trees' nodes and weights."""
    nodes, weights = trees
    parts = {"preparation": [s.values() for s in model.stages if isinstance(s, AccountPreparationModel)], "weights": weights,
             "trees": [{k: v.tolist() for k, v in t.items() if k != "tree"} for t in nodes]}
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def require_features(df: DataFrame, features=FEATURES) -> None:
    """P2 (raise form) on the model side."""
    Q.require_columns(df, features)


def gbt_pipeline(features=FEATURES, label=TARGET, **overrides) -> Pipeline:
    params = {**GBT_PARAMS, **overrides}
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"),
                            GBTClassifier(featuresCol="features", labelCol=label, **params)])


def gbt_fit(df: DataFrame, features=FEATURES, label=TARGET, **overrides) -> PipelineModel:
    """Fit the boosted trees."""
    require_features(df, features)
    return gbt_pipeline(features, label, **overrides).fit(df)


def forest_pipeline(features=FEATURES, label=TARGET, **overrides) -> Pipeline:
    params = {**FOREST_PARAMS, **overrides}
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"),
                            RandomForestClassifier(featuresCol="features", labelCol=label, **params)])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """0/1 label and P(class 1)."""
    out = model.transform(df)
    return out.withColumn("p1", vector_to_array("probability")[1]).withColumn(
        "prediction", F.col("prediction").cast("int")).drop("features", "rawPrediction", "probability")


def oof_probabilities(df: DataFrame, folds: DataFrame, features=FEATURES, label=TARGET, k: int = 5,
                      **overrides) -> DataFrame:
    """L1: out-of-fold class probabilities from a 100-tree forest per fold.

    ``folds`` is (id, fold); each fit uses the other folds, scoring its own.
    Returns (id, label, p0, p1).
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import StorageLevel
    tagged = written(df.join(folds.select("id", "fold"), "id"), "tagged")
    # A forest keeps a row with its count in every tree, many times the size of the file, so a task gets a bounded number of rows.
    parts = -(-tagged.count() // FOREST_ROWS_PER_PARTITION)
    if parts > 1:
        tagged = tagged.repartition(parts, "id").sortWithinPartitions("id")
    tagged = tagged.persist(StorageLevel.MEMORY_AND_DISK)
    p = vector_to_array("probability")

    def one(f):
        model = forest_pipeline(features, label, **overrides).fit(tagged.where(F.col("fold") != f))
        scored = model.transform(tagged.where(F.col("fold") == f))
        return written(scored.select("id", F.col(label).alias("label"), p[0].alias("p0"), p[1].alias("p1")), "oof")

    # The k fits are independent: run them as concurrent Spark jobs.
    try:
        with ThreadPoolExecutor(max_workers=k) as pool:
            parts = list(pool.map(one, range(k)))
    finally:
        tagged.unpersist()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def evaluate(model: PipelineModel, val: DataFrame, label=TARGET) -> dict:
    """A10 on a validation frame."""
    scored = predict(model, val)
    return classification_metrics(scored.select(F.col(label).alias("label"), F.col("p1").alias("score")))
