"""Per-row Shapley attributions of an MLlib GBT model (path-dependent TreeSHAP values).

The attribution of a tree is the Shapley value of
``v(S) = E[tree(x) | x_S]`` where features outside S are integrated out with
the training covers of the nodes (Lundberg et al., arXiv:1802.03888,
Algorithm 1). ``v`` is a sum over leaves of ``value x prod(step)``, where a
step is the row's branch indicator (feature in S) or the cover fraction
(feature not in S); by linearity each leaf's game is solved over the at most
``depth`` features on its path. This is vectorised over the rows of an Arrow
batch with numpy inside ``mapInPandas``.

The model's node table is read from the saved model (Parquet), so it is a
small broadcast (trees x nodes), never data rows. Values are in margin
space ``F``; MLlib's probability is ``1 / (1 + exp(-2F))``, so log-odds
attributions are ``2 * phi``.
"""

from __future__ import annotations

import os
import uuid
from math import factorial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def tree_table(spark: SparkSession, model) -> tuple[list, list]:
    """(trees, weights): per tree a dict of node arrays, read from the saved GBT model."""
    path = scratch_path(spark, f"gbt-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    stage = path
    data = spark.read.parquet(os.path.join(stage, "data")).select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        "nodeData.rawCount", F.col("nodeData.split.featureIndex").alias("feature"),
        F.try_element_at(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(1)).alias("threshold"))
    # Saved as (treeID, metadata, weight) tuples.
    meta = spark.read.parquet(os.path.join(stage, "treesMetadata")).select(F.col("_1").alias("treeID"), F.col("_3").alias("weight"))
    # Bounded: number of trees x nodes per tree (a 200-tree depth-3 model has 3000 rows).
    nodes = data.toPandas()
    weights = dict(meta.toPandas().values.tolist())
    trees = []
    for tid, g in nodes.groupby("treeID"):
        g = g.set_index("id").sort_index()
        trees.append({"id": g.index.to_numpy(), "value": g["prediction"].to_numpy(float),
                      "left": g["leftChild"].to_numpy(int), "right": g["rightChild"].to_numpy(int),
                      "cover": g["rawCount"].to_numpy(float), "feature": g["feature"].to_numpy(int),
                      "threshold": g["threshold"].astype(float).fillna(0.0).to_numpy(float), "tree": int(tid)})
    order = sorted(range(len(trees)), key=lambda i: trees[i]["tree"])
    return [trees[i] for i in order], [float(weights[trees[i]["tree"]]) for i in order]


def compile_tree(t: dict) -> dict:
    """Leaves with their paths: (feature, threshold, goes_left, cover fraction) per step."""
    pos = {nid: i for i, nid in enumerate(t["id"])}
    root = int(t["id"][0]) if 0 not in pos else 0
    leaves = []

    def walk(nid, path):
        i = pos[nid]
        if t["left"][i] < 0:
            leaves.append((t["value"][i], path))
            return
        cov = t["cover"][i] if t["cover"][i] > 0 else 1.0
        for child, left in ((t["left"][i], True), (t["right"][i], False)):
            frac = t["cover"][pos[child]] / cov
            walk(int(child), path + [(int(t["feature"][i]), float(t["threshold"][i]), left, frac)])

    walk(root, [])
    feats = sorted({f for _, p in leaves for f, _, _, _ in p})
    root_cover = t["cover"][pos[root]] if t["cover"][pos[root]] > 0 else 1.0
    expected = 0.0
    for value, p in leaves:
        w = 1.0
        for _, _, _, frac in p:
            w *= frac
        expected += w * value
    return {"leaves": leaves, "features": feats, "expected": expected, "root_cover": root_cover}


def _shapley_coefs(m: int) -> np.ndarray:
    return np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)]) if m else np.array([])


def shap_batch(X: np.ndarray, compiled: list, weights: list, n_features: int) -> np.ndarray:
    """Margin-space attributions (rows x features) of a weighted sum of trees.

    Shapley values are linear in the game, and a tree's game is the sum of
    its leaves' games; a leaf's game only involves the features on its path
    (at most the depth), every other feature is a null player there. So each
    leaf enumerates the subsets of its own path features only.
    """
    n = X.shape[0]
    phi = np.zeros((n, n_features))
    for t, w in zip(compiled, weights):
        for value, path in t["leaves"]:
            feats = sorted({f for f, _, _, _ in path})
            m = len(feats)
            if m == 0:
                continue
            col = {f: j for j, f in enumerate(feats)}
            # Per step: the row's branch indicator and the cover fraction.
            steps = [(col[f], ((X[:, f] <= thr) if left else ~(X[:, f] <= thr)).astype(float), frac)
                     for f, thr, left, frac in path]
            v = np.empty((1 << m, n))
            for s_mask in range(1 << m):
                lw = np.full(n, value)
                for j, ind, frac in steps:
                    lw = lw * (ind if (s_mask >> j) & 1 else frac)
                v[s_mask] = lw
            coefs = _shapley_coefs(m)
            for j, f in enumerate(feats):
                acc = np.zeros(n)
                for s_mask in range(1 << m):
                    if (s_mask >> j) & 1:
                        continue
                    acc += coefs[bin(s_mask).count("1")] * (v[s_mask | (1 << j)] - v[s_mask])
                phi[:, f] += w * acc
    return phi


def margin_batch(X: np.ndarray, compiled: list, weights: list) -> np.ndarray:
    """F(x) = sum of tree weight x leaf value, walking the same leaf paths."""
    out = np.zeros(X.shape[0])
    for t, w in zip(compiled, weights):
        for value, path in t["leaves"]:
            ind = np.ones(X.shape[0], dtype=bool)
            for f, thr, left, _ in path:
                ind &= (X[:, f] <= thr) if left else ~(X[:, f] <= thr)
            out += w * value * ind
    return out


def tree_attribution(df: DataFrame, model, features, key: str = "id", log_odds: bool = True) -> tuple[DataFrame, float]:
    """Long (key, feature, phi) for every row, and the expected value.

    ``phi`` is in log-odds (2 x margin) when ``log_odds``; the check
    ``sum(phi) + expected == margin`` holds in the same units.
    """
    spark = df.sparkSession
    trees, weights = tree_table(spark, model.stages[-1] if hasattr(model, "stages") else model)
    compiled = [compile_tree(t) for t in trees]
    scale = 2.0 if log_odds else 1.0
    expected = scale * sum(w * t["expected"] for t, w in zip(compiled, weights))
    bc = spark.sparkContext.broadcast((compiled, weights))
    feats = list(features)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("feature", T.StringType()),
                           T.StructField("phi", T.DoubleType())])

    def run(batches):
        import pandas as pd
        comp, wts = bc.value
        for pdf in batches:
            X = pdf[feats].to_numpy(dtype=float)
            phi = scale * shap_batch(X, comp, wts, len(feats))
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), len(feats)),
                                "feature": np.tile(np.array(feats, dtype=object), len(pdf)),
                                "phi": phi.reshape(-1)})

    return df.select(key, *feats).mapInPandas(run, schema), expected


def additivity_check(df: DataFrame, model, features, key: str = "id") -> DataFrame:
    """Per row: sum(phi) + expected versus the model's own raw margin (log-odds units)."""
    from pyspark.ml.functions import vector_to_array
    phi, expected = tree_attribution(df, model, features, key)
    sums = phi.groupBy(key).agg(F.sum("phi").alias("phi_sum"))
    raw = model.transform(df).select(key, (F.lit(2.0) * vector_to_array("rawPrediction")[1]).alias("margin"))
    return sums.join(raw, key).select(key, "phi_sum", F.lit(expected).alias("expected_value"), "margin",
                                      F.abs(F.col("phi_sum") + F.lit(expected) - F.col("margin")).alias("abs_error"))
