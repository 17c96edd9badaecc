"""Boosted trees of several fits at once: one Spark job per tree level grows the trees of all fits.

MLlib's ``GBTClassifier`` runs a job per level for every fit of its own. Here the fits advance together: rows are binned
once and held as blocks of bounded size, a level's job adds up (count, sum, sum of squares) per fit, node, feature and bin,
and only these sums reach the driver, which picks the splits. The method is MLlib's (its thresholds, draws, gains, leaves
and losses), and so is the result: a ``GBTClassificationModel``. Draws come from ``rand`` over the same partitions and are
MLlib's own; splits of equal gain may fall differently where rounding does. Only where there are more than 10,000 rows do the thresholds differ: MLlib takes them from a sample of about
that many rows, and so does this, but from another sample.
"""

from __future__ import annotations

import json
import os
import pickle
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, written

BINS, SAMPLE_ROWS = 32, 10_000
#: Rows of a block, which is what one task reads; sums of so many tasks meet in one; trees after which the margins are stored anew.
BLOCK_ROWS, FAN, REFRESH = 65_536, 64, 5
DRAWS_PER_WORD = 62
EPSILON = 2.220446049250313e-16
ALWAYS_LEFT = (0, 255)


def thresholds(values: np.ndarray, expected: float, n_splits: int) -> list[float]:
    """MLlib's thresholds of a feature: halfway between values, all of them or about every ``expected / (n_splits + 1)`` rows."""
    value, count = np.unique(values[values != 0.0], return_counts=True)
    if not len(value):
        return []
    zeros = expected - count.sum()
    if zeros > EPSILON * count.sum() * 100:
        at = np.searchsorted(value, 0.0)
        value, count = np.insert(value, at, 0.0), np.insert(count.astype(float), at, zeros)
    middle = (value[:-1] + value[1:]) / 2.0
    if len(middle) <= n_splits:
        return middle.tolist()
    out, stride = [], expected / (n_splits + 1)
    target, sums = stride, np.cumsum(count)
    for before, after, cut in zip(sums[:-1].tolist(), sums[1:].tolist(), middle.tolist()):
        if abs(before - target) < abs(after - target):
            out.append(cut)
            target += stride
    return out


def _find_thresholds(rows: DataFrame, n: int, seeds: list[int], features: list[str]) -> list[list[list[float]]]:
    """Per seed and feature its thresholds, found feature by feature in the tasks; all seeds share them if all rows are taken."""
    n_splits = min(BINS, n) - 1
    fraction = SAMPLE_ROWS / n if n > SAMPLE_ROWS else 1.0
    takers = [0] if fraction == 1.0 else seeds
    taken = F.array(*[F.when((F.rand(s << 20) < fraction) if fraction < 1.0 else F.lit(True), F.lit(k)) for k, s in enumerate(takers)])
    values = rows.select(F.array(*features).alias("x"), F.explode(F.array_compact(taken)).alias("fit")).select("fit", F.posexplode("x").alias("feature", "value"))

    def of_feature(pdf):
        import pandas as pd
        return pd.DataFrame({"fit": pdf["fit"][:1], "feature": pdf["feature"][:1], "cuts": [thresholds(pdf["value"].to_numpy(), fraction * n, n_splits)]})

    found = {(r.fit, r.feature): r.cuts for r in values.groupBy("fit", "feature").applyInPandas(of_feature, "fit int, feature int, cuts array<double>").collect()}
    return [[found.get((k, i), []) for i in range(len(features))] for k in range(len(takers))]


def _encode(cuts: list[list[list[float]]], n_features: int, n_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (part, label, features, words of draws) as pickled blocks: bins of each feature, label as -1 or 1, draws."""
    def block(part: int, number: int, x: list[np.ndarray]) -> pa.RecordBatch:
        y = x[0]
        if not np.isin(y, (0.0, 1.0)).all():
            raise ValueError("labels must be 0 or 1")
        bins = [np.stack([np.searchsorted(c, v).astype(np.uint8) for c, v in zip(of, x[1:1 + n_features])]) for of in cuts]
        data = pickle.dumps((bins, 2.0 * y - 1.0, np.stack(x[1 + n_features:])), protocol=5)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([data], pa.binary())], names=["part", "block", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, part, number = [], 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            n += batch.num_rows
            while n >= BLOCK_ROWS:
                x = [np.concatenate(c) for c in zip(*held)]
                yield block(part, number, [c[:BLOCK_ROWS] for c in x])
                held, n, number = [[c[BLOCK_ROWS:] for c in x]], n - BLOCK_ROWS, number + 1
        if n:
            yield block(part, number, [np.concatenate(c) for c in zip(*held)])

    return run


def _blocks(rows: DataFrame, n: int, seeds: list[int], max_iter: int, rate: float, features: list[str], label: str) -> tuple[DataFrame, list]:
    """(written blocks, thresholds per seed) of one set of rows."""
    rows = rows.select(F.col(label).cast("double").alias("_label"), *[F.col(c).cast("double").alias(c) for c in features])
    cuts = _find_thresholds(rows, n, seeds, features)
    # Tree m of a fit draws by seed + m, counted up by the partition: rand(seed) does so too, from one below.
    draws = [(F.rand(s + 1) < F.lit(rate)).cast("bigint") for s in range(min(seeds), max(seeds) + max_iter)]
    words = []
    for at in range(0, len(draws), DRAWS_PER_WORD):
        word = F.lit(0).cast("bigint")
        for k, d in enumerate(draws[at:at + DRAWS_PER_WORD]):
            word = word.bitwiseOR(F.shiftleft(d, k))
        words.append(word.alias(f"_draws{at}"))
    tagged = rows.select(F.spark_partition_id().alias("_part"), "_label", *features, *words)
    encoded = tagged.mapInArrow(_encode(cuts, len(features), len(words)), "part int, block int, data binary")
    return written(encoded, "blocks"), cuts


def _route(bins: np.ndarray, levels: list[list[tuple[int, int]]]) -> np.ndarray:
    """The node of the last level that each row comes to, by (feature, last bin that goes left) of every node."""
    at = np.zeros(bins.shape[1], np.uint8)
    for nodes in levels:
        right = bins[nodes[0][0]] > nodes[0][1]
        for j, (feature, last) in enumerate(nodes[1:], 1):
            right = np.where(at == j, bins[feature] > last, right)
        at = 2 * at + right
    return at


def _margins(block: tuple, recent: dict) -> dict[int, np.ndarray]:
    """F(x) of each fit of a block's rows: what is stored, and the trees since."""
    _, bins, _, _, stored = block
    out = {}
    for k, (fit, margin) in enumerate(stored.items()):
        for weight, levels, values in recent[fit]:
            margin = margin + values[_route(bins[k if len(bins) > 1 else 0], levels)] * weight
        out[fit] = margin
    return out


def _advance(recent: dict) -> Callable:
    return lambda block: (*block[:4], _margins(block, recent))


def _level_sums(m: int, offsets: list[int], width: int, recent: dict, growing: dict) -> Callable:
    """Per fit: count, sum and sum of squares of the residuals by feature, open node and bin. offsets: each fit's first draw among its block's."""
    def run(index: int, blocks: Iterator[tuple]) -> Iterator[tuple]:
        for block in blocks:
            _, bins, y, draws, stored = block
            out, margins = {}, _margins(block, {f: recent[f] if f in growing else [] for f in stored})
            for k, fit in enumerate(stored):
                if fit not in growing:
                    continue
                b, (levels, is_open) = bins[k if len(bins) > 1 else 0], growing[fit]
                # Rounded once, as MLlib's exp nearly always is: splits of equal gain then fall alike.
                label = 4.0 * y / (1.0 + np.exp((2.0 * y * margins[fit]).astype(np.longdouble)).astype(float)) if m else y
                word, bit = divmod(offsets[fit] + m, DRAWS_PER_WORD)
                drawn = (draws[word] >> bit) & 1 == 1
                n_open = sum(is_open)
                place = np.where(is_open, np.cumsum(is_open) - 1, n_open) * width
                place = np.where(drawn, place[_route(b, levels)], n_open * width)
                square, size, sums = label * label, n_open * width, np.empty((len(b), n_open, width, 3))
                for f in range(len(b)):
                    at = b[f] + place
                    for s, weights in enumerate((None, label, square)):
                        sums[f, :, :, s] = np.bincount(at, weights, size + width)[:size].reshape(n_open, width)
                out[fit] = sums
            yield index, out

    return run


def _added(parts: list[tuple]) -> dict:
    out: dict = {}
    for _, sums in sorted(parts, key=lambda p: p[0]):
        for fit, s in sums.items():
            out[fit] = out[fit] + s if fit in out else s
    return out


def _summed(sums: RDD, n: int) -> dict:
    """The sums of n tasks, at most FAN of them at a time in one place, always in the same order."""
    while n > FAN:
        n = -(-n // FAN)
        sums = sums.map(lambda p: (p[0] // FAN, p)).groupByKey(n).mapValues(_added)
    return _added(sums.collect())


def _impurity(s: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(s[..., 0] == 0, 0.0, (s[..., 2] - s[..., 1] * s[..., 1] / s[..., 0]) / s[..., 0])


class _Node:
    def __init__(self, stats: np.ndarray | None):
        self.stats, self.impurity = stats, None if stats is None else float(_impurity(stats))
        self.gain, self.split, self.left, self.right, self.valid = -1.0, None, None, None, True

    def grow(self, sums: np.ndarray, n_splits: np.ndarray, last: bool) -> list:
        """The best of all splits by (feature, bin, stat) sums; returns the two children if there is one, and which stay open."""
        cum = np.cumsum(sums, axis=1)
        usable = np.flatnonzero(n_splits)
        total = cum[np.arange(len(cum)), n_splits][:, None, :]
        left, right = cum[:, :-1], total - cum[:, :-1]
        if self.stats is None:
            f = usable[0] if len(usable) else 0
            self.stats = left[f, 0] + right[f, 0] if len(usable) else cum[0, -1]
            self.impurity = float(_impurity(self.stats))
        n = left[..., 0] + right[..., 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = self.impurity - left[..., 0] / n * _impurity(left) - right[..., 0] / n * _impurity(right)
        can = (np.arange(gain.shape[1]) < n_splits[:, None]) & (left[..., 0] >= 1) & (right[..., 0] >= 1) & (gain >= 0)
        f, b = np.unravel_index(np.argmax(np.where(can, gain, -np.inf)), gain.shape)
        self.valid = bool(can[f, b])
        if not self.valid or gain[f, b] <= 0:
            return []
        self.gain, self.split = float(gain[f, b]), (int(f), int(b))
        self.left, self.right = _Node(left[f, b]), _Node(right[f, b])
        return [(c, not last and abs(c.impurity) >= EPSILON) for c in (self.left, self.right)]

    def prediction(self) -> float:
        return float(self.stats[1] / self.stats[0]) if self.stats[0] else 0.0

    def merge(self) -> None:
        """Leaves of the same parent that predict the same become one."""
        if self.left is None:
            return
        self.left.merge()
        self.right.merge()
        if self.left.left is None and self.right.left is None and self.left.prediction() == self.right.prediction():
            self.value = self.left.prediction()
            self.split = self.left = self.right = None
            self.gain = -1.0

    def rows(self, tree: int, cuts: list[list[float]]) -> list:
        """The nodes as MLlib saves them, numbered from the root, left subtrees first."""
        out: list = []

        def walk(node: _Node) -> int:
            number = len(out)
            out.append(None)
            left, right = (walk(node.left), walk(node.right)) if node.left else (-1, -1)
            split = (node.split[0], [cuts[node.split[0]][node.split[1]]], -1) if node.left else (-1, [], -1)
            value = getattr(node, "value", node.prediction())
            out[number] = (tree, (number, value, node.impurity if node.valid or node.left else -1.0, node.stats.tolist(), int(node.stats[0]), node.gain, left, right, split))
            return number

        walk(self)
        return out


NODES = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, "
         "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>")


class _Tree:
    """A tree that grows level by level; nodes that aren't split stand in for their left children, so that leaves share a level."""

    def __init__(self):
        self.root = _Node(None)
        self.levels, self.row, self.open = [], [self.root], [True]

    def grow(self, sums: np.ndarray, n_splits: np.ndarray, last: bool) -> None:
        nodes, row, is_open, k = [], [], [], 0
        for node, growing in zip(self.row, self.open):
            children = node.grow(sums[:, k], n_splits, last) if growing else []
            k += growing
            nodes.append(node.split if children else ALWAYS_LEFT)
            row += [c for c, _ in children] or [node, node]
            is_open += [o for _, o in children] or [False, False]
        self.levels.append(nodes)
        self.row, self.open = row, is_open

    def leaves(self) -> np.ndarray:
        return np.array([n.prediction() for n in self.row])


def _as_mllib(spark: SparkSession, trees: list[_Tree], weights: list[float], cuts: list, features: list[str], label: str, params: dict) -> PipelineModel:
    """The trees as MLlib's own model, by the layout in which it saves one."""
    path = scratch_path(spark, f"boosted-{uuid.uuid4().hex}")
    classifier = GBTClassifier(featuresCol="features", labelCol=label, **params)
    tree = DecisionTreeRegressor(featuresCol="features", labelCol=label, maxDepth=classifier.getMaxDepth(), seed=params["seed"])

    def metadata(estimator, kind: str, **more) -> str:
        saved = os.path.join(path, f"of-{kind.rsplit('.', 1)[1]}")
        estimator.write().overwrite().save(saved)
        return json.dumps({**json.loads(spark.read.text(os.path.join(saved, "metadata")).first()[0]), "class": kind, **more})

    of_tree = metadata(tree, "org.apache.spark.ml.regression.DecisionTreeRegressionModel")
    for t in trees:
        t.root.merge()
    model, nodes = os.path.join(path, "model"), [r for i, t in enumerate(trees) for r in t.root.rows(i, cuts)]
    spark.createDataFrame(nodes, NODES).coalesce(1).write.parquet(os.path.join(model, "data"))
    spark.createDataFrame([(i, of_tree, w) for i, w in enumerate(weights)], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(os.path.join(model, "treesMetadata"))
    of_model = metadata(classifier, "org.apache.spark.ml.classification.GBTClassificationModel", numFeatures=len(features), numTrees=len(trees))
    spark.createDataFrame([(of_model,)], "value string").coalesce(1).write.text(os.path.join(model, "metadata"))
    return PipelineModel([VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), GBTClassificationModel.load(model)])


def gbt_fits(groups: list[tuple[DataFrame, list[int]]], features, label: str, maxIter: int, maxDepth: int, stepSize: float, subsamplingRate: float) -> list[PipelineModel]:
    """L6 for several fits: boosted trees for every seed of every (rows, seeds), in order.

    As in MLlib, rows are drawn by seed, partition and place, so the caller settles how rows are dealt out and ordered.
    """
    spark, features = groups[0][0].sparkSession, list(features)
    sizes = [rows.count() for rows, _ in groups]
    if not all(sizes):
        raise ValueError("boosted trees need rows")
    with ThreadPoolExecutor(max_workers=len(groups)) as pool:
        made = list(pool.map(lambda g: _blocks(g[0][0], g[1], g[0][1], maxIter, subsamplingRate, features, label), zip(groups, sizes)))
    seeds = [s for _, of in groups for s in of]
    group_of = [g for g, (_, of) in enumerate(groups) for _ in of]
    cuts = [c[k if len(c) > 1 else 0] for (_, of), (_, c) in zip(groups, made) for k in range(len(of))]
    n_splits = [np.array([len(c) for c in of]) for of in cuts]
    width = 1 + max(2, *[int(x.max()) for x in n_splits])
    offsets = [s - min(of) for _, of in groups for s in of]
    fits_of = [[f for f, g in enumerate(group_of) if g == k] for k in range(len(groups))]

    # One block per task. A block is numbered by its group, partition and place, so sums are added in the same order on any cluster.
    tables = made[0][0].withColumn("group", F.lit(0))
    for g, (table, _) in enumerate(made[1:], 1):
        tables = tables.unionByName(table.withColumn("group", F.lit(g)))
    number = {tuple(r): i for i, r in enumerate(sorted(tables.select("group", "part", "block").collect()))}

    def opened(item):
        group, data = item[1]
        bins, y, draws = pickle.loads(data)
        return group, bins, y, draws, {f: np.zeros(len(y)) for f in fits_of[group]}

    n = len(number)
    keyed = tables.rdd.map(lambda r: (number[r["group"], r["part"], r["block"]], (r["group"], bytes(r["data"]))))
    blocks = keyed.partitionBy(n, lambda k: k).map(opened).persist(StorageLevel.MEMORY_AND_DISK)
    trees: list[list[_Tree]] = [[] for _ in seeds]
    recent: dict = {f: [] for f in range(len(seeds))}
    for m in range(maxIter):
        weight, now = 1.0 if m == 0 else stepSize, [_Tree() for _ in seeds]
        for depth in range(maxDepth):
            growing = {f: (t.levels, t.open) for f, t in enumerate(now) if any(t.open)}
            if not growing:
                break
            sums = _summed(blocks.mapPartitionsWithIndex(_level_sums(m, offsets, width, recent, growing)), n)
            for f in growing:
                now[f].grow(sums[f], n_splits[f], depth + 1 == maxDepth)
        for f, t in enumerate(now):
            trees[f].append(t)
            recent[f].append((weight, t.levels, t.leaves()))
        if (m + 1) % REFRESH == 0 and m + 1 < maxIter:
            later = blocks.map(_advance(recent)).persist(StorageLevel.MEMORY_AND_DISK)
            later.count()
            blocks.unpersist()
            blocks, recent = later, {f: [] for f in recent}
    blocks.unpersist()
    weights = [1.0] + [stepSize] * (maxIter - 1)

    def saved(f: int) -> PipelineModel:
        params = dict(maxIter=maxIter, maxDepth=maxDepth, stepSize=stepSize, subsamplingRate=subsamplingRate, seed=seeds[f])
        return _as_mllib(spark, trees[f], weights, cuts[f], features, label, params)

    with ThreadPoolExecutor(max_workers=len(seeds)) as pool:
        return list(pool.map(saved, range(len(seeds))))
