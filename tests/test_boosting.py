"""Fits that grow together, against MLlib's own fit of each; jobs don't multiply with the fits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import boosting as B
from vigil.operators import model as MO
from vigil.operators import training as TR
from vigil.operators.treeshap import tree_table

FEATURES = ["a", "b", "c", "d", "zero"]
PARAMS = dict(maxIter=12, maxDepth=3, stepSize=0.05, subsamplingRate=0.9)


def rows_of(spark, n, seed, parts):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = r.gauss(0, 1), r.choice([0.0, 1.0, 2.0, -1.0]), r.choice([0.0, 0.0, r.gauss(0, 2)])
        rows.append((i // 2 if i % 7 == 0 else i, a, b, c, r.random(), 0.0, int(a + b * c + r.gauss(0, 1) > 0.5)))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, zero double, y int")
    return df.repartition(parts, "id").sortWithinPartitions("id", "a").persist()


def same_trees(spark, mine, theirs):
    (a, wa), (b, wb) = (tree_table(spark, m.stages[-1]) for m in (mine, theirs))
    assert wa == wb and len(a) == len(b)
    for x, y in zip(a, b):
        assert all(np.array_equal(x[k], y[k]) for k in ("id", "left", "right", "feature", "threshold", "cover"))
        assert np.allclose(x["value"], y["value"], rtol=1e-9, atol=1e-12)


def test_each_fit_is_mllibs(spark):
    groups = [(rows_of(spark, 700, 1, 2), [42, 44]), (rows_of(spark, 20, 2, 2), [45]), (rows_of(spark, 300, 3, 1), [7])]
    models = B.gbt_fits(groups, FEATURES, "y", **PARAMS)
    expected = [(df, s) for df, seeds in groups for s in seeds]
    for model, (df, seed) in zip(models, expected):
        theirs = MO.gbt_fit(df, FEATURES, "y", seed=seed, **PARAMS)
        same_trees(spark, model, theirs)
        p = [{tuple(r) for r in MO.predict(m, df).select("id", "a", "prediction", F.round("p1", 9)).collect()} for m in (model, theirs)]
        assert p[0] == p[1]
        assert model.stages[-1].getOrDefault("seed") == seed and np.allclose(model.stages[-1].featureImportances.toArray(), theirs.stages[-1].featureImportances.toArray())


def test_blocks_and_sums_in_steps_change_nothing(spark, monkeypatch):
    df = rows_of(spark, 500, 4, 3)
    whole = B.gbt_fits([(df, [42])], FEATURES, "y", **PARAMS)[0]
    monkeypatch.setattr(B, "BLOCK_ROWS", 40)
    monkeypatch.setattr(B, "FAN", 3)
    parts = B.gbt_fits([(df, [42])], FEATURES, "y", **PARAMS)[0]
    p = [dict(MO.predict(m, df).groupBy("id").agg(F.sum("p1")).collect()) for m in (whole, parts)]
    assert np.abs(np.array([p[0][k] - p[1][k] for k in p[0]])).max() < 0.02
    assert len(parts.stages[-1].trees) == 12


def test_sampled_thresholds_take_all_of_a_large_table_into_the_fit(spark, monkeypatch):
    df = rows_of(spark, 2000, 5, 2)
    monkeypatch.setattr(B, "SAMPLE_ROWS", 500)
    a, b = B.gbt_fits([(df, [42, 43])], FEATURES, "y", **PARAMS)
    assert MO.evaluate(a, df, "y")["roc_auc"] > 0.75 and a.stages[-1].trees[0].toDebugString != b.stages[-1].trees[0].toDebugString
    root = tree_table(spark, a.stages[-1])[0][0]["cover"][0]
    assert 1700 < root < 1900  # nine tenths of all rows, not of the sample


@pytest.mark.parametrize("rows", [[], [(1, 2)], [(1, None)]])
def test_no_rows_and_other_labels_are_refused(spark, rows):
    df = spark.createDataFrame([(i, 0.5, 0.0, 0.0, 0.0, 0.0, y) for i, y in rows], "id long, a double, b double, c double, d double, zero double, y int")
    with pytest.raises(Exception):
        B.gbt_fits([(df, [42])], FEATURES, "y", **PARAMS)


def test_curriculum_runs_one_job_per_level_for_all_epochs(spark):
    df = rows_of(spark, 400, 6, 2).withColumn("segment", F.when(F.col("id") % 3 == 0, "high").otherwise("low")).withColumn("quality_score", F.col("d"))

    def jobs(trees):
        def last():
            return max(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        before = last()
        epochs, models, _ = TR.curriculum_train(spark, df, df, FEATURES, "y", maxIter=trees)
        assert epochs.count() == 10 and all(len(m.stages[-1].trees) == trees for m in models.values())
        return last() - before

    jobs(2)
    assert jobs(4) - jobs(2) <= 10  # 2 more trees of 3 levels; a job per epoch and level would be 60 more
