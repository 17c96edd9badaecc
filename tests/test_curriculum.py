"""Curriculum training: one seeded fit per epoch, the same models however the rows arrive."""

from pyspark.sql import functions as F

from vigil.operators import model as MO
from vigil.operators import training as TR
from vigil.plans import model as M
from vigil.plans.labels import segments

SF = "/root/testdata/sf0.001"


def test_epochs_are_fits_of_their_own(spark):
    fr = M.frame(spark, SF).persist()
    seg = segments(spark, SF).select("id", "quality_score", "segment").join(fr.where("split = 'train'"), "id")
    val = fr.where("split = 'val'")
    runs = [TR.curriculum_train(spark, s, val, MO.FEATURES, MO.TARGET, maxIter=2) for s in (seg, seg.repartition(5, F.rand(1)))]
    rows, models = runs[0][0].orderBy("epoch").collect(), runs[0][1]
    assert [r.phase for r in rows] == [p for p, n in TR.PHASES for _ in range(n)]
    assert [models[e].stages[-1].getOrDefault("seed") for e in range(1, 11)] == list(range(42, 52))
    assert rows == runs[1][0].orderBy("epoch").collect() and runs[0][2] == runs[1][2]
    assert runs[0][2] == TR.best_epoch(runs[0][0]).first().epoch
    fr.unpersist()
