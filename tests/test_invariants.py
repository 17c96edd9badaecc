"""Invariants of the operators that have no SQL oracle, and brute-force cross-checks."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vigil.operators import model as MO
from vigil.operators import neighbors
from vigil.operators.neighbors import knn
from vigil.operators.ranking import prefix_sums, rank_in_groups
from vigil.operators.sampling import smote
from vigil.operators import stats
from vigil.operators.stats import exact_median, exact_quantile_cont, kth_values
from vigil.operators.treeshap import compile_tree, margin_batch, shap_batch, tree_table
from vigil.session import written
from vigil.sources import views


def test_rank_in_groups_matches_window_and_partitioning(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 500).alias("v"))
    w = Window.partitionBy("g").orderBy("v")
    expect = {(r.g, r.v): r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    for parts in (1, 7):
        got = {(r.g, r.v): r.rank for r in rank_in_groups(df.repartition(parts), ["g"], ["v"]).collect()}
        assert got == expect


def test_prefix_sums(spark):
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 5).cast("double").alias("x"))
    got = {r.k: r.cum_x for r in prefix_sums(df.repartition(5), "k", ["x"]).collect()}
    run = 0.0
    for k in range(300):
        assert got[k] == run
        run += k % 5


def test_exact_order_statistics(spark):
    vals = [float(x) for x in np.random.default_rng(1).normal(size=501)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert exact_median(df, "x") == float(np.median(vals))
    assert abs(exact_quantile_cont(df, "x", 0.95) - float(np.quantile(vals, 0.95))) < 1e-12
    assert kth_values(df, "x", 10, 501) == [sorted(vals)[9]]


def test_selection_of_many_ranks(spark, monkeypatch):
    """Ties, nulls, constants and several ranks of several columns together, with brackets far below the row count."""
    monkeypatch.setattr(stats, "FINISH_ROWS", 50)
    monkeypatch.setattr(stats, "ACCURACY", 100)
    n = 4001
    df = spark.range(n).select(
        F.lit(7).alias("constant"), (F.col("id") % 2).alias("two"), ((F.col("id") * 7919) % n).cast("double").alias("spread"),
        F.when(F.col("id") % 3 > 0, F.floor(F.sqrt(F.col("id")))).alias("holes")).repartition(5)
    ranks = {c: [1, 2, 40, 1000, 1333, 2000, 2001, 2600] for c in ("constant", "two", "spread", "holes")}
    got = stats.select_ranks(df, ranks)
    rows = df.collect()
    for c, rs in ranks.items():
        values = sorted(r[c] for r in rows if r[c] is not None)
        assert got[c] == {r: values[r - 1] for r in rs}
    monkeypatch.setattr(stats, "SCAN_ROWS", 1)  # a finishing scan for each column, or one for all of a type
    assert stats.select_ranks(df, ranks) == got
    assert stats.exact_medians(df, ["two", "holes"])["holes"] == float(np.median([r.holes for r in rows if r.holes is not None]))
    with pytest.raises(ValueError):
        stats.select_ranks(df, {"spread": [n + 1]})


def test_ties_are_never_ordered(spark, monkeypatch):
    """Constant and two-valued columns are answered from counts: no scan collects or orders their rows."""
    monkeypatch.setattr(stats, "FINISH_ROWS", 1000)
    df = spark.range(200_000).select(F.lit(3.0).alias("constant"), (F.col("id") % 2).cast("double").alias("two"))
    rounds = []
    cut = stats._cut
    monkeypatch.setattr(stats, "_cut", lambda frame, wanted: rounds.append(cut(frame, wanted)) or rounds[-1])
    assert stats.exact_medians(df, ["constant", "two"]) == {"constant": 3.0, "two": 0.5}
    assert len(rounds) == 1 and not any(isinstance(k, stats._Bracket) for k in rounds[0])


def brute_knn(queries, refs, k, exclude_self):
    """{query key: [(neighbour key, distance)]}, nearest first, ties by key; rows are (key, *features)."""
    out = {}
    for q in queries:
        found = []
        for r in refs:
            if not (exclude_self and q[0] == r[0]):
                total = 0.0
                for a, b in zip(q[1:], r[1:]):
                    total += (a - b) * (a - b)
                found.append((math.sqrt(total), r[0]))
        out[q[0]] = [(key, d) for d, key in sorted(found)[:k]]
    return out


def knn_rows(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.neighbor_id, r.distance))
    return out


def clustered(n, seed, copies=0):
    """Points around ten centres, with ties: grid coordinates, and copies of one point."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(-400, 400, (10, 3))
    points = centres[rng.integers(0, 10, n)] + rng.integers(-4, 5, (n, 3))
    points[:copies] = points[0]
    return [(int(i), *map(float, p)) for i, p in zip(rng.permutation(n), points)]


@pytest.mark.parametrize("seed,k,exclude_self", [(1, 1, False), (2, 3, True), (3, 7, False), (4, 5, True)])
def test_knn_matches_brute_force(spark, monkeypatch, seed, k, exclude_self):
    monkeypatch.setattr(neighbors, "BLOCK", 16)
    monkeypatch.setattr(neighbors, "ROWS_PER_PIVOT", 20)
    rows = clustered(400, seed, copies=120)
    refs = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(3)
    queries = refs if exclude_self else spark.createDataFrame(clustered(90, seed + 50, copies=30), refs.schema)
    got = knn_rows(knn(queries, refs, ["a", "b", "c"], k, exclude_self=exclude_self))
    assert got == brute_knn(sorted(map(tuple, queries.collect())), rows, k, exclude_self)


def test_knn_small_sides(spark):
    kinds = "id long, a double"
    one, none = spark.createDataFrame([(1, 2.0)], kinds), spark.createDataFrame([], kinds)
    few = spark.createDataFrame([(1, 2.0), (2, None), (3, float("nan")), (4, 5.0)], kinds)
    assert knn(one, none, ["a"], 3).count() == knn(none, one, ["a"], 3).count() == knn(one, one, ["a"], 3, exclude_self=True).count() == 0
    assert knn_rows(knn(few, few, ["a"], 3)) == {1: [(1, 0.0), (4, 3.0)], 4: [(4, 0.0), (1, 3.0)]}


def test_knn_prunes(spark, monkeypatch):
    """On clustered rows the ring visits grow with the rows, not with their square."""
    monkeypatch.setattr(neighbors, "BLOCK", 32)
    monkeypatch.setattr(neighbors, "ROWS_PER_PIVOT", 32)
    visits = {}
    for n in (1000, 4000):
        df = spark.createDataFrame(clustered(n, 8), "id long, a double, b double, c double")
        counter = []
        knn(df, df, ["a", "b", "c"], 3, exclude_self=True, counter=counter).count()
        visits[n] = counter[0]
        assert counter[0] < n * counter[1] / 4
    assert visits[4000] < 8 * visits[1000]


def test_knn_writes_grow_with_the_rows(spark, monkeypatch):
    """Even where nothing can be ruled out, what is written grows with the rows, not with the pairs of rows and rings."""
    monkeypatch.setattr(neighbors, "BLOCK", 32)
    monkeypatch.setattr(neighbors, "ROWS_PER_PIVOT", 32)
    features, sizes = [f"f{i}" for i in range(12)], {}
    for n in (500, 2000):
        tables = []

        def write(df, name="table", tables=tables):
            tables.append(written(df, name))
            return tables[-1]

        monkeypatch.setattr(neighbors, "written", write)
        points = np.random.default_rng(n).uniform(-1, 1, (n, 12))
        df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, " + ", ".join(f"{f} double" for f in features))
        assert knn(df, df, features, 3, exclude_self=True).count() == 3 * n
        packed = {"rows", "queries", "found"}
        sizes[n] = sum(t.select(F.sum(sum([F.size(c) for c in t.columns if c in packed], F.lit(1)))).first()[0] or 0 for t in tables)
    assert sizes[2000] < 5 * sizes[500]


def test_knn_large_and_odd_values(spark):
    """Distances are exact where squares lose digits or overflow, and rows at no finite distance are no neighbours."""
    rows = [(1, 1e9, 0.0), (2, 1e9 + 1, 0.0), (3, 1e9 + 3, 1e-3), (4, 1e9 + 3, 0.0), (5, 1e9 + 3, 0.0), (6, float("inf"), 0.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = knn_rows(knn(df.where("id < 3"), df, ["a", "b"], 3, exclude_self=True))
    assert got == {1: [(2, 1.0), (4, 3.0), (5, 3.0)], 2: [(1, 1.0), (4, 2.0), (5, 2.0)]}
    far = spark.createDataFrame([(7, 1e154, 0.0), (8, -1e153, 0.0), (9, 0.0, 1e160)], df.schema)
    assert [n for n, _ in knn_rows(knn(far.where("id = 7"), far.where("id < 9"), ["a", "b"], 2))[7]] == [7, 8]


def test_smote_parity_ids_and_bounds(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), float(rng.normal()), 1 if i < 12 else 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    out = smote(df, "y", ["a", "b"], k=3)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == counts[1] == 48
    syn = out.where("synthetic").collect()
    assert sorted(r.id for r in syn) == list(range(60, 60 + 36))
    minority = np.array([(a, b) for _, a, b, y in rows if y == 1])
    for r in syn:
        assert minority[:, 0].min() - 1e-12 <= r.a <= minority[:, 0].max() + 1e-12
        assert minority[:, 1].min() - 1e-12 <= r.b <= minority[:, 1].max() + 1e-12


def _brute_shapley(x, t):
    """Shapley values by the exponential definition of v(S) (cover-weighted expectation)."""
    pos = {nid: i for i, nid in enumerate(t["id"])}

    def expect(nid, S):
        i = pos[nid]
        if t["left"][i] < 0:
            return t["value"][i]
        f, thr = t["feature"][i], t["threshold"][i]
        lc, rc = t["left"][i], t["right"][i]
        if f in S:
            return expect(lc if x[f] <= thr else rc, S)
        cov = t["cover"][i]
        return (t["cover"][pos[lc]] * expect(lc, S) + t["cover"][pos[rc]] * expect(rc, S)) / cov

    feats = sorted({int(f) for f, lc in zip(t["feature"], t["left"]) if lc >= 0})
    m = len(feats)
    phi = {}
    for f in feats:
        others = [g for g in feats if g != f]
        total = 0.0
        for s in range(m):
            for S in itertools.combinations(others, s):
                w = math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m)
                total += w * (expect(0, set(S) | {f}) - expect(0, set(S)))
        phi[f] = total
    return phi


def test_treeshap_matches_brute_force_and_adds_up(spark):
    acc = MO.model_frame(views.accounts(spark, SF_SMALL))
    feats = ["limit_bal", "age", "pay_0", "bill_amt1"]
    model = MO.gbt_fit(acc, feats, maxIter=3, maxDepth=2)
    trees, weights = tree_table(spark, model.stages[-1])
    compiled = [compile_tree(t) for t in trees]
    X = np.array([[r[c] for c in feats] for r in acc.limit(25).collect()], dtype=float)
    phi = shap_batch(X, compiled, weights, len(feats))
    for row, x in zip(phi, X):
        ref = np.zeros(len(feats))
        for t, w in zip(trees, weights):
            for f, v in _brute_shapley(x, t).items():
                ref[f] += w * v
        assert np.allclose(row, ref, atol=1e-12)
    expected = sum(w * c["expected"] for c, w in zip(compiled, weights))
    assert np.allclose(phi.sum(1) + expected, margin_batch(X, compiled, weights), atol=1e-12)


def test_smote_single_minority_row(spark):
    df = spark.createDataFrame([(0, 1.0, 1), (1, 2.0, 0), (2, 3.0, 0), (3, 4.0, 0)], "id long, a double, y int")
    out = smote(df, "y", ["a"])
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {0: 3, 1: 3}
    assert {r.a for r in out.where("synthetic").collect()} == {1.0}


def test_hash_chain_detects_tampering(spark):
    from vigil.operators.chain import build_chain, verify_chain
    ev = views.audit_event(spark, SF_SMALL)
    heads = build_chain(ev)[1].persist()
    assert verify_chain(heads, ev).where("NOT valid").count() == 0
    victim = ev.orderBy("event_id").first()
    tampered = ev.withColumn("extra_payload", F.when(F.col("event_id") == victim.event_id, F.lit('{"k": -1}'))
                             .otherwise(F.col("extra_payload")))
    bad = [r.client_transaction_id for r in verify_chain(heads, tampered).where("NOT valid").collect()]
    assert bad == [victim.client_transaction_id]


def test_results_equal_under_repartitioning(spark):
    from vigil.operators import labels as L
    from vigil.operators.quality import dedupe_keep_first
    from vigil.operators.sampling import sample_exact, stratified_folds
    pp = L.with_probs(views.pred_probs(spark, SF_SMALL))
    li = views.accounts(spark, SF_SMALL).select("id", "education", "limit_bal")

    def runs(df):
        return (
            sorted(map(tuple, stratified_folds(df.select("id", "label"), "label").select("id", "fold").collect())),
            sorted(r.id for r in sample_exact(df.select("id"), 30).collect()),
            sorted(map(tuple, L.label_issues(df).collect())),
        )

    assert runs(pp.repartition(1)) == runs(pp.repartition(7))
    d1 = sorted(map(tuple, dedupe_keep_first(li.repartition(1), ["education"], ["limit_bal", "id"]).collect()))
    d7 = sorted(map(tuple, dedupe_keep_first(li.repartition(7), ["education"], ["limit_bal", "id"]).collect()))
    assert d1 == d7


def test_forest_partitions_follow_the_rows(spark, monkeypatch):
    """A forest holds each row with its count in every tree, so no task of a fold's fit may hold the whole table."""
    rows = spark.range(600).select("id", F.lit("train").alias("split"), (F.col("id") % 2).cast("int").alias(MO.TARGET), (F.col("id") % 13).cast("double").alias("a")).coalesce(1)
    folds = rows.select("id", (F.col("id") % 5).cast("int").alias("fold"))
    most, pipeline = [], MO.forest_pipeline

    class Watched:
        def __init__(self, *args, **kwargs):
            self.inner = pipeline(*args, **kwargs)

        def fit(self, data):
            most.append(data.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
            return self.inner.fit(data)

    monkeypatch.setattr(MO, "forest_pipeline", Watched)
    monkeypatch.setattr(MO, "FOREST_ROWS_PER_PARTITION", 100, raising=False)
    out = MO.oof_probabilities(rows, folds, ["a"], numTrees=3).collect()
    assert sorted(r.id for r in out) == list(range(600)) and all(abs(r.p0 + r.p1 - 1) < 1e-9 for r in out)
    assert len(most) == 5 and max(most) <= 200


def test_top_drivers_are_dealt_before_they_are_sorted(spark):
    """The scan makes all features' rows of its ids; nothing may sort them before the shuffle by id."""
    from vigil.operators.attribution import top_drivers_long
    phi = spark.range(50).select("id", F.explode(F.array(*[F.struct(F.lit(f"f{i}").alias("feature"), ((F.col("id") * 7 + i * 3) % 11 - 5).cast("double").alias("phi")) for i in range(8)])).alias("p")).select("id", "p.*")
    out = top_drivers_long(phi, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(id" in plan and "Sort [" not in plan[plan.index("Exchange hashpartitioning(id"):]
    expected = {}
    for r in phi.collect():
        expected.setdefault(r.id, []).append((-abs(r.phi), r.feature, r.phi))
    got = {(r.id, r["rank"]): (r.feature, r.phi) for r in out.collect()}
    assert got == {(i, n): (f, v) for i, rows in expected.items() for n, (_, f, v) in enumerate(sorted(rows)[:3], 1)}
