"""One key holding a third of all rows: results stay exact and the hot group spreads over tasks."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.operators.audit import as_of_latest
from vigil.operators.quality import dedupe_keep_first
from vigil.operators.ranking import rank_in_groups
from vigil.operators.stats import grouped_quantile_cont

N = 30000


def skewed(spark):
    # Key 0 holds one third of the rows; the rest spread over 1000 keys.
    return spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000 + 1).alias("g"),
        ((F.col("id") * 7919) % N).cast("double").alias("v"), F.col("id"))


def test_rank_in_groups_hot_group(spark):
    df = skewed(spark)
    got = rank_in_groups(df, ["g"], ["v", "id"]).where("g = 0").select("id", "rank")
    w = Window.partitionBy("g").orderBy("v", "id")
    exp = df.where("g = 0").withColumn("rank", F.row_number().over(w).cast("bigint")).select("id", "rank")
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0
    # The same range partitioning puts the hot group in several tasks.
    spread = (df.repartitionByRange(8, "g", "v", "id").where("g = 0")
              .select(F.spark_partition_id().alias("p")).distinct().count())
    assert spread >= 3


def test_rank_in_groups_many_groups_without_broadcast(spark):
    # 100,000 groups beside a hot one: the span table is joined, not broadcast, where it is over the planner's limit.
    df = spark.range(150000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("g"), "id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rank_in_groups(df, ["g"], ["id"])
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.where("g = -1 and rank <> id / 3 + 1").count() == 0
        assert got.where("g <> -1 and rank <> 1").count() == 0 and got.count() == 150000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_dedupe_hot_key(spark):
    df = skewed(spark).select(F.col("g").alias("k"), "v", "id")
    first = {r.k: (r.v, r.id) for r in dedupe_keep_first(df, ["k"], ["v", "id"]).collect()}
    rows = df.collect()
    best = {}
    for r in rows:
        if r.k not in best or (r.v, r.id) < best[r.k]:
            best[r.k] = (r.v, r.id)
    assert first == best


def test_grouped_quantile_hot_group(spark):
    df = skewed(spark)
    got = {r.g: r.quantile for r in grouped_quantile_cont(df, ["g"], "v", 0.95, tiebreak="id").collect()}
    vals = np.array([r.v for r in df.where("g = 0").collect()])
    assert abs(got[0] - float(np.quantile(vals, 0.95))) < 1e-9
    vals7 = np.array([r.v for r in df.where("g = 7").collect()])
    assert abs(got[7] - float(np.quantile(vals7, 0.95))) < 1e-9


def test_as_of_burst_at_one_time(spark):
    # A third of the events share one timestamp; facts before, at and after it.
    events = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("2024-01-02 00:00:00"))
        .otherwise(F.concat(F.lit("2024-01-0"), (F.col("id") % 2 * 2 + 1).cast("string"), F.lit(" 12:00:00")))
        .cast("timestamp_ntz").alias("t"),
        F.format_string("m%05d", F.col("id")).alias("m"))
    facts = spark.createDataFrame([(1, "2024-01-01 06:00:00"), (2, "2024-01-02 00:00:00"), (3, "2024-01-04 00:00:00"),
                                   (4, "2023-12-31 00:00:00")], "fid int, ts string").select(
        "fid", F.col("ts").cast("timestamp_ntz").alias("ts"))
    got = {r.fid: r.latest for r in as_of_latest(facts, "ts", events, "t", "m", "latest").collect()}
    ev = [(r.t, r.m) for r in events.collect()]
    for fid, ts in [(r.fid, r.ts) for r in facts.collect()]:
        cands = [e for e in ev if e[0] <= ts]
        assert got[fid] == (max(cands)[1] if cands else None)


def test_copies_of_one_row_spread(spark):
    """One minority row that becomes a million: blocks of copies are dealt out over the tasks."""
    from vigil.operators.sampling import COPY_BLOCK, repeat_rows, upsample
    one = spark.createDataFrame([(7, 1, "x")], "id long, y int, z string")
    out = repeat_rows(one, F.lit(1_000_000), 1_000_000)
    per_task = out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in per_task) == 1_000_000 and len(per_task) >= 4 and max(r.n for r in per_task) < 500_000
    assert out.agg(F.min("copy"), F.max("copy"), F.count_distinct("copy")).first() == (1, 1_000_000, 1_000_000)
    assert [r.copy for r in repeat_rows(one, F.lit(0), 0).collect()] == []
    major = spark.range(100, 100 + 3 * COPY_BLOCK + 1).select("id", F.lit(0).alias("y"), F.lit("m").alias("z"))
    counts = {r.y: r["count"] for r in upsample(one.unionByName(major), "y").groupBy("y").count().collect()}
    assert counts == {0: 3 * COPY_BLOCK + 1, 1: 3 * COPY_BLOCK + 1}


def test_smote_need_below_the_minority(spark):
    """Fewer new rows than minority rows: only so many rows are copied."""
    from vigil.operators.sampling import smote
    df = spark.range(25).select("id", (F.col("id") * 7 % 25).cast("double").alias("a"), F.when(F.col("id") < 10, 1).otherwise(0).alias("y"))
    counts = {r.y: r["count"] for r in smote(df, "y", ["a"], k=3).groupBy("y").count().collect()}
    assert counts == {0: 15, 1: 15}


def test_fingerprint_of_equal_rows(spark):
    """A million equal rows are one leaf with their count: the longest list has one entry."""
    from vigil.operators import fingerprint as FP
    equal = spark.range(1_000_000).select(F.lit(1).alias("a"), F.lit("x").alias("b"))
    one, few = FP.fingerprint(equal).first(), FP.fingerprint(equal.limit(3)).first()
    assert one.row_count == 1_000_000 and few.row_count == 3 and one.fingerprint != few.fingerprint
    leaves = FP.row_hashes(equal).groupBy("h").count().collect()
    assert len(leaves) == 1
    plan = FP.fingerprint(equal)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("collect_list(leaf") < plan.index("count(1)")  # the lists stand above the counting
    mixed = equal.limit(5).unionByName(spark.createDataFrame([(2, "y")], "a int, b string"))
    assert FP.fingerprint(mixed.repartition(4)).first() == FP.fingerprint(mixed.coalesce(1)).first()


def test_profile_makes_no_text_of_cells(spark):
    """Distinct values are counted by typed hashes: no cast of a cell to text, and few distinct values shuffle little."""
    from vigil.operators.quality import schema_report
    df = spark.range(50_000).select((F.col("id") % 3).alias("a"), F.when(F.col("id") % 2 == 0, 1.5).alias("b"), F.lit(None).cast("string").alias("c"), F.lit(-0.0).alias("d"))
    report = schema_report(df.unionByName(df.withColumn("d", F.lit(0.0))), ["A", "b", "c", "d", "missing"])
    assert "cast(" not in report._jdf.queryExecution().optimizedPlan().toString().replace("cast(id", "").lower().split("null_count")[0]
    got = {r.column_name: (r.present, r.null_count, r.distinct_count) for r in report.collect()}
    assert got == {"A": (True, 0, 3), "b": (True, 50_000, 1), "c": (True, 100_000, 0), "d": (True, 0, 1), "missing": (False, None, None)}
