"""The streaming ingest is restartable: a re-run with the same checkpoint adds nothing twice."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from vigil.sources import views
from vigil.streaming import audit_stream as ST


def test_stream_dedupes_and_restarts(spark):
    base = tempfile.mkdtemp(prefix="vigil-stream-")
    ev = views.audit_event(spark, SF_SMALL)
    src, out, esc, ck = (os.path.join(base, p) for p in ("src", "out", "esc", "ck"))
    first = ev.where(F.col("created_at") < "2024-01-15")
    first.write.mode("append").parquet(src)
    first.write.mode("append").parquet(src)
    ST.run(spark, src, ev.schema, out, esc, ck)
    n1 = spark.read.parquet(out).count()
    assert n1 == first.count()
    ST.run(spark, src, ev.schema, out, esc, ck)  # restart: nothing new
    assert spark.read.parquet(out).count() == n1
    ev.where(F.col("created_at") >= "2024-01-15").write.mode("append").parquet(src)
    ST.run(spark, src, ev.schema, out, esc, ck)
    got = spark.read.parquet(out).select("event_id")
    assert got.count() == ev.count() and got.distinct().count() == ev.count()


def test_late_events_and_late_repeats_are_kept_once(spark):
    """Newer files first, older ones next, and a repeat days later: every event is stored exactly once."""
    base = tempfile.mkdtemp(prefix="vigil-stream-")
    ev = views.audit_event(spark, SF_SMALL)
    src, out, esc, ck = (os.path.join(base, p) for p in ("src", "out", "esc", "ck"))
    for part in (F.col("created_at") >= "2024-01-15", F.col("created_at") < "2024-01-15", F.col("created_at") < "2024-01-03"):
        ev.where(part).write.mode("append").parquet(src)
        ST.run(spark, src, ev.schema, out, esc, ck)
    got = spark.read.parquet(out).select("event_id")
    assert got.count() == ev.count() and got.distinct().count() == ev.count()


def days_of(df):
    """Event dates of the files that a plan reads."""
    return {f.split("event_date=")[1].split("/")[0] for f in df.inputFiles()}


def test_batch_of_one_day_reads_that_day_only(spark, tmp_path):
    ev = views.audit_event(spark, SF_SMALL)
    out, esc = str(tmp_path / "out"), str(tmp_path / "esc")
    ST.append_batch(ev, 0, ev.schema, out, esc)
    assert len(days_of(ST.stored(spark, out, ev.schema))) > 5
    day = ev.agg(F.min(F.to_date("created_at"))).first()[0]
    one = ST.stored(spark, out, ev.schema, [day])
    assert "event_date" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("PushedFilters")[0]
    read = one.select("event_id", "_metadata.file_path").collect()
    assert read and {r.file_path.split("event_date=")[1].split("/")[0] for r in read} == {str(day)}
    # a repeat of the day adds nothing
    ST.append_batch(ev.where(F.to_date("created_at") == F.lit(day)), 1, ev.schema, out, esc)
    assert ST.stored(spark, out, ev.schema).count() == ev.count()


def test_running_a_batch_again_changes_nothing(spark, tmp_path):
    ev = views.audit_event(spark, SF_SMALL)
    out, esc = str(tmp_path / "out"), str(tmp_path / "esc")
    late = F.col("created_at") >= "2024-01-15"
    state = lambda: (sorted(map(str, ST.stored(spark, out, ev.schema).collect())), sorted(map(str, spark.read.parquet(esc).collect())))
    for number, part in enumerate((ev.where(late), ev)):
        ST.append_batch(part, number, ev.schema, out, esc)
    before = state()
    ST.append_batch(ev, 1, ev.schema, out, esc)
    ST.append_batch(ev.where(late), 0, ev.schema, out, esc)
    assert state() == before and len(before[0]) == ev.count()


def test_deliveries_that_disagree_and_events_without_time(spark, tmp_path):
    ev = views.audit_event(spark, SF_SMALL)
    out, esc = str(tmp_path / "out"), str(tmp_path / "esc")
    one = ev.limit(1)
    other = one.withColumn("agent_name", F.lit("AAA_Agent"))
    timeless = one.withColumn("event_id", F.lit("no-time")).withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    ST.append_batch(one.unionByName(other).unionByName(timeless), 0, ev.schema, out, esc)
    ST.append_batch(one.unionByName(timeless), 1, ev.schema, out, esc)
    got = {r.event_id: r.agent_name for r in ST.stored(spark, out, ev.schema).collect()}
    assert got == {one.first().event_id: "AAA_Agent", "no-time": one.first().agent_name}


def test_compaction(spark, tmp_path):
    ev = views.audit_event(spark, SF_SMALL)
    out, esc, to = (str(tmp_path / p) for p in ("out", "esc", "to"))
    for number in range(4):
        ST.append_batch(ev.where(F.crc32(F.col("event_id").cast("binary")) % 4 == number), number, ev.schema, out, esc)
    ST.compact(spark, out, ev.schema, to)
    a, b = ST.stored(spark, out, ev.schema), ST.stored(spark, to, ev.schema)
    assert sorted(map(str, a.select(*ev.columns).collect())) == sorted(map(str, b.select(*ev.columns).collect()))
    assert b.select("event_date", "batch").distinct().count() == b.select("event_date").distinct().count()
    assert len(b.inputFiles()) <= len(a.inputFiles())
    ST.append_batch(ev, 9, ev.schema, to, esc)  # batches go on against the compacted table
    assert ST.stored(spark, to, ev.schema).count() == ev.count()
