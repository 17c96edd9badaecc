"""Fairness, treatment-effect, drift, latency and retrieval reports (documented capabilities).

All of them are grouped aggregates over whole tables; only per-group or
per-bin summaries (a handful of rows) are combined with small windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Report constants (fixed values).
DRIFT_BINS = 10
PSI_ALERT = 0.2
PSI_FLOOR = 1e-6
LATENCY_SPIKE = 1.5
# Article vectors and rows that meet as matrices, on average.
ARTICLE_BLOCK, PART_ROWS = 16_384, 65_536
TRAILING_HOURS = 24


def positive_rates(df: DataFrame, group: str, pred="prediction", label=None) -> DataFrame:
    """R2 base: rows and positive rate per group (and TPR / FPR when a label is given)."""
    p = F.col(pred).cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(p).alias("positive_rate")]
    if label:
        y = F.col(label)
        aggs += [F.avg(F.when(y == 1, p)).alias("tpr"), F.avg(F.when(y == 0, p)).alias("fpr")]
    return df.groupBy(group).agg(*aggs)


def disparate_impact(df: DataFrame, group: str, reference, pred="prediction") -> DataFrame:
    """R2: positive rate of each group divided by the reference group's.

    The reference rate is read with a window over the per-group rows (one row
    per group), so no join is needed.
    """
    rates = positive_rates(df, group, pred)
    w = Window.partitionBy(F.lit(0))
    ref = F.max(F.when(F.col(group) == F.lit(reference), F.col("positive_rate"))).over(w)
    return rates.withColumn("di_ratio", F.try_divide(F.col("positive_rate"), ref))


def equalized_odds(df: DataFrame, group: str, label: str, pred="prediction") -> DataFrame:
    """TPR and FPR per group and their max-min gaps (window over the group rows)."""
    r = positive_rates(df, group, pred, label)
    w = Window.partitionBy(F.lit(0))
    return r.select(group, "n", "tpr", "fpr",
                    (F.max("tpr").over(w) - F.min("tpr").over(w)).alias("tpr_gap"),
                    (F.max("fpr").over(w) - F.min("fpr").over(w)).alias("fpr_gap"))


def ate_stratified(df: DataFrame, treated: str, outcome: str, strata) -> DataFrame:
    """Stratum mean differences weighted by stratum size (strata with both arms)."""
    t = F.col(treated)
    y = F.col(outcome).cast("double")
    s = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(t, y)).alias("m1"),
                                F.avg(F.when(~t, y)).alias("m0"), F.count_if(t).alias("n1"), F.count_if(~t).alias("n0"))
    v = s.where((F.col("n1") > 0) & (F.col("n0") > 0))
    return v.agg((F.sum(F.col("n") * (F.col("m1") - F.col("m0"))) / F.sum("n")).alias("ate"),
                 F.count(F.lit(1)).alias("n_strata"), F.sum("n").cast("bigint").alias("n_rows"))


def ate_ipw(df: DataFrame, treated: str, outcome: str, features, clip: float = 0.01) -> DataFrame:
    """R4 (IPW): propensity from MLlib logistic regression, inverse-probability weighted means.

    Propensities outside [clip, 1 - clip] are moved to its ends (0: none are); ``n_clipped`` counts the rows concerned.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    data = df.withColumn("_t", F.col(treated).cast("double"))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep"),
                            LogisticRegression(featuresCol="_x", labelCol="_t", maxIter=50)])
    scored = pipe.fit(data).transform(data).withColumn("_p", vector_to_array("probability")[1]).withColumn(
        "_e", F.least(F.greatest("_p", F.lit(clip)), F.lit(1 - clip)))
    y = F.col(outcome).cast("double")
    return scored.agg((F.avg(F.col("_t") * y / F.col("_e")) - F.avg((1 - F.col("_t")) * y / (1 - F.col("_e")))).alias("ate"),
                      F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_p") != F.col("_e")).alias("n_clipped"))


def completeness(events: DataFrame, required) -> DataFrame:
    """Required phases present per transaction."""
    req = F.array(*[F.lit(p) for p in required])
    per = events.groupBy("client_transaction_id").agg(F.array_sort(F.collect_set("phase")).alias("phases"))
    present = F.size(F.array_intersect("phases", req))
    return per.select("client_transaction_id", present.alias("required_present"),
                      (present == F.lit(len(required))).alias("complete"))


def psi(baseline: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """Population stability index over the baseline's decile bins of ``value`` (null values don't count).

    Cuts are the exact values of rank ceil(i n / 10); equal cuts make one bin. An empty baseline has no cuts.
    """
    from .stats import select_ranks
    n = baseline.where(F.col(value).isNotNull()).count()
    cuts = sorted(set(select_ranks(baseline, {value: [-(-i * n // DRIFT_BINS) for i in range(1, DRIFT_BINS)]}, {value: n})[value].values())) if n else []

    def dist(df, name):
        b = sum([(F.col(value) > F.lit(c)).cast("int") for c in cuts], F.lit(0))
        c = df.where(F.col(value).isNotNull()).select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias(name))
        return c
    base, cur = dist(baseline, "nb"), dist(current, "nc")
    j = base.join(cur, "bin", "full").fillna(0, ["nb", "nc"])
    w = Window.partitionBy(F.lit(0))
    pb = F.greatest(F.col("nb") / F.sum("nb").over(w), F.lit(PSI_FLOOR))
    pc = F.greatest(F.col("nc") / F.sum("nc").over(w), F.lit(PSI_FLOOR))
    per = j.select("bin", ((pc - pb) * F.log(pc / pb)).alias("term"))
    return per.agg(F.sum("term").alias("psi")).withColumn("alert", F.col("psi") > F.lit(PSI_ALERT))


def latency_alerts(events: DataFrame) -> DataFrame:
    """Exact p95 latency per hour against the mean p95 of the previous 24 hours.

    The hourly quantile comes from ranks inside each hour (range-partitioned),
    so a burst hour is spread over many tasks.
    """
    from .stats import grouped_quantile_cont
    hourly = events.withColumn("hour", F.date_trunc("hour", F.col("created_at")).cast("timestamp_ntz"))
    p95 = grouped_quantile_cont(hourly, ["hour"], "latency_ms", 0.95, tiebreak="event_id", out="p95")
    counts = hourly.groupBy("hour").agg(F.count(F.lit(1)).alias("events"))
    w = Window.orderBy("hour").rowsBetween(-TRAILING_HOURS, -1)
    # One row per hour: the trailing window runs over the hourly table, not the events.
    out = p95.join(counts, "hour").withColumn("trailing_p95", F.avg("p95").over(w))
    return out.withColumn("alert", F.coalesce(F.col("p95") > F.lit(LATENCY_SPIKE) * F.col("trailing_p95"), F.lit(False)))


def spearman(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Rank correlation (average ranks on ties) of one value between two small tables."""
    def ranked(df, name):
        w = Window.orderBy(F.col(value))
        r = df.withColumn("_rn", F.row_number().over(w))
        tie = Window.partitionBy(F.col(value))
        return r.select(key, F.avg("_rn").over(tie).alias(name))
    j = ranked(a, "ra").join(ranked(b, "rb"), key)
    return j.agg(F.corr("ra", "rb").alias("spearman"), F.count(F.lit(1)).alias("n_features"))


def nearest_article(vectors: DataFrame, articles, key: str, vec: str) -> DataFrame:
    """Best article per vector by cosine (ties: smallest article id).

    ``articles`` is a table (article, vector), or a dict of one. Rows are dealt to parts of about ``PART_ROWS`` and
    articles to blocks of about ``ARTICLE_BLOCK``; every part meets every block as two matrices, a row's vector is read and
    shuffled once for each block, and the best of its blocks is kept. Vectors have unique keys; those without a cosine (null,
    or all zeros) have a null answer, and all do without articles.
    """
    spark = vectors.sparkSession
    if isinstance(articles, dict):
        articles = spark.createDataFrame(sorted(articles.items()), "article int, vector array<double>")
    n_articles = articles.count()
    if not n_articles:
        return vectors.select(key, F.lit(None).cast(articles.schema["article"].dataType).alias("article"), F.lit(None).cast("double").alias("cosine"))
    n_blocks = -(-n_articles // ARTICLE_BLOCK)
    n_parts = max(1, -(-vectors.count() // PART_ROWS))
    left = vectors.select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(n_parts)).cast("int").alias("part"),
                          F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    right = articles.select("article", F.col("vector").cast("array<double>").alias("vector"), F.pmod(F.xxhash64("article"), F.lit(n_blocks)).cast("int").alias("a_block"),
                            F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("a_part"))
    out = T.StructType([T.StructField("k", vectors.schema[key].dataType), T.StructField("article", articles.schema["article"].dataType), T.StructField("cosine", T.DoubleType())])

    def matrix(column) -> np.ndarray:
        rows = column.to_pylist()
        width = max((len(r) for r in rows if r is not None), default=1)
        return np.array([r if r is not None and len(r) == width else [np.nan] * width for r in rows], dtype=float).reshape(len(rows), width)

    def best(rows: pa.Table, block: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"k": rows.column("k"), "article": block.column("article").slice(0, 0), "cosine": pa.array([], pa.float64())})
        if block.num_rows:
            block = block.sort_by("article")
            a = matrix(block.column("vector"))
            with np.errstate(invalid="ignore", divide="ignore"):
                a = a / np.sqrt((a * a).sum(axis=1))[:, None]
        which, value = [], []
        for at in range(0, rows.num_rows, 256):
            x = matrix(rows.column("v").slice(at, 256))
            if not block.num_rows or x.shape[1] != a.shape[1]:
                which.append(np.zeros(len(x), np.int64))
                value.append(np.full(len(x), np.nan))
                continue
            with np.errstate(invalid="ignore", divide="ignore"):
                score = (x @ a.T) / np.sqrt((x * x).sum(axis=1))[:, None]
            score = np.where(np.isnan(score), -np.inf, score)
            which.append(score.argmax(axis=1))  # the first on ties
            top = score[np.arange(len(x)), which[-1]]
            value.append(np.where(np.isfinite(top), top, np.nan))
        which, value = np.concatenate(which), np.concatenate(value)
        none = np.isnan(value)
        return pa.table({"k": rows.column("k"), "article": block.column("article").combine_chunks().take(pa.array(which, mask=none)), "cosine": pa.array(value, mask=none)})

    found = left.groupBy("part", "block").cogroup(right.groupBy("a_part", "a_block")).applyInArrow(best, out).where(F.col("k").isNotNull())
    if n_blocks > 1:
        found = found.groupBy("k").agg(F.min_by("article", F.struct(F.col("cosine").isNull(), -F.col("cosine"), "article")).alias("article"), F.max("cosine").alias("cosine"))
    return found.select(F.col("k").alias(key), "article", "cosine")
