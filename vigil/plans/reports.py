"""Documented-only reports: fairness, treatment effects, completeness, drift, latency, stability, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fairness as FA
from ..operators import quality as Q
from ..sources import tables, views
from .registry import query

SA = ("scores", "accounts")
REC = """a AS (SELECT id, sex, CASE WHEN education IN (5, 6, 0) THEN 4 ELSE education END AS education,
  (CASE WHEN marriage IN (0) THEN 3 ELSE marriage END) = 1 AS treated, default_payment_next_month AS y, age, limit_bal FROM accounts)"""
REQUIRED_PHASES = ["Phase1_DataAssurance", "Phase3_PredictionPipeline", "Phase3_Governance"]
DRIFT_CUT = "1996-01-01"
PLACEBO_SEEDS = 5


def _scored_accounts(spark, sf):
    acc = Q.recode_categories(views.accounts(spark, sf)).select("id", "sex", "default_payment_next_month")
    sc = views.scores(spark, sf).select("id", (F.col("p1") >= 0.5).cast("int").alias("prediction"))
    return sc.join(acc, "id")


def _treatment(spark, sf):
    acc = Q.recode_categories(views.accounts(spark, sf))
    return acc.select("id", "sex", "education", (F.col("marriage") == 1).alias("treated"),
                      F.col("default_payment_next_month").alias("y"), "age", "limit_bal")


@query("disparate_impact", """WITH d AS (SELECT a.sex, CASE WHEN s.p1 >= 0.5 THEN 1.0 ELSE 0.0 END AS prediction
  FROM scores s JOIN accounts a ON a.id = s.id),
r AS (SELECT sex, count(*) AS n, avg(prediction) AS positive_rate FROM d GROUP BY sex)
SELECT r.sex, r.n, round(r.positive_rate, 9) AS positive_rate,
  round(r.positive_rate / nullif((SELECT positive_rate FROM r WHERE sex = 1), 0), 9) AS di_ratio FROM r""", SA)
def disparate_impact(spark, sf):
    """R2: ratio of positive-prediction rates between sexes (reference: 1)."""
    d = FA.disparate_impact(_scored_accounts(spark, sf), "sex", 1)
    return d.select("sex", "n", F.round("positive_rate", 9).alias("positive_rate"), F.round("di_ratio", 9).alias("di_ratio"))


@query("equalized_odds", """WITH d AS (SELECT a.sex, a.default_payment_next_month AS y, CASE WHEN s.p1 >= 0.5 THEN 1.0 ELSE 0.0 END AS p
  FROM scores s JOIN accounts a ON a.id = s.id),
r AS (SELECT sex, count(*) AS n, avg(CASE WHEN y = 1 THEN p END) AS tpr, avg(CASE WHEN y = 0 THEN p END) AS fpr FROM d GROUP BY sex)
SELECT sex, n, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr, round(max(tpr) OVER () - min(tpr) OVER (), 9) AS tpr_gap,
  round(max(fpr) OVER () - min(fpr) OVER (), 9) AS fpr_gap FROM r""", SA)
def equalized_odds(spark, sf):
    """TPR / FPR per sex and their gaps."""
    e = FA.equalized_odds(_scored_accounts(spark, sf), "sex", "default_payment_next_month")
    return e.select("sex", "n", *[F.round(c, 9).alias(c) for c in ["tpr", "fpr", "tpr_gap", "fpr_gap"]])


_ATE_SQL = """s AS (SELECT education, sex, count(*) AS n, avg(CASE WHEN treated THEN y END) AS m1, avg(CASE WHEN NOT treated THEN y END) AS m0,
  count(*) FILTER (WHERE treated) AS n1, count(*) FILTER (WHERE NOT treated) AS n0 FROM a GROUP BY education, sex)"""


@query("ate_stratified", f"""WITH {REC},
{_ATE_SQL}
SELECT round(sum(n * (m1 - m0)) / sum(n), 9) AS ate, count(*) AS n_strata, CAST(sum(n) AS BIGINT) AS n_rows
FROM s WHERE n1 > 0 AND n0 > 0""", ("accounts",))
def ate_stratified(spark, sf):
    """Effect of being married on default, stratified by education x sex."""
    r = FA.ate_stratified(_treatment(spark, sf), "treated", "y", ["education", "sex"])
    return r.select(F.round("ate", 9).alias("ate"), "n_strata", "n_rows")


@query("ate_ipw")
def ate_ipw(spark, sf):
    """R4 (IPW): propensity-weighted effect with a logistic propensity model."""
    t = _treatment(spark, sf).fillna({"age": 0})
    return FA.ate_ipw(t, "treated", "y", ["age", "limit_bal", "sex", "education"])


@query("ate_placebo", f"""WITH {REC},
p AS (SELECT seed, a.id, a.education, a.sex, a.y,
  row_number() OVER (PARTITION BY seed ORDER BY substr(sha256(CAST(a.id AS VARCHAR) || '-' || CAST(seed AS VARCHAR)), 1, 8), a.id)
    <= (SELECT count(*) FILTER (WHERE treated) FROM a) AS treated
  FROM a CROSS JOIN (SELECT CAST(range AS INTEGER) AS seed FROM range(1, {PLACEBO_SEEDS + 1})) r),
s AS (SELECT seed, education, sex, count(*) AS n, avg(CASE WHEN treated THEN y END) AS m1, avg(CASE WHEN NOT treated THEN y END) AS m0,
  count(*) FILTER (WHERE treated) AS n1, count(*) FILTER (WHERE NOT treated) AS n0 FROM p GROUP BY seed, education, sex)
SELECT seed, round(sum(n * (m1 - m0)) / sum(n), 9) AS ate FROM s WHERE n1 > 0 AND n0 > 0 GROUP BY seed""", ("accounts",))
def ate_placebo(spark, sf):
    """The stratified effect under a permuted treatment, one row per seed: as many rows as were treated are, the first by a seeded hash."""
    from ..operators.ranking import rank_in_groups
    t = _treatment(spark, sf).select("id", "education", "sex", "y", "treated")
    n_treated = t.where("treated").count()
    seeds = t.drop("treated").withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(PLACEBO_SEEDS))))
    h = F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit("-"), F.col("seed").cast("string")), 256), 1, 8)
    placebo = rank_in_groups(seeds.withColumn("h", h), ["seed"], ["h", "id"]).withColumn("treated", F.col("rank") <= n_treated)
    tt = F.col("treated")
    y = F.col("y").cast("double")
    s = placebo.groupBy("seed", "education", "sex").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(tt, y)).alias("m1"), F.avg(F.when(~tt, y)).alias("m0"),
        F.count_if(tt).alias("n1"), F.count_if(~tt).alias("n0"))
    v = s.where((F.col("n1") > 0) & (F.col("n0") > 0))
    return v.groupBy("seed").agg(F.round(F.sum(F.col("n") * (F.col("m1") - F.col("m0"))) / F.sum("n"), 9).alias("ate"))


@query("ite_two_model")
def ite_two_model(spark, sf):
    """Individual effect = P(default | married model) - P(default | unmarried model) per account."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    t = _treatment(spark, sf).fillna({"age": 0}).withColumn("y", F.col("y").cast("double"))
    feats = ["age", "limit_bal", "sex", "education"]

    def fit(rows):
        return Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="_x", handleInvalid="keep"),
                                LogisticRegression(featuresCol="_x", labelCol="y", maxIter=50)]).fit(rows)
    m1, m0 = fit(t.where("treated")), fit(t.where("NOT treated"))
    p1 = m1.transform(t).select("id", vector_to_array("probability")[1].alias("p_treated"))
    p0 = m0.transform(t).select("id", vector_to_array("probability")[1].alias("p_control"))
    return p1.join(p0, "id").withColumn("ite", F.col("p_treated") - F.col("p_control"))


@query("audit_completeness", """SELECT client_transaction_id,
  CAST(count(DISTINCT phase) FILTER (WHERE phase IN ('Phase1_DataAssurance', 'Phase3_PredictionPipeline', 'Phase3_Governance')) AS INTEGER) AS required_present,
  count(DISTINCT phase) FILTER (WHERE phase IN ('Phase1_DataAssurance', 'Phase3_PredictionPipeline', 'Phase3_Governance')) = 3 AS complete
FROM audit_event GROUP BY client_transaction_id""", ("audit_event",))
def audit_completeness(spark, sf):
    """Transactions carrying every required phase."""
    return FA.completeness(views.audit_event(spark, sf), REQUIRED_PHASES)


@query("drift_alert", f"""WITH o AS (SELECT l_quantity AS v, row_number() OVER (ORDER BY l_quantity) AS r, count(*) OVER () AS n
  FROM lineitem WHERE l_shipdate < TIMESTAMP '{DRIFT_CUT}' AND l_quantity IS NOT NULL),
cuts AS (SELECT list(DISTINCT v) AS vs FROM o, range(1, 10) d(i) WHERE r = (i * n + 9) // 10),
x AS (SELECT l_shipdate, len(list_filter(vs, lambda c: l_quantity > c)) AS bin FROM lineitem, cuts WHERE l_quantity IS NOT NULL),
b AS (SELECT bin, count(*) AS nb FROM x WHERE l_shipdate < TIMESTAMP '{DRIFT_CUT}' GROUP BY 1),
c AS (SELECT bin, count(*) AS nc FROM x WHERE l_shipdate >= TIMESTAMP '{DRIFT_CUT}' GROUP BY 1),
j AS (SELECT coalesce(b.bin, c.bin) AS bin, coalesce(nb, 0) AS nb, coalesce(nc, 0) AS nc FROM b FULL JOIN c ON b.bin = c.bin),
p AS (SELECT greatest(nb / sum(nb) OVER (), CAST(1e-6 AS DOUBLE)) AS pb, greatest(nc / sum(nc) OVER (), CAST(1e-6 AS DOUBLE)) AS pc FROM j)
SELECT round(sum((pc - pb) * ln(pc / pb)), 9) AS psi, sum((pc - pb) * ln(pc / pb)) > 0.2 AS alert FROM p""")
def drift_alert(spark, sf):
    """Population stability index of line quantities before / after a ship-date cut."""
    li = tables.table(spark, sf, "lineitem").select("l_quantity", "l_shipdate")
    cut = F.lit(DRIFT_CUT).cast("timestamp_ntz")
    r = FA.psi(li.where(F.col("l_shipdate") < cut), li.where(F.col("l_shipdate") >= cut), "l_quantity")
    return r.select(F.round("psi", 9).alias("psi"), "alert")


@query("latency_alert", """WITH h AS (SELECT date_trunc('hour', created_at) AS hour, quantile_cont(latency_ms, 0.95) AS p95,
  count(*) AS events FROM audit_event GROUP BY 1),
t AS (SELECT *, avg(p95) OVER (ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS trailing_p95 FROM h)
SELECT hour, round(p95, 6) AS p95, events, round(trailing_p95, 9) AS trailing_p95,
  coalesce(p95 > 1.5 * trailing_p95, false) AS alert FROM t""", ("audit_event",))
def latency_alert(spark, sf):
    """Hourly exact p95 latency against its trailing 24-hour mean."""
    r = FA.latency_alerts(views.audit_event(spark, sf))
    return r.select("hour", F.round("p95", 6).alias("p95"), "events", F.round("trailing_p95", 9).alias("trailing_p95"),
                    "alert")


_VAL = "(CAST(('0x' || substr(sha256(CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) % 1000) < 125"


@query("attribution_stability", f"""WITH a AS (SELECT feature, avg(abs(phi)) AS v FROM phi WHERE NOT {_VAL} GROUP BY feature),
b AS (SELECT feature, avg(abs(phi)) AS v FROM phi WHERE {_VAL} GROUP BY feature),
ra AS (SELECT feature, avg(rn) OVER (PARTITION BY v) AS r FROM (SELECT feature, v, row_number() OVER (ORDER BY v) AS rn FROM a)),
rb AS (SELECT feature, avg(rn) OVER (PARTITION BY v) AS r FROM (SELECT feature, v, row_number() OVER (ORDER BY v) AS rn FROM b))
SELECT round(corr(ra.r, rb.r), 9) AS spearman, count(*) AS n_features FROM ra JOIN rb ON ra.feature = rb.feature""", ("phi",))
def attribution_stability(spark, sf):
    """Rank correlation of global importance between the train and validation populations."""
    from ..functions.columns import hash_fraction_key
    from ..operators.attribution import global_importance
    phi = views.phi(spark, sf)
    val = hash_fraction_key("id") % 1000 < 125
    a = global_importance(phi.where(~val)).withColumnRenamed("importance", "v")
    b = global_importance(phi.where(val)).withColumnRenamed("importance", "v")
    r = FA.spearman(a, b, "feature", "v")
    return r.select(F.round("spearman", 9).alias("spearman"), "n_features")


@query("article_lookup", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT label, list(m ORDER BY i) AS centroid FROM (
  SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
s AS (SELECT e.vec_id, c.label AS article, list_cosine_similarity(e.v, c.centroid) AS cosine FROM e, c)
SELECT vec_id, article, round(cosine, 6) AS cosine FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, article) AS rn FROM s) WHERE rn = 1""")
def article_lookup(spark, sf):
    """Every vector's nearest article (article vector = centroid of its labelled vectors) by cosine."""
    emb = tables.table(spark, sf, "embeddings")
    dims = emb.select(F.posexplode("embedding").alias("i", "x"), "label")
    cent = dims.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = F.array_sort(F.collect_list(F.struct("i", "m")))  # one vector's dimensions
    articles = cent.groupBy(F.col("label").alias("article")).agg(F.transform(packed, lambda s: s["m"]).alias("vector"))
    out = FA.nearest_article(emb, articles, "vec_id", "embedding")
    return out.select("vec_id", F.col("article").cast("int").alias("article"), F.round("cosine", 6).alias("cosine"))
