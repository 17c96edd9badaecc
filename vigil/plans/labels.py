"""Label-audit, curriculum and sampling queries (pred_probs and accounts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import hash_fraction_key
from ..operators import labels as L
from ..operators import sampling as S
from ..operators import features as FE
from ..sources import views
from .registry import query

PP = ("pred_probs",)
BOTH = ("accounts", "pred_probs")
HASH = "sha256(CAST(id AS VARCHAR))"
SPLIT_H = "(CAST(('0x' || substr(sha256(CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) % 1000)"

ISSUES_SQL = """th AS (SELECT avg(CASE WHEN label = 0 THEN p0 END) - CAST(1e-6 AS DOUBLE) AS t0,
                avg(CASE WHEN label = 1 THEN p1 END) - CAST(1e-6 AS DOUBLE) AS t1 FROM pred_probs),
cand AS (SELECT id, label, p0, p1,
  CASE WHEN p0 >= t0 AND p1 >= t1 THEN (CASE WHEN p1 > p0 THEN 1 ELSE 0 END)
       WHEN p0 >= t0 THEN 0 WHEN p1 >= t1 THEN 1 END AS c
  FROM pred_probs CROSS JOIN th),
joint AS (SELECT label AS y, c, count(*) AS n FROM cand WHERE c IS NOT NULL GROUP BY label, c),
lab AS (SELECT label AS y, count(*) AS n FROM pred_probs GROUP BY label),
rs AS (SELECT y, sum(n) AS s FROM joint GROUP BY y),
quota AS (SELECT j.y, j.c AS oj, CAST(floor(CAST(j.n AS DOUBLE) * lab.n / rs.s + 0.5) AS BIGINT) AS q
  FROM joint j JOIN lab ON j.y = lab.y JOIN rs ON j.y = rs.y WHERE j.c <> j.y),
marg AS (SELECT c.id, c.label, q.oj, q.q, CASE WHEN q.oj = 1 THEN c.p1 - c.p0 ELSE c.p0 - c.p1 END AS m
  FROM cand c JOIN quota q ON c.label = q.y),
flag AS (SELECT DISTINCT id FROM (
  SELECT id, q, row_number() OVER (PARTITION BY label, oj ORDER BY m DESC, id) AS r FROM marg) WHERE r <= q),
issues AS (SELECT p.id, (f.id IS NOT NULL) AND ((CASE WHEN p.p1 > p.p0 THEN 1 ELSE 0 END) <> p.label) AS is_issue
  FROM pred_probs p LEFT JOIN flag f ON p.id = f.id),
report AS (SELECT p.id, p.label AS original_label, CASE WHEN p.p1 > p.p0 THEN 1 ELSE 0 END AS predicted_label,
  greatest(p.p0, p.p1) AS confidence_score, CASE WHEN p.label = 0 THEN p.p0 ELSE p.p1 END AS quality_score, i.is_issue
  FROM pred_probs p JOIN issues i ON p.id = i.id)"""


def probs(spark, sf):
    return L.with_probs(views.pred_probs(spark, sf))


def report(spark, sf):
    return L.label_report(probs(spark, sf))


@query("label_quality", "SELECT id, CASE WHEN label = 0 THEN p0 ELSE p1 END AS quality_score FROM pred_probs", PP)
def label_quality(spark, sf):
    """L3: self-confidence of the given label."""
    return probs(spark, sf).select("id", L.self_confidence().alias("quality_score"))


@query("label_issues", f"WITH {ISSUES_SQL}\nSELECT id, is_issue FROM issues", PP)
def label_issues(spark, sf):
    """L2: confident-learning issue mask (prune by noise rate)."""
    return L.label_issues(probs(spark, sf))


@query("label_report", f"WITH {ISSUES_SQL}\nSELECT * FROM report", PP)
def label_report(spark, sf):
    """L4: per-row label report."""
    return report(spark, sf)


@query("issue_filter", f"WITH {ISSUES_SQL}\nSELECT id, original_label, quality_score FROM report WHERE is_issue", PP)
def issue_filter(spark, sf):
    """Flagged rows only."""
    return report(spark, sf).where("is_issue").select("id", "original_label", "quality_score")


@query("quality_alert", f"""WITH {ISSUES_SQL}
SELECT count(*) FILTER (WHERE is_issue) AS issue_count, count(*) AS row_count,
  min(quality_score) AS min_quality, max(quality_score) AS max_quality,
  CASE WHEN count(*) FILTER (WHERE is_issue) > 0 THEN 'Esclate for human review' ELSE 'Data Quality check passed' END AS message
FROM report""", PP)
def quality_alert(spark, sf):
    """Alert text from the issue count."""
    return L.quality_alert(report(spark, sf))


@query("quality_range", f"""WITH {ISSUES_SQL}
SELECT min(quality_score) AS min_quality, max(quality_score) AS max_quality,
  count(*) FILTER (WHERE is_issue) AS issue_count FROM report""", PP)
def quality_range(spark, sf):
    """Quality score range and issue count."""
    return report(spark, sf).agg(F.min("quality_score").alias("min_quality"), F.max("quality_score").alias("max_quality"),
                                 F.count_if("is_issue").alias("issue_count"))


@query("stratified_folds", f"""SELECT id, label,
  CAST((row_number() OVER (PARTITION BY label ORDER BY {HASH}, id) - 1) % 5 AS INT) AS fold FROM pred_probs""", PP)
def stratified_folds(spark, sf):
    """Five stratified folds in hash order."""
    return S.stratified_folds(views.pred_probs(spark, sf).select("id", "label"), "label")


SEG_SQL = f"""q AS (SELECT id, CASE WHEN label = 0 THEN p0 ELSE p1 END AS quality_score FROM pred_probs),
train AS (SELECT id, default_payment_next_month FROM accounts WHERE {SPLIT_H} >= 125),
seg AS (SELECT t.id, t.default_payment_next_month, q.quality_score,
  CASE WHEN q.quality_score >= CAST(0.9 AS DOUBLE) THEN 'high' ELSE 'low' END AS segment
  FROM train t LEFT JOIN q ON t.id = q.id)"""


def segments(spark, sf):
    """Train rows joined to their quality score, split at the threshold."""
    acc = views.accounts(spark, sf)
    train = acc.where(hash_fraction_key("id") % 1000 >= 125).select("id", FE.TARGET)
    quality = probs(spark, sf).select("id", L.self_confidence().alias("quality_score"))
    return L.segment(L.join_quality(train, quality))


@query("join_quality", f"WITH {SEG_SQL}\nSELECT id, default_payment_next_month, quality_score FROM seg", BOTH)
def join_quality(spark, sf):
    """Train rows left-joined to quality scores (scores unique per id)."""
    return segments(spark, sf).select("id", FE.TARGET, "quality_score")


@query("curriculum_prep", f"WITH {SEG_SQL}\nSELECT id, quality_score, segment FROM seg", BOTH)
def curriculum_prep(spark, sf):
    """L10 + P10: high / low confidence segments; a missing score is low."""
    return segments(spark, sf).select("id", "quality_score", "segment")


@query("segment_counts", f"WITH {SEG_SQL}\nSELECT segment, count(*) AS n FROM seg GROUP BY segment", BOTH)
def segment_counts(spark, sf):
    """Rows per segment."""
    return segments(spark, sf).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


SAMPLE_SQL = f"""low AS (SELECT id, row_number() OVER (ORDER BY {HASH}, id) AS r FROM seg WHERE segment = 'low'),
picked AS (SELECT id FROM low WHERE r <= ((SELECT count(*) FROM low) * 30 + 50) // 100)"""


def sampled_low(spark, sf):
    low = segments(spark, sf).where(F.col("segment") == "low")
    return S.sample_exact(low, 30)


@query("sample_low", f"WITH {SEG_SQL},\n{SAMPLE_SQL}\nSELECT id FROM picked", BOTH)
def sample_low(spark, sf):
    """Exactly round(30% of low) rows, first in hash order."""
    return sampled_low(spark, sf).select("id")


@query("curriculum_union", f"""WITH {SEG_SQL},
{SAMPLE_SQL}
SELECT id, segment FROM seg WHERE segment = 'high'
UNION ALL SELECT s.id, s.segment FROM seg s JOIN picked p ON s.id = p.id""", BOTH)
def curriculum_union(spark, sf):
    """High rows plus the sampled low rows (UNION ALL)."""
    seg = segments(spark, sf)
    high = seg.where(F.col("segment") == "high").select("id", "segment")
    return high.unionByName(sampled_low(spark, sf).select("id", "segment"))


@query("curriculum_batches", f"""WITH {SEG_SQL},
{SAMPLE_SQL},
c AS (SELECT count(*) FILTER (WHERE segment = 'high') AS nh, count(*) FILTER (WHERE segment = 'low') AS nl,
  (SELECT count(*) FROM picked) AS ns FROM seg)
SELECT e.epoch, e.phase, c.nh AS n_high,
  CASE WHEN e.phase = 'high_only' THEN 0 WHEN e.phase = 'high_plus_sample' THEN c.ns ELSE c.nl END AS n_low,
  c.nh + CASE WHEN e.phase = 'high_only' THEN 0 WHEN e.phase = 'high_plus_sample' THEN c.ns ELSE c.nl END AS n_rows
FROM (SELECT CAST(range + 1 AS INT) AS epoch, CASE WHEN range < 3 THEN 'high_only' WHEN range < 6 THEN 'high_plus_sample'
  ELSE 'high_plus_all' END AS phase FROM range(10)) e CROSS JOIN c""", BOTH)
def curriculum_batches(spark, sf):
    """Ten epochs, rows per epoch (3 high only, 3 with 30% of low, 4 with all of low)."""
    from ..operators.training import curriculum_plan
    seg = segments(spark, sf)
    return curriculum_plan(spark, seg, sampled_low(spark, sf))


@query("upsample", f"""WITH c AS (SELECT default_payment_next_month AS y, count(*) AS n FROM accounts GROUP BY 1),
mj AS (SELECT y, n FROM c ORDER BY n DESC, y DESC LIMIT 1),
r AS (SELECT id, default_payment_next_month AS y,
  row_number() OVER (PARTITION BY default_payment_next_month ORDER BY {HASH}, id) AS rk FROM accounts)
SELECT id, y AS default_payment_next_month, 1 AS copy FROM r WHERE y = (SELECT y FROM mj)
UNION ALL
SELECT id, y AS default_payment_next_month, CAST(unnest(range(1, k + 1)) AS INT) AS copy FROM (
  SELECT r.id, r.y, (SELECT n FROM mj) // c.n + CASE WHEN r.rk <= (SELECT n FROM mj) % c.n THEN 1 ELSE 0 END AS k
  FROM r JOIN c ON r.y = c.y WHERE r.y <> (SELECT y FROM mj))""", ("accounts",))
def upsample(spark, sf):
    """Minority rows copied round-robin until the classes are equal."""
    acc = views.accounts(spark, sf).select("id", FE.TARGET)
    return S.upsample(acc, FE.TARGET).select("id", FE.TARGET, F.col("copy").cast("int").alias("copy"))


@query("downsample", f"""SELECT id, default_payment_next_month FROM (
  SELECT id, default_payment_next_month,
    row_number() OVER (PARTITION BY default_payment_next_month ORDER BY {HASH}, id) AS rk FROM accounts)
WHERE rk <= (SELECT min(n) FROM (SELECT count(*) AS n FROM accounts GROUP BY default_payment_next_month))""",
       ("accounts",))
def downsample(spark, sf):
    """Every class thinned to the minority count, first in hash order."""
    acc = views.accounts(spark, sf).select("id", FE.TARGET)
    return S.downsample(acc, FE.TARGET)


@query("align_by_key", """SELECT x.id, y.default_payment_next_month, x.limit_bal, x.age
FROM (SELECT id, limit_bal, age FROM accounts) x JOIN (SELECT id, default_payment_next_month FROM accounts) y ON x.id = y.id""",
       ("accounts",))
def align_by_key(spark, sf):
    """Features and labels re-aligned by key (rows have no position in Spark)."""
    acc = views.accounts(spark, sf)
    x = acc.select("id", "limit_bal", "age")
    y = acc.select("id", FE.TARGET)
    return x.join(y, "id").select("id", FE.TARGET, "limit_bal", "age")
