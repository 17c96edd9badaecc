"""Scoring records, attributions, policies, decisions and escalations (scores + phi)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as AT
from ..operators import policy as PO
from ..sources import views
from .registry import query

SC = ("scores",)
PH = ("phi",)
SP = ("scores", "phi")
RUN_TS = "2024-02-01 00:00:00"


def plain(x: str) -> str:
    return f"rtrim(rtrim(CAST(CAST({x} AS DECIMAL(38,6)) AS VARCHAR), '0'), '.')"


GOV_SQL = f"""top AS (SELECT id, feature, phi,
  row_number() OVER (PARTITION BY id ORDER BY abs(phi) DESC, feature) AS rank FROM phi),
pred AS (SELECT id, p1, CAST(1 AS DOUBLE) - p1 AS p0, greatest(CAST(1 AS DOUBLE) - p1, p1) AS confidence,
  model_version, concat('TXN-', CAST(id AS VARCHAR)) AS client_transaction_id FROM scores),
viol AS (SELECT id, feature AS attribute, abs(phi) AS influence, CAST(0.3 AS DOUBLE) AS threshold,
  'Prohibited attribute ' || feature || ' has excessive influence: ' || {plain('abs(phi)')} AS message
  FROM top WHERE rank <= 5 AND feature IN ('SEX', 'AGE', 'EDUCATION') AND abs(phi) > CAST(0.3 AS DOUBLE)),
nv AS (SELECT id, count(*) AS n FROM viol GROUP BY id),
ev AS (SELECT p.*, p.confidence >= CAST(0.7 AS DOUBLE) AS oversight_allow,
  p.confidence < CAST(0.7 AS DOUBLE) AS requires_human_review,
  'Confidence: ' || {plain('p.confidence')} || ', Threshold: 0.7' AS oversight_message,
  CAST(coalesce(nv.n, 0) AS INTEGER) AS violation_count, coalesce(nv.n, 0) = 0 AS prohibited_allow,
  coalesce(p.model_version <> '' AND p.model_version IN ('gb_model_v1', 'rf_model_v2', 'xgb_model_v3'), false)
    AS provenance_allow
  FROM pred p LEFT JOIN nv ON p.id = nv.id),
dec AS (SELECT *, CASE WHEN oversight_allow THEN 'pass' ELSE 'human_review_required' END AS confidence_status,
  NOT prohibited_allow AS has_violations,
  CASE WHEN (NOT prohibited_allow) OR requires_human_review THEN 'BLOCKED' ELSE 'APPROVED' END AS final_decision
  FROM ev),
reg AS (SELECT * FROM (VALUES
  ('prohibited_attribute_check', 'Article 10 - Data and Data Governance', 'BLOCK'),
  ('oversight_threshold_check', 'Article 14 - Human Oversight', 'ESCALATE'),
  ('provenance_compliance_check', 'Article 9 - Risk Management System', 'DENY')) AS r(policy, article, action_on_violation)),
res AS (SELECT id, 'oversight_threshold_check' AS policy, oversight_allow AS allow FROM ev
  UNION ALL SELECT id, 'prohibited_attribute_check', prohibited_allow FROM ev
  UNION ALL SELECT id, 'provenance_compliance_check', provenance_allow FROM ev)"""


def predictions(spark, sf):
    rec = PO.prediction_record(views.scores(spark, sf))
    return rec.withColumn("client_transaction_id", F.concat(F.lit("TXN-"), F.col("id").cast("string")))


def evaluated(spark, sf):
    drivers = AT.pack_drivers(views.phi(spark, sf))
    return PO.evaluate(predictions(spark, sf), drivers)


def decided(spark, sf):
    return PO.decide(evaluated(spark, sf))


@query("prediction_record", """SELECT id, CAST(p1 >= 0.5 AS INTEGER) AS prediction_label, CAST(1 AS DOUBLE) - p1 AS p0, p1,
  greatest(CAST(1 AS DOUBLE) - p1, p1) AS confidence, p1 >= 0.5 AS is_default_risk, model_version FROM scores""", SC)
def prediction_record(spark, sf):
    """Per-row scoring record."""
    return PO.prediction_record(views.scores(spark, sf))


@query("top_drivers", "SELECT id, CAST(rank AS INTEGER) AS rank, feature, phi FROM (SELECT id, feature, phi, "
       "row_number() OVER (PARTITION BY id ORDER BY abs(phi) DESC, feature) AS rank FROM phi) WHERE rank <= 5", PH)
def top_drivers(spark, sf):
    """Five largest |attribution| per row, signed values kept."""
    return AT.top_drivers_long(views.phi(spark, sf))


@query("local_drivers", f"""WITH {GOV_SQL.split('pred AS')[0].rstrip().rstrip(',')}
SELECT id, string_agg(feature, ',' ORDER BY rank) AS risk_factors,
  max(CASE WHEN rank = 1 THEN feature END) AS top_feature, max(CASE WHEN rank = 1 THEN phi END) AS top_phi,
  count(*) AS n_drivers
FROM top WHERE rank <= 5 GROUP BY id""", PH)
def local_drivers(spark, sf):
    """Every row's drivers: risk factors in rank order and the strongest one."""
    ld = AT.local_drivers(views.phi(spark, sf))
    return ld.select("id", F.array_join("risk_factors", ",").alias("risk_factors"),
                     F.col("drivers")[0]["feature"].alias("top_feature"), F.col("drivers")[0]["phi"].alias("top_phi"),
                     F.size("drivers").cast("bigint").alias("n_drivers"))


@query("influence_graph", """SELECT id, feature, CASE WHEN phi > 0.15 THEN 'strong_positive' WHEN phi > 0.07 THEN 'moderate_positive'
  WHEN phi < -0.10 THEN 'strong_negative' WHEN phi < -0.05 THEN 'moderate_negative' ELSE 'weak' END AS strength FROM phi""", PH)
def influence_graph(spark, sf):
    """L13 + F12: strength label per (row, feature)."""
    return AT.influence_graph(views.phi(spark, sf))


@query("global_importance", "SELECT feature, round(avg(abs(phi)), 6) AS importance FROM phi GROUP BY feature", PH)
def global_importance(spark, sf):
    """Mean |phi| per feature."""
    return AT.global_importance(views.phi(spark, sf)).select("feature", F.round("importance", 6).alias("importance"))


_GROUPS_SQL = ", ".join(f"('{f}', '{g}')" for g, fs in AT.FEATURE_GROUPS.items() for f in fs)


@query("sensitive_share", f"""WITH g AS (SELECT * FROM (VALUES {_GROUPS_SQL}) AS t(feature, feature_group)),
per AS (SELECT coalesce(g.feature_group, 'ungrouped') AS feature_group, sum(abs(p.phi)) AS total_abs
  FROM phi p LEFT JOIN g ON p.feature = g.feature GROUP BY 1)
SELECT feature_group, round(total_abs, 6) AS total_abs, round(total_abs / sum(total_abs) OVER (), 6) AS share,
  feature_group = 'demographic_sensitive' AND total_abs / sum(total_abs) OVER () > CAST({AT.SENSITIVE_SHARE} AS DOUBLE) AS flagged FROM per""", PH)
def sensitive_share(spark, sf):
    """Share of total |attribution| per feature group; demographic_sensitive is flagged above the threshold."""
    s = AT.group_share(views.phi(spark, sf))
    return s.select("feature_group", F.round("total_abs", 6).alias("total_abs"), F.round("share", 6).alias("share"), "flagged")


@query("policy_oversight", f"WITH {GOV_SQL}\nSELECT id, oversight_allow AS allow, requires_human_review, "
       "oversight_message AS message FROM ev", SP)
def policy_oversight(spark, sf):
    """G1 + F13: confidence >= 0.7 or human review."""
    return evaluated(spark, sf).select("id", F.col("oversight_allow").alias("allow"), "requires_human_review",
                                       F.col("oversight_message").alias("message"))


@query("policy_prohibited", f"WITH {GOV_SQL}\nSELECT id, violation_count, prohibited_allow AS allow FROM ev", SP)
def policy_prohibited(spark, sf):
    """Prohibited attributes among the top drivers with |influence| > 0.3."""
    return evaluated(spark, sf).select("id", F.size("violations").alias("violation_count"),
                                       F.col("prohibited_allow").alias("allow"))


@query("policy_violations", f"WITH {GOV_SQL}\nSELECT id, attribute, influence, threshold, message FROM viol", SP)
def policy_violations(spark, sf):
    """G2 detail + F13: one row per violation with its message."""
    ev = evaluated(spark, sf)
    return ev.select("id", F.explode("violations").alias("v")).select("id", "v.attribute", "v.influence",
                                                                      "v.threshold", "v.message")


@query("policy_provenance", """SELECT id, coalesce(model_version <> '' AND model_version IN ('gb_model_v1', 'rf_model_v2', 'xgb_model_v3'), false) AS allow,
  CASE WHEN coalesce(model_version <> '' AND model_version IN ('gb_model_v1', 'rf_model_v2', 'xgb_model_v3'), false)
    THEN 'Approved model' ELSE 'Model not approved' END AS message FROM scores""", SC)
def policy_provenance(spark, sf):
    """Approved, non-empty model version."""
    p = PO.provenance()
    return views.scores(spark, sf).select("id", p["allow"].alias("allow"), p["message"].alias("message"))


@query("policy_results", f"WITH {GOV_SQL}\nSELECT res.id, res.policy, res.allow, reg.action_on_violation "
       "FROM res JOIN reg ON res.policy = reg.policy", SP)
def policy_results(spark, sf):
    """Every registered policy evaluated for every prediction."""
    return PO.policy_results(evaluated(spark, sf))


@query("final_decision", f"WITH {GOV_SQL}\nSELECT id, confidence_status, has_violations, final_decision FROM dec", SP)
def final_decision(spark, sf):
    """APPROVED iff no violation and no review needed."""
    return decided(spark, sf).select("id", "confidence_status", "has_violations", "final_decision")


@query("governance_report", f"""WITH {GOV_SQL}
SELECT d.id, d.final_decision, d.confidence_status, d.violation_count, d.confidence,
  coalesce((SELECT string_agg(r.policy, ',' ORDER BY r.policy) FROM res r WHERE r.id = d.id AND NOT r.allow), '') AS failed_policies
FROM dec d""", SP)
def governance_report(spark, sf):
    """Decision record with its failed policies."""
    d = decided(spark, sf)
    failed = F.array_sort(F.filter(F.array(
        F.when(~F.col("oversight_allow"), F.lit(PO.OVERSIGHT)),
        F.when(~F.col("prohibited_allow"), F.lit(PO.PROHIBITED)),
        F.when(~F.col("provenance_allow"), F.lit(PO.PROVENANCE))), lambda x: x.isNotNull()))
    return d.select("id", "final_decision", "confidence_status", F.size("violations").alias("violation_count"),
                    "confidence", F.array_join(failed, ",").alias("failed_policies"))


@query("escalations", f"""WITH {GOV_SQL}
SELECT 'ESC-' || client_transaction_id || '-' || strftime(TIMESTAMP '{RUN_TS}', '%Y%m%d%H%M%S') AS escalation_id,
  id, client_transaction_id, confidence, violation_count, 'Human review required' AS action,
  TIMESTAMP '{RUN_TS}' AS escalated_at
FROM dec WHERE final_decision = 'BLOCKED'""", SP)
def escalations(spark, sf):
    """G7 + F10: one escalation per blocked prediction."""
    return PO.escalations(decided(spark, sf), RUN_TS).select(
        "escalation_id", "id", "client_transaction_id", "confidence",
        F.col("violation_count").cast("int").alias("violation_count"), "action", "escalated_at")


@query("violation_summary", f"WITH {GOV_SQL}\nSELECT policy, count(*) FILTER (WHERE NOT allow) AS n_failed, "
       "count(*) AS n_evaluated FROM res GROUP BY policy", SP)
def violation_summary(spark, sf):
    """Failures per policy."""
    r = PO.policy_results(evaluated(spark, sf))
    return r.groupBy("policy").agg(F.count_if(~F.col("allow")).alias("n_failed"),
                                   F.count(F.lit(1)).alias("n_evaluated"))


@query("decision_counts", f"WITH {GOV_SQL}\nSELECT final_decision, count(*) AS n, "
       "CAST(sum(violation_count) AS BIGINT) AS violations FROM dec GROUP BY final_decision", SP)
def decision_counts(spark, sf):
    """Predictions and violations per decision."""
    return decided(spark, sf).groupBy("final_decision").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("violations")).cast("bigint").alias("violations"))


@query("policy_regulation", f"""WITH {GOV_SQL}
SELECT res.policy, reg.article, reg.action_on_violation, count(*) AS n_failed
FROM res JOIN reg ON res.policy = reg.policy WHERE NOT res.allow GROUP BY res.policy, reg.article, reg.action_on_violation""", SP)
def policy_regulation(spark, sf):
    """Failed checks joined to their regulation article and action."""
    r = PO.policy_results(evaluated(spark, sf)).where(~F.col("allow"))
    reg = PO.registry(spark).select("policy", "article")
    return (r.join(F.broadcast(reg), "policy").groupBy("policy", "article", "action_on_violation")
            .agg(F.count(F.lit(1)).alias("n_failed")))


def _decision_graph(spark, sf):
    """FinalDecision, Violation, PolicyCheck and HumanOversight nodes with their edges."""
    d = decided(spark, sf)
    dec_id = F.concat(F.lit("decision-"), F.col("id").cast("string"))
    decisions = d.select(dec_id.alias("node_id"), F.lit("FinalDecision").alias("label"),
                         F.col("final_decision").alias("node_type"), F.col("id"))
    viol = d.select("id", dec_id.alias("src"), F.explode("violations").alias("v")).select(
        "id", "src", F.concat(F.lit("violation-"), F.col("id").cast("string"), F.lit("-"), F.col("v.attribute")).alias("node_id"),
        F.lit("Violation").alias("label"), F.col("v.attribute").alias("node_type"))
    checks = PO.policy_results(d).select(
        "id", F.concat(F.lit("decision-"), F.col("id").cast("string")).alias("src"),
        F.concat(F.lit("check-"), F.col("id").cast("string"), F.lit("-"), F.col("policy")).alias("node_id"),
        F.lit("PolicyCheck").alias("label"), F.when(F.col("allow"), "allow").otherwise("deny").alias("node_type"))
    esc = PO.escalations(d, RUN_TS).select(
        "id", F.concat(F.lit("decision-"), F.col("id").cast("string")).alias("src"), F.col("escalation_id").alias("node_id"),
        F.lit("HumanOversight").alias("label"), F.col("action").alias("node_type"))
    nodes = decisions.select("node_id", "label", "node_type")
    for part in (viol, checks, esc):
        nodes = nodes.unionByName(part.select("node_id", "label", "node_type"))
    edges = (viol.select("src", F.col("node_id").alias("dst"), F.lit("HAS_VIOLATION").alias("edge_type"))
             .unionByName(checks.select("src", F.col("node_id").alias("dst"), F.lit("CHECKED_BY").alias("edge_type")))
             .unionByName(esc.select("src", F.col("node_id").alias("dst"), F.lit("ESCALATED_TO").alias("edge_type"))))
    return nodes, edges


_DG_SQL = f"""dn AS (
  SELECT 'decision-' || CAST(id AS VARCHAR) AS node_id, 'FinalDecision' AS label, final_decision AS node_type FROM dec
  UNION ALL SELECT 'violation-' || CAST(id AS VARCHAR) || '-' || attribute, 'Violation', attribute FROM viol
  UNION ALL SELECT 'check-' || CAST(id AS VARCHAR) || '-' || policy, 'PolicyCheck', CASE WHEN allow THEN 'allow' ELSE 'deny' END FROM res
  UNION ALL SELECT 'ESC-' || client_transaction_id || '-' || strftime(TIMESTAMP '{RUN_TS}', '%Y%m%d%H%M%S'), 'HumanOversight',
    'Human review required' FROM dec WHERE final_decision = 'BLOCKED'),
de AS (
  SELECT 'decision-' || CAST(id AS VARCHAR) AS src, 'violation-' || CAST(id AS VARCHAR) || '-' || attribute AS dst, 'HAS_VIOLATION' AS edge_type FROM viol
  UNION ALL SELECT 'decision-' || CAST(id AS VARCHAR), 'check-' || CAST(id AS VARCHAR) || '-' || policy, 'CHECKED_BY' FROM res
  UNION ALL SELECT 'decision-' || CAST(id AS VARCHAR), 'ESC-' || client_transaction_id || '-' || strftime(TIMESTAMP '{RUN_TS}', '%Y%m%d%H%M%S'),
    'ESCALATED_TO' FROM dec WHERE final_decision = 'BLOCKED')"""


@query("decision_nodes", f"WITH {GOV_SQL},\n{_DG_SQL}\nSELECT * FROM dn", SP)
def decision_nodes(spark, sf):
    """C22 nodes: decisions, violations, policy checks, human-oversight escalations."""
    return _decision_graph(spark, sf)[0]


@query("decision_edges", f"WITH {GOV_SQL},\n{_DG_SQL}\nSELECT * FROM de", SP)
def decision_edges(spark, sf):
    """C22 edges: decision -> violation / check / escalation."""
    return _decision_graph(spark, sf)[1]


def _full_decision_graph(spark, sf):
    """C22 with all node kinds: also an ExplanationArtifact (the drivers in rank order) where the prediction has attributions,
    and the PredictionMetrics (the predicted label)."""
    nodes, edges = _decision_graph(spark, sf)
    d = decided(spark, sf).withColumn("src", F.concat(F.lit("decision-"), F.col("id").cast("string")))
    xai = d.where(F.size("drivers") > 0).select(
        "src", F.concat(F.lit("explanation-"), F.col("id").cast("string")).alias("node_id"), F.lit("ExplanationArtifact").alias("label"),
        F.array_join(F.transform("drivers", lambda x: x["feature"]), ",").alias("node_type"), F.lit("EXPLAINED_BY").alias("edge_type"))
    metrics = d.select(
        "src", F.concat(F.lit("metrics-"), F.col("id").cast("string")).alias("node_id"), F.lit("PredictionMetrics").alias("label"),
        F.col("prediction_label").cast("string").alias("node_type"), F.lit("HAS_METRICS").alias("edge_type"))
    for part in (xai, metrics):
        nodes = nodes.unionByName(part.select("node_id", "label", "node_type"))
        edges = edges.unionByName(part.select("src", F.col("node_id").alias("dst"), "edge_type"))
    return nodes, edges


_FULL_DG_SQL = f"""{_DG_SQL},
xai AS (SELECT s.id, string_agg(t.feature, ',' ORDER BY t.rank) AS drivers FROM scores s JOIN top t ON s.id = t.id
  WHERE t.rank <= 5 GROUP BY s.id)"""


@query("decision_graph_nodes", f"""WITH {GOV_SQL},\n{_FULL_DG_SQL}
SELECT * FROM dn
UNION ALL SELECT 'explanation-' || CAST(id AS VARCHAR), 'ExplanationArtifact', drivers FROM xai
UNION ALL SELECT 'metrics-' || CAST(id AS VARCHAR), 'PredictionMetrics', CAST(CAST(p1 >= 0.5 AS INTEGER) AS VARCHAR) FROM scores""", SP)
def decision_graph_nodes(spark, sf):
    """C22 nodes of all six kinds."""
    return _full_decision_graph(spark, sf)[0]


@query("decision_graph_edges", f"""WITH {GOV_SQL},\n{_FULL_DG_SQL}
SELECT * FROM de
UNION ALL SELECT 'decision-' || CAST(id AS VARCHAR), 'explanation-' || CAST(id AS VARCHAR), 'EXPLAINED_BY' FROM xai
UNION ALL SELECT 'decision-' || CAST(id AS VARCHAR), 'metrics-' || CAST(id AS VARCHAR), 'HAS_METRICS' FROM scores""", SP)
def decision_graph_edges(spark, sf):
    """C22 edges from the decisions to nodes of the five other kinds."""
    return _full_decision_graph(spark, sf)[1]


@query("escalation_rate", f"WITH {GOV_SQL}\nSELECT count(*) AS predictions, count(*) FILTER (WHERE final_decision = 'BLOCKED') AS blocked, "
       "round(avg(CASE WHEN final_decision = 'BLOCKED' THEN 1.0 ELSE 0.0 END) * 100, 6) AS escalation_pct FROM dec", SP)
def escalation_rate(spark, sf):
    """Share of predictions escalated to human review."""
    d = decided(spark, sf)
    blocked = F.col("final_decision") == "BLOCKED"
    return d.agg(F.count(F.lit(1)).alias("predictions"), F.count_if(blocked).alias("blocked"),
                 F.round(F.avg(blocked.cast("double")) * 100, 6).alias("escalation_pct"))


@query("policy_reevaluation", f"""WITH {GOV_SQL},
dec2 AS (SELECT id, CASE WHEN (NOT prohibited_allow) OR confidence < CAST(0.8 AS DOUBLE) THEN 'BLOCKED' ELSE 'APPROVED' END AS final_decision
  FROM ev)
SELECT a.id, a.final_decision AS decision_before, b.final_decision AS decision_after
FROM dec a JOIN dec2 b ON a.id = b.id WHERE a.final_decision <> b.final_decision""", SP)
def policy_reevaluation(spark, sf):
    """Decisions re-evaluated under a stricter threshold (0.8); only changed ones."""
    drivers = AT.pack_drivers(views.phi(spark, sf))
    preds = predictions(spark, sf)
    before = PO.decide(PO.evaluate(preds, drivers)).select("id", F.col("final_decision").alias("decision_before"))
    after = PO.decide(PO.evaluate(preds, drivers, threshold=0.8)).select("id", F.col("final_decision").alias("decision_after"))
    return before.join(after, "id").where(F.col("decision_before") != F.col("decision_after"))
