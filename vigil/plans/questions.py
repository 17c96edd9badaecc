"""Audit-question queries: routing, answers per intent, rendered text, history."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import questions as QU
from ..session import scratch_path, written
from ..sources import views
from .audit import GRAPH_SQL, _graph
from .governance import GOV_SQL, decided
from .registry import query

VIEWS = ("audit_event", "evidence_pointer", "event_link", "scores", "phi")
B = QU.BULLET


def _route_sql(col="question"):
    parts = []
    for intent, words, _ in QU.INTENTS:
        if words:
            cond = " OR ".join(f"contains(lower({col}), '{w}')" for w in words)
            parts.append(f"WHEN {cond} THEN '{intent}'")
    return "CASE " + " ".join(parts) + " ELSE 'fallback' END"


_TEMPLATES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(QU.QUESTION_TEMPLATES))
_LIMITS = ", ".join(f"('{i}', {lim})" for i, _, lim in QU.INTENTS)


def _target_sql(name, edge, etype=None, n=1):
    where = f"WHERE e.event_type = '{etype}'" if etype else ""
    return f"""{name} AS (SELECT client_transaction_id, target_id, target_label, pos FROM (
  SELECT e.client_transaction_id, x.dst AS target_id, x.dst_label AS target_label,
    row_number() OVER (PARTITION BY e.client_transaction_id ORDER BY e.created_at, e.event_id, x.dst) AS pos
  FROM evs e JOIN edges x ON x.src = e.event_id AND x.edge_type = '{edge}' {where}) WHERE pos <= {n})"""


def _u(x):
    return f"coalesce(CAST({x} AS VARCHAR), 'Unknown')"


Q_SQL = f"""{GRAPH_SQL},
{GOV_SQL},
edges AS (SELECT * FROM eedges UNION ALL SELECT * FROM ledges),
evs AS (SELECT event_id, client_transaction_id, event_type, created_at, agent_name FROM audit_event),
questions AS (
  SELECT t.client_transaction_id || '#' || CAST(q.n AS VARCHAR) AS question_id, t.client_transaction_id,
    replace(q.t, '{{txn}}', t.client_transaction_id) AS question
  FROM (SELECT DISTINCT client_transaction_id FROM audit_event WHERE client_transaction_id IS NOT NULL) t
  CROSS JOIN (VALUES {_TEMPLATES}) AS q(n, t)),
routed AS (SELECT *, {_route_sql()} AS intent FROM questions),
limits AS (SELECT * FROM (VALUES {_LIMITS}) AS l(intent, row_limit)),
why AS (SELECT f.client_transaction_id, f.event_type, d.final_decision, d.confidence_status, d.violation_count FROM (
    SELECT *, row_number() OVER (PARTITION BY client_transaction_id ORDER BY created_at, event_id) AS pos FROM evs) f
  LEFT JOIN (SELECT src AS event_id, dst AS gov_id FROM edges WHERE edge_type = 'EVALUATED') g ON f.event_id = g.event_id
  LEFT JOIN (SELECT CAST(id AS VARCHAR) AS gov_id, final_decision, confidence_status, violation_count FROM dec) d
    ON g.gov_id = d.gov_id
  WHERE f.pos = 1),
{_target_sql("dh", "CREATED", "DATA_HASH_SAVED")},
{_target_sql("evd", "HAS_EVIDENCE", None, 5)},
{_target_sql("pr", "PREDICTED", "PREDICTION_EXECUTED")},
{_target_sql("md", "TRAINED", "MODEL_TRAINING_COMPLETED")},
tl AS (SELECT * FROM (SELECT client_transaction_id, event_id, event_type, created_at,
  row_number() OVER (PARTITION BY client_transaction_id ORDER BY created_at, event_id) AS pos FROM evs) WHERE pos <= 10),
ag AS (SELECT * EXCLUDE (rn) FROM (SELECT client_transaction_id, agent_name, count(*) AS event_count,
  row_number() OVER (PARTITION BY client_transaction_id ORDER BY agent_name) AS rn FROM evs GROUP BY 1, 2) WHERE rn <= 10),
answers AS (
  SELECT client_transaction_id, 'why' AS intent, '**Transaction ' || client_transaction_id || ' Analysis:**' || chr(10) ||
    '{B} **Event Type**: ' || {_u('event_type')} || chr(10) || '{B} **Final Decision**: ' || {_u('final_decision')} || chr(10) ||
    '{B} **Confidence Status**: ' || {_u('confidence_status')} || chr(10) || chr(10) ||
    CASE WHEN final_decision = 'BLOCKED' THEN '{QU.BLOCKED_NOTE}' WHEN final_decision = 'APPROVED' THEN '{QU.APPROVED_NOTE}' ELSE '' END AS body
  FROM why
  UNION ALL SELECT client_transaction_id, 'data_hash', '**Data Provenance for ' || client_transaction_id || ':**' || chr(10) ||
    '{B} **Type**: ProcessedData' || chr(10) || '{B} **SHA-256**: ' || target_id FROM dh
  UNION ALL SELECT e.client_transaction_id, 'evidence', '**Evidence Found:**' || chr(10) || '{B} **ID**: ' || e.target_id || chr(10) ||
    '{B} **Kind**: ' || {_u('p.kind')} || chr(10) || '{B} **Type**: ' || {_u('e.target_label')}
    FROM evd e LEFT JOIN evidence_pointer p ON p.evidence_id = e.target_id WHERE e.pos = 1
  UNION ALL SELECT client_transaction_id, 'prediction', '**Prediction Record:**' || chr(10) || '{B} **ID**: ' || target_id || chr(10) ||
    '{B} **Type**: PredictionResult' FROM pr
  UNION ALL SELECT client_transaction_id, 'model_lineage', '**Model Training Record:**' || chr(10) || '{B} **Model ID**: ' || target_id ||
    chr(10) || '{B} **Type**: TrainedModel' FROM md
  UNION ALL SELECT client_transaction_id, 'timeline', '**Event Timeline for ' || client_transaction_id || ':**' || chr(10) ||
    string_agg('{B} ' || event_type || ' at ' || strftime(created_at, '%Y-%m-%d %H:%M:%S'), chr(10) ORDER BY pos)
    FROM tl WHERE pos <= 5 GROUP BY client_transaction_id
  UNION ALL SELECT client_transaction_id, 'agents', '**Agents Involved in ' || client_transaction_id || ':**' || chr(10) ||
    string_agg('{B} ' || agent_name || ' (' || CAST(event_count AS VARCHAR) || ' events)', chr(10) ORDER BY agent_name)
    FROM ag GROUP BY client_transaction_id
  UNION ALL SELECT client_transaction_id, 'fallback', '**Recent Events for ' || client_transaction_id || ':**' || chr(10) ||
    string_agg('{B} ' || event_type, chr(10) ORDER BY pos) FROM tl WHERE pos <= 3 GROUP BY client_transaction_id),
rendered AS (SELECT r.question_id, r.client_transaction_id, r.question, r.intent,
  CASE WHEN a.body IS NULL THEN 'No audit records found for Transaction ID ' || r.client_transaction_id || '.'
    ELSE a.body || chr(10) || chr(10) || 'How else may I assist with this audit?' END AS response
  FROM routed r LEFT JOIN answers a ON a.client_transaction_id = r.client_transaction_id AND a.intent = r.intent)"""


def _parts(spark, sf, reuse: bool = False):
    """Audit tables and all edges; ``reuse`` writes the edges once for queries that read them several times. Otherwise a filter
    on the edge type drops the parts of the union that can't hold it."""
    t, en, ee, an, le = _graph(spark, sf)
    edges = ee.unionByName(le)
    if reuse:
        edges = written(edges, "edges")
    return t, edges


@query("question_intent", f"WITH {Q_SQL}\nSELECT question_id, client_transaction_id, question, intent FROM routed", VIEWS)
def question_intent(spark, sf):
    """C10 + F14: route every question by its first matching keyword."""
    q = QU.question_table(views.audit_event(spark, sf))
    return q.withColumn("intent", QU.route())


@query("answer_why", f"WITH {Q_SQL}\nSELECT * FROM why", VIEWS)
def answer_why(spark, sf):
    """C11: first event, its governance node and the decision behind it."""
    t, edges = _parts(spark, sf)
    return QU.answer_why(t["audit_event"], edges, decided(spark, sf))


@query("answer_why_detail", f"""WITH {Q_SQL}
SELECT f.client_transaction_id, f.event_type, d.final_decision, d.confidence_status, d.violations, d.policies FROM (
    SELECT *, row_number() OVER (PARTITION BY client_transaction_id ORDER BY created_at, event_id) AS pos FROM evs) f
  LEFT JOIN (SELECT src AS event_id, dst AS gov_id FROM edges WHERE edge_type = 'EVALUATED') g ON f.event_id = g.event_id
  LEFT JOIN (SELECT CAST(dec.id AS VARCHAR) AS gov_id, final_decision, confidence_status, coalesce(v.attributes, '') AS violations,
    'oversight_threshold_check,prohibited_attribute_check' AS policies
    FROM dec LEFT JOIN (SELECT id, string_agg(attribute, ',' ORDER BY attribute) AS attributes FROM viol GROUP BY id) v ON dec.id = v.id) d
    ON g.gov_id = d.gov_id
  WHERE f.pos = 1""", VIEWS)
def answer_why_detail(spark, sf):
    """C11 in full: also the violated attributes and the policies enforced (the operator's arrays, joined)."""
    t, edges = _parts(spark, sf)
    a = QU.answer_why_detail(t["audit_event"], edges, decided(spark, sf))
    return a.withColumns({c: F.array_join(c, ",") for c in ("violations", "policies")})


@query("answer_data_hash", f"WITH {Q_SQL}\nSELECT client_transaction_id, target_id AS data_hash, 'ProcessedData' AS data_type FROM dh",
       VIEWS)
def answer_data_hash(spark, sf):
    """Dataset hash created by the transaction's DATA_HASH_SAVED event."""
    t, edges = _parts(spark, sf)
    a = QU.answer_target(t["audit_event"], edges, "DATA_HASH_SAVED", "CREATED")
    return a.select("client_transaction_id", F.col("target_id").alias("data_hash"), F.lit("ProcessedData").alias("data_type"))


@query("answer_evidence", f"""WITH {Q_SQL}
SELECT e.client_transaction_id, e.target_id AS evidence_id, p.kind AS evidence_kind, e.target_label AS evidence_type,
  CAST(e.pos AS INTEGER) AS position
FROM evd e LEFT JOIN evidence_pointer p ON p.evidence_id = e.target_id""", VIEWS)
def answer_evidence(spark, sf):
    """Up to five evidence rows per transaction."""
    t, edges = _parts(spark, sf)
    a = QU.answer_target(t["audit_event"], edges, None, "HAS_EVIDENCE", 5)
    kinds = t["evidence_pointer"].select(F.col("evidence_id").alias("target_id"), F.col("kind").alias("evidence_kind"))
    return a.join(kinds, "target_id", "left").select(
        "client_transaction_id", F.col("target_id").alias("evidence_id"), "evidence_kind",
        F.col("target_label").alias("evidence_type"), F.col("position").cast("int").alias("position"))


@query("answer_prediction", f"""WITH {Q_SQL}
SELECT p.client_transaction_id, p.target_id AS prediction_id, 'PredictionResult' AS prediction_type,
  CAST(s.p1 >= 0.5 AS INTEGER) AS prediction_label, s.p1 AS probability, s.model_version
FROM pr p LEFT JOIN scores s ON CAST(s.id AS VARCHAR) = p.target_id""", VIEWS)
def answer_prediction(spark, sf):
    """C14: prediction node of the transaction's PREDICTION_EXECUTED event, with its label, probability and model."""
    t, edges = _parts(spark, sf)
    a = QU.answer_target(t["audit_event"], edges, "PREDICTION_EXECUTED", "PREDICTED")
    sc = views.scores(spark, sf).select(F.col("id").cast("string").alias("target_id"),
                                         (F.col("p1") >= 0.5).cast("int").alias("prediction_label"),
                                         F.col("p1").alias("probability"), "model_version")
    return a.join(sc, "target_id", "left").select(
        "client_transaction_id", F.col("target_id").alias("prediction_id"), F.lit("PredictionResult").alias("prediction_type"),
        "prediction_label", "probability", "model_version")


@query("answer_model", f"WITH {Q_SQL}\nSELECT client_transaction_id, target_id AS model_id, 'TrainedModel' AS model_type FROM md",
       VIEWS)
def answer_model(spark, sf):
    """Model trained by the transaction (none in the audit data: empty)."""
    t, edges = _parts(spark, sf)
    a = QU.answer_target(t["audit_event"], edges, "MODEL_TRAINING_COMPLETED", "TRAINED")
    return a.select("client_transaction_id", F.col("target_id").alias("model_id"), F.lit("TrainedModel").alias("model_type"))


@query("answer_timeline", f"WITH {Q_SQL}\nSELECT client_transaction_id, event_id, event_type, created_at, "
       "CAST(pos AS INTEGER) AS position FROM tl", VIEWS)
def answer_timeline(spark, sf):
    """First ten events per transaction."""
    a = QU.answer_timeline(views.audit_event(spark, sf), 10)
    return a.select("client_transaction_id", "event_id", "event_type", "created_at",
                    F.col("position").cast("int").alias("position"))


@query("answer_agents", f"WITH {Q_SQL}\nSELECT client_transaction_id, body AS agents FROM answers WHERE intent = 'agents'", VIEWS)
def answer_agents(spark, sf):
    """C17: agents and their event counts per transaction, as listed text."""
    r = question_answers(spark, sf)
    return r.where(F.col("intent") == "agents").select(
        "client_transaction_id", F.regexp_replace("response", r"\n\nHow else may I assist with this audit\?$", "").alias("agents"))


@query("question_answers", f"WITH {Q_SQL}\nSELECT * FROM rendered", VIEWS)
def question_answers(spark, sf):
    """Rendered response for every question (or 'No audit records found')."""
    t, edges = _parts(spark, sf, reuse=True)
    q = QU.question_table(t["audit_event"])
    return QU.render(q, t["audit_event"], edges, t["evidence_pointer"], decided(spark, sf))


@query("answer_history", f"WITH {Q_SQL}\nSELECT question_id, client_transaction_id, question, response, "
       "'intent:' || intent AS query_template FROM rendered", VIEWS)
def answer_history(spark, sf):
    """Question, response, transaction and the query used, appended to a history table."""
    r = question_answers(spark, sf).select("question_id", "client_transaction_id", "question", "response",
                                           F.concat(F.lit("intent:"), F.col("intent")).alias("query_template"))
    path = scratch_path(spark, f"answers-{uuid.uuid4().hex}")
    r.write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("template_limits", f"""WITH {Q_SQL},
hits AS (
  SELECT client_transaction_id, 'why' AS intent, count(*) AS n FROM why GROUP BY 1
  UNION ALL SELECT client_transaction_id, 'data_hash', count(*) FROM dh GROUP BY 1
  UNION ALL SELECT client_transaction_id, 'evidence', count(*) FROM evd GROUP BY 1
  UNION ALL SELECT client_transaction_id, 'prediction', count(*) FROM pr GROUP BY 1
  UNION ALL SELECT client_transaction_id, 'model_lineage', count(*) FROM md GROUP BY 1
  UNION ALL SELECT client_transaction_id, 'timeline', count(*) FROM tl GROUP BY 1
  UNION ALL SELECT client_transaction_id, 'agents', count(*) FROM ag GROUP BY 1
  UNION ALL SELECT client_transaction_id, 'fallback', count(*) FILTER (WHERE pos <= 5) FROM tl GROUP BY 1)
SELECT r.question_id, r.intent, l.row_limit, coalesce(h.n, 0) AS n_rows
FROM routed r JOIN limits l ON l.intent = r.intent
LEFT JOIN hits h ON h.client_transaction_id = r.client_transaction_id AND h.intent = r.intent""", VIEWS)
def template_limits(spark, sf):
    """T4: rows each question's intent returns under its limit (1 / 5 / 10)."""
    t, edges = _parts(spark, sf, reuse=True)
    ev = t["audit_event"]
    lim = dict((i, n) for i, _, n in QU.INTENTS)
    c = lambda df, intent: df.groupBy("client_transaction_id").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "intent", F.lit(intent))
    ag = QU.agent_counts(ev, lim["agents"])
    hits = [
        c(QU.answer_why(ev, edges, decided(spark, sf)), "why"),
        c(QU.answer_target(ev, edges, "DATA_HASH_SAVED", "CREATED", lim["data_hash"]), "data_hash"),
        c(QU.answer_target(ev, edges, None, "HAS_EVIDENCE", lim["evidence"]), "evidence"),
        c(QU.answer_target(ev, edges, "PREDICTION_EXECUTED", "PREDICTED", lim["prediction"]), "prediction"),
        c(QU.answer_target(ev, edges, "MODEL_TRAINING_COMPLETED", "TRAINED", lim["model_lineage"]), "model_lineage"),
        c(QU.answer_timeline(ev, lim["timeline"]), "timeline"),
        c(ag, "agents"),
        c(QU.answer_timeline(ev, lim["fallback"]), "fallback"),
    ]
    from functools import reduce
    hits = reduce(lambda a, b: a.unionByName(b), hits)
    routed = QU.question_table(ev).withColumn("intent", QU.route())
    limits = QU.limits_table(spark)
    # The limits table has one row per intent: a fixed-size broadcast.
    return routed.join(F.broadcast(limits), "intent").join(hits, ["client_transaction_id", "intent"], "left").select(
        "question_id", "intent", "row_limit", F.coalesce("n", F.lit(0)).alias("n_rows"))
