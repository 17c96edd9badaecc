"""SQL text of the fixture views (FIXTURES.md part B), for the DuckDB oracle.

``with_views(sql, *names)`` prefixes a query with the CTEs it needs.
"""

from __future__ import annotations

_PAY = "CAST(substr(o.o_orderpriority,1,1) AS INT)*3-5"

ACCOUNTS = f"""
SELECT c.c_custkey AS id, c.c_acctbal AS limit_bal,
  CAST(1 + c.c_custkey % 2 AS INT) AS sex,
  CAST(c.c_nationkey % 7 AS INT) AS education,
  CAST(c.c_nationkey % 4 AS INT) AS marriage,
  CASE WHEN c.c_custkey % 97 = 0 THEN NULL ELSE CAST(20 + c.c_custkey % 60 AS INT) END AS age,
  max(CASE WHEN o.rn=1 THEN {_PAY} END) AS pay_0,
  max(CASE WHEN o.rn=2 THEN {_PAY} END) AS pay_2,
  max(CASE WHEN o.rn=3 THEN {_PAY} END) AS pay_3,
  max(CASE WHEN o.rn=4 THEN {_PAY} END) AS pay_4,
  max(CASE WHEN o.rn=5 THEN {_PAY} END) AS pay_5,
  max(CASE WHEN o.rn=6 THEN {_PAY} END) AS pay_6,
  max(CASE WHEN o.rn=1 THEN o.o_totalprice END) AS bill_amt1,
  max(CASE WHEN o.rn=2 THEN o.o_totalprice END) AS bill_amt2,
  max(CASE WHEN o.rn=3 THEN o.o_totalprice END) AS bill_amt3,
  max(CASE WHEN o.rn=4 THEN o.o_totalprice END) AS bill_amt4,
  max(CASE WHEN o.rn=5 THEN o.o_totalprice END) AS bill_amt5,
  max(CASE WHEN o.rn=6 THEN o.o_totalprice END) AS bill_amt6,
  max(CASE WHEN o.rn=1 THEN o.o_totalprice/6 END) AS pay_amt1,
  max(CASE WHEN o.rn=2 THEN o.o_totalprice/6 END) AS pay_amt2,
  max(CASE WHEN o.rn=3 THEN o.o_totalprice/6 END) AS pay_amt3,
  max(CASE WHEN o.rn=4 THEN o.o_totalprice/6 END) AS pay_amt4,
  max(CASE WHEN o.rn=5 THEN o.o_totalprice/6 END) AS pay_amt5,
  max(CASE WHEN o.rn=6 THEN o.o_totalprice/6 END) AS pay_amt6,
  max(CASE WHEN o.rn=1 AND o.o_orderstatus='F' THEN 1 ELSE 0 END) AS default_payment_next_month
FROM customer c LEFT JOIN (
  SELECT o_custkey, o_totalprice, o_orderstatus, o_orderpriority,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) o ON c.c_custkey = o.o_custkey AND o.rn <= 6
GROUP BY c.c_custkey, c.c_acctbal, c.c_nationkey
"""

PRED_PROBS = """
SELECT doc_id AS id, quality AS label,
  CAST(1 AS DOUBLE) - CAST((doc_id * 37) % 101 AS DOUBLE) / 100 AS p0,
  CAST((doc_id * 37) % 101 AS DOUBLE) / 100 AS p1
FROM labels
"""

SCORES = """
SELECT c_custkey AS id, CAST((c_custkey * 53) % 101 AS DOUBLE) / 100 AS p1,
  CASE c_custkey % 4 WHEN 0 THEN 'gb_model_v1' WHEN 1 THEN 'rf_model_v2' WHEN 2 THEN 'old_model' ELSE '' END AS model_version
FROM customer
"""

PHI = """
SELECT c.c_custkey AS id, f.feature,
  CAST((c.c_custkey * 31 + f.k * 17) % 101 - 50 AS DOUBLE) / 100 AS phi
FROM customer c CROSS JOIN (VALUES ('LIMIT_BAL',0),('SEX',1),('EDUCATION',2),('MARRIAGE',3),('AGE',4),
  ('PAY_0',5),('BILL_AMT1',6),('PAY_AMT1',7),('total_months_late',8),('utilization_rate',9)) AS f(feature, k)
"""

AUDIT_EVENT = """
SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS created_at,
  concat('trace-', CAST(user_id AS VARCHAR)) AS trace_id,
  concat('TXN-', CAST(user_id AS VARCHAR)) AS client_transaction_id,
  CASE event_type WHEN 'signup' THEN 'DataAssuranceAgent' WHEN 'click' THEN 'Prediction_Agent'
    WHEN 'view' THEN 'Prediction_Agent' WHEN 'purchase' THEN 'Critic_Agent' ELSE 'Orchestrator_Agent' END AS agent_name,
  CASE event_type WHEN 'signup' THEN 'Phase1_DataAssurance' WHEN 'click' THEN 'Phase3_PredictionPipeline'
    WHEN 'view' THEN 'Phase3_PredictionPipeline' WHEN 'purchase' THEN 'Phase3_Governance' ELSE 'Orchestration' END AS phase,
  CASE event_type WHEN 'signup' THEN 'DATA_HASH_SAVED' WHEN 'view' THEN 'PREDICTION_EXECUTED'
    WHEN 'click' THEN 'XAI_EXPLANATIONS_GENERATED' WHEN 'purchase' THEN 'POLICY_EVALUATION_COMPLETED' ELSE 'ERROR' END AS event_type,
  props AS extra_payload, value AS latency_ms
FROM events
"""

EVIDENCE_POINTER = """
SELECT concat('ev-', CAST(event_id AS VARCHAR)) AS evidence_id, ts AS created_at,
  CASE event_type WHEN 'signup' THEN 'CONFIDENT_LEARNING_REPORT' WHEN 'view' THEN 'PREDICTION_RESULT'
    WHEN 'click' THEN 'PREDICTION_XAI_EXPLANATION' WHEN 'purchase' THEN 'GOVERNANCE_DECISION' ELSE 'TRAINED_MODEL' END AS kind,
  concat('path/', CAST(user_id AS VARCHAR), '/', CAST(event_id AS VARCHAR), '.json') AS dvc_path
FROM events
"""

EVENT_LINK = """
SELECT concat('ln-', CAST(event_id AS VARCHAR)) AS link_id, CAST(event_id AS VARCHAR) AS event_id,
  CAST(NULL AS VARCHAR) AS policy_id,
  CASE WHEN event_id % 50 = 0 THEN concat('ds-', CAST(event_id AS VARCHAR)) END AS dataset_id,
  CASE WHEN event_id % 10 = 9 THEN NULL WHEN event_id % 10 = 8 THEN 'ev-missing'
    ELSE concat('ev-', CAST(event_id AS VARCHAR)) END AS evidence_id
FROM events
"""

VIEWS = {
    "accounts": ACCOUNTS, "pred_probs": PRED_PROBS, "scores": SCORES, "phi": PHI,
    "audit_event": AUDIT_EVENT, "evidence_pointer": EVIDENCE_POINTER, "event_link": EVENT_LINK,
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with CTEs for the named views (in the given order)."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
