"""Audit-trail and lineage queries (audit_event, evidence_pointer, event_link)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import audit as AU
from ..operators import lineage as LI
from ..session import scratch_path
from ..sources import sinks, views
from .registry import query

AE = ("audit_event",)
EP = ("evidence_pointer",)
EL = ("event_link",)
ALL3 = ("audit_event", "evidence_pointer", "event_link")


def _tables(spark, sf):
    return {"audit_event": views.audit_event(spark, sf), "evidence_pointer": views.evidence_pointer(spark, sf),
            "event_link": views.event_link(spark, sf)}


def _fresh(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


# ---------------------------------------------------------------- sinks

@query("sink_tables", """SELECT id, split, limit_bal, default_payment_next_month FROM (
  SELECT id, limit_bal, default_payment_next_month,
    CASE WHEN (CAST(('0x' || substr(sha256(CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) % 1000) < 125 THEN 'val' ELSE 'train' END AS split
  FROM accounts)""", ("accounts",))
def sink_tables(spark, sf):
    """Splits written as one table partitioned by split, read back."""
    from ..operators.sampling import hash_split
    acc = views.accounts(spark, sf).select("id", "limit_bal", "default_payment_next_month")
    back = sinks.write_splits(hash_split(acc), _fresh(spark, "splits"))
    return back.select("id", "split", "limit_bal", "default_payment_next_month")


@query("report_json", """SELECT id, CAST(to_json(struct_pack(model_version := model_version, p1 := p1)) AS VARCHAR) AS report
FROM scores""", ("scores",))
def report_json(spark, sf):
    """S3: one JSON report per prediction, written as JSON lines and read back."""
    sc = views.scores(spark, sf).select("id", "model_version", "p1")
    path = _fresh(spark, "reports")
    sinks.json_reports(sc, "id").write.mode("overwrite").json(path)
    return spark.read.schema("id bigint, report string").json(path)


@query("audit_append", "SELECT event_id, created_at, client_transaction_id, agent_name, phase, event_type, "
       "CAST(created_at AS DATE) AS event_date FROM audit_event", AE)
def audit_append(spark, sf):
    """Events appended to a date-partitioned audit table, read back."""
    ev = views.audit_event(spark, sf).select("event_id", "created_at", "client_transaction_id", "agent_name", "phase",
                                            "event_type")
    return sinks.append_events(ev, _fresh(spark, "audit")).select(
        "event_id", "created_at", "client_transaction_id", "agent_name", "phase", "event_type", "event_date")


@query("artifact_append", """SELECT sha256(coalesce(CAST(evidence_id AS VARCHAR), '\\N')) AS artifact_id,
  'evidence_pointer' AS table_name, evidence_id, kind, CAST(NULL AS VARCHAR) AS dataset_id FROM evidence_pointer
UNION ALL SELECT sha256(coalesce(CAST(dataset_id AS VARCHAR), '\\N')), 'dataset_version', NULL, NULL, dataset_id
FROM (SELECT DISTINCT dataset_id FROM event_link WHERE dataset_id IS NOT NULL)""", ("evidence_pointer", "event_link"))
def artifact_append(spark, sf):
    """Evidence and dataset rows (different columns) appended as one artifact table."""
    ev = views.evidence_pointer(spark, sf).select("evidence_id", "kind")
    ds = views.event_link(spark, sf).where(F.col("dataset_id").isNotNull()).select("dataset_id").distinct()
    back = sinks.append_artifacts({"evidence_pointer": ev, "dataset_version": ds}, _fresh(spark, "artifacts"),
                                  {"evidence_pointer": ["evidence_id"], "dataset_version": ["dataset_id"]})
    return back.select("artifact_id", "table_name", "evidence_id", "kind", "dataset_id")


@query("scaler_io", """WITH s AS (SELECT avg(limit_bal) AS m, stddev_samp(limit_bal) AS sd FROM accounts)
SELECT id, round((limit_bal - m) / sd, 6) AS limit_bal FROM accounts CROSS JOIN s""", ("accounts",))
def scaler_io(spark, sf):
    """Scaling parameters saved, loaded and applied to the table."""
    from ..operators import features as FE
    acc = views.accounts(spark, sf).select("id", "limit_bal")
    path = _fresh(spark, "scaler")
    sinks.save_params(FE.zscore_fit(acc, ["limit_bal"]), path)
    scaled = FE.zscore_transform(acc, sinks.load_params(spark, path))
    return scaled.select("id", F.round("limit_bal", 6).alias("limit_bal"))


@query("artifact_key", """SELECT p.evidence_id, concat_ws('/', p.kind, coalesce(e.client_transaction_id, 'global'),
  split_part(p.dvc_path, '/', -1)) AS storage_key
FROM evidence_pointer p LEFT JOIN event_link l ON l.evidence_id = p.evidence_id
LEFT JOIN audit_event e ON e.event_id = l.event_id""", ALL3)
def artifact_key(spark, sf):
    """type/txn/filename for every evidence row ('global' when no event links it)."""
    t = _tables(spark, sf)
    ev = t["evidence_pointer"]
    links = t["event_link"].where(F.col("evidence_id").isNotNull()).select("evidence_id", "event_id")
    txn = t["audit_event"].select("event_id", "client_transaction_id")
    j = ev.join(links, "evidence_id", "left").join(txn, "event_id", "left")
    return j.select("evidence_id", sinks.artifact_key("kind", "client_transaction_id", "dvc_path").alias("storage_key"))


# ---------------------------------------------------------------- constraints and lookups

@query("constraint_unique", """SELECT 'audit_event' AS table_name, 'event_id' AS key_columns, count(*) AS duplicate_keys
  FROM (SELECT event_id FROM audit_event GROUP BY event_id HAVING count(*) > 1)
UNION ALL SELECT 'evidence_pointer', 'evidence_id', count(*) FROM (SELECT evidence_id FROM evidence_pointer GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'event_link', 'link_id', count(*) FROM (SELECT link_id FROM event_link GROUP BY 1 HAVING count(*) > 1)""", ALL3)
def constraint_unique(spark, sf):
    """Primary-key uniqueness per audit table."""
    return AU.unique_violations(_tables(spark, sf))


def _nn_sql():
    parts = []
    for t, cols in AU.NOT_NULL.items():
        for c in cols:
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS null_count FROM {t}")
    return "\nUNION ALL ".join(parts)


@query("constraint_not_null", _nn_sql(), ALL3)
def constraint_not_null(spark, sf):
    """NOT NULL columns."""
    return AU.not_null_violations(_tables(spark, sf))


@query("constraint_link_check", "SELECT link_id, event_id FROM event_link "
       "WHERE coalesce(policy_id, dataset_id, evidence_id) IS NULL", EL)
def constraint_link_check(spark, sf):
    """Links with no policy, dataset or evidence."""
    return AU.link_check_violations(views.event_link(spark, sf)).select("link_id", "event_id")


@query("fk_violations", """SELECT link_id, 'event_id' AS fk_column, event_id AS value FROM event_link l
  WHERE event_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM audit_event e WHERE e.event_id = l.event_id)
UNION ALL SELECT link_id, 'evidence_id', evidence_id FROM event_link l
  WHERE evidence_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM evidence_pointer p WHERE p.evidence_id = l.evidence_id)""", ALL3)
def fk_violations(spark, sf):
    """Referential integrity of the link keys (left anti joins)."""
    t = _tables(spark, sf)
    return AU.fk_violations(t["event_link"], {"event_id": (t["audit_event"], "event_id"),
                                              "evidence_id": (t["evidence_pointer"], "evidence_id")})


@query("audit_lookup", "SELECT event_id, created_at, client_transaction_id FROM audit_event "
       "WHERE agent_name = 'Critic_Agent' AND phase = 'Phase3_Governance'", AE)
def audit_lookup(spark, sf):
    """C4: access by (agent, phase) on the stored audit table.

    The table is date-partitioned and clustered by (agent, phase), so both
    predicates reach the Parquet scan (row-group min/max skipping).
    """
    ev = views.audit_event(spark, sf).select("event_id", "created_at", "client_transaction_id", "agent_name", "phase",
                                            "event_type")
    stored = sinks.append_events(ev, _fresh(spark, "audit"))
    return stored.where((F.col("agent_name") == "Critic_Agent") & (F.col("phase") == "Phase3_Governance")).select(
        "event_id", "created_at", "client_transaction_id")


@query("json_extract", "SELECT event_id, CAST(json_extract_string(extra_payload, '$.k') AS INTEGER) AS k, "
       "CAST(json_extract_string(extra_payload, '$.k') AS INTEGER) / CAST(100 AS DOUBLE) AS confidence FROM audit_event", AE)
def json_extract(spark, sf):
    """payload fields as typed columns."""
    k = AU.payload_field().cast("int")
    return views.audit_event(spark, sf).select("event_id", k.alias("k"), (k / F.lit(100.0)).alias("confidence"))


@query("latest_model", """SELECT evidence_id, created_at FROM evidence_pointer WHERE kind = 'TRAINED_MODEL'
ORDER BY created_at DESC, evidence_id DESC LIMIT 1""", EP)
def latest_model(spark, sf):
    """Newest TRAINED_MODEL evidence."""
    return AU.latest_by_time(views.evidence_pointer(spark, sf)).select("evidence_id", "created_at")


@query("scored_with_latest_model", """SELECT e.event_id, e.created_at,
  (SELECT p.evidence_id FROM evidence_pointer p WHERE p.kind = 'TRAINED_MODEL' AND p.created_at <= e.created_at
   ORDER BY p.created_at DESC, p.evidence_id DESC LIMIT 1) AS model_evidence_id
FROM audit_event e WHERE e.event_type = 'PREDICTION_EXECUTED'""", ("audit_event", "evidence_pointer"))
def scored_with_latest_model(spark, sf):
    """Every prediction event with the newest model at its time (batch as-of)."""
    preds = views.audit_event(spark, sf).where(F.col("event_type") == "PREDICTION_EXECUTED").select("event_id", "created_at")
    models = views.evidence_pointer(spark, sf).where(F.col("kind") == "TRAINED_MODEL")
    return AU.as_of_latest(preds, "created_at", models, "created_at", "evidence_id", "model_evidence_id")


@query("event_timeline", """SELECT client_transaction_id, event_id, event_type, created_at, position FROM (
  SELECT *, row_number() OVER (PARTITION BY client_transaction_id ORDER BY created_at, event_id) AS position
  FROM audit_event) WHERE position <= 10""", AE)
def event_timeline(spark, sf):
    """First ten events per transaction."""
    return AU.event_timeline(views.audit_event(spark, sf)).select(
        "client_transaction_id", "event_id", "event_type", "created_at", F.col("position").cast("bigint").alias("position"))


@query("agent_activity", "SELECT client_transaction_id, agent_name, count(*) AS event_count FROM audit_event "
       "GROUP BY client_transaction_id, agent_name", AE)
def agent_activity(spark, sf):
    """Agents and event counts per transaction."""
    return AU.agent_activity(views.audit_event(spark, sf))


@query("ops_metrics", """SELECT count(*) AS n_events, count(*) FILTER (WHERE event_type = 'ERROR') AS n_errors,
  count(*) FILTER (WHERE event_type = 'POLICY_EVALUATION_COMPLETED') AS policy_checks,
  avg(CASE WHEN event_type = 'POLICY_EVALUATION_COMPLETED' THEN
    CASE WHEN CAST(json_extract_string(extra_payload, '$.k') AS DOUBLE) / 100 >= CAST(0.7 AS DOUBLE) THEN 1.0 ELSE 0.0 END END)
    AS policy_pass_rate,
  quantile_cont(latency_ms, 0.95) AS latency_p95_ms,
  (epoch_us(max(created_at)) - epoch_us(min(created_at))) / CAST(1000000 AS DOUBLE) AS span_seconds
FROM audit_event""", AE)
def ops_metrics(spark, sf):
    """Operational metrics from the audit table (exact p95)."""
    return AU.ops_metrics(views.audit_event(spark, sf))


@query("run_status", """SELECT agent_name, count(*) AS events,
  count(*) FILTER (WHERE event_type = 'ERROR' OR event_type LIKE '%\\_FAILED' ESCAPE '\\') AS failures,
  count(*) FILTER (WHERE NOT (event_type = 'ERROR' OR event_type LIKE '%\\_FAILED' ESCAPE '\\')) AS successes
FROM audit_event GROUP BY agent_name""", AE)
def run_status(spark, sf):
    """C20: outcome events per agent."""
    return AU.run_status(views.audit_event(spark, sf))


@query("trace_rollup", """SELECT trace_id, min(created_at) AS first_at, max(created_at) AS last_at, count(*) AS event_count,
  array_to_string(list_sort(list_distinct(list(phase))), ',') AS phases,
  (epoch_us(max(created_at)) - epoch_us(min(created_at))) / CAST(1000000 AS DOUBLE) AS duration_seconds
FROM audit_event GROUP BY trace_id""", AE)
def trace_rollup(spark, sf):
    """Everything sharing a trace id."""
    return AU.trace_rollup(views.audit_event(spark, sf))


# ---------------------------------------------------------------- lineage graph

def _typed_sql():
    parts = []
    for etype, keys, label, ntype, edge in LI.EVENT_TYPE_MAP:
        if label == "Error":
            aid = "'err-' || event_id"
        else:
            ks = [k for k in keys.split(",") if k] + ["k"]
            aid = "coalesce(" + ", ".join(f"nullif(json_extract_string(extra_payload, '$.{k}'), '')" for k in ks) + ")"
        parts.append(f"SELECT event_id, created_at, {aid} AS artifact_id, '{label}' AS artifact_label, "
                     f"'{ntype}' AS artifact_type, '{edge}' AS edge_type FROM audit_event WHERE event_type = '{etype}'")
    return "typed AS MATERIALIZED (SELECT * FROM (" + "\n  UNION ALL ".join(parts) + ") WHERE artifact_id IS NOT NULL)"


_KIND_CASE = ("CASE kind " + " ".join(f"WHEN '{k}' THEN '{lab}'" for k, lab, _ in LI.EVIDENCE_KINDS) + " ELSE 'Evidence' END")
_KIND_TYPE = ("CASE kind " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, _, t in LI.EVIDENCE_KINDS) + " ELSE 'Evidence' END")

GRAPH_SQL = f"""{_typed_sql()},
enodes AS MATERIALIZED (
  SELECT DISTINCT agent_name AS node_id, 'Agent' AS label, CAST(NULL AS VARCHAR) AS node_type, CAST(NULL AS TIMESTAMP) AS created_at FROM audit_event
  UNION ALL SELECT DISTINCT client_transaction_id, 'Transaction', CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP) FROM audit_event WHERE client_transaction_id IS NOT NULL
  UNION ALL SELECT event_id, 'Event', event_type, created_at FROM audit_event
  UNION ALL SELECT DISTINCT artifact_id, artifact_label, artifact_type, CAST(NULL AS TIMESTAMP) FROM typed),
eedges AS MATERIALIZED (
  SELECT 'Agent' AS src_label, agent_name AS src, 'Event' AS dst_label, event_id AS dst, 'PERFORMED' AS edge_type, event_id FROM audit_event
  UNION ALL SELECT 'Event', event_id, 'Transaction', client_transaction_id, 'PART_OF', event_id FROM audit_event WHERE client_transaction_id IS NOT NULL
  UNION ALL SELECT 'Event', event_id, artifact_label, artifact_id, edge_type, event_id FROM typed),
anodes AS MATERIALIZED (
  SELECT evidence_id AS node_id, {_KIND_CASE} AS label, {_KIND_TYPE} AS node_type, created_at FROM evidence_pointer
  UNION ALL SELECT DISTINCT dataset_id, 'Dataset', 'DatasetVersion', CAST(NULL AS TIMESTAMP) FROM event_link WHERE dataset_id IS NOT NULL),
ledges AS MATERIALIZED (
  SELECT 'Event' AS src_label, l.event_id AS src, a.label AS dst_label, l.dst, l.edge_type, l.event_id FROM (
    SELECT event_id, 'USES_POLICY' AS edge_type, policy_id AS dst, 'P' AS kind FROM event_link
    UNION ALL SELECT event_id, 'USES_DATA', dataset_id, 'D' FROM event_link
    UNION ALL SELECT event_id, 'HAS_EVIDENCE', evidence_id, 'E' FROM event_link) l
  JOIN anodes a ON a.node_id = l.dst
  WHERE l.dst IS NOT NULL AND ((l.kind = 'P' AND a.label = 'Policy') OR (l.kind = 'D' AND a.label = 'Dataset')
    OR (l.kind = 'E' AND a.label IN ({", ".join(f"'{x}'" for x in LI.EVIDENCE_LABELS)})))
    AND l.event_id IN (SELECT event_id FROM audit_event))"""


def _graph(spark, sf):
    t = _tables(spark, sf)
    ev = t["audit_event"]
    anodes = LI.artifact_nodes(t["evidence_pointer"], t["event_link"])
    return t, LI.event_nodes(ev), LI.event_edges(ev), anodes, LI.link_edges(t["event_link"], ev, anodes)


@query("graph_nodes", f"WITH {GRAPH_SQL}\nSELECT * FROM enodes", ALL3)
def graph_nodes(spark, sf):
    """Agent, Transaction, Event and typed artifact nodes."""
    return LI.event_nodes(views.audit_event(spark, sf)).select(*LI.NODE_COLS)


@query("graph_edges", f"WITH {GRAPH_SQL}\nSELECT * FROM eedges", ALL3)
def graph_edges(spark, sf):
    """PERFORMED, PART_OF and typed edges."""
    return LI.event_edges(views.audit_event(spark, sf)).select(*LI.EDGE_COLS)


@query("artifact_nodes", f"WITH {GRAPH_SQL}\nSELECT * FROM anodes", ALL3)
def artifact_nodes(spark, sf):
    """Evidence nodes labelled by kind, dataset nodes."""
    t = _tables(spark, sf)
    return LI.artifact_nodes(t["evidence_pointer"], t["event_link"]).select(*LI.NODE_COLS)


@query("link_edges", f"WITH {GRAPH_SQL}\nSELECT * FROM ledges", ALL3)
def link_edges(spark, sf):
    """Link rows as USES_POLICY / USES_DATA / HAS_EVIDENCE edges between existing nodes."""
    return _graph(spark, sf)[4].select(*LI.EDGE_COLS)


@query("graph_stats", f"""WITH {GRAPH_SQL},
nodes AS (SELECT * FROM enodes UNION ALL SELECT * FROM anodes),
edges AS (SELECT * FROM eedges UNION ALL SELECT * FROM ledges)
SELECT 'node' AS kind, label, count(*) AS n FROM nodes GROUP BY label
UNION ALL SELECT 'node', 'ALL', count(*) FROM nodes
UNION ALL SELECT 'edge', 'ALL', count(*) FROM edges""", ALL3)
def graph_stats(spark, sf):
    """Nodes per label, total nodes and total edges."""
    _, en, ee, an, le = _graph(spark, sf)
    return LI.graph_stats(en.unionByName(an), ee.unionByName(le))


def _one_scan(of) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{t[0]}' THEN {of(t)}" for t in LI.EVENT_TYPE_MAP) + " END"


def _artifact_sql(row) -> str:
    if row[2] == "Error":
        return "'err-' || event_id"
    return "coalesce(" + ", ".join(f"nullif(json_extract_string(extra_payload, '$.{k}'), '')" for k in [*filter(None, row[1].split(",")), "k"]) + ")"


# PART_OF is the event's own transaction; the other edges of an event are its typed artifact and its links.
@query("lineage_pattern", f"""WITH ev AS MATERIALIZED (
  SELECT event_id, client_transaction_id, event_type, created_at, {_one_scan(_artifact_sql)} AS artifact_id,
    {_one_scan(lambda t: f"'{t[2]}'")} AS label, {_one_scan(lambda t: f"'{t[4]}'")} AS edge_type
  FROM audit_event WHERE client_transaction_id IS NOT NULL),
links AS (
  SELECT l.event_id, 'HAS_EVIDENCE' AS edge_type, {_KIND_CASE} AS label, l.evidence_id AS dst FROM event_link l JOIN evidence_pointer p ON p.evidence_id = l.evidence_id
  UNION ALL SELECT event_id, 'USES_DATA', 'Dataset', dataset_id FROM event_link WHERE dataset_id IS NOT NULL)
SELECT event_id, client_transaction_id, edge_type, label AS target_label, artifact_id AS target_id, event_type, created_at FROM ev WHERE artifact_id IS NOT NULL
UNION ALL
SELECT ev.event_id, ev.client_transaction_id, links.edge_type, links.label, links.dst, ev.event_type, ev.created_at FROM links JOIN ev ON ev.event_id = links.event_id""", ALL3)
def lineage_pattern(spark, sf):
    """(Transaction)<-[:PART_OF]-(Event)-[:T]->(X) over all edges."""
    t, _, ee, _, le = _graph(spark, sf)
    return LI.lineage_pattern(ee.unionByName(le), t["audit_event"]).select(
        "event_id", "client_transaction_id", "edge_type", "target_label", "target_id", "event_type", "created_at")


@query("event_artifacts", """SELECT l.link_id, l.event_id, e.event_type, e.client_transaction_id, l.policy_id, l.dataset_id,
  l.evidence_id, p.kind AS evidence_kind
FROM event_link l LEFT JOIN audit_event e ON e.event_id = l.event_id
LEFT JOIN evidence_pointer p ON p.evidence_id = l.evidence_id""", ALL3)
def event_artifacts(spark, sf):
    """Every link with its event and the policy / dataset / evidence it points at."""
    t = _tables(spark, sf)
    ev = t["audit_event"].select("event_id", "event_type", "client_transaction_id")
    kinds = t["evidence_pointer"].select("evidence_id", F.col("kind").alias("evidence_kind"))
    return (t["event_link"].join(ev, "event_id", "left").join(kinds, "evidence_id", "left")
            .select("link_id", "event_id", "event_type", "client_transaction_id", "policy_id", "dataset_id",
                    "evidence_id", "evidence_kind"))
