"""Lineage graph as two DataFrames: nodes(node_id, label, node_type, created_at)
and edges(src_label, src, dst_label, dst, edge_type, event_id).

Graph writes become projections and unions; graph reads become equi-joins
on the edge table. Small rule tables (event-type map, evidence kinds) are
broadcast: their size is fixed by the schema, not the data.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Event type -> payload keys (in order of preference), node label, node type, edge (fixed values).
# When none of the keys is in the payload, the payload's generic key ``k`` names the artifact.
EVENT_TYPE_MAP = [
    ("DATA_HASH_SAVED", "train_hash,train_val_hash", "Dataset", "ProcessedData", "CREATED"),
    ("POLICY_METADATA_SAVED", "policy_id", "Policy", "DataPreprocessPolicy", "DEFINED"),
    ("calculating_confidence_learning", "evidence_id", "Evidence", "ConfidenceReport", "GENERATED"),
    ("MODEL_TRAINING_COMPLETED", "model_evidence_id", "Model", "TrainedModel", "TRAINED"),
    ("XAI_EXPLANATIONS_GENERATED", "xai_evidence_id", "XAI", "Explanation", "EXPLAINED"),
    ("PREDICTION_EXECUTED", "prediction_evidence_id", "Prediction", "PredictionResult", "PREDICTED"),
    ("POLICY_EVALUATION_COMPLETED", "governance_evidence_id", "Governance", "PolicyDecision", "EVALUATED"),
    ("ERROR", "", "Error", "Error", "CAUSED"),
]
# Evidence kind -> node label and type (fixed values).
EVIDENCE_KINDS = [
    ("TRAINED_MODEL", "Model", "TrainedModel"),
    ("XAI_EXPLANATION_REPORT", "XAI", "XAIExplanation"),
    ("PREDICTION_XAI_EXPLANATION", "XAI", "XAIExplanation"),
    ("XAI_VISUALIZATION", "Visualization", "XAIVisualization"),
    ("PREDICTION_RESULT", "Prediction", "PredictionResult"),
    ("GOVERNANCE_DECISION", "Governance", "GovernanceDecision"),
]
EVIDENCE_LABELS = ["Model", "XAI", "Visualization", "Prediction", "Governance", "Evidence"]
ERROR_SUMMARY_CHARS = 100
NODE_COLS = ["node_id", "label", "node_type", "created_at"]
EDGE_COLS = ["src_label", "src", "dst_label", "dst", "edge_type", "event_id"]


def _node(df, node_id, label, node_type=None, created_at=None) -> DataFrame:
    return df.select(F.col(node_id).cast("string").alias("node_id") if isinstance(node_id, str) else node_id.alias("node_id"),
                     F.lit(label).alias("label"),
                     (F.lit(node_type) if node_type is None or isinstance(node_type, str) else node_type)
                     .cast("string").alias("node_type"),
                     (F.col(created_at) if created_at else F.lit(None)).cast("timestamp_ntz").alias("created_at"))


def artifact_key(payload_keys: str):
    """F8: first present payload key, else the generic key ``k``."""
    keys = [k for k in payload_keys.split(",") if k] + ["k"]
    return F.coalesce(*[F.nullif(F.get_json_object(F.col("extra_payload"), f"$.{k}"), F.lit("")) for k in keys])


def _typed(events: DataFrame) -> DataFrame:
    """Events with their artifact (label, id, type, edge) from the type map, in one pass."""
    et = F.col("event_type")
    label = ntype = edge = aid = None
    for etype, keys, lab, typ, edg in EVENT_TYPE_MAP:
        cond = et == etype
        a = F.concat(F.lit("err-"), F.col("event_id")) if lab == "Error" else artifact_key(keys)
        if label is None:
            label, ntype, edge, aid = (F.when(cond, F.lit(lab)), F.when(cond, F.lit(typ)),
                                       F.when(cond, F.lit(edg)), F.when(cond, a))
        else:
            label, ntype, edge, aid = (label.when(cond, F.lit(lab)), ntype.when(cond, F.lit(typ)),
                                       edge.when(cond, F.lit(edg)), aid.when(cond, a))
    typed = events.where(et.isin(*[t[0] for t in EVENT_TYPE_MAP])).select(
        "event_id", "created_at", aid.alias("artifact_id"), label.alias("artifact_label"),
        ntype.alias("artifact_type"), edge.alias("edge_type"))
    return typed.where(F.col("artifact_id").isNotNull())


def event_nodes(events: DataFrame) -> DataFrame:
    """Agent, Transaction, Event and typed artifact nodes; merged nodes de-duplicated."""
    agents = _node(events, "agent_name", "Agent").distinct()
    txns = _node(events.where(F.col("client_transaction_id").isNotNull()), "client_transaction_id", "Transaction").distinct()
    evs = _node(events, "event_id", "Event", F.col("event_type"), "created_at")
    typed = _typed(events)
    arts = typed.select(F.col("artifact_id").alias("node_id"), F.col("artifact_label").alias("label"),
                        F.col("artifact_type").alias("node_type"),
                        F.lit(None).cast("timestamp_ntz").alias("created_at")).distinct()
    return agents.unionByName(txns).unionByName(evs).unionByName(arts)


def event_edges(events: DataFrame) -> DataFrame:
    """PERFORMED, PART_OF and the typed edge of each event."""
    performed = events.select(F.lit("Agent").alias("src_label"), F.col("agent_name").alias("src"),
                              F.lit("Event").alias("dst_label"), F.col("event_id").alias("dst"),
                              F.lit("PERFORMED").alias("edge_type"), "event_id")
    part_of = events.where(F.col("client_transaction_id").isNotNull()).select(
        F.lit("Event").alias("src_label"), F.col("event_id").alias("src"), F.lit("Transaction").alias("dst_label"),
        F.col("client_transaction_id").alias("dst"), F.lit("PART_OF").alias("edge_type"), "event_id")
    typed = _typed(events).select(F.lit("Event").alias("src_label"), F.col("event_id").alias("src"),
                                  F.col("artifact_label").alias("dst_label"), F.col("artifact_id").alias("dst"),
                                  "edge_type", "event_id")
    return performed.unionByName(part_of).unionByName(typed)


def artifact_nodes(evidence: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """One node per evidence row (label by kind) and per referenced dataset."""
    label = F.lit("Evidence")
    ntype = F.lit("Evidence")
    for kind, lab, typ in reversed(EVIDENCE_KINDS):
        label = F.when(F.col("kind") == kind, F.lit(lab)).otherwise(label)
        ntype = F.when(F.col("kind") == kind, F.lit(typ)).otherwise(ntype)
    ev = evidence.select(F.col("evidence_id").alias("node_id"), label.alias("label"), ntype.alias("node_type"),
                         F.col("created_at").cast("timestamp_ntz").alias("created_at"))
    if links is None:
        return ev
    ds = links.where(F.col("dataset_id").isNotNull()).select(
        F.col("dataset_id").alias("node_id"), F.lit("Dataset").alias("label"), F.lit("DatasetVersion").alias("node_type"),
        F.lit(None).cast("timestamp_ntz").alias("created_at")).distinct()
    return ev.unionByName(ds)


def link_edges(links: DataFrame, events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """USES_POLICY / USES_DATA / HAS_EVIDENCE for links whose two ends exist as nodes."""
    long = links.select("event_id", F.explode(F.array(
        F.struct(F.lit("USES_POLICY").alias("edge_type"), F.col("policy_id").alias("dst"), F.array(F.lit("Policy")).alias("labels")),
        F.struct(F.lit("USES_DATA").alias("edge_type"), F.col("dataset_id").alias("dst"), F.array(F.lit("Dataset")).alias("labels")),
        F.struct(F.lit("HAS_EVIDENCE").alias("edge_type"), F.col("evidence_id").alias("dst"),
                 F.array(*[F.lit(x) for x in EVIDENCE_LABELS]).alias("labels")),
    )).alias("l")).select("event_id", "l.edge_type", "l.dst", "l.labels").where(F.col("dst").isNotNull())
    ends = artifacts.select(F.col("node_id").alias("dst"), F.col("label").alias("dst_label"))
    matched = long.join(ends, "dst").where(F.array_contains("labels", F.col("dst_label")))
    matched = matched.join(events.select("event_id"), "event_id", "left_semi")
    return matched.select(F.lit("Event").alias("src_label"), F.col("event_id").alias("src"), "dst_label", "dst",
                          "edge_type", "event_id")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes per label, total nodes (rollup) and total edges."""
    per_label = nodes.rollup("label").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("node").alias("kind"), F.coalesce("label", F.lit("ALL")).alias("label"), "n")
    total_edges = edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), F.lit("ALL").alias("label"), "n")
    return per_label.unionByName(total_edges)


def lineage_pattern(edges: DataFrame, events: DataFrame) -> DataFrame:
    """(Transaction)<-[:PART_OF]-(Event)-[:T]->(X) as two equi-joins on the edge table."""
    part_of = edges.where(F.col("edge_type") == "PART_OF").select(F.col("src").alias("event_id"),
                                                                   F.col("dst").alias("client_transaction_id"))
    out = edges.where(F.col("src_label") == "Event").where(F.col("edge_type") != "PART_OF").select(
        F.col("src").alias("event_id"), "edge_type", F.col("dst_label").alias("target_label"), F.col("dst").alias("target_id"))
    ev = events.select("event_id", F.col("event_type"), "created_at")
    return part_of.join(out, "event_id").join(ev, "event_id")
