"""End-to-end jobs: data assurance, training, and scoring + governance.

Each job writes its tables (parquet under ``out``), then records what it did
in the append-only audit tables: events (S4), artifacts (S5) and the links
between them. Ids are SHA-256 of natural keys, so a re-run of the same inputs
gives the same ids. A failure appends an ERROR event (C20) with the first 100
characters of the message (F9) and re-raises.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import attribution as AT
from ..operators import features as FE
from ..operators import labels as L
from ..operators import lineage as LI
from ..operators import model as MO
from ..operators import policy as PO
from ..operators import quality as Q
from ..operators import questions as QU
from ..operators import training as TR
from ..operators.fingerprint import fingerprint
from ..operators.preparation import AccountPreparation
from ..operators.sampling import hash_split, smote, stratified_folds
from ..operators.treeshap import tree_attribution, tree_table
from ..session import scratch_path
from ..sources import sinks, views
from .fingerprint import DATA_VERSION, RULES_JSON, split_strategy
from .labels import segments
from .registry import query

EVENT_SCHEMA = ("event_id string, created_at timestamp_ntz, trace_id string, client_transaction_id string, "
                "agent_name string, phase string, event_type string, summary string, extra_payload string")
SUMMARY_CHARS = 100


def _id(*parts) -> str:
    import hashlib
    return hashlib.sha256("\u0001".join(str(p) for p in parts).encode()).hexdigest()[:32]


class AuditTrail:
    """Collects one job's events, artifacts and links, and appends them in one write each."""

    def __init__(self, spark: SparkSession, root: str, txn: str, trace: str, agent: str, run_ts: str):
        self.spark, self.root, self.txn, self.trace, self.agent, self.run_ts = spark, root, txn, trace, agent, run_ts
        self.events, self.artifacts, self.links = [], {}, []

    def event(self, phase: str, event_type: str, summary: str, payload: dict) -> str:
        eid = _id(self.txn, self.agent, event_type, self.run_ts, len(self.events))
        self.events.append((eid, self.run_ts, self.trace, self.txn, self.agent, phase, event_type,
                            summary[:SUMMARY_CHARS], json.dumps(payload, sort_keys=True)))
        return eid

    def artifact(self, table: str, row: dict, key: str) -> str:
        aid = _id(table, *[row[k] for k in sorted(row)])
        self.artifacts.setdefault(table, []).append({key: aid, **row})
        return aid

    def link(self, event_id: str, policy_id=None, dataset_id=None, evidence_id=None) -> None:
        self.links.append((_id("link", event_id, policy_id, dataset_id, evidence_id), event_id, policy_id, dataset_id,
                           evidence_id))

    def _new(self, table: str, key: str, rows: list, at) -> list:
        """The rows whose id the table doesn't hold: a run that is repeated adds nothing twice. A run has a handful of rows."""
        ids = [at(r) for r in rows]
        try:
            held = {r[0] for r in self.spark.read.schema(f"{key} string").parquet(os.path.join(self.root, table)).where(F.col(key).isin(ids)).collect()}
        except AnalysisException:  # nothing was written yet
            held = set()
        return [r for r, i in zip(rows, ids) if i not in held]

    def holds(self, event_type: str) -> bool:
        """Whether this transaction has such an event already."""
        try:
            ev = self.spark.read.schema("client_transaction_id string, event_type string").parquet(os.path.join(self.root, "audit_event"))
            return bool(ev.where((F.col("client_transaction_id") == self.txn) & (F.col("event_type") == event_type)).limit(1).count())
        except AnalysisException:
            return False

    def flush(self) -> None:
        """Artifacts and links first, events last: an event in the table means that all it points at is there."""
        frames, keys = {}, {}
        for table, rows in self.artifacts.items():
            key = next(iter(rows[0]))
            if new := self._new("artifacts", key, rows, lambda r, key=key: r[key]):
                frames[table], keys[table] = self.spark.createDataFrame(new), [key]
        if frames:
            sinks.append_artifacts(frames, os.path.join(self.root, "artifacts"), keys)
        if new := self._new("event_link", "link_id", self.links, lambda r: r[0]):
            self.spark.createDataFrame(new, "link_id string, event_id string, policy_id string, dataset_id string, "
                                            "evidence_id string").write.mode("append").parquet(os.path.join(self.root, "event_link"))
        if new := self._new("audit_event", "event_id", self.events, lambda r: r[0]):
            ev = self.spark.createDataFrame(new, EVENT_SCHEMA.replace("created_at timestamp_ntz", "created_at string"))
            sinks.append_events(ev.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")), os.path.join(self.root, "audit_event"))

    def fail(self, phase: str, error: Exception, event_type: str = "ERROR") -> None:
        self.event(phase, event_type, f"{type(error).__name__}: {error}", {"error": type(error).__name__})
        self.flush()


def assurance_job(spark: SparkSession, sf: str, out: str, txn: str = "TXN-ASSURANCE", trace: str = "trace-assurance",
                  run_ts: str = "2024-02-01 00:00:00") -> str:
    """SURVEY 3.1 as one Spark job; returns the audit root."""
    trail = AuditTrail(spark, os.path.join(out, "audit"), txn, trace, "DataAssuranceAgent", run_ts)
    try:
        acc = Q.dedupe_keep_first(views.accounts(spark, sf, position=True), ["id"], ["position"]).drop("position")  # D1, first of the input
        clean = FE.clean_accounts(acc)                                                   # P1 P8 P9 M2-M4
        sinks.write_table(clean, os.path.join(out, "interim"))                           # S2
        clean = spark.read.parquet(os.path.join(out, "interim"))
        feats = hash_split(FE.engineer(clean), "id", cuts=((MO.VAL_PER_MILLE, "val"),))  # F1 F2 X1
        params = FE.zscore_fit(feats.where("split = 'train'"))                           # A3 (train only)
        sinks.save_params(params, os.path.join(out, "scaler"))                           # S7
        scaled = FE.zscore_transform(feats, sinks.load_params(spark, os.path.join(out, "scaler")))  # A4
        scaled = scaled.fillna(0.0, subset=MO.FEATURES)
        train = scaled.where("split = 'train'").drop("split")
        if FE.imbalance(train).first().is_imbalanced:                                    # A1 A2
            train = smote(train.select("id", *MO.FEATURES, FE.TARGET), FE.TARGET, MO.FEATURES).drop("synthetic")  # X5
        prepared = train.select("id", *MO.FEATURES, FE.TARGET).withColumn("split", F.lit("train")).unionByName(
            scaled.where("split = 'val'").select("id", *MO.FEATURES, FE.TARGET, "split"))
        prepared = sinks.write_splits(prepared, os.path.join(out, "prepared")).persist(StorageLevel.MEMORY_AND_DISK)
        fp = fingerprint(prepared).first()                                               # F5
        hash_event = trail.event("Phase1_DataAssurance", "DATA_HASH_SAVED", "Prepared data fingerprinted",
                                 {"train_hash": fp.fingerprint})
        for r in prepared.groupBy("split").count().collect():                            # A6
            part = fingerprint(prepared.where(F.col("split") == r["split"])).first()
            ds = trail.artifact("dataset_version", {"dataset_version": DATA_VERSION, "split_group": r["split"],
                                                    "sha256": part.fingerprint, "row_count": r["count"],
                                                    "col_count": len(prepared.columns) - 1}, "dataset_id")
            trail.link(hash_event, dataset_id=ds)
        policy = trail.artifact("policy_document", {"policy_name": f"DATA-ASSURANCE-{DATA_VERSION}",
                                                    "policy_version": DATA_VERSION,
                                                    "content_sha256": _id(RULES_JSON, fp.fingerprint),
                                                    "split_strategy": split_strategy()}, "policy_id")  # G9
        pol_event = trail.event("Phase1_DataAssurance", "POLICY_METADATA_SAVED", "Preprocessing rules recorded",
                                {"policy_id": policy})
        trail.link(pol_event, policy_id=policy)
        tr = prepared.where("split = 'train'")
        folds = stratified_folds(tr.select("id", FE.TARGET), FE.TARGET)                 # X3
        report = L.label_report(L.with_probs(MO.oof_probabilities(tr, folds)))          # L1 L2 L4
        sinks.write_table(report, os.path.join(out, "label_report"))
        alert = L.quality_alert(spark.read.parquet(os.path.join(out, "label_report"))).first()  # L5 A7
        ev_id = trail.artifact("evidence_pointer", {"kind": "CONFIDENT_LEARNING_REPORT",
                                                    "dvc_path": os.path.join(out, "label_report"),
                                                    "issue_count": alert.issue_count}, "evidence_id")
        cl_event = trail.event("Phase1_DataAssurance", "calculating_confidence_learning", alert.message,
                               {"evidence_id": ev_id, "issue_count": alert.issue_count})
        trail.link(cl_event, evidence_id=ev_id)
        trail.event("Phase1_DataAssurance", "DATA_ASSURANCE_COMPLETED", "Data assurance finished", {"rows": fp.row_count})
        trail.flush()
        return trail.root
    except Exception as e:  # record the failure, then surface it
        trail.fail("Phase1_DataAssurance", e)
        raise


def training_job(spark: SparkSession, sf: str, out: str, run_id: str, model_version: str = "gb_model_v1", trace: str = "trace-training",
                 run_ts: str = "2024-02-01 00:00:00", **gbt) -> str:
    """SURVEY 3.2 as one Spark job: curriculum fits, the best model saved with its preparation, and the run's evidence; returns
    the audit root. A run id that has completed is not run again, and one that was broken off adds nothing twice."""
    trail = AuditTrail(spark, os.path.join(out, "audit"), f"TXN-TRAINING-{run_id}", trace, "Training_Agent", run_ts)
    phase = "Phase2_ModelTraining"
    if trail.holds("MODEL_TRAINING_COMPLETED"):
        return trail.root
    try:
        trail.event(phase, "MODEL_TRAINING_STARTED", "Model training started", {"training_run_id": run_id})
        accounts = views.accounts(spark, sf)
        preparation = AccountPreparation().fit(accounts)
        frame = MO.model_frame(accounts, preparation=preparation).persist(StorageLevel.MEMORY_AND_DISK)
        train = segments(spark, sf).select("id", "quality_score", "segment").join(frame.where("split = 'train'"), "id")   # L10
        epochs, models, best = TR.curriculum_train(spark, train, frame.where("split = 'val'"), MO.FEATURES, MO.TARGET, **gbt)  # L6 L8 L9
        epochs_path, model_path, xai_path = (os.path.join(out, name) for name in ("epochs", "model", "explanations"))
        sinks.write_table(epochs, epochs_path)                                            # S2
        chosen = TR.best_epoch(spark.read.parquet(epochs_path)).first()                   # A11
        model = PipelineModel([preparation, *models[best].stages])
        model.write().overwrite().save(model_path)                                        # S6 S7
        data = fingerprint(frame)                                                         # F5
        dataset = trail.artifact("dataset_version", {"dataset_version": DATA_VERSION, "split_group": "training", "sha256": data.first().fingerprint,
                                                     "row_count": frame.count(), "col_count": len(frame.columns) - 1}, "dataset_id")
        phi, _ = tree_attribution(frame.where("split = 'val'"), models[best], MO.FEATURES)  # L11
        sinks.write_table(AT.global_importance(phi), xai_path)                            # A9
        frame.unpersist()
        digest = MO.model_sha256(model, tree_table(spark, models[best].stages[-1]))
        evidence = trail.artifact("evidence_pointer", {
            "kind": "TRAINED_MODEL", "dvc_path": model_path, "sha256": digest, "model_name": "gb_model", "model_version": model_version,
            "training_run_id": run_id, "epochs_path": epochs_path, "recorded_at": run_ts}, "evidence_id")
        done = trail.event(phase, "MODEL_TRAINING_COMPLETED", f"Model training completed - Best ROC AUC: {chosen.val_roc_auc:.4f}" if chosen.val_roc_auc is not None else "Model training completed",
                           {"model_evidence_id": evidence, "training_run_id": run_id, "model_version": model_version, "best_epoch": chosen.epoch,
                            "best_roc_auc": chosen.val_roc_auc, "model_type": "GradientBoosting"})
        trail.link(done, dataset_id=dataset, evidence_id=evidence)
        xai = trail.artifact("evidence_pointer", {"kind": "XAI_EXPLANATION_REPORT", "dvc_path": xai_path, "training_run_id": run_id, "recorded_at": run_ts}, "evidence_id")
        explained = trail.event(phase, "XAI_EXPLANATIONS_GENERATED", "Model explanations computed", {"xai_evidence_id": xai, "model_evidence_id": evidence})
        trail.link(explained, evidence_id=xai)
        trail.link(explained, evidence_id=evidence)
        trail.flush()
        return trail.root
    except Exception as e:
        trail.fail(phase, e, "MODEL_TRAINING_FAILED")
        raise


def _evidence(spark: SparkSession, root: str):
    """Evidence rows; runs add columns of their own, so schemas are merged."""
    return spark.read.option("mergeSchema", "true").parquet(os.path.join(root, "artifacts")).where("table_name = 'evidence_pointer'")


def trained_model(spark: SparkSession, root: str) -> tuple[dict, PipelineModel]:
    """The latest TRAINED_MODEL evidence under an audit root, and the pipeline that it points at."""
    arts = _evidence(spark, root).where("kind = 'TRAINED_MODEL'")
    row = arts.orderBy(F.col("recorded_at").desc(), F.col("evidence_id").desc()).first()
    if row is None:
        raise ValueError(f"no trained model is recorded under {root}")
    return row.asDict(), PipelineModel.load(row.dvc_path)


def scoring_job(spark: SparkSession, sf: str, out: str, trained: str, txn: str = "TXN-SCORING", trace: str = "trace-scoring",
                run_ts: str = "2024-02-01 00:00:00") -> str:
    """SURVEY 3.3 as one batch job over every account: score, attribute, evaluate, escalate. Model, saved fills and scale, and
    the model's version come from the evidence under ``trained``, a training run's audit root; nothing is fitted here."""
    trail = AuditTrail(spark, os.path.join(out, "audit"), txn, trace, "Prediction_Agent", run_ts)
    try:
        evidence, full = trained_model(spark, trained)                                     # S6 S7
        frame = MO.model_frame(views.accounts(spark, sf), preparation=full.stages[0])      # L14
        model = PipelineModel(full.stages[1:])
        scored = MO.predict(model, frame).select("id", "p1")                               # L7
        preds = PO.prediction_record(scored).withColumn(                                  # L15
            "client_transaction_id", F.concat(F.lit("TXN-"), F.col("id").cast("string")))
        sinks.write_table(preds, os.path.join(out, "predictions"))
        pred_ev = trail.artifact("evidence_pointer", {"kind": "PREDICTION_RESULT", "dvc_path": os.path.join(out, "predictions")},
                                 "evidence_id")
        e1 = trail.event("Phase3_PredictionPipeline", "PREDICTION_EXECUTED", "Accounts scored",
                         {"prediction_evidence_id": pred_ev, "model_evidence_id": evidence["evidence_id"], "model_version": evidence["model_version"]})
        trail.link(e1, evidence_id=pred_ev)
        phi, expected = tree_attribution(frame, model, MO.FEATURES)                        # L11
        sinks.write_table(phi, os.path.join(out, "attributions"))
        phi = spark.read.parquet(os.path.join(out, "attributions"))
        xai_ev = trail.artifact("evidence_pointer", {"kind": "PREDICTION_XAI_EXPLANATION",
                                                     "dvc_path": os.path.join(out, "attributions")}, "evidence_id")
        e2 = trail.event("Phase3_PredictionPipeline", "XAI_EXPLANATIONS_GENERATED", "Attributions computed",
                         {"xai_evidence_id": xai_ev, "expected_value": expected})
        trail.link(e2, evidence_id=xai_ev)
        preds = spark.read.parquet(os.path.join(out, "predictions")).withColumn("model_version", F.lit(evidence["model_version"]))
        decided = PO.decide(PO.evaluate(preds, AT.pack_drivers(phi)))                      # G1-G5
        sinks.write_table(decided.select("id", "model_version", "provenance_allow", "final_decision", "confidence_status", "violations"),
                          os.path.join(out, "decisions"))
        esc = PO.escalations(decided, run_ts)                                             # G7
        sinks.write_table(esc, os.path.join(out, "escalations"))
        # One HUMAN_ESCALATION audit event per escalation, appended as a distributed projection.
        esc = spark.read.schema(esc.schema).parquet(os.path.join(out, "escalations"))
        esc_events = esc.select(
            F.substring(F.sha2(F.concat_ws("|", F.lit(txn), F.col("escalation_id")), 256), 1, 32).alias("event_id"),
            F.col("escalated_at").alias("created_at"), F.lit(trace).alias("trace_id"),
            F.col("client_transaction_id"), F.lit("Critic_Agent").alias("agent_name"),
            F.lit("Phase3_Governance").alias("phase"), F.lit("HUMAN_ESCALATION").alias("event_type"),
            F.lit("Prediction requires human review due to policy violations or low confidence").alias("summary"),
            F.to_json(F.struct("escalation_id", "violation_count", "confidence", "action")).alias("extra_payload"))
        sinks.append_events(esc_events, os.path.join(trail.root, "audit_event"))
        gov_ev = trail.artifact("evidence_pointer", {"kind": "GOVERNANCE_DECISION", "dvc_path": os.path.join(out, "decisions")},
                                "evidence_id")
        e3 = trail.event("Phase3_Governance", "POLICY_EVALUATION_COMPLETED", "Policies evaluated",
                         {"governance_evidence_id": gov_ev, "prediction_evidence_id": pred_ev})
        trail.link(e3, evidence_id=gov_ev)
        trail.link(e3, evidence_id=pred_ev)
        trail.flush()
        return trail.root
    except Exception as e:
        trail.fail("Phase3_PredictionPipeline", e)
        raise


def _events(spark, root):
    schema = EVENT_SCHEMA + ", event_date date"
    return spark.read.schema(schema).parquet(os.path.join(root, "audit_event")).select(
        "event_id", "created_at", "client_transaction_id", "agent_name", "phase", "event_type", "summary", "extra_payload")


@query("assurance_run")
def assurance_run(spark, sf):
    """SURVEY 3.1 end to end; the audit events the run appended."""
    return _events(spark, assurance_job(spark, sf, scratch_path(spark, f"assurance-{uuid.uuid4().hex}")))


@query("scoring_run")
def scoring_run(spark, sf):
    """SURVEY 3.3 end to end with the best curriculum model; the audit events the run appended."""
    from .model import trained_root
    return _events(spark, scoring_job(spark, sf, scratch_path(spark, f"scoring-{uuid.uuid4().hex}"), trained_root(spark, sf)))


@query("training_run")
def training_run(spark, sf):
    """SURVEY 3.2 end to end; the audit events the run appended."""
    from .model import trained_root
    return _events(spark, trained_root(spark, sf))


@query("answer_trained_model")
def answer_trained_model(spark, sf):
    """C15 over a training run's own audit tables: the model trained by the transaction, with its evidence."""
    from .model import trained_root
    return trained_answers(spark, trained_root(spark, sf))


def trained_answers(spark, root):
    ev = _events(spark, root)
    target = QU.answer_target(ev, LI.event_edges(ev), "MODEL_TRAINING_COMPLETED", "TRAINED")
    arts = _evidence(spark, root)
    return target.join(arts, target.target_id == arts.evidence_id).select(
        "client_transaction_id", F.col("target_id").alias("model_id"), F.lit("TrainedModel").alias("model_type"), "model_version", "sha256")


@query("run_lineage")
def run_lineage(spark, sf):
    """Lineage graph edges of an assurance run's own audit trail (typed by the payload keys it wrote)."""
    root = assurance_job(spark, sf, scratch_path(spark, f"lineage-{uuid.uuid4().hex}"))
    ev = _events(spark, root)
    links = spark.read.parquet(os.path.join(root, "event_link"))
    arts = spark.read.parquet(os.path.join(root, "artifacts"))
    evidence = arts.where(F.col("table_name") == "evidence_pointer").select("evidence_id", "kind", F.lit(None).cast(
        "timestamp_ntz").alias("created_at"))
    policies = arts.where(F.col("table_name") == "policy_document").select(
        F.col("policy_id").alias("node_id"), F.lit("Policy").alias("label"), F.lit("PolicyDocument").alias("node_type"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"))
    nodes = LI.artifact_nodes(evidence, links).unionByName(policies)
    return LI.event_edges(ev).unionByName(LI.link_edges(links, ev, nodes))

