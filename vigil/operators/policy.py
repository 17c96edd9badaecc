"""Governance policies as Column predicates over one row per prediction.

The three rules (oversight threshold, prohibited attributes, model
provenance) are evaluated for all predictions at once; results, decisions
and escalations are ordinary DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import escalation_id, plain_number

# Policy constants (fixed values).
MIN_CONFIDENCE = 0.7
PROHIBITED_ATTRIBUTES = ["SEX", "AGE", "EDUCATION"]
MAX_INFLUENCE = 0.3
APPROVED_MODELS = ["gb_model_v1", "rf_model_v2", "xgb_model_v3"]
ESCALATION_ACTION = "Human review required"

OVERSIGHT = "oversight_threshold_check"
PROHIBITED = "prohibited_attribute_check"
PROVENANCE = "provenance_compliance_check"
#: The policies that decide() enforces by default, sorted; provenance is evaluated and reported.
ENFORCED = [OVERSIGHT, PROHIBITED]

# Policy registry (fixed values): key, name, version, phase, regulation source, article, action.
REGISTRY = [
    (PROHIBITED, "Prohibited Attribute Influence Check", "1.0", "runtime", "EU AI Act",
     "Article 10 - Data and Data Governance", "BLOCK"),
    (OVERSIGHT, "Confidence Threshold and Human Oversight", "1.0", "runtime", "EU AI Act",
     "Article 14 - Human Oversight", "ESCALATE"),
    (PROVENANCE, "Data Provenance & PaC Compliance Check", "1.0", "pre-prediction", "EU AI Act",
     "Article 9 - Risk Management System", "DENY"),
]
REGISTRY_SCHEMA = ("policy string, policy_name string, version string, enforcement_phase string, "
                   "regulation_source string, article string, action_on_violation string")


def registry(spark, include_provenance: bool = True) -> DataFrame:
    rows = [r for r in REGISTRY if include_provenance or r[0] != PROVENANCE]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def prediction_record(scores: DataFrame) -> DataFrame:
    """Label, p0, p1, confidence = max(p0, p1), is_default_risk."""
    p1 = F.col("p1")
    return scores.select(
        "id", (p1 >= 0.5).cast("int").alias("prediction_label"), (F.lit(1.0) - p1).alias("p0"), p1.alias("p1"),
        F.greatest(F.lit(1.0) - p1, p1).alias("confidence"), (p1 >= 0.5).alias("is_default_risk"),
        *[c for c in scores.columns if c == "model_version"])


def oversight(confidence="confidence", threshold: float = MIN_CONFIDENCE) -> dict:
    """G1: allow when confidence >= threshold."""
    c = F.col(confidence)
    return {
        "allow": c >= F.lit(threshold),
        "requires_human_review": c < F.lit(threshold),
        "message": F.concat(F.lit("Confidence: "), plain_number(c), F.lit(", Threshold: "),
                            plain_number(F.lit(threshold))),
    }


def prohibited_violations(drivers="drivers", attributes=PROHIBITED_ATTRIBUTES, limit: float = MAX_INFLUENCE):
    """Violation structs for top drivers that are prohibited and too influential."""
    hits = F.filter(F.col(drivers), lambda d: d["feature"].isin(*attributes) & (F.abs(d["phi"]) > F.lit(limit)))
    return F.transform(hits, lambda d: F.struct(
        d["feature"].alias("attribute"), F.abs(d["phi"]).alias("influence"), F.lit(limit).alias("threshold"),
        F.concat(F.lit("Prohibited attribute "), d["feature"], F.lit(" has excessive influence: "),
                 plain_number(F.abs(d["phi"]))).alias("message")))


def provenance(model_version="model_version", approved=APPROVED_MODELS) -> dict:
    """Allow when the model version is non-empty and approved."""
    v = F.col(model_version)
    ok = F.coalesce((v != F.lit("")) & v.isin(*approved), F.lit(False))
    return {"allow": ok, "message": F.when(ok, "Approved model").otherwise("Model not approved")}


def evaluate(predictions: DataFrame, drivers: DataFrame, threshold: float = MIN_CONFIDENCE,
             include_provenance: bool = True) -> DataFrame:
    """G1-G3 on one wide row per prediction: ``predictions`` (id, confidence,
    model_version) joined to packed ``drivers`` (id, drivers)."""
    wide = predictions.join(drivers, "id", "left").withColumn(
        "drivers", F.coalesce("drivers", F.array().cast("array<struct<feature:string,phi:double>>")))
    o = oversight(threshold=threshold)
    cols = {
        "oversight_allow": o["allow"], "requires_human_review": o["requires_human_review"],
        "oversight_message": o["message"], "violations": prohibited_violations(),
    }
    out = wide.withColumns(cols).withColumn("prohibited_allow", F.size("violations") == 0)
    if include_provenance:
        p = provenance()
        out = out.withColumns({"provenance_allow": p["allow"], "provenance_message": p["message"]})
    return out


def policy_results(evaluated: DataFrame, include_provenance: bool = True) -> DataFrame:
    """Long (id, policy, allow, action_on_violation) for every registered policy."""
    entries = [F.struct(F.lit(OVERSIGHT).alias("policy"), F.col("oversight_allow").alias("allow")),
               F.struct(F.lit(PROHIBITED).alias("policy"), F.col("prohibited_allow").alias("allow"))]
    if include_provenance:
        entries.append(F.struct(F.lit(PROVENANCE).alias("policy"), F.col("provenance_allow").alias("allow")))
    long = evaluated.select("id", F.explode(F.array(*entries)).alias("r")).select("id", "r.policy", "r.allow")
    reg = registry(evaluated.sparkSession, include_provenance).select("policy", "action_on_violation")
    # The registry has one row per policy: a fixed-size broadcast.
    return long.join(F.broadcast(reg), "policy").select("id", "policy", "allow", "action_on_violation")


def decide(evaluated: DataFrame, enforce_provenance: bool = False) -> DataFrame:
    """APPROVED iff no prohibited-attribute violation and no review needed."""
    blocked = (~F.col("prohibited_allow")) | F.col("requires_human_review")
    if enforce_provenance:
        blocked = blocked | ~F.col("provenance_allow")
    return evaluated.withColumns({
        "confidence_status": F.when(F.col("oversight_allow"), "pass").otherwise("human_review_required"),
        "has_violations": ~F.col("prohibited_allow"),
        "final_decision": F.when(blocked, "BLOCKED").otherwise("APPROVED"),
    })


def escalations(decided: DataFrame, run_ts, txn_col="client_transaction_id") -> DataFrame:
    """One record per BLOCKED prediction; the time is the run's, passed in."""
    b = decided.where(F.col("final_decision") == "BLOCKED")
    ts = F.lit(run_ts).cast("timestamp_ntz") if isinstance(run_ts, str) else run_ts
    return b.select(
        escalation_id(F.col(txn_col), ts).alias("escalation_id"), "id", F.col(txn_col), "confidence",
        F.size("violations").alias("violation_count"), F.lit(ESCALATION_ACTION).alias("action"),
        ts.alias("escalated_at"))
