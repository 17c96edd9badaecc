"""The seven fixture views of FIXTURES.md part B, built with the DataFrame API.

Each builder reads only the driver tables it needs; the SQL text of the same
views (used by the DuckDB oracle) lives in ``vigil.plans.oracle_views``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import in_file_order, table

PAY_STATUS = ["pay_0", "pay_2", "pay_3", "pay_4", "pay_5", "pay_6"]
BILL_AMT = [f"bill_amt{i}" for i in range(1, 7)]
PAY_AMT = [f"pay_amt{i}" for i in range(1, 7)]
TARGET = "default_payment_next_month"
ACCOUNT_COLUMNS = (["id", "limit_bal", "sex", "education", "marriage", "age"]
                   + PAY_STATUS + BILL_AMT + PAY_AMT + [TARGET])

# Feature names of the attribution view and their offsets (fixed values).
PHI_FEATURES = [("LIMIT_BAL", 0), ("SEX", 1), ("EDUCATION", 2), ("MARRIAGE", 3), ("AGE", 4),
                ("PAY_0", 5), ("BILL_AMT1", 6), ("PAY_AMT1", 7), ("total_months_late", 8),
                ("utilization_rate", 9)]


def accounts(spark: SparkSession, sf_dir: str, position: bool = False) -> DataFrame:
    """Credit accounts: one row per customer, six most recent orders pivoted.

    The six latest orders per customer come from ``row_number() <= 6``; Spark
    plans this with a partial WindowGroupLimit before the shuffle, so a
    customer holding a large share of orders still ships at most six rows per
    map task. The pivot is a hash aggregate on the same key, and the customer
    table joins the (already key-partitioned) result without another
    shuffle of the aggregate side. With ``position`` the rows carry the
    place of their customer in the input.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    recent = orders.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 6)
    pay_code = F.substring("o_orderpriority", 1, 1).cast("int") * 3 - 5
    price = F.col("o_totalprice")
    aggs = []
    for i, name in enumerate(PAY_STATUS, start=1):
        aggs.append(F.max(F.when(F.col("rn") == i, pay_code)).alias(name))
    for i, name in enumerate(BILL_AMT, start=1):
        aggs.append(F.max(F.when(F.col("rn") == i, price)).alias(name))
    for i, name in enumerate(PAY_AMT, start=1):
        aggs.append(F.max(F.when(F.col("rn") == i, price / 6)).alias(name))
    aggs.append(F.max(F.when((F.col("rn") == 1) & (F.col("o_orderstatus") == "F"), F.lit(1))
                      .otherwise(F.lit(0))).alias(TARGET))
    per_customer = recent.groupBy("o_custkey").agg(*aggs)

    cust = table(spark, sf_dir, "customer")
    place = ["position"] if position else []
    cust = (in_file_order(cust) if position else cust).select("c_custkey", "c_acctbal", "c_nationkey", *place)
    key = F.col("c_custkey")
    joined = cust.join(per_customer, cust.c_custkey == per_customer.o_custkey, "left")
    return joined.select(
        key.alias("id"),
        F.col("c_acctbal").alias("limit_bal"),
        (F.lit(1) + key % 2).cast("int").alias("sex"),
        (F.col("c_nationkey") % 7).cast("int").alias("education"),
        (F.col("c_nationkey") % 4).cast("int").alias("marriage"),
        F.when(key % 97 == 0, F.lit(None).cast("int")).otherwise((F.lit(20) + key % 60).cast("int")).alias("age"),
        *[F.col(c) for c in PAY_STATUS + BILL_AMT + PAY_AMT],
        # A customer without orders has one null-extended row in the SQL form,
        # whose CASE yields 0.
        F.coalesce(F.col(TARGET), F.lit(0)).alias(TARGET),
        *place,
    )


def pred_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold class probabilities stand-in: (id, label, p0, p1)."""
    lab = table(spark, sf_dir, "labels")
    p1 = ((F.col("doc_id") * 37) % 101).cast("double") / 100
    return lab.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"),
                      (F.lit(1.0) - p1).alias("p0"), p1.alias("p1"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model scores per account: (id, p1, model_version)."""
    cust = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    version = (F.when(k % 4 == 0, "gb_model_v1").when(k % 4 == 1, "rf_model_v2")
               .when(k % 4 == 2, "old_model").otherwise(""))
    return cust.select(k.alias("id"), (((k * 53) % 101).cast("double") / 100).alias("p1"),
                       version.alias("model_version"))


def phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-account, per-feature attribution: (id, feature, phi).

    Ten features per account come from exploding a literal array, a narrow
    projection (no join).
    """
    cust = table(spark, sf_dir, "customer").select("c_custkey")
    feats = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(k).alias("k")) for n, k in PHI_FEATURES])
    exploded = cust.select(F.col("c_custkey").alias("id"), F.explode(feats).alias("f"))
    value = ((F.col("id") * 31 + F.col("f.k") * 17) % 101 - 50).cast("double") / 100
    return exploded.select("id", F.col("f.feature").alias("feature"), value.alias("phi"))


def audit_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only audit events derived from ``events``."""
    ev = table(spark, sf_dir, "events")
    et = F.col("event_type")
    uid = F.col("user_id").cast("string")
    agent = (F.when(et == "signup", "DataAssuranceAgent").when(et == "click", "Prediction_Agent")
             .when(et == "view", "Prediction_Agent").when(et == "purchase", "Critic_Agent")
             .otherwise("Orchestrator_Agent"))
    phase = (F.when(et == "signup", "Phase1_DataAssurance").when(et == "click", "Phase3_PredictionPipeline")
             .when(et == "view", "Phase3_PredictionPipeline").when(et == "purchase", "Phase3_Governance")
             .otherwise("Orchestration"))
    etype = (F.when(et == "signup", "DATA_HASH_SAVED").when(et == "view", "PREDICTION_EXECUTED")
             .when(et == "click", "XAI_EXPLANATIONS_GENERATED").when(et == "purchase", "POLICY_EVALUATION_COMPLETED")
             .otherwise("ERROR"))
    return ev.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("trace-"), uid).alias("trace_id"),
        F.concat(F.lit("TXN-"), uid).alias("client_transaction_id"),
        agent.alias("agent_name"), phase.alias("phase"), etype.alias("event_type"),
        F.col("props").alias("extra_payload"), F.col("value").alias("latency_ms"))


def evidence_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    et = F.col("event_type")
    kind = (F.when(et == "signup", "CONFIDENT_LEARNING_REPORT").when(et == "view", "PREDICTION_RESULT")
            .when(et == "click", "PREDICTION_XAI_EXPLANATION").when(et == "purchase", "GOVERNANCE_DECISION")
            .otherwise("TRAINED_MODEL"))
    eid = F.col("event_id").cast("string")
    return ev.select(
        F.concat(F.lit("ev-"), eid).alias("evidence_id"), F.col("ts").alias("created_at"), kind.alias("kind"),
        F.concat(F.lit("path/"), F.col("user_id").cast("string"), F.lit("/"), eid, F.lit(".json")).alias("dvc_path"))


def event_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    e = F.col("event_id")
    eid = e.cast("string")
    return ev.select(
        F.concat(F.lit("ln-"), eid).alias("link_id"), eid.alias("event_id"),
        F.lit(None).cast("string").alias("policy_id"),
        F.when(e % 50 == 0, F.concat(F.lit("ds-"), eid)).alias("dataset_id"),
        F.when(e % 10 == 9, F.lit(None).cast("string")).when(e % 10 == 8, F.lit("ev-missing"))
        .otherwise(F.concat(F.lit("ev-"), eid)).alias("evidence_id"))


VIEW_BUILDERS = {
    "accounts": accounts, "pred_probs": pred_probs, "scores": scores, "phi": phi,
    "audit_event": audit_event, "evidence_pointer": evidence_pointer, "event_link": event_link,
}


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register every fixture view (and the raw tables) as temp views."""
    from .tables import TABLES
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    for name, build in VIEW_BUILDERS.items():
        build(spark, sf_dir).createOrReplaceTempView(name)
