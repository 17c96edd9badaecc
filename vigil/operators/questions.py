"""Audit questions over a table of (question, transaction) rows.

Routing is an ordered ``when`` chain of keyword tests; each intent is
answered for every transaction at once by joins on the lineage edges, then
rendered to text. Per-transaction answers are bounded by the intent's limit
(1, 5 or 10 rows), chosen with ``row_number() <= limit``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .policy import ENFORCED

# Intents in routing order with their keywords and row limits (fixed values).
INTENTS = [
    ("why", ["why was", "what caused"], 1),
    ("data_hash", ["show me data hash", "provenance"], 1),
    ("evidence", ["show me the report", "evidence"], 5),
    ("prediction", ["confidence", "score", "prediction"], 1),
    ("model_lineage", ["what data trained", "model lineage"], 1),
    ("timeline", ["show all events", "timeline"], 10),
    ("agents", ["which agents", "who processed"], 10),
    ("fallback", [], 5),
]
# One question per intent (fixed templates; {txn} is the transaction id).
QUESTION_TEMPLATES = [
    "Why was transaction {txn} blocked?",
    "Show me data hash for {txn}",
    "Show me the report for {txn}",
    "What was the confidence score for {txn}?",
    "What data trained the model for {txn}?",
    "Show all events for {txn}",
    "Which agents processed {txn}?",
    "Tell me about {txn}",
]
# Rendered texts (fixed values).
BULLET = "•"
CLOSING = "\n\nHow else may I assist with this audit?"
BLOCKED_NOTE = "The decision was blocked due to policy violations or low confidence."
APPROVED_NOTE = "The system approved the request based on policy compliance."
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def question_table(events: DataFrame) -> DataFrame:
    """One question per intent for every transaction in the audit table (an explode, no join)."""
    txns = events.select("client_transaction_id").where(F.col("client_transaction_id").isNotNull()).distinct()
    qs = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(t).alias("t")) for i, t in enumerate(QUESTION_TEMPLATES)])
    ex = txns.select("client_transaction_id", F.explode(qs).alias("q"))
    return ex.select(
        F.concat(F.col("client_transaction_id"), F.lit("#"), F.col("q.n").cast("string")).alias("question_id"),
        "client_transaction_id",
        F.replace(F.col("q.t"), F.lit("{txn}"), F.col("client_transaction_id")).alias("question"))


def route(question="question"):
    """C10 + F14: first intent whose keyword occurs in the lower-cased question."""
    q = F.lower(F.col(question))
    expr = None
    for intent, words, _ in INTENTS:
        if not words:
            continue
        cond = reduce(lambda a, b: a | b, [q.contains(w) for w in words])
        expr = F.when(cond, F.lit(intent)) if expr is None else expr.when(cond, F.lit(intent))
    return expr.otherwise(F.lit("fallback"))


def limits_table(spark) -> DataFrame:
    """T4: row limit per intent."""
    return spark.createDataFrame([(i, lim) for i, _, lim in INTENTS], "intent string, row_limit int")


def _first(df: DataFrame, n: int, order) -> DataFrame:
    w = Window.partitionBy("client_transaction_id").orderBy(*order)
    return df.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") <= n)


def _events_of(events, edges, etype=None, edge_type=None):
    ev = events if etype is None else events.where(F.col("event_type") == etype)
    ev = ev.select("event_id", "client_transaction_id", "event_type", "created_at")
    if edge_type is None:
        return ev
    e = edges.where(F.col("edge_type") == edge_type).select(F.col("src").alias("event_id"), F.col("dst").alias("target_id"),
                                                           F.col("dst_label").alias("target_label"))
    return ev.join(e, "event_id")


def answer_why(events, edges, decisions) -> DataFrame:
    """C11: first event of the transaction, its EVALUATED governance node and that decision."""
    first = _first(_events_of(events, edges), 1, ["created_at", "event_id"])
    gov = edges.where(F.col("edge_type") == "EVALUATED").select(F.col("src").alias("event_id"), F.col("dst").alias("gov_id"))
    d = decisions.select(F.col("id").cast("string").alias("gov_id"), "final_decision", "confidence_status",
                         F.size("violations").alias("violation_count"))
    return first.join(gov, "event_id", "left").join(d, "gov_id", "left").select(
        "client_transaction_id", "event_type", "final_decision", "confidence_status", "violation_count")


def answer_why_detail(events, edges, decisions) -> DataFrame:
    """C11 with the violated attributes and the policies enforced, both sorted; null without a decision."""
    first = _first(_events_of(events, edges), 1, ["created_at", "event_id"])
    gov = edges.where(F.col("edge_type") == "EVALUATED").select(F.col("src").alias("event_id"), F.col("dst").alias("gov_id"))
    d = decisions.select(F.col("id").cast("string").alias("gov_id"), "final_decision", "confidence_status",
                         F.array_sort(F.transform("violations", lambda v: v["attribute"])).alias("violations"),
                         F.array(*[F.lit(p) for p in ENFORCED]).alias("policies"))
    return first.join(gov, "event_id", "left").join(d, "gov_id", "left").select(
        "client_transaction_id", "event_type", "final_decision", "confidence_status", "violations", "policies")


def answer_target(events, edges, etype, edge_type, n=1) -> DataFrame:
    """C12/C14/C15 (and C13 with n=5): targets reached from the transaction's events."""
    hits = _events_of(events, edges, etype, edge_type)
    return _first(hits, n, ["created_at", "event_id", "target_id"]).select(
        "client_transaction_id", "target_id", "target_label", F.col("_pos").alias("position"))


def answer_timeline(events, n=10) -> DataFrame:
    """First n events of the transaction."""
    return _first(events.select("client_transaction_id", "event_id", "event_type", "created_at"), n,
                  ["created_at", "event_id"]).withColumnRenamed("_pos", "position")


def agent_counts(events, n=10) -> DataFrame:
    """C17: events of the transaction's first n agents, by name."""
    counts = events.groupBy("client_transaction_id", "agent_name").agg(F.count(F.lit(1)).alias("event_count"))
    return _first(counts, n, ["agent_name"]).drop("_pos")


def _lines(df, text, order_col="position", key="client_transaction_id") -> DataFrame:
    """Join the per-row texts of each transaction with newlines, in order."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), text.alias("t"))))
    return df.groupBy(key).agg(F.array_join(F.transform(packed, lambda s: s["t"]), "\n").alias("body"))


def _u(c):
    return F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))


def render(questions: DataFrame, events: DataFrame, edges: DataFrame, evidence: DataFrame,
           decisions: DataFrame) -> DataFrame:
    """One response text per question; 'No audit records found' when the answer is empty."""
    b = F.lit(BULLET)
    txn = F.col("client_transaction_id")
    why = answer_why(events, edges, decisions).select(
        "client_transaction_id", F.lit("why").alias("intent"),
        F.concat(F.lit("**Transaction "), txn, F.lit(" Analysis:**\n"), b, F.lit(" **Event Type**: "), _u("event_type"),
                 F.lit("\n"), b, F.lit(" **Final Decision**: "), _u("final_decision"), F.lit("\n"), b,
                 F.lit(" **Confidence Status**: "), _u("confidence_status"), F.lit("\n\n"),
                 F.when(F.col("final_decision") == "BLOCKED", F.lit(BLOCKED_NOTE))
                 .when(F.col("final_decision") == "APPROVED", F.lit(APPROVED_NOTE)).otherwise(F.lit(""))).alias("body"))
    dh = answer_target(events, edges, "DATA_HASH_SAVED", "CREATED").select(
        "client_transaction_id", F.lit("data_hash").alias("intent"),
        F.concat(F.lit("**Data Provenance for "), txn, F.lit(":**\n"), b, F.lit(" **Type**: ProcessedData\n"), b,
                 F.lit(" **SHA-256**: "), F.col("target_id")).alias("body"))
    kinds = evidence.select(F.col("evidence_id").alias("target_id"), "kind")
    evd = answer_target(events, edges, None, "HAS_EVIDENCE", 5).where(F.col("position") == 1).join(kinds, "target_id", "left")
    evd = evd.select("client_transaction_id", F.lit("evidence").alias("intent"),
                     F.concat(F.lit("**Evidence Found:**\n"), b, F.lit(" **ID**: "), F.col("target_id"), F.lit("\n"), b,
                              F.lit(" **Kind**: "), _u("kind"), F.lit("\n"), b, F.lit(" **Type**: "), _u("target_label"))
                     .alias("body"))
    pr = answer_target(events, edges, "PREDICTION_EXECUTED", "PREDICTED").select(
        "client_transaction_id", F.lit("prediction").alias("intent"),
        F.concat(F.lit("**Prediction Record:**\n"), b, F.lit(" **ID**: "), F.col("target_id"), F.lit("\n"), b,
                 F.lit(" **Type**: PredictionResult")).alias("body"))
    md = answer_target(events, edges, "MODEL_TRAINING_COMPLETED", "TRAINED").select(
        "client_transaction_id", F.lit("model_lineage").alias("intent"),
        F.concat(F.lit("**Model Training Record:**\n"), b, F.lit(" **Model ID**: "), F.col("target_id"), F.lit("\n"), b,
                 F.lit(" **Type**: TrainedModel")).alias("body"))
    tl = answer_timeline(events, 5)
    tl_text = _lines(tl, F.concat(b, F.lit(" "), F.col("event_type"), F.lit(" at "),
                                  F.date_format("created_at", TIME_FORMAT)))
    tl_text = tl_text.select("client_transaction_id", F.lit("timeline").alias("intent"),
                             F.concat(F.lit("**Event Timeline for "), txn, F.lit(":**\n"), F.col("body")).alias("body"))
    ag = agent_counts(events)
    ag_text = _lines(ag, F.concat(b, F.lit(" "), F.col("agent_name"), F.lit(" ("), F.col("event_count").cast("string"),
                                  F.lit(" events)")), order_col="agent_name")
    ag_text = ag_text.select("client_transaction_id", F.lit("agents").alias("intent"),
                             F.concat(F.lit("**Agents Involved in "), txn, F.lit(":**\n"), F.col("body")).alias("body"))
    fb = _lines(answer_timeline(events, 3), F.concat(b, F.lit(" "), F.col("event_type")))
    fb = fb.select("client_transaction_id", F.lit("fallback").alias("intent"),
                   F.concat(F.lit("**Recent Events for "), txn, F.lit(":**\n"), F.col("body")).alias("body"))
    answers = reduce(DataFrame.unionByName, [why, dh, evd, pr, md, tl_text, ag_text, fb])
    routed = questions.withColumn("intent", route())
    j = routed.join(answers, ["client_transaction_id", "intent"], "left")
    response = F.when(F.col("body").isNull(), F.concat(F.lit("No audit records found for Transaction ID "), txn, F.lit(".")))\
        .otherwise(F.concat(F.col("body"), F.lit(CLOSING)))
    return j.select("question_id", "client_transaction_id", "question", "intent", response.alias("response"))
