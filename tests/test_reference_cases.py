"""The reference's unit cases, re-expressed on small Spark frames."""

import pytest
from pyspark.sql import functions as F

from vigil.functions.columns import escalation_id, influence_bucket, row_hash
from vigil.operators import attribution as AT
from vigil.operators import features as FE
from vigil.operators import labels as L
from vigil.operators import policy as PO
from vigil.operators import quality as Q
from vigil.operators import sampling as S
from vigil.operators.fingerprint import fingerprint


def test_recode(spark):
    df = spark.createDataFrame([(1, 1, 25), (5, 0, 30), (6, 2, 35), (0, 3, 40)], "EDUCATION int, MARRIAGE int, AGE int")
    out = Q.recode_categories(df).collect()
    assert {r.EDUCATION for r in out} <= {1, 4}
    assert {r.MARRIAGE for r in out} <= {1, 2, 3}


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(10, 0), (-5, 12), (2, -2), (None, None)], "PAY_0 int, PAY_1 int")
    out = Q.clip_pay(df).collect()
    assert [r.PAY_0 for r in out] == [9, -1, 2, None]
    assert [r.PAY_1 for r in out] == [0, 9, -1, None]


def test_trim_columns(spark):
    df = spark.createDataFrame([(1, 2)], "`PAY_0 ` int, ` AGE` int")
    assert Q.trim_columns(df).columns == ["PAY_0", "AGE"]


@pytest.mark.parametrize("positives,expected", [(10, True), (50, False)])
def test_imbalance(spark, positives, expected):
    rows = [(1 if i < positives else 0,) for i in range(100)]
    df = spark.createDataFrame(rows, "default_payment_next_month int")
    assert FE.imbalance(df).first().is_imbalanced is expected


def test_up_and_down_sampling_equal_counts(spark):
    rows = [(i, i, 1 if i < 20 else 0) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, AGE int, target int")
    up = S.upsample(df, "target").groupBy("target").count().collect()
    down = S.downsample(df, "target").groupBy("target").count().collect()
    assert len({r["count"] for r in up}) == 1 and up[0]["count"] == 80
    assert len({r["count"] for r in down}) == 1 and down[0]["count"] == 20


def test_missing_report(spark):
    df = spark.createDataFrame([(1, 4), (None, 5), (3, 6)], "A int, B int")
    rep = {r.column_name: r.null_count for r in Q.missing_report(df).collect()}
    assert [c for c, n in rep.items() if n > 0] == ["A"]


def test_imputation_leaves_no_null(spark):
    df = spark.createDataFrame(
        [(1000.0, None, 25, None, None), (None, 500.0, None, 20000.0, 1), (2000.0, 600.0, 30, 30000.0, 0)],
        "BILL_AMT1 double, PAY_AMT1 double, AGE int, LIMIT_BAL double, PAY_0 int")
    out = Q.impute_missing(df)
    row = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in out.columns]).first()
    assert all(v == 0 for v in row)
    ages = sorted(r.AGE for r in out.collect())
    assert ages == [25.0, 27.5, 30.0]  # median of 25 and 30


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([(2,), (1,), (None,)], "pay_0 int")
    assert Q.fit_mode(df, ["pay_0"]) == {"pay_0": 1.0}


def test_id_projection(spark):
    df = spark.createDataFrame([(1, 25), (2, 30), (3, 35)], "ID int, AGE int")
    assert Q.present(df, ["id"]) == ["ID"]
    assert Q.present(df.drop("ID"), ["id"]) == []


def test_derived_features(spark):
    df = spark.createDataFrame([(0.0, 5000.0, 1, -1, 2, 0, 0, 0), (10000.0, 5000.0, None, 1, 1, 1, 1, 1)],
                               "limit_bal double, bill_amt1 double, pay_0 int, pay_2 int, pay_3 int, pay_4 int, "
                               "pay_5 int, pay_6 int")
    out = FE.engineer(df).collect()
    assert [r.total_months_late for r in out] == [2, 5]
    assert out[0].utilization_rate is None and out[1].utilization_rate == 0.5


def test_zscore_mean_zero_std_one(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(10)], "limit_bal double, age double")
    scaled = FE.zscore_transform(df, FE.zscore_fit(df))
    s = scaled.agg(F.avg("limit_bal"), F.stddev_samp("limit_bal")).first()
    assert abs(s[0]) < 1e-9 and abs(s[1] - 1) < 1e-9


def test_split_sizes_add_up(spark):
    df = spark.range(1000).select(F.col("id"))
    out = S.hash_split(df, "id", cuts=((100, "test"), (200, "val")))
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert sum(counts.values()) == 1000 and set(counts) == {"train", "val", "test"}


def test_hash_determinism_and_sensitivity(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "A int, B string")
    h1 = fingerprint(df).first().fingerprint
    h2 = fingerprint(df.repartition(3).orderBy(F.desc("A"))).first().fingerprint
    h3 = fingerprint(df.withColumn("A", F.when(F.col("A") == 1, 999).otherwise(F.col("A")))).first().fingerprint
    assert h1 == h2 and h1 != h3 and len(h1) == 64
    rows = df.select(row_hash(df).alias("h")).collect()
    assert all(len(r.h) == 64 for r in rows)


def test_single_class_label_audit_raises(spark):
    df = spark.createDataFrame([(i, 1) for i in range(10)], "id long, label int")
    with pytest.raises(ValueError):
        FE.require_two_labels(df)


def test_curriculum_segments_null_is_low(spark):
    train = spark.createDataFrame([(1, 10, 1), (2, 20, 0), (3, 30, 1), (4, 40, 0)], "id long, feature1 int, y int")
    scores = spark.createDataFrame([(1, 0.95), (2, 0.80), (3, 0.92), (4, 0.50)], "id long, quality_score double")
    seg = {r.id: r.segment for r in L.segment(L.join_quality(train, scores)).collect()}
    assert seg == {1: "high", 2: "low", 3: "high", 4: "low"}
    seg2 = {r.id: (r.segment, r.quality_score) for r in
            L.segment(L.join_quality(train, scores.where("id != 3"))).collect()}
    assert seg2[3] == ("low", None)


def test_escalation_id_prefix(spark):
    df = spark.createDataFrame([("TXN001", "2024-03-04 05:06:07")], "txn string, ts string")
    eid = df.select(escalation_id("txn", F.col("ts").cast("timestamp_ntz")).alias("e")).first().e
    assert eid == "ESC-TXN001-20240304050607"


def test_policy_cases(spark):
    preds = spark.createDataFrame([(1, 0.85, "gb_model_v1"), (2, 0.45, "invalid_model")],
                                  "id long, confidence double, model_version string")
    drivers = spark.createDataFrame([], "id long, drivers array<struct<feature:string,phi:double>>")
    ev = {r.id: r for r in PO.decide(PO.evaluate(preds, drivers)).collect()}
    assert ev[1].oversight_allow and ev[1].provenance_allow and ev[1].final_decision == "APPROVED"
    assert not ev[2].oversight_allow and not ev[2].provenance_allow and ev[2].final_decision == "BLOCKED"
    assert ev[2].oversight_message == "Confidence: 0.45, Threshold: 0.7"


def test_full_prediction_record_blocks(spark):
    # Five drivers of the reference's sample record: EDUCATION -0.315 exceeds 0.3; confidence 0.408 < 0.7.
    phi = spark.createDataFrame([(7, "EDUCATION", -0.315), (7, "MARRIAGE", 0.187), (7, "PAY_0", 0.12),
                                 (7, "LIMIT_BAL", -0.09), (7, "AGE", 0.05), (7, "SEX", 0.01)],
                                "id long, feature string, phi double")
    preds = spark.createDataFrame([(7, 0.408, "gb_model_v1")], "id long, confidence double, model_version string")
    r = PO.decide(PO.evaluate(preds, AT.pack_drivers(phi))).first()
    assert [v.attribute for v in r.violations] == ["EDUCATION"]
    assert r.violations[0].message == "Prohibited attribute EDUCATION has excessive influence: 0.315"
    assert r.confidence_status == "human_review_required" and r.final_decision == "BLOCKED"


def test_influence_buckets_asymmetric(spark):
    df = spark.createDataFrame([(0.2,), (0.1,), (-0.2,), (-0.06,), (0.0,), (-0.1,)], "v double")
    assert [r.b for r in df.select(influence_bucket("v").alias("b")).collect()] == [
        "strong_positive", "moderate_positive", "strong_negative", "moderate_negative", "weak", "moderate_negative"]


def test_policy_registry_has_rules(spark):
    reg = PO.registry(spark).collect()
    assert {r.policy for r in reg} == {PO.OVERSIGHT, PO.PROHIBITED, PO.PROVENANCE}
    assert {r.action_on_violation for r in reg} == {"BLOCK", "ESCALATE", "DENY"}


def test_csv_scan_with_reference_layout(spark, tmp_path):
    """S1 + P1 + P3: the credit CSV layout (upper-case names, stray spaces) reads with a declared schema."""
    from conftest import SF_SMALL
    from vigil.sources import tables, views
    acc = views.accounts(spark, SF_SMALL)
    names = {"id": "ID", "default_payment_next_month": "default_payment_next_month"}
    raw = acc.select(*[F.col(c).alias(names.get(c, c.upper())) for c in acc.columns])
    path = str(tmp_path / "accounts_csv")
    raw.withColumnRenamed("PAY_0", "PAY_0 ").coalesce(1).write.option("header", True).csv(path)
    back = Q.trim_columns(spark.read.option("header", True).csv(path))
    assert "PAY_0" in back.columns
    rep = {r.column_name: r for r in Q.dtype_report(back, {"LIMIT_BAL": "double", "AGE": "bigint", "BILL_AMT1": "bigint"}).collect()}
    assert rep["limit_bal"].actual == "string" and rep["age"].bad_values == 0 and rep["bill_amt1"].bad_values > 0
    typed = tables.read_accounts_csv(spark, path, tables.account_schema([c.strip() for c in back.columns]))
    assert typed.count() == acc.count()
    with pytest.raises(FileNotFoundError):
        tables.read_accounts_csv(spark, str(tmp_path / "missing.csv"))


def test_article_lookup_bound(spark):
    from vigil.operators import fairness as FA
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    best = {r.vec_id: r.article for r in FA.nearest_article(vecs, {0: [1.0, 0.1], 1: [0.1, 1.0]}, "vec_id", "embedding").collect()}
    assert best == {1: 0, 2: 1}
    # more articles than one expression holds: the same best one, the smallest id at ties
    many = {i: [1.0, 0.1 * (i % 7)] for i in range(2 * FA.ARTICLE_BLOCK + 1)}
    best = {r.vec_id: r.article for r in FA.nearest_article(vecs, many, "vec_id", "embedding").collect()}
    assert best == {1: 0, 2: 6}
    assert FA.nearest_article(vecs, {}, "vec_id", "embedding").where("article is null").count() == 2


def test_hash_chain_levels_and_null_transactions(spark, monkeypatch):
    """Blocks of two: segments, the chain fold and events without a transaction, against hashlib."""
    import hashlib
    from vigil.operators import chain as CH
    monkeypatch.setattr(CH, "BLOCK", 2)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [("a" if i % 3 else None, f"e{i:02d}", "2024-01-01 00:00:00") for i in range(31)]
    ev = spark.createDataFrame(rows, "client_transaction_id string, event_id string, t string").select(
        "client_transaction_id", "event_id", F.col("t").cast("timestamp_ntz").alias("created_at"),
        *[F.lit("x").alias(c) for c in ("agent_name", "phase", "event_type", "extra_payload")])
    heads = {r.client_transaction_id: r for r in CH.build_chain(ev)[1].collect()}
    for txn in ("a", None):
        level = [sha(f"{e}|1704067200000000|x|x|x|x") for t, e, _ in rows if t == txn]
        n = len(level)
        for _ in range(2):
            level = [sha("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
        head = sha("genesis-" + (txn or "\\N"))
        for h in level:
            head = sha(head + h)
        assert heads[txn].chain_head == head and heads[txn].n_events == n and heads[txn].n_blocks == -(-n // 2)
    stored = spark.createDataFrame([(t, r.chain_head) for t, r in heads.items()], "client_transaction_id string, chain_head string")
    touched = ev.withColumn("extra_payload", F.when(F.col("event_id") == "e00", "y").otherwise(F.col("extra_payload")))
    assert {r.client_transaction_id: r.valid for r in CH.verify_chain(stored, touched).collect()} == {"a": True, None: False}


def test_decision_graph_has_all_kinds_and_why_names_causes(spark):
    from vigil.operators import questions as QU
    from vigil.plans.catalog import QUERIES
    from conftest import SF_SMALL

    kinds = {r.label for r in QUERIES["decision_graph_nodes"](spark, SF_SMALL).select("label").distinct().collect()}
    assert kinds == {"FinalDecision", "Violation", "PolicyCheck", "HumanOversight", "ExplanationArtifact", "PredictionMetrics"}
    nodes, edges = QUERIES["decision_graph_nodes"](spark, SF_SMALL), QUERIES["decision_graph_edges"](spark, SF_SMALL)
    assert edges.join(nodes, edges.dst == nodes.node_id, "left_anti").count() == 0
    events = spark.createDataFrame([("e1", "T1", "X", 1), ("e2", "T2", "X", 1)], "event_id string, client_transaction_id string, event_type string, created_at long")
    links = spark.createDataFrame([("e1", "7", "EVALUATED", "G")], "src string, dst string, edge_type string, dst_label string")
    d = spark.sql("SELECT 7 AS id, 'BLOCKED' AS final_decision, 'pass' AS confidence_status, array(named_struct('attribute', 'SEX'), named_struct('attribute', 'AGE')) AS violations")
    got = {r.client_transaction_id: (r.violations, r.policies) for r in QU.answer_why_detail(events, links, d).collect()}
    assert got == {"T1": (["AGE", "SEX"], ["oversight_threshold_check", "prohibited_attribute_check"]), "T2": (None, None)}


@pytest.mark.parametrize("module, name, value", [
    (Q, "MEDIAN_FILL_COLUMNS", ["age"]), (Q, "ZERO_FILL_PREFIXES", ("bill_amt",)), (Q, "PAY_STATUS_COLUMNS", ["pay_0"]),
    (FE, "ENGINEERED_COLUMNS", ["utilization_rate"]), (FE, "NUMERIC_COLUMNS", ["age"]), (FE, "IMBALANCE_RATIO", 2.0), (S, "SMOTE_K", 3)])
def test_rules_record_follows_the_preparation(monkeypatch, module, name, value):
    from vigil.plans import fingerprint as FP

    assert FP.rules() == FP.RULES
    monkeypatch.setattr(module, name, value)
    assert FP.rules() != FP.RULES


def test_agents_answer_lists_ten(spark):
    from vigil.operators.questions import agent_counts
    rows = [("T", f"agent-{i:02d}") for i in range(12) for _ in range(i + 1)] + [("U", "solo")]
    got = agent_counts(spark.createDataFrame(rows, "client_transaction_id string, agent_name string"))
    assert sorted((r.agent_name, r.event_count) for r in got.where("client_transaction_id = 'T'").collect()) == [(f"agent-{i:02d}", i + 1) for i in range(10)]
    assert got.count() == 11


def test_articles_in_blocks(spark, monkeypatch):
    """Thousands of articles in blocks, rows in parts, ties, rows without a cosine; one scan of the vectors."""
    import numpy as np

    from vigil.operators import fairness as FA
    monkeypatch.setattr(FA, "ARTICLE_BLOCK", 300)
    monkeypatch.setattr(FA, "PART_ROWS", 40)
    rng = np.random.default_rng(1)
    articles = rng.integers(-3, 4, (1000, 4)).astype(float)
    vectors = rng.integers(-3, 4, (150, 4)).astype(float)
    table = spark.createDataFrame([(int(i), list(map(float, a))) for i, a in enumerate(articles)], "article long, vector array<double>")
    rows = spark.createDataFrame([(int(i), list(map(float, v))) for i, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 4)], "vec_id long, embedding array<float>")
    out = FA.nearest_article(rows, table, "vec_id", "embedding")
    got = {r.vec_id: (r.article, r.cosine) for r in out.collect()}
    with np.errstate(invalid="ignore"):
        unit = articles / np.linalg.norm(articles, axis=1)[:, None]
    for i, v in enumerate(vectors):
        if not v.any():
            assert got[i] == (None, None)
            continue
        cos = np.nan_to_num(unit @ v / np.linalg.norm(v), nan=-9)
        assert abs(got[i][1] - cos.max()) < 1e-9 and abs(cos[got[i][0]] - cos.max()) < 1e-9
    assert got[900] == got[901] == (None, None) and len(got) == 152
