"""The training job: saved state, evidence, answers over the written audit tables, and scoring that fits nothing."""

import os

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from compare import rows_of_duck, rows_of_spark
from vigil.operators import model as MO
from vigil.operators.preparation import AccountPreparation
from vigil.operators.treeshap import tree_table
from vigil.plans import jobs as J
from vigil.sources import views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("training"))
    return out, J.training_job(spark, SF, out, "run-1", maxIter=3)


def parquet(con, folder):
    return f"read_parquet('{folder}/**/*.parquet', hive_partitioning = true, union_by_name = true)"


def test_answer_equals_sql_over_the_written_tables(spark, run):
    import duckdb
    con = duckdb.connect()
    root = run[1]
    sql = f"""SELECT e.client_transaction_id, json_extract_string(e.extra_payload, '$.model_evidence_id') AS model_id, 'TrainedModel' AS model_type,
      a.model_version, a.sha256 FROM {parquet(con, root + '/audit_event')} e
      JOIN {parquet(con, root + '/artifacts')} a ON a.evidence_id = json_extract_string(e.extra_payload, '$.model_evidence_id')
      WHERE e.event_type = 'MODEL_TRAINING_COMPLETED'"""
    got = rows_of_spark(J.trained_answers(spark, root))
    assert got == rows_of_duck(con, sql) and len(got[1]) == 1


def test_best_epoch_equals_sql_over_the_written_epochs(spark, run):
    import duckdb
    best = duckdb.sql(f"SELECT epoch, val_roc_auc FROM '{run[0]}/epochs/*.parquet' ORDER BY val_roc_auc DESC NULLS LAST, epoch LIMIT 1").fetchall()[0]
    event = spark.read.parquet(os.path.join(run[1], "audit_event")).where("event_type = 'MODEL_TRAINING_COMPLETED'").first()
    payload = __import__("json").loads(event.extra_payload)
    assert (payload["best_epoch"], payload["best_roc_auc"]) == best


def test_lineage_is_complete(spark, run):
    events = J._events(spark, run[1])
    assert sorted(r.event_type for r in events.collect()) == ["MODEL_TRAINING_COMPLETED", "MODEL_TRAINING_STARTED", "XAI_EXPLANATIONS_GENERATED"]
    links = spark.read.parquet(os.path.join(run[1], "event_link")).collect()
    assert len(links) == 3 and sum(r.dataset_id is not None for r in links) == 1
    arts = spark.read.option("mergeSchema", "true").parquet(os.path.join(run[1], "artifacts"))
    ids = {r[0] for c in ("evidence_id", "dataset_id") for r in arts.select(c).collect()}
    assert all(r.evidence_id in ids for r in links)


def test_run_id_adds_nothing_twice(spark, run):
    def state():
        return {t: sorted(map(str, spark.read.option("mergeSchema", "true").parquet(os.path.join(run[1], t)).collect())) for t in ("audit_event", "event_link", "artifacts")}
    before = state()
    assert J.training_job(spark, SF, run[0], "run-1", maxIter=3) == run[1]
    trail = J.AuditTrail(spark, run[1], "TXN-TRAINING-run-1", "trace-training", "Training_Agent", "2024-02-01 00:00:00")
    trail.event("Phase2_ModelTraining", "MODEL_TRAINING_STARTED", "again", {})  # a repeated half of the run
    trail.flush()
    assert state() == before


def test_one_row_scores_as_in_the_table(spark, run):
    _, model = J.trained_model(spark, run[1])
    accounts = views.accounts(spark, SF)
    whole = {r.id: r.p1 for r in MO.predict(model, accounts).collect()}
    some = [r.id for r in accounts.where("age is null").limit(2).collect()] + sorted(whole)[:3]
    for i in some:
        alone = MO.predict(model, accounts.where(F.col("id") == i)).collect()
        assert [(r.id, r.p1) for r in alone] == [(i, whole[i])]


def test_saved_preparation_is_the_fitted_one(spark, run, tmp_path):
    accounts = views.accounts(spark, SF)
    fitted = AccountPreparation().fit(accounts)
    saved = J.trained_model(spark, run[1])[1].stages[0]
    assert saved.values() == fitted.values()
    assert AccountPreparation(fitOn="all").fit(accounts).values()["means"] != fitted.values()["means"]
    path = str(tmp_path / "pipeline")
    PipelineModel([fitted]).write().overwrite().save(path)
    assert PipelineModel.load(path).stages[0].values() == fitted.values()
    empty = accounts.limit(0)
    assert saved.transform(empty).count() == 0


def test_model_hash_is_that_of_the_loaded_model(spark, run):
    evidence, model = J.trained_model(spark, run[1])
    assert evidence["sha256"] == MO.model_sha256(model, tree_table(spark, model.stages[-1]))


def test_unapproved_version_is_denied(spark, run, tmp_path):
    root = J.training_job(spark, SF, str(tmp_path / "train"), "run-9", model_version="gb_model_v9", maxIter=2)
    decisions = {}
    for name, trained in (("approved", run[1]), ("unknown", root)):
        J.scoring_job(spark, SF, str(tmp_path / name), trained)
        rows = spark.read.parquet(str(tmp_path / name / "decisions"))
        decisions[name] = {tuple(r) for r in rows.select("model_version", "provenance_allow").distinct().collect()}
    assert decisions == {"approved": {("gb_model_v1", True)}, "unknown": {("gb_model_v9", False)}}


def test_failure_is_recorded(spark, tmp_path):
    with pytest.raises(Exception):
        J.training_job(spark, str(tmp_path / "no-such-folder"), str(tmp_path / "out"), "run-2")
    ev = spark.read.parquet(str(tmp_path / "out" / "audit" / "audit_event")).collect()
    assert [r.event_type for r in ev if "FAILED" in r.event_type] == ["MODEL_TRAINING_FAILED"]
