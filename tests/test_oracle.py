"""Every registered query against its DuckDB oracle (small scale factor for speed)."""

import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from compare import compare, duck
from conftest import SF_SMALL

from vigil.operators import model as MO
from vigil.plans.catalog import ORACLE, QUERIES
from vigil.sources import views

SF = os.environ.get("VIGIL_TEST_SF", SF_SMALL)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    problems, _ = compare(QUERIES[name](spark, SF), con, ORACLE[name])
    assert not problems, problems


def accounts_of(spark, split=None):
    from vigil.operators.sampling import hash_split
    df = hash_split(views.accounts(spark, SF), "id", cuts=((MO.VAL_PER_MILLE, "val"),))
    return {r.id for r in (df.where(F.col("split") == split) if split else df).select("id").collect()}


def check_trees(spark, rows):
    assert len(rows) == MO.GBT_PARAMS["maxIter"] and [r.tree_id for r in sorted(rows)] == list(range(len(rows)))
    assert all(r.depth <= MO.GBT_PARAMS["maxDepth"] and r.num_nodes >= 1 for r in rows)


def check_epochs(spark, rows):
    assert sorted(r.epoch for r in rows) == list(range(1, 11))
    assert all(0 <= r.val_acc <= 1 and r.n_rows > 0 for r in rows)


def check_best(spark, rows):
    epochs = QUERIES["curriculum_train"](spark, SF).collect()
    assert rows == [min(epochs, key=lambda r: (-(r.val_roc_auc if r.val_roc_auc is not None else -1.0), r.epoch))]


def check_scores(spark, rows, split=None):
    assert {r.id for r in rows} == accounts_of(spark, split) and len({r.id for r in rows}) == len(rows)
    assert all(0 <= r.p1 <= 1 and (r.prediction == 1) == (r.p1 > 0.5) or r.p1 == 0.5 for r in rows)


def check_oof(spark, rows):
    assert {r.id for r in rows} == accounts_of(spark, "train") and len({r.id for r in rows}) == len(rows)
    assert all(abs(r.p0 + r.p1 - 1) < 1e-9 for r in rows)


def check_attribution(spark, rows):
    assert {r.id for r in rows} == accounts_of(spark) and len(rows) == len({(r.id, r.feature) for r in rows})
    assert {r.feature for r in rows} <= set(MO.FEATURES)


def check_margins(spark, rows):
    assert {r.id for r in rows} == accounts_of(spark)
    assert all(abs(r.phi_sum + r.expected_value - r.margin) < 1e-9 and r.abs_error < 1e-9 for r in rows)


def check_smote(spark, rows):
    by = Counter((r[MO.TARGET], r.synthetic) for r in rows)
    assert by[0, False] + by[0, True] == by[1, False] + by[1, True]
    assert {r.id for r in rows if not r.synthetic} == accounts_of(spark, "train")


def check_counterfactual(spark, rows):
    predicted = {r.id: r.prediction for r in QUERIES["score_batch"](spark, SF).collect()}
    assert {r.id for r in rows} == ({i for i, p in predicted.items() if p == 1} if 0 in predicted.values() else set())
    assert all(predicted[r.neighbor_id] == 0 and r.distance >= 0 and (r.distance == 0) == (not r.changes) for r in rows)


def check_effects(spark, rows):
    assert len(rows) == len({r.id for r in rows}) > 0 and all(abs(r.p_treated - r.p_control - r.ite) < 1e-12 for r in rows)


def events(*wanted):
    def check(spark, rows):
        types = Counter(r.event_type for r in rows)
        assert set(wanted) <= set(types) and "ERROR" not in types and len({r.event_id for r in rows}) == len(rows)
    return check


def check_lineage(spark, rows):
    assert {"PERFORMED", "PART_OF", "CREATED", "DEFINED"} <= {r.edge_type for r in rows}


def check_model_answer(spark, rows):
    assert len(rows) == 1 and rows[0].model_type == "TrainedModel" and len(rows[0].sha256) == 64


def check_ate(spark, rows):
    assert len(rows) == 1 and all(v is None or math.isfinite(v) for v in rows[0] if isinstance(v, float))


def check_label_audit(spark, rows):
    ids = accounts_of(spark, "train")
    assert {r.id for r in rows} <= ids and rows


#: What holds of results that SQL over the given tables can't express.
INVARIANTS = {
    "gbt_fit": check_trees, "model_io": check_trees, "curriculum_train": check_epochs, "best_epoch": check_best,
    "gbt_predict": lambda spark, rows: check_scores(spark, rows, "val"), "score_batch": check_scores, "oof_probabilities": check_oof,
    "tree_attribution": check_attribution, "attribution_check": check_margins, "smote": check_smote, "nearest_counterfactual": check_counterfactual,
    "ite_two_model": check_effects, "ate_ipw": check_ate, "account_label_audit": check_label_audit,
    "assurance_run": events("DATA_HASH_SAVED", "POLICY_METADATA_SAVED", "calculating_confidence_learning", "DATA_ASSURANCE_COMPLETED"),
    "training_run": events("MODEL_TRAINING_STARTED", "MODEL_TRAINING_COMPLETED", "XAI_EXPLANATIONS_GENERATED"),
    "scoring_run": events("PREDICTION_EXECUTED", "XAI_EXPLANATIONS_GENERATED", "POLICY_EVALUATION_COMPLETED"),
    "run_lineage": check_lineage, "answer_trained_model": check_model_answer,
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_invariants_without_sql(spark, name):
    INVARIANTS[name](spark, QUERIES[name](spark, SF).collect())
