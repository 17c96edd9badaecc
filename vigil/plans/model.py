"""Model queries: fits, scoring, curriculum training, metrics (scores + accounts)."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import labels as L
from ..operators import model as MO
from ..operators import training as TR
from ..operators.metrics import classification_metrics
from ..operators.sampling import hash_split
from ..session import scratch_path, written
from ..sources import views
from .assurance import featured
from .registry import query
from .sqlparts import FEATURE_CHAIN, SCALED, ZFIT, hash_bucket

SA = ("scores", "accounts")


def frame(spark, sf):
    return MO.model_frame(views.accounts(spark, sf))


def trained_root(spark, sf):
    """The audit root of a training run on this data: a run is found by the data's fingerprint, so changed data trains anew."""
    from ..operators.fingerprint import fingerprint
    from .jobs import training_job
    parts = [fingerprint(df).first().fingerprint for df in (views.accounts(spark, sf), views.pred_probs(spark, sf))]
    run_id = hashlib.sha256("".join(parts).encode()).hexdigest()[:16]
    return training_job(spark, sf, scratch_path(spark, f"training-{run_id}"), run_id)


def _trained(spark, sf):
    """(prepared accounts, epochs, pipeline of the best epoch) as the training run wrote them."""
    from .jobs import trained_model
    root = trained_root(spark, sf)
    evidence, model = trained_model(spark, root)
    fr = MO.model_frame(views.accounts(spark, sf), preparation=model.stages[0])
    return fr, spark.read.parquet(evidence["epochs_path"]), PipelineModel(model.stages[1:])


def _tree_table(spark, model: PipelineModel):
    gbt = model.stages[-1]
    rows = [(i, float(w), t.numNodes, t.depth) for i, (t, w) in enumerate(zip(gbt.trees, gbt.treeWeights))]
    return spark.createDataFrame(rows, "tree_id int, weight double, num_nodes int, depth int")


@query("gbt_fit")
def gbt_fit(spark, sf):
    """Boosted trees on the train split (one row per tree: weight, size)."""
    fr = frame(spark, sf)
    return _tree_table(spark, MO.gbt_fit(fr.where("split = 'train'")))


@query("curriculum_train")
def curriculum_train(spark, sf):
    """Ten epochs, each its own seeded fit on its phase's rows; validation accuracy / F1 / AUC per epoch."""
    return _trained(spark, sf)[1]


@query("best_epoch")
def best_epoch(spark, sf):
    """Epoch with the best validation AUC (first on ties)."""
    return TR.best_epoch(_trained(spark, sf)[1])


@query("gbt_predict")
def gbt_predict(spark, sf):
    """Label and P(default) for the validation rows with the best curriculum model."""
    fr, _, model = _trained(spark, sf)
    return MO.predict(model, fr.where("split = 'val'")).select("id", "prediction", "p1")


@query("model_io")
def model_io(spark, sf):
    """Best model saved and loaded back; the loaded model's tree table."""
    _, _, model = _trained(spark, sf)
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    return _tree_table(spark, PipelineModel.load(path))


@query("score_batch")
def score_batch(spark, sf):
    """The full scoring chain (clean, saved fills, features, saved scaling, predict) for every account; nothing is fitted."""
    from .jobs import trained_model
    _, model = trained_model(spark, trained_root(spark, sf))
    accounts = hash_split(views.accounts(spark, sf), "id", cuts=((MO.VAL_PER_MILLE, "val"),))
    return MO.predict(model, accounts).select("id", "split", "prediction", "p1")


@query("oof_probabilities")
def oof_probabilities(spark, sf):
    """L1: five-fold out-of-fold probabilities from 100-tree forests (train split)."""
    from ..operators.sampling import stratified_folds
    fr = frame(spark, sf).where("split = 'train'")
    folds = stratified_folds(fr.select("id", MO.TARGET), MO.TARGET)
    return MO.oof_probabilities(fr, folds)


_METRICS_SQL = """WITH d AS (SELECT s.p1 AS score, a.default_payment_next_month AS y FROM scores s JOIN accounts a ON a.id = s.id),
g AS (SELECT score, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS neg FROM d GROUP BY score),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g),
auc AS (SELECT sum(pos * (nb + neg / CAST(2 AS DOUBLE))) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS roc_auc FROM c),
cm AS (SELECT count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (WHERE y = 0 AND score < 0.5) AS tn, count(*) FILTER (WHERE y = 1 AND score < 0.5) AS fn FROM d)"""


def _scored(spark, sf):
    acc = views.accounts(spark, sf).select("id", F.col(MO.TARGET).alias("label"))
    return views.scores(spark, sf).select("id", F.col("p1").alias("score")).join(acc, "id")


@query("classification_metrics", _METRICS_SQL + """
SELECT tp, fp, tn, fn, round(CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn), 9) AS accuracy,
  round(CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn), 9) AS f1, round(roc_auc, 9) AS roc_auc FROM cm CROSS JOIN auc""", SA)
def classification_metrics_q(spark, sf):
    """A10: accuracy, F1 and exact ROC AUC of stored scores against the account target."""
    m = classification_metrics(_scored(spark, sf), "label", "score")
    return spark.createDataFrame([(m["tp"], m["fp"], m["tn"], m["fn"], round(m["accuracy"], 9), round(m["f1"], 9),
                                   round(m["roc_auc"], 9))],
                                 "tp bigint, fp bigint, tn bigint, fn bigint, accuracy double, f1 double, roc_auc double")


@query("precision_recall", _METRICS_SQL + """
SELECT round(CAST(tp AS DOUBLE) / (tp + fp), 9) AS precision, round(CAST(tp AS DOUBLE) / (tp + fn), 9) AS recall FROM cm""", SA)
def precision_recall(spark, sf):
    """Precision and recall of the positive class."""
    m = classification_metrics(_scored(spark, sf), "label", "score")
    return spark.createDataFrame([(round(m["precision"], 9), round(m["recall"], 9))], "precision double, recall double")


@query("tree_attribution")
def tree_attribution(spark, sf):
    """Per-row, per-feature Shapley attributions (log-odds) of the best curriculum model, every account."""
    from ..operators.treeshap import tree_attribution as attribute
    fr, _, model = _trained(spark, sf)
    phi, _ = attribute(fr, model, MO.FEATURES)
    return phi


@query("attribution_check")
def attribution_check(spark, sf):
    """L11 invariant: sum(phi) + expected value equals the model margin for every row."""
    from ..operators.treeshap import additivity_check
    fr, _, model = _trained(spark, sf)
    return additivity_check(fr, model, MO.FEATURES)


@query("smote")
def smote(spark, sf):
    """Train split balanced by SMOTE (exact minority k-NN, deterministic gaps, new ids after max id)."""
    from ..operators.sampling import smote as oversample
    fr = frame(spark, sf).where("split = 'train'")
    return oversample(fr.drop("split"), MO.TARGET, MO.FEATURES)


@query("smote_counts", f"""WITH t AS (SELECT id, default_payment_next_month AS y FROM accounts WHERE {hash_bucket('id')} >= {MO.VAL_PER_MILLE}),
c AS (SELECT y, count(*) AS n FROM t GROUP BY y),
m AS (SELECT arg_min(y, n * 10 + y) AS y, max(n) - min(n) AS need FROM c)
SELECT y AS label, false AS synthetic, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM t GROUP BY y
UNION ALL SELECT y, true, need, (SELECT max(id) FROM t) + 1, (SELECT max(id) FROM t) + need FROM m WHERE need > 0""", ("accounts",))
def smote_counts(spark, sf):
    """Rows and ids of each class after balancing: equal counts, new ids after the largest."""
    return smote(spark, sf).groupBy(F.col(MO.TARGET).alias("label"), "synthetic").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def _steps(spark, sf):
    """Features in whole thousandths of a deviation (categories in thousands), so that distances are exact in any engine."""
    df = featured(spark, sf)
    z = FE.zscore_transform(df, FE.zscore_fit(df))
    step = lambda c: F.round(F.col(c).cast("double") * 1000).cast("bigint")
    return z.select("id", *[F.coalesce(step(c), F.lit(0)).alias(c) for c in MO.FEATURES])


def _steps_sql(c):
    if c not in SCALED:
        return f"coalesce(CAST(round(CAST({c} AS DOUBLE) * 1000) AS BIGINT), 0) AS {c}"
    z = f"({c} - (SELECT mean FROM zfit WHERE column_name = '{c}')) / nullif((SELECT std FROM zfit WHERE column_name = '{c}'), 0)"
    return f"coalesce(CAST(round({z} * 1000) AS BIGINT), 0) AS {c}"


_SQUARES = " + ".join(f"(q.{c} - r.{c}) * (q.{c} - r.{c})" for c in MO.FEATURES)
_CHANGED = " + ".join(f"CAST(q.{c} <> r.{c} AS INTEGER)" for c in MO.FEATURES)


@query("stored_counterfactual", f"""{FEATURE_CHAIN},
{ZFIT},
x AS (SELECT id, {", ".join(_steps_sql(c) for c in MO.FEATURES)} FROM feat),
s AS (SELECT x.*, p1 >= 0.5 AS positive FROM x JOIN scores USING (id)),
d AS (SELECT q.id, r.id AS neighbor_id, {_SQUARES} AS d2, {_CHANGED} AS changed FROM s q JOIN s r ON q.positive AND NOT r.positive)
SELECT id, neighbor_id, round(sqrt(CAST(d2 AS DOUBLE)) / 1000, 9) AS distance, changed
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, neighbor_id) AS rn FROM d) WHERE rn = 1""", SA)
def stored_counterfactual(spark, sf):
    """R11 on stored scores: for every account scored 0.5 or more, the nearest account scored below, and how many features differ."""
    from ..operators.neighbors import knn
    scored = written(_steps(spark, sf).join(views.scores(spark, sf).select("id", (F.col("p1") >= 0.5).alias("positive")), "id"), "scored")
    pos, neg = scored.where("positive"), scored.where("not positive")
    nn = knn(pos, neg, MO.FEATURES, 1).select(F.col("query_id").alias("id"), "neighbor_id", F.round(F.col("distance") / 1000, 9).alias("distance"))
    a = pos.select("id", F.array(*MO.FEATURES).alias("a"))
    b = neg.select(F.col("id").alias("neighbor_id"), F.array(*MO.FEATURES).alias("b"))
    changed = F.size(F.filter(F.arrays_zip("a", "b"), lambda p: p["a"] != p["b"]))
    return nn.join(a, "id").join(b, "neighbor_id").select("id", "neighbor_id", "distance", changed.alias("changed"))


@query("nearest_counterfactual")
def nearest_counterfactual(spark, sf):
    """For every account predicted to default, the nearest account predicted not to, and what differs."""
    from ..operators.neighbors import knn
    fr, _, model = _trained(spark, sf)
    scored = written(MO.predict(model, fr).select("id", "prediction", *MO.FEATURES), "scored")
    pos = scored.where("prediction = 1")
    neg = scored.where("prediction = 0")
    nn = knn(pos, neg, MO.FEATURES, 1)
    a = pos.select("id", *[F.col(c).alias(f"a_{c}") for c in MO.FEATURES])
    b = neg.select(F.col("id").alias("neighbor_id"), *[F.col(c).alias(f"b_{c}") for c in MO.FEATURES])
    j = nn.select(F.col("query_id").alias("id"), "neighbor_id", "distance").join(a, "id").join(b, "neighbor_id")
    changes = F.filter(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a_{c}").alias("from_value"),
                                          F.col(f"b_{c}").alias("to_value")) for c in MO.FEATURES]),
                       lambda s: s["from_value"] != s["to_value"])
    return j.select("id", "neighbor_id", "distance", changes.alias("changes"))


@query("account_label_audit")
def account_label_audit(spark, sf):
    """L1 -> L2/L4: label report of the train split from out-of-fold forest probabilities."""
    oof = oof_probabilities(spark, sf)
    return L.label_report(L.with_probs(oof))
