"""Canonical rows, row hashes, dataset fingerprints and the preprocessing metadata record."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.columns import canonical_row, row_hash
from ..operators import features as FE
from ..operators import quality as QU
from ..operators import sampling as SA
from ..operators import fingerprint as FP
from ..operators import model as MO
from ..sources import views
from .registry import query
from .sqlparts import BILL, FEATURE_CHAIN, PAY, PAYAMT

ACC = ("accounts",)
_RAW = ["id", "limit_bal", "sex", "education", "marriage", "age"] + PAY + BILL + PAYAMT + ["default_payment_next_month"]
_TYPES = {"limit_bal": "double", **{c: "double" for c in BILL + PAYAMT}}


def _canon_sql(cols, types):
    parts = []
    for c in sorted(cols):
        if types.get(c) == "double":
            parts.append(f"coalesce(CAST(CAST({c} AS DECIMAL(38,6)) AS VARCHAR), '\\N')")
        else:
            parts.append(f"coalesce(CAST({c} AS VARCHAR), '\\N')")
    return "concat_ws('|', " + ", ".join(parts) + ")"


@query("canonical_row", f"SELECT id, {_canon_sql(_RAW, _TYPES)} AS canonical FROM accounts", ACC)
def canonical_row_q(spark, sf):
    """stable text of every account row (sorted columns, null token, fixed-scale doubles)."""
    acc = views.accounts(spark, sf)
    return acc.select("id", canonical_row(acc).alias("canonical"))


_FEAT = MO.FEATURES
_FEAT_TYPES = {c: "double" for c in ["limit_bal", "age", "utilization_rate"] + BILL + PAYAMT}


@query("input_feature_hash", f"{FEATURE_CHAIN}\nSELECT id, sha256({_canon_sql(_FEAT, _FEAT_TYPES)}) AS input_hash FROM feat", ACC)
def input_feature_hash(spark, sf):
    """SHA-256 of each cleaned scoring input."""
    from ..operators import features as FE
    df = FE.engineer(FE.clean_accounts(views.accounts(spark, sf)))
    return df.select("id", row_hash(df, _FEAT).alias("input_hash"))


def _fp_sql(src):
    return f"""h AS (SELECT sha256({_canon_sql(_RAW, _TYPES)}) AS h FROM {src}),
leaves AS (SELECT h, count(*) AS n FROM h GROUP BY h),
l1 AS (SELECT substr(h, 1, 6) AS b, sha256(string_agg(h || ':' || n, '' ORDER BY h)) AS bh, sum(n) AS n FROM leaves GROUP BY 1),
l2 AS (SELECT substr(b, 1, 3) AS b2, sha256(string_agg(bh, '' ORDER BY b)) AS b2h, sum(n) AS n FROM l1 GROUP BY 1),
fp AS (SELECT sha256(string_agg(b2h, '' ORDER BY b2)) AS fingerprint, CAST(sum(n) AS BIGINT) AS row_count FROM l2)"""


@query("dataset_fingerprint", f"WITH {_fp_sql('accounts')}\nSELECT * FROM fp", ACC)
def dataset_fingerprint(spark, sf):
    """order-insensitive fingerprint of the account table (hash tree, bounded fan-in)."""
    return FP.fingerprint(views.accounts(spark, sf))


# What the preparation does, from the constants that its operators run with.
def rules() -> dict:
    return {
        "recode": {"education": {str(k): v for k, v in QU.EDUCATION_RECODE.items()}, "marriage": {str(k): v for k, v in QU.MARRIAGE_RECODE.items()}},
        "clip": {"columns": QU.PAY_CLIP_COLUMNS, "bounds": list(QU.PAY_CLIP)},
        "impute": {"zero_prefixes": list(QU.ZERO_FILL_PREFIXES), "median": QU.MEDIAN_FILL_COLUMNS, "mode": QU.PAY_STATUS_COLUMNS},
        "derive": {"columns": FE.ENGINEERED_COLUMNS, "months_late_of": QU.PAY_STATUS_COLUMNS, "utilization_of": list(FE.add_utilization.__defaults__)},
        "zscore": {"columns": FE.NUMERIC_COLUMNS + FE.ENGINEERED_COLUMNS, "fitted_on": "train"},
        "smote": {"columns": MO.FEATURES, "neighbours": SA.SMOTE_K, "above_ratio": FE.IMBALANCE_RATIO},
        "kept": {"features": MO.FEATURES, "target": MO.TARGET},
        "validation_per_mille": MO.VAL_PER_MILLE,
    }


RULES = rules()
RULES_JSON = json.dumps(RULES, sort_keys=True, separators=(",", ":"))
DATA_VERSION = "1.0"


def split_strategy() -> str:
    val = MO.VAL_PER_MILLE / 10
    return f"{100 - val:g}/{val:g}"


@query("pac_metadata", f"""WITH {_fp_sql('accounts')}
SELECT 'DATA-ASSURANCE-{DATA_VERSION}' AS policy_id, '{DATA_VERSION}' AS daa_agent_version, '{split_strategy()}' AS split_strategy,
  fingerprint AS data_version_hash_key, row_count, sha256('{RULES_JSON}') AS rules_sha256,
  sha256('{RULES_JSON}' || fingerprint) AS content_sha256 FROM fp""", ACC)
def pac_metadata(spark, sf):
    """Version record of the preprocessing rules, tied to the dataset fingerprint."""
    fp = FP.fingerprint(views.accounts(spark, sf))
    return fp.select(
        F.lit(f"DATA-ASSURANCE-{DATA_VERSION}").alias("policy_id"), F.lit(DATA_VERSION).alias("daa_agent_version"),
        F.lit(split_strategy()).alias("split_strategy"), F.col("fingerprint").alias("data_version_hash_key"), "row_count",
        F.sha2(F.lit(RULES_JSON), 256).alias("rules_sha256"),
        F.sha2(F.concat(F.lit(RULES_JSON), F.col("fingerprint")), 256).alias("content_sha256"))
