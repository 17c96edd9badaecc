"""Data-assurance queries: scans, schema checks, cleaning, de-duplication, balance, scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import hash_fraction_key
from ..operators import features as FE
from ..operators import quality as Q
from ..sources import tables, views
from .registry import query
from .sqlparts import BILL, CLEAN_CHAIN, FEATURE_CHAIN, PAY, PAYAMT, SCALED, ZFIT

ACC = ("accounts",)


def clean(spark, sf):
    return FE.clean_accounts(views.accounts(spark, sf))


def featured(spark, sf):
    return FE.engineer(clean(spark, sf))


@query("assurance_profile", f"""{FEATURE_CHAIN}
SELECT education, count(*) AS n, CAST(sum(default_payment_next_month) AS BIGINT) AS defaults,
  round(CAST(100 AS DOUBLE) * sum(default_payment_next_month) / count(*), 6) AS default_pct,
  round(avg(total_months_late), 6) AS avg_months_late,
  round(avg(utilization_rate), 6) AS avg_utilization
FROM feat GROUP BY education""", ACC)
def assurance_profile(spark, sf):
    """Flagship: accounts -> P8 -> P9 -> M2-M4 -> F1 -> F2 -> class rate per education."""
    df = featured(spark, sf)
    t = F.col(FE.TARGET)
    return df.groupBy("education").agg(
        F.count(F.lit(1)).alias("n"), F.sum(t).cast("bigint").alias("defaults"),
        F.round(F.lit(100.0) * F.sum(t) / F.count(F.lit(1)), 6).alias("default_pct"),
        F.round(F.avg("total_months_late"), 6).alias("avg_months_late"),
        F.round(F.avg("utilization_rate"), 6).alias("avg_utilization"))


@query("scan_accounts", "SELECT * FROM accounts", ACC)
def scan_accounts(spark, sf):
    """The whole account table with its declared types."""
    return views.accounts(spark, sf)


_RAW = ["id", "limit_bal", "sex", "education", "marriage", "age"] + PAY + BILL + PAYAMT + [FE.TARGET]
# Expected columns as configured (includes a pay_1 the data lacks).
_EXPECTED = _RAW[:6] + ["pay_1"] + _RAW[6:]


def _schema_sql():
    parts = []
    for c in _EXPECTED:
        if c in _RAW:
            parts.append(f"SELECT '{c}' AS column_name, true AS present, CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
                         f"CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count FROM accounts")
        else:
            parts.append(f"SELECT '{c}' AS column_name, false AS present, CAST(NULL AS BIGINT) AS null_count, "
                         f"CAST(NULL AS BIGINT) AS distinct_count")
    return "\nUNION ALL ".join(parts)


@query("schema_missing", _schema_sql(), ACC)
def schema_missing(spark, sf):
    """Presence, null and distinct counts of every expected column."""
    return Q.schema_report(views.accounts(spark, sf), _EXPECTED)


# Declared types of the account table (fixed values: integer everywhere except the limit).
_DECLARED = {c: ("double" if c == "limit_bal" else ("int" if c == FE.TARGET else "bigint")) for c in _RAW}


def _dtype_sql():
    parts = []
    for c in _RAW:
        want = _DECLARED[c]
        actual = (f"(SELECT CASE any_value(typeof({c})) WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' "
                  f"WHEN 'DOUBLE' THEN 'double' ELSE lower(any_value(typeof({c}))) END FROM accounts)")
        bad = (f"(SELECT CAST(count(*) FILTER (WHERE {c} IS NOT NULL AND {c} <> floor({c})) AS BIGINT) FROM accounts)"
               if want in ("int", "bigint") else "CAST(0 AS BIGINT)")
        parts.append(f"SELECT '{c}' AS column_name, '{want}' AS declared, a AS actual, a = '{want}' AS type_ok, "
                     f"CASE WHEN a IN ('double', 'float') THEN {bad} ELSE CAST(0 AS BIGINT) END AS bad_values "
                     f"FROM (SELECT {actual} AS a)")
    return "\nUNION ALL ".join(parts)


@query("dtype_mismatch", _dtype_sql(), ACC)
def dtype_mismatch(spark, sf):
    """Declared versus actual type, and values that do not fit the declared type."""
    return Q.dtype_report(views.accounts(spark, sf), _DECLARED)


@query("recode_categories", """SELECT id,
  CASE WHEN education IN (5, 6, 0) THEN 4 ELSE education END AS education,
  CASE WHEN marriage IN (0) THEN 3 ELSE marriage END AS marriage FROM accounts""", ACC)
def recode_categories(spark, sf):
    return Q.recode_categories(views.accounts(spark, sf)).select("id", "education", "marriage")


@query("clip_pay", "SELECT id, " + ", ".join(
    f"CASE WHEN {p} IS NULL THEN NULL ELSE least(9, greatest(-1, {p})) END AS {p}" for p in PAY)
    + " FROM accounts", ACC)
def clip_pay(spark, sf):
    return Q.clip_pay(views.accounts(spark, sf)).select("id", *PAY)


_ONE_HOT = {"sex": [1, 2], "education": [1, 2, 3, 4], "marriage": [1, 2, 3]}


@query("one_hot", "WITH r AS (SELECT id, sex, CASE WHEN education IN (5, 6, 0) THEN 4 ELSE education END AS education, "
       "CASE WHEN marriage IN (0) THEN 3 ELSE marriage END AS marriage FROM accounts)\nSELECT id, "
       + ", ".join(f"CASE WHEN {c} = {v} THEN 1 ELSE 0 END AS {c}_{v}" for c, vs in _ONE_HOT.items() for v in vs)
       + " FROM r", ACC)
def one_hot(spark, sf):
    """Indicator columns over the recoded categorical domains."""
    df = Q.recode_categories(views.accounts(spark, sf)).select("id", *_ONE_HOT)
    for c, vs in _ONE_HOT.items():
        df = Q.one_hot(df, c, vs)
    return df.drop(*_ONE_HOT)


@query("missing_report", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS null_count FROM accounts" for c in _RAW), ACC)
def missing_report(spark, sf):
    """M1: null count per column (a column is 'missing' when the count is above 0)."""
    return Q.missing_report(views.accounts(spark, sf))


@query("impute_zero", "SELECT id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in BILL + PAYAMT) + " FROM accounts", ACC)
def impute_zero(spark, sf):
    return Q.impute_zero(views.accounts(spark, sf)).select("id", *BILL, *PAYAMT)


@query("impute_median", f"{CLEAN_CHAIN}\nSELECT id, age, limit_bal FROM clean", ACC)
def impute_median(spark, sf):
    return clean(spark, sf).select("id", "age", "limit_bal")


@query("impute_mode", f"{CLEAN_CHAIN}\nSELECT id, {', '.join(PAY)} FROM clean", ACC)
def impute_mode(spark, sf):
    return clean(spark, sf).select("id", *PAY)


@query("clean_accounts", f"{CLEAN_CHAIN}\nSELECT * FROM clean", ACC)
def clean_accounts(spark, sf):
    """P1, P8, P9, M2, M3, M4 chained."""
    return clean(spark, sf)


@query("engineer_features", f"{FEATURE_CHAIN}\nSELECT id, total_months_late, round(utilization_rate, 9) AS utilization_rate FROM feat", ACC)
def engineer_features(spark, sf):
    """F1 total_months_late, F2 utilization_rate (null on a zero limit)."""
    return featured(spark, sf).select("id", "total_months_late", F.round("utilization_rate", 9).alias("utilization_rate"))


_LI_KEYS = ["l_orderkey", "l_linenumber"]
_LI_REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus", "l_shipdate"]


@query("dedupe_keep_first", f"""SELECT {", ".join(_LI_KEYS + _LI_REST)} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY {", ".join(c + " ASC NULLS FIRST" for c in _LI_REST)}) AS rn FROM lineitem) WHERE rn = 1""")
def dedupe_keep_first(spark, sf):
    """One lineitem per (order, line), first under the order of all other columns."""
    li = tables.table(spark, sf, "lineitem").select(*_LI_KEYS, *_LI_REST)
    return Q.dedupe_keep_first(li, _LI_KEYS, _LI_REST)


@query("duplicate_count", """SELECT CAST(count(*) AS BIGINT) AS row_count,
  CAST((SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS BIGINT) AS distinct_keys,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS BIGINT) AS duplicate_rows
FROM lineitem""")
def duplicate_count(spark, sf):
    """Surplus rows by key."""
    return Q.duplicate_count(tables.table(spark, sf, "lineitem"), _LI_KEYS)


@query("duplicate_sample", """SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 ORDER BY l_orderkey, l_linenumber LIMIT 5""")
def duplicate_sample(spark, sf):
    """D3: first five keys that occur more than once (a top-k report)."""
    return Q.duplicate_sample(tables.table(spark, sf, "lineitem"), _LI_KEYS)


@query("class_balance", """SELECT default_payment_next_month, count(*) AS n,
  round(CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER (), 6) AS pct
FROM accounts GROUP BY default_payment_next_month""", ACC)
def class_balance(spark, sf):
    """A1: class share in percent."""
    return FE.class_balance(views.accounts(spark, sf))


@query("imbalance_flag", """WITH p AS (SELECT CAST(count(*) AS DOUBLE) AS n
  FROM accounts GROUP BY default_payment_next_month)
SELECT round(max(n) / min(n), 6) AS imbalance_ratio, count(*) AS n_classes,
  round(max(n) / min(n), 6) > 1.1 AS is_imbalanced FROM p""", ACC)
def imbalance_flag(spark, sf):
    """A2: imbalance ratio and flag (ratio > 1.1)."""
    return FE.imbalance(views.accounts(spark, sf))


@query("label_domain", "SELECT DISTINCT label FROM pred_probs WHERE label IS NOT NULL", ("pred_probs",))
def label_domain(spark, sf):
    """A5: label values present (the fit raises below two)."""
    pp = views.pred_probs(spark, sf)
    FE.require_two_labels(pp)
    return FE.label_domain(pp)


@query("zscore_fit", f"""{FEATURE_CHAIN},
{ZFIT}
SELECT column_name, round(mean, 6) AS mean, round(std, 6) AS std FROM zfit""", ACC)
def zscore_fit(spark, sf):
    """A3: mean and sample std per scaled column."""
    p = FE.zscore_fit(featured(spark, sf))
    return p.select("column_name", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("zscore_transform", f"""{FEATURE_CHAIN},
{ZFIT}
SELECT id, {", ".join(f"round(({c} - (SELECT mean FROM zfit WHERE column_name = '{c}')) / "
                      f"nullif((SELECT std FROM zfit WHERE column_name = '{c}'), 0), 6) AS {c}" for c in SCALED)}
FROM feat""", ACC)
def zscore_transform(spark, sf):
    """A4: z-scaled features (parameters fitted on all rows; the reference's setting)."""
    df = featured(spark, sf)
    scaled = FE.zscore_transform(df, FE.zscore_fit(df))
    return scaled.select("id", *[F.round(c, 6).alias(c) for c in SCALED])


def _split_expr(id_col="id"):
    return hash_fraction_key(id_col) % 1000


@query("train_val_split", """SELECT id, CASE WHEN """ + "(CAST(('0x' || substr(sha256(CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) % 1000)"
       + """ < 125 THEN 'val' ELSE 'train' END AS split FROM accounts""", ACC)
def train_val_split(spark, sf):
    """87.5 / 12.5 split by hash of the id (stable under repartitioning)."""
    acc = views.accounts(spark, sf)
    return acc.select("id", F.when(_split_expr() < 125, "val").otherwise("train").alias("split"))


@query("three_way_split", """SELECT id, CASE WHEN h < 800 THEN 'train' WHEN h < 900 THEN 'val' ELSE 'test' END AS split
FROM (SELECT id, (CAST(('0x' || substr(sha256(CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) % 1000) AS h FROM accounts)""", ACC)
def three_way_split(spark, sf):
    """80 / 10 / 10 split by the same hash."""
    h = _split_expr()
    acc = views.accounts(spark, sf)
    return acc.select("id", F.when(h < 800, "train").when(h < 900, "val").otherwise("test").alias("split"))


@query("dataset_profile", """SELECT split_group, count(*) AS row_count, 25 AS col_count FROM (
  SELECT CASE WHEN (CAST(('0x' || substr(sha256(CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) % 1000) < 125
    THEN 'val' ELSE 'train' END AS split_group FROM accounts) GROUP BY split_group""", ACC)
def dataset_profile(spark, sf):
    """Rows and columns per split group (each row counted once)."""
    acc = views.accounts(spark, sf)
    tagged = acc.withColumn("split", F.when(_split_expr() < 125, "val").otherwise("train"))
    return FE.dataset_profile(tagged).select("split_group", "row_count", F.col("col_count").cast("int").alias("col_count"))
