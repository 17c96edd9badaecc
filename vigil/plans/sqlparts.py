"""Reusable SQL fragments for the DuckDB oracle (account cleaning chain)."""

from __future__ import annotations

PAY = ["pay_0", "pay_2", "pay_3", "pay_4", "pay_5", "pay_6"]
BILL = [f"bill_amt{i}" for i in range(1, 7)]
PAYAMT = [f"pay_amt{i}" for i in range(1, 7)]
SCALED = ["limit_bal", "age"] + PAY + BILL + PAYAMT + ["utilization_rate", "total_months_late"]


def _j(parts, sep=",\n  "):
    return sep.join(parts)


# rec: P8 recode, P9 clip, M2 zero fill.
REC = f"""rec AS (
  SELECT id, limit_bal, sex,
  CASE WHEN education IN (5, 6, 0) THEN 4 ELSE education END AS education,
  CASE WHEN marriage IN (0) THEN 3 ELSE marriage END AS marriage,
  age,
  {_j(f"CASE WHEN {p} IS NULL THEN NULL ELSE least(9, greatest(-1, {p})) END AS {p}" for p in PAY)},
  {_j(f"coalesce({c}, 0) AS {c}" for c in BILL + PAYAMT)},
  default_payment_next_month
  FROM accounts)"""

# M3 medians and M4 modes (tie -> smallest value).
IMPUTE = f"""med AS (SELECT median(age) AS m_age, median(limit_bal) AS m_limit_bal FROM rec),
mode_counts AS (
  SELECT col, val, count(*) AS n
  FROM (UNPIVOT (SELECT {", ".join(PAY)} FROM rec) ON {", ".join(PAY)} INTO NAME col VALUE val)
  GROUP BY col, val),
modes AS (
  SELECT {", ".join(f"max(CASE WHEN col = '{p}' THEN val END) AS m_{p}" for p in PAY)}
  FROM (SELECT col, val, row_number() OVER (PARTITION BY col ORDER BY n DESC, val ASC) AS rn FROM mode_counts)
  WHERE rn = 1),
clean AS (
  SELECT id, coalesce(CAST(limit_bal AS DOUBLE), m_limit_bal) AS limit_bal, sex, education, marriage,
  coalesce(CAST(age AS DOUBLE), m_age) AS age,
  {_j(f"coalesce({p}, m_{p}) AS {p}" for p in PAY)},
  {", ".join(BILL + PAYAMT)},
  default_payment_next_month
  FROM rec CROSS JOIN med CROSS JOIN modes)"""

# F1 + F2 over the cleaned rows.
FEAT = f"""feat AS (
  SELECT *,
  {" + ".join(f"(CASE WHEN {p} > 0 THEN 1 ELSE 0 END)" for p in PAY)} AS total_months_late,
  CASE WHEN limit_bal = 0 THEN NULL ELSE CAST(bill_amt1 AS DOUBLE) / limit_bal END AS utilization_rate
  FROM clean)"""

CLEAN_CHAIN = f"WITH {REC},\n{IMPUTE}"
FEATURE_CHAIN = f"WITH {REC},\n{IMPUTE},\n{FEAT}"

# A3 over feat: one row per scaled column.
ZFIT = "zfit AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS column_name, avg({c}) AS mean, stddev_samp({c}) AS std FROM feat" for c in SCALED) + ")"


def hash_bucket(expr: str, modulus: int = 1000) -> str:
    """Integer from the first 8 hex digits of sha256(text), modulo ``modulus``."""
    return f"(CAST(('0x' || substr(sha256(CAST({expr} AS VARCHAR)), 1, 8)) AS BIGINT) % {modulus})"
