"""Column expressions (JVM-side, codegen-friendly) used across operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip_keep_null(c, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]; a null stays null (bare least/greatest would not)."""
    x = col(c)
    return F.when(x.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), x)))


def recode(c, mapping: dict) -> Column:
    """Replace listed codes, keep everything else."""
    x = col(c)
    expr = None
    for new in sorted(set(mapping.values())):
        olds = [k for k, v in mapping.items() if v == new]
        cond = x.isin(*olds)
        expr = F.when(cond, F.lit(new)) if expr is None else expr.when(cond, F.lit(new))
    return expr.otherwise(x) if expr is not None else x


def count_positive(cols) -> Column:
    """number of columns holding a value > 0; null counts as 0."""
    terms = [F.coalesce((col(c) > 0).cast("int"), F.lit(0)) for c in cols]
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0)


def safe_ratio(num, den) -> Column:
    """num / den, null when den is 0 (ANSI division would raise)."""
    return F.try_divide(col(num), col(den))


def sha256_hex(c) -> Column:
    """lower-case hex SHA-256 of a string or binary column."""
    return F.sha2(col(c), 256)


NULL_TOKEN = "\\N"


def canonical_value(c, dtype: str, scale: int = 6) -> Column:
    """F4 cell: a serialisation that two engines agree on.

    Doubles go through a fixed-scale decimal (never straight to string);
    nulls become an explicit token.
    """
    x = col(c)
    if dtype in ("double", "float"):
        s = x.cast(f"decimal(38,{scale})").cast("string")
    elif dtype == "boolean":
        s = F.when(x, F.lit("true")).when(~x, F.lit("false"))
    else:
        s = x.cast("string")
    return F.coalesce(s, F.lit(NULL_TOKEN))


def canonical_row(df, columns=None, scale: int = 6) -> Column:
    """one stable string per row, columns in name order, '|'-separated."""
    types = dict(df.dtypes)
    names = sorted(columns or df.columns)
    return F.concat_ws("|", *[canonical_value(n, types[n], scale) for n in names])


def row_hash(df, columns=None, scale: int = 6) -> Column:
    """SHA-256 of the canonical row."""
    return F.sha2(canonical_row(df, columns, scale), 256)


def plain_number(c, scale: int = 6) -> Column:
    """Number as text without trailing zeros (0.5 -> '0.5', 1.0 -> '1')."""
    s = col(c).cast(f"decimal(38,{scale})").cast("string")
    return F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))


def escalation_id(txn, ts) -> Column:
    """ESC-{txn}-{yyyyMMddHHmmss}, time taken from the row."""
    return F.concat(F.lit("ESC-"), col(txn), F.lit("-"), F.date_format(col(ts), "yyyyMMddHHmmss"))


# Influence bands of an attribution value (fixed values; asymmetric on purpose).
STRONG_POSITIVE = 0.15
MODERATE_POSITIVE = 0.07
STRONG_NEGATIVE = -0.10
MODERATE_NEGATIVE = -0.05


def influence_bucket(v) -> Column:
    """strength label of an attribution value."""
    x = col(v)
    return (F.when(x > STRONG_POSITIVE, "strong_positive")
            .when(x > MODERATE_POSITIVE, "moderate_positive")
            .when(x < STRONG_NEGATIVE, "strong_negative")
            .when(x < MODERATE_NEGATIVE, "moderate_negative")
            .otherwise("weak"))


def hash_fraction_key(c, digits: int = 8) -> Column:
    """Stable integer in [0, 16**digits) from sha2 of a key (X1..X4)."""
    return F.conv(F.substring(F.sha2(col(c).cast("string"), 256), 1, digits), 16, 10).cast("bigint")


def coalesce_key(a, b) -> Column:
    """F8: `a or b` — empty string counts as missing."""
    return F.coalesce(F.nullif(col(a), F.lit("")), col(b))
