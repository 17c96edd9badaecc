"""Data assurance: schema checks, recoding, clipping, missing values, de-duplication.

Every function is ``DataFrame -> DataFrame`` with explicit parameters.
Imputers follow the fit/transform split: the fitted values are scalars (one
per column), so they are bounded no matter how large the table is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip_keep_null, recode
from .stats import exact_medians

# Recoding rules of the categorical columns (fixed values).
EDUCATION_RECODE = {5: 4, 6: 4, 0: 4}
MARRIAGE_RECODE = {0: 3}
# Valid repayment-status range.
PAY_CLIP = (-1, 9)
PAY_CLIP_COLUMNS = ["pay_0", "pay_1", "pay_2", "pay_3", "pay_4", "pay_5", "pay_6"]
PAY_STATUS_COLUMNS = ["pay_0", "pay_2", "pay_3", "pay_4", "pay_5", "pay_6"]
ZERO_FILL_PREFIXES = ("bill_amt", "pay_amt")
MEDIAN_FILL_COLUMNS = ["age", "limit_bal"]


def present(df: DataFrame, names) -> list[str]:
    """The listed columns that exist (case-insensitive), in df's spelling."""
    lower = {c.lower(): c for c in df.columns}
    return [lower[n.lower()] for n in names if n.lower() in lower]


def trim_columns(df: DataFrame) -> DataFrame:
    """Strip whitespace from column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def missing_columns(df: DataFrame, expected) -> list[str]:
    """Expected minus actual column names (order of ``expected``)."""
    have = {c.lower() for c in df.columns}
    return [c for c in expected if c.lower() not in have]


def require_columns(df: DataFrame, expected) -> None:
    """P2 (raise form): the model side refuses a frame lacking a feature."""
    missing = missing_columns(df, expected)
    if missing:
        raise ValueError(f"missing columns: {missing}")


def schema_report(df: DataFrame, expected) -> DataFrame:
    """P2 (table form): per expected column, presence, null and distinct counts.

    Nulls are counted in place. Distinct values are counted as (column number, 128-bit hash of the typed value), with
    partial aggregation, so at most one small row per distinct value of a map task is shuffled and no cell becomes text.
    """
    spark = df.sparkSession
    have = present(df, expected)
    rows = [(c, c.lower() in {h.lower() for h in have}) for c in expected]
    flags = spark.createDataFrame(rows, "column_name string, present boolean")
    if have:
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(have)])
        nulls = nulls.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c.lower()).alias("column_name"), F.col(f"n{i}").alias("null_count")) for i, c in enumerate(have)])).alias("p")).select("p.*")
        cells = df.select(F.explode(F.array(*[
            F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("i"), F.xxhash64(c).alias("a"), F.xxhash64(F.lit(i), F.lit("b"), c).alias("b"))) for i, c in enumerate(have)
        ])).alias("p")).where(F.col("p").isNotNull()).select("p.*")
        distinct = cells.groupBy("i", "a", "b").agg(F.lit(1)).groupBy("i").agg(F.count(F.lit(1)).alias("distinct_count"))
        # One row per column on both sides.
        stats = nulls.join(F.broadcast(distinct), "i", "left").select("column_name", F.col("null_count").cast("bigint").alias("null_count"), F.coalesce("distinct_count", F.lit(0)).cast("bigint").alias("distinct_count"))
    else:
        stats = spark.createDataFrame([], "column_name string, null_count bigint, distinct_count bigint")
    # Both sides have one row per expected column, so the broadcast is bounded.
    flags = flags.withColumn("key", F.lower("column_name"))
    return (flags.join(F.broadcast(stats.withColumnRenamed("column_name", "key")), "key", "left")
            .select("column_name", "present", "null_count", "distinct_count"))


def dtype_report(df: DataFrame, declared: dict) -> DataFrame:
    """Declared versus actual type, and how many values do not fit the declared type.

    An integer declaration is broken by any non-integral value; a floating
    declaration accepts every number; a string column is tested with try_cast.
    """
    spark = df.sparkSession
    types = {c.lower(): t for c, t in df.dtypes}
    names = {c.lower(): c for c in df.columns}
    checks, meta = [], []
    for column, want in declared.items():
        key = column.lower()
        if key not in types:
            continue
        actual = types[key]
        x = F.col(names[key])
        if want in ("bigint", "int") and actual in ("double", "float"):
            bad = F.count_if(x.isNotNull() & (x != F.floor(x)))
        elif actual == "string":
            bad = F.count_if(x.isNotNull() & x.try_cast(want).isNull())
        else:
            bad = F.lit(0).cast("bigint")
        checks.append(bad.cast("bigint").alias(key))
        meta.append((key, want, actual))
    counts = df.agg(*checks) if checks else None
    m = spark.createDataFrame(meta, "column_name string, declared string, actual string")
    if counts is None:
        return m.withColumn("type_ok", F.lit(True)).withColumn("bad_values", F.lit(0).cast("bigint"))
    long = counts.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("column_name"), F.col(k).alias("bad_values")) for k, _, _ in meta])).alias("r")).select("r.*")
    return (m.join(long, "column_name")
            .withColumn("type_ok", F.col("declared") == F.col("actual"))
            .select("column_name", "declared", "actual", "type_ok", "bad_values"))


def recode_categories(df: DataFrame, education="education", marriage="marriage") -> DataFrame:
    """EDUCATION {5,6,0} -> 4, MARRIAGE {0} -> 3."""
    out = df
    for name, rule in ((education, EDUCATION_RECODE), (marriage, MARRIAGE_RECODE)):
        for c in present(out, [name]):
            out = out.withColumn(c, recode(c, rule))
    return out


def clip_pay(df: DataFrame, columns=PAY_CLIP_COLUMNS, bounds=PAY_CLIP) -> DataFrame:
    """Repayment-status columns that exist, clipped to bounds; null stays null."""
    lo, hi = bounds
    cols = present(df, columns)
    return df.withColumns({c: clip_keep_null(c, lo, hi).cast(dict(df.dtypes)[c]) for c in cols}) if cols else df


def one_hot(df: DataFrame, column: str, values) -> DataFrame:
    """One indicator column per value of a fixed domain, named COL_value."""
    x = F.col(column)
    return df.withColumns({f"{column}_{v}": F.when(x == F.lit(v), 1).otherwise(0) for v in values})


def missing_report(df: DataFrame, columns=None) -> DataFrame:
    """M1: null count of every column in one pass, long form (column, null_count)."""
    cols = columns or df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("bigint").alias("null_count")) for c in cols
    ])).alias("r")).select("r.column_name", "r.null_count")


def zero_fill_columns(df: DataFrame, prefixes=ZERO_FILL_PREFIXES) -> list[str]:
    return [c for c in df.columns if c.lower().startswith(prefixes)]


def impute_zero(df: DataFrame, columns=None) -> DataFrame:
    """M2: null billing / payment amounts -> 0."""
    cols = columns if columns is not None else zero_fill_columns(df)
    return df.fillna(0, subset=cols) if cols else df


def fit_median(df: DataFrame, columns=MEDIAN_FILL_COLUMNS) -> dict:
    """M3 fit: exact median per column (bounded-memory selection, all columns in the same scans)."""
    cols = present(df, columns)
    return exact_medians(df, cols) if cols else {}


def fit_mode(df: DataFrame, columns=PAY_STATUS_COLUMNS) -> dict:
    """M4 fit: most frequent value per column, smallest on ties.

    Values are counted per (column, value) with map-side partial aggregation;
    only one row per distinct value per column reaches the final step.
    """
    cols = present(df, columns)
    if not cols:
        return {}
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("p")).select("p.*").where(F.col("value").isNotNull())
    counts = pairs.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column_name").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    return {r["column_name"]: r["mode"] for r in best.collect()}


def fill_values(df: DataFrame, fills: dict, keep_type: bool = False) -> DataFrame:
    """Apply fitted fill values.

    ``keep_type`` keeps the column type (a mode of integer codes is an
    integer code); otherwise the column becomes double, as a median is.
    """
    types = dict(df.dtypes)
    exprs = {}
    for c, v in fills.items():
        if v is None:
            continue
        if keep_type:
            exprs[c] = F.coalesce(F.col(c), F.lit(v).cast(types[c]))
        else:
            exprs[c] = F.coalesce(F.col(c).cast("double"), F.lit(float(v)))
    return df.withColumns(exprs) if exprs else df


def impute_median(df: DataFrame, columns=MEDIAN_FILL_COLUMNS) -> DataFrame:
    """M3: AGE, LIMIT_BAL null -> exact median."""
    return fill_values(df, fit_median(df, columns))


def impute_mode(df: DataFrame, columns=PAY_STATUS_COLUMNS) -> DataFrame:
    """M4: repayment status null -> most frequent value (smallest on ties)."""
    return fill_values(df, fit_mode(df, columns), keep_type=True)


def impute_missing(df: DataFrame) -> DataFrame:
    """M2 + M3 + M4 in the reference's order.

    The fits scan the input several times (counts, medians, modes), so the
    input is persisted (memory, spilling to disk) while they run.
    """
    from pyspark import StorageLevel
    base = impute_zero(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fills, modes = fit_median(base), fit_mode(base)
    finally:
        base.unpersist()
    return fill_values(fill_values(base, fills), modes, keep_type=True)


def dedupe_keep_first(df: DataFrame, keys, order=None) -> DataFrame:
    """One row per key, the first under an explicit order.

    Written as a min over a struct of (order columns, remaining columns):
    a hash aggregate with map-side combine, so a key holding a third of the
    table is reduced to one row per map task before the shuffle.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys]
    order = list(order) if order else rest
    tail = [c for c in rest if c not in order]
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                      *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tail)])
    first = df.groupBy(*keys).agg(F.min(packed).alias("_r"))
    names = {f"_o{i}": c for i, c in enumerate(order)}
    names.update({f"_t{i}": c for i, c in enumerate(tail)})
    return first.select(*keys, *[F.col(f"_r.{k}").alias(v) for k, v in names.items()]).select(*df.columns)


def duplicate_count(df: DataFrame, keys) -> DataFrame:
    """Rows, distinct keys and surplus rows."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").cast("bigint").alias("row_count"),
                       F.count(F.lit(1)).alias("distinct_keys"),
                       (F.sum("n") - F.count(F.lit(1))).cast("bigint").alias("duplicate_rows"))


def duplicate_sample(df: DataFrame, keys, n: int = 5) -> DataFrame:
    """D3: the first ``n`` keys (in key order) occurring more than once."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))
    return per_key.where(F.col("occurrences") > 1).orderBy(*keys).limit(n)
