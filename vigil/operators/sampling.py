"""Deterministic splitting, folds, sampling and class balancing.

Randomness comes from SHA-256 of the row key, so every result is stable
under repartitioning and recomputation. Ranks inside a class use the
range-partitioned ranking of ``ranking.rank_in_groups`` (no task holds a
whole class).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_fraction_key
from ..session import written
from .ranking import rank_in_groups


def hash_order(key="id") -> list:
    """Row order used for 'shuffled' operations: sha2 of the key, then the key."""
    return [F.sha2(F.col(key).cast("string"), 256), F.col(key)]


def hash_split(df: DataFrame, key="id", cuts=((125, "val"),), rest="train", col="split") -> DataFrame:
    """bucket = first 32 bits of sha2(key) mod 1000; cut points give the split names."""
    h = hash_fraction_key(key) % 1000
    expr = None
    for cut, name in cuts:
        expr = F.when(h < cut, name) if expr is None else expr.when(h < cut, name)
    return df.withColumn(col, expr.otherwise(rest))


def stratified_folds(df: DataFrame, label="label", key="id", k: int = 5, col="fold") -> DataFrame:
    """Within each label, rows in hash order are dealt to folds 0..k-1 in turn."""
    ranked = rank_in_groups(df, [label], hash_order(key), rank_col="_r")
    return ranked.withColumn(col, ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def sample_exact(df: DataFrame, percent: int, key="id", groups=()) -> DataFrame:
    """The first round-half-up(percent% of n) rows in hash order (per group when given).

    The quota is integer arithmetic, so no engine rounds 0.3 * n differently.
    """
    groups = list(groups)
    if groups:
        sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
        ranked = rank_in_groups(df, groups, hash_order(key), rank_col="_r")
        # One row per group: bounded by the number of groups.
        ranked = ranked.join(F.broadcast(sizes), groups)
    else:
        ranked = rank_in_groups(df.withColumn("_g", F.lit(0)), ["_g"], hash_order(key), rank_col="_r")
        ranked = ranked.withColumn("_n", F.lit(df.count())).drop("_g")
    quota = F.expr(f"(_n * {int(percent)} + 50) div 100")
    return ranked.where(F.col("_r") <= quota).drop("_r", "_n")


def class_counts(df: DataFrame, target: str) -> dict:
    """Rows per class; one row per class, so bounded."""
    return {r[0]: r[1] for r in df.groupBy(target).count().collect()}


#: Copies that one row makes in one task at most.
COPY_BLOCK = 1000


def repeat_rows(df: DataFrame, copies, most: int, out: str = "copy") -> DataFrame:
    """Each row ``copies`` times (none for 0), numbered from 1 in ``out``; ``most`` is the largest number of copies.

    A row with many copies first becomes blocks of COPY_BLOCK numbers, which are dealt out over the tasks, and only
    there the copies themselves.
    """
    counted = df.withColumn("_copies", copies).where(F.col("_copies") > 0)
    if most <= COPY_BLOCK:
        return counted.withColumn(out, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies").cast("bigint")))).drop("_copies")
    blocks = counted.withColumn("_block", F.explode(F.expr(f"sequence(0L, (_copies - 1) div {COPY_BLOCK})")))
    dealt = blocks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*[F.col(c) for c in df.columns], "_block"))
    first = F.col("_block") * COPY_BLOCK
    return dealt.withColumn(out, F.explode(F.sequence(first + 1, F.least(first + COPY_BLOCK, F.col("_copies").cast("bigint"))))).drop("_copies", "_block")


def upsample(df: DataFrame, target: str, key="id") -> DataFrame:
    """Duplicate minority rows (round-robin in hash order) until classes are equal.

    Adds ``copy`` (1-based) so every output row stays identifiable.
    """
    counts = class_counts(df, target)
    major = max(counts, key=lambda c: (counts[c], c))
    n_major = counts[major]
    parts = [df.where(F.col(target) == F.lit(major)).withColumn("copy", F.lit(1).cast("bigint"))]
    for cls, n in counts.items():
        if cls == major:
            continue
        sub = df.where(F.col(target) == F.lit(cls))
        ranked = rank_in_groups(sub, [target], hash_order(key), rank_col="_r")
        base, extra = divmod(n_major, n)
        copies = F.lit(base).cast("bigint") + F.when(F.col("_r") <= extra, 1).otherwise(0)
        parts.append(repeat_rows(ranked, copies, base + 1).drop("_r"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def downsample(df: DataFrame, target: str, key="id") -> DataFrame:
    """Keep the first n_minority rows of every class in hash order."""
    counts = class_counts(df, target)
    n_min = min(counts.values())
    ranked = rank_in_groups(df, [target], hash_order(key), rank_col="_r")
    return ranked.where(F.col("_r") <= n_min).drop("_r")


SMOTE_K = 5


def _unit_fraction(key_col, salt_col):
    """Deterministic number in [0, 1) from sha2(key-salt)."""
    h = F.sha2(F.concat(F.col(key_col).cast("string"), F.lit("-"), F.col(salt_col).cast("string")), 256)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(16 ** 8))


def smote(df: DataFrame, target: str, features, key: str = "id", k: int = SMOTE_K) -> DataFrame:
    """Oversample the minority class to parity by interpolating toward minority neighbours.

    Neighbours: exact k-NN among minority rows on ``features`` (the key and
    the target are not features). Base rows are taken round-robin in hash
    order; neighbour choice and gap come from sha2(key, copy), so the output
    is deterministic. Original rows keep their keys; synthetic rows get
    max(key) + 1, + 2, ... in (base rank, copy) order. Adds ``synthetic``.
    """
    from .neighbors import knn
    # Read by many steps below, so written once. Rows and largest key per class in one aggregate (one row per class).
    df = written(df, "rows")
    per_class = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("m")).collect()
    counts = {r[target]: r["n"] for r in per_class}
    max_id = max(r["m"] for r in per_class) if per_class else None
    if len(counts) < 2:
        return df.withColumn("synthetic", F.lit(False))
    minority = min(counts, key=lambda c: (counts[c], c))
    n_min, n_maj = counts[minority], max(counts.values())
    need = n_maj - n_min
    out = df.withColumn("synthetic", F.lit(False))
    if need == 0:
        return out
    minor = df.where(F.col(target) == F.lit(minority)).select(key, *features)
    kk = min(k, n_min - 1)
    if kk == 0:
        # A single minority row has no neighbour: its copies are the row itself.
        nn = minor.select(F.col(key).alias("query_id"), F.col(key).alias("neighbor_id"),
                          F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))
        kk = 1
    else:
        nn = knn(minor, minor, features, k, key, exclude_self=True)
    base = rank_in_groups(minor.withColumn("_g", F.lit(0)), ["_g"], hash_order(key), rank_col="_r").drop("_g")
    per, extra = divmod(need, n_min)
    copies = F.lit(per).cast("bigint") + F.when(F.col("_r") <= extra, 1).otherwise(0)
    reps = repeat_rows(base, copies, per + 1)
    reps = reps.withColumn("_nn_rank", (F.conv(F.substring(F.sha2(F.concat(F.col(key).cast("string"), F.lit("#"),
                                                                             F.col("copy").cast("string")), 256), 1, 8),
                                                16, 10).cast("bigint") % kk + 1).cast("int"))
    reps = reps.withColumn("_u", _unit_fraction(key, "copy"))
    pick = nn.select(F.col("query_id").alias(key), F.col("rank").alias("_nn_rank"), F.col("neighbor_id").alias("_nb"))
    nbr = minor.select(F.col(key).alias("_nb"), *[F.col(c).alias(f"_n_{c}") for c in features])
    joined = reps.join(pick, [key, "_nn_rank"]).join(nbr, "_nb")
    # Written, as the sampling of the range partitions below would run the neighbour search a second time.
    synth = written(joined.select(key, "_r", "copy", *[
        (F.col(c) + F.col("_u") * (F.col(f"_n_{c}") - F.col(c))).alias(c) for c in features]), "synthetic")
    numbered = rank_in_groups(synth.withColumn("_g", F.lit(0)), ["_g"], ["_r", "copy"], rank_col="_seq")
    new_rows = numbered.select((F.lit(max_id) + F.col("_seq")).alias(key), *features,
                               F.lit(minority).cast(df.schema[target].dataType).alias(target),
                               F.lit(True).alias("synthetic"))
    cols = [key, *features, target, "synthetic"]
    return out.select(*cols).unionByName(new_rows.select(*cols))
