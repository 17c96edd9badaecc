"""Exact k-nearest neighbours (Euclidean) over pivot cells, pruned by the triangle inequality.

Reference rows are dealt to the cell of their nearest pivot (a bounded sample of
the rows) and, within a cell, to rings of at most ``BLOCK`` rows by their
distance from it. Query rows are packed too, in blocks of about ``BLOCK`` rows
that share a home: the ring of their own cell that they would lie in. There
they meet first; a query's k-th distance there (or the bound that the cells'
least radii give, where that is lower) is how far it has to look. Then the
blocks of queries meet the other rings, block by block, in a cartesian product
of the two packed tables, without those that the triangle inequality rules out.

Both tables are written once and shuffled once; the product reads them again and
writes nothing but neighbours, so shuffled and written bytes grow with the rows,
whatever share of the pairs is left to compare. A task holds a few bounded
blocks. A final ``row_number() <= k`` per query (with a partial
WindowGroupLimit before its shuffle) merges the candidates. Row pairs are never
materialised.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .ranking import rank_in_groups

BLOCK = 16384
#: Pivots: one for about so many reference rows, and at most so many, as every task holds them.
ROWS_PER_PIVOT, MAX_PIVOTS = 16384, 4096
#: Queries and rows of a ring that are compared at a time, rings that a task of the product holds, bytes of an Arrow batch of blocks.
QUERIES, TILE, RINGS, BATCH_BYTES = 256, 2048, 8, 32 << 20
#: Relative room for rounding in the bounds; too much only costs time.
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the rows of a and b, summed feature by feature, so that equal differences give equal distances."""
    out = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        d = a[:, f][:, None] - b[:, f][None, :]
        out += d * d
    return np.sqrt(out)


def _points(df: DataFrame, key: str, features) -> DataFrame:
    """k and v, written once as every step reads them; rows with a null or NaN feature have no distance and are left out."""
    out = written(df.select(F.col(key).alias("k"), F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in features]).alias("v")), "points")
    return out.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


def _least_keys(points: DataFrame, n: int) -> DataFrame:
    """Of rows at the same point only the n least keys can be neighbours (a partial WindowGroupLimit runs before the shuffle)."""
    w = Window.partitionBy("v").orderBy("k")
    return points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def _matrix(column, width: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten(), dtype=float).reshape(-1, width)


def choose_pivots(refs: DataFrame, n: int) -> np.ndarray:
    """At most MAX_PIVOTS different rows, those of the least hash of the key."""
    wanted = min(MAX_PIVOTS, max(1, n // ROWS_PER_PIVOT))
    rows = refs.orderBy(F.xxhash64("k"), "k").limit(wanted).collect()
    return np.unique(np.array([r["v"] for r in rows], dtype=float), axis=0)


def assign(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """k, v, cell (nearest pivot, the first on ties) and radius (its distance)."""
    kind = T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())])
    width = pivots.shape[1]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                d = distances(_matrix(part.column("v"), width), pivots)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("v"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], names=["k", "v", "cell", "radius"])

    return points.mapInArrow(run, kind)


def _rings(assigned: DataFrame) -> DataFrame:
    """Packed blocks: cell, ring, the rows, least and greatest radius and count."""
    ranked = rank_in_groups(assigned, ["cell"], ["radius", "k"], rank_col="_r")
    ring = F.expr(f"cast((_r - 1) div {BLOCK} as int)")
    return ranked.groupBy("cell", ring.alias("ring")).agg(
        F.collect_list(F.struct("radius", "k", "v")).alias("rows"), F.min("radius").alias("least"), F.max("radius").alias("most"), F.count(F.lit(1)).alias("n"))


def _same(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where keys are (nulls too)."""
    both = pa.concat_arrays([left, right.cast(left.type)]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return both[:len(left)], both[len(left):]


def _nearest(points: np.ndarray, keys: pa.Array, far: np.ndarray, refs: np.ndarray, ref_keys: pa.Array, k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, ref, distance): for each query the k nearest refs, ties by key, as far as ``far``.

    Squared distances by a matrix product, with room for its rounding, choose the candidates; their distances are exact.
    """
    place = pc.rank(ref_keys, "ascending", null_placement="at_start", tiebreaker="first").to_numpy()
    own, other = _same(keys, ref_keys) if exclude_self else (None, None)
    wanted = k + (1 if exclude_self else 0)  # a query may meet itself among the nearest
    found = []
    with np.errstate(over="ignore", invalid="ignore"):
        middle = refs.mean(axis=0)
        middle[~np.isfinite(middle)] = 0.0
        shifted = refs - middle
        norms = (shifted * shifted).sum(axis=1)
        odd = ~np.isfinite(norms)  # too large for the product: always candidates
        most = norms[~odd].max(initial=0.0)
        right = np.column_stack([shifted, np.ones(len(refs)), norms])
        for lo in range(0, len(points), QUERIES):
            p = points[lo:lo + QUERIES]
            q = p - middle
            n = (q * q).sum(axis=1)
            left, room = np.column_stack([-2.0 * q, n, np.ones(len(p))]), SLACK * 1e-3 * (n + most)
            plain = np.isfinite(n).all() and not odd.any()
            limit = (far[lo:lo + QUERIES] * (1 + SLACK)) ** 2 + room
            rows, ats, values = [], [], []
            for start in range(0, len(refs), TILE):
                near = left @ right[start:start + TILE].T
                if not plain:
                    near[~np.isfinite(near)] = -np.inf
                hit = np.flatnonzero((near <= limit[:, None]).reshape(-1))
                if len(hit) > 4 * wanted * len(p) and near.shape[1] >= wanted:  # the limit is loose: the nearest of this tile lower it
                    nth = near.min(axis=1) if wanted == 1 else np.partition(near, wanted - 1, axis=1)[:, wanted - 1]
                    limit = np.fmin(limit, np.where(np.isfinite(nth), nth + 2 * room, np.inf))
                    hit = np.flatnonzero((near <= limit[:, None]).reshape(-1))
                row, at = np.divmod(hit, near.shape[1])
                rows.append(row)
                ats.append(at + start)
                values.append(near.reshape(-1)[hit])
            row, at, value = (np.concatenate(x) for x in (rows, ats, values))
            order = np.lexsort((value, row))
            row, at, value = row[order], at[order], value[order]
            first, last = np.searchsorted(row, np.arange(len(p))), np.searchsorted(row, np.arange(len(p)), "right")
            full = last - first >= wanted
            bound = np.full(len(p), np.inf)
            bound[full] = value[first[full] + wanted - 1] + 2 * room[full]
            bound[~np.isfinite(bound)] = np.inf
            keep = value <= bound[row]
            row, at = row[keep], at[keep]
            d = np.zeros(len(row))
            for f in range(points.shape[1]):
                step = p[row, f] - refs[at, f]
                d += step * step
            d = np.sqrt(d)
            real = np.isfinite(d)
            if exclude_self:
                real &= own[lo + row] != other[at]
            row, at, d = row[real], at[real], d[real]
            order = np.lexsort((place[at], d, row))
            row, at, d = row[order], at[order], d[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append((row[best] + lo, at[best], d[best]))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _seen(far: np.ndarray, row: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """far, lowered to the k-th distance where a query (row, ascending) has k."""
    out, at = far.copy(), np.arange(len(row)) - np.searchsorted(row, row) == k - 1
    out[row[at]] = np.minimum(out[row[at]], d[at])
    return out


def _homes(queries: DataFrame, rings: DataFrame, key_type, pivots: np.ndarray, cells: dict, k: int, exclude_self: bool) -> DataFrame:
    """Blocks of queries of one home (q_cell, q_ring): queries (k, v, far to look), found in the home ring, widest radius, greatest far."""
    # one row per ring: chunks of its queries; each chunk gets a copy of the ring
    chunks = queries.groupBy("cell", "ring").agg(F.expr(f"cast(ceil(count(1) / {BLOCK}) as int)").alias("chunks"))
    left = queries.join(chunks, ["cell", "ring"]).withColumn("chunk", F.pmod(F.xxhash64("k"), "chunks").cast("int"))
    right = rings.select("cell", "ring", "rows").join(chunks, ["cell", "ring"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = right.select(F.col("cell").alias("r_cell"), F.col("ring").alias("r_ring"), F.col("chunk").alias("r_chunk"), "rows")
    width, ids, spare = pivots.shape[1], np.array(sorted(cells), np.int32), 1 if exclude_self else 0
    least = np.full((len(ids), k + spare), np.inf)
    for at, i in enumerate(ids):
        least[at, :len(cells[i]["near"])] = cells[i]["near"]
    point = T.StructType([T.StructField("k", key_type), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("far", T.DoubleType())])
    pair = T.StructType([T.StructField("query_id", key_type), T.StructField("neighbor_id", key_type), T.StructField("distance", T.DoubleType())])
    kind = T.StructType([T.StructField("q_cell", T.IntegerType()), T.StructField("q_ring", T.IntegerType()), T.StructField("q_radius", T.DoubleType()), T.StructField("q_far", T.DoubleType()),
                         T.StructField("queries", T.ArrayType(point)), T.StructField("found", T.ArrayType(pair))])

    def meet(mine: pa.Table, ring: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return pa.table({"q_cell": pa.array([], pa.int32()), "q_ring": pa.array([], pa.int32()), "q_radius": pa.array([], pa.float64()), "q_far": pa.array([], pa.float64()),
                             "queries": pa.array([], pa.list_(pa.struct([("k", mine.schema.field("k").type), ("v", pa.list_(pa.float64())), ("far", pa.float64())]))),
                             "found": pa.array([], pa.list_(pa.struct([("query_id", mine.schema.field("k").type), ("neighbor_id", mine.schema.field("k").type), ("distance", pa.float64())])))})
        keys, v = mine.column("k").combine_chunks(), mine.column("v").combine_chunks()
        points = _matrix(v, width)
        far = np.empty(len(points))
        for lo in range(0, len(points), QUERIES):
            # the k rows nearest to each pivot are no farther than by way of it
            by_way = distances(points[lo:lo + QUERIES], pivots[ids])[:, :, None] + least[None]
            far[lo:lo + QUERIES] = np.partition(by_way.reshape(len(by_way), -1), k + spare - 1, axis=1)[:, k + spare - 1]
        far *= 1 + SLACK
        if ring.num_rows:
            rows = ring.column("rows").combine_chunks().flatten()
            row, at, d = _nearest(points, keys, far, _matrix(rows.field("v"), width), rows.field("k"), k, exclude_self)
            far = _seen(far, row, d, k)
            pairs = pa.StructArray.from_arrays([keys.take(pa.array(row)), rows.field("k").take(pa.array(at)), pa.array(d)], ["query_id", "neighbor_id", "distance"])
        else:
            pairs = pa.StructArray.from_arrays([keys.slice(0, 0), keys.slice(0, 0), pa.array([], pa.float64())], ["query_id", "neighbor_id", "distance"])
        packed = pa.StructArray.from_arrays([keys, v, pa.array(far)], ["k", "v", "far"])
        return pa.table({"q_cell": mine.column("cell").slice(0, 1), "q_ring": mine.column("ring").slice(0, 1), "q_radius": pa.array([pc.max(mine.column("radius")).as_py()]), "q_far": pa.array([float(far.max())]),
                         "queries": pa.ListArray.from_arrays(pa.array([0, len(packed)], pa.int32()), packed), "found": pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs)})

    return left.select("cell", "ring", "chunk", "k", "v", "radius").groupBy("cell", "ring", "chunk").cogroup(right.groupBy("r_cell", "r_ring", "r_chunk")).applyInArrow(meet, kind)


def _elsewhere(pairs: DataFrame, key_type, pivots: np.ndarray, k: int, exclude_self: bool, visits=None) -> DataFrame:
    """Neighbours from pairs of a block of queries and a ring that isn't its home: of those queries that could have some there."""
    width = pivots.shape[1]
    kind = T.StructType([T.StructField("query_id", key_type), T.StructField("neighbor_id", key_type), T.StructField("distance", T.DoubleType())])

    def run(batches):
        block = None
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                if block != column["block"][i].as_py():
                    block, mine = column["block"][i].as_py(), column["queries"][i].values
                    keys, points, far = mine.field("k"), _matrix(mine.field("v"), width), mine.field("far").to_numpy().copy()
                least, most = column["least"][i].as_py(), column["most"][i].as_py()
                away = distances(points, pivots[[column["cell"][i].as_py()]])[:, 0]
                look = np.flatnonzero(np.maximum(away - most, least - away) <= far + SLACK * (1 + away + most))
                if visits is not None:
                    visits.add(len(look))
                if len(look):
                    rows = column["rows"][i].values
                    row, at, d = _nearest(points[look], keys.take(pa.array(look)), far[look], _matrix(rows.field("v"), width), rows.field("k"), k, exclude_self)
                    far[look] = _seen(far[look], row, d, k)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(look[row])), rows.field("k").take(pa.array(at)), pa.array(d)], names=kind.names)

    return pairs.mapInArrow(run, kind)


def knn(queries: DataFrame, refs: DataFrame, features, k: int, key: str = "id", exclude_self: bool = False, counter: list | None = None) -> DataFrame:
    """(query_id, neighbor_id, distance, rank) with rank 1..k per query row, ties by the neighbour's key.

    ``counter`` gets the number of (query, ring) visits and of rings, for tests and reports. An empty side gives no rows.
    """
    spark, key_type = queries.sparkSession, queries.schema[key].dataType
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    features = list(features)
    spare = 1 if exclude_self else 0  # a query may meet itself among the nearest
    same = refs is queries
    points = _points(queries, key, features)
    refs, queries = written(_least_keys(points if same else _points(refs, key, features), k + spare), "refs"), points
    n = refs.count()
    pivots = choose_pivots(refs, n) if n else np.zeros((1, len(features)))
    # written, as ranking samples its rows before it orders them
    rings = written(_rings(written(assign(refs, pivots), "cells")), "rings")
    # one row per cell, so at most MAX_PIVOTS: extent, and the least radii
    radii = F.slice(F.transform(F.array_sort("rows"), lambda r: r["radius"]), 1, k + spare)
    extent = {r["cell"]: {"near": r["near"], "rings": r["rings"]} for r in rings.groupBy("cell").agg(F.min_by(radii, "ring").alias("near"), F.count(F.lit(1)).alias("rings")).collect()}
    n_rings = sum(c["rings"] for c in extent.values())
    spans = rings.select("cell", "ring", "least")
    after = F.lead("least").over(Window.partitionBy("cell").orderBy("ring"))
    spans = written(spans.withColumn("_from", F.when(F.col("ring") == 0, F.lit(-math.inf)).otherwise(F.col("least"))).withColumn("_to", F.coalesce(after, F.lit(math.inf))), "spans")
    homed = assign(queries, pivots).join(spans.drop("least"), "cell").where("radius >= _from and radius < _to").select("k", "v", "cell", "ring", "radius")
    homes = written(_homes(homed, rings, key_type, pivots, extent, k, exclude_self), "homes")
    n_homes = homes.count()
    # blocks far enough from each other to have no neighbours there, by their pivots, are no pairs
    centres = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "at int, centre array<double>")
    left = homes.join(F.broadcast(centres), F.col("q_cell") == F.col("at")).select(
        F.monotonically_increasing_id().alias("block"), "q_cell", "q_ring", "q_radius", "q_far", F.col("centre").alias("q_centre"), "queries")
    right = rings.join(F.broadcast(centres), F.col("cell") == F.col("at")).select("cell", "ring", "least", "most", "centre", "rows")
    left = left.repartition(max(1, min(n_homes, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    right = right.repartition(max(1, -(-n_rings // RINGS)))
    apart = F.sqrt(F.aggregate(F.zip_with("q_centre", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, x: total + x))
    room = F.lit(SLACK) * (F.lit(1.0) + apart + F.col("q_radius") + F.col("most"))
    pairs = left.join(right.hint("shuffle_replicate_nl"), ~((F.col("q_cell") == F.col("cell")) & (F.col("q_ring") == F.col("ring"))) & (
        F.greatest(apart - F.col("q_radius") - F.col("most"), F.col("least") - F.col("q_radius") - apart) <= F.col("q_far") + room))
    visits = spark.sparkContext.accumulator(0) if counter is not None else None
    others = _elsewhere(pairs.select("block", "queries", "cell", "least", "most", "rows"), key_type, pivots, k, exclude_self, visits)
    if counter is not None:
        others = written(others, "others")
        counter += [homed.count() + visits.value, n_rings]
    cand = homes.select(F.explode("found").alias("f")).select("f.*").unionByName(others)
    w = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
