"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A document is the set of its distinct n-word shingles. Sets that agree are one class from the start. Each class gets
a signature of ``CHUNKS * WIDE`` 16-bit MinHash values. Two signatures that differ in at most ``CHUNKS * (ERRORS + 1) - 1``
values agree, in some chunk, in all but at most ERRORS of its values (pigeonhole), so every choice of WIDE - ERRORS values
of each chunk is a key, and all pairs within that distance meet under some key. A pair of similarity 0.8 lies outside the
distance with probability 8e-7 (binomial, 24 values).

Within a key's group, size bounds and a second, independent 128-bit sketch rule out pairs. Of the pairs that remain, only a spanning
forest leaves a group, grown from the class next to the group's majority sketch; these links are confirmed on the full sets. What
could be linked besides lies in one cluster; a cluster of several components sends the sets of its classes to blocks, where those
outside its largest component meet all others, and a block returns at most one link of a class to a component.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import scratch_path

from . import blocks as bl
from .rolling import Names, mix, words

CHUNKS, WIDE, ERRORS = 4, 6, 3
SKETCH = 64
PICKS = [(c, [c * WIDE + i for i in pick]) for c in range(CHUNKS) for pick in combinations(range(WIDE), WIDE - ERRORS)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, firsts): the distinct shingles of each document, sorted; document i has names[firsts[i]:firsts[i + 1]]."""
    _, _, doc, word = words(LOWER[data], starts)
    n_docs = len(starts) - 1
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    seq = Names(word)
    at = np.arange(len(word))
    at = at[at + size <= np.repeat(first[1:], np.diff(first))]
    name, of = seq.of(at, size), doc[at]
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < size))
    if len(short):
        name = np.concatenate([name, seq.of(first[short], first[short + 1] - first[short])])
        of = np.concatenate([of, short])
    order = np.lexsort((name, of))
    name, of = name[order], of[order]
    new = np.append(True, (name[1:] != name[:-1]) | (of[1:] != of[:-1]))[:len(name)]
    name, of = name[new], of[new]
    return name, np.searchsorted(of, np.arange(n_docs + 1))


def _minhash(name: np.ndarray, first: np.ndarray, count: int, seed: int) -> np.ndarray:
    """count MinHash values of each nonempty document, one row each."""
    some = np.flatnonzero(np.diff(first))
    rng = np.random.default_rng(seed)
    out = np.zeros((count, len(first) - 1), np.uint64)
    for k in range(count):
        mul, add = rng.integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        out[k, some] = np.minimum.reduceat((name ^ add) * mul, first[some]) if len(some) else 0
    return mix(out)


ROW = "k1 long, k2 long, id long, n long, node binary, sig binary, sketch binary"


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in bl.blocks(batches, max_bytes=bl.SMALL_BYTES):
            name, first = shingles(data, starts, size)
            cut = [name[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            # the class: two independent sums over the set
            parts = [np.concatenate([[np.uint64(0)], np.cumsum(mix(name * m))]) for m in (np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F))]
            node = np.stack([p[first[1:]] - p[first[:-1]] for p in parts], 1).astype(">u8")
            sig = (_minhash(name, first, CHUNKS * WIDE, 11) & np.uint64(0xFFFF)).astype(np.uint16).T
            bits = _minhash(name, first, SKETCH, 12) & np.uint64(3)
            sketch = np.zeros((len(cut), 2), np.uint64)  # 64 values of 2 bits: low bits, high bits
            for k in range(SKETCH):
                sketch[:, 0] |= (bits[k] & np.uint64(1)) << np.uint64(k)
                sketch[:, 1] |= (bits[k] >> np.uint64(1)) << np.uint64(k)
            binary = lambda m: pa.array([r.tobytes() for r in np.ascontiguousarray(m)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), batch.column("id"), pa.array(np.diff(first).astype(np.int64)), binary(node), binary(sig), binary(sketch)],
                                             names=["k1", "k2", "id", "n", "node", "sig", "sketch"])

    return run


RECORD = "u8 u8 u8 u4 u8 u8"


def _key_map(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = np.frombuffer(b"".join(batch.column("node").to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, CHUNKS * WIDE).astype(np.uint64)
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, 2)
            n = bl.ints(batch, "n").astype(np.uint32)
            keys, routes = [], []
            for number, (chunk, pick) in enumerate(PICKS):
                # by the least value picked: the keys of one chunk go to few buckets, where their pairs are found once
                routes.append(mix(sig[:, pick].min(1) * np.uint64(31) + np.uint64(chunk + 1)))
                key = np.full(len(n), number + 1, np.uint64)
                for column in pick:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, column])
                keys.append(key)
            key = np.concatenate(keys)
            times = len(PICKS)
            yield from bl.rows(bl.route(np.concatenate(routes), [key, *(np.tile(c, times) for c in (node[:, 0], node[:, 1], n, sketch[:, 0], sketch[:, 1]))], n_buckets))

    return run


def least_matches(similarity: float) -> int:
    """Equal sketch values that a pair of this similarity has but for a probability of 1e-8."""
    p, total = similarity + (1 - similarity) / 4, 0.0
    for k in range(SKETCH + 1):
        total += math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if total > 1e-8:
            return k
    return SKETCH


def _near(low, high, n, i, j, similarity: float, least: int) -> np.ndarray:
    """Whether the records i and j can be similar: by size and by sketch."""
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    differ = np.bitwise_count((low[i] ^ low[j]) | (high[i] ^ high[j]))
    return (small >= similarity * large - 1e-9) & (SKETCH - differ.astype(np.int64) >= least)


PAIRS = "a binary, b binary"
PAIRS_ARROW = pa.schema([("a", pa.binary()), ("b", pa.binary())])
#: Classes of a cluster that one block holds.
BLOCK = 256


def _join(similarity: float):
    """A bucket: of each key's group, a spanning forest of the pairs that can be similar, grown from the group's middle."""
    least = least_matches(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b for batch in batches for b in batch.column("blob").to_pylist()]
        if not blobs:
            return
        key, x, y, n, low, high = bl.unpack_all(blobs, RECORD)
        del blobs
        order, cuts = bl.split_by([key])
        size = np.diff(cuts)
        n = n.astype(np.int64)
        two = cuts[:-1][size == 2]
        i, j = order[two], order[two + 1]
        ok = _near(low, high, n, i, j, similarity, least)
        left, right = [i[ok]], [j[ok]]
        for a, b in zip(cuts[:-1][size > 2].tolist(), cuts[1:][size > 2].tolist(), strict=True):
            rest = order[a:b]
            # the first root: next to the bitwise majority of the sketches
            middle = [np.packbits(np.unpackbits(v[rest].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").mean(0) > 0.5, bitorder="little").view(np.uint64)[0] for v in (low, high)]
            rest = rest[np.lexsort((y[rest], x[rest], np.bitwise_count((low[rest] ^ middle[0]) | (high[rest] ^ middle[1]))))]
            queue: list[int] = []
            while len(rest):
                if queue:
                    node = queue.pop()
                else:
                    node, rest = int(rest[0]), rest[1:]
                ok = _near(low, high, n, node, rest, similarity, least)
                if ok.any():
                    reached = rest[ok]
                    left.append(np.full(len(reached), node))
                    right.append(reached)
                    queue += reached.tolist()
                    rest = rest[~ok]
        i, j = np.concatenate(left), np.concatenate(right)
        flip = (x[i] > x[j]) | ((x[i] == x[j]) & (y[i] > y[j]))
        i, j = np.where(flip, j, i), np.where(flip, i, j)
        pairs = np.unique(np.stack([x[i], y[i], x[j], y[j]], 1), axis=0).astype(">u8")  # big-endian bytes sort as the numbers do
        yield from bl.rows([(p[:2].tobytes(), p[2:].tobytes()) for p in pairs], PAIRS_ARROW)

    return run


def _block(similarity: float, percent: int):
    """Visitors (role 1) against the residents (role 0) of a block: confirmed links between different components, at most one of a
    visitor to a component."""
    least = least_matches(similarity)

    def run(table: pa.Table) -> pa.Table:
        role = np.array(table.column("role").to_pylist())
        node, comp = table.column("node").to_pylist(), np.unique(np.array([c.hex() for c in table.column("comp").to_pylist()]), return_inverse=True)[1]
        n = np.array(table.column("n").to_pylist(), np.int64)
        low, high = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, 2).T
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        home, found = np.flatnonzero(role == 0), []
        for i in np.flatnonzero(role == 1):
            reached: set[int] = set()
            for j in home[(comp[home] != comp[i]) & _near(low, high, n, i, home, similarity, least)]:
                if comp[j] not in reached:
                    at = np.minimum(np.searchsorted(sets[j], sets[i]), len(sets[j]) - 1)
                    common = int((sets[j][at] == sets[i]).sum())
                    if 100 * common >= percent * (n[i] + n[j] - common):
                        reached.add(comp[j])
                        found.append((min(node[i], node[j]), max(node[i], node[j])))
        return pa.table({"a": pa.array([p[0] for p in found], pa.binary()), "b": pa.array([p[1] for p in found], pa.binary())})

    return run


def _between(met: DataFrame, comp: DataFrame, classes: DataFrame, docs: DataFrame, rows_: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between the components of one cluster, confirmed on full sets. A cluster holds all classes that could be linked."""
    cluster = components(met.select("a", "b")).withColumnRenamed("comp", "cluster")
    member = _written(cluster.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "members")
    sizes = member.groupBy("cluster", "comp").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max_by("comp", "c").alias("largest"), F.sum("c").alias("total"), (F.sum("c") - F.max("c")).alias("outside"))
    mixed = member.join(sizes.where("outside > 0"), "cluster")
    mixed = _written(mixed.join(classes.select("node", "n", "sketch"), "node"), "mixed")
    sets = _sets(docs, rows_, mixed.select("node"), size)
    whole = mixed.join(sets, "node")
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own = lambda c, salt: F.pmod(F.xxhash64("node", F.lit(salt)), parts(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
    columns = ["cluster", "node", "comp", "n", "sketch", "shingles"]
    home = whole.select(*columns, F.lit(0).alias("role"), own("total", 1).alias("block"), every("outside").alias("group"))
    visit = whole.where("comp <> largest").select(*columns, F.lit(1).alias("role"), every("total").alias("block"), own("outside", 2).alias("group"))
    return home.union(visit).groupBy("cluster", "block", "group").applyInArrow(_block(percent / 100, percent), "a binary, b binary").distinct()


def _written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it is read more than once, and a lost executor doesn't recompute it."""
    path = scratch_path(df.sparkSession, f"near-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node of the component of each node of edges (a, b), by alternating large and small stars.

    Every round is an aggregate with a map-side step and joins that AQE may split; a node of many edges needs no list.
    """
    edges = _written(edges.where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = _written(small, "edges")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
        before = state


def _sets(docs: DataFrame, rows_: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, shingles): the full sets of the given classes, from one document of each."""
    one = rows_.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("k")).select("node", F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2"))
    found = docs.select("k1", "k2", "text").join(one.hint("shuffle_hash"), ["k1", "k2"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in bl.blocks(batches, max_bytes=bl.SMALL_BYTES):
            name, first = shingles(data, starts, size)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([name[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["node", "shingles"])

    return found.mapInArrow(run, "node binary, shingles binary").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on their full sets."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_set").to_pylist(), batch.column("b_set").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def _answers(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keyed documents, a row of id, n and node per document, per class with copies or links: the least id that links reach and
    the key of the one document that stands for all)."""
    spark = docs.sparkSession
    bl.prepare(spark)
    similarity, n_buckets = percent / 100, bl.buckets(spark)
    keyed = bl.keyed(docs, id_col, text_col)
    described = keyed.select("k1", "k2", "id", "text").mapInArrow(_describe(size), ROW)
    rows_ = _written(described, "rows")
    classes = _written(rows_.where("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min("sig").alias("sig"), F.min("sketch").alias("sketch")), "classes")
    met = classes.mapInArrow(_key_map(n_buckets), bl.ROUTED).repartitionById(n_buckets, F.col("bucket")).mapInArrow(_join(similarity), PAIRS)
    first = _written(met.distinct(), "pairs")
    sets = _written(_sets(keyed, rows_, first.select(F.explode(F.array("a", "b")).alias("node")).distinct(), size), "sets")
    links = _written(_confirmed(first, sets, percent), "links")
    comp = components(links)
    more = _written(_between(first, comp, classes, keyed, rows_, size, percent), "links")
    if not more.isEmpty():
        comp = components(links.union(more))
    # the least id of each component; only classes with copies or links need it
    ids = rows_.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("one"))
    grouped = ids.join(comp, "node", "left").select("node", "least", "copies", "one", "comp")
    of_comp = grouped.where("comp is not null").groupBy("comp").agg(F.min("least").alias("of_comp"), F.min("one").alias("one_of_comp"))
    answer = grouped.where("copies > 1 or comp is not null").join(of_comp, "comp", "left").select("node", F.coalesce("of_comp", "least").alias("found"), F.coalesce("one_of_comp", "one").alias("one"))
    return keyed, rows_.select("k1", "k2", "id", "n", "node"), answer


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2, percent: int = 80) -> DataFrame:
    """All rows of docs with: n_shingles, component_id (the least id that links reach, itself included), kept (id = component_id).

    Null and empty texts and texts without words have no shingles and are linked with nothing. Texts with fewer words than
    ``size`` have their whole sequence as one shingle. Rows with equal sets share a component, repeated rows too. A row with a null id counts
    for links but never as the least; alone it keeps a null component and is kept. An empty table gives an empty result.
    Input columns with the names of results are replaced.
    """
    keyed, rows_, answer = _answers(docs, id_col, text_col, size, percent)
    names = ["n_shingles", "component_id", "kept"]
    found = rows_.join(answer.select("node", "found"), "node", "left")
    results = [F.col("n").alias("n_shingles"), F.coalesce("found", "id").alias("component_id"), F.coalesce("found", "id").eqNullSafe(F.col("id")).alias("kept")]
    if set(docs.columns) <= {id_col, text_col}:
        return found.select(F.col("id").alias(id_col), *results)
    rest = [c for c in docs.columns if c not in names]
    done = found.select("k1", "k2", *results).dropDuplicates(["k1", "k2"])
    return keyed.select("k1", "k2", F.struct(*[f"row.`{c}`" for c in rest]).alias("row")).join(done, ["k1", "k2"]).select("row.*", *names)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when one document of each component of near duplicates does: the one of least id, null ids last,
    and among equal ids one of them. Rows equal in id and text are one document. Documents without words stay; so do documents
    that share an id, or have none, but not a component. An empty table gives an empty result.
    """
    keyed, rows_, answer = _answers(docs, id_col, text_col, size, percent)
    stays = rows_.join(answer.select("node", "one"), "node", "left").where("one is null or (one.k1 = k1 and one.k2 = k2)").select("k1", "k2").distinct()
    return keyed.select("k1", "k2", "row").join(stays, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
