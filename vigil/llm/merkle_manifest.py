"""Merkle manifest of a dataset: a hash tree over the rows of each group and over the groups' roots, stored in blocks.

A block is an aligned subtree over 2^HEIGHT consecutive nodes, kept as one array of digests in van Emde Boas order: the upper
half of its levels first, then each subtree below, both laid out the same way. Address arithmetic alone finds a node, so the
same few lines serve construction and the retrieval of siblings. The roots of blocks are the leaves of the next tier, until
a group has one block; the groups' roots, in order, make a tree of the same kind.

Ranks come from a range-partitioned sort, and a block is one bounded group, so no group of any size meets in one task.
A proof goes down the tiers: each block hands the siblings above it to the blocks below.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.ranking import rank_in_groups
from vigil.session import scratch_path

from . import blocks as bl

#: A block has at most 2^HEIGHT nodes in its lowest level.
HEIGHT = 10
DIGEST = 32
#: A step of a proof: one byte for the place of the sibling, and the sibling's digest (zeros where there is none).
RIGHT, LEFT, LONE = 0, 1, 2
STEP = 1 + DIGEST


@lru_cache(64)
def _steps(levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By depth below the root: size of the subtree rooted there (bottom), of the tree above it (top), and the depth of that
    tree's root, in the recursive split of a tree of that many levels at half its height."""
    bottom, top, above = (np.zeros(levels, np.int64) for _ in range(3))

    def split(first: int, count: int) -> None:
        if count == 1:
            return
        upper = count // 2
        cut = first + upper
        top[cut], bottom[cut], above[cut] = (1 << upper) - 1, (1 << (count - upper)) - 1, first
        split(first, upper)
        split(cut, count - upper)

    split(0, levels)
    return bottom, top, above


def address(height: int, level: int, index: np.ndarray) -> np.ndarray:
    """Places, in the van Emde Boas order of a tree of that height, of the nodes ``index`` of a level (0: the leaves)."""
    bottom, top, above = _steps(height + 1)

    def at(depth: int, node: np.ndarray) -> np.ndarray:
        if depth == 0:
            return np.zeros(len(node), np.int64)
        root = int(above[depth])
        return at(root, node >> (depth - root)) + top[depth] + (node & top[depth]) * bottom[depth]

    depth = height - level
    return at(depth, np.asarray(index, np.int64) + (1 << depth))  # numbered from 1 at the root, breadth first


def height_of(block: int, n: int) -> int:
    """Only a group's first block can be its last, and then the tree ends where one node is left."""
    return HEIGHT if block else (n - 1).bit_length()


def combine(left: bytes, right: bytes | None = None) -> bytes:
    """The parent of two digests, or of a lone one; digests are hashed as hex text."""
    return hashlib.sha256((left.hex() + right.hex() if right is not None else left.hex()).encode()).digest()


def build_tree(digests: list[bytes], height: int) -> tuple[bytes, bytes]:
    """(the layout, the root) of a block over these nodes. Places without a node are zeros."""
    tree = np.zeros(((2 << height) - 1, DIGEST), np.uint8)
    for level in range(height + 1):
        tree[address(height, level, np.arange(len(digests)))] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, DIGEST)
        if level < height:
            digests = [combine(*digests[i:i + 2]) for i in range(0, len(digests), 2)]
    return tree.tobytes(), digests[0]


def siblings(tree: bytes, height: int, n: int) -> list[bytes]:
    """For each of the n lowest nodes of a block the steps of its proof up to the block's root."""
    nodes = np.frombuffer(tree, np.uint8).reshape(-1, DIGEST)
    out = np.zeros((n, height, STEP), np.uint8)
    index, count = np.arange(n), n
    for level in range(height):
        other = index ^ 1
        there = other < count
        out[:, level, 0] = np.where(there, np.where(other < index, LEFT, RIGHT), LONE)
        out[there, level, 1:] = nodes[address(height, level, other[there])]
        index, count = index >> 1, (count + 1) // 2
    return [steps.tobytes() for steps in out]


def fold(digest: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    for at in range(0, len(proof), STEP):
        side, other = proof[at], proof[at + 1:at + STEP]
        digest = combine(digest) if side == LONE else combine(other, digest) if side == LEFT else combine(digest, other)
    return digest


def proof_digest(proof: bytes) -> str:
    """Hash of the proof's siblings as hex text, from the leaf up."""
    return hashlib.sha256("".join(proof[at + 1:at + STEP].hex() for at in range(0, len(proof), STEP) if proof[at] != LONE).encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """sha256 of the columns one after the other: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]).cast("binary"), 256))


TREE = "g string, block long, n long, tree binary, root binary"


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _tower(nodes: DataFrame, path: str) -> list[DataFrame]:
    """nodes: g, pos (from 0 in each g), digest. The written tiers of blocks (TREE); in the last every g has one block."""
    def one(key: tuple, table: pa.Table) -> pa.Table:
        group, block = (k.as_py() for k in key)
        place = np.argsort(table.column("pos").to_numpy())
        tree, root = build_tree(table.column("digest").take(pa.array(place)).to_pylist(), height_of(block, table.num_rows))
        return pa.table({"g": [group], "block": [block], "n": [table.num_rows], "tree": [tree], "root": [root]})

    tiers: list[DataFrame] = []
    most = nodes.agg(F.max("pos")).first()[0] or 0
    while True:
        blocks = nodes.select("g", F.shiftright("pos", HEIGHT).alias("block"), "pos", "digest").groupBy("g", "block").applyInArrow(one, TREE)
        tiers.append(_write(blocks, f"{path}/tier-{len(tiers)}"))
        if most < 1 << HEIGHT:
            return tiers
        most >>= HEIGHT
        nodes = tiers[-1].select("g", F.col("block").alias("pos"), F.col("root").alias("digest"))


def _expand(blocks: DataFrame) -> DataFrame:
    """g, pos, subroot, proof of each lowest node of the blocks; blocks: TREE, g's subroot and the proof of the block's root."""
    kinds = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("subroot", pa.binary()), ("proof", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, block, n, tree, subroot, proof in zip(*(batch.column(c).to_pylist() for c in ("g", "block", "n", "tree", "subroot", "proof")), strict=True):
                steps = siblings(tree, height_of(block, n), n)
                yield pa.RecordBatch.from_pydict({"g": [g] * n, "pos": [(block << HEIGHT) + i for i in range(n)], "subroot": [subroot] * n, "proof": [s + proof for s in steps]}, schema=kinds)

    return blocks.mapInArrow(run, "g string, pos long, subroot binary, proof binary")


def _proofs(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest blocks with the subroot of their group and the proof of their roots; tops: g, subroot and the proof of g's root.

    Joins are by (g, block), unique on both sides, so a group of any size spreads."""
    known = tops.select("g", F.lit(0).cast("long").alias("block"), "subroot", "proof")
    for tier in reversed(tiers[1:]):
        known = _expand(tier.join(known, ["g", "block"])).withColumnRenamed("pos", "block")
    return tiers[0].join(known, ["g", "block"])


def prove(docs: DataFrame, columns: list[str], group_col: str, order_col: str, claimed: dict[str, Column] | None = None, path: str | None = None) -> DataFrame:
    """Build the manifest of docs under ``path`` (the shared scratch folder if None) and prove every row by it.

    A row's leaf hashes ``columns``; leaves ascend by ``order_col`` in each group, groups by name. Returns a row per row: all
    columns but those hashed only (``columns`` other than group and order), leaf, subroot, root, proof_sha256, folded_root and
    verified. ``claimed`` replaces columns' values in the row that is shown to the verifier: folded_root is what that row's leaf and the
    stored siblings give, verified whether it is root. A column that evaluates to null is a null value.

    Nulls count as values (``-``); the null group and null ids come first. Rows with equal ids stand in the order of their leaves,
    so repeated rows have leaves and proofs of their own. Empty and long texts are values like any other. A table of one row
    has its leaf as its root and no siblings (the hash of nothing). An empty table gives an empty result. Input columns
    with the names of results are replaced, but are hashed if ``columns`` names them.
    """
    spark = docs.sparkSession
    bl.prepare(spark)
    path = path or scratch_path(spark, f"merkle-{uuid.uuid4().hex}")
    new = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rest = [c for c in docs.columns if c not in new and (c not in columns or c in (group_col, order_col))]
    shown = [(claimed or {}).get(c, F.col(f"`{c}`")) for c in columns]
    leaf = leaf_digest([F.col(f"`{c}`") for c in columns])
    group = F.col(f"`{group_col}`").cast("string")
    # null groups first, and no name can be taken for null
    g = F.when(group.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), group))
    leaves = _write(docs.select(g.alias("g"), F.col(f"`{order_col}`").alias("o"), leaf.alias("leaf"), leaf_digest(shown).alias("shown"), F.struct(*[f"`{c}`" for c in rest]).alias("row")), f"{path}/leaves")
    ranked = rank_in_groups(leaves, "g", ["o", "leaf"]).select("g", (F.col("rank") - 1).alias("pos"), "leaf", "shown", "row")
    tiers = _tower(ranked.select("g", "pos", F.col("leaf").alias("digest")), f"{path}/rows")
    tops = rank_in_groups(tiers[-1].select("g", "root").withColumn("all", F.lit("")), "all", "g").select("g", "root", (F.col("rank") - 1).alias("pos"))
    tops = _write(tops, f"{path}/groups")
    over = _tower(tops.select(F.lit("").alias("g"), "pos", F.col("root").alias("digest")), f"{path}/over")
    whole = over[-1].select(F.lit("").alias("g"), F.lit(b"").alias("subroot"), F.lit(b"").alias("proof"))
    tops = tops.join(_expand(_proofs(over, whole)).select("pos", "proof"), "pos").select("g", F.col("root").alias("subroot"), "proof")
    lowest = _proofs(tiers, tops)
    top = over[-1].select("root").first()  # one digest
    root = bytes(top.root) if top else b""

    def one(key: tuple, rows: pa.Table, block: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column("pos").to_numpy())))
        tree, above, subroot = (block.column(c)[0].as_py() for c in ("tree", "proof", "subroot"))
        proofs = [s + above for s in siblings(tree, height_of(key[1].as_py(), rows.num_rows), rows.num_rows)]
        folded = [fold(d, p) for d, p in zip(rows.column("shown").to_pylist(), proofs, strict=True)]
        n = rows.num_rows
        return pa.Table.from_arrays([rows.column("row"), pa.array([d.hex() for d in rows.column("leaf").to_pylist()]), pa.array([subroot.hex()] * n), pa.array([root.hex()] * n),
                                     pa.array([proof_digest(p) for p in proofs]), pa.array([d.hex() for d in folded]), pa.array([d == root for d in folded])], names=["row", *new])

    placed = ranked.withColumn("block", F.shiftright("pos", HEIGHT))
    kind = f"row {leaves.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} string" for c in new[:-1]) + ", verified boolean"
    return placed.groupBy("g", "block").cogroup(lowest.groupBy("g", "block")).applyInArrow(one, kind).select("row.*", *new)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return prove(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"n_chars": tampered}).drop("lang")


#: op11 in SQL: the levels of each group's tree and of the tree over groups, then every row's way up; the middle of docs is a crc32.
OP11_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 7 = 0 AS tampered
  FROM documents),
hashed AS (
  SELECT r, doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(m AS VARCHAR)) || ':' || m, '-') || tail) AS shown
  FROM (SELECT *, CASE WHEN tampered THEN n_chars + 1 ELSE n_chars END AS m FROM docs)),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
levels AS (
  SELECT lang, 0 AS level, pos, leaf AS h, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM levels WHERE n > 1 GROUP BY lang, level, pos // 2),
tops AS (SELECT lang, level AS depth, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM levels WHERE n = 1),
over_ AS (
  SELECT 0 AS level, pos, h, n FROM tops
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM over_ WHERE n > 1 GROUP BY level, pos // 2),
walk AS (
  SELECT r, l.lang, 0 AS level, l.pos, depth, t.pos AS top, shown AS cur, '' AS proof FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang
  UNION ALL
  SELECT w.r, w.lang, w.level + 1, w.pos // 2, depth, top, sha256(CASE WHEN s.h IS NULL THEN cur WHEN s.pos < w.pos THEN s.h || cur ELSE cur || s.h END), proof || coalesce(s.h, '')
  FROM walk w LEFT JOIN levels s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.level < depth),
up AS (
  SELECT r, 0 AS level, top AS pos, cur, proof FROM walk WHERE level = depth
  UNION ALL
  SELECT w.r, w.level + 1, w.pos // 2, sha256(CASE WHEN s.h IS NULL THEN cur WHEN s.pos < w.pos THEN s.h || cur ELSE cur || s.h END), proof || coalesce(s.h, '')
  FROM up w LEFT JOIN over_ s ON s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.level < (SELECT max(level) FROM over_))
SELECT doc_id, leaf, t.h AS subroot, o.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = o.h AS verified
FROM leaves l JOIN up USING (r) JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang JOIN over_ o ON o.n = 1
WHERE up.level = o.level
"""
