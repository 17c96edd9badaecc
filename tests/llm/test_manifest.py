"""Merkle manifest against a plain tree over sorted leaves; addresses against the recursive layout."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import merkle_manifest as mm

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
KINDS = "doc_id long, source string, lang string, n_chars long, text string, leaf int, g string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def tree(nodes):
    """Root, and for each node its path of (sibling is left, sibling or None)."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, o in zip(paths, own, strict=True):
            path.append((bool(o & 1), nodes[o ^ 1] if (o ^ 1) < len(nodes) else None))
        own, nodes = [o >> 1 for o in own], [digest(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute(rows, shown):
    leaves, groups = [leaf(r) for r in rows], {}
    for i, r in enumerate(rows):
        groups.setdefault(r[2], []).append(i)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    paths, subroots = {}, {}
    for name in names:
        placed = sorted(groups[name], key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaves[i]))
        subroots[name], found = tree([leaves[i] for i in placed])
        paths |= dict(zip(placed, found, strict=True))
    root, found = tree([subroots[name] for name in names])
    above, out = dict(zip(names, found, strict=True)), []
    for i, r in enumerate(rows):
        path, now = paths[i] + above[r[2]], leaf(shown(r))
        for left, other in path:
            now = digest(now) if other is None else digest(other, now) if left else digest(now, other)
        out.append((r[0], r[2], leaves[i], subroots[r[2]], root, digest(*(d for _, d in path if d)), now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", range(1, 9))
def test_address(levels):
    def layout(depth, index, count):
        """Nodes of a subtree of count levels in van Emde Boas order, as (depth, index)."""
        if count == 1:
            return [(depth, index)]
        upper = count // 2
        out, below = layout(depth, index, upper), depth + upper
        for i in range(1 << upper):
            out += layout(below, (index << upper) + i, count - upper)
        return out

    want = {node: at for at, node in enumerate(layout(0, 0, levels))}
    for depth in range(levels):
        got = mm.address(levels - 1, levels - 1 - depth, np.arange(1 << depth))
        assert got.tolist() == [want[depth, i] for i in range(1 << depth)]




def rows_for(sizes):
    rows = [(i, f"s{i % 3}", lang, i * 10, f"text {i} é") for lang, n in sizes.items() for i in range(n)]
    return rows + [(None, None, None, None, None), (None, "a", None, 3, ""), (7, "s", "en", None, "x" * 100_000), (7, "s", "en", None, "x" * 100_000), (8, "-", "-", 1, "2:ab")]


@pytest.mark.parametrize("sizes", [{}, {"en": 1}, {"en": 3, "de": 2, "fr": 1}, {"en": 1030, "": 5, "日本": 2, "de": 2100}])
def test_prove(spark, sizes):
    rows = rows_for(sizes)
    frame = spark.createDataFrame([(*r, 5, "clash") for r in rows], KINDS).repartition(3)
    claimed = {"n_chars": F.when(F.col("doc_id") % 5 == 1, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    got = mm.prove(frame, COLUMNS, "lang", "doc_id", claimed)
    assert got.columns == ["doc_id", "lang", "g", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute(rows, lambda r: (*r[:3], r[3] + 1 if r[0] is not None and r[0] % 5 == 1 and r[3] is not None else r[3], r[4]))
    assert sorted((tuple(r) for r in got.drop("g").collect()), key=str) == want


def test_one_row_and_none(spark):
    one = mm.prove(spark.createDataFrame([(1, "s", "en", 1, "t", 0, "")], KINDS), COLUMNS, "lang", "doc_id").first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == digest("")
    assert mm.prove(spark.createDataFrame([], KINDS), COLUMNS, "lang", "doc_id").count() == 0


def test_blocks_hold_the_tree():
    """Any path through a block's layout gives its root, also with nodes missing at the end."""
    for n in (1, 2, 3, 5, 8, 11, 16):
        nodes = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        height = mm.height_of(0, n)
        layout, root = mm.build_tree(nodes, height)
        assert root.hex() == tree([d.hex() for d in nodes])[0]
        assert all(mm.fold(d, p) == root for d, p in zip(nodes, mm.siblings(layout, height, n), strict=True))
