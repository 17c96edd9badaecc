"""Repeated word passages across documents: the later document loses them, found by an FM-index per shard.

A window is ``window`` consecutive words of one document. A word is removed if a window that covers it also starts in a
document with a smaller id.

1. *Sharding by anchor.* Every window holds one gram of words that is the least of its window; equal windows share it,
   so the shard of an anchor holds every document that can share a window around it. Anchors are first compared by
   the names of their surroundings (all windows that could hold them): of equal surroundings only those in the
   smallest document can be a first occurrence; the others are settled. An anchor with only one class of
   surroundings needs nothing more. A hot anchor (many classes in one block of text) is dealt out by its surroundings.
2. *FM-index.* The surroundings that are left go to their shard as words. Each shard builds a wavelet-matrix FM-index
   over them and streams every passage backwards through it, all passages in lockstep; the matching statistic, capped at
   the window, gives the interval of all equal windows, and an interval that holds a smaller document is reported. The
   passages of hot anchors would make one huge shard: their windows meet by 128-bit names instead, each sent once per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import blocks as bl
from .rolling import Names, anchors, words

#: Words of an anchor's gram as a share of the window.
GRAM_SHARE = 6
#: Null ids come after all others.
LAST = (1 << 63) - 1
RECORD = "u8 u8 i8 i8 i8 u4 u1"
WINDOW = "u8 u8 i8 i8 i8 u4"
SALTED, MARKER = 1, 2


class BitVector:
    """Bits in 64-bit words with counts before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)


class FMIndex:
    """Wavelet matrix over the Burrows-Wheeler transform of int symbols (0 separates passages), sorted as deep as ``depth`` symbols.

    Backward search is right for patterns of up to ``depth`` symbols. groups: rows whose first ``depth`` symbols agree.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.depth, self.size = depth, n
        tail = lambda r, h: np.concatenate([r[h:], np.full(min(h, n), -1, np.int64)])
        rank, h = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        while h < depth:  # rank: of the first h symbols; doubles, the last step overlaps
            step = min(h, depth - h)
            rank = np.unique(rank * (n + 2) + tail(rank, step) + 1, return_inverse=True)[1].astype(np.int64)
            h += step
        self.suffixes = np.argsort(rank, kind="stable")
        of = rank[self.suffixes]
        self.starts = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])) if n else np.zeros(0, np.int64), n)
        self.group = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        column = text[self.suffixes - 1]
        top = int(text.max(initial=0))
        counts = np.bincount(text, minlength=top + 1)
        self.less = np.concatenate([[0], np.cumsum(counts)])
        self.levels, self.zeros = [], []
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            ones = ((column >> bit) & 1).astype(bool)
            self.levels.append((bit, BitVector(ones)))
            self.zeros.append(len(column) - int(ones.sum()))
            column = np.concatenate([column[~ones], column[ones]])

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern, from those of the patterns."""
        a, b, at = lo.copy(), hi.copy(), np.zeros_like(lo)
        for (bit, ones), zeros in zip(self.levels, self.zeros, strict=True):
            up = ((symbol >> bit) & 1).astype(bool)
            ra, rb, rat = ones.rank(a), ones.rank(b), ones.rank(at)
            a, b, at = np.where(up, zeros + ra, a - ra), np.where(up, zeros + rb, b - rb), np.where(up, zeros + rat, at - rat)
        base = self.less[symbol]
        return base + a - at, base + b - at

    def trim(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first ``depth`` symbols of the rows lo."""
        g = self.group[lo]
        return self.starts[g], self.starts[g + 1]


def matching(index: FMIndex, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Streams the passages text[begin:end) backwards, in lockstep: (passage, position, row) of each position where a match of
    index.depth symbols starts; row is any row of its interval. A passage without a match restarts after the mismatch."""
    lane = np.argsort(begin - end, kind="stable")
    at, stop = end[lane].copy(), begin[lane]
    lo, hi, length = np.zeros(len(lane), np.int64), np.full(len(lane), index.size, np.int64), np.zeros(len(lane), np.int64)
    while len(lane):
        at -= 1
        alive = at >= stop
        if not alive.all():
            lane, at, stop, lo, hi, length = (x[alive] for x in (lane, at, stop, lo, hi, length))
            if not len(lane):
                return
        a, b = index.extend(lo, hi, text[at])
        lost = a >= b
        if lost.any():
            a[lost], b[lost] = index.extend(np.zeros(lost.sum(), np.int64), np.full(lost.sum(), index.size, np.int64), text[at[lost]])
        length = np.where(lost, 1, length + 1)
        full = length >= index.depth
        if full.any():
            a[full], b[full] = index.trim(a[full])
            length = np.minimum(length, index.depth)
            yield lane[full], at[full], a[full]
        lo, hi = a, b


def _classes(name, around, ident):
    """Records sorted by (name, surroundings, id), alone where there are no whole surroundings: order, members of the class,
    whether its id is the class's least, classes in the group, least and greatest id of the group."""
    alone = np.where(around == 0, np.arange(1, len(around) + 1, dtype=np.uint64), np.uint64(0))
    order = np.lexsort((ident, alone, around, name))
    n, a, o, d = name[order], around[order], alone[order], ident[order]
    group_new, class_new = np.ones(len(order), bool), np.ones(len(order), bool)
    group_new[1:] = n[1:] != n[:-1]
    class_new[1:] = group_new[1:] | (a[1:] != a[:-1]) | (o[1:] != o[:-1])
    klass, group = np.cumsum(class_new) - 1, np.cumsum(group_new) - 1
    first = d[class_new][klass]
    n_classes = np.bincount(group[class_new])[group] if len(order) else group
    cuts = np.flatnonzero(group_new)
    least = np.minimum.reduceat(d, cuts)[group] if len(order) else d
    most = np.maximum.reduceat(d, cuts)[group] if len(order) else d
    return order, d == first, n_classes, least < most


def _anchor_map(window: int, gram: int, n_buckets: int):
    before = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in bl.blocks(batches):
            _, _, doc, name = words(data, starts)
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            ends = np.repeat(first[1:], np.diff(first))
            seq = Names(name)
            grams = seq.all(gram)
            at = anchors(grams, ends, gram, window)
            of = doc[at]
            lo, hi = at - before, at + window
            whole = (lo >= first[of]) & (hi <= first[of + 1])
            around = np.zeros(len(at), np.uint64)
            around[whole] = seq.of(lo[whole], before + window)
            k1, k2, ident = (bl.ints(batch, c, LAST)[of] for c in ("k1", "k2", "id"))
            rel, g = at - first[of], grams[at]
            # within a block: equal surroundings in a document that isn't the least are settled, the rest goes on
            order, least, n_classes, _ = _classes(g, around, ident)
            g, around, k1, k2, ident, rel = (x[order] for x in (g, around, k1, k2, ident, rel))
            out = bl.spans(k1[~least], k2[~least], (rel - before)[~least], (rel + window)[~least], bl.SETTLED, n_buckets)
            g, around, k1, k2, ident, rel, n_classes = (x[least] for x in (g, around, k1, k2, ident, rel.astype(np.uint32), n_classes))
            hot = n_classes > bl.HOT
            marker = hot & np.append(True, g[1:] != g[:-1])[:len(g)]
            to = np.where(hot, bl.salted(g, around, k1, rel), g)
            records = [np.concatenate([x, x[marker]]) for x in (g, around, k1, k2, ident, rel)]
            records[1][len(g):] = 0
            mark = np.concatenate([np.where(hot, SALTED, 0), np.full(int(marker.sum()), MARKER)]).astype(np.uint8)
            yield from bl.rows(out + bl.route(np.concatenate([to, g[marker]]), [*records, mark], n_buckets))

    return run


#: Of kind OTHER: a document's anchors whose passages a shard needs.
ASKED_FOR = "i8 i8 u8 u4 u1"


def _compare(window: int, gram: int, n_buckets: int):
    before = window - gram

    def run(blobs: list[bytes]) -> list[tuple]:
        name, around, k1, k2, ident, rel, mark = bl.unpack_all(blobs, RECORD)
        order, least, n_classes, several = _classes(name, around, ident)
        name, k1, k2, rel, mark = (x[order] for x in (name, k1, k2, rel, mark))
        rel = rel.astype(np.int64)
        # a group with a marker is hot everywhere: all of its members compare windows
        new = np.append(True, name[1:] != name[:-1])[:len(name)]
        hot = mark == SALTED
        if len(name):
            cuts = np.flatnonzero(new)
            hot |= np.repeat(np.maximum.reduceat(mark == MARKER, cuts), np.diff(np.append(cuts, len(name))))
        out = bl.spans(k1[~least], k2[~least], (rel - before)[~least], (rel + window)[~least], bl.SETTLED, n_buckets)
        ask = least & (((n_classes > 1) & several) | hot) & (mark != MARKER)
        name, k1, k2, rel, hot = (x[ask] for x in (name, k1, k2, rel, hot))
        return out + (bl.to_documents([k1, k2, name, rel.astype(np.uint32), hot.astype(np.uint8)], bl.OTHER, n_buckets) if len(name) else [])

    return run


#: kind of the rows for a shard that hold a passage's words; NAMES: windows of hot anchors; SETTLED goes through.
PASSAGE = 3
SHARDED = "bucket int, kind int, k1 long, k2 long, id long, start long, blob binary"
SHARDED_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("blob", pa.binary())])


def _passage_map(window: int, gram: int, n_buckets: int):
    """The words around each anchor that is asked for, to the anchor's shard; for hot anchors the names of their windows; settled ranges go along."""
    before = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in bl.blocks(batches):
            key1, key2, ids = (bl.ints(batch, c, LAST) for c in ("k1", "k2", "id"))
            k1, k2, ident = key1.tolist(), key2.tolist(), ids.tolist()
            passages = batch.column("other").to_pylist()
            begin, end, doc, name_a = words(data, starts)
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            raw, out, spread = data.tobytes(), [(x, kind, 0, 0, 0, 0, blob) for x, kind, blob in bl.passed(batch, n_buckets)], []
            for i in range(batch.num_rows):
                if passages[i]:
                    name, rel, hot = bl.unpack(passages[i], "u8 u4 u1")
                    lo = np.maximum(rel.astype(np.int64) - before, 0)
                    hi = np.minimum(rel.astype(np.int64) + window, first[i + 1] - first[i])
                    spread += [np.arange(a, b - window + 1) + first[i] for a, b in zip(lo[hot == 1], hi[hot == 1], strict=True)]
                    shard = ((name >> np.uint64(40)) % np.uint64(n_buckets)).tolist()
                    for s, h, a, b in zip(shard, hot.tolist(), lo.tolist(), hi.tolist(), strict=True):
                        if not h and b - a >= window:
                            out.append((s, PASSAGE, k1[i], k2[i], ident[i], a, raw[begin[first[i] + a]:end[first[i] + b - 1]]))
            if spread and len(at := np.unique(np.concatenate(spread))):
                a = Names(name_a).of(at, window)
                b = Names(words(data, starts, 1)[3], 1).of(at, window)
                of = doc[at]
                least, part = _least_only(a, b, key1[of], key2[of], ids[of], at - first[of], window, n_buckets)
                out += [(x, kind, 0, 0, 0, 0, blob) for x, kind, blob in least + part]
            yield from bl.rows(out, SHARDED_ARROW)

    return run


def _least_only(a, b, k1, k2, ident, at, window: int, n_buckets: int) -> tuple[list[tuple], list[tuple]]:
    """Windows by 128-bit name: those of the least id, routed on; the others, settled."""
    order = np.lexsort((ident, b, a))
    a, b, k1, k2, ident, at = (x[order] for x in (a, b, k1, k2, ident, at))
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[:len(a)]
    least = ident == ident[new][np.cumsum(new) - 1]
    later = ~least
    at = at.astype(np.int64)
    return (bl.route(a[least], [x[least] for x in (a, b, k1, k2, ident, at.astype(np.uint32))], n_buckets),
            bl.spans(k1[later], k2[later], at[later], at[later] + window, bl.SETTLED, n_buckets))


def _shard(window: int, n_buckets: int):
    """One shard: the FM-index of its passages, each streamed through it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[bytes, int] = {}
        symbols, owner, start, key1, key2, named = [], [], [], [], [], []
        for batch in batches:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            through = kind == bl.SETTLED
            if through.any():
                yield batch.filter(pa.array(through)).select(["bucket", "kind", "blob"])
            named += batch.column("blob").filter(pa.array(kind == bl.NAMES)).to_pylist()
            part = batch.filter(pa.array(kind == PASSAGE))
            for w in part.column("blob").to_pylist():
                symbols.append(np.fromiter((ids.setdefault(x, len(ids) + 1) for x in w.split()), np.int64))
            for to, c in ((owner, "id"), (start, "start"), (key1, "k1"), (key2, "k2")):
                to += part.column(c).to_pylist()
        if named:
            yield from bl.rows(_least_only(*bl.unpack_all(named, WINDOW), window, n_buckets)[1])
        if not symbols:
            return
        lengths = np.array([len(s) for s in symbols])
        text = np.zeros(int(lengths.sum()) + len(symbols), np.int64)
        end = np.cumsum(lengths + 1) - 1
        begin = end - lengths
        passage = np.repeat(np.arange(len(symbols)), lengths + 1)
        inside = np.ones(len(text), bool)
        inside[end] = False
        text[inside] = np.concatenate(symbols)
        owner, start, key1, key2 = (np.array(x, np.int64) for x in (owner, start, key1, key2))
        index = FMIndex(text, window)
        # the least document of each interval of equal windows
        least = np.minimum.reduceat(owner[passage[index.suffixes]], index.starts[:-1])
        out_k1, out_k2, out_lo = [], [], []
        for lane, at, row in matching(index, text, begin, end):
            hit = least[index.group[row]] < owner[lane]
            lane, at = lane[hit], at[hit]
            out_k1.append(key1[lane])
            out_k2.append(key2[lane])
            out_lo.append(start[lane] + at - begin[lane])
        if out_lo:
            lo = np.concatenate(out_lo)
            yield from bl.rows(bl.spans(np.concatenate(out_k1), np.concatenate(out_k2), lo, lo + window, bl.SETTLED, n_buckets))

    return run


def remove_later_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, keep_text: bool = True) -> DataFrame:
    """All rows of docs with: n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, with keep_text,
    kept_text. Words are runs of bytes other than ASCII white space.

    Null and empty texts have no words and the hash of the empty string. Rows with equal ids never make each other lose words;
    null ids count as one id above all others. An empty table gives an empty result. Input columns with the names of results are replaced.
    """
    spark = docs.sparkSession
    bl.prepare(spark)
    n = bl.buckets(spark)
    gram = max(1, window // GRAM_SHARE)
    new = StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])
    if keep_text:
        new = new.add("kept_text", StringType())
    rest = [c for c in docs.columns if c not in new.names and c != text_col]
    text = bl.keyed(docs, id_col, text_col).select("k1", "k2", "id", "text", F.struct(*[f"row.`{c}`" for c in rest]).alias("row")).repartition(n, "k1", "k2")
    # every step takes all columns, so that all read the same exchange
    found = bl.meet(text.mapInArrow(_anchor_map(window, gram, n), bl.ROUTED), n, _compare(window, gram, n))
    known = bl.by_document(found, n, ASKED_FOR)
    passages = text.join(known.hint("shuffle_hash"), (text.k1 == known.d1) & (text.k2 == known.d2)).select(
        "k1", "k2", "id", F.when(F.col("other").isNotNull(), F.col("text")).otherwise("").alias("text"), "settled", "other", "row")
    shards = passages.mapInArrow(_passage_map(window, gram, n), SHARDED).repartitionById(n, F.col("bucket")).mapInArrow(_shard(window, n), bl.ROUTED)
    done = bl.by_document(shards, n).select("d1", "d2", "settled")
    joined = text.join(done.hint("shuffle_hash"), (text.k1 == done.d1) & (text.k2 == done.d2), "left").select("text", "settled", "row", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in bl.blocks(batches):
            raw, n_words, n_removed, sha, kept_text = data.tobytes(), [], [], [], []
            for i, blob in enumerate(batch.column("settled").to_pylist()):
                found_words = raw[starts[i]:starts[i + 1]].split()
                kept = found_words
                if blob:
                    lo, hi = bl.unpack(blob, "u4 u4")
                    edge = np.zeros(len(found_words) + 1, np.int32)
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, np.minimum(hi, len(found_words)), -1)
                    kept = [found_words[j] for j in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                n_words.append(len(found_words))
                n_removed.append(len(found_words) - len(kept))
                joined_words = b" ".join(kept)
                sha.append(hashlib.sha256(joined_words).hexdigest())
                if keep_text:
                    kept_text.append(joined_words.decode("utf-8", "replace"))
            columns = [batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())] + ([pa.array(kept_text, pa.string())] if keep_text else [])
            yield pa.RecordBatch.from_arrays(columns, names=["row", *new.names])

    out = joined.mapInArrow(run, StructType([StructField("row", joined.schema["row"].dataType), *new.fields]))
    return out.select("row.*", *new.names)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_later_passages(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
