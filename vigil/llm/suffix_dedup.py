"""Repeated byte strings across a corpus, by a distributed difference-cover sort.

A byte is repeated if a string of ``width`` bytes that covers it also starts anywhere else (same document
included). The sort works on names: a suffix's first ``width`` bytes are all that can matter, so its sort key is
the name (64-bit fingerprint, 128 bits in the last step) of that prefix instead of its rank.

1. *Anchors.* Every ``width`` bytes hold one gram that is the least of its window; repeated strings share it. Anchors
   are compared with their whole surroundings (the bytes of all windows that could hold them). Equal surroundings
   settle everything inside at once; what is left are the edges of repeats.
2. *Difference cover.* There, suffixes at sample positions (a difference cover modulo 57: any two positions reach
   sample positions by the same shift below 57) are sorted by the names of their first width - 56 bytes. Only those
   with an equal neighbour go on; equal longer prefixes settle what is around them.
3. *Merge.* The remaining suffixes beside such samples get the 128-bit names of all their ``width`` bytes, are sorted
   together, and equal neighbours are repeats.

Every step shuffles names, not text, to hash buckets; a name that many documents share leaves a task once. The text
itself is shuffled once, by document, and all steps read that exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import blocks as bl
from .rolling import Names, anchors, byte_table

#: A perfect difference set modulo 57: each nonzero residue is the difference of exactly one pair.
COVER, MODULUS = (0, 1, 3, 13, 32, 36, 43, 52), 57
#: Bytes that a task names at a time: every byte has a dozen 64-bit numbers meanwhile.
BLOCK_BYTES = 1 << 20
#: Length of an anchor's gram as a share of the width.
GRAM_SHARE = 2


def _classes(name: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, ...]:
    """order, per record in that order: its group (equal name), its class (equal surroundings, 0 is always alone), members of its class, classes of its group, whether it is the first of its class."""
    alone = np.where(around == 0, np.arange(1, len(around) + 1, dtype=np.uint64), np.uint64(0))
    order, cuts = bl.split_by([name, around, alone])
    size = np.diff(cuts)
    members = np.repeat(size, size)
    first = np.zeros(len(order), bool)
    first[cuts[:-1]] = True
    group_of_class = name[order][cuts[:-1]]
    _, inverse, n_classes = np.unique(group_of_class, return_inverse=True, return_counts=True)
    return order, members, np.repeat(n_classes[inverse], size), first


def _combine(name, around, k1, k2, at, lo, hi, n_buckets: int) -> list[tuple]:
    """Within one block: equal surroundings settle [lo, hi) for all their members, and one of them goes on.

    A name with many classes in this block (a common passage in ever new surroundings) is dealt out by its surroundings,
    marked SALTED, and one MARKER goes to the name's own bucket, so that no bucket gets all of a hot name.
    """
    order, members, n_classes, first = _classes(name, around)
    name, around, k1, k2, at, lo, hi = (x[order] for x in (name, around, k1, k2, at, lo, hi))
    many = members > 1
    out = bl.spans(k1[many], k2[many], lo[many], hi[many], bl.SETTLED, n_buckets)
    name, around, k1, k2, at, n_classes = (x[first] for x in (name, around, k1, k2, at.astype(np.uint32), n_classes))
    hot = n_classes > bl.HOT
    marker = hot & np.append(True, name[1:] != name[:-1])[:len(name)]
    to = np.where(hot, bl.salted(name, around, k1, at), name)
    records = [np.concatenate([x, x[marker]]) for x in (name, around, k1, k2, at)]
    records[1][len(name):] = 0
    mark = np.concatenate([np.where(hot, SALTED, 0), np.full(int(marker.sum()), MARKER)]).astype(np.uint8)
    return out + bl.route(np.concatenate([to, name[marker]]), [*records, mark], n_buckets)


RECORD = "u8 u8 i8 i8 u4 u1"
SALTED, MARKER = 1, 2


def _compare(before: int, after: int, n_buckets: int) -> Callable[[list[bytes]], list[tuple]]:
    """Records of equal names meet: equal surroundings settle [at - before, at + after); of a group with several classes, one
    member of each class asks on for the strings that start in [at - before, at]."""
    def run(blobs: list[bytes]) -> list[tuple]:
        name, around, k1, k2, at, mark = bl.unpack_all(blobs, RECORD)
        order, members, n_classes, first = _classes(name, around)
        k1, k2, at, mark = (x[order] for x in (k1, k2, at, mark))
        at = at.astype(np.int64)
        lo, settled = np.maximum(at - before, 0), (members > 1) & (around[order] != 0)
        out = bl.spans(k1[settled], k2[settled], lo[settled], at[settled] + after, bl.SETTLED, n_buckets)
        ask = first & ((n_classes > 1) | (mark == SALTED)) & (mark != MARKER)
        return out + bl.spans(k1[ask], k2[ask], lo[ask], at[ask] + 1, bl.ASKED, n_buckets)

    return run


def _equal(width: int, n_buckets: int) -> Callable[[list[bytes]], list[tuple]]:
    """Records of the whole strings meet: equal neighbours are repeats."""
    def run(blobs: list[bytes]) -> list[tuple]:
        a, b, k1, k2, at, _ = bl.unpack_all(blobs, RECORD)
        order, cuts = bl.split_by([a, b])
        size = np.diff(cuts)
        hit = np.repeat(size, size) > 1
        k1, k2, at = (x[order][hit] for x in (k1, k2, at))
        at = at.astype(np.int64)
        return bl.spans(k1, k2, at, at + width, bl.SETTLED, n_buckets)

    return run


def _ends(starts: np.ndarray) -> np.ndarray:
    return np.repeat(starts[1:], np.diff(starts))


def _anchor_map(width: int, n_buckets: int):
    gram = max(1, width // GRAM_SHARE)
    before, after = width - gram, width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in bl.blocks(batches, max_bytes=BLOCK_BYTES):
            names = Names(byte_table()[data])
            ends = _ends(starts)
            grams = names.all(gram)
            at = anchors(grams, ends, gram, width)
            doc = np.searchsorted(starts, at, "right") - 1
            lo, hi = at - before, at + after
            whole = (lo >= starts[doc]) & (hi <= starts[doc + 1])
            around = np.zeros(len(at), np.uint64)
            around[whole] = names.of(lo[whole], before + after)
            k1, k2, rel = bl.ints(batch, "k1")[doc], bl.ints(batch, "k2")[doc], at - starts[doc]
            yield from bl.rows(_combine(grams[at], around, k1, k2, rel, np.maximum(rel - before, 0), rel + after, n_buckets))

    return run


def _cover_map(width: int, n_buckets: int):
    short, reach = width - MODULUS + 1, MODULUS - 1
    sampled = np.zeros(MODULUS, bool)
    sampled[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in bl.blocks(batches, max_bytes=BLOCK_BYTES):
            out = bl.passed(batch, n_buckets)
            if len(data):
                names, ends = Names(byte_table()[data]), _ends(starts)
                at = np.flatnonzero(bl.cover(batch, "asked", starts, len(data), reach))
                doc = np.searchsorted(starts, at, "right") - 1
                keep = sampled[(at - starts[doc]) % MODULUS] & (at + short <= ends[at])
                at, doc = at[keep], doc[keep]
                lo, hi = at - reach, at + width
                whole = (lo >= starts[doc]) & (hi <= starts[doc + 1])
                around = np.zeros(len(at), np.uint64)
                around[whole] = names.of(lo[whole], reach + width)
                k1, k2, rel = bl.ints(batch, "k1")[doc], bl.ints(batch, "k2")[doc], at - starts[doc]
                out += _combine(names.of(at, short), around, k1, k2, rel, np.maximum(rel - reach, 0), rel + width, n_buckets)
            yield from bl.rows(out)

    return run


def _merge_map(width: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in bl.blocks(batches, max_bytes=BLOCK_BYTES):
            out = bl.passed(batch, n_buckets)
            if len(data):
                at = np.flatnonzero(bl.cover(batch, "asked", starts, len(data)))
                at = at[at + width <= _ends(starts)[at]]
                doc = np.searchsorted(starts, at, "right") - 1
                a, b = (Names(byte_table(f)[data], f).of(at, width) for f in (0, 1))
                k1, k2, rel = bl.ints(batch, "k1")[doc], bl.ints(batch, "k2")[doc], at - starts[doc]
                out += _combine(a, b, k1, k2, rel, rel, rel + width, n_buckets)
            yield from bl.rows(out)

    return run


def repeated_spans(docs: DataFrame, width: int) -> DataFrame:
    """(d1, d2, settled): byte ranges of documents (k1, k2, text, row, as from keyed()) that repeats of ``width`` bytes cover."""
    if width <= MODULUS:
        raise ValueError(f"width must be above {MODULUS}")
    n = bl.buckets(docs.sparkSession)
    gram = max(1, width // GRAM_SHARE)
    # every step takes all columns of docs, so that all read the same exchange
    found = bl.meet(docs.mapInArrow(_anchor_map(width, n), bl.ROUTED), n, _compare(width - gram, width, n))
    for step, compare in ((_cover_map, _compare(MODULUS - 1, width, n)), (_merge_map, _equal(width, n))):
        known = bl.by_document(found, n)
        with_text = docs.join(known.hint("shuffle_hash"), (docs.k1 == known.d1) & (docs.k2 == known.d2)).select(
            "k1", "k2", F.when(F.col("asked").isNotNull(), F.col("text")).otherwise("").alias("text"), "settled", "asked", "row")
        found = bl.meet(with_text.mapInArrow(step(width, n), bl.ROUTED), n, compare)
    return bl.by_document(found, n).select("d1", "d2", "settled")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 400, keep_text: bool = True) -> DataFrame:
    """All rows of docs with: n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, spans (array of start and end
    bytes) and, with keep_text, kept_text (the remaining bytes; a character that is cut through is dropped from kept_text only).

    Null and empty texts, and texts shorter than width, keep everything. Repeated rows are copies of each other: all
    of their bytes go if they have width bytes. Null ids are ids like any other. An empty table gives an empty result. Input
    columns with the names of results are replaced.
    """
    spark = docs.sparkSession
    bl.prepare(spark)
    new = StructType([StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()),
                      StructField("kept_sha256", StringType()),
                      StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())])))])
    if keep_text:
        new = new.add("kept_text", StringType())
    rest = [c for c in docs.columns if c not in new.names and c != text_col]
    n = bl.buckets(spark)
    text = bl.keyed(docs, id_col, text_col).select("k1", "k2", "text", F.struct(*[f"row.`{c}`" for c in rest]).alias("row")).repartition(n, "k1", "k2")
    known = repeated_spans(text, width)
    joined = text.join(known.hint("shuffle_hash"), (text.k1 == known.d1) & (text.k2 == known.d2), "left").select("text", "settled", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in bl.blocks(batches, max_bytes=BLOCK_BYTES):
            gone = bl.cover(batch, "settled", starts, len(data))
            first = np.zeros(len(data) + 1, bool)
            first[starts] = True
            rise = gone & (~np.concatenate([[False], gone])[:-1] | first[:-1]) if len(data) else gone
            fall = gone & (~np.concatenate([gone, [False]])[1:] | first[1:]) if len(data) else gone
            n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[starts])
            begin, end = np.flatnonzero(rise), np.flatnonzero(fall) + 1
            cut = np.searchsorted(begin, starts)
            sha, kept, found = [], [], []
            for i in range(batch.num_rows):
                a, b = starts[i], starts[i + 1]
                rest_of = data[a:b] if not n_removed[i] else data[a:b][~gone[a:b]]
                sha.append(hashlib.sha256(rest_of).hexdigest())
                if keep_text:
                    kept.append(rest_of.tobytes().decode("utf-8", "ignore"))
                found.append([{"start": int(s - a), "end": int(e - a)} for s, e in zip(begin[cut[i]:cut[i + 1]], end[cut[i]:cut[i + 1]], strict=True)])
            columns = [batch.column("row"), pa.array(np.diff(starts)), pa.array(n_removed.astype(np.int64)), pa.array(np.diff(cut).astype(np.int64)), pa.array(sha, pa.string()),
                       pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))] + ([pa.array(kept, pa.string())] if keep_text else [])
            yield pa.RecordBatch.from_arrays(columns, names=["row", *new.names])

    out = joined.mapInArrow(run, StructType([StructField("row", joined.schema["row"].dataType), *new.fields]))
    return out.select("row.*", *new.names)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
