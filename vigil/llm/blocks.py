"""Text as numpy blocks inside Arrow tasks, and byte blobs routed to hash buckets.

A block is the UTF-8 bytes of several whole documents laid end to end; a task handles one block
at a time, so its memory is bounded by ``MAX_BYTES`` (or by one document, where that is longer).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rolling import mix

MAX_BYTES = 4 << 20
#: A smaller block, for steps that hold many 64-bit numbers per byte: it bounds what a Python worker takes and keeps.
SMALL_BYTES = 1 << 19
#: Rows and bytes of one Arrow batch.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20

ROUTED = "bucket int, kind int, blob binary"
#: kind of a routed row: records for the bucket of their name; for the bucket of their document, settled ranges, ranges
#: still to be looked at, and other records of documents. A task sends at most one row of a kind to a bucket and block.
NAMES, SETTLED, ASKED, OTHER = 9, 0, 1, 2
RANGES = "i8 i8 u4 u4"


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python tasks by rows and by bytes."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def buckets(spark: SparkSession) -> int:
    """Number of hash buckets: one for each shuffle partition, so it follows the cluster's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, id, text, row): a 128-bit key of (id, text), the text with null as empty, and all columns as a struct.

    Rows that agree in id and text share a key and get the same answer; every stage counts occurrences,
    not keys, so they still count as copies of each other.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    ident = F.col(f"`{id_col}`").cast("string")
    return docs.select(
        F.xxhash64(ident, F.lit("a"), text).alias("k1"), F.xxhash64(text, F.lit("b"), ident).alias("k2"),
        F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.struct("*").alias("row"))


def texts(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): the column's UTF-8 bytes end to end; document i is bytes[starts[i]:starts[i + 1]]."""
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    body = col.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0]:offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = MAX_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in slices of whole documents, at most max_bytes of text or one document each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, starts = texts(batch, column)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(starts, starts[at] + max_bytes, "right")) - 1
            to = max(to, at + 1)
            part = batch.slice(at, to - at)
            yield part, *texts(part, column)
            at = to


def ints(batch: pa.RecordBatch, column: str, null: int = 0) -> np.ndarray:
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null(null)
    return col.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns one after the other; unpack() knows their types."""
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpack(blob: bytes, types: str) -> list[np.ndarray]:
    kinds = [np.dtype(t) for t in types.split()]
    n, out, at = len(blob) // sum(k.itemsize for k in kinds), [], 0
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += n * k.itemsize
    return out


def unpack_all(blobs: list[bytes], types: str) -> list[np.ndarray]:
    parts = [unpack(b, types) for b in blobs]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in types.split()]


def split_by(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): a stable order that groups equal keys, and where each group starts in it (with the end)."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order, np.append(np.flatnonzero(new), len(order))


#: A name with more classes than this in one block is hot: its records are dealt out by what they hold besides the name.
HOT = 8


def salted(name: np.ndarray, around: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names for routing: equal (name, around) stay together; records without surroundings spread by place."""
    own = mix(key.astype(np.uint64) * np.uint64(31) + at.astype(np.uint64))
    return mix(name * np.uint64(31) + np.where(around == 0, own, around))


def route(name: np.ndarray, columns: list[np.ndarray], n_buckets: int) -> list[tuple]:
    """ROUTED rows of kind NAMES: records go to the bucket of their name."""
    if not len(name):
        return []
    bucket = ((name >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)
    order, cuts = split_by([bucket])
    columns = [c[order] for c in columns]
    return [(int(bucket[order[a]]), NAMES, pack([c[a:b] for c in columns])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def spans(k1: np.ndarray, k2: np.ndarray, lo: np.ndarray, hi: np.ndarray, kind: int, n_buckets: int) -> list[tuple]:
    """ROUTED rows of one kind with the ranges [lo, hi) of each document, overlapping ones merged."""
    if not len(k1):
        return []
    order = np.lexsort((lo, k2, k1))
    k1, k2, lo, hi = k1[order], k2[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    doc = np.zeros(len(k1), np.int64)
    doc[1:] = np.cumsum((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
    wide = int(hi.max()) + 1  # documents set apart, so that one running maximum serves all
    reach = np.maximum.accumulate(hi + doc * wide)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] + doc[1:] * wide > reach[:-1]
    first = np.flatnonzero(new)
    ends = reach[np.append(first[1:], len(lo)) - 1] - doc[first] * wide
    starts, k1, k2 = lo[first], k1[first], k2[first]
    return to_documents([k1, k2, starts.astype(np.uint32), ends.astype(np.uint32)], kind, n_buckets)


def to_documents(columns: list[np.ndarray], kind: int, n_buckets: int) -> list[tuple]:
    """ROUTED rows of records that begin with the document's k1 and k2, for the document's bucket."""
    bucket = columns[0] % n_buckets
    order, cuts = split_by([bucket])
    columns = [c[order] for c in columns]
    return [(int(bucket[order[a]]), kind, pack([c[a:b] for c in columns])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


ROUTED_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def rows(found: list[tuple], schema: pa.Schema = ROUTED_ARROW) -> Iterator[pa.RecordBatch]:
    """Record batches of the tuples, some thousands of rows each."""
    for at in range(0, len(found), 5000):
        part = found[at:at + 5000]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


def meet(df: DataFrame, n_buckets: int, fn: Callable[[list[bytes]], list[tuple]]) -> DataFrame:
    """ROUTED rows by bucket: fn gets the blobs of kind NAMES of one bucket and returns ROUTED rows; other kinds pass through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for batch in batches:
            names = batch.column("kind").to_numpy(zero_copy_only=False) == NAMES
            blobs += batch.column("blob").filter(pa.array(names)).to_pylist()
            if not names.all():
                yield batch.filter(pa.array(~names))
        if blobs:
            yield from rows(fn(blobs))

    return df.repartitionById(n_buckets, F.col("bucket")).mapInArrow(run, ROUTED)


DOCUMENTS = "d1 long, d2 long, settled binary, asked binary, other binary"
DOCUMENTS_ARROW = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("settled", pa.binary()), ("asked", pa.binary()), ("other", pa.binary())])


def by_document(found: DataFrame, n_buckets: int, other: str = "i8 i8 u4") -> DataFrame:
    """One row per document that has any: its records of each kind (without the keys) in one blob. other: types of the kind OTHER."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {SETTLED: [], ASKED: [], OTHER: []}
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                blobs[kind].append(blob)
        out: dict[tuple[int, int], list] = {}
        for kind, parts in blobs.items():
            columns = unpack_all(parts, other if kind == OTHER else RANGES)
            order, cuts = split_by(columns[:2])
            k1, k2, *rest = (c[order] for c in columns)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                out.setdefault((int(k1[a]), int(k2[a])), [None, None, None])[kind] = pack([c[a:b] for c in rest])
        yield from rows([(*key, *values) for key, values in out.items()], DOCUMENTS_ARROW)

    return found.repartitionById(n_buckets, F.col("bucket")).mapInArrow(run, DOCUMENTS)


def cover(batch: pa.RecordBatch, column: str, starts: np.ndarray, size: int, widen: int = 0) -> np.ndarray:
    """Boolean mask over a block: inside the ranges that the column lists for each document (widen: that much longer), cut at document ends."""
    edge = np.zeros(size + 1, np.int32)
    for i, blob in enumerate(batch.column(column).to_pylist()):
        if blob:
            lo, hi = unpack(blob, "u4 u4")
            top = starts[i + 1]
            np.add.at(edge, np.minimum(starts[i] + lo, top), 1)
            np.add.at(edge, np.minimum(starts[i] + hi + widen, top), -1)
    return np.cumsum(edge[:-1]) > 0


def passed(batch: pa.RecordBatch, n_buckets: int) -> list[tuple]:
    """The settled ranges that came with the documents, as ROUTED rows."""
    blobs = batch.column("settled").to_pylist()
    some = [i for i, b in enumerate(blobs) if b]
    lo, hi = unpack_all([blobs[i] for i in some], "u4 u4")
    doc = np.repeat(np.array(some, np.int64), [len(blobs[i]) // 8 for i in some])
    return spans(ints(batch, "k1")[doc], ints(batch, "k2")[doc], lo, hi, SETTLED, n_buckets)
