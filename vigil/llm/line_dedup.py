"""Reversible line de-duplication: exact reference counts of lines in shards, with a cuckoo filter over each shard's frequent lines.

A line's key is the line without ASCII white space at both ends and with A-Z in lower case; its name is the key's 128-bit
hash. The index counts, for each name, the documents that hold the line. Lines held by ``min_docs`` documents are frequent: their
names are in the cuckoo filter of their shard, which supports deletion, so inserting and deleting documents moves lines in and out
as their counts pass the threshold. Every update writes a new version of the index; an old one stays readable.

Counting adds up names within a task, so a line that a third of all documents hold leaves a task once. To drop lines,
documents are dealt to buckets; each bucket sends its names once to the shards, which pass them through the filter, confirm
what passes by the exact counts, and send the frequent ones back to the bucket.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from vigil.session import scratch_path

from . import blocks as bl

SPACE = b" \t\n\x0b\x0c\r"
#: Names that a task gathers before it sends them on.
FLUSH = 400_000
#: Names that a shard counts at most on average; with more, the next version has more shards.
SHARD_NAMES = 1 << 20
#: Bytes of text in a bucket of documents, on average.
BUCKET_BYTES = 16 << 20

#: kind of a row on its way to a shard: names with changes of their counts, counts so far, the shard's filter, frequent
#: names, and names that a bucket asks for.
CHANGE, KNOWN, FILTER, FREQUENT, ASKED = 0, 1, 2, 3, 4
SENT = "shard int, kind int, bucket int, blob binary"
SENT_ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
COUNTS, FILTERS = 0, 1
STATE = "kind int, shard int, k1 long, k2 long, n long, held long, slots binary"
STATE_ARROW = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("held", pa.int64()), ("slots", pa.binary())])


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # bytes: A-Z only


def line_names(text: bytes, min_chars: int) -> list[bytes | None]:
    """The name of each line, None for keys that are too short to count."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line_key(line)
        enough = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if enough else None)
    return out


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each has two buckets, either computed from the other and the fingerprint."""

    SLOTS, KICKS = 4, 500

    def __init__(self, n_buckets: int, slots: np.ndarray | None = None):
        self.mask = n_buckets - 1
        self.slots = np.zeros((n_buckets, self.SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def read(cls, blob: bytes) -> CuckooFilter:
        slots = np.frombuffer(blob, np.uint16).reshape(-1, cls.SLOTS).copy()
        return cls(len(slots), slots)

    @classmethod
    def holding(cls, names: np.ndarray) -> CuckooFilter:
        """A filter of the least fitting size."""
        n = 1 << max(0, int(len(names) / (0.8 * cls.SLOTS)).bit_length())
        while not (out := cls(n)).insert(names):
            n *= 2
        return out

    def places(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names = names.astype(np.uint64)
        mark = (names % np.uint64(65535) + np.uint64(1)).astype(np.int64)
        first = (names >> np.uint64(32)).astype(np.int64) & self.mask
        return mark, first, self.other(first, mark)

    def other(self, place, mark):
        return (place ^ (mark * 0x5BD1E995 >> 7)) & self.mask

    def contains(self, names: np.ndarray) -> np.ndarray:
        mark, first, second = self.places(names)
        return (self.slots[first] == mark[:, None]).any(axis=1) | (self.slots[second] == mark[:, None]).any(axis=1)

    def insert(self, names: np.ndarray) -> bool:
        """False where there was no room: the filter is then to be built anew."""
        for m, a, b in zip(*(x.tolist() for x in self.places(names)), strict=True):
            if not (self._put(a, m) or self._put(b, m)):
                place = b
                for kick in range(self.KICKS):
                    slot = (m + kick) % self.SLOTS
                    m, self.slots[place, slot] = int(self.slots[place, slot]), m
                    place = self.other(place, m)
                    if self._put(place, m):
                        break
                else:
                    return False
        return True

    def _put(self, place: int, mark: int) -> bool:
        for i in range(self.SLOTS):
            if not self.slots[place, i]:
                self.slots[place, i] = mark
                return True
        return False

    def delete(self, names: np.ndarray) -> None:
        """Only names that were inserted."""
        for m, a, b in zip(*(x.tolist() for x in self.places(names)), strict=True):
            for place in (a, b):
                at = np.flatnonzero(self.slots[place] == m)
                if len(at):
                    self.slots[place, at[0]] = 0
                    break

    def __len__(self) -> int:
        return int((self.slots > 0).sum())


def _split(names: np.ndarray, n_shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, which) of names given as rows of two numbers."""
    shard = (names[:, 1].view(np.uint64) % np.uint64(n_shards)).astype(np.int64)
    order, cuts = bl.split_by([shard])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(shard[order[a]]), order[a:b]


def _pairs(names: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)


def _counted(names: np.ndarray, n: np.ndarray, n_shards: int, kind: int) -> list[tuple]:
    return [(shard, kind, 0, bl.pack([names[at, 0], names[at, 1], n[at]])) for shard, at in _split(names, n_shards)]


def _grouped(k1: np.ndarray, k2: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order, cuts = bl.split_by([k1, k2])
    at = order[cuts[:-1]]
    return k1[at], k2[at], np.add.reduceat(n[order], cuts[:-1]) if len(at) else n


def _text(docs: DataFrame, text_col: str):
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


@dataclass(frozen=True)
class LineIndex:
    """One version of the index. Every row of a table counts as a document, whatever its id; a null text is empty."""

    spark: SparkSession
    path: str
    version: int
    n_shards: int
    n_names: int
    min_docs: int
    min_chars: int

    @classmethod
    def create(cls, spark: SparkSession, path: str, min_docs: int = 10, min_chars: int = 1) -> LineIndex:
        """An empty index under a path that all executors see. Lines of fewer than min_chars (1 or more) code points never count."""
        if min_docs < 1 or min_chars < 1:
            raise ValueError("min_docs and min_chars must be 1 or more")
        return cls(spark, path, 0, bl.buckets(spark), 0, min_docs, min_chars)._noted()

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int) -> LineIndex:
        row = spark.read.parquet(f"{path}/meta-{version}").first()
        return cls(spark, path, version, row.n_shards, row.n_names, row.min_docs, row.min_chars)

    def _noted(self) -> LineIndex:
        row = [(self.version, self.n_shards, self.n_names, self.min_docs, self.min_chars)]
        self.spark.createDataFrame(row, "version int, n_shards int, n_names long, min_docs int, min_chars int").write.mode("overwrite").parquet(f"{self.path}/meta-{self.version}")
        return self

    def _state(self, kind: int) -> DataFrame:
        read = self.spark.read.schema(STATE)
        empty = self.spark.createDataFrame([], STATE)
        return read.parquet(f"{self.path}/state-{self.version}").where(F.col("kind") == kind) if self.version else empty

    def counts(self) -> DataFrame:
        """k1, k2 (the name) and n, the documents that hold the line."""
        return self._state(COUNTS).select("k1", "k2", "n")

    def filters(self) -> DataFrame:
        """shard, held (fingerprints) and slots of each filter that holds any."""
        return self._state(FILTERS).select("shard", "held", "slots")

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """The next version, with these documents counted."""
        return self._updated(docs, text_col, 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """The next version, without these documents. Fails if a line's count would fall below 0: they weren't all inserted."""
        return self._updated(docs, text_col, -1)

    def _updated(self, docs: DataFrame, text_col: str, sign: int) -> LineIndex:
        bl.prepare(self.spark)
        min_docs, min_chars = self.min_docs, self.min_chars
        text = _text(docs, text_col)
        lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
        n_shards = max(self.n_shards, -(-(self.n_names + lines) // SHARD_NAMES)) if sign > 0 else self.n_shards
        same = n_shards == self.n_shards

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: Counter = Counter()

            def sent() -> Iterator[pa.RecordBatch]:
                if known:
                    n = sign * np.fromiter(known.values(), np.int64, len(known))
                    yield from bl.rows(_counted(_pairs(list(known)), n, n_shards, CHANGE), SENT_ARROW)
                    known.clear()

            for batch, data, starts in bl.blocks(batches):
                raw = data.tobytes()
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    names = set(line_names(raw[a:b], min_chars))
                    names.discard(None)
                    known.update(names)
                    if len(known) > FLUSH:
                        yield from sent()
            yield from sent()

        def resent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = np.column_stack([bl.ints(batch, "k1"), bl.ints(batch, "k2")])
                yield from bl.rows(_counted(names, bl.ints(batch, "n"), n_shards, KNOWN), SENT_ARROW)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            changes, known, held, shard = [], [], None, None
            for batch in batches:
                for s, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "blob")), strict=True):
                    shard = s
                    if kind == FILTER:
                        held = blob
                    else:
                        (changes if kind == CHANGE else known).append(blob)
            if shard is None:
                return
            old, new = bl.unpack_all(known, "i8 i8 i8"), _grouped(*bl.unpack_all(changes, "i8 i8 i8"))
            k1, k2, n = _grouped(*(np.concatenate(x) for x in zip(old, new, strict=True)))
            if len(n) and n.min() < 0:
                raise ValueError("a document was deleted that had not been inserted")
            frequent = k1[n >= min_docs]
            # what a change moves over the threshold, in either direction
            a1, a2, change = new
            pos = np.searchsorted(_packed(k1, k2), _packed(a1, a2))
            now = n[pos]
            up, down = a1[(now >= min_docs) & (now - change < min_docs)], a1[(now < min_docs) & (now - change >= min_docs)]
            cuckoo = CuckooFilter.read(held) if held else None
            if cuckoo is not None:
                cuckoo.delete(down)
            if cuckoo is None or not cuckoo.insert(up):
                cuckoo = CuckooFilter.holding(frequent)
            left = n > 0
            k1, k2, n = k1[left], k2[left], n[left]
            for at in range(0, len(n), 100_000):
                part = slice(at, at + 100_000)
                size = len(n[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, COUNTS, np.int32)), pa.array(np.full(size, shard, np.int32)), pa.array(k1[part]), pa.array(k2[part]), pa.array(n[part]), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary())], schema=STATE_ARROW)
            if len(frequent):
                yield from bl.rows([(FILTERS, shard, None, None, None, len(cuckoo), cuckoo.slots.tobytes())], STATE_ARROW)

        changed = docs.select(text.alias("text")).mapInArrow(count, SENT)
        sent = changed.union(self.counts().mapInArrow(resent, SENT))
        if same:  # filters belong to their number of shards
            sent = sent.union(self.filters().select("shard", F.lit(FILTER).alias("kind"), F.lit(0).alias("bucket"), F.col("slots").alias("blob")))
        after = replace(self, version=self.version + 1, n_shards=n_shards)
        sent.repartitionById(n_shards, F.col("shard")).mapInArrow(merge, STATE).write.mode("overwrite").partitionBy("kind").parquet(f"{self.path}/state-{after.version}")
        return replace(after, n_names=after.counts().count())._noted()

    def drop_lines(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """All rows of docs without the text, with n_lines (before dropping), n_dropped and kept_text: the lines, joined by newlines,
        that aren't frequent in the index. All lines of a frequent key go.

        Null and empty texts are one empty line, which is never frequent. Repeated rows are documents each, null ids don't matter.
        An empty table gives an empty result. Input columns with the names of results are replaced.
        """
        bl.prepare(self.spark)
        n_shards, min_docs, min_chars = self.n_shards, self.min_docs, self.min_chars
        new = ["n_lines", "n_dropped", "kept_text"]
        rest = [c for c in docs.columns if c not in new and c != text_col]
        size = docs.agg(F.sum(F.octet_length(_text(docs, text_col)) + 1)).first()[0] or 0
        n_buckets = max(bl.buckets(self.spark), -(-size // BUCKET_BYTES))
        # equal rows spread too; a scan numbers its rows the same way again
        bucket = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_buckets)).cast("int")
        held = docs.select(bucket.alias("bucket"), _text(docs, text_col).alias("text"), F.struct(F.lit(0).alias("_"), *[f"`{c}`" for c in rest]).alias("row")).repartition(bl.buckets(self.spark), "bucket")

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, set] = {}
            n = 0

            def sent() -> Iterator[pa.RecordBatch]:
                for bucket, names in found.items():
                    names.discard(None)
                    if names:
                        pairs = _pairs(list(names))
                        yield from bl.rows([(shard, ASKED, bucket, bl.pack([pairs[at, 0], pairs[at, 1]])) for shard, at in _split(pairs, n_shards)], SENT_ARROW)
                found.clear()

            for batch, data, starts in bl.blocks(batches):
                raw = data.tobytes()
                for bucket, a, b in zip(batch.column("bucket").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    mine = found.setdefault(bucket, set())
                    before = len(mine)
                    mine.update(line_names(raw[a:b], min_chars))
                    n += len(mine) - before
                    if n > FLUSH:
                        yield from sent()
                        n = 0
            yield from sent()

        def resent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = np.column_stack([bl.ints(batch, "k1"), bl.ints(batch, "k2")])
                yield from bl.rows([(shard, FREQUENT, 0, bl.pack([names[at, 0], names[at, 1]])) for shard, at in _split(names, n_shards)], SENT_ARROW)

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, frequent, cuckoo = [], [], None
            for batch in batches:
                for kind, bucket, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "blob")), strict=True):
                    if kind == FILTER:
                        cuckoo = CuckooFilter.read(blob)
                    elif kind == FREQUENT:
                        frequent.append(blob)
                    else:
                        asked.append((bucket, blob))
            if cuckoo is None:
                return
            exact = np.sort(_packed(*bl.unpack_all(frequent, "i8 i8")))
            out = []
            for bucket, blob in asked:
                k1, k2 = bl.unpack(blob, "i8 i8")
                maybe = cuckoo.contains(k1)
                k1, k2 = k1[maybe], k2[maybe]
                name = _packed(k1, k2)
                sure = exact[np.minimum(np.searchsorted(exact, name), len(exact) - 1)] == name
                if sure.any():
                    out.append((bucket, np.column_stack([k1[sure], k2[sure]]).tobytes()))
            yield from bl.rows(out, pa.schema([("bucket", pa.int32()), ("blob", pa.binary())]))

        known = self.filters().select("shard", F.lit(FILTER).alias("kind"), F.lit(0).alias("bucket"), F.col("slots").alias("blob"))
        exact = self.counts().where(F.col("n") >= min_docs).mapInArrow(resent, SENT)
        answers = held.mapInArrow(ask, SENT).union(known).union(exact).repartitionById(n_shards, F.col("shard")).mapInArrow(answer, "bucket int, blob binary")

        def cleaned(rows: pa.Table, answered: pa.Table) -> pa.Table:
            names = b"".join(answered.column("blob").to_pylist())
            frequent = {names[i:i + 16] for i in range(0, len(names), 16)}
            n_lines, n_dropped, kept = [], [], []
            for text in rows.column("text").cast(pa.large_binary()).to_pylist():
                lines = text.split(b"\n")
                stay = [line for line, name in zip(lines, line_names(text, min_chars), strict=True) if name not in frequent] if frequent else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            return pa.Table.from_arrays([rows.column("row"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary())], names=["row", *new])

        kind = StructType([StructField("row", held.schema["row"].dataType), StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept_text", BinaryType())])
        out = held.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(cleaned, kind)
        return out.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], "n_lines", "n_dropped", F.col("kept_text").cast("string").alias("kept_text"))


def _packed(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Names as one sortable column, in the order of (k1, k2)."""
    out = np.empty(len(k1), np.dtype([("a", "i8"), ("b", "i8")]))
    out["a"], out["b"] = k1, k2
    return out


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = LineIndex.create(spark, scratch_path(spark, f"lines-{uuid.uuid4().hex}"), min_docs=10, min_chars=1).insert(docs)
    return index.drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: op12 in SQL: keys by the same rule, documents counted by row.
OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
keyed AS (SELECT r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
judged AS (SELECT r, i, line, k IN (SELECT k FROM frequent) AS gone FROM keyed)
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged JOIN docs USING (r) GROUP BY r
"""
