"""Packing documents into sequences of a fixed number of tokens: best-fit decreasing with certified bounds.

Each partition of documents is packed by best-fit decreasing. Dual feasible functions give a lower bound of its number of bins; a
partition that reaches its bound is certified and settles all but its emptiest bin. The others settle their full bins and
exchange the rest: it is dealt out again, with what others gave, over fewer partitions, and packed anew, until one
partition is left or nothing more settles.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import scratch_path

from . import blocks as bl

#: Name of the vocabulary among the installed public tokenizers, where no path is given.
TOKENIZER = "word_bpe_49k.json"
CAPACITY, END = 2048, 0
#: Tokens that one partition packs.
PARTITION_TOKENS = 1 << 24
#: Words whose tokens a Python worker remembers (some 180 bytes each, kept for its next tasks); above that it starts anew.
CACHE_WORDS = 1_500_000
ROUNDS = 8


@lru_cache(2)
def _tokenizer(path: str | None):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))


_CACHE: dict[str | None, dict[bytes, bytes]] = {}


def token_ids(path: str | None, texts: list[list[bytes]], cache_words: int = CACHE_WORDS) -> list[bytes]:
    """Token ids of texts given as words, as little-endian 32-bit numbers. This tokenizer drops white space and never joins across
    it, so a text's ids are its words' ids, and a worker tokenizes a word once."""
    known = _CACHE.setdefault(path, {})
    if len(known) > cache_words:
        known.clear()
    new = list(set().union(*texts) - known.keys())
    for at in range(0, len(new), 10_000):
        part = new[at:at + 10_000]
        for w, e in zip(part, _tokenizer(path).encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()
    return [b"".join([known[w] for w in words]) for words in texts]


def _tokenize(path: str | None, capacity: int, keep_tokens: bool, cache_words: int = CACHE_WORDS):
    end, step = np.array([END], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in bl.blocks(batches):
            raw = data.tobytes()
            texts = [raw[a:b].split() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            out: list[list] = [[], [], [], [], [], []]
            for i, ids in enumerate(token_ids(path, texts, cache_words)):
                mine = ids + end
                for piece, a in enumerate(range(0, len(mine), step)):
                    part = mine[a:a + step]
                    for to, v in zip(out, (i, piece, a // 4, len(part) // 4, zlib.crc32(part), part if keep_tokens else None), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:5]), pa.array(out[5], pa.binary())],
                                             names=["row", "piece", "start", "length", "ids_crc32", "tokens"])

    return run


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item. Open bins are kept by free room; one bit per room says whether there is any."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.zeros(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, n = 0, 0
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = open_ >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ &= ~(1 << r)
        else:
            r, b, n = capacity, n, n + 1
        bins[i] = b
        if r > s:
            room[r - s].append(b)
            open_ |= 1 << (r - s)
    return bins


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best of the volume bound and the bounds of two families of dual feasible functions (Fekete and Schepers): items above
    capacity - k count whole and those of at most k not at all; and sizes rounded to k + 1 parts."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)
    s = np.arange(capacity + 1)
    best = -(-int(sizes.sum()) // capacity)
    for k in range(1, capacity // 2 + 1):
        whole = int(count[capacity - k + 1:].sum())
        between = int((count * s)[k:capacity - k + 1].sum())
        best = max(best, whole + -(-between // capacity))
    for k in range(1, 21):  # u(k): x where x(k + 1) is whole, else floor((k + 1)x) / k
        scaled = (k + 1) * s
        value = np.where(scaled % capacity == 0, k * s / capacity, scaled // capacity) * count
        best = max(best, int(np.ceil(value.sum() / k - 1e-9)))
    return best


def _pack(capacity: int, number: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).drop_columns(["bucket"]).combine_chunks()
        sizes = table.column("length").to_numpy()
        order = np.lexsort((table.column("own").to_numpy(), sizes))
        table, sizes = table.take(pa.array(order)), sizes[order]
        bins = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(bins, sizes).astype(np.int64)
        if last:
            settled = np.ones(len(fill), bool)
        elif len(fill) == lower_bound(sizes, capacity):
            settled = np.ones(len(fill), bool)
            settled[fill.argmin()] = fill.min() == capacity
        else:
            settled = fill == capacity
        by_bin = np.argsort(bins, kind="stable")
        before = np.concatenate([[0], np.cumsum(sizes[by_bin])])[:-1]
        first = np.concatenate([[0], np.cumsum(np.bincount(bins))])[:-1]
        offset = np.zeros(len(bins), np.int64)
        offset[by_bin] = before - np.repeat(before[first], np.bincount(bins))
        ids = (np.int64(number) << 48) + (np.int64(TaskContext.get().partitionId()) << 24) + bins
        done = settled[bins]
        table = table.append_column("sequence_id", pa.array(ids, mask=~done)).append_column("offset", pa.array(offset, mask=~done))
        yield from table.to_batches(max_chunksize=bl.BATCH_ROWS)

    return run


def pack(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, keep_tokens: bool = True, partition_tokens: int = PARTITION_TOKENS, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: docs' columns without the text, piece, start, length, ids_crc32, sequence_id, offset and, with
    keep_tokens, tokens (little-endian unsigned 32-bit ids).

    ``tokenizer`` is the path of a vocabulary file, or None for the installed one. A document is its tokens and the id 0; only documents of more than ``capacity`` are cut. Null and empty texts are the one id 0.
    Repeated rows are packed each. An empty table gives an empty result. Input columns with the names of results are replaced.
    ``cache_words`` weighs a worker's memory against its time and changes no result.
    """
    spark = docs.sparkSession
    bl.prepare(spark)
    new = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", "tokens"]
    rest = [c for c in docs.columns if c not in new and c != text_col]
    held = docs.select(F.struct(*[f"`{c}`" for c in rest]).alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = f"row {held.schema['row'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, tokens binary"
    name = f"pack-{uuid.uuid4().hex}"

    def written(df: DataFrame, part: str) -> DataFrame:
        df.write.parquet(path := scratch_path(spark, f"{name}-{part}"))
        return spark.read.schema(df.schema).parquet(path)

    pool = written(held.mapInArrow(_tokenize(tokenizer, capacity, keep_tokens, cache_words), kind).withColumn("own", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    done = []
    before = -1
    for number in range(ROUNDS):
        tokens = pool.agg(F.sum("length")).first()[0] or 0
        n = max(1, -(-tokens // partition_tokens))
        last = n == 1 or number == ROUNDS - 1 or tokens == before
        before = tokens
        dealt = pool.withColumn("bucket", F.pmod(F.xxhash64("own", F.lit(number)), F.lit(n)).cast("int")).repartitionById(n, F.col("bucket"))
        packed = written(dealt.mapInArrow(_pack(capacity, number, last), f"{kind}, own long, sequence_id long, offset long"), f"round{number}")
        done.append(packed.where("sequence_id is not null"))
        if last:
            break
        pool = packed.where("sequence_id is null").drop("sequence_id", "offset")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select("row.*", *(new if keep_tokens else new[:-1]))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_tokens=False)
