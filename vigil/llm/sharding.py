"""Global shuffle into shards, in two passes over external storage.

Pass 1 scatters whole rows into memory-sized buckets by a seeded hash of the row and a seeded draw (so that repeated rows
spread too). Pass 2 shuffles each bucket in memory (Fisher-Yates, seeded by bucket) and writes it. The place of a row in the
concatenation of the buckets then deals it to a shard, so that shards differ by one row at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.session import scratch_path

from . import blocks as bl

#: Bytes (of the rows as JSON) and rows that a bucket holds on average at most; a task shuffles one bucket in memory.
BUCKET_BYTES, BUCKET_ROWS = 32 << 20, 1 << 18


def shuffle_order(n: int, seed: int, bucket: int) -> np.ndarray:
    """Fisher-Yates: a permutation of n places, the same for the same seed and bucket."""
    rng = np.random.default_rng([seed, bucket])
    order = np.arange(n)
    other = (rng.random(n) * (np.arange(n) + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = other[i]
        order[i], order[j] = order[j], order[i]
    return order


def shuffled_shards(docs: DataFrame, n_shards: int, seed: int = 17, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of docs, written in shuffled order, with shard (0 to n_shards - 1) and slot (place in the shard, gapless from 0).

    Sizes of the shards differ by one row at most. Nulls, empty texts and repeated rows are rows like any other. An empty
    table gives an empty result. Input columns with the names of results are replaced. Buckets follow the bytes of whole rows and
    the number of rows, so text_col no longer matters.
    """
    spark = docs.sparkSession
    bl.prepare(spark)
    rest = [c for c in docs.columns if c not in ("shard", "slot")]
    held = docs.select(F.struct(*[f"`{c}`" for c in rest]).alias("row"))
    total, n_rows = held.agg(F.coalesce(F.sum(F.octet_length(F.to_json("row"))), F.lit(0)), F.count("*")).first()
    n_buckets = max(1, -(-total // bucket_bytes), -(-n_rows // BUCKET_ROWS), min(bl.buckets(spark), -(-total // (1 << 20))))
    own = F.pmod(F.xxhash64(F.lit(seed), F.to_json("row")) + (F.rand(seed) * (1 << 30)).cast("long"), F.lit(n_buckets)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        bucket = table.column("bucket")[0].as_py()
        # rows come in any order from the exchange: a fixed one first
        keys = np.array(table.column("own").to_pylist(), np.int64)
        table = table.take(pa.array(np.argsort(keys, kind="stable")))
        order = shuffle_order(table.num_rows, seed, bucket)
        for at in range(0, len(order), bl.BATCH_ROWS):
            part = table.take(pa.array(order[at:at + bl.BATCH_ROWS])).combine_chunks()
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([part.column("bucket").chunk(0), pa.array(np.arange(at, at + n)), part.column("row").chunk(0)], names=["bucket", "place", "row"])

    scattered = held.select(own.alias("bucket"), F.xxhash64(F.lit(seed + 1), F.to_json("row")).alias("own"), "row").repartitionById(n_buckets, F.col("bucket"))
    kind = held.schema["row"].dataType.simpleString()
    path = scratch_path(spark, f"shards-{uuid.uuid4().hex}")
    scattered.mapInArrow(run, f"bucket int, place long, row {kind}").write.parquet(path)
    written = spark.read.parquet(path)
    # one row per bucket: rows before it
    sizes = written.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    if n_buckets <= 100_000:  # a table of one row per bucket, of two numbers
        before = F.broadcast(before)
    place = F.col("before") + F.col("place")
    return written.join(before, "bucket").select("row.*", F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"), F.expr(f"(before + place) div {n_shards}").alias("slot"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return shuffled_shards(docs, 16).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
