"""A training corpus from documents, in five stages; each takes the table that the one before it wrote.

Quality rules (rejected documents go), near-duplicates by five-word shingles (the least id of a group stays), repeated byte
strings (removed from the texts; texts left empty go), benchmark passages (documents that hold one go), packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import blocks, decontaminate, near_dedup, packing, quality_rules, suffix_dedup
from vigil.session import scratch_path

#: The stages learn, link and count on the way; SQL expresses none of them, so they are tested against brute force.
ORACLE_SQL = None


#: Words whose tokens a worker remembers while it packs: workers live on beside the other stages.
PACK_CACHE_WORDS = 200_000


def _held(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one: an operator's result columns then can't take the place of an input's."""
    return docs.select("doc_id", "text", F.struct(*[f"`{c}`" for c in docs.columns if c != "text"]).alias("_row"))


def _as_before(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged; the rules are learned from ``labels`` of these documents.

    Null and empty texts have no words and are rejected. Repeated rows are judged alike, null ids don't matter. An empty table gives
    an empty result. All columns stay, also those named like a statistic.
    """
    blocks.prepare(spark)
    rules = quality_rules.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _as_before(quality_rules.judge(_held(docs), rules).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles at a similarity of 0.8, unchanged.

    Null and empty texts are linked with nothing and stay. Repeated rows are copies: one stays. Rows without an id are judged one
    by one like others. An empty table gives an empty result. All columns stay.
    """
    return _as_before(near_dedup.one_of_each(_held(docs), size=5), docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 400-byte strings that start more than once in the table, n_chars counted anew; texts that lose all but
    white space go.

    Null and empty texts stay, a null as an empty text. Repeated rows lose what they share. An empty table gives an empty result.
    All columns stay.
    """
    out = suffix_dedup.remove_repeats(_held(docs)).withColumn("text", F.col("kept_text")).where("n_removed = 0 or trim(text) <> ''")
    n_chars = F.char_length("text").cast("long")
    out = _as_before(out, docs)
    return out.withColumn("n_chars", n_chars) if "n_chars" in docs.columns else out


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage near an item of ``benchmark``, unchanged.

    Null and empty texts hold none and stay. Repeated rows are judged alike. An empty table, or no items, changes nothing. All columns stay.
    """
    return _as_before(decontaminate.decontaminated(_held(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of at most 2048 tokens (see packing.pack); doc_id of each.

    Null and empty texts are one end token. Repeated rows are packed each. An empty table gives an empty result. Other columns go.
    """
    return packing.pack(docs.select("doc_id", "text"), keep_tokens=False, cache_words=PACK_CACHE_WORDS)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("suffix-array dedup", repeated_strings), ("benchmark decontamination", benchmark_passages), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs, name = spark.read.parquet(f"{sf_dir}/documents.parquet"), uuid.uuid4().hex
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{name}-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
