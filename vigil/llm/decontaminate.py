"""Benchmark decontamination in DataFrame functions only: SimHash fingerprints of item-sized windows, multi-index Hamming
join, exact weighted similarity.

A text is its lower-cased words (white space and ASCII punctuation separate them), a shingle the hash of five words (of all
words, for shorter items). A window is as long as a benchmark item (as the whole text, if that is shorter). All windows count that hold as
many shingles of items of their size as the similarity needs, in whatever order they stand there; a window with fewer can't be similar.
Windows and items of one size meet if their 64-bit SimHashes agree in one of 8 bytes but for ERRORS bits, which
finds all within 8 * (ERRORS + 1) - 1 bits. What meets and lies within that distance is verified by the weighted Jaccard similarity of
the shingles with their counts.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, SIMILARITY, ERRORS = 5, 0.8, 2
RADIUS = 8 * (ERRORS + 1) - 1
#: Distinct shingles of benchmark items that one pass over the texts compares with; a larger benchmark takes several passes.
PASS_SHINGLES = 50_000
MASKS = [sum(1 << b for b in bits) for k in range(ERRORS + 1) for bits in combinations(range(8), k)]


def _once(value: Column) -> Column:
    """The value, computed once per row: the optimizer copies no expression through a generator, into lambdas or filters above."""
    return F.explode(F.array(value))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+"), lambda w: w != "")


def _shingles(width: int) -> Column:
    """Hashes of the runs of width words, from the array ``hashes`` of the words' hashes."""
    last = F.size("hashes") - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(width)]))).otherwise(F.array().cast("array<bigint>"))


def _with_fingerprint(df: DataFrame, keys: list[str], shingles: str) -> DataFrame:
    """keys, the shingles (in any order) and print, their SimHash: each bit is the majority of the shingles' bits, a repeated shingle
    weighing as often as it occurs. A window has as many shingles as its item, so its list is short."""
    ones = [F.sum(F.getbit("h", F.lit(b)).cast("int")).alias(f"_{b}") for b in range(64)]
    counted = df.select(*keys, F.explode(shingles).alias("h")).groupBy(*keys).agg(F.collect_list("h").alias(shingles), *ones)
    value = F.lit(0).cast("bigint")
    for b in range(64):
        value = value.bitwiseOR(F.when(2 * F.col(f"_{b}") > F.size(shingles), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)))
    return counted.select(*keys, shingles, value.alias("print"))


def _byte(fingerprint: str, b: int) -> Column:
    return F.shiftright(fingerprint, 8 * b).bitwiseAND(F.lit(255))


def _needed(length: Column, size: Column) -> Column:
    """Least number of common shingles at which length and size shingles reach SIMILARITY = 4 / 5: the least c with 9 c >= 4 (length + size)."""
    return F.floor((4 * (length + size) + 8) / 9).cast("int")


def _starts(p: Column, i: Column) -> Column:
    """Starts of the windows that hold the hits i to i + need - 1 of ``at`` and not hit i - 1, so over all i each start of a window
    with need hits or more occurs once."""
    lo = F.greatest(F.lit(0), F.get("at", i + F.col("need") - 1) - F.col("length") + 1, F.get("at", i - 1) + 1)
    hi = F.least(p, F.col("n") - F.col("length"))
    return F.when((i + F.col("need") <= F.size("at")) & (lo <= hi), F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def _pass(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(key, item_id, start, similarity) of windows that are similar to items; items: at most PASS_SHINGLES distinct shingles."""
    pairs = items.select("size", F.explode("shingles").alias("h")).distinct()
    held = pairs.collect()  # bounded by PASS_SHINGLES and the sizes
    wanted = list({r["h"] for r in held})
    # a similar window has this many shingles at most that no item has (_needed), so its hits lie so close together
    gap, least = max(r["size"] for r in held) // 9, -(-4 * min(r["size"] for r in held) // 5)
    found = docs.select("key", "text_a", "text_b", _once(_shingles(width)).alias("shingles"))
    hits = F.transform(F.filter(F.transform("shingles", lambda h, i: F.struct(h.alias("h"), i.alias("at"))), lambda x: x.h.isin(wanted)), lambda x, i: F.struct(x["at"].alias("at"), i.alias("i")))
    found = found.select("key", "text_a", "text_b", "shingles", F.size("shingles").alias("n"), _once(hits).alias("hits")).where(F.size("hits") >= least)
    first = F.filter("hits", lambda x, i: (i == 0) | (x["at"] - F.get("hits", i - 1)["at"] > gap + 1))
    last = F.filter("hits", lambda x, i: (i == F.size("hits") - 1) | (F.get("hits", i + 1)["at"] - x["at"] > gap + 1))
    runs = found.select("key", "text_a", "text_b", "shingles", "n", F.explode(F.arrays_zip(first.alias("first"), last.alias("last"))).alias("run")).where(F.col("run.last.i") - F.col("run.first.i") + 1 >= least)
    runs = runs.withColumn("lo", F.greatest(F.lit(0), F.col("run.first.at") - gap)).withColumn("hi", F.least(F.col("n") - 1, F.col("run.last.at") + gap))
    cells = runs.select("key", "text_a", "text_b", "n", "lo", F.posexplode(F.slice("shingles", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1)).alias("pos", "h"))
    sizes = pairs.groupBy("h").agg(F.collect_set("size").alias("sizes"))
    cells = cells.join(F.broadcast(sizes), "h", "left").groupBy("key", "text_a", "text_b", "n", "lo").agg(  # bounded as above; equal rows give equal cells
        F.array_sort(F.collect_set(F.struct((F.col("lo") + F.col("pos")).alias("at"), "h", F.coalesce("sizes", F.array().cast("array<int>")).alias("sizes")))).alias("cells"))
    cells = cells.withColumn("size", F.explode(F.array_distinct(F.flatten(F.col("cells.sizes"))))).withColumn("length", F.least("n", "size")).withColumn("need", _needed(F.col("length"), F.col("size")))
    cells = cells.withColumn("at", _once(F.transform(F.filter("cells", lambda c: F.array_contains(c["sizes"], F.col("size"))), lambda c: c["at"])))
    windows = cells.withColumn("start", F.explode(F.flatten(F.transform("at", _starts)))).select(
        "key", "text_a", "text_b", "size", "start", F.transform(F.slice("cells", F.col("start") - F.col("lo") + 1, F.col("length")), lambda c: c["h"]).alias("w"))
    prints = _with_fingerprint(items, ["item_id", "number", "size"], "shingles")
    windows = _with_fingerprint(windows, ["key", "text_a", "text_b", "size", "start"], "w")
    bytes_ = lambda name: F.array(*[F.struct(F.lit(b).alias("b"), _byte(name, b).alias("v")) for b in range(8)])
    index = prints.select("item_id", "number", "size", F.col("print").alias("own"), F.col("shingles").alias("item"), F.explode(bytes_("print")).alias("p")).select(
        "item_id", "number", "size", "own", "item", F.col("p.b").alias("b"), F.explode(F.transform(F.array(*[F.lit(m) for m in MASKS]), lambda m: F.col("p.v").bitwiseXOR(m.cast("bigint")))).alias("v"))
    probes = windows.select("key", "text_a", "text_b", "size", "start", "w", "print", F.explode(bytes_("print")).alias("p")).select("key", "text_a", "text_b", "size", "start", "w", "print", F.col("p.b").alias("b"), F.col("p.v").alias("v"))
    near = probes.join(index, ["size", "b", "v"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("own"))) <= RADIUS).groupBy("key", "text_a", "text_b", "size", "start", "item_id", "number").agg(F.first("w").alias("w"), F.first("item").alias("item"))
    common = F.aggregate(F.array_distinct("item"), F.lit(0), lambda n, h: n + F.least(F.size(F.filter("item", lambda x: x == h)), F.size(F.filter("w", lambda x: x == h))))
    return near.withColumn("common", common).withColumn("similarity", F.col("common") / (F.size("w") + F.size("item") - F.col("common"))).where(F.col("similarity") >= SIMILARITY).select("key", "item_id", "start", "similarity")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with a window that is similar to a benchmark item: id_col, n_items, item_ids (sorted), similarity (the best), first_word
    (start of the first such window). Clean documents have no row.

    Null, empty and wordless texts and items match nothing; a text shorter than an item is one window. Documents are told apart
    by id: rows with equal ids make one row, null ids are one document; each text among them is compared for itself. So is each item's text,
    whatever its id; n_items counts ids, items without one as one. Texts are never cut. An empty table gives an empty result. Extra columns are ignored.
    """
    spark = docs.sparkSession
    hashes = lambda c: _once(F.transform(_words(c.cast("string")), lambda w: F.xxhash64(w))).alias("hashes")
    held = docs.select(F.col(f"`{id_col}`").alias("key"), hashes(F.col(f"`{text_col}`"))).select("key", "hashes", F.xxhash64("hashes").alias("text_a"), F.xxhash64(F.lit("b"), "hashes").alias("text_b"))
    named = benchmark.select("item_id", hashes(F.col("text"))).withColumn("n", F.size("hashes")).where("n > 0").withColumn("number", F.xxhash64("hashes"))  # tells items without an id, or of one id, apart
    out = None
    for width in range(1, WIDTH + 1):
        items = named.where(F.least("n", F.lit(WIDTH)) == width).select("item_id", "number", _once(_shingles(width)).alias("shingles")).withColumn("size", F.size("shingles"))
        total = items.agg(F.sum("size")).first()[0] or 0
        slices = -(-total // (PASS_SHINGLES // 2)) if total > PASS_SHINGLES else min(1, total)
        for k in range(slices):  # the stated query set, in blocks
            part = items if slices == 1 else items.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(slices)) == k)
            found = _pass(held, part, width)
            out = found if out is None else out.union(found)
    kind = docs.schema[id_col].dataType
    if out is None:
        return spark.createDataFrame([], f"`{id_col}` {kind.simpleString()}, n_items long, item_ids array<long>, similarity double, first_word int")
    return out.groupBy("key").agg(F.count_distinct(F.coalesce("item_id", F.lit(-1))).alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"), F.min("start").alias("first_word")).withColumnRenamed("key", id_col)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without benchmark passages, unchanged. Every text is judged for itself, also where ids are null or shared."""
    ident, text = F.col(f"`{id_col}`").cast("string"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.struct(F.xxhash64(ident, F.lit("a"), text).alias("k1"), F.xxhash64(text, F.lit("b"), ident).alias("k2"))
    bad = contamination(docs.select(key.alias("key"), text.alias("text")), benchmark, "key", "text").select(F.col("key.k1").alias("_k1"), F.col("key.k2").alias("_k2"))
    return docs.join(bad, (key["k1"] == F.col("_k1")) & (key["k2"] == F.col("_k2")), "left_anti")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
