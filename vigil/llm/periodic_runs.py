"""Periodic runs of words, by internal pattern matching.

A run of period q and at least 4q words holds, for the power of two l with l <= q < 2l, an aligned block of l words that
occurs again q and 2q words later. So for every l each aligned (dyadic) block asks for its occurrences among the l places that
begin l words after it: its suffix-array interval is known from the doubling that sorts the suffixes, and a wavelet matrix
over the suffix array gives the least position of the interval from a place on (range successor). The occurrences of l words in
a window of l places are one, two or an arithmetic progression; one and two are candidate periods themselves, and for a
progression only the period that carries the block's own periodic stretch to the progression's can be one. A candidate is
extended both ways by the ranks of the doubling, which name substrings exactly, and kept if it is long enough.

Documents don't depend on each other: nothing is shuffled. A task works on whole documents, some megabytes of text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as bl

#: The window of places after a block covers the periods of runs at least so many periods long.
LEAST_EXPONENT = 4


class WaveletMatrix:
    """Numbers below 2^bits with the count of those below x, and the k-th least, in ranges of places; all queries at once."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros = bits, []
        for bit in reversed(range(bits)):
            one = (values >> bit) & 1 == 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[~one], values[one]])

    def _step(self, before: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: np.ndarray, lo0: np.ndarray, hi0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = before[-1]
        return np.where(right, n + lo - lo0, lo0), np.where(right, n + hi - hi0, hi0)

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        out, beyond, size = np.zeros(len(lo), np.int64), x >> self.bits > 0, hi - lo
        for bit, before in zip(reversed(range(self.bits)), self.zeros, strict=True):
            lo0, hi0 = before[lo], before[hi]
            right = (x >> bit) & 1 == 1
            out += np.where(right, hi0 - lo0, 0)
            lo, hi = self._step(before, lo, hi, right, lo0, hi0)
        return np.where(beyond, size, out)

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lo), np.int64)
        for bit, before in zip(reversed(range(self.bits)), self.zeros, strict=True):
            lo0, hi0 = before[lo], before[hi]
            right = k >= hi0 - lo0
            k = np.where(right, k - (hi0 - lo0), k)
            out += right.astype(np.int64) << bit
            lo, hi = self._step(before, lo, hi, right, lo0, hi0)
        return out

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least value from x on in the places [lo, hi); a number above all values where there is none."""
        k = self.below(lo, hi, x)
        there = k < hi - lo
        out = np.full(len(lo), np.iinfo(np.int64).max)
        out[there] = self.kth(lo[there], hi[there], k[there])
        return out


class Suffixes:
    """Suffix array of several documents of words, each for itself, by doubling; ranks at every doubling name substrings.

    ids: word numbers, documents end to end; begin, end: for each place the bounds of its document. rank[k][i] is where the suffixes
    that share i's first 2^k words begin in ``order`` (a suffix shorter than that is alone), so equal ranks are equal strings.
    blocks[k]: aligned blocks of 2^k words that occur three times or more, as (place, first, last + 1) with their interval.
    """

    def __init__(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray):
        n, places = len(ids), np.arange(len(ids))
        self.begin, self.end = begin, end
        key = begin * (int(ids.max(initial=0)) + 1) + ids
        order = np.argsort(key, kind="stable")
        rank, size = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self._number(order, places, [key[order]], rank, size)
        longest = int((end - begin).max(initial=0))
        self.rank, self.blocks = [rank.copy()], []
        k = 0
        while True:
            length = 1 << k
            aligned = places[((places - begin) % length == 0) & (size >= 3)] if k else places[size >= 3]
            aligned = aligned[aligned + length <= end[aligned]]
            self.blocks.append((aligned, rank[aligned].astype(np.int64), (rank + size)[aligned].astype(np.int64)))
            slots = np.flatnonzero(size[order] > 1)
            if 2 * length * LEAST_EXPONENT > longest or not len(slots):
                break
            several = order[slots]
            then = several + length
            inside = then < end[several]
            second = np.where(inside, rank[np.minimum(then, n - 1)], -1)
            first = rank[several]
            by = np.lexsort((second, first))
            order[slots] = several[by]
            self._number(order, slots, [first[by], second[by]], rank, size)
            self.rank.append(rank.copy())
            k += 1
        self.order = order

    @staticmethod
    def _number(order: np.ndarray, slots: np.ndarray, keys: list[np.ndarray], rank: np.ndarray, size: np.ndarray) -> None:
        """Set rank and size of the places at these slots of order, whose keys are sorted."""
        if not len(slots):
            return
        new = np.ones(len(slots), bool)
        new[1:] = False
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        cuts = np.flatnonzero(new)
        sizes = np.diff(np.append(cuts, len(slots)))
        rank[order[slots]] = np.repeat(slots[cuts], sizes)
        size[order[slots]] = np.repeat(sizes, sizes)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and j on (i < j, one document) are the same."""
        out, end = np.zeros(len(i), np.int64), self.end[i]

        def more(k: int) -> np.ndarray:
            a, b = i + out, j + out
            fits = b + (1 << k) <= end
            return fits & (self.rank[k][a] == self.rank[k][np.where(fits, b, 0)])

        top = len(self.rank) - 1
        while len(i) and (step := more(top)).any():
            out[step] += 1 << top
        for k in reversed(range(top)):
            out[more(k)] += 1 << k
        return out

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and j (i < j, one document) are the same."""
        out, begin = np.zeros(len(i), np.int64), self.begin[i]

        def more(k: int) -> np.ndarray:
            a, b = i - out - (1 << k), j - out - (1 << k)
            fits = a >= begin
            return fits & (self.rank[k][np.where(fits, a, 0)] == self.rank[k][np.where(fits, b, 0)])

        top = len(self.rank) - 1
        while len(i) and (step := more(top)).any():
            out[step] += 1 << top
        for k in reversed(range(top)):
            out[more(k)] += 1 << k
        return out


def _candidates(found: Suffixes, wavelets: WaveletMatrix, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) that the dyadic blocks of 2^k words give."""
    length = 1 << k
    at, lo, hi = found.blocks[k]
    begin = found.begin[at]
    last = at - begin + 2 * length - 1
    first = wavelets.successor(lo, hi, at - begin + length)
    some = first <= last
    at, lo, hi, begin, last, first = (x[some] for x in (at, lo, hi, begin, last, first))
    second = wavelets.successor(lo, hi, first + 1)
    two = second <= last
    third = np.full(len(at), np.iinfo(np.int64).max)
    third[two] = wavelets.successor(lo[two], hi[two], second[two] + 1)
    many = third <= last
    places, periods = [at[~many], at[two & ~many]], [(first + begin - at)[~many], (second + begin - at)[two & ~many]]
    # a progression: its stretch of period step ends at ``stop``, the block's own at ``own``
    at, first, step = at[many], (first + begin)[many], (second - first)[many]
    own = at + step + found.ahead(at, at + step)
    stop = first + step + found.ahead(first, first + step)
    fits = (stop - own >= length) & (stop - own < 2 * length)
    return np.concatenate([*places, at[fits]]), np.concatenate([*periods, (stop - own)[fits]])


def find_runs(ids: np.ndarray, starts: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, period) of the runs of documents laid end to end (document d is ids[starts[d]:starts[d + 1]]), by begin and period."""
    lengths = np.diff(starts)
    begin, end = np.repeat(starts[:-1], lengths), np.repeat(starts[1:], lengths)
    found = Suffixes(ids, begin, end)
    wavelets = WaveletMatrix(found.order - begin[found.order], max(1, int(lengths.max(initial=0) - 1).bit_length()))
    parts = [_candidates(found, wavelets, k) for k in range(len(found.blocks))]
    at, period = (np.concatenate(x) for x in zip(*parts, strict=True))
    lo, hi = at - found.back(at, at + period), at + period + found.ahead(at, at + period)
    long = hi - lo >= np.maximum(min_length, min_exponent * period)
    lo, hi, period = (x[long] for x in (lo, hi, period))
    # multiples of a stretch's smallest period find the same stretch
    order = np.lexsort((period, hi, lo))
    lo, hi, period = (x[order] for x in (lo, hi, period))
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    lo, hi, period = (x[new] for x in (lo, hi, period))
    order = np.lexsort((period, lo))
    return lo[order], hi[order], period[order]


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def with_runs(docs: DataFrame, text_col: str = "text", min_length: int = 6, min_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """All rows of docs without the text, with n_words, runs (array of start, length, period in words, by start and period) and
    kept_text (the words that no run holds after its first period, joined by one space).

    A run is a stretch of words that are the same ``period`` words apart, with that smallest period, at least min_length words and
    min_exponent periods long, that can't be extended either way. Words are stretches without ASCII white space, compared
    byte by byte. Null and empty texts have no words, no runs and an empty kept_text. Rows are judged one by one: repeated
    rows get the same answer and null ids don't matter. An empty table gives an empty result. Input columns with the names
    of results are replaced.
    """
    if min_exponent < LEAST_EXPONENT:
        raise ValueError(f"min_exponent must be {LEAST_EXPONENT} or more")
    bl.prepare(docs.sparkSession)
    new = ["n_words", "runs", "kept_text"]
    rest = [c for c in docs.columns if c not in new and c != text_col]
    held = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *[f"`{c}`" for c in rest]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, cuts in bl.blocks(batches):
            raw, number = data.tobytes(), {}
            texts = [raw[a:b].split() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            ids = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(starts[-1]))
            lo, hi, period = find_runs(ids, starts, min_length, min_exponent) if len(ids) else (np.zeros(0, np.int64),) * 3
            doc = np.searchsorted(starts, lo, "right") - 1
            edge = np.zeros(len(ids) + 1, np.int32)
            np.add.at(edge, lo + period, 1)
            np.add.at(edge, hi, -1)
            gone = np.cumsum(edge) > 0
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            kept = [b" ".join(t) if a == b else b" ".join([w for w, g in zip(t, gone[s:s + len(t)].tolist(), strict=True) if not g])
                    for t, s, a, b in zip(texts, starts[:-1].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(lo - starts[doc]), pa.array(hi - lo), pa.array(period)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.diff(starts)), runs, pa.array(kept, pa.binary())], names=["row", *new])

    kind = held.schema["row"].dataType.simpleString()
    out = held.mapInArrow(run, f"row {kind}, n_words bigint, runs array<{RUN}>, kept_text binary")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], "n_words", "runs", F.col("kept_text").cast("string").alias("kept_text"))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one text in ten made periodic from some word on: with h the unsigned crc32 of the decimal id, g = h div 10 and n words,
    where 10 divides h and n > 0, each word i from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    found = F.filter(F.split(F.col(f"`{text_col}`"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    steps = docs.withColumn("_words", F.when(h % 10 == 0, found)).withColumn("_n", F.nullif(F.size("_words"), F.lit(0)))
    steps = steps.withColumn("_g", F.floor(h / 10)).withColumn("_a", F.expr("cast(_g % _n as int)")).withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) as int)"))
    made: Column = F.expr("array_join(concat(slice(_words, 1, _a), slice(flatten(array_repeat(slice(_words, _a + 1, _p), cast((_n - _a) div _p + 1 as int))), 1, _n - _a)), ' ')")
    return steps.withColumn(text_col, F.when(F.col("_words").isNotNull() & (F.col("_n") > 0), made).otherwise(F.col(f"`{text_col}`"))).drop("_words", "_n", "_g", "_a", "_p")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    best = F.expr("array_max(transform(runs, r -> named_struct('ratio', r.length / r.period, 's', -r.start, 'p', -r.period, 'l', r.length)))")
    lines = F.expr(r"concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    return with_runs(docs).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.l").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("(1000 * best.l) div -best.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
