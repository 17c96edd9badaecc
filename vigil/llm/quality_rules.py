"""Quality rules: a decision list learned by sequential covering from labelled text statistics, applied as Spark conditions.

Rules are grown one condition at a time by information gain on two thirds of the labelled rows and pruned on the other
third; rows that a rule covers leave before the next is grown. A rule that does no better on the held-out third than MIN_PRECISION
ends the list. The list becomes ordered ``when`` conditions over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import blocks as bl
from .rolling import Names, words

#: Most labelled rows that a fit collects, those of the least hash of the id. It bounds the fit, not what is judged.
MAX_LABELLED = 20_000
MIN_PRECISION = 0.9
MAX_RULES, MAX_CONDITIONS = 12, 4

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines", "n_upper", "n_marks", "n_bytes"]
#: name: (numerator, denominator). Ratios are compared as numerator / greatest(denominator, 1).
RATIOS = {"mean_word": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
          "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("n_upper", "n_bytes"), "mark_share": ("n_marks", "n_words")}
FEATURES = ["n_words", *RATIOS]

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
MARKS = np.isin(np.arange(256), list(b"!?"))
UPPER = np.isin(np.arange(256), np.arange(65, 91))
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
NOT_NEWLINE = np.arange(256) != 10


def text_stats(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each document of a block."""
    n = len(starts) - 1
    per_doc = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[starts])
    _, _, doc, name = words(data, starts)
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": per_doc(~SPACE[data] & ((data & 0xC0) != 0x80)), "n_symbols": per_doc(SYMBOLS[data]),
           "n_upper": per_doc(UPPER[data]), "n_marks": per_doc(MARKS[data]), "n_bytes": np.diff(starts)}
    begin, end, of, line = words(data, starts, keep=NOT_NEWLINE)
    filled = np.concatenate([[0], np.cumsum(~SPACE[data])])
    some = filled[end] > filled[begin]
    of, line = of[some], line[some]
    out["n_lines"] = np.bincount(of, minlength=n)
    order, cuts = bl.split_by([of, line])
    firsts = np.bincount(of[order][cuts[:-1]], minlength=n)
    out["n_dup_lines"] = out["n_lines"] - firsts
    first = np.searchsorted(doc, np.arange(n + 1))
    at = np.arange(len(name))
    at = at[at + 3 <= np.repeat(first[1:], np.diff(first))]
    window = Names(name).of(at, 3)
    order, cuts = bl.split_by([doc[at], window])
    size = np.diff(cuts)
    twice = at[order[np.repeat(size, size) > 1]]
    edge = np.zeros(len(name) + 3, np.int32)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 3, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(edge)[:len(name)] > 0], minlength=n)
    return {c: out[c].astype(np.int64) for c in COUNTS}


def _stats_map(through: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in bl.blocks(batches, max_bytes=bl.SMALL_BYTES):
            stats = text_stats(data, starts)
            yield pa.RecordBatch.from_arrays([batch.column("text") if through else pa.nulls(batch.num_rows, pa.string()), batch.column("row"), *(pa.array(stats[c]) for c in COUNTS)], names=["text", "row", *COUNTS])

    return run


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the statistics' names, plus COUNTS of each text; null texts count as empty."""
    keep = [c for c in docs.columns if c not in COUNTS]
    text = F.col(f"`{text_col}`")
    through = docs.schema[text_col].dataType == StringType()  # then the text itself comes back from the task, sent once
    rest = [c for c in keep if not (through and c == text_col)]
    held = docs.select(text.cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *[f"`{c}`" for c in rest]).alias("row"))
    kind = held.schema["row"].dataType.simpleString()
    out = held.mapInArrow(_stats_map(through), f"text string, row {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    return out.select(*[F.col("text" if through and c == text_col else f"row.`{c}`").alias(c) for c in keep], *COUNTS)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.value if self.above else x[self.feature] <= self.value

    def column(self) -> Column:
        if self.feature in RATIOS:
            top, bottom = RATIOS[self.feature]
            value = F.col(top) / F.greatest(F.col(bottom), F.lit(1))
        else:
            value = F.col(self.feature)
        return value > self.value if self.above else value <= self.value


def features(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {"n_words": stats["n_words"].astype(float), **{k: stats[a] / np.maximum(stats[b], 1) for k, (a, b) in RATIOS.items()}}


def _covered(rule: list[Condition], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(x["n_words"]), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and inside.any() and not bad[inside].all():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        if not p:
            break
        best, gain = None, 1e-9
        for f in FEATURES:
            order = np.argsort(x[f][inside], kind="stable")
            v, b = x[f][inside][order], bad[inside][order]
            cut = np.flatnonzero(v[1:] != v[:-1])
            below_p, below_n = np.cumsum(b)[cut], np.cumsum(~b)[cut]
            for above, cp, cn in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
                got = np.where(cp > 0, cp * (np.log2(np.maximum(cp, 1) / np.maximum(cp + cn, 1)) - np.log2(p / (p + n))), 0)
                if len(got) and got.max() > gain:
                    at = int(got.argmax())
                    best, gain = Condition(f, above, float((v[cut[at]] + v[cut[at] + 1]) / 2)), float(got.max())
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return rule


def _prune(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    def worth(r: list[Condition]) -> float:
        c = _covered(r, x)
        p, n = bad[c].sum(), (~bad[c]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(stats: dict[str, np.ndarray], bad: np.ndarray) -> list[list[Condition]]:
    """The decision list: rules that reject, in order. bad: the labelled verdicts. Without rows of both kinds it is empty."""
    x, rules = features(stats), []
    held = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES and bad[left & ~held].any():
        take = lambda m: {k: v[m] for k, v in x.items()}
        grow, prune = left & ~held, left & held
        rule = _prune(_grow(take(grow), bad[grow]), take(prune), bad[prune])
        covered = _covered(rule, x)
        hit, right = (covered & prune).sum(), (covered & prune & bad).sum()
        if not rule or right < MIN_PRECISION * hit or hit < 3:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """Kept or not, as one ordered conditional expression over COUNTS."""
    out = F
    for rule in rules:
        condition = rule[0].column()
        for c in rule[1:]:
            condition &= c.column()
        out = out.when(condition, F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> list[list[Condition]]:
    """Learn from at most max_labelled labelled rows (those of the least hash of the id), quality 0 being bad. Rows without
    id or quality don't count; of several labels of a document the least counts; documents that fail the base rules are left out."""
    sample = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    chosen = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(sample), "doc_id")  # bounded by max_labelled
    rows = with_stats(chosen).where(~base_failed()).select(F.xxhash64("doc_id").alias("h"), "doc_id", "quality", *COUNTS).orderBy("h", "doc_id", *COUNTS).limit(2 * max_labelled).collect()
    stats = {c: np.array([r[c] for r in rows], np.int64) for c in COUNTS}
    return learn(stats, np.array([r["quality"] == 0 for r in rows], bool))


def judge(docs: DataFrame, rules: list[list[Condition]], text_col: str = "text") -> DataFrame:
    """docs with BASE statistics, base_failed and kept. Null and empty texts have no words and fail. Repeated rows are judged
    alike. An empty table gives an empty result. Input columns with the names of results are replaced."""
    found = with_stats(docs, text_col)
    names = [c for c in docs.columns if c not in {*COUNTS, "base_failed", "kept"}]
    return found.select(*[f"`{c}`" for c in names], *BASE, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    bl.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).drop("text")
