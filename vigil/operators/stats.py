"""Exact order statistics with bounded memory per task.

Spark's exact ``percentile``/``median`` aggregate merges a value->count map
in one task, which is unbounded for a column with many distinct values. Here
all ranks of all columns are found together by narrowing open brackets: one
aggregate takes two cuts near every rank from ``percentile_approx`` (a
fixed-size sketch per task), a second counts the values below, at and between
the cuts. A rank that falls on a cut is answered by its count, so a bracket
loses its cuts' ties in every round whatever the sketch says, and a constant
column is done after one round. Brackets of at most ``FINISH_ROWS`` rows are
finished together by their values' counts. Each round is two scans and leaves
about ``8 / ACCURACY`` of a bracket's rows, so 10^12 rows need three rounds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINISH_ROWS = 100_000
#: Rows that the brackets of one finishing scan hold together at most (or one column's).
SCAN_ROWS = 4 * FINISH_ROWS
ACCURACY = 20_000


@dataclass(frozen=True)
class _Bracket:
    """The values of a column strictly between lo and hi (None: no bound), ``before`` of them at or below lo."""

    column: str
    lo: object
    hi: object
    before: int
    inside: int

    def holds(self) -> Column:
        x = F.col(self.column)
        cond = x.isNotNull()
        if self.lo is not None:
            cond = cond & (x > F.lit(self.lo))
        if self.hi is not None:
            cond = cond & (x < F.lit(self.hi))
        return cond


def _cut(df: DataFrame, wanted: dict) -> dict:
    """One round: {bracket: ranks} -> {bracket: ranks} or, under the column's name and rank, a found value."""
    brackets = list(wanted)
    delta = 4.0 / ACCURACY
    sketches = []
    for i, b in enumerate(brackets):
        near = sorted({min(1.0, max(0.0, (r - b.before - 1) / b.inside + d)) for r in wanted[b] for d in (-delta, delta)})
        sketches.append(F.percentile_approx(F.when(b.holds(), F.col(b.column)), near, ACCURACY).alias(f"s{i}"))
    sketch = df.agg(*sketches).first()
    cuts = [sorted(set(sketch[f"s{i}"])) for i in range(len(brackets))]
    counts = []
    for i, b in enumerate(brackets):
        x = F.col(b.column)
        for j, c in enumerate(cuts[i]):
            counts += [F.count_if(b.holds() & (x < F.lit(c))).alias(f"l{i}_{j}"), F.count_if(x == F.lit(c)).alias(f"e{i}_{j}")]
    n = df.agg(*counts).first()
    out: dict = {}
    for i, b in enumerate(brackets):
        edges = [(c, b.before + n[f"l{i}_{j}"], n[f"e{i}_{j}"]) for j, c in enumerate(cuts[i])]
        for r in wanted[b]:
            lo, hi, start, stop = b.lo, b.hi, b.before, b.before + b.inside
            for c, below, ties in edges:
                if r <= below:
                    hi, stop = c, below
                    break
                if r <= below + ties:
                    out[b.column, r] = c
                    break
                lo, start = c, below + ties
            if (b.column, r) not in out:
                out.setdefault(_Bracket(b.column, lo, hi, start, stop - start), []).append(r)
    return out


def select_ranks(df: DataFrame, ranks: dict, counts: dict | None = None) -> dict:
    """{column: {rank: value}} for {column: 1-based ranks} among the non-null values (``counts`` of them)."""
    ranks = {c: sorted(set(rs)) for c, rs in ranks.items() if rs}
    if not ranks:
        return {}
    counts = counts or non_null_counts(df, list(ranks))
    for c, rs in ranks.items():
        if not 1 <= rs[0] <= rs[-1] <= counts[c]:
            raise ValueError(f"ranks {rs} of {c} outside 1..{counts[c]}")
    df = df.select(*ranks)
    found: dict = {c: {} for c in ranks}
    open_ = {_Bracket(c, None, None, 0, counts[c]): rs for c, rs in ranks.items()}
    while True:
        large = {b: rs for b, rs in open_.items() if b.inside > FINISH_ROWS}
        if not large:
            break
        open_ = {b: rs for b, rs in open_.items() if b.inside <= FINISH_ROWS}
        for key, value in _cut(df, large).items():
            if isinstance(key, _Bracket):
                open_[key] = value
            else:
                found[key[0]][key[1]] = value
    _finish(df, open_, found)
    return found


def _finish(df: DataFrame, open_: dict, found: dict) -> None:
    """Ranks of small brackets, from the counts of the values inside (one row per distinct value).

    Columns of one type share a scan, as long as their brackets hold at most SCAN_ROWS rows together.
    """
    types, scans = dict(df.dtypes), []
    for c in sorted({b.column for b in open_}, key=lambda c: (types[c], c)):
        mine = [b for b in open_ if b.column == c]
        rows = sum(b.inside for b in mine)
        if not scans or scans[-1]["type"] != types[c] or scans[-1]["rows"] + rows > SCAN_ROWS:
            scans.append({"type": types[c], "rows": 0, "columns": []})
        scans[-1]["rows"] += rows
        scans[-1]["columns"].append((c, mine))
    for scan in scans:
        inside = [reduce(or_, [b.holds() for b in mine]) for _, mine in scan["columns"]]
        cells = F.array(*[F.when(cond, F.struct(F.lit(i).alias("i"), F.col(c).alias("v"))) for i, (cond, (c, _)) in enumerate(zip(inside, scan["columns"]))])
        rows = df.where(reduce(or_, inside)).select(F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("x")).groupBy("x.i", "x.v").count().collect()
        for i, (c, mine) in enumerate(scan["columns"]):
            seen = sorted((r["v"], r["count"]) for r in rows if r["i"] == i)
            for b in mine:  # brackets of one column don't overlap
                at, left = b.before, list(open_[b])
                for value, n in seen:
                    if (b.lo is None or value > b.lo) and (b.hi is None or value < b.hi):
                        at += n
                        while left and left[0] <= at:
                            found[c][left.pop(0)] = value


def kth_values(df: DataFrame, c: str, k: int, n: int, count: int = 1) -> list:
    """Values of rank k .. k+count-1 (1-based) among the n non-null values of ``c``."""
    ranks = range(k, min(k + count, n + 1)) if k <= n else [k]
    values = select_ranks(df, {c: ranks}, {c: n})[c]
    return [values[r] for r in ranks]


def non_null_counts(df: DataFrame, columns) -> dict:
    row = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def exact_medians(df: DataFrame, columns) -> dict:
    """Median of every column, as interpolated by DuckDB/pandas (mean of the two middle values); None without values."""
    counts = non_null_counts(df, columns)
    ranks = {c: [(n + 1) // 2, n // 2 + 1] for c, n in counts.items() if n}
    values = select_ranks(df, ranks, counts)
    return {c: (float(values[c][ranks[c][0]]) + float(values[c][ranks[c][1]])) / 2.0 if c in ranks else None for c in columns}


def exact_median(df: DataFrame, c: str):
    """Median of one column."""
    return exact_medians(df, [c])[c]


def exact_quantile_cont(df: DataFrame, c: str, p: float, n: int | None = None):
    """Linear-interpolated quantile (``quantile_cont`` / ``percentile``)."""
    if n is None:
        n = non_null_counts(df, [c])[c]
    if n == 0:
        return None
    pos = p * (n - 1)
    lo_rank = int(pos) + 1
    frac = pos - int(pos)
    vals = kth_values(df, c, lo_rank, n, count=2)
    a = float(vals[0])
    if frac == 0 or len(vals) == 1:
        return a
    return a + (float(vals[1]) - a) * frac


def grouped_quantile_cont(df: DataFrame, groups, c: str, p: float, tiebreak=None, out: str = "quantile") -> DataFrame:
    """Exact linear-interpolated quantile of ``c`` per group, without one task per group.

    Values are ranked inside their group by the range-partitioned ranking
    (a hot group spreads over many tasks); per group only the two ranks
    around ``p * (n - 1)`` are kept and interpolated.
    """
    from .ranking import rank_in_groups
    groups = [groups] if isinstance(groups, str) else list(groups)
    vals = df.where(F.col(c).isNotNull())
    order = [F.col(c)] + ([F.col(t) for t in ([tiebreak] if isinstance(tiebreak, str) else tiebreak)] if tiebreak else [])
    ranked = rank_in_groups(vals.select(*groups, c, *([tiebreak] if isinstance(tiebreak, str) else (tiebreak or []))),
                            groups, order, rank_col="_r")
    sizes = vals.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    pos = F.lit(p) * (F.col("_n") - 1)
    lo = F.floor(pos).cast("bigint") + 1
    j = ranked.join(sizes, groups).where((F.col("_r") == lo) | (F.col("_r") == lo + 1))
    agg = j.groupBy(*groups).agg(
        F.max(F.when(F.col("_r") == lo, F.col(c))).alias("_a"), F.max(F.when(F.col("_r") == lo + 1, F.col(c))).alias("_b"),
        F.first(pos - F.floor(pos)).alias("_f"))
    val = F.when(F.col("_b").isNull() | (F.col("_f") == 0), F.col("_a")).otherwise(
        F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f"))
    return agg.select(*groups, val.cast("double").alias(out))
