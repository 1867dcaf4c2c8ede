"""Exact order statistics without sorting or collecting a column.

Each pass counts values into a fixed number of bins (map-side combine, at most
BINS rows per open interval reach the driver) and keeps only the bin holding
the wanted rank, so skewed or repeated values cost nothing extra. A bin whose
smallest and largest value agree is final.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024
SMALL = 4096  # an interval this small is read value by value


def finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


class _Interval:
    def __init__(self, col: str, lo: float, hi: float, below: int, count: int, ranks: set[int]):
        self.col, self.lo, self.hi, self.below, self.count, self.ranks = col, lo, hi, below, count, ranks


def _tag(df: DataFrame, open_: list[_Interval]) -> DataFrame:
    """One row (i, v) for every value inside open interval i."""
    parts = []
    for i, it in enumerate(open_):
        v = F.col(it.col).cast("double")
        parts.append(F.when(finite(v) & (v >= it.lo) & (v <= it.hi), F.struct(F.lit(i).alias("i"), v.alias("v"))))
    cols = sorted({it.col for it in open_})
    return df.select(*cols).select(F.explode(F.array(*parts)).alias("t")).where("t IS NOT NULL").select("t.i", "t.v")


def _bin(open_: list[_Interval]) -> Column:
    out = None
    for i, it in enumerate(open_):
        width = (it.hi - it.lo) or 1.0
        b = F.least(F.floor((F.col("v") - it.lo) / width * BINS), F.lit(BINS - 1).cast("long"))
        out = F.when(F.col("i") == i, b) if out is None else out.when(F.col("i") == i, b)
    return out


def order_statistics(df: DataFrame, ranks: dict[str, set[int]], stats: dict[str, tuple[int, float, float]]):
    """Values at 0-based ranks of each column. ``stats``: column -> (count, min, max)."""
    found: dict[tuple[str, int], float] = {}
    open_ = [_Interval(c, stats[c][1], stats[c][2], 0, stats[c][0], set(r)) for c, r in ranks.items() if r]
    while open_:
        direct = [it for it in open_ if it.count <= SMALL]
        wide = [it for it in open_ if it.count > SMALL]
        open_ = []
        for group, exact in ((direct, True), (wide, False)):
            if not group:
                continue
            tagged = _tag(df, group)
            key = F.col("v") if exact else _bin(group)
            rows = tagged.groupBy("i", key.alias("b")).agg(
                F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
            for i, it in enumerate(group):
                below, left = it.below, sorted(it.ranks)
                for r in sorted((r for r in rows if r["i"] == i), key=lambda r: r["b"]):
                    inside = {k for k in left if below <= k < below + r["n"]}
                    if inside and r["lo"] == r["hi"]:
                        found.update({(it.col, k): r["lo"] for k in inside})
                    elif inside:
                        open_.append(_Interval(it.col, r["lo"], r["hi"], below, r["n"], inside))
                    below += r["n"]
    return found


def quantiles(df: DataFrame, wanted: dict[str, list[float]], method: str = "linear") -> dict[str, list[float]]:
    """Exact quantiles of several columns in a few scans.

    ``linear`` interpolates between neighbours at (n - 1) q; ``floor`` takes the
    element at floor((n - 1) q). Null, NaN and infinite values are ignored; a
    column without values gives NaN.
    """
    aggs = []
    for c in wanted:
        v = F.when(finite(F.col(c)), F.col(c).cast("double"))
        aggs += [F.count(v).alias(f"n_{c}"), F.min(v).alias(f"lo_{c}"), F.max(v).alias(f"hi_{c}")]
    row = df.agg(*aggs).first()
    stats = {c: (row[f"n_{c}"], row[f"lo_{c}"], row[f"hi_{c}"]) for c in wanted}
    ranks: dict[str, set[int]] = {}
    for c, qs in wanted.items():
        n = stats[c][0]
        ranks[c] = set()
        for q in qs if n else []:
            k = math.floor((n - 1) * q)
            ranks[c] |= {k} if method == "floor" else {k, min(k + 1, n - 1)}
    at = order_statistics(df, ranks, stats)
    out: dict[str, list[float]] = {}
    for c, qs in wanted.items():
        n = stats[c][0]
        out[c] = []
        for q in qs:
            if not n:
                out[c].append(float("nan"))
                continue
            k = math.floor((n - 1) * q)
            lo = at[(c, k)]
            if method == "floor":
                out[c].append(lo)
            else:
                hi = at[(c, min(k + 1, n - 1))]
                out[c].append(lo + (hi - lo) * ((n - 1) * q - k))
    return out
