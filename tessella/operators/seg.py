"""Windowed entropy of symbol series, low- and high-complexity segments, masking.

A series is ``(id, pos, symbol)`` with positions 1, 2, ... in each id.  Entropy,
runs and masks are window expressions; the search for a segment's best part
runs in a kernel over one segment at a time.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_entropy(series: DataFrame, size: int, symbols: list[str]) -> DataFrame:
    """``entropy`` in bits of the window around each position; null where a window is cut off or holds another symbol.

    An even window reaches one further to the right.
    """
    frame = Window.partitionBy("id").orderBy("pos").rowsBetween(-((size - 1) // 2), size // 2)
    counts = [F.count_if(F.col("symbol") == s).over(frame) for s in symbols]
    whole = sum(counts, start=F.lit(0))
    bits = sum((F.when(c > 0, -(c / float(size)) * F.log2(c / float(size))).otherwise(0.0) for c in counts), start=F.lit(0.0))
    return series.withColumn("entropy", F.when(whole == size, bits))


def segments(entropies: DataFrame, size: int, trigger: float, extension: float, high: bool = False) -> DataFrame:
    """Runs of windows whose entropy stays within ``extension`` and somewhere reaches ``trigger``: ``(id, left, right)``.

    A run covers the windows themselves, so it reaches half a window beyond
    their centres; runs that overlap are one.  With ``high`` both bounds are
    lower bounds.
    """
    inside = F.col("entropy") >= extension if high else F.col("entropy") <= extension
    hit = F.col("entropy") >= trigger if high else F.col("entropy") <= trigger
    by = Window.partitionBy("id").orderBy("pos")
    kept = entropies.withColumn("inside", F.coalesce(inside, F.lit(False)))
    runs = kept.withColumn("run", F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(by)).where("inside")
    found = runs.groupBy("id", "run").agg(
        (F.min("pos") - (size - 1) // 2).alias("left"), (F.max("pos") + size // 2).alias("right"), F.count_if(hit).alias("hits")
    )
    return merged(found.where("hits > 0").select("id", "left", "right"))


def merged(intervals: DataFrame) -> DataFrame:
    """Union of intervals of each id: those that share a position become one."""
    by = Window.partitionBy("id").orderBy("left", "right")
    reach = F.max("right").over(by.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("left") > reach), 1).otherwise(0)
    island = F.sum("begins").over(by)
    marked = intervals.withColumn("begins", begins).withColumn("island", island)
    return marked.groupBy("id", "island").agg(F.min("left").alias("left"), F.max("right").alias("right")).drop("island")


def masked(series: DataFrame, found: DataFrame, mask: str = "X", keep: Column | None = None) -> DataFrame:
    """``symbol`` replaced by ``mask`` inside segments, except where ``keep`` holds.

    Segments are disjoint, so each position takes the last one that begins at or
    before it: one sort by id instead of a range join.
    """
    marks = found.select("id", F.col("left").alias("pos"), "right", F.lit(None).cast("string").alias("symbol"), F.lit(0).alias("o"))
    rows = series.select("id", "pos", F.lit(None).cast("long").alias("right"), "symbol", F.lit(1).alias("o"))
    by = Window.partitionBy("id").orderBy("pos", "o")
    last = F.last("right", ignorenulls=True).over(by)
    out = marks.withColumn("right", F.col("right").cast("long")).unionByName(rows).withColumn("until", last).where("o = 1")
    hidden = F.coalesce(F.col("pos") <= F.col("until"), F.lit(False))
    hidden &= ~keep if keep is not None else F.lit(True)
    return out.select("id", "pos", F.when(hidden, F.lit(mask)).otherwise(F.col("symbol")).alias("symbol"), hidden.alias("masked"))


def window_log_probability(symbols: list, alphabet: int) -> float:
    """ln of the probability of a window's composition: arrangements times compositions of its kind over all windows."""
    counts = sorted(Counter(symbols).values(), reverse=True)
    length = len(symbols)
    arrangements = math.lgamma(length + 1) - sum(math.lgamma(c + 1) for c in counts)
    kinds = math.lgamma(alphabet + 1) - sum(math.lgamma(r + 1) for r in Counter(counts).values()) - math.lgamma(alphabet - len(counts) + 1)
    return arrangements + kinds - length * math.log(alphabet)


def best_part(symbols: list, alphabet: int, most_cut: int = 100, high: bool = False) -> tuple[int, int, float]:
    """(left, right, ln probability) of the least probable part that leaves out at most ``most_cut`` symbols.

    Longer parts and, among equals, earlier ones come first.  With ``high`` the
    most probable part is taken.
    """
    n, sign = len(symbols), -1.0 if high else 1.0
    best, at = (100.0 if high else 0.0), (0, n - 1)
    for length in range(n, max(1, n - most_cut), -1):
        for left in range(n - length + 1):
            p = sign * window_log_probability(symbols[left : left + length], alphabet)
            if p < best:
                best, at = p, (left, left + length - 1)
    return *at, sign * best


def optimised(series: DataFrame, found: DataFrame, alphabet: int, most_cut: int = 100, high: bool = False) -> DataFrame:
    """Each segment's best part: ``(id, left, right, log_probability)``."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        left, right, p = best_part(group["symbol"].tolist(), alphabet, most_cut, high)
        first = int(group["left"].iloc[0])
        return pd.DataFrame({"id": [group["id"].iloc[0]], "left": [first + left], "right": [first + right], "log_probability": [p]})

    kind = dict(series.dtypes)["id"]
    rows = series.join(found, "id").where(F.col("pos").between(F.col("left"), F.col("right"))).select("id", "pos", "symbol", "left")
    return rows.groupBy("id", "left").applyInPandas(one, f"id {kind}, left long, right long, log_probability double")


def vector_classes(vectors: list, distance: float) -> list[int]:
    """Symbols for a series of vectors: each takes the class of the first earlier representative nearer than ``distance``."""
    found: list = []
    out = []
    for v in vectors:
        at = next((i for i, r in enumerate(found) if sum((x - y) ** 2 for x, y in zip(v, r, strict=True)) < distance * distance), None)
        if at is None:
            found.append(v)
            at = len(found) - 1
        out.append(at)
    return out


def classified(series: DataFrame, distance: float) -> DataFrame:
    """``(id, pos, vector)`` to ``(id, pos, symbol)`` by ``vector_classes``, one series at a time."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        return pd.DataFrame({"id": group["id"], "pos": group["pos"], "symbol": [str(c) for c in vector_classes(list(group["vector"]), distance)]})

    kind = dict(series.dtypes)["id"]
    return series.groupBy("id").applyInPandas(one, f"id {kind}, pos long, symbol string")
