"""Score tables chosen by levels: of effective sequences, of cluster probabilities, of state probabilities.

A set of tables is one long table ``(e_low, e_high, p_low, p_high, s_low, s_high,
row, col, score)``.  Each level is the lower bound of a bin that reaches to the
next level of its kind; a table belongs to a pair of bins of each kind, the
lower of both positions' values first.  ``row`` and ``col`` are keys of the two
positions, the larger one first: a cluster, a state, or ``pair_key`` of both.

A value below the lowest level of its kind scores 0, and so does a missing cell.
Where a pair of bins has no table, the one of the highest bins not above them
counts (compared by the lower one first); 0 where there is none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("e", "p", "s")
LEVELS = [f"{k}_{end}" for k in KINDS for end in ("low", "high")]
#: Cells of a set of tables that the driver and every task may hold.
MOST_CELLS = 1 << 22
STATES = 3


def pair_key(cluster: Column, state: Column) -> Column:
    """One key of a cluster and one of three states."""
    return cluster * STATES + state


def _held(table: DataFrame) -> list:
    rows = table.select(*LEVELS, "row", "col", "score").limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    return rows


def level_scores(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """``pairs(id, key1, key2, e1, e2, p1, p2, s1, s2)`` to ``(id, score)``.

    Both positions' bins are found among the tables' levels, then the table, then
    the cell; tables are joined by broadcast, behind a count of their cells.
    """
    table = table.select(*LEVELS, "row", "col", "score")
    if table.limit(MOST_CELLS + 1).count() > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    known = table.select(*LEVELS).distinct()
    sets = {k: known.select(F.array_sort(F.array_union(F.collect_set(f"{k}_low"), F.collect_set(f"{k}_high")))).first()[0] for k in KINDS}
    bins = {}
    for k in KINDS:
        levels = F.array(*(F.lit(float(x)) for x in sets[k])).cast("array<double>")
        for end, value in (("low", F.least(f"{k}1", f"{k}2")), ("high", F.greatest(f"{k}1", f"{k}2"))):
            bins[f"_{k}_{end}"] = _bin(levels, value)
    rows = pairs.withColumns({"row": F.greatest("key1", "key2").cast("int"), "col": F.least("key1", "key2").cast("int"), **bins})
    whole = F.col("key1").isNotNull() & F.col("key2").isNotNull()
    for k in KINDS:
        whole &= F.col(f"{k}1").isNotNull() & F.col(f"{k}2").isNotNull() & F.col(f"_{k}_low").isNotNull()
    # which table each combination of bins takes: a few rows
    asked = rows.where(whole).select(*(f"_{x}" for x in LEVELS)).distinct()
    below = F.lit(True)
    for x in LEVELS:
        below &= F.col(x) <= F.col(f"_{x}")
    taken = asked.join(F.broadcast(known), below).groupBy(*(f"_{x}" for x in LEVELS)).agg(F.max(F.struct(*LEVELS)).alias("t"))
    chosen = taken.select(*(f"_{x}" for x in LEVELS), "t.*")
    cells = F.broadcast(chosen.join(table, LEVELS).select(*(f"_{x}" for x in LEVELS), "row", "col", "score"))
    found = rows.where(whole).select("id", *(f"_{x}" for x in LEVELS), "row", "col").join(cells, [*(f"_{x}" for x in LEVELS), "row", "col"], "left")
    rest = rows.where(~F.coalesce(whole, F.lit(False))).select("id", F.lit(0.0).alias("score"))
    return found.select("id", F.coalesce("score", F.lit(0.0)).alias("score")).unionByName(rest)


def _bin(levels: Column, value: Column) -> Column:
    """The highest level not above a value; null below the lowest."""
    return F.array_max(F.filter(levels, lambda x: x <= value))


@dataclass(frozen=True)
class LevelTables:
    """A set of tables held whole, for scores of all pairs of positions of two profiles."""

    levels: dict[str, tuple[float, ...]]
    tables: dict[tuple[float, ...], np.ndarray]

    @staticmethod
    def of(table: DataFrame) -> LevelTables:
        return LevelTables.from_rows(_held(table))

    @staticmethod
    def from_rows(rows: list) -> LevelTables:
        """From rows in the order of the long table's columns; a missing cell is not a number."""
        size = 1 + max((max(r[6], r[7]) for r in rows), default=-1)
        tables: dict[tuple[float, ...], np.ndarray] = {}
        for r in rows:
            key = tuple(float(x) for x in r[:6])
            cells = tables.setdefault(key, np.full((size, size), np.nan))
            cells[r[6], r[7]] = cells[r[7], r[6]] = np.nan if r[8] is None else r[8]
        levels = {k: tuple(sorted({key[2 * i + j] for key in tables for j in (0, 1)})) for i, k in enumerate(KINDS)}
        return LevelTables(levels, tables)

    def scores(self, q: dict[str, np.ndarray], s: dict[str, np.ndarray]) -> np.ndarray:
        """Scores of all pairs: ``key`` (below 0: none), ``e``, ``p`` and ``s`` of each position of both."""
        n, m = len(q["key"]), len(s["key"])
        out = np.zeros((n, m))
        if not self.tables:
            return out
        bins, usable = [], (q["key"] >= 0)[:, None] & (s["key"] >= 0)[None, :]
        for k in KINDS:
            levels = np.array(self.levels[k])
            a, b = (np.searchsorted(levels, x[k], side="right") - 1 for x in (q, s))
            usable &= (a >= 0)[:, None] & (b >= 0)[None, :]
            bins += [np.minimum(a[:, None], b[None, :]), np.maximum(a[:, None], b[None, :])]
        stacked = np.stack([np.where(usable, x, -1) for x in bins], axis=-1)
        for combination in np.unique(stacked[usable], axis=0) if usable.any() else ():
            wanted = tuple(self.levels[KINDS[i // 2]][j] for i, j in enumerate(combination))
            key = max((t for t in self.tables if all(x <= y for x, y in zip(t, wanted, strict=True))), default=None)
            if key is None:
                continue
            at = usable & (stacked == combination).all(axis=-1)
            i, j = np.nonzero(at)
            x, y = q["key"][i], s["key"][j]
            cells = self.tables[key]
            inside = (x < len(cells)) & (y < len(cells))
            out[i[inside], j[inside]] = np.nan_to_num(cells[x[inside], y[inside]], nan=0.0)
        return out
