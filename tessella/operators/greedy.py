"""Greedy selection of sequences in alignments of any size, in rounds over blocks.

The greedy choice takes sequences in a fixed order, each unless one taken before
it is too much like it.  That is the first independent set of a graph, and a
sequence's place in it hangs on earlier sequences alone, so rounds decide many
at once and give the same set:

1. sequences lie in blocks of consecutive places in the order; a round looks at
   the first ``WINDOW`` blocks of each alignment that have open sequences;
2. pairs of these blocks tell which sequences are too much like an open one of
   an earlier block;
3. each block is gone through in order: what is like a sequence just taken is
   left, what is like an open one waits, and anything else is taken; the first
   block has nothing to wait for, so every round closes one block at least;
4. what was taken is compared with all other sequences, block by block, and
   the highest identity of each is kept.

No pair of sequences leaves a task, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import alphabet as A
from tessella.operators import msa
from tessella.sources.shared import written

BLOCK = 1024
WINDOW = 8
_ROW = ["msa_id", "seq_id", "at", "block", "v", "lo", "hi", "highest"]


def shares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Identity of all rows of codes of ``x`` with all of ``y`` over columns that both know (codes from 0); 0 without any."""
    segment = (x >= 0).astype(np.float32) @ (y >= 0).astype(np.float32).T
    same = np.zeros(segment.shape, np.float32)
    for c in np.intersect1d(x[x >= 0], y[y >= 0]):
        same += (x == c).astype(np.float32) @ (y == c).astype(np.float32).T
    return np.divide(same.astype(float), segment, out=np.zeros(segment.shape), where=segment > 0)


def _codes(part: pa.Table, rows: np.ndarray) -> np.ndarray:
    """Codes of some rows of a table as a matrix."""
    held = part["v"].combine_chunks().take(pa.array(np.flatnonzero(rows)))
    return held.flatten().to_numpy().astype(np.int8).reshape(int(rows.sum()), -1)


def ordered(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences over the match columns in order of their identity with the query, and one row for each alignment.

    ``(msa_id, seq_id, at, block, v, lo, hi, highest)`` without the queries: codes
    (-1 where a column does not count), the first and last column inside the
    sequence's ends, its identity with the query.  ``at`` ascends in the order in
    which an alignment's sequences are offered.
    """
    columns = msa.match_states(table).select("msa_id", "pos", (F.col("state") - 1).cast("int").alias("col"))
    cells = msa.trimmed(table).join(columns, ["msa_id", "pos"])
    cells = cells.select("msa_id", "seq_id", "col", F.when(F.col("used") & (F.col("code") < A.X), F.col("code")).otherwise(-1).alias("c"), F.when(F.col("used"), F.col("col")).alias("own"))
    listed = F.array_sort(F.collect_list(F.struct("col", "c")))
    rows = cells.groupBy("msa_id", "seq_id").agg(F.transform(listed, lambda x: x["c"]).alias("v"), F.min("own").alias("lo"), F.max("own").alias("hi"))
    rows = written(rows, "sequences")
    least = rows.groupBy("msa_id").agg(F.min("seq_id").alias("seq_id"), F.count("*").alias("n"))
    queries = written(rows.join(least, ["msa_id", "seq_id"]).select("msa_id", F.col("seq_id").alias("query"), F.col("v").alias("qv"), "n"), "queries")
    both = F.zip_with("v", "qv", lambda a, b: F.when((a >= 0) & (b >= 0), (a == b).cast("int")))
    known = F.filter(both, lambda x: x.isNotNull())
    alike = F.aggregate(known, F.lit(0), lambda t, x: t + x)
    rest = rows.join(queries, "msa_id").where(F.col("seq_id") != F.col("query"))
    rest = rest.withColumn("highest", F.when(F.size(known) > 0, alike / F.size(known)).otherwise(0.0))
    keys = ["msa_id", F.desc("level"), "seq_id"]
    rest = rest.withColumn("level", F.rint(1000 * F.col("highest"))).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rest = rest.withColumn("at", F.monotonically_increasing_id()).withColumn("block", F.floor(F.col("at") / BLOCK))
    out = rest.select("msa_id", "seq_id", "at", "block", "v", F.coalesce("lo", F.lit(0)).alias("lo"), F.coalesce("hi", F.lit(-1)).alias("hi"), "highest")
    return written(out, "ordered"), queries.select("msa_id", "n", F.size("qv").alias("length"))


def _waiting(window: DataFrame) -> DataFrame:
    """``at`` of sequences that are too much like an open one of an earlier block of the window."""
    blocks = window.select("msa_id", "block").distinct()
    pairs = blocks.withColumnRenamed("block", "first").join(blocks.withColumnRenamed("block", "second"), "msa_id").where("first < second")
    sides = [window.join(pairs, (window["msa_id"] == pairs["msa_id"]) & (window["block"] == pairs[side])).drop(pairs["msa_id"]) for side in ("first", "second")]

    def compared(part: pa.Table) -> pa.Table:
        late = part["block"].to_numpy() == part["second"][0].as_py()
        if late.all() or not late.any():
            return pa.table({"at": pa.array([], pa.int64())})
        near = shares(_codes(part, ~late), _codes(part, late)) >= part["limit"].to_numpy()[late]
        return pa.table({"at": part["at"].to_numpy()[late][near.any(axis=0)]})

    return sides[0].unionByName(sides[1]).groupBy("msa_id", "first", "second").applyInArrow(compared, "at long").distinct()


def _taken(window: DataFrame, waiting: DataFrame) -> DataFrame:
    """``at`` of the sequences that the round takes."""

    def chosen(part: pa.Table) -> pa.Table:
        part = part.sort_by("at")
        near = shares(codes := _codes(part, np.ones(len(part), bool)), codes)
        limit, waits = part["limit"].to_numpy(), part["waits"].to_numpy(zero_copy_only=False).copy()
        taken = np.zeros(len(part), bool)
        for i in range(len(part)):
            alike = near[:i, i] >= limit[i]
            if not (alike & taken[:i]).any():
                waits[i] = waits[i] or bool((alike & waits[:i]).any())
                taken[i] = not waits[i]
            else:
                waits[i] = False
        return pa.table({"at": part["at"].to_numpy()[taken]})

    marked = window.join(waiting.withColumn("waits", F.lit(True)), "at", "left").withColumn("waits", F.coalesce("waits", F.lit(False)))
    return marked.groupBy("msa_id", "block").applyInArrow(chosen, "at long")


def _raised(rest: DataFrame, taken: DataFrame) -> DataFrame:
    """``rest`` with the highest identity to what was ``taken`` taken into account, block by block."""
    pairs = taken.select("msa_id", F.col("block").alias("given")).distinct().join(rest.select("msa_id", "block").distinct(), "msa_id")
    pairs = written(pairs, "pairs")
    given = taken.select("msa_id", "at", "v", F.col("block").alias("given"), F.lit(True).alias("new")).join(pairs, ["msa_id", "given"])
    held = rest.select("msa_id", "at", "v", "block", F.lit(False).alias("new")).join(pairs, ["msa_id", "block"])

    def compared(part: pa.Table) -> pa.Table:
        new = part["new"].to_numpy(zero_copy_only=False)
        if new.all() or not new.any():
            return pa.table({"at": pa.array([], pa.int64()), "most": pa.array([], pa.float64())})
        return pa.table({"at": part["at"].to_numpy()[~new], "most": shares(_codes(part, new), _codes(part, ~new)).max(axis=0)})

    found = given.unionByName(held).groupBy("msa_id", "given", "block").applyInArrow(compared, "at long, most double")
    most = written(found.groupBy("at").agg(F.max("most").alias("most")), "most")
    return rest.join(most, "at", "left").withColumn("highest", F.greatest("highest", F.coalesce("most", F.lit(0.0)))).select(_ROW)


def _asked(columns: DataFrame, now: float, wanted: int, fragment: int) -> DataFrame:
    """One row for each alignment, ``(msa_id, length, steps, ask)``, to the same with columns that still ask asking for ``now``; others are left out.

    ``steps`` are changes in the number of sequences that a column has, one or two
    for each sequence's ends, summed by column before.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept, asks = [], []
            for row in frame.itertuples():
                change = np.zeros(row.length + 1, np.int64)
                for step in row.steps if row.steps is not None else ():
                    change[step["col"]] += step["d"]
                full = np.concatenate([[0], np.cumsum(1 + np.cumsum(change[: row.length]) >= wanted)])
                at = np.arange(row.length)
                lo = np.maximum(0, at - fragment // 2)
                end = lo + fragment >= row.length
                hi = np.where(end, row.length - 1, lo + fragment)
                lo = np.where(end, max(0, row.length - 1 - fragment), lo)
                asking = full[hi + 1] == full[lo]
                ask = np.array(row.ask, float)
                ask[asking] = now
                kept.append(bool(asking.any()))
                asks.append(ask)
            yield frame.assign(ask=asks)[["msa_id", "length", "ask"]][np.array(kept, bool)]

    kind = dict(columns.dtypes)["msa_id"]
    return columns.mapInPandas(run, f"msa_id {kind}, length int, ask array<double>")


def _one_pass(rest: DataFrame, limits: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """One pass over ``rest`` with a limit for each sequence that is offered: what is left, and what each round took."""
    out = []
    while True:
        open_ = rest.join(limits, "at").where(F.col("highest") < F.col("limit"))
        blocks = open_.select("msa_id", "block").distinct().withColumn("k", F.row_number().over(Window.partitionBy("msa_id").orderBy("block")))
        window = written(open_.join(blocks.where(F.col("k") <= WINDOW).drop("k"), ["msa_id", "block"]), "window")
        if window.isEmpty():
            return rest, out
        chosen = written(_taken(window, _waiting(window)), "chosen")
        taken = written(window.join(chosen, "at", "left_semi").select(_ROW), "taken")
        out.append(taken)
        rest = written(_raised(rest.join(chosen, "at", "left_anti"), taken), "rest")


def select(table: DataFrame, identity: float, least: float, wanted: int, fragment: int) -> DataFrame:
    """``(msa_id, seq_id, selected)``: as ``clusters.select_sequences``, for alignments that no task could hold."""
    rows, alignments = ordered(table)
    done: list[DataFrame] = []
    for large in (False, True):
        whole = alignments.where(F.col("n") > wanted if large else F.col("n") <= wanted)
        state = written(whole.select("msa_id", "length", F.array_repeat(F.lit(0.0), F.col("length")).alias("ask")), "columns")
        rest = rows.join(whole.select("msa_id"), "msa_id", "left_semi")
        step, now = max(0.01, min(0.05, wanted * 1e-4)), least if large else identity
        own: list[DataFrame] = []
        while now <= identity + 1e-12 and not state.isEmpty():
            ends = [t.where("lo <= hi").select("msa_id", F.explode(F.array(F.struct(F.col("lo").alias("col"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("col"), F.lit(-1).alias("d")))).alias("e")) for t in own]
            if ends:
                steps = ends[0]
                for t in ends[1:]:
                    steps = steps.unionByName(t)
                steps = steps.groupBy("msa_id", F.col("e.col").alias("col")).agg(F.sum("e.d").cast("int").alias("d"))
                steps = steps.groupBy("msa_id").agg(F.collect_list(F.struct("col", "d")).alias("steps"))
                asked = state.join(steps, "msa_id", "left")
            else:
                asked = state.withColumn("steps", F.lit(None).cast("array<struct<col:int,d:int>>"))
            state = written(_asked(asked, now, wanted, fragment), "columns")
            limit = F.coalesce(F.array_max(F.slice("ask", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1)), F.lit(0.0))
            limits = rest.where("lo <= hi").join(state, "msa_id").select("at", limit.alias("limit")).where("limit > 0")
            rest, taken = _one_pass(rest, written(limits, "limits"))
            own += taken
            now += step
        done += own
    chosen = None
    for t in done:
        chosen = t.select("msa_id", "seq_id") if chosen is None else chosen.unionByName(t.select("msa_id", "seq_id"))
    ids = table.select("msa_id", F.col("seq_id").cast("long").alias("seq_id")).distinct()
    first = ids.groupBy("msa_id").agg(F.min("seq_id").alias("seq_id"))
    chosen = first if chosen is None else chosen.unionByName(first)
    return ids.join(chosen.withColumn("selected", F.lit(True)), ["msa_id", "seq_id"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
