"""Search of query vectors against a table of vectors, in blocks.

Rows are packed into blocks of up to ``BLOCK`` vectors where they lie; blocks of
subjects are dealt out evenly and meet blocks of queries, and matrix products give
all scores of the two, up to ``CELLS`` at a time.  What leaves a pair of blocks is
bounded: the best k of each query, or a histogram.  Histograms are added up in the
task before they leave it.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.shared import written

BLOCK = 1024
CELLS = 1 << 16  # what stays in a core's cache while it is rounded and counted
HELD = 1 << 21  # rows of counts that a task adds up at a time
DIGITS = 6


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows; a null among the numbers is not a number."""
    lengths = np.unique(np.diff(lists.offsets.to_numpy()))
    if len(lengths) > 1:
        raise ValueError("vectors of one block differ in length")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), lengths[0])


def packed(df: DataFrame, key: str, vector: str, prefix: str) -> DataFrame:
    """Blocks of ``df`` as rows of ids and a matrix of doubles; rows without a vector are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                mat = _matrix(part["v"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part["k"].to_numpy().tobytes()]), pa.array([mat.tobytes()]), pa.array([mat.shape[0]], pa.int32())],
                    [f"{prefix}_ids", f"{prefix}_mat", f"{prefix}_n"],
                )

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and k is not null")
    return rows.mapInArrow(run, f"{prefix}_ids binary, {prefix}_mat binary, {prefix}_n int")


def _each_pair(kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], scale: float, digits: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (q, s), (qid, sid) = ([np.frombuffer(batch[f"{p}_{part}"][at].as_buffer(), kind) for p in "qs"] for part, kind in (("mat", np.float64), ("ids", np.int64)))
                q, s = q.reshape(len(qid), -1), s.reshape(len(sid), -1)
                step = max(1, CELLS // len(s))
                for top in range(0, len(q), step):
                    scores = scale * (q[top : top + step] @ s.T)
                    yield pa.RecordBatch.from_pydict(kernel(qid[top : top + step], sid, scores if digits is None else np.round(scores, digits)))

    return run


def _summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``parts`` with their last column added up by the others, as far as ``HELD`` rows go."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += part.num_rows
        if n > HELD:
            held = _sums(held)
            n = sum(b.num_rows for b in held)
            if 2 * n > HELD:
                yield from held
                held, n = [], 0
    if held:
        yield from _sums(held)


def _sums(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    *by, last = names = parts[0].schema.names
    sums = pa.Table.from_batches(parts).group_by(by, use_threads=False).aggregate([(last, "sum")])
    return sums.select([*by, f"{last}_sum"]).rename_columns(names).to_batches()


def _spread(blocks: DataFrame) -> DataFrame:
    """Written blocks dealt evenly to tasks, however the files that they come from are cut."""
    n = blocks.count()
    return blocks.repartition(min(n, 2 * blocks.sparkSession.sparkContext.defaultParallelism)) if n > 1 else blocks


def scored(
    queries: DataFrame, subjects: DataFrame, key: str, vector: str, kernel, schema: str, scale: float = 1.0, digits: int | None = DIGITS, summed: bool = False
) -> DataFrame:
    """``kernel(query ids, subject ids, scores)`` over all pairs of blocks, which are written once, some whole rows at a time.

    Scores are rounded to ``digits``.  ``summed``: the kernel's last column counts
    and is added up by the others within a task, so that what leaves a task grows
    with queries and not with pairs of blocks; the rest of the sum is the caller's.
    """
    pairs = written(packed(queries, key, vector, "q"), "queries").crossJoin(_spread(written(packed(subjects, key, vector, "s"), "subjects")))
    each = _each_pair(kernel, scale, digits)
    return pairs.mapInArrow((lambda batches: _summed(each(batches))) if summed else each, schema)


def evalue(score: Column, lam: float, k: float, space: Column) -> Column:
    """Karlin-Altschul expectation K * space * exp(-lambda * score)."""
    return k * space * F.exp(-lam * score)


def pvalue(e: Column) -> Column:
    """1 - exp(-E), by E itself where E is small."""
    return F.when(e < 0.01, e).otherwise(-F.expm1(-e))


def bits(score: Column, lam: float, k: float) -> Column:
    return (lam * score - float(np.log(k))) / float(np.log(2.0))


def top_hits(queries: DataFrame, subjects: DataFrame, key: str, vector: str, k: int, scale: float = 1.0) -> DataFrame:
    """The ``k`` best subjects of each query: ``query_id, subject_id, score, rank``; ties by id."""

    def best(qid: np.ndarray, sid: np.ndarray, score: np.ndarray) -> dict[str, np.ndarray]:
        order = np.lexsort((np.broadcast_to(sid, score.shape), -score))[:, :k]
        return {
            "query_id": np.repeat(qid, order.shape[1]),
            "subject_id": sid[order].ravel(),
            "score": np.take_along_axis(score, order, 1).ravel(),
        }

    hits = scored(queries, subjects, key, vector, best, "query_id long, subject_id long, score double", scale)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "subject_id")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def counted(rows: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, value, count)`` of the values in a matrix of whole numbers, by what ``rows`` (from 0) names each of its rows."""
    if not whole.size:
        return (np.zeros(0, np.int64),) * 3
    low = int(whole.min())
    width, most = int(whole.max()) - low + 1, int(rows.max()) + 1
    flat = (whole - low + rows[:, None] * width).ravel()
    if width * most <= 4 * whole.size:
        n = np.bincount(flat, minlength=width * most)
        at = np.flatnonzero(n)
        n = n[at]
    else:  # values lie far apart
        at, n = np.unique(flat, return_counts=True)
    return at // width, at % width + low, n


def counted_sides(whole: np.ndarray, names: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``counted`` of each row, and of the columns by what ``names`` (from 0) names each of them; at once where names are few."""
    rows = np.arange(len(whole))
    if whole.size:
        low = int(whole.min())
        width, kinds = int(whole.max()) - low + 1, int(names.max()) + 1
        if width * kinds <= len(names):
            flat = (whole + (names * width - low) + rows[:, None] * (kinds * width)).ravel()
            cube = np.bincount(flat, minlength=len(rows) * kinds * width).reshape(len(rows), kinds, width)
            sums = cube.sum(1), cube.sum(0)
            return [(at, value + low, n[at, value]) for n, (at, value) in zip(sums, map(np.nonzero, sums), strict=True)]
    return [counted(rows, whole), counted(names, whole.T)]


def score_counts(queries: DataFrame, subjects: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``query_id, score, n``: how many subjects have each rounded score with each query."""

    def bins(qid: np.ndarray, sid: np.ndarray, score: np.ndarray) -> dict[str, np.ndarray]:
        at, whole, n = counted(np.arange(len(qid)), np.rint(score).astype(np.int64))
        return {"query_id": qid[at], "score": whole, "n": n}

    parts = scored(queries, subjects, key, vector, bins, "query_id long, score long, n long", scale, summed=True)
    return parts.groupBy("query_id", "score").agg(F.sum("n").alias("n"))


def length_adjustment(lam: float, k: float, alpha: float, beta: float, query: int, database: int, sequences: int) -> int:
    """The edge-effect length: the largest whole l with l <= beta + alpha / lambda * ln(K * space).

    The space left by l, (query - l) * (database - sequences * l), must keep
    K * space at or above the longer of both lengths.  Both conditions hold up to
    some l and fail beyond it, which is halved in on; 0 where even 0 fails.
    """
    if min(query, database, sequences) <= 0 or lam <= 0 or k <= 0:
        return 0

    def holds(cut: int) -> bool:
        space = (query - cut) * (database - sequences * cut)
        return k * space >= max(query, database) and beta + alpha / lam * math.log(k * space) >= cut

    # every cut from here on leaves no space
    beyond = min(query, -(-database // sequences))
    whole = range(beyond)
    return max(0, bisect.bisect_left(whole, True, key=lambda cut: not holds(cut)) - 1)
