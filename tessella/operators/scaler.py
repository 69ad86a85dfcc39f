"""Scores of all pairs of distinct vectors, their distribution, and the factor that brings it to a wanted lambda."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import search, statistics
from tessella.sources.shared import written


def pair_distribution(vectors: DataFrame, scale: float, offset: float = 0.0) -> DataFrame:
    """``(score, p)``: rounded scores of all unordered pairs of ``vectors(id, x, p)``, weighted by both probabilities."""
    return _distribution(_blocks(vectors), scale, offset)


def _blocks(vectors: DataFrame) -> DataFrame:
    """Blocks of vectors and their probabilities, written once, so that both sides of a pair are cut alike."""
    keyed = vectors.select("id", F.concat(F.array("p"), F.col("x").cast("array<double>")).alias("x"))
    return written(search.packed(keyed, "id", "x", "q").withColumn("q_no", F.monotonically_increasing_id()), "blocks")


def _distribution(blocks: DataFrame, scale: float, offset: float) -> DataFrame:
    """As ``pair_distribution``.

    Blocks of vectors meet once: a block is paired with itself and with blocks
    numbered after it, so work is spread over pairs of blocks, and only a
    histogram leaves each.
    """
    other = blocks.select(*(F.col(c).alias(c.replace("q_", "s_")) for c in blocks.columns))
    pairs = blocks.crossJoin(other).where("q_no <= s_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = (np.frombuffer(row[f"{k}_mat"]).reshape(row[f"{k}_n"], -1) for k in "qs")
                w = np.outer(a[:, 0], b[:, 0])
                if row["q_no"] == row["s_no"]:
                    w = np.triu(w) + np.triu(w, 1)
                else:
                    w = 2 * w
                score = np.rint(np.round(scale * (a[:, 1:] @ b[:, 1:].T) - offset, search.DIGITS)).astype(np.int64)
                low = int(score.min())
                p = np.bincount((score - low).ravel(), w.ravel())
                at = np.flatnonzero(p)
                yield pa.RecordBatch.from_pydict({"score": at + low, "p": p[at]})

    parts = pairs.mapInArrow(run, "score long, p double").groupBy("score").agg(F.sum("p").alias("p"))
    whole = parts.agg(F.sum("p").alias("t"))
    return parts.crossJoin(F.broadcast(whole)).select("score", (F.col("p") / F.col("t")).alias("p"))


def scaled_to(vectors: DataFrame, wanted: float, offset: float, scale: float = 1.0, rounds: int = 20, tolerance: float = 1e-3) -> dict[str, float]:
    """Scale, lambda, entropy and expected score once lambda is within ``tolerance`` of ``wanted``.

    Each round multiplies the scale by lambda over the wanted one; a round's
    distribution has one row for each whole score.
    """
    lam, blocks = None, _blocks(vectors)
    for _ in range(rounds):
        rows = _distribution(blocks, scale, offset * scale).collect()
        lam = statistics.find_lambda([r.score for r in rows], [r.p for r in rows])
        if lam is None:
            raise ValueError("the scores have no lambda")
        if abs(lam / wanted - 1) <= tolerance:
            break
        scale *= lam / wanted
    h = lam * sum(r.score * r.p * np.exp(lam * r.score) for r in rows)
    return {"scale": scale, "lambda": lam, "entropy": float(h), "expected": float(sum(r.score * r.p for r in rows))}
