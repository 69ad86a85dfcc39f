"""Seeded generators: labelled clusters, shuffled fragments, random alignments, context samples.

Every draw is keyed by an id and a seed, so a retried task makes the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import alphabet as A
from tessella.functions.vectors import scaled, superposed

BUCKETS = 1024


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) fixed by the keys and the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def below(seed: int, bound: Column, *keys: Column) -> Column:
    """A whole number in [0, bound) fixed by the keys and the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), bound)


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with a number ``n`` from 0 on, fixed by the keys.

    Rows are numbered inside hash buckets, which are numbered by their sizes
    before them, so only a table of ``BUCKETS`` rows is ordered as a whole.
    """
    placed = rows.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    sizes = placed.groupBy("_b").agg(F.count("*").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_b", before.alias("_o")))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*keys)) - 1
    return placed.withColumn("_i", inside).join(offsets, "_b").withColumn("n", F.col("_o") + F.col("_i")).drop("_b", "_i", "_o")


def labelled_clusters(spark: SparkSession, clusters: int, size: int, dim: int, seed: int, spread: float = 5.0) -> DataFrame:
    """``(vec_id, cluster, mixed, x)``: normal vectors around random centres; ``mixed`` is a label that ignores the cluster."""
    centres = np.random.default_rng(seed).normal(0, spread, (clusters, dim))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = frame["id"].to_numpy()
            x = [centres[i % clusters] + np.random.default_rng([seed, i]).normal(0, 1, dim) for i in ids]
            yield pd.DataFrame({"vec_id": ids, "cluster": ids % clusters, "mixed": ids // clusters % clusters, "x": x})

    return spark.range(clusters * size).mapInPandas(run, "vec_id long, cluster long, mixed long, x array<double>")


def shuffled_fragments(library: DataFrame, wanted: int, length: int, fragment: int, seed: int, edge: int = 40) -> DataFrame:
    """New series of ``length`` rows put together from random fragments of ``library(id, pos, ...)``.

    Each fragment comes from a random source and place, away from its ends by
    up to ``edge`` positions or a fifth of its length.  Sources are numbered, so
    the choice is a join on that number.
    """
    spark = library.sparkSession
    sizes = library.groupBy("id").agg(F.count("*").alias("size")).where(F.col("size") >= fragment)
    sources = numbered(sizes, "id")
    many = sources.count()
    parts = -(-length // fragment)
    grid = spark.range(wanted * parts).select(
        F.floor(F.col("id") / parts).alias("new_id"), (F.col("id") % parts).alias("part")
    )
    picked = grid.withColumn("n", below(seed, F.lit(max(many, 1)), F.col("new_id"), F.col("part"))).join(sources, "n")
    away = F.least(F.lit(edge), F.floor(F.col("size") / 5), F.floor((F.col("size") - fragment) / 2))
    room = F.col("size") - fragment - 2 * away + 1
    begin = away + below(seed + 1, room, F.col("new_id"), F.col("part")) + 1
    spans = picked.select("new_id", "part", "id", begin.alias("begin"), F.explode(F.sequence(F.lit(0), F.lit(fragment - 1))).alias("k"))
    spans = spans.withColumn("pos", F.col("begin") + F.col("k"))
    at = F.col("part") * fragment + F.col("k") + 1
    rows = spans.join(library, ["id", "pos"]).withColumn("new_pos", at).where(F.col("new_pos") <= length)
    rest = [c for c in library.columns if c not in ("id", "pos")]
    return rows.select("new_id", "new_pos", F.col("id").alias("source_id"), F.col("pos").alias("source_pos"), *rest)


def shuffled_elements(library: DataFrame, wanted: int, length: int, seed: int, edge: int = 40) -> DataFrame:
    """New series of ``length`` rows put together from whole runs of one state of ``library(id, pos, state, ...)``.

    Runs are numbered over the library and drawn by hash; a run within ``edge``
    positions (or a fifth of its source) of an end is not drawn, and the last
    run is cut where the series is full.
    """
    spark = library.sparkSession
    by = Window.partitionBy("id").orderBy("pos")
    change = F.when(F.lag("state").over(by).eqNullSafe(F.col("state")), 0).otherwise(1)
    runs = library.withColumn("_c", change).withColumn("run", F.sum("_c").over(by)).drop("_c")
    spans = runs.groupBy("id", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    size = F.max("last").over(Window.partitionBy("id"))
    away = F.least(F.lit(edge), F.floor(size / 5))
    inner = spans.withColumns({"away": away, "size": size}).where((F.col("first") > F.col("away")) & (F.col("last") <= F.col("size") - F.col("away")))
    known = numbered(inner.select("id", "run", "first", "last"), "id", "run")
    many = known.count()
    grid = spark.range(wanted * length).select(F.floor(F.col("id") / length).alias("new_id"), (F.col("id") % length).alias("draw"))
    drawn = grid.withColumn("n", below(seed, F.lit(max(many, 1)), F.col("new_id"), F.col("draw"))).join(known, "n")
    before = F.coalesce(F.sum(F.col("last") - F.col("first") + 1).over(Window.partitionBy("new_id").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = drawn.withColumn("before", before).where(F.col("before") < length)
    rows = placed.select("new_id", "id", "before", "first", F.explode(F.sequence("first", "last")).alias("pos"))
    rows = rows.withColumn("new_pos", F.col("before") + F.col("pos") - F.col("first") + 1).where(F.col("new_pos") <= length)
    rest = [c for c in library.columns if c not in ("id", "pos")]
    return rows.join(library, ["id", "pos"]).select("new_id", "new_pos", F.col("id").alias("source_id"), F.col("pos").alias("source_pos"), *rest)


def noisy(probs: np.ndarray, weight: float, rng: np.random.Generator) -> np.ndarray:
    """(1 - weight) * probs + weight * a logistic-normal draw."""
    draw = np.exp(rng.standard_normal(probs.shape))
    return (1 - weight) * probs + weight * draw / draw.sum(axis=-1, keepdims=True)


def markov_alignment(
    spark: SparkSession, alignments: int, width: int, length: int, seed: int, noise: float = 0.0, emission: np.ndarray | None = None
) -> DataFrame:
    """``(msa_id, seq_id, seq)``: sequences walked through match, insert and delete states of a model.

    ``emission`` is a profile (length by 20) or None for the background.  The
    first sequence has no insertions and no deletions.  Sequences are aligned by
    match column, insertions of a column in lower case behind it.
    """
    moves = np.array([[0.9, 0.05, 0.05], [0.6, 0.4, 0.0], [0.6, 0.0, 0.4]])
    base = np.tile(np.array(A.BACKGROUND) / sum(A.BACKGROUND), (length, 1)) if emission is None else np.asarray(emission)

    def one(msa: int, seq: int) -> str:
        model = np.random.default_rng([seed, msa])
        step, emit = noisy(moves, noise, model) if noise else moves, noisy(base, noise, model) if noise else base
        rng = np.random.default_rng([seed, msa, seq])
        out, state, column = "", 0, 0
        while column < len(emit):
            state = 0 if seq == 0 else rng.choice(3, p=step[state] / step[state].sum())
            if state == 1 and column:
                out += A.SYMBOLS[rng.choice(20, p=emit[column - 1] / emit[column - 1].sum())].lower()
                continue
            out += A.SYMBOLS[rng.choice(20, p=emit[column] / emit[column].sum())] if state != 2 else A.SYMBOLS[A.GAP]
            column += 1
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            msa, seq = frame["id"].to_numpy() // width, frame["id"].to_numpy() % width
            yield pd.DataFrame({"msa_id": msa, "seq_id": seq, "seq": [one(int(m), int(s)) for m, s in zip(msa, seq, strict=True)]})

    return spark.range(alignments * width).mapInPandas(run, "msa_id long, seq_id long, seq string")


def width_for(target: float, effective, low: int = 1, high: int = 400) -> int:
    """The least width whose effective number of sequences, by ``effective(width)``, reaches ``target``; by bisection."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if effective(mid) >= target else (mid + 1, high)
    return low


def _weighted(vectors: list[Column], weights: list[float]) -> Column:
    out = scaled(vectors[0], F.lit(weights[0]))
    for v, w in zip(vectors[1:], weights[1:], strict=True):
        out = superposed(out, v, F.lit(w))
    return out


def sampled_contexts(series: DataFrame, wanted: int, size: int, seed: int, weights: list[float] | None = None, three: bool = False) -> DataFrame:
    """Windows of ``size`` vectors around positions of ``series(id, pos, x)``, taken at the rate wanted / positions.

    Which positions are taken depends on id, position and seed alone.  Without
    ``weights`` a context is its vectors one after another, with them their
    weighted sum, and with ``three`` the weighted means of the left half, of the
    centre and of the right half one after another.  Positions without a whole
    window are not taken.
    """
    half = size // 2
    frame = Window.partitionBy("id").orderBy("pos").rowsBetween(-half, size - 1 - half)
    windows = series.withColumn("near", F.collect_list("x").over(frame)).where(F.size("near") == size)
    rate = series.agg((F.lit(float(wanted)) / F.greatest(F.count("*"), F.lit(1))).alias("rate"))
    taken = windows.crossJoin(F.broadcast(rate)).where(uniform(seed, F.col("id"), F.col("pos")) < F.col("rate"))
    if weights is None:
        return taken.select("id", "pos", F.flatten("near").alias("context"))
    if three:
        parts = [(range(half), weights[:half]), ((half,), [1.0]), (range(half + 1, size), weights[half + 1 :])]
        sums = [_weighted([F.get("near", k) for k in at], [w / sum(ws) for w in ws]) for at, ws in parts]
        return taken.select("id", "pos", F.concat(*sums).alias("context"))
    return taken.select("id", "pos", _weighted([F.get("near", k) for k in range(size)], weights).alias("context"))


def variates(kind: str, rng: np.random.Generator, n: int, **par) -> np.ndarray:
    """Random variates by name: discrete, beta, chi2, exponential, gamma, t, dirichlet, normal vectors, t vectors."""
    if kind == "discrete":
        return rng.choice(len(par["p"]), n, p=par["p"])
    if kind == "beta":
        return rng.beta(par["a"], par["b"], n)
    if kind == "chi2":
        return rng.chisquare(par["df"], n)
    if kind == "exponential":
        return rng.exponential(par.get("scale", 1.0), n)
    if kind == "gamma":
        return rng.gamma(par["shape"], par.get("scale", 1.0), n)
    if kind == "t":
        return rng.standard_t(par["df"], n)
    if kind == "dirichlet":
        return rng.dirichlet(par["alpha"], n)
    if kind == "mvnormal":
        return rng.multivariate_normal(par["mean"], par["cov"], n)
    if kind == "mvt":
        z = rng.multivariate_normal(np.zeros(len(par["mean"])), par["cov"], n)
        return np.asarray(par["mean"]) + z / np.sqrt(rng.chisquare(par["df"], (n, 1)) / par["df"])
    raise ValueError(f"no variates named {kind}")
