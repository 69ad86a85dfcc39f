"""Scores of pairs of profile positions, their masking and scaling, and what turns a score into an expectation.

Schemes are functions of columns; a registry names them.  Lookup tables are
small DataFrames that the caller broadcasts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import alphabet as A
from tessella.functions import special
from tessella.functions.vectors import dot, total
from tessella.operators import search

#: Fixed values of the schemes.
OFFSET = 0.0003
STATE_OFFSET, STATE_SHARE = 0.05, 9.0
CLUSTER_RANGE = (0.0, 3.0)


def log_sum_score(q: Column, s: Column, bg: Column) -> Column:
    """ln sum q_a s_a / bg_a less a small offset; ``bg`` is the mean background of both profiles."""
    shares = F.zip_with(F.zip_with(q, s, lambda a, b: a * b), bg, lambda x, b: x / b)
    return F.ln(total(shares)) - OFFSET


def thickness_weight(n: Column) -> Column:
    """1 - (1 + ln n) / n; 0 where nothing was observed."""
    return F.when(n > 0, 1.0 - (1.0 + F.ln(n)) / n).otherwise(0.0)


def profile_score(qf: Column, ss: Column, sf: Column, qs: Column, qn: Column | None = None, sn: Column | None = None) -> Column:
    """Frequencies of each against log-odds of the other, weighted by observations where they are given."""
    if qn is None:
        return dot(qf, ss) + dot(sf, qs)
    a, b = thickness_weight(qn), thickness_weight(sn)
    even = (a <= 0) & (b <= 0)
    a, b = F.when(even, 1.0).otherwise(a), F.when(even, 1.0).otherwise(b)
    whole = F.when(sn == 0, 1.0).otherwise(a + b)
    return 2 * a / whole * dot(qf, ss) + 2 * b / whole * dot(sf, qs)


SCHEMES: dict[str, Callable[..., Column]] = {"log_sum": log_sum_score, "profile": profile_score}


def overlap_score(total_overlap: Column, q_background: Column, s_background: Column) -> Column:
    """ln of sum p q prior over both background probabilities, within CLUSTER_RANGE; 0 without overlap."""
    ratio = total_overlap / (q_background * s_background)
    low, high = CLUSTER_RANGE
    return F.when((total_overlap > 0) & (q_background > 0) & (s_background > 0), F.least(F.lit(high), F.greatest(F.lit(low), F.ln(ratio)))).otherwise(0.0)


#: Clusters up to which memberships are held as dense vectors.
MOST_CLUSTERS = 4096


def overlap_totals(queries: DataFrame, subjects: DataFrame, priors: DataFrame, key: str, cluster: str) -> DataFrame:
    """``(query_id, subject_id, total)``: sum of p q / prior over the clusters that both share, where it is not 0.

    ``queries`` and ``subjects`` hold ``p`` by ``key`` and ``cluster``, ``priors``
    has ``cluster, prior``.  Memberships become vectors over clusters, divided by
    the root of their prior, so the sums are products of blocks of vectors and no
    common cluster brings all its holders together.
    """
    names = [r[0] for r in priors.select(cluster).orderBy(cluster).limit(MOST_CLUSTERS + 1).collect()]
    if len(names) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    held = F.broadcast(priors.where("prior > 0").select(cluster, "prior"))  # MOST_CLUSTERS rows

    def dense(shares: DataFrame) -> DataFrame:
        w = shares.join(held, cluster).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(cluster, F.col("p") / F.sqrt("prior")))).alias("w"))
        return w.select(key, F.transform(F.array(*map(F.lit, names)), lambda c: F.coalesce(F.element_at("w", c), F.lit(0.0))).alias("x"))

    def shared(qid: np.ndarray, sid: np.ndarray, total: np.ndarray) -> dict[str, np.ndarray]:
        i, j = np.nonzero(total > 0)
        return {"query_id": qid[i], "subject_id": sid[j], "total": total[i, j]}

    return search.scored(dense(queries), dense(subjects), key, "x", shared, "query_id long, subject_id long, total double", digits=None)


def damped(score: Column, q_eff: Column, s_eff: Column, q_prob: Column, s_prob: Column) -> Column:
    """A table score of two clusters, damped by effective sequences far from 23 and memberships below 1."""
    a, b = q_eff - 23.0, s_eff - 23.0
    by_size = 0.4 + 0.6 * F.exp(-1.5e-5 * (0.47 * F.pow(a, F.lit(4)) + 0.47 * F.pow(b, F.lit(4)) + 0.94 * a * a * b * b))
    c, d = q_prob - 1.0, s_prob - 1.0
    return score * by_size * F.exp(-7.5 * (0.37 * c * c + 0.37 * d * d + 2.34 * c * d))


def state_score(pairs: DataFrame, table: DataFrame, weight: float) -> DataFrame:
    """Expected table score over both positions' states: ``pairs(id, q ARRAY(C, E, H), s)`` and ``table(a, b, score)``.

    Equal last states other than coil add a bonus of their probabilities; a
    missing table cell of which the pair has some weight makes its score 0.
    """
    q = pairs.select("id", F.posexplode("q").alias("a", "pq"), "s")
    both = q.select("id", "a", "pq", F.posexplode("s").alias("b", "ps")).join(F.broadcast(table), ["a", "b"], "left")
    last = F.max(F.when((F.col("a") == 2) & (F.col("b") == 2), (F.col("pq") + 0.1) * (F.col("ps") + 0.1) / STATE_SHARE))
    sums = both.groupBy("id").agg(F.sum(F.col("pq") * F.col("ps") * F.col("score")).alias("t"), F.count_if(F.col("score").isNull() & (F.col("pq") * F.col("ps") > 0)).alias("gaps"), last.alias("bonus"))
    return sums.select("id", F.when(F.col("gaps") > 0, 0.0).otherwise(weight * (F.col("t") + F.col("bonus") - STATE_OFFSET)).alias("score"))


def table_score(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows(id, row, col, p1, p2, e1, e2)`` looked up in ``table(plvl, lvl, row, col, score)``.

    The levels are the highest not above the smaller probability and the smaller
    number of sequences; below the lowest level, and for missing cells, the
    score is 0.
    """
    low_p, low_e = F.least("p1", "p2"), F.least("e1", "e2")
    keyed = rows.withColumns({"_p": low_p, "_e": low_e, "_r": F.greatest("row", "col"), "_c": F.least("row", "col")})
    t = F.broadcast(table.select("plvl", "lvl", F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("score").alias("_s")))
    found = keyed.join(t, ["_r", "_c"], "left").where((F.col("plvl").isNull()) | ((F.col("plvl") <= F.col("_p")) & (F.col("lvl") <= F.col("_e"))))
    best = found.groupBy("id").agg(F.max_by("_s", F.struct("plvl", "lvl")).alias("s"))
    return rows.select("id").join(best, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("score"))


def context_score(q: Column, s: Column, q_norm: Column, s_norm: Column, q_prior: Column, s_prior: Column, kappa: float, c: float, power: float) -> Column:
    """Log-odds of two context vectors: c + power * ln det of their shifted 2 x 2 products, less both priors."""
    cross = dot(q, s) + kappa
    return c + power * F.ln((q_norm + 1 + kappa) * (s_norm + 1 + kappa) - cross * cross) - q_prior - s_prior


def masked_score(score: Column, q_info: Column, s_info: Column, threshold: float, scale: float, mode: str = "consider") -> tuple[Column, Column]:
    """Scores of positions with little information scaled down, and whether the cell counts in statistics.

    Modes: ``none``; ``consider`` (scaled, counted); ``ignore`` (scaled, not counted).
    """
    low = (q_info < threshold) | (s_info < threshold) if mode != "none" else F.lit(False)
    return F.when(low, score * scale).otherwise(score), ~low if mode == "ignore" else F.lit(True)


def information_threshold(evalue: Column, upper: float, numerator: float, scale: float, numerator_alt: float, scale_alt: float) -> Column:
    """Threshold of the second pass by the first pass's pair expectation; ``upper`` where it is not small."""
    value = F.ln(evalue)
    new = F.greatest(upper + numerator / (value - scale), -numerator_alt / (value + scale_alt))
    small = (evalue > 0) & (evalue < math.exp(-scale_alt)) & (evalue < math.exp(scale)) & (evalue != 1.0)
    return F.when(small, F.when(new < 0, F.lit(upper)).otherwise(F.least(new, F.lit(upper)))).otherwise(F.lit(upper))


def repaired(freqs: Column, residue: Column, least: float = 0.001) -> Column:
    """A row of frequencies without any above ``least``: background for X, the two residues for B and Z, else the residue itself."""
    pair = lambda a, b: [round(100 * A.BACKGROUND[k] / (A.BACKGROUND[a] + A.BACKGROUND[b])) / 100 if k in (a, b) else 0.0 for k in range(20)]
    fixed = lambda values: F.array(*(F.lit(float(v)) for v in values))
    size = F.size(freqs)
    wide = lambda row: F.concat(row, F.array_repeat(F.lit(0.0), size - 20))
    own = F.transform(F.sequence(F.lit(0), size - 1), lambda i: (i == residue).cast("double"))
    new = F.when(residue == A.X, wide(fixed(A.BACKGROUND))).when(residue == A.B, wide(fixed(pair(A.N, A.D)))).when(residue == A.Z, wide(fixed(pair(A.Q, A.E))))
    return F.when(F.array_max(freqs) <= least, new.otherwise(own)).otherwise(freqs)


def diagonal_hits(cells: DataFrame, least: float, length: int, distance: int) -> DataFrame:
    """Pairs of ungapped hits on one diagonal at most ``distance`` apart.

    A hit is a window of ``length`` cells of a diagonal whose scores sum to at
    least ``least``; overlapping hits do not pair.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("id", F.col("q") - F.col("s")).orderBy("q")
    whole = by.rowsBetween(-(length - 1), 0)
    hits = cells.withColumns({"_sum": F.sum("score").over(whole), "_n": F.count("*").over(whole)}).where((F.col("_n") == length) & (F.col("_sum") >= least))
    before = F.max(F.struct("q", "_sum")).over(by.rangeBetween(-distance - length, -length))
    return hits.withColumn("_b", before).where("_b is not null").select(
        "id", (F.col("q") - F.col("s")).alias("diagonal"), F.col("_b.q").alias("first_end"), F.col("q").alias("second_end"), (F.col("_sum") + F.col("_b._sum")).alias("score")
    )


def transformed_scores(score: Column, c: float, lam: float) -> Column:
    """Scores shifted so that they reach a wanted entropy: score - 2 ln(c) / lambda."""
    return score - 2 * math.log(c) / lam


def powered_moves(moves: Column, index: list[float]) -> Column:
    """Nine probabilities of moves to the powers given for each, as probabilities."""
    powers = F.array(*(F.lit(float(x)) for x in index))
    return F.zip_with(moves, powers, lambda p, k: F.when(p > 0, F.exp(F.ln(p) * k)).otherwise(0.0))


def autocorrelation_correction(evalue: Column, upper: float, log_scale: float, denominator: float, entropy: float) -> Column:
    """Correction of the second pass: -1 / ((ln E + log_scale) * denominator), at most ``upper`` / sqrt(entropy)."""
    top = upper / math.sqrt(entropy) if entropy > 0 else upper
    bound = math.exp(-log_scale - 1.0 / (denominator * top))
    return F.when((evalue > 0) & (evalue <= bound), F.least(F.lit(top), -1.0 / ((F.ln(evalue) + log_scale) * denominator))).otherwise(F.lit(top))


def network(inputs: np.ndarray, weights: list[np.ndarray], symmetric: bool = True) -> np.ndarray:
    """A small network: each matrix has a bias row first; hidden units are logistic, or from -1 to 1 with ``symmetric``."""
    x = np.atleast_2d(inputs)
    for k, w in enumerate(weights):
        x = np.hstack([np.ones((len(x), 1)), x]) @ w
        if k < len(weights) - 1:
            x = 1 / (1 + np.exp(-x))
            x = 2 * x - 1 if symmetric else x
    return x


def extreme_value_expectation(score: float, mu: float, beta: float, k: float, k_ref: float) -> float:
    """exp(mu / beta - score / beta), times K / K_ref where K is the larger and both are below 1."""
    ratio = k / k_ref if k > k_ref and 0 < k < 1 and 0 < k_ref < 1 else 1.0
    return ratio * math.exp(min(700.0, max(-700.0, (mu - score) / beta)))


#: Fixed values of the combined significance.
FISHER_SHAPE, FISHER_SCALE, TAIL_SHAPE, TAIL_PROB = 1.346206, 1.485656, 0.1, 0.757213
POSITIVES, LENGTH_POWER, PER_PAIR = 100_000.0, 1.5, 1e-4


def combined_expectation(expect: float, positives: int, q_length: int, s_length: int, space: float, per_pair: float = PER_PAIR) -> float:
    """The expectation of a score joined with the tail of the positives' negative-binomial law, by the scaled Fisher method."""
    e = expect * per_pair
    p = e if e < 0.01 else -math.expm1(-e)
    x = round(positives * POSITIVES / float(q_length * s_length) ** LENGTH_POWER)
    tail = max(special.beta_i(x + 1, TAIL_SHAPE, TAIL_PROB), 1e-300)
    joint = special.gamma_q(FISHER_SHAPE, (-math.log(max(p, 1e-300)) - math.log(tail)) / FISHER_SCALE)
    pair = joint if joint < 0.01 else -math.log1p(-joint)
    return max(pair * space / (q_length * s_length), 1e-300)


def mixture_expectation(expectations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean of ``expectations(id, e1, l1, e2, l2, evalue)`` over bins of profile pairs, weighted by ``pairs(e1, l1, e2, l2, prob)``."""
    by = ["e1", "l1", "e2", "l2"]
    joined = expectations.join(F.broadcast(pairs.select(*by, "prob")), by)
    return joined.groupBy("id").agg((F.sum(F.col("evalue") * F.col("prob")) / F.sum("prob")).alias("evalue"))


def optimised_targets(targets: np.ndarray, rows: np.ndarray, cols: np.ndarray, entropy: float, steps: int = 200) -> np.ndarray:
    """Joint probabilities with the given marginals and relative entropy, closest to ``targets``.

    The minimum has the form target ** (1 - t) * (row * col) ** t scaled to the
    marginals; t is found by bisection and the scaling by alternating fits.
    """
    outer = np.outer(rows, cols)

    def fitted(t: float) -> np.ndarray:
        m = np.exp((1 - t) * np.log(np.maximum(targets, 1e-300)) + t * np.log(np.maximum(outer, 1e-300)))
        for _ in range(steps):
            m *= (rows / np.maximum(m.sum(axis=1), 1e-300))[:, None]
            m *= cols / np.maximum(m.sum(axis=0), 1e-300)
        return m

    def h(m: np.ndarray) -> float:
        return float(np.sum(m * np.log(np.maximum(m, 1e-300) / np.maximum(outer, 1e-300))))

    low, high = -4.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if h(fitted(mid)) > entropy else (low, mid)
    return fitted((low + high) / 2)
