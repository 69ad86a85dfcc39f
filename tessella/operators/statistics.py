"""Statistics of score distributions: lambda, relative entropy, scaling, derived parameters."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find_lambda(scores: Iterable[float], probs: Iterable[float]) -> float | None:
    """The positive root of sum p exp(lambda s) = 1; None unless the mean is negative and some score positive."""
    pairs = [(float(s), float(p)) for s, p in zip(scores, probs, strict=True) if p > 0]
    if not pairs or sum(s * p for s, p in pairs) >= 0 or max(s for s, _ in pairs) <= 0:
        return None

    def excess(x: float) -> float:
        top = max(s * x for s, _ in pairs)
        return (sum(p * math.exp(s * x - top) for s, p in pairs) * math.exp(top) if top < 700 else math.inf) - 1

    high = 1.0
    while excess(high) < 0:
        high *= 2
    low = high / 2
    while excess(low) > 0:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return (low + high) / 2


def lambda_by(histogram: DataFrame, by: list[str]) -> DataFrame:
    """Lambda of each group of ``histogram(by..., score, p)``; a group is a histogram, so it is small."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        head = {c: [group[c].iloc[0]] for c in by}
        return pd.DataFrame(head | {"lambda": [find_lambda(group["score"], group["p"])]})

    kinds = dict(histogram.dtypes)
    keep = histogram.select(*by, F.col("score").cast("double"), F.col("p").cast("double"))
    return keep.groupBy(*by).applyInPandas(one, ", ".join([*(f"{c} {kinds[c]}" for c in by), "lambda double"]))


def entropy_given_lambda(score: Column, p: Column, lam: float) -> Column:
    """Relative entropy lambda * sum s p exp(lambda s), as an aggregate."""
    return lam * F.sum(score * p * F.exp(lam * score))


def scale_to_lambda(scores: list[float], probs: list[float], target: float) -> float:
    """The factor by which scores are multiplied so that their lambda becomes ``target``."""
    found = find_lambda(scores, probs)
    if not found:
        raise ValueError("the scores have no lambda")
    return found / target


def karlin_k(scores: list[int], probs: list[float], lam: float, h: float, terms: int = 60) -> float:
    """K of the ungapped statistics on an integer lattice, by the published series over sums of k scores."""
    step = math.gcd(*(abs(s) for s, p in zip(scores, probs, strict=True) if s and p > 0))
    dist = {s // step: p for s, p in zip(scores, probs, strict=True) if p > 0}
    lam *= step
    low, high = min(dist), max(dist)
    if low == -1 and high == 1:
        up, down = dist.get(1, 0.0), dist.get(-1, 0.0)
        return (up - down) ** 2 / down
    if low == -1 or high == 1:
        mean = sum(s * p for s, p in dist.items())
        return (h / lam if high == 1 else mean**2 / (h / lam)) * (1 - math.exp(-lam))
    now, total = {0: 1.0}, 0.0
    for k in range(1, terms + 1):
        after: dict[int, float] = {}
        for s, p in now.items():
            for t, q in dist.items():
                after[s + t] = after.get(s + t, 0.0) + p * q
        now = after
        part = sum(p * (math.exp(lam * s) if s < 0 else 1.0) for s, p in now.items()) / k
        total += part
        if part < 1e-10:
            break
    return lam * math.exp(-2 * total) / (h * (1 - math.exp(-lam)))


def derived_gapped(lam: Column, k: Column, ref: dict[str, float]) -> tuple[Column, Column]:
    """Gapped lambda and K in proportion to the reference's gapped and ungapped values."""
    return lam * ref["gapped_lambda"] / ref["lambda"], k * ref["gapped_k"] / ref["k"]


def mean_length(expect: Column, k: float, h: float, space: Column) -> Column:
    """Mean alignment length of an expectation: ln(K * space / E) / H; 0 for a negative E, 1e5 without space or entropy."""
    bad = (expect <= 0) | (space <= 0) | F.lit(k <= 0 or h <= 0)
    return F.when(expect < 0, F.lit(0.0)).when(bad, F.lit(1.0e5)).otherwise(F.ln(k * space / expect) / h)
