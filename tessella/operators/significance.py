"""Expectations of pairs of profiles from location and scale of their scores.

Two small networks, whose weights the caller brings, predict an extreme-value
law for a pair: one the location from both thicknesses and lengths, one location
and scale from lambda and both lengths.  Both predictions are corrected linearly
and blended by shares that depend on lambda.  All of it is column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of the networks' outputs, bounds of location and scale, and how lambda moves the shares.
LOCATION_UNIT, LEAST_LOCATION = 30.0, 3.0
SCALE_UNIT, LEAST_SCALE, MOST_SCALE = 5.0, 0.1, 5.0
SHARE_STEP, MOST_INVERSE = 0.1, 10.0

Weights = Sequence[Sequence[Sequence[float]]]


def network(inputs: list[Column], weights: Weights, symmetric: bool = True) -> list[Column]:
    """A network's outputs: each matrix has a bias row first; hidden units are logistic, or from -1 to 1 with ``symmetric``."""
    now = inputs
    for k, w in enumerate(weights):
        now = [sum((x * float(w[i + 1][j]) for i, x in enumerate(now)), start=F.lit(float(w[0][j]))) for j in range(len(w[0]))]
        if k < len(weights) - 1:
            now = [1 / (1 + F.exp(-x)) for x in now]
            now = [2 * x - 1 if symmetric else x for x in now]
    return now


@dataclass(frozen=True)
class PairModel:
    """Weights of both networks, slopes and intercepts of the corrections, and the shares of the blends.

    ``by_thickness``: 4 inputs (thickness and ln length of the thicker profile,
    then of the other), one output.  ``by_lambda``: 3 inputs (lambda, ln of the
    larger and of the smaller length), two outputs.  ``scale_factor`` turns the second
    network's scale into factor * (exp(scale) - 1).
    """

    by_thickness: Weights
    by_lambda: Weights
    location: tuple[float, float] = (1.0, 0.0)
    location_by_lambda: tuple[float, float] = (1.0, 0.0)
    scale: tuple[float, float] = (0.1, 0.0)
    scale_factor: float = 1.0
    location_share: float = 0.5
    scale_share: float = 0.5

    def law(self, q_thick: Column, q_length: Column, s_thick: Column, s_length: Column, lam: Column) -> tuple[Column, Column]:
        """Location and scale of the scores of a pair."""
        first = (q_thick > s_thick) | ((q_thick == s_thick) & (q_length >= s_length))
        side = lambda a, b: [F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)]
        (t1, t2), (l1, l2) = side(q_thick, s_thick), side(q_length, s_length)
        mu_e = F.greatest(F.lit(LEAST_LOCATION), LOCATION_UNIT * network([t1, F.ln(l1), t2, F.ln(l2)], self.by_thickness)[0])
        mu_l, scale_l = network([lam, F.ln(F.greatest(q_length, s_length)), F.ln(F.least(q_length, s_length))], self.by_lambda)
        mu_l = F.greatest(F.lit(LEAST_LOCATION), LOCATION_UNIT * mu_l)
        bounded = lambda x: F.least(F.lit(MOST_SCALE), F.greatest(F.lit(LEAST_SCALE), x))
        scale_e = bounded(self.scale[0] * mu_e + self.scale[1])
        scale_l = bounded(self.scale_factor * (F.exp(F.greatest(F.lit(LEAST_SCALE), SCALE_UNIT * scale_l)) - 1))
        inverse = SHARE_STEP * F.least(F.lit(MOST_INVERSE), 1 / lam)
        share = self.location_share * (1 - inverse)
        mu = share * (self.location[0] * mu_e + self.location[1]) + (1 - share) * (self.location_by_lambda[0] * mu_l + self.location_by_lambda[1])
        other = self.scale_share + (1 - self.scale_share) * inverse
        return mu, (1 - other) * scale_e + other * scale_l


def expectation(score: Column, law: tuple[Column, Column], k: Column, k_ref: float) -> Column:
    """exp((location - score) / scale), times K / K_ref where K is the larger and both are below 1."""
    mu, scale = law
    usable = (k > k_ref) & (k > 0) & (k < 1)
    ratio = F.when(usable, k / k_ref).otherwise(F.lit(1.0)) if 0 < k_ref < 1 else F.lit(1.0)
    return ratio * F.exp((mu - score) / scale)


def over_space(pair: Column, q_length: Column, s_length: Column, space: Column) -> Column:
    """The expectation of a pair carried over to a search space."""
    return pair * space / (q_length * s_length)
