"""Joint probabilities of pairs of positions brought to wanted marginals and relative entropy, for many pairs of profiles at once.

Given scores s of cells with probabilities r and c of their row and column, the
joint probabilities closest to r c exp(s) that have r and c as marginals and a
wanted entropy relative to r c have the form r c exp(theta s + a + b), with one
number for each row, each column and the whole.  Newton steps find these for a
batch of matrices together: one linear system for each matrix, solved in one
call.  Matrices of different sizes share a batch; rows and columns of
probability 0 fill them up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of the linear systems that are solved in one call.
BATCH = 1 << 22
#: Largest relative change of a constraint at which a matrix is done; steps and halvings of a step at most.
TOLERANCE, STEPS, HALVINGS = 1e-9, 60, 30


def positive_lambda(scores: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each matrix of a batch the positive root of sum r c exp(lambda s) = 1; nan where the mean is not negative or nothing is positive."""
    w = r[:, :, None] * c[:, None, :]
    top = np.where(w > 0, scores, -np.inf).max(axis=(1, 2))
    fit = ((w * scores).sum(axis=(1, 2)) < 0) & (top > 0)
    low, high = np.zeros(len(scores)), np.where(fit, 1.0 / np.where(fit, top, 1.0), 1.0)

    def excess(lam: np.ndarray) -> np.ndarray:
        z = lam[:, None, None] * np.where(w > 0, scores, 0.0)
        shift = z.max(axis=(1, 2), keepdims=True)
        return np.log((w * np.exp(z - shift)).sum(axis=(1, 2))) + shift[:, 0, 0]

    for _ in range(200):
        short = fit & (excess(high) < 0)
        if not short.any():
            break
        low, high = np.where(short, high, low), np.where(short, 2 * high, high)
    for _ in range(100):
        mid = (low + high) / 2
        under = excess(mid) < 0
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return np.where(fit, (low + high) / 2, np.nan)


def _residual(log: np.ndarray, w: np.ndarray, r: np.ndarray, c: np.ndarray, entropy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joint probabilities for their logarithm over r c, and what the constraints (rows, columns, entropy) miss."""
    q = w * np.exp(np.minimum(log, 700.0))
    h = (q * log).sum(axis=(1, 2))
    return q, np.concatenate([q.sum(axis=2) - r, q.sum(axis=1) - c, (h - entropy)[:, None]], axis=1)


def optimised(scores: np.ndarray, r: np.ndarray, c: np.ndarray, entropy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(log(q / (r c)), done)`` of a batch: scores in units of lambda, probabilities, the wanted entropies (nats).

    ``done`` is false where no such probabilities were found, as for an entropy
    above what the marginals allow; the logarithm is then that of the scores.
    """
    b, n, m = scores.shape
    w = r[:, :, None] * c[:, None, :]
    s = np.where(w > 0, scores, 0.0)
    # what depends on a row or a column alone is in their numbers; without it large scores do not overflow
    by_row, by_col = (s * c[:, None, :]).sum(axis=2), (s * r[:, :, None]).sum(axis=1)
    s = np.where(w > 0, s - by_row[:, :, None] - by_col[:, None, :] + (by_row * r).sum(axis=1)[:, None, None], 0.0)
    rows, cols = r > 0, c > 0
    theta, x, y = np.ones(b), np.zeros((b, n)), np.zeros((b, m))
    log = lambda t, u, v: np.where(w > 0, t[:, None, None] * s + u[:, :, None] + v[:, None, :], 0.0)
    for _ in range(20):  # a start near the marginals
        with np.errstate(divide="ignore", invalid="ignore"):
            x -= np.where(rows, np.log(_residual(log(theta, x, y), w, r, c, entropy)[0].sum(axis=2) / np.where(rows, r, 1.0)), 0.0)
            y -= np.where(cols, np.log(_residual(log(theta, x, y), w, r, c, entropy)[0].sum(axis=1) / np.where(cols, c, 1.0)), 0.0)
    q, miss = _residual(log(theta, x, y), w, r, c, entropy)
    size = n + m + 1
    for _ in range(STEPS):
        worst = np.abs(miss).max(axis=1)
        going = worst > TOLERANCE
        if not going.any():
            break
        at = np.flatnonzero(going)
        own, l1 = q[at], log(theta, x, y)[at] + 1
        jac = np.zeros((len(at), size, size))
        i, j = np.arange(n), np.arange(m)
        jac[:, i, i] = own.sum(axis=2) + ~rows[at]
        jac[:, n + j, n + j] = own.sum(axis=1) + ~cols[at]
        jac[:, :n, n : n + m] = own
        jac[:, n : n + m, :n] = own.transpose(0, 2, 1)
        jac[:, :n, -1] = (own * s[at]).sum(axis=2)
        jac[:, n : n + m, -1] = (own * s[at]).sum(axis=1)
        jac[:, -1, :n] = (own * l1).sum(axis=2)
        jac[:, -1, n : n + m] = (own * l1).sum(axis=1)
        jac[:, -1, -1] = (own * l1 * s[at]).sum(axis=(1, 2))
        # one column's number is free, as rows and columns sum to the same
        last = m - 1 - np.argmax(cols[at][:, ::-1], axis=1)
        k = np.arange(len(at))
        jac[k, n + last, :] = 0.0
        jac[k, n + last, n + last] = 1.0
        wanted = miss[at].copy()
        wanted[k, n + last] = 0.0
        try:
            step = np.linalg.solve(jac, wanted[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:  # a matrix of equal scores
            step = (np.linalg.pinv(jac) @ wanted[:, :, None])[:, :, 0]
        length = np.ones(len(at))
        for _ in range(HALVINGS):
            t = theta.copy()
            u, v = x.copy(), y.copy()
            t[at] -= length * step[:, -1]
            u[at] -= length[:, None] * step[:, :n]
            v[at] -= length[:, None] * step[:, n : n + m]
            q2, miss2 = _residual(log(t, u, v), w, r, c, entropy)
            worse = ~(np.abs(miss2[at]).max(axis=1) < worst[at])
            if not worse.any():
                break
            length[worse] /= 2
        better = at[~worse]
        theta[better], x[better], y[better], q[better], miss[better] = t[better], u[better], v[better], q2[better], miss2[better]
        if not len(better):
            break
    done = np.abs(miss).max(axis=1) <= TOLERANCE * 10
    return np.where(done[:, None, None], log(theta, x, y), scores), done


def rescored(matrices: list[np.ndarray], entropy: float) -> list[np.ndarray]:
    """Score matrices with the scores that joint probabilities of a wanted relative entropy (nats) give, in the units of the old ones.

    All positions of a profile are alike.  A matrix whose mean score is not
    negative, or that cannot have the entropy, stays as it is.
    """
    out = list(matrices)
    n, m = (max(s.shape[k] for s in matrices) for k in (0, 1))
    batch, r, c = np.zeros((len(out), n, m)), np.zeros((len(out), n)), np.zeros((len(out), m))
    for k, s in enumerate(out):
        batch[k, : s.shape[0], : s.shape[1]] = s
        r[k, : s.shape[0]], c[k, : s.shape[1]] = 1 / s.shape[0], 1 / s.shape[1]
    lam = positive_lambda(batch, r, c)
    fit = np.flatnonzero(~np.isnan(lam))
    if len(fit):
        logs, done = optimised(lam[fit, None, None] * batch[fit], r[fit], c[fit], np.full(len(fit), entropy))
        for k, log, ok in zip(fit, logs, done, strict=True):
            if ok:
                a, b = out[k].shape
                out[k] = log[:a, :b] / lam[k]
    return out


def batches(shapes: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Numbers of matrices in the order of their size, as many at once as ``BATCH`` allows."""
    order = sorted(range(len(shapes)), key=lambda k: shapes[k])
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * (sum(np.max([shapes[k] for k in order[at : to + 1]], axis=0)) + 1) ** 2 <= BATCH:
            to += 1
        yield order[at:to]
        at = to


def joint_probabilities(pairs: DataFrame) -> DataFrame:
    """``pairs(id, scores, r, c, entropy)`` to ``(id, joint, done)``: scores in units of lambda, probabilities of rows and columns.

    ``joint`` is null where no such probabilities exist or any input is null.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = [np.array([*map(list, x)], float) for x in frame["scores"]]
            joint: list = [None] * len(frame)
            for part in batches([x.shape for x in scores]):
                n, m = np.max([scores[k].shape for k in part], axis=0)
                s, r, c = np.zeros((len(part), n, m)), np.zeros((len(part), n)), np.zeros((len(part), m))
                for i, k in enumerate(part):
                    a, b = scores[k].shape
                    s[i, :a, :b], r[i, :a], c[i, :b] = scores[k], frame["r"].iloc[k], frame["c"].iloc[k]
                log, done = optimised(s, r, c, frame["entropy"].to_numpy(float)[part])
                for i, k in enumerate(part):
                    a, b = scores[k].shape
                    if done[i]:
                        joint[k] = (np.outer(r[i, :a], c[i, :b]) * np.exp(log[i, :a, :b])).tolist()
            yield pd.DataFrame({"id": frame["id"], "joint": joint, "done": [x is not None for x in joint]})

    whole = pairs.select(F.col("id").cast("long").alias("id"), "scores", "r", "c", F.col("entropy").cast("double").alias("entropy")).dropna()
    found = whole.mapInPandas(run, "id long, joint array<array<double>>, done boolean")
    rest = pairs.where(F.col("scores").isNull() | F.col("r").isNull() | F.col("c").isNull() | F.col("entropy").isNull())
    return found.unionByName(rest.select(F.col("id").cast("long").alias("id"), F.lit(None).cast("array<array<double>>").alias("joint"), F.lit(False).alias("done")))
