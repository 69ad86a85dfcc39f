"""Places for documents of like vocabulary.

A router is fitted on a bounded sample of documents, each given by the set of
its token ids hashed to ``BINS`` bins.  It is a balanced tree: a node splits its
part of the sample at the median of its first principal axis, over unit vectors
of inverse document frequencies.  Below the tree, the signs on the principal
axes of the whole sample go on.  All bits in order are a document's place, so
documents that lie close by place use like words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 4096
LEVELS = 5
AXES = 16
#: Documents of the sample below which a node is not split.
LEAST = 16
STEPS = 12


def bins(ids: np.ndarray) -> np.ndarray:
    """The bins of token ids."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)


def presence(docs: list[np.ndarray]) -> np.ndarray:
    """Documents by bins: 1 where the document has a token of the bin."""
    out = np.zeros((len(docs), BINS), np.float32)
    for row, ids in zip(out, docs, strict=True):
        row[bins(ids)] = 1
    return out


def _axes(x: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` principal axes of centred rows, by subspace iteration."""
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((x.shape[1], n)))[0].astype(np.float32)
    for _ in range(STEPS):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    return q


@dataclass(frozen=True)
class Router:
    """Columns of ``weights`` and ``least``: the tree's nodes in heap order, then the axes of the whole sample."""

    squares: np.ndarray
    weights: np.ndarray
    least: np.ndarray

    def places(self, x: np.ndarray) -> np.ndarray:
        """One number of LEVELS + AXES bits for each row of ``presence``."""
        length = np.sqrt(np.maximum(x @ self.squares, 1e-30))
        above = (x @ self.weights) / length[:, None] > self.least
        at = np.zeros(len(x), np.int64)
        out = np.zeros(len(x), np.int64)
        for _ in range(LEVELS):
            bit = above[np.arange(len(x)), at]
            out, at = out * 2 + bit, 2 * at + 1 + bit
        for k in range(AXES):
            out = out * 2 + above[:, 2**LEVELS - 1 + k]
        return out


def fit(x: np.ndarray) -> Router:
    """A router from the ``presence`` of sampled documents; without any, all places are 0."""
    nodes = 2**LEVELS - 1
    weights = np.zeros((BINS, nodes + AXES), np.float32)
    least = np.full(nodes + AXES, np.inf, np.float32)
    df = x.sum(axis=0)
    idf = np.log1p((len(x) - df + 0.5) / (df + 0.5)).astype(np.float32)
    if len(x) >= LEAST:
        unit = x * idf
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        parts = {0: np.arange(len(x))}
        for node in range(nodes):
            rows = parts.pop(node, np.zeros(0, np.int64))
            if len(rows) < LEAST:
                continue
            axis = _axes(unit[rows] - unit[rows].mean(axis=0), 1)[:, 0]
            value = unit[rows] @ axis
            weights[:, node], least[node] = idf * axis, np.median(value)
            parts[2 * node + 1], parts[2 * node + 2] = rows[value <= least[node]], rows[value > least[node]]
        axes = _axes(unit - unit.mean(axis=0), AXES)
        weights[:, nodes:], least[nodes:] = idf[:, None] * axes, np.median(unit @ axes, axis=0)
    return Router(idf**2, weights, least)
