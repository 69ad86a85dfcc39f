"""Greedy selection in rounds over blocks against the same choice in one task; components of links."""

import random

import numpy as np
import pytest

from tessella.operators import clusters, greedy, msa
from tessella.operators.components import connected


def alignment(rng, name, n, length, families, changes):
    heads = [rng.choice(list("ARNDCQEG"), length) for _ in range(families)]
    rows = []
    for i in range(n):
        s = heads[rng.integers(families)].copy()
        at = rng.random(length) < changes
        s[at] = rng.choice(list("ARNDCQEGX-"), at.sum())
        lo, hi = sorted(rng.integers(0, length, 2)) if i and rng.random() < 0.4 else (0, length)
        rows.append((name, i, "-" * int(lo) + "".join(s[lo:hi]) + "-" * int(length - hi)))
    return rows


@pytest.mark.parametrize(("identity", "wanted"), [(0.9, 1000), (0.9, 20)])
def test_rounds_take_what_one_task_takes(spark, monkeypatch, identity, wanted):
    monkeypatch.setattr(greedy, "BLOCK", 8)
    monkeypatch.setattr(greedy, "WINDOW", 3)
    rng = np.random.default_rng(3)
    rows = alignment(rng, "a", 50, 24, 6, 0.15) + alignment(rng, "b", 30, 20, 3, 0.3) + alignment(rng, "c", 1, 10, 1, 0.0) + alignment(rng, "d", 40, 20, 40, 0.0)
    rows += [("d", 100 + i, rows[-1][2]) for i in range(20)]  # a third of one alignment are copies
    cells = msa.cells(spark.createDataFrame(rows, "msa_id string, seq_id long, seq string")).cache()
    whole = {tuple(r) for r in clusters.select_sequences(cells, identity, least=0.84, wanted=wanted, fragment=9).collect()}
    rounds = {tuple(r) for r in clusters.select_sequences(cells, identity, least=0.84, wanted=wanted, fragment=9, small=100).collect()}
    assert rounds == whole and len(whole) == len(rows) and 4 < sum(s for _, _, s in whole) < len(rows)


def test_shares_against_counting():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-1, 4, (5, 9)).astype(np.int8), rng.integers(-1, 4, (7, 9)).astype(np.int8)
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            both = (a >= 0) & (b >= 0)
            assert greedy.shares(x, y)[i, j] == pytest.approx((a == b)[both].mean() if both.any() else 0.0)


def brute_labels(links):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for part, a, b in links:
        x, y = top((part, a)), top((part, b))
        up[max(x, y)] = min(x, y)
    return {(*x, top(x)[1]) for x in list(up)}


def test_components_of_chains_stars_and_random_links(spark):
    rng = random.Random(5)
    links = [("chain", i, i + 1) for i in range(60)] + [("star", 99, i) for i in range(50)] + [("zigzag", 2 * i, 101 - 2 * (i // 2)) for i in range(40)]
    links += [("random", rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [("star", 99, 3), ("chain", 5, 4), ("loop", 7, 7)]
    got = {tuple(r) for r in connected(spark.createDataFrame(links, "part string, a long, b long")).collect()}
    assert got == brute_labels([x for x in links if x[1] != x[2]])
    assert connected(spark.createDataFrame([], "part string, a long, b long")).count() == 0


def test_clusters_of_alignments_of_many_blocks(spark):
    """Blocks of two sequences: 40 blocks, more than one square of 32."""
    rng = np.random.default_rng(8)
    rows = alignment(rng, "a", 80, 24, 12, 0.1) + alignment(rng, "b", 10, 20, 2, 0.1)
    cells = msa.cells(spark.createDataFrame(rows, "msa_id string, seq_id long, seq string")).cache()
    whole = {tuple(r) for r in clusters.single_linkage(cells, 0.8).collect()}
    assert {tuple(r) for r in clusters.single_linkage(cells, 0.8, block=2).collect()} == whole
    assert 3 < len({(m, c) for m, _, c, _ in whole}) < 60
