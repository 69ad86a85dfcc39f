"""Scoring schemes, masks, corrections and combined significance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import alphabet as A
from tessella.operators import msa, scoring


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def array(*values):
    return F.array(*(F.lit(float(v)) for v in values))


def test_schemes(spark):
    q, s, bg = (0.5, 0.3, 0.2), (0.1, 0.6, 0.3), (0.4, 0.4, 0.2)
    got = one(spark, scoring.log_sum_score(array(*q), array(*s), array(*bg)), scoring.profile_score(array(*q), array(1, 2, 3), array(*s), array(0, 1, 1)))
    assert got[0] == pytest.approx(math.log(sum(a * b / c for a, b, c in zip(q, s, bg))) - 0.0003)
    assert got[1] == pytest.approx(0.5 + 0.6 + 0.6 + 0.9)
    w = lambda n: 1 - (1 + math.log(n)) / n
    weighted = one(spark, scoring.profile_score(array(1), array(2), array(1), array(3), F.lit(4.0), F.lit(9.0)))[0]
    assert weighted == pytest.approx(2 * (w(4) * 2 + w(9) * 3) / (w(4) + w(9)))
    assert one(spark, scoring.overlap_score(F.lit(0.5), F.lit(0.1), F.lit(0.1)), scoring.overlap_score(F.lit(0.0), F.lit(0.1), F.lit(0.1))) == [3.0, 0.0]
    assert one(spark, scoring.damped(F.lit(2.0), F.lit(23.0), F.lit(23.0), F.lit(1.0), F.lit(1.0)))[0] == pytest.approx(2.0)


def test_states_and_tables(spark):
    pairs = spark.createDataFrame([(1, [0.2, 0.3, 0.5], [0.1, 0.1, 0.8])], "id long, q array<double>, s array<double>")
    table = spark.createDataFrame([(a, b, float(a == b)) for a in range(3) for b in range(3)], "a int, b int, score double")
    wanted = 2.0 * (0.02 + 0.03 + 0.4 + 0.6 * 0.9 / 9 - 0.05)
    assert scoring.state_score(pairs, table, 2.0).first().score == pytest.approx(wanted)
    assert scoring.state_score(pairs, table.where("a <> 0"), 2.0).first().score == 0.0
    rows = spark.createDataFrame([(1, 0, 1, 0.9, 0.6, 5.0, 9.0), (2, 1, 0, 0.4, 0.9, 5.0, 5.0), (3, 1, 1, 0.9, 0.9, 9.0, 9.0)], "id long, row int, col int, p1 double, p2 double, e1 double, e2 double")
    levels = spark.createDataFrame([(0.5, 3.0, 1, 0, 1.0), (0.5, 6.0, 1, 0, 2.0), (0.8, 3.0, 1, 0, 3.0), (0.5, 3.0, 1, 1, None)], "plvl double, lvl double, row int, col int, score double")
    assert {r.id: r.score for r in scoring.table_score(rows, levels).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_masks_and_corrections(spark):
    score, counted = scoring.masked_score(F.lit(4.0), F.lit(0.1), F.lit(0.5), 0.2, 0.5, "ignore")
    assert one(spark, score, counted) == [2.0, False]
    assert one(spark, *scoring.masked_score(F.lit(4.0), F.lit(0.1), F.lit(0.5), 0.2, 0.5, "none")) == [4.0, True]
    t = lambda e: one(spark, scoring.information_threshold(F.lit(e), 0.3, 4.4, 4.0, 1.0, 3.0))[0]
    assert t(1.0) == 0.3 and t(0.5) == 0.3 and 0 <= t(1e-30) < 0.3
    c = lambda e: one(spark, scoring.autocorrelation_correction(F.lit(e), 4.0, 14.0, 0.12, 0.2))[0]
    assert c(1.0) == pytest.approx(4 / math.sqrt(0.2)) and c(1e-40) == pytest.approx(-1 / ((math.log(1e-40) + 14) * 0.12))
    powered = one(spark, scoring.powered_moves(array(0.5, 0.25, 0.0), [1.0, 2.0, 1.0]))[0]
    assert powered == pytest.approx([0.5, 0.0625, 0.0])
    assert one(spark, scoring.transformed_scores(F.lit(1.0), math.e, 2.0))[0] == pytest.approx(0.0)
    zero = F.array_repeat(F.lit(0.0), 25)
    x, b, r, kept = one(spark, *(scoring.repaired(zero, F.lit(k)) for k in (A.X, A.B, 4)), scoring.repaired(array(0.5, 0.5), F.lit(0)))
    assert x[:20] == pytest.approx(A.BACKGROUND) and sum(b) == pytest.approx(1) and b[A.N] > 0 and r[4] == 1.0 and sum(r) == 1.0 and kept == [0.5, 0.5]


def test_diagonal_hits(spark):
    rows = [("m", i, i + 2, 3.0 if i in (2, 3, 9, 10) else -1.0) for i in range(1, 15)]
    cells = spark.createDataFrame(rows, "id string, q long, s long, score double")
    got = [(r.first_end, r.second_end, r.score) for r in scoring.diagonal_hits(cells, 6.0, 2, 8).collect()]
    assert got == [(3, 10, 12.0)] and scoring.diagonal_hits(cells, 6.0, 2, 3).count() == 0


def test_significance():
    assert scoring.extreme_value_expectation(10.0, 10.0, 2.0, 0.1, 0.2) == 1.0
    assert scoring.extreme_value_expectation(12.0, 10.0, 2.0, 0.4, 0.2) == pytest.approx(2 / math.e)
    values = [scoring.combined_expectation(e, p, 100, 120, 1e6) for e, p in ((1.0, 0), (1e-3, 0), (1e-3, 30))]
    assert values[0] > values[1] > values[2] > 0
    out = scoring.network(np.array([[0.5, 1.0]]), [np.array([[0.1], [1.0], [-1.0]]), np.array([[0.0], [2.0]])])
    assert out[0, 0] == pytest.approx(2 * (2 / (1 + math.exp(0.4)) - 1))
    rng = np.random.default_rng(0)
    t = rng.random((4, 4)) + np.eye(4)
    t /= t.sum()
    rows, cols = np.full(4, 0.25), np.array([0.1, 0.2, 0.3, 0.4])
    fit = scoring.optimised_targets(t, rows, cols, 0.2)
    assert np.allclose(fit.sum(axis=0), cols) and np.allclose(fit.sum(axis=1), rows, atol=1e-6)
    assert (fit * np.log(fit / np.outer(rows, cols))).sum() == pytest.approx(0.2, abs=1e-6)


def test_target_frequencies_with_ratios(spark):
    rows = [("m", 1, "AR"), ("m", 2, "AN")]
    cells = msa.cells(spark.createDataFrame(rows, "msa_id string, seq_id long, seq string"))
    freqs = msa.match_frequencies(cells, msa.sequence_weights(cells))
    even = spark.createDataFrame([(a, b, 1.0) for a in range(20) for b in range(20)], "code int, other int, ratio double")
    plain = {(r.pos, r.code): r.target for r in msa.target_frequencies(freqs).collect()}
    same = {(r.pos, r.code): r.target for r in msa.target_frequencies(freqs, even).collect()}
    assert plain == pytest.approx(same)


def test_mixture_expectation(spark):
    pairs = spark.createDataFrame([(2, 50, 2, 50, 0.25), (4, 50, 2, 50, 0.75)], "e1 int, l1 int, e2 int, l2 int, prob double")
    values = spark.createDataFrame([(1, 2, 50, 2, 50, 4.0), (1, 4, 50, 2, 50, 8.0), (2, 4, 50, 2, 50, 8.0)], "id long, e1 int, l1 int, e2 int, l2 int, evalue double")
    assert {r.id: r.evalue for r in scoring.mixture_expectation(values, pairs).collect()} == {1: 7.0, 2: 8.0}
