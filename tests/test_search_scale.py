"""Searching beyond what fits: seeds against the full search, banded alignment against whole matrices, sums over all paths."""

import itertools
import math
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from tessella.operators import align, scoring, seeds, significance, targets
from tessella.plans import programs
from tessella.sources.tables import Options

PROFILE = "profile_id long, v array<array<double>>"


def profile(rng, n, dim=20, peak=0.15):
    return rng.dirichlet(np.full(dim, peak), n)


def related(rng, v, noise):
    """A profile with some positions of ``v`` mixed with others, some left out and some put in."""
    kept = v[rng.random(len(v)) > 0.04]
    mixed = (1 - noise) * kept + noise * profile(rng, len(kept), v.shape[1])
    at = rng.integers(5, len(mixed) - 5)
    return np.vstack([profile(rng, rng.integers(5, 30)), mixed[:at], profile(rng, rng.integers(0, 3)), mixed[at:]])


def families(seed=3, wide=14, own=8, others=90):
    rng = np.random.default_rng(seed)
    heads = [profile(rng, rng.integers(60, 110)) for _ in range(wide)]
    rows = [(i, v) for i, v in enumerate(heads)]
    rows += [(1000 + own * i + j, related(rng, v, 0.1 + 0.08 * j)) for i, v in enumerate(heads) for j in range(own)]
    rows += [(5000 + i, profile(rng, rng.integers(40, 120))) for i in range(others)]
    return [(i, v.tolist()) for i, v in rows]


def test_seeds_find_what_the_full_search_finds(spark):
    """Recall of hits with an expectation up to 10, and how few pairs are aligned for it."""
    rows = families()
    subjects = spark.createDataFrame(rows, PROFILE).repartition(4).cache()
    queries = subjects.where("profile_id < 14")
    scheme = align.Scheme(kind="log_sum", offset=0.6)
    ask = {"options": Options(EVAL=10.0, NOHITS=10_000, SHOW=0), "scheme": scheme, "lam": 0.9, "k": 0.1}
    full = {(r.query_id, r.subject_id): r.score for r in programs.search_profiles(queries, subjects, **ask).collect()}
    seeding = seeds.Seeding(shortest=2, longest=5, common=20)
    fast = {(r.query_id, r.subject_id): r.score for r in programs.search_profiles(queries, subjects, **ask, seeding=seeding).collect()}
    asked = seeds.candidates(queries, subjects, seeding).count()
    assert set(fast) <= set(full) and all(fast[p] == pytest.approx(full[p]) for p in fast)
    assert len(full) >= 80 and len(fast) >= 0.9 * len(full)
    assert asked < 0.3 * 14 * len(rows)


def plain_profile(v, moves=None):
    return {c: None for c in align.PROFILE} | {"id": 0, "v": np.asarray(v), "moves": align.default_moves(len(v)) if moves is None else moves}


def random_moves(rng, n):
    p = rng.dirichlet(np.ones(3), (n + 1, 3)).reshape(n + 1, 9)
    return np.log(np.maximum(p, 1e-9))


def test_banded_alignment_equals_whole_matrices():
    rng = np.random.default_rng(2)
    scheme = align.Scheme(scale=4, offset=1.2)
    for k in range(40):
        rows, cols = rng.integers(1, 60, 2)
        q, s = profile(rng, rows, 5, 0.3), profile(rng, cols, 5, 0.3)
        if k % 2:
            n = min(rows, cols)
            s[:n] = 0.8 * q[:n] + 0.2 * s[:n]
        q, s = plain_profile(q, random_moves(rng, rows)), plain_profile(s, random_moves(rng, cols))
        scores, banded = scheme.scores(q, s), align.Banded(scheme, q, s, stride=int(rng.integers(2, 40)))
        whole, found = align.local(scores, q["moves"], s["moves"]), banded.local()
        assert (found.path, found.matches, found.positives) == (whole.path, whole.matches, whole.positives)
        assert found.score == pytest.approx(whole.score)
        best = align.most_accurate(align.posteriors(scores, q["moves"], s["moves"])[0], 0.28)
        score, path = banded.most_accurate(0.28)
        assert path == best[1] and score == pytest.approx(best[0])


def test_banded_alignment_keeps_bounded_memory():
    """1,500 by 1,500 positions: matrices of five states in doubles would take 90 MB."""
    rng = np.random.default_rng(5)
    q, s = profile(rng, 1500), profile(rng, 1500)
    s[200:900] = q[500:1200]
    banded = align.Banded(align.Scheme(scale=10, offset=1.0), plain_profile(q), plain_profile(s))
    tracemalloc.start()
    found = banded.local()
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 25e6
    assert set(found.path) >= {(n, n - 300) for n in range(505, 1195)}


def test_large_pairs_take_the_banded_way(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, profile(rng, 30).tolist()) for i in range(3)] + [(7, None)]
    frame = spark.createDataFrame([r for r in rows if r[1]], PROFILE)
    whole = align.align_profiles(frame, frame, align.Scheme(scale=4, offset=1.0), realign=True).drop("space").collect()
    monkeypatch.setattr(align, "WHOLE_CELLS", 100)
    banded = align.align_profiles(frame, frame, align.Scheme(scale=4, offset=1.0), realign=True).drop("space").collect()
    for a, b in zip(sorted(whole), sorted(banded), strict=True):
        assert (a.query_id, a.subject_id, a.path, a.n_matched) == (b.query_id, b.subject_id, b.path, b.n_matched)
        assert a.score == pytest.approx(b.score)


def all_global_paths(rows, cols):
    """Every way from (0, 0) in M to (rows, cols), as lists of (state, n, m)."""

    def walk(state, n, m):
        if (n, m) == (rows, cols):
            yield []
        for after, (a, b) in enumerate(align.STEPS):
            if n + a <= rows and m + b <= cols and (after == align.M_ or state in (align.M_, after)):
                for rest in walk(after, n + a, m + b):
                    yield [(after, n + a, m + b), *rest]

    return list(walk(align.M_, 0, 0))


def test_global_sum_equals_listing_all_paths():
    rng = np.random.default_rng(7)
    into = {
        (align.M_, align.M_): lambda a, b, c, d: a[align.MM] + b[align.MM], (align.MI_, align.M_): lambda a, b, c, d: a[align.MM] + b[align.IM],
        (align.IM_, align.M_): lambda a, b, c, d: a[align.IM] + b[align.MM], (align.DG_, align.M_): lambda a, b, c, d: a[align.DM] + b[align.MM],
        (align.GD_, align.M_): lambda a, b, c, d: a[align.MM] + b[align.DM], (align.M_, align.MI_): lambda a, b, c, d: a[align.MM] + d[align.MI],
        (align.MI_, align.MI_): lambda a, b, c, d: a[align.MM] + d[align.II], (align.M_, align.IM_): lambda a, b, c, d: c[align.MI] + b[align.MM],
        (align.IM_, align.IM_): lambda a, b, c, d: c[align.II] + b[align.MM], (align.M_, align.DG_): lambda a, b, c, d: a[align.MD],
        (align.DG_, align.DG_): lambda a, b, c, d: a[align.DD], (align.M_, align.GD_): lambda a, b, c, d: b[align.MD], (align.GD_, align.GD_): lambda a, b, c, d: b[align.DD],
    }
    for rows, cols in ((1, 1), (1, 3), (3, 2), (3, 3)):
        scores, tq, ts = rng.normal(size=(rows, cols)), random_moves(rng, rows), random_moves(rng, cols)
        total = []
        for path in all_global_paths(rows, cols):
            state, log = align.M_, 0.0
            for after, n, m in path:
                log += into[state, after](tq[n - 1], ts[m - 1], tq[n], ts[m]) + (scores[n - 1, m - 1] if after == align.M_ else 0.0)
                state = after
            total.append(log + into[state, align.M_](tq[rows], ts[cols], None, None))
        assert align.global_log_sum(scores, tq, ts) == pytest.approx(np.logaddexp.reduce(total))


def test_seeds_against_their_definition(spark):
    """Leaf words, words with one code replaced, two hits on a diagonal, listed position by position."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.integers(0, 40, (int(rng.integers(1, 30)), 4)).astype(float).tolist()) for i in range(25)]
    frame = spark.createDataFrame([*rows, (None, [[1.0, 2.0, 3.0, 4.0]]), (99, None), (98, [])], PROFILE)
    seeding = seeds.Seeding(shortest=1, longest=3, common=30, reach=5)
    ranked = {i: [sorted(range(4), key=lambda c, p=p: (-p[c], c))[:2] for p in v] for i, v in rows}
    index, leaves = defaultdict(list), []
    for i, r in ranked.items():
        for s in range(len(r)):
            for size in range(1, 4):
                if s + size <= len(r):
                    index[tuple(x[0] for x in r[s : s + size])].append((i, s))
    for w, at in index.items():
        inner = all(len(index[w[:k]]) > 30 for k in range(1, len(w)))
        if inner and (len(at) <= 30 or len(w) == 3):
            leaves.append(w)
    wanted = set()
    for i, r in ranked.items():
        for q in range(len(r)):
            for w in leaves:
                if q + len(w) <= len(r):
                    differ = [k for k in range(len(w)) if r[q + k][0] != w[k]]
                    if not differ or len(differ) == 1 and r[q + differ[0]][1] == w[differ[0]]:
                        wanted |= {(i, j, q, s) for j, s in index[w]}
    assert {tuple(r) for r in seeds.hits(frame, frame, seeding).collect()} == wanted
    diagonals = defaultdict(set)
    for i, j, q, s in wanted:
        diagonals[i, j, q - s].add(q)
    found = {k[:2] for k, at in diagonals.items() if any(0 < b - a <= 5 for a, b in itertools.combinations(sorted(at), 2))}
    assert {(r.query_id, r.subject_id) for r in seeds.candidates(frame, frame, seeding).collect()} == found


def test_a_word_that_many_positions_share_is_lengthened(spark):
    """A third of all positions alike: their one-code word gives way to longer ones, and no lookup brings more rows than asked for."""
    rng = np.random.default_rng(10)
    rows = [(i, [[1.0, 0.0, 0.0] if rng.random() < 0.6 else rng.dirichlet(np.ones(3)).tolist() for _ in range(40)]) for i in range(30)]
    frame = spark.createDataFrame(rows, PROFILE)
    hits = seeds.hits(frame.where("profile_id = 0"), frame, seeds.Seeding(shortest=1, longest=12, common=40)).groupBy("q").count().collect()
    assert hits and math.fsum(r["count"] for r in hits) / len(hits) < 40 * 13


def test_optimised_targets_hit_entropy_and_marginals_for_all_pairs():
    """Matrices of different sizes in one batch, against bisection over one matrix at a time."""
    rng = np.random.default_rng(11)
    matrices = [rng.normal(-0.6, 1.0, (int(rng.integers(2, 30)), int(rng.integers(2, 30)))) for _ in range(25)]
    matrices += [np.full((4, 5), -1.0), rng.normal(2.0, 0.1, (3, 3))]  # nothing positive; a positive mean
    new = targets.rescored(matrices, 0.2)
    for s, t in zip(matrices[:-2], new, strict=False):
        r, c = np.full(s.shape[0], 1 / s.shape[0]), np.full(s.shape[1], 1 / s.shape[1])
        lam = targets.positive_lambda(s[None], r[None], c[None])[0]
        if np.isnan(lam):
            assert t is s
            continue
        w = np.outer(r, c)
        q = w * np.exp(lam * t)
        assert (q * lam * t).sum() == pytest.approx(0.2, abs=1e-7)
        assert q.sum(axis=0) == pytest.approx(c, abs=1e-8) and q.sum(axis=1) == pytest.approx(r, abs=1e-8)
        assert q == pytest.approx(scoring.optimised_targets(w * np.exp(lam * s), r, c, 0.2), abs=1e-7)
    assert new[-2] is matrices[-2] and new[-1] is matrices[-1]


def test_a_search_aligns_hits_again_by_optimised_targets(spark):
    rng = np.random.default_rng(12)
    heads = [profile(rng, 40) for _ in range(3)]
    rows = [(i, v.tolist()) for i, v in enumerate(heads)] + [(10 + i, related(rng, v, 0.2).tolist()) for i, v in enumerate(heads)]
    frame = spark.createDataFrame(rows, PROFILE)
    scheme = align.Scheme(kind="log_sum", offset=0.6)
    ask = {"options": Options(EVAL=1e-3), "scheme": scheme, "lam": 0.9, "k": 0.1}
    plain = {(r.query_id, r.subject_id): r.score for r in programs.search_profiles(frame, frame, **ask).collect()}
    again = {(r.query_id, r.subject_id): r for r in programs.search_profiles(frame, frame, **ask, entropy=0.25).collect()}
    assert set(again) == set(plain) and {(i, 10 + i) for i in range(3)} <= set(plain)
    held = {i: plain_profile(v) for i, v in rows}
    for (a, b), r in again.items():
        scores = targets.rescored([scheme.scores(held[a], held[b])], 0.25)[0]
        found = align.local(scores, held[a]["moves"], held[b]["moves"])
        assert r.score == pytest.approx(found.score, rel=1e-6) and r.n_matched == found.matches
    assert any(again[p].score != pytest.approx(plain[p]) for p in plain)


def test_joint_probabilities_of_odd_rows(spark):
    rows = [(1, [[1.0, -2.0], [-2.0, 1.0]], [0.5, 0.5], [0.5, 0.5], 0.2), (2, None, [0.5, 0.5], [1.0], 0.1), (3, [[1.0, -1.0]], [1.0], [0.5, 0.5], 5.0), (4, [[0.0, 0.0], [0.0, 0.0]], [0.5, 0.5], [0.5, 0.5], 0.1)]
    frame = spark.createDataFrame(rows, "id long, scores array<array<double>>, r array<double>, c array<double>, entropy double")
    got = {r.id: (r.joint, r.done) for r in targets.joint_probabilities(frame).collect()}
    assert got[1][1] and got[1][0][0][0] == pytest.approx(got[1][0][1][1]) and got[1][0][0][0] > 0.25
    assert [got[k] for k in (2, 3, 4)] == [(None, False)] * 3
    assert targets.joint_probabilities(frame.where("false")).count() == 0


def test_a_search_judges_pairs_by_location_and_scale(spark):
    rng = np.random.default_rng(13)
    heads = [profile(rng, 40) for _ in range(2)]
    rows = [(i, v.tolist(), 2.0 + i) for i, v in enumerate(heads)] + [(10 + i, related(rng, v, 0.2).tolist(), None) for i, v in enumerate(heads)]
    frame = spark.createDataFrame(rows, f"{PROFILE}, thickness double")
    model = significance.PairModel(by_thickness=[[[0.1], [0.02], [0.03], [0.01], [0.02]]], by_lambda=[[[0.1, 0.05], [0.1, 0.02], [0.02, 0.01], [0.03, 0.01]]])
    ask = {"scheme": align.Scheme(kind="log_sum", offset=0.6), "lam": 0.9, "k": 0.1}
    plain = {(r.query_id, r.subject_id): r for r in programs.search_profiles(frame, frame, Options(EVAL=1e6), **ask).collect()}
    got = {(r.query_id, r.subject_id): r for r in programs.search_profiles(frame, frame, Options(EVAL=1e4), model=model, **ask).collect()}
    assert set(got) <= set(plain) and {(0, 10), (0, 0), (1, 1)} <= set(got)
    size, thick = {i: len(v) for i, v, _ in rows}, {i: t or 1.0 for i, _, t in rows}
    space = align.Significance(0.9, 0.1, programs.ALPHA, programs.BETA, sum(size.values()), len(rows), 1.0)
    for (a, b), r in got.items():
        x, y = sorted((a, b), key=lambda p: (-thick[p], -size[p]))
        mu_e = max(3.0, 30 * (0.1 + 0.02 * thick[x] + 0.03 * math.log(size[x]) + 0.01 * thick[y] + 0.02 * math.log(size[y])))
        long, short = sorted((size[a], size[b]), reverse=True)
        mu_l, s_l = (c + d * 0.9 + e * math.log(long) + f * math.log(short) for c, d, e, f in ((0.1, 0.1, 0.02, 0.03), (0.05, 0.02, 0.01, 0.01)))
        mu_l, s_l = max(3.0, 30 * mu_l), min(5.0, max(0.1, math.exp(max(0.1, 5 * s_l)) - 1))
        inverse = 0.1 / 0.9
        share, other = 0.5 * (1 - inverse), 0.5 + 0.5 * inverse
        mu, scale = share * mu_e + (1 - share) * mu_l, (1 - other) * min(5.0, max(0.1, 0.1 * mu_e)) + other * s_l
        wanted = 0.1 / programs.K * math.exp((mu - r.score) / scale) * space.space(size[a]) / (size[a] * size[b])
        assert r.evalue == pytest.approx(wanted) and r.score == pytest.approx(plain[a, b].score)
        assert r.evalue <= 1e4
