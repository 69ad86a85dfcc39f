"""Score tables chosen by levels: files, lookups, and their terms in an alignment."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import align, levels
from tessella.sources import tables


def example(seed=1, missing=((6.0, 6.0, 0.1, 0.5, 0.0, 0.3),)):
    """Two levels of each kind, all pairs of bins but the missing ones, five keys with a few missing cells."""
    rng = np.random.default_rng(seed)
    pairs = lambda x: [(a, b) for a, b in itertools.product(x, x) if a <= b]
    rows = []
    for (e, f), (p, q), (s, t) in itertools.product(pairs((3.0, 6.0)), pairs((0.1, 0.5)), pairs((0.0, 0.3))):
        if (e, f, p, q, s, t) not in missing:
            rows += [(e, f, p, q, s, t, i, j, None if rng.random() < 0.1 else float(rng.normal())) for i in range(5) for j in range(i + 1)]
    return rows


def brute(rows, key1, key2, e1, e2, p1, p2, s1, s2):
    known = sorted({r[:6] for r in rows})
    bins = []
    for k, (a, b) in enumerate(((e1, e2), (p1, p2), (s1, s2))):
        of = sorted({t[2 * k + j] for t in known for j in (0, 1)})
        if min(a, b) < of[0]:
            return 0.0
        bins += [max(x for x in of if x <= min(a, b)), max(x for x in of if x <= max(a, b))]
    fit = [t for t in known if all(x <= y for x, y in zip(t, bins, strict=True))]
    cells = {(r[6], r[7]): r[8] for r in rows if fit and r[:6] == fit[-1]}
    return cells.get((max(key1, key2), min(key1, key2))) or 0.0


def test_a_set_of_files_comes_back(spark):
    rows = example()
    texts = tables.render_levels(rows, "own")
    frame = spark.createDataFrame([(f"{k}", v) for k, v in texts.items()] + [("bad", "nothing of the kind\n"), ("short", "x3_3= 10 +0\n10 10 0 0\nCardinality = 3\n 1.0\n")], "path string, value string")
    good, bad = tables.readable(tables.parsed(frame, tables.parse_levels, tables.LEVEL_TABLE))
    assert {tuple(r)[1:] for r in good.collect()} == set(rows)
    assert {r.path for r in bad.collect()} == {"bad", "short"}
    whole = "a3_6= 50 90 + 0\n50 90 0 0\nCardinality = 2 x 3\n 1 NA 2\n 3 4 5\n"
    assert tables.parse_levels(whole) == [(3.0, 6.0, 0.5, 0.9, 0.0, 0.0, i, j, x) for i, r in enumerate(((1.0, None, 2.0), (3.0, 4.0, 5.0))) for j, x in enumerate(r)]


def asked(n=300, seed=2):
    rng = np.random.default_rng(seed)
    rows = [
        (i, int(rng.integers(0, 6)), int(rng.integers(0, 6)), *(float(x) for x in rng.uniform(2, 9, 2)), *(float(x) for x in rng.uniform(0.05, 1, 2)), *(float(x) for x in rng.uniform(0, 1, 2)))
        for i in range(n)
    ]
    return rows + [(n, 1, 1, 3.0, 6.0, 0.1, 0.5, 0.0, 0.3), (n + 1, 2, 3, 6.0, 6.0, 0.1, 0.5, 0.0, 0.3)]


SCHEMA = "id long, key1 int, key2 int, e1 double, e2 double, p1 double, p2 double, s1 double, s2 double"


def test_lookups_against_the_definition(spark):
    rows = example()
    known = spark.createDataFrame(rows, tables.LEVEL_TABLE)
    got = {r.id: r.score for r in levels.level_scores(spark.createDataFrame(asked(), SCHEMA), known).collect()}
    assert got == pytest.approx({r[0]: brute(rows, *r[1:]) for r in asked()})
    assert sum(x != 0 for x in got.values()) > 100
    odd = spark.createDataFrame([(1, None, 2, 5.0, 5.0, 0.4, 0.4, 0.4, 0.4), (2, 1, 2, None, 5.0, 0.4, 0.4, 0.4, 0.4), (3, 1, 2, 1.0, 5.0, 0.4, 0.4, 0.4, 0.4)], SCHEMA)
    assert {tuple(r) for r in levels.level_scores(odd, known).collect()} == {(1, 0.0), (2, 0.0), (3, 0.0)}
    assert levels.level_scores(odd.where("false"), known).count() == 0
    assert {r.score for r in levels.level_scores(odd, known.where("false")).collect()} == {0.0}


def test_tables_held_whole_score_all_pairs_of_positions():
    rows, pairs = example(), asked(40)
    held = levels.LevelTables.from_rows(rows)
    q, s = ({"key": np.array([r[k] for r in pairs]), "e": np.array([r[e] for r in pairs]), "p": np.array([r[p] for r in pairs]), "s": np.array([r[t] for r in pairs])} for k, e, p, t in ((1, 3, 5, 7), (2, 4, 6, 8)))
    got = held.scores(q, s)
    for i, a in enumerate(pairs):
        for j, b in enumerate(pairs):
            assert got[i, j] == pytest.approx(brute(rows, a[1], b[2], a[3], b[4], a[5], b[6], a[7], b[8]))
    none = levels.LevelTables.from_rows([])
    assert not none.scores(q, s).any()


def test_an_alignment_takes_cluster_and_state_terms(spark):
    rng = np.random.default_rng(3)
    rows = example(4, ())
    pair_rows = [(*r[:6], i, j, float(rng.normal())) for r in {x[:6]: x for x in rows}.values() for i in range(15) for j in range(i + 1)]
    scheme = align.Scheme(scale=3.0, offset=0.4, cluster_tables=levels.LevelTables.from_rows(rows), cluster_weight=0.5, pair_tables=levels.LevelTables.from_rows(pair_rows), pair_weight=0.25)
    profiles = []
    for i in range(3):
        n = int(rng.integers(15, 25))
        profiles.append((i, rng.dirichlet(np.ones(5), n).tolist(), rng.dirichlet(np.ones(3), n).tolist(), [float(x) for x in rng.integers(-1, 5, n)], rng.uniform(0, 1, n).tolist(), rng.uniform(2, 9, n).tolist()))
    frame = spark.createDataFrame(profiles, "profile_id long, v array<array<double>>, states array<array<double>>, clusters array<double>, cluster_prob array<double>, effective array<double>")
    got = {(r.query_id, r.subject_id): r.score for r in align.align_profiles(frame, frame, scheme).collect()}
    for a in profiles:
        for b in profiles:
            scores = 3.0 * np.array(a[1]) @ np.array(b[1]).T - 0.4
            for i in range(len(a[1])):
                for j in range(len(b[1])):
                    if a[3][i] >= 0 and b[3][j] >= 0:
                        scores[i, j] += 0.5 * brute(rows, a[3][i], b[3][j], a[5][i], b[5][j], a[4][i], b[4][j], 1.0, 1.0)
                        x, y = np.argmax(a[2][i]), np.argmax(b[2][j])
                        scores[i, j] += 0.25 * brute(pair_rows, 3 * a[3][i] + x, 3 * b[3][j] + y, a[5][i], b[5][j], a[4][i], b[4][j], max(a[2][i]), max(b[2][j]))
            wanted = align.local(scores, align.default_moves(len(a[1])), align.default_moves(len(b[1])))
            assert got[a[0], b[0]] == pytest.approx(wanted.score)
    plain = {(r.query_id, r.subject_id): r.score for r in align.align_profiles(frame.drop("clusters"), frame, scheme).collect()}
    simple = {(r.query_id, r.subject_id): r.score for r in align.align_profiles(frame, frame, align.Scheme(scale=3.0, offset=0.4)).collect()}
    assert plain == pytest.approx(simple)
    assert frame.select(levels.pair_key(F.lit(4), F.lit(2))).first()[0] == 14
