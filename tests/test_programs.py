"""Whole workflows, masking, extents and scaling."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import align, extents, masking, msa, scaler, search
from tessella.plans import programs
from tessella.sources import tables
from tessella.sources.tables import Options

ROWS = [("m", 1, "ARNDCQEGHILK"), ("m", 2, "ARNDCQEGHILV"), ("m", 3, "AANDCWWW----"), ("m", 4, "----VVVVWWWW"), ("k", 7, "ARND"), ("k", 9, "ARNE")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "msa_id string, seq_id long, seq string")


def test_profiles_from_alignments(spark, rows):
    kept = {(r.msa_id, r.seq_id) for r in programs.select_sequences(rows, Options(IDENTITY=90)).collect()}
    assert kept == {("m", 1), ("m", 3), ("m", 4), ("k", 7), ("k", 9)}
    profile = programs.build_profile(rows)
    assert profile.where("msa_id = 'm'").count() == 240 and profile.where("target < 0 or target > 1").count() == 0
    counts = programs.cluster_counts(rows)
    scores, summary = programs.derive_scores(counts)
    assert counts.where("b = -1").count() > 0 and scores.count() > 0 and summary.first()["scale"] >= 2


def test_kinds_of_pseudo_weight(spark, rows):
    cells = msa.cells(rows)
    freqs = msa.match_frequencies(cells, msa.sequence_weights(cells))
    for kind in ("power", "fixed", "entropy"):
        sums = msa.target_frequencies(freqs, kind=kind).groupBy("msa_id", "pos").agg(F.sum("target").alias("s")).collect()
        assert all(r.s == pytest.approx(1, abs=2e-3) for r in sums)


def test_position_weights(spark, rows):
    got = extents.position_weights(msa.cells(rows), 2)
    sums = got.groupBy("msa_id", "pos").agg(F.sum("weight").alias("s"), F.count("*").alias("n"))
    assert all(r.s == pytest.approx(1) for r in sums.collect())
    assert {(r.pos, r.n) for r in sums.where("msa_id = 'm' and pos in (1, 6, 12)").collect()} == {(1, 3), (6, 4), (12, 3)}
    spans = {r.pos: (r["first"], r["last"]) for r in got.where("msa_id = 'm'").collect()}
    assert spans[1] == (1, 8) and spans[6] == (5, 8) and spans[12] == (5, 12)
    small = spark.createDataFrame([("s", 1, "AR"), ("s", 2, "AR"), ("s", 3, "AN")], "msa_id string, seq_id long, seq string")
    w = [r.weight for r in extents.position_weights(msa.cells(small), 2).where("pos = 1").orderBy("seq_id").collect()]
    assert w == pytest.approx([(1 / 3 + 1 / 4) / 2, (1 / 3 + 1 / 4) / 2, (1 / 3 + 1 / 2) / 2])


def test_position_weights_against_columns_one_by_one(spark):
    """Ragged sequences, gaps inside, columns that the query lacks, against the definition."""
    rng = np.random.default_rng(4)
    rows = [("m", 0, "".join(rng.choice(list("ARND-X"), 24, p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.1])))]
    for i in range(1, 15):
        lo, hi = sorted(rng.integers(0, 25, 2))
        rows.append(("m", i, "".join(rng.choice(list("ARNDB-"), 24))[lo:hi].rjust(hi, "-").ljust(24, "-")))
    for least in (1, 5, 40):
        for bounded in (True, False):
            frame = spark.createDataFrame(rows, "msa_id string, seq_id long, seq string")
            got = {(r.pos, r.seq_id): (r.weight, r["first"], r["last"]) for r in extents.position_weights(msa.cells(frame), least, bounded).collect()}
            match = [p for p, c in enumerate(rows[0][2]) if c not in "X-"]
            seqs = ["".join(s[p] for p in match) for _, _, s in rows]
            n, want = len(match), min(least, len(match))
            ends = [(min(at), max(at)) if (at := [c for c, x in enumerate(s) if x != "-"]) else (n, -1) for s in seqs]
            wanted = {}
            for p in range(n):
                members = [i for i, (lo, hi) in enumerate(ends) if lo <= p <= hi]
                left, right = max(ends[i][0] for i in members), min(ends[i][1] for i in members)
                left = max(0, left - (max(0, want - (right - left + 1)) + 1) // 2)
                right = min(n - 1, left + max(right - left, want - 1))
                left = max(0, min(left, right - want + 1))
                left, right = (left, right) if bounded else (0, n - 1)
                w = dict.fromkeys(members, 0.0)
                for c in range(left, right + 1):
                    column = [seqs[i][c] for i in members if seqs[i][c] != "-"]
                    for i in members:
                        if seqs[i][c] != "-":
                            w[i] += 1 / (column.count(seqs[i][c]) * len(set(column)))
                there = [i for i in members if seqs[i][p] != "-"]
                wanted |= {(match[p] + 1, i): (w[i] / sum(w[j] for j in there), match[left] + 1, match[right] + 1) for i in there}
            assert got.keys() == wanted.keys()
            assert all(got[k] == pytest.approx(wanted[k]) for k in got)


def test_masks(spark):
    low = spark.createDataFrame([("m", 1, "ARNDCQAAAAAAAAAAAAAAQEGHILK-RND")], "msa_id string, seq_id long, seq string")
    seq = programs.mask_low_complexity(low, 8, 0.5, 1.0).first().seq
    assert "XXXXXXXXXXXX" in seq and seq.startswith("ARND") and seq.endswith("ILK-RND")
    rng = np.random.default_rng(1)
    wide = [("m", i, "A" if i < 40 else "ARNDCQEGHILKMFPSTWYV"[rng.integers(20)]) for i in range(80)]
    cells = msa.cells(spark.createDataFrame(wide, "msa_id string, seq_id long, seq string"))
    hidden = {r.seq_id for r in masking.mask_columns(cells, 12, 3.0, 2.8).where("code = 22").collect()}
    assert hidden and min(hidden) > 30
    positions = [("p", i + 1, 0, [0.0] * 20 if 5 <= i < 25 else [float(i)] * 20) for i in range(40)]
    out = masking.mask_profile(spark.createDataFrame(positions, "id string, pos long, residue int, x array<double>"), 8, 0.5, 1.0, 0.5)
    masked = {r.pos for r in out.where("masked").collect()}
    assert set(range(8, 24)) <= masked and not masked & {1, 2, 38} and out.where("masked and residue <> 22").count() == 0


def test_search(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, (30, 8))
    profiles = [(k, (base if k == 3 else rng.normal(0, 1, (30, 8))).tolist()) for k in range(6)] + [(9, [])]
    table = spark.createDataFrame(profiles, "profile_id long, v array<array<double>>")
    query = spark.createDataFrame([(100, base[5:25].tolist())], "profile_id long, v array<array<double>>")
    hits = programs.search_profiles(query, table, scheme=align.Scheme(scale=1.0, offset=2.0)).collect()
    assert hits[0].subject_id == 3 and hits[0]["rank"] == 1 and hits[0].n_matched == 20 and (hits[0].s_beg, hits[0].s_end) == (6, 25)
    assert all(a.evalue <= b.evalue for a, b in zip(hits, hits[1:]))


def test_search_with_own_moves_states_and_masks(spark, monkeypatch):
    """Every pair against the kernel on matrices written out cell by cell; two profiles a block."""
    whole = align.packed
    monkeypatch.setattr(align, "packed", lambda t: whole(t, 30))
    rng = np.random.default_rng(4)
    table = ((0.5, -0.2, -0.4), (-0.2, 0.7, -0.6), (-0.4, -0.6, 0.9))
    made = []
    for k in range(7):
        n = 10 + k
        moves = np.log(rng.dirichlet(np.ones(9), n + 1)) if k % 2 else None
        made.append({"profile_id": k, "v": rng.dirichlet(np.ones(5) * 0.3, n), "moves": moves, "bg": rng.dirichlet(np.ones(5) * 9), "info": rng.random(n), "states": rng.dirichlet(np.ones(3), n)})
    rows = [{c: x.tolist() if isinstance(x, np.ndarray) else x for c, x in p.items()} for p in made]
    schema = "profile_id long, " + ", ".join(f"{c} {t}" for c, t in align.PROFILE.items())
    good = spark.createDataFrame(rows, schema).repartition(2)
    ragged = spark.createDataFrame(
        [(90, [[0.1] * 5, [0.1]], None), (91, None, None), (92, [], None), (93, [[0.2] * 5], [[0.0] * 9]), (94, [[0.2, None, 0.2, 0.2, 0.2]], None)],
        "profile_id long, v array<array<double>>, moves array<array<double>>",
    )
    profiles = good.unionByName(ragged, allowMissingColumns=True)
    assert {(r.profile_id, r.reason) for r in programs.unusable(profiles).collect()} == {
        (90, "uneven vectors"), (91, "no positions"), (92, "no positions"), (93, "moves do not fit"), (94, "uneven vectors")
    }
    scheme = align.Scheme("log_sum", offset=0.0003, state_table=table, state_weight=0.4, masked=0.25)
    options = tables.Options(EVAL=1e9, INFCON=0.3, NOALNS=2)
    hits = programs.search_profiles(profiles.where("profile_id % 3 = 0 or profile_id > 89"), profiles, options, scheme, lam=0.5, k=0.1).collect()
    wanted = {}
    for q in made[::3]:
        for s in made:
            cells = np.zeros((len(q["v"]), len(s["v"])))
            for i, j in np.ndindex(cells.shape):
                bg = (q["bg"] + s["bg"]) / 2
                x = math.log(sum(q["v"][i][c] * s["v"][j][c] / bg[c] for c in range(5))) - 0.0003
                a, b = q["states"][i], s["states"][j]
                bonus = (a[2] + 0.1) * (b[2] + 0.1) / 9
                x += 0.4 * (sum(a[u] * b[w] * table[u][w] for u in range(3) for w in range(3)) + bonus - 0.05)
                cells[i, j] = x * (0.25 if min(q["info"][i], s["info"][j]) < 0.3 else 1)
            tq, ts = (align.default_moves(len(p["v"])) if p["moves"] is None else p["moves"] for p in (q, s))
            if (score := align.local(cells, tq, ts).score) > 0:
                wanted[q["profile_id"], s["profile_id"]] = score
    assert {(r.query_id, r.subject_id): r.score for r in hits} == pytest.approx(wanted)
    total = sum(len(p["v"]) for p in made)
    for r in hits:
        n = len(made[r.query_id]["v"])
        cut = search.length_adjustment(0.5, 0.1, 0.5, -1.0, n, total, 7)
        assert r.evalue == pytest.approx(0.1 * (n - cut) * (total - 7 * cut) * math.exp(-0.5 * r.score))
        assert (r.path is None) == (r["rank"] > 2)
    assert programs.search_profiles(profiles.where("false"), profiles, options, scheme).collect() == []
    assert programs.search_profiles(profiles, profiles.where("false"), options, scheme).collect() == []
    with pytest.raises(ValueError, match="HSPMINSCORE"):
        programs.search_profiles(profiles, profiles, tables.Options(HSPMINSCORE=3))


def test_scaling(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (50, 4))
    p = rng.random(50)
    p /= p.sum()
    frame = spark.createDataFrame([(i, x[i].tolist(), float(p[i])) for i in range(50)], "id long, x array<double>, p double").repartition(3)
    got = {r.score: r.p for r in scaler.pair_distribution(frame, 2.0, 1.0).collect()}
    wanted: dict[int, float] = {}
    for i in range(50):
        for j in range(50):
            s = int(np.rint(round(2.0 * float(x[i] @ x[j]) - 1.0, 6)))
            wanted[s] = wanted.get(s, 0.0) + p[i] * p[j]
    assert got == pytest.approx(wanted)
    out = programs.scale_scores(frame, 0.2, 1.5)
    assert out["lambda"] == pytest.approx(0.2, rel=0.1) and out["expected"] < 0 < out["entropy"]


def test_generators(spark, rows):
    new = programs.gen_msas(rows.where("msa_id = 'm'"), 2, 5, 9, 4, 7).collect()
    assert len(new) == 10 and all(len(r.seq) == 9 for r in new) and all(r.seq == "-" * 9 for r in new if r.seq_id == 4)
    wide = programs.rnd_msas(spark, 2, 3.0, 12, 5)
    assert wide.select("msa_id").distinct().count() == 2 and wide.count() >= 4
    prior = programs.niw_prior(programs.simulate_clusters(spark, 2, 20, 3, 1))
    assert prior.mu.shape == (3,) and math.isfinite(np.linalg.slogdet(prior.scatter)[1])
