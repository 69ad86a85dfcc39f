"""Readers and writers, stores, generators, segments and streams on small tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import alphabet as A
from tessella.operators import clusters, database, generate, hdp, msa, seg
from tessella.sources import alignments, tables
from tessella.streaming import incremental

STOCKHOLM = """# STOCKHOLM 1.0
#=GF AC X1
#=GF DE some family
a ARn.D
b A-NkE

a CC
b C_
//
"""
REPORT = """Results from round 1
>hit one
 Score = 30 bits (60), Expect = 1e-10
Query: 2 AR-ND 5
Sbjct: 7 ARKNE 11
Query: 6 C 6
Sbjct: 12 C 12
Results from round 2
>hit two
 Score = 20 bits, Expect = 5.0
Query  1 A 1
Sbjct  1 A 1
"""


def test_alignment_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text("junk\n>one title\nARN D\n-C\n>two\nar-DCC\n")
    (tmp_path / "b.sto").write_text(STOCKHOLM)
    (tmp_path / "empty.fa").write_text("")
    rows = alignments.alignments(alignments.whole_files(spark, f"file://{tmp_path}"))
    got = {(r.msa_id.rpartition("/")[2], r.seq_id): (r.title, r.seq) for r in rows.collect()}
    assert got["a.fa", 0] == ("one title", "ARND-C") and got["a.fa", 1] == ("two", "ar-DCC")
    assert got["b.sto", 0][0] == "X1 some family" and [got["b.sto", k][1] for k in range(3)] == ["AR--DCC", "A-NKEC-", "ARN-DCC"]
    assert len(got) == 5
    fasta = alignments.to_fasta(rows, 3).collect()
    assert any(">two\nar-\nDCC\n" in r.value for r in fasta)
    first = alignments.without_query_gaps(rows.where("msa_id like '%a.fa'"))
    assert {r.seq for r in first.collect()} == {"ARNDC", "ar-DC"}
    uneven = spark.createDataFrame([("x", ">a\nAR\n>b\nA\n")], "path string, value string")
    with pytest.raises(Exception, match="different lengths"):
        alignments.fasta(uneven).collect()


def test_reports(spark):
    hits = alignments.report_hits(spark.createDataFrame([("r", REPORT)], "path string, value string"))
    assert [(r.round, r.hit, r.evalue, r.q_beg, r.q_end, r.q_aln) for r in hits.orderBy("round").collect()] == [
        (1, "hit one", 1e-10, 2, 6, "AR-NDC"), (2, "hit two", 5.0, 1, 1, "A"),
    ]
    assert [r.seq for r in alignments.stacked(hits, 8, 1.0).collect()] == ["-ARNEC--"]


def test_text_tables(spark):
    residues = {a: float(a) for a in range(20)}
    pairs = {(a, b): a + b / 10 for a in range(20) for b in range(20)}
    text = tables.render_counts(residues, pairs)
    files = spark.createDataFrame([("good", text), ("bad", "1 2 3\n"), ("none", "")], "path string, value string")
    good, bad = tables.readable(tables.parsed(files, tables.parse_counts, tables.COUNTS))
    assert good.count() == 420 and {r.path for r in bad.collect()} == {"bad", "none"}
    assert good.where("b = -1 and a = 7").first().n == 7.0 and good.where("a = 3 and b = 5").first().n == 3.5
    table = tables.render_score_table(3, {(0, 0): 1.5, (1, 0): None, (1, 1): -2.0, (2, 0): 0.25, (2, 1): 0.0, (2, 2): 3.0})
    assert tables.parse_score_table("# c\n" + table)[1] == (1, 0, None) and len(tables.parse_score_table(table)) == 6
    with pytest.raises(ValueError, match="short"):
        tables.parse_score_table("Cardinality = 3\n1.0\n")
    scores = tables.parse_context_scores("Cardinality = 3\n0.0 0.5 1.5\n1.0 2.0 4.0\n")
    assert [k for k, _ in scores] == [0.0, 0.5, 1.0, 1.5] and scores[0][1] == pytest.approx((1 + 2 + 2) / 3)
    ini = tables.parse_ini("[A]\nx = 1 # c\n[B]\ny=z\n")
    assert ini == [("A", "x", "1"), ("B", "y", "z")] and tables.parse_ini(tables.render_ini(ini)) == ini
    assert tables.Options.read("[OPTIONS]\nEVAL = 0.5\nNOHITS = 9\n").NOHITS == 9
    for broken in ("[OPTIONS]\nNOPE = 1\n", "[OPTIONS]\nIDENTITY = 101\n", "[OPTIONS]\nNOHITS = x\n"):
        with pytest.raises(ValueError):
            tables.Options.read(broken)
    groups = [(0, 1, 5, [1.0, 2.0]), (0, 1, 5, [3.0, 4.0]), (2, 0, 6, [0.5, -1.0])]
    assert sorted(tables.parse_groups(tables.render_groups(groups))) == groups


def test_profile_text(spark):
    p = tables.Profile(
        "d", "n", 3, 2.5, [0.04] * 25, [0.04] * 25, [0.125] * 9, [1.0, 0.0, 0.0], "AR", [[0.5] * 25, [-0.25] * 25], [[0.25] * 25] * 2, [[0.125] * 9] * 2,
        [[1.0, 0.0, 0.5]] * 2, [0.5, 0.5], [1.5, 0.25], [[], [(3, 0.5), (-1, 0.25)]], [None, (1.5, 2.0, [0.1, 0.2])], [("H", 0.1, 0.2, 0.7), None], {"K": 0.1},
    )
    text = tables.render_profile(p)
    back = tables.parse_profile(text)
    assert (back.residues, back.scores, back.freqs, back.moves, back.clusters, back.context, back.states, back.footer) == (
        p.residues, p.scores, p.freqs, p.moves, p.clusters, p.context, p.states, p.footer,
    )
    files = spark.createDataFrame([("p", text), ("q", "what")], "path string, value string")
    good, bad = tables.readable(tables.parsed(files, tables.profile_rows, tables.PROFILE_ROWS))
    assert [(r.pos, r.residue, r.state) for r in good.orderBy("pos").collect()] == [(1, "A", "H"), (2, "R", None)] and bad.count() == 1
    pos = good.select(F.col("name").alias("profile_id"), "pos", "residue")
    pred = spark.createDataFrame([("n", 1, "a", "C"), ("n", 2, "*", "E")], "profile_id string, pos long, residue string, predicted string")
    assert tables.with_states(pos, pred).where("predicted is not null").count() == 2
    with pytest.raises(Exception, match="differ"):
        tables.with_states(pos, pred.withColumn("residue", F.lit("W"))).collect()


def test_scores_contexts_and_dumps(spark):
    scores = [[float(a == b) - 0.25 * (a != b) for b in range(24)] for a in range(24)]
    background, targets = [0.05] * 20, [[0.0025] * 20] * 20
    text = tables.render_scores(scores, background, targets, 4, {"Lambda": 0.3, "K": 0.1})
    rows = tables.parse_scores(text)
    assert ("parameter:K", -1, -1, 0.1) in rows and ("score", 2, 2, 4.0) in rows and ("score", 2, 3, -1.0) in rows
    assert ("background", 19, -1, 0.05) in rows and sum(k == "target" for k, *_ in rows) == 400
    files = spark.createDataFrame([("good", text), ("bad", "x = 1\n1 2\n")], "path string, value string")
    good, bad = tables.readable(tables.parsed(files, tables.parse_scores, tables.SCORES))
    assert good.count() == len(rows) and bad.count() == 1
    assert tables.parse_contexts("A 0.5 0.5\nR 1 0\n*\nN 0 1\n") == [(0, 0, "A", [0.5, 0.5]), (0, 1, "R", [1.0, 0.0]), (1, 0, "N", [0.0, 1.0])]
    p = tables.Profile("d", "n", 1, 1.0, [0.0] * 25, [0.0] * 25, [0.1] * 9, [1.0, 0.0, 0.0], "W", [[1.5] * 25], [[0.05] * 25], [[0.1] * 9], [[1, 0, 0]], [0.5], [2.0], [[]], [None], [None])
    dump = tables.profile_dump(p).splitlines()
    assert len(dump) == 2 and dump[1].startswith("    1 W   1.5") and dump[1].endswith(" 0.50  2.00")


def test_alphabet(spark):
    row = spark.range(1).select(*(A.encode(F.lit(c)).alias(f"c{i}") for i, c in enumerate("aV-xJ*")), A.decode(F.lit(1)).alias("d")).first()
    assert list(row) == [0, 19, 24, 22, 22, 23, "R"]
    with pytest.raises(Exception, match="not a residue"):
        spark.range(1).select(A.encode(F.lit("1"))).collect()
    assert sum(A.BACKGROUND) == pytest.approx(1, abs=1e-3)


def test_columns_by_hand(spark):
    rows = [("m", 1, "ARN-"), ("m", 2, "A-NB"), ("m", 3, "--XA"), ("m", 4, None), ("m", 5, "ARN")]
    cells = msa.cells(spark.createDataFrame(rows, "msa_id string, seq_id long, seq string"))
    assert cells.count() == 20
    counts = {r.pos: (r.n_residues, r.n_distinct) for r in msa.column_counts(cells).collect()}
    assert counts == {1: (3, 1), 2: (2, 1), 3: (4, 2), 4: (2, 2)}
    used = {(r.seq_id, r.pos) for r in msa.trimmed(cells).where("used").collect()}
    assert (1, 4) in used and (3, 1) not in used and (4, 1) not in used and (2, 2) in used
    assert [(r.pos, r.state) for r in msa.match_states(cells).orderBy("pos").collect()] == [(1, 1), (2, 2), (3, 3)]
    weights = msa.sequence_weights(cells)
    assert weights.agg(F.sum("weight")).first()[0] == pytest.approx(1) and weights.count() == 4
    freqs = msa.match_frequencies(cells, weights)
    assert all(r.s == pytest.approx(1) for r in freqs.groupBy("pos").agg(F.sum("freq").alias("s")).collect())
    targets = msa.target_frequencies(freqs)
    assert all(r.s == pytest.approx(1, abs=1e-3) for r in targets.groupBy("pos").agg(F.sum("target").alias("s")).collect())
    assert msa.sequences(cells).where("seq_id = 2").first().seq == "A-NB"
    pairs = {(r.seq_a, r.seq_b): (r.segment, r.matches) for r in clusters.identities(cells).collect()}
    assert pairs[1, 5] == (3, 3) and pairs[1, 2] == (2, 2) and (1, 3) not in pairs


def test_clusters_and_selection(spark):
    rows = [("m", 1, "ARNDCQEGHI"), ("m", 2, "ARNDCQEGHL"), ("m", 3, "ARNDCWWWWW"), ("m", 4, "VVVVVWWWWW"), ("m", 5, "VVVVVWWWWW")]
    cells = msa.cells(spark.createDataFrame(rows, "msa_id string, seq_id long, seq string"))
    got = {r.seq_id: (r["cluster"], r["size"]) for r in clusters.single_linkage(cells, 0.5).collect()}
    assert got == dict.fromkeys(range(1, 6), (1, 5))
    got = {r.seq_id: r["cluster"] for r in clusters.single_linkage(cells, 0.9).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    kept = {r.seq_id for r in clusters.select_sequences(cells, 0.9).where("selected").collect()}
    assert kept == {1, 3, 4}
    many = [("m", i, "ARNDCQEGHI" if i % 2 else "VVVVVWWWWW") for i in range(1, 131)]
    cells = msa.cells(spark.createDataFrame(many, "msa_id string, seq_id long, seq string"))
    assert {r.seq_id for r in clusters.select_sequences(cells, 0.9).where("selected").collect()} == {1, 2}


def brute_clusters(texts, threshold):
    """Clusters of sequences without gaps by comparing all pairs."""
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sum(x == y for x, y in zip(texts[i], texts[j], strict=True)) >= threshold * len(texts[i]):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


def test_clusters_of_many_blocks(spark):
    rng = np.random.default_rng(5)
    letters = np.array(list("ARND"))
    roots = rng.integers(0, 4, (12, 20))
    texts = ["".join(letters[np.where(rng.random(20) < 0.12, rng.integers(0, 4, 20), roots[i % 12])]) for i in range(150)]
    rows = spark.createDataFrame([("m", i, t) for i, t in enumerate(texts)] + [("one", 7, "ARND")], "msa_id string, seq_id long, seq string")
    cells = msa.cells(rows)
    linked = clusters.single_linkage(cells, 0.8, block=16)
    got = {(r.msa_id, r.seq_id): (r["cluster"], r["size"]) for r in linked.collect()}
    wanted = brute_clusters(texts, 0.8)
    assert got == {("m", i): (c, wanted.count(c)) for i, c in enumerate(wanted)} | {("one", 7): (7, 1)}
    assert 1 < len(set(wanted)) < 150
    counts = {}
    for column in zip(*texts, strict=True):
        for i, j in itertools.combinations(range(150), 2):
            if wanted[i] != wanted[j]:
                a, b = sorted("ARND".index(column[k]) for k in (i, j))
                counts[a, b] = counts.get((a, b), 0) + 1 / wanted.count(wanted[i]) / wanted.count(wanted[j])
    table = clusters.between_cluster_counts(cells, linked)
    assert {(r.a, r.b): r.n for r in clusters.pair_counts(table).collect()} == pytest.approx(counts)
    assert clusters.single_linkage(cells.where("false"), 0.8).collect() == []
    assert clusters.between_cluster_counts(cells.where("false"), linked).collect() == []


def test_clusters_of_a_large_alignment(spark):
    """5,000 rows of one alignment: 25 blocks, and no array over all pairs."""
    rng = np.random.default_rng(6)
    roots = rng.integers(0, 20, (50, 30))
    texts = ["".join("ARNDCQEGHILKMFPSTWYV"[c] for c in roots[i % 50]) for i in range(5000)]
    cells = msa.cells(spark.createDataFrame([("m", i, t) for i, t in enumerate(texts)], "msa_id string, seq_id long, seq string"))
    got = {r.seq_id: (r["cluster"], r["size"]) for r in clusters.single_linkage(cells, 0.9).collect()}
    assert got == {i: (i % 50, 100) for i in range(5000)}


def test_store(spark, tmp_path):
    store = database.ProfileStore(spark, f"file://{tmp_path}/db")
    profiles = spark.createDataFrame([("a", 3.2, 2), ("b", 9.0, 300)], "profile_id string, effective double, length long")
    positions = spark.createDataFrame([("a", 1, 0, "u"), ("a", 2, 22, "v"), ("b", 1, 3, "u"), ("b", 2, 4, "w")], "profile_id string, pos long, residue int, key string")
    store.make(profiles, positions, "key")
    assert {(r.key, r.n) for r in store.vectors().collect()} == {("u", 2), ("w", 1)}
    assert tuple(store.header().first()) == (2, 302) and store.pairs().count() == 3
    store.append(profiles.limit(0), positions.limit(1))
    with pytest.raises(ValueError, match="add up"):
        store.vectors()
    rows = positions.select("key")
    with pytest.raises(Exception, match="not in the store"):
        database.looked_up(rows, rows.where("key = 'u'").distinct(), ["key"]).collect()


def test_segments(spark):
    text = "abcdeabcdaaaaaaaaaabcdeabcde"
    series = spark.createDataFrame([("s", i + 1, c) for i, c in enumerate(text)] + [("t", 1, "a")], "id string, pos long, symbol string")
    entropies = seg.window_entropy(series, 4, list("abcde"))
    assert entropies.where("id = 't' and entropy is null").count() == 1
    found = seg.segments(entropies, 4, 0.5, 0.9)
    assert [(r.left, r.right) for r in found.collect()] == [(9, 20)]
    hidden = seg.masked(series, found, "X", F.col("symbol") == "b").where("id = 's'").orderBy("pos").collect()
    assert "".join(r.symbol for r in hidden) == text[:8] + "X" * 11 + "b" + text[20:]
    best = seg.optimised(series, found, 5).first()
    assert text[best.left - 1 : best.right] == "a" * 10
    assert seg.segments(entropies, 4, 1.9, 1.9, high=True).count() >= 1
    spans = spark.createDataFrame([(1, 1, 3), (1, 3, 5), (1, 6, 7), (1, 2, 2), (2, 1, 1)], "id long, left long, right long")
    assert sorted((r.id, r.left, r.right) for r in seg.merged(spans).collect()) == [(1, 1, 5), (1, 6, 7), (2, 1, 1)]
    vectors = spark.createDataFrame([(1, 1, [0.0]), (1, 2, [5.0]), (1, 3, [0.1])], "id long, pos long, vector array<double>")
    assert [r.symbol for r in seg.classified(vectors, 1.0).orderBy("pos").collect()] == ["0", "1", "0"]


def test_generators_are_fixed_by_their_seed(spark):
    a = generate.labelled_clusters(spark, 3, 5, 2, 1).orderBy("vec_id").collect()
    assert a == generate.labelled_clusters(spark, 3, 5, 2, 1).repartition(3).orderBy("vec_id").collect() != generate.labelled_clusters(spark, 3, 5, 2, 2).orderBy("vec_id").collect()
    library = spark.range(400).select((F.col("id") % 4).alias("id"), (F.floor(F.col("id") / 4) + 1).alias("pos"), F.col("id").alias("x"))
    new = generate.shuffled_fragments(library, 3, 20, 8, 9)
    assert new.count() == 60 and new.select("new_id", "new_pos").distinct().count() == 60
    assert new.where("source_pos <= 20 or source_pos > 80").count() == 0
    rows = generate.markov_alignment(spark, 2, 3, 10, 4).collect()
    assert all(sum(not c.islower() for c in r.seq) == 10 for r in rows) and all("-" not in r.seq for r in rows if r.seq_id == 0)
    series = spark.range(60).select((F.col("id") % 2).alias("id"), (F.floor(F.col("id") / 2) + 1).alias("pos"), F.array(F.col("id") * 1.0).alias("x"))
    taken = generate.sampled_contexts(series, 60, 3, 5, [0.25, 0.5, 0.25])
    assert taken.count() == 56 and all(r.context == [float(2 * (r.pos - 1) + r.id)] for r in taken.collect())
    three = generate.sampled_contexts(series, 60, 3, 5, [0.25, 0.5, 0.25], three=True)
    assert all(r.context == [float(2 * (r.pos - 2) + r.id), float(2 * (r.pos - 1) + r.id), float(2 * r.pos + r.id)] for r in three.collect())
    states = library.withColumn("state", F.floor((F.col("pos") - 1) / 5) % 3)
    whole = generate.shuffled_elements(states, 2, 23, 6)
    assert whole.count() == 46 and whole.select("new_id", "new_pos").distinct().count() == 46
    runs = whole.groupBy("new_id", F.floor((F.col("new_pos") - 1) / 5).alias("r")).agg(F.count_distinct("state").alias("s"), F.max("source_pos").alias("m"))
    assert runs.where("s <> 1").count() == 0 and whole.where("source_pos <= 20 or source_pos > 80").count() == 0
    assert generate.width_for(10, lambda w: w / 2) == 20
    rng = np.random.default_rng(0)
    for kind, par in (
        ("discrete", {"p": [0.2, 0.8]}), ("beta", {"a": 2, "b": 3}), ("chi2", {"df": 3}), ("exponential", {}), ("gamma", {"shape": 2}), ("t", {"df": 5}),
        ("dirichlet", {"alpha": [1, 2]}), ("mvnormal", {"mean": [0, 0], "cov": np.eye(2)}), ("mvt", {"mean": [0, 0], "cov": np.eye(2), "df": 4}),
    ):
        assert len(generate.variates(kind, rng, 7, **par)) == 7


def test_sampler_recovers_planted_clusters(spark, tmp_path):
    planted = generate.labelled_clusters(spark, 3, 30, 2, 8, 12.0)
    state = planted.select("vec_id", (F.col("vec_id") % 5).alias("group_id"), F.col("vec_id").alias("table_id"), F.col("vec_id").alias("dish_id"), "x")
    whole = hdp.moments(state.withColumn("k", F.lit(0)), "k").first()
    prior = hdp.Prior(np.array(whole.total) / whole.n, np.eye(2) * 2, 0.05, 4.0)

    def cut(df, n):
        df.write.parquet(f"{tmp_path}/{n}")
        return spark.read.parquet(f"{tmp_path}/{n}")

    out = hdp.fit(state, prior, 5, 4, cut)
    assert hdp.menu_consistent(out)
    seen = out.join(planted, "vec_id").groupBy("dish_id").agg(F.count_distinct("cluster").alias("c"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in seen if r.c == 1) >= 80


def test_splits_and_merges(spark, tmp_path):
    """One dish to start with, tables of two vectors; proposals move whole tables, with scans they find the planted clusters."""
    planted = generate.labelled_clusters(spark, 3, 30, 2, 8, 12.0)
    own = F.row_number().over(Window.partitionBy("cluster").orderBy("vec_id"))
    state = planted.withColumn("table_id", F.floor(own / 2) * 3 + F.col("cluster"))
    state = state.select("vec_id", F.lit(0).cast("long").alias("group_id"), F.col("table_id").cast("long").alias("table_id"), F.lit(7).cast("long").alias("dish_id"), "x")
    whole = hdp.moments(state.withColumn("k", F.lit(0)), "k").first()
    prior = hdp.Prior(np.array(whole.total) / whole.n, np.eye(2) * 2, 0.05, 4.0)

    def cut(df, name):
        path = f"{tmp_path}/{len(list(tmp_path.iterdir()))}-{name}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    split, taken = hdp.split_merge_tables(state, prior, 0, cut)
    assert taken and split.count() == 90 and split.select("dish_id").distinct().count() == 2
    assert split.groupBy("table_id").agg(F.count_distinct("dish_id").alias("c")).where("c > 1").count() == 0
    # two dishes for both halves of one cluster are merged again
    one = state.join(planted.where("cluster = 0").select("vec_id"), "vec_id")
    side = F.avg(F.get("x", 0)).over(Window.partitionBy("table_id")) > F.avg(F.get("x", 0)).over(Window.partitionBy("group_id"))
    torn = cut(one.withColumn("dish_id", side.cast("long")), "torn")
    for seed in range(8):
        torn, _ = hdp.split_merge_tables(torn, prior, seed, cut)
    assert torn.count() == 30 and torn.select("dish_id").distinct().count() == 1
    assert hdp.split_merge_tables(state.where("false"), prior, 1, cut)[1] is False
    out = hdp.fit(state, prior, 4, 4, cut, proposals=2, scales=True)
    assert hdp.menu_consistent(out)
    seen = out.join(planted, "vec_id").groupBy("dish_id").agg(F.count_distinct("cluster").alias("c"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in seen if r.c == 1) >= 80


def test_a_merge_is_weighed_by_the_split_it_undoes(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(40):
        x = rng.normal(0, 2, (int(rng.integers(1, 4)), 2))
        rows.append((k, None, len(x), x.sum(axis=0).tolist(), (x.T @ x).ravel().tolist()))
    tables = spark.createDataFrame(rows, "k long, was boolean, n long, total array<double>, outer array<double>")
    prior = hdp.Prior(np.zeros(2), np.eye(2), 0.1, 4.0)
    sides = tuple((1, (r[2], np.array(r[3]), np.array(r[4]))) for r in rows[:2])
    dealt = {r.k: r for r in hdp._sided(tables, prior, (0, 1), sides, 3, False).collect()}
    present = tables.drop("was").join(spark.createDataFrame([(k, r.side) for k, r in dealt.items()], "k long, was boolean"), "k")
    undone = hdp._sided(present.select(tables.columns), prior, (0, 1), sides, 5, True).collect()
    assert {r.k: (r.side, r.log_q) for r in undone} == {k: (r.side, r.log_q) for k, r in dealt.items()}
    assert dealt[0].side and not dealt[1].side and len({r.side for r in dealt.values()}) == 2


def test_streams(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, x array<double>")
    for k in range(3):
        frame.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = incremental.arrivals(spark, f"{tmp_path}/in", frame)
    queries = frame.where("id < 2")
    for _ in range(2):  # a second run finds nothing new
        incremental.search_arrivals(stream, queries, "id", "x", 4, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    best = {(r.query_id, r["rank"]): r.subject_id for r in incremental.best_hits(spark, f"{tmp_path}/out", 4).collect()}
    x = np.array([r[1] for r in rows])
    for q in range(2):
        assert [best[q, k + 1] for k in range(4)] == np.argsort(-np.round(x @ x[q], 6), kind="stable")[:4].tolist()
