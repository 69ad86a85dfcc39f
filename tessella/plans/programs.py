"""The programs: whole workflows over DataFrames, with options in place of command lines."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import align, clusters, database, generate, hdp, masking, msa, scaler, search, seeds, significance, states
from tessella.sources import alignments, tables
from tessella.sources.tables import Options

#: Reference lambda, K, alpha and beta of gapped alignments.
LAMBDA, K, ALPHA, BETA = 0.561132, 0.001488, 0.5, -1.0
#: Options that a search does not take.
UNUSED = ("PCFWEIGHT", "SUBMAT", "SCOADJ", "SUPCLT", "ADJWGT", "HSPMINSCORE", "MASKAFTER")


def build_profile(rows: DataFrame, options: Options = Options(), lam: float = 0.3176, mask: bool = False) -> DataFrame:  # noqa: B008
    """Aligned sequences ``(msa_id, seq_id, seq)`` to profiles, after selecting sequences below the identity level."""
    cells = msa.cells(rows)
    chosen = clusters.select_sequences(cells, options.IDENTITY / 100).where("selected").select("msa_id", "seq_id")
    cells = cells.join(chosen, ["msa_id", "seq_id"], "left_semi")
    return msa.build_profile(masking.mask_sequences(cells) if mask else cells, lam)


def select_sequences(rows: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """The non-redundant rows of each alignment."""
    kept = clusters.select_sequences(msa.cells(rows), options.IDENTITY / 100).where("selected")
    return rows.join(kept.select("msa_id", "seq_id"), ["msa_id", "seq_id"], "left_semi")


def make_db(spark: SparkSession, root: str, profiles: DataFrame, positions: DataFrame, key: str) -> database.ProfileStore:
    """Profiles and their positions to a store of four tables."""
    store = database.ProfileStore(spark, root)
    store.make(profiles, positions, key)
    return store


def cluster_counts(rows: DataFrame, identity: float = 0.62, gaps: float = 0.5) -> DataFrame:
    """Residue and pair counts ``(a, b, n)`` between clusters of each alignment's sequences, gappy columns left out."""
    cells = msa.without_gappy_columns(msa.cells(rows), gaps).drop("gap_share")
    return clusters.between_cluster_counts(cells, clusters.single_linkage(cells, identity))


def derive_scores(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts to log-odds scores and their summary."""
    scores = clusters.substitution_scores(clusters.pair_counts(clusters.held(counts)))
    return scores, clusters.score_summary(scores)


def mask_low_complexity(rows: DataFrame, size: int = 12, trigger: float = 2.2, extension: float = 2.5) -> DataFrame:
    """Aligned sequences with low-complexity residues as X."""
    return msa.sequences(masking.mask_sequences(msa.cells(rows), size, trigger, extension))


def search_profiles(
    queries: DataFrame,
    subjects: DataFrame,
    options: Options = Options(),  # noqa: B008
    scheme: align.Scheme = align.Scheme(),  # noqa: B008
    lam: float = LAMBDA,
    k: float = K,
    seeding: seeds.Seeding | None = None,
    entropy: float | None = None,
    model: significance.PairModel | None = None,
    generous: float = 100.0,
) -> DataFrame:
    """Profiles ``(profile_id, v, ...)`` aligned with ``subjects``; hits by expectation.

    Blocks of queries meet blocks of subjects: all of them, or with ``seeding``
    only those with pairs that share words of positions (``seeds.candidates``),
    and only these pairs are aligned.  Expectations do not depend on it.  With
    ``entropy`` hits are aligned again by optimised target frequencies; their
    expectation and rank are by the new score.  With ``model`` hits are judged by
    location and scale of their pair: the constants, ``generous`` times as lax as
    ``EVAL``, only tell which pairs it looks at; a profile's thickness is its
    column ``thickness``, 1 without it.  Optional columns (see
    ``align.PROFILE``) give a profile's own moves, background, bits and states.
    The search space is that left by the edge-effect length.  A hit needs a
    positive score and an expectation up to ``EVAL``; each query lists at most
    ``NOHITS`` and has paths for the first ``NOALNS``, none where ``SHOW`` is 0.
    Cells below ``INFCON`` bits are scaled by the scheme's ``masked`` where it is
    below 1.  Other search options must keep their defaults.  Errors of single
    profiles do not end a search: those with a fault (``unusable``) are left out
    before it.
    """
    changed = [name for name in UNUSED if getattr(options, name) != getattr(Options, name)]
    if changed:
        raise ValueError(f"options without effect on a search: {', '.join(changed)}")
    q, s = (t.where(align.fault(t).isNull()) for t in (queries, subjects))
    whole = s.agg(F.sum(F.size("v")).alias("positions"), F.count("*").alias("profiles")).first()
    known = align.Significance(lam, k, ALPHA, BETA, whole.positions or 0, whole.profiles, options.EVAL * (generous if model else 1.0))
    scheme = replace(scheme, least_info=options.INFCON) if scheme.masked < 1 and not scheme.least_info else scheme
    pairs = None if seeding is None else seeds.candidates(q, s, seeding)
    found = align.align_profiles(q, s, scheme, realign=True, least=options.MINPP, significance=known, candidates=pairs, entropy=entropy)
    e = search.evalue(F.col("score"), lam, k, F.col("space"))
    if model:
        for side, own in (("query", q), ("subject", s)):
            thick = F.col("thickness").cast("double") if "thickness" in own.columns else F.lit(1.0)
            sizes = own.select(F.col("profile_id").cast("long").alias(f"{side}_id"), F.size("v").cast("double").alias(f"_{side}_n"), F.coalesce(thick, F.lit(1.0)).alias(f"_{side}_t"))
            found = found.join(sizes, f"{side}_id")
        law = model.law(F.col("_query_t"), F.col("_query_n"), F.col("_subject_t"), F.col("_subject_n"), F.lit(float(lam)))
        pair = significance.expectation(F.col("score"), law, F.lit(float(k)), K)
        e = significance.over_space(pair, F.col("_query_n"), F.col("_subject_n"), F.col("space"))
        found = found.withColumn("_e", e).where(F.col("_e") <= options.EVAL)
        e = F.col("_e")
    hits = found.withColumns({"evalue": e, "bits": search.bits(F.col("score"), lam, k), "pvalue": search.pvalue(e)})
    hits = hits.drop("space", "_e", "_query_n", "_query_t", "_subject_n", "_subject_t")
    listed = database.ranked(hits, ["query_id"], [F.asc("evalue"), F.asc("subject_id")], options.NOHITS)
    return listed.withColumn("path", F.when((F.col("rank") <= options.NOALNS) & F.lit(options.SHOW == 1), F.col("path")))


def unusable(profiles: DataFrame) -> DataFrame:
    """``(profile_id, reason)`` of profiles that a search leaves out."""
    return profiles.select("profile_id", align.fault(profiles).alias("reason")).where("reason is not null")


def scale_scores(vectors: DataFrame, wanted: float, offset: float) -> dict[str, float]:
    """The factor that brings all pairs of distinct vectors to a wanted lambda."""
    return scaler.scaled_to(vectors, wanted, offset)


def gen_profiles(library: DataFrame, wanted: int, length: int, fragment: int, seed: int) -> DataFrame:
    """Random profiles put together from fragments of a library."""
    return generate.shuffled_fragments(library, wanted, length, fragment, seed)


def gen_msas(library: DataFrame, wanted: int, width: int, length: int, fragment: int, seed: int) -> DataFrame:
    """Random alignments put together from fragments of columns of ``library(msa_id, seq_id, seq)``, ``width`` rows each.

    A source with fewer rows is filled up with gaps.
    """
    cells = msa.cells(library)
    rank = cells.select("msa_id", "seq_id").distinct()
    from pyspark.sql import Window

    rank = rank.withColumn("row", F.row_number().over(Window.partitionBy("msa_id").orderBy("seq_id")) - 1).where(F.col("row") < width)
    columns = cells.select(F.col("msa_id").alias("id"), "pos").distinct()
    picked = generate.shuffled_fragments(columns.withColumn("pos", F.col("pos").cast("long")), wanted, length, fragment, seed)
    grid = picked.crossJoin(cells.sparkSession.range(width).select(F.col("id").alias("row")))
    source = cells.join(rank, ["msa_id", "seq_id"]).select(F.col("msa_id").alias("source_id"), F.col("pos").cast("long").alias("source_pos"), "row", "code")
    full = grid.join(source, ["source_id", "source_pos", "row"], "left").withColumn("code", F.coalesce("code", F.lit(24)))
    return msa.sequences(full.select(F.col("new_id").alias("msa_id"), F.col("row").alias("seq_id"), F.col("new_pos").alias("pos"), "code"))


def rnd_msas(spark: SparkSession, wanted: int, effective: float, length: int, seed: int, noise: float = 0.0) -> DataFrame:
    """Random alignments from the model, wide enough for an effective number of sequences."""

    def reached(width: int) -> float:
        rows = generate.markov_alignment(spark, 1, width, length, seed, noise)
        upper = rows.select("msa_id", "seq_id", F.regexp_replace("seq", "[a-z]", "").alias("seq"))
        cells = msa.cells(upper)
        return msa.effective_sequences(msa.match_frequencies(cells, msa.sequence_weights(cells))).first()["effective"] or 0.0

    return generate.markov_alignment(spark, wanted, generate.width_for(effective, reached, 1, 64), length, seed, noise)


def niw_prior(vectors: DataFrame) -> hdp.Prior:
    """A prior from all vectors ``x``."""
    whole = hdp.moments(vectors.select(F.lit(0).alias("k"), "x"), "k").first()
    return hdp.niw_prior(whole.n, np.array(whole.total), np.array(whole.outer))


def hdp_fit(
    vectors: DataFrame, prior: hdp.Prior, scans: int, seed: int, root: str, proposals: int = 1, scales: bool = True, by_distance: bool = False, best: bool = False
) -> DataFrame:
    """Clusters of grouped vectors after ``scans`` rounds, the last or the best state.

    States are kept under ``root``; a fit that was broken off there goes on, and one that is whole is read.
    """
    kept = states.States(vectors.sparkSession, root)
    last = states.fit(vectors, prior, scans, seed, kept, proposals=proposals, scales=scales, by_distance=by_distance)
    found = kept.best() if best else last
    return found.vectors(vectors.sparkSession) if found else vectors


def simulate_clusters(spark: SparkSession, clusters_: int, size: int, dim: int, seed: int) -> DataFrame:
    return generate.labelled_clusters(spark, clusters_, size, dim, seed)


def sample_contexts(series: DataFrame, wanted: int, size: int, seed: int) -> DataFrame:
    return generate.sampled_contexts(series, wanted, size, seed)


def blast_to_msa(files: DataFrame, query_length: int, evalue: float, round_: int | None = None) -> DataFrame:
    """Search reports ``(path, value)`` to alignments over the query."""
    return alignments.stacked(alignments.report_hits(files), query_length, evalue, round_)


def insert_states(positions: DataFrame, predicted: DataFrame) -> DataFrame:
    """Predicted states put beside a profile's positions."""
    return tables.with_states(positions, predicted)
