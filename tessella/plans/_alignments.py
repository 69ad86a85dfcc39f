"""Queries over multiple alignments: column statistics, profiles, clusters, substitution scores, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import alphabet as A
from tessella.operators import clusters, extents, masking, msa
from tessella.plans._common import CELLS, DIGITS, r6, sequences, sql6
from tessella.sources import alignments as files

IDENTITY = 0.62
LAMBDA = 0.3176
BG = ", ".join(map(repr, A.BACKGROUND))
RESIDUES = f"r AS (SELECT i AS code, [{BG}][i + 1] AS bg FROM range(20) AS t(i))"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.cells(sequences(spark, sf_dir))


def column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.column_counts(_cells(spark, sf_dir))


def gap_column_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.without_gappy_columns(_cells(spark, sf_dir), 0.3).groupBy("msa_id", "pos").agg(r6(F.max("gap_share")).alias("gap_share"))


def terminal_gap_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = msa.trimmed(_cells(spark, sf_dir)).where("used")
    return used.groupBy("msa_id", "seq_id").agg(F.min("pos").alias("first_used"), F.max("pos").alias("last_used"))


TRIM = f"""
WITH {CELLS}, e AS (SELECT msa_id, seq_id, min(CASE WHEN code < 23 THEN pos END) AS lo, max(CASE WHEN code < 23 THEN pos END) AS hi, max(pos) AS last FROM c GROUP BY 1, 2)
SELECT e.msa_id, seq_id, CASE WHEN seq_id = query THEN 1 ELSE lo END AS first_used, CASE WHEN seq_id = query THEN last ELSE hi END AS last_used
FROM e JOIN first USING (msa_id) WHERE seq_id = query OR lo IS NOT NULL"""


def match_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.match_states(_cells(spark, sf_dir))


def background_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.query_background(_cells(spark, sf_dir)).select("msa_id", "code", r6("prob").alias("prob"))


SHARED = (
    "CASE WHEN code < 20 THEN [code] WHEN code = 20 THEN [2, 3] WHEN code = 21 THEN [5, 6] ELSE [] END AS parts, CASE WHEN code < 20 THEN 1.0 ELSE 0.5 END AS w"
)
BACKGROUND = f"""
WITH {CELLS}, {RESIDUES}, s AS (SELECT msa_id, unnest(parts) AS code, w FROM (SELECT msa_id, {SHARED} FROM m)),
n AS (SELECT msa_id, code, sum(w)::DOUBLE AS n FROM s GROUP BY 1, 2), t AS (SELECT msa_id, sum(n) AS t FROM n GROUP BY 1),
g AS (SELECT f.msa_id, r.code, bg, coalesce(n, 0) AS n, coalesce(t, 0) AS t FROM first f CROSS JOIN r LEFT JOIN n ON n.msa_id = f.msa_id AND n.code = r.code LEFT JOIN t ON t.msa_id = f.msa_id)
SELECT msa_id, code::INT AS code, {sql6("(1 - 120 / (2 * t + 120)) * n / greatest(t, 0.5) + 120 / (2 * t + 120) * bg")} AS prob FROM g"""


def henikoff_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.sequence_weights(_cells(spark, sf_dir)).select("msa_id", "seq_id", r6("weight").alias("weight"))


WEIGHTS = """x AS (SELECT c.* FROM c JOIN m USING (msa_id, pos) WHERE c.code < 23),
k AS (SELECT msa_id, pos, least(count(DISTINCT code), 20) AS k FROM x GROUP BY 1, 2), nc AS (SELECT msa_id, pos, code, count(*) AS n FROM x GROUP BY 1, 2, 3),
u AS (SELECT x.msa_id, seq_id, sum(1.0::DOUBLE / (n * k)) / greatest(count(*) + 1, 30) AS w FROM x JOIN k USING (msa_id, pos) JOIN nc ON nc.msa_id = x.msa_id AND nc.pos = x.pos AND nc.code = x.code GROUP BY 1, 2),
wt AS (SELECT msa_id, seq_id, w / sum(w) OVER (PARTITION BY msa_id) AS weight FROM u)"""
FREQS = f"""{WEIGHTS},
fp AS (SELECT msa_id, pos, n, unnest(parts) AS code, weight * w AS f FROM (SELECT x.msa_id, x.pos, weight, count(*) OVER (PARTITION BY x.msa_id, x.pos) AS n, {SHARED} FROM x JOIN wt USING (msa_id, seq_id))),
fr AS (SELECT msa_id, pos, n, code, sum(f) / sum(sum(f)) OVER (PARTITION BY msa_id, pos) AS freq FROM fp GROUP BY 1, 2, 3, 4)"""
TARGETS = f"""{FREQS}, {RESIDUES},
tg AS (SELECT d.msa_id, d.pos, r.code, bg, least(0.65 / pow(d.n, 0.9), 1.0) * bg + (1 - least(0.65 / pow(d.n, 0.9), 1.0)) * coalesce(freq, 0) AS target
  FROM (SELECT DISTINCT msa_id, pos, n FROM fr) d CROSS JOIN r LEFT JOIN fr ON fr.msa_id = d.msa_id AND fr.pos = d.pos AND fr.code = r.code)"""


def column_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    targets = msa.target_frequencies(msa.match_frequencies(cells, msa.sequence_weights(cells)))
    return msa.information(targets).select("msa_id", "pos", r6("information").alias("information"))


def profile_from_msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = msa.build_profile(_cells(spark, sf_dir), LAMBDA)
    return built.select("msa_id", "pos", "code", r6("target").alias("target"), r6("score").alias("score"))


def profile_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msa.profile_probabilities(msa.build_profile(_cells(spark, sf_dir), LAMBDA)).select("msa_id", "code", r6("prob").alias("prob"))


def effective_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    return msa.effective_sequences(msa.match_frequencies(cells, msa.sequence_weights(cells))).select("msa_id", r6("effective").alias("effective"))


EFFECTIVE = f"""
WITH {CELLS}, {FREQS}, kd AS (SELECT msa_id, pos, exp(-sum(freq * ln(freq))) AS kinds FROM fr GROUP BY 1, 2),
oc AS (SELECT n, 20 - (SELECT sum(pow(1 - b, n)) FROM (SELECT unnest([{BG}]) AS b)) AS k FROM range(400) AS t(n)),
os AS (SELECT n, k, lag(k) OVER (ORDER BY n) AS below FROM oc),
dr AS (SELECT msa_id, pos, kinds, min(n) AS n FROM kd LEFT JOIN os ON below IS NOT NULL AND k > kinds GROUP BY 1, 2, 3),
ex AS (SELECT msa_id, round_even(CASE WHEN dr.n IS NULL THEN 400 ELSE dr.n - (k - kinds) / (k - below) END, 0) AS d FROM dr LEFT JOIN os ON os.n = dr.n)
SELECT msa_id, {sql6("median(d)")} AS effective FROM ex GROUP BY msa_id"""


def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    found = msa.transitions(cells, msa.sequence_weights(cells))
    return found.select("msa_id", "pos", "from_state", "to_state", r6("weight").alias("weight"))


MOVES = f"""{WEIGHTS}, e AS (SELECT msa_id, seq_id, min(CASE WHEN code < 23 THEN pos END) AS lo, max(CASE WHEN code < 23 THEN pos END) AS hi FROM c GROUP BY 1, 2),
st AS (SELECT c.msa_id, c.seq_id, c.pos, m.pos IS NOT NULL AS is_match, CASE WHEN m.pos IS NOT NULL THEN CASE WHEN c.code < 23 THEN 'M' ELSE 'D' END WHEN c.code < 23 THEN 'I' END AS kind
  FROM c JOIN first USING (msa_id) JOIN e USING (msa_id, seq_id) LEFT JOIN m ON m.msa_id = c.msa_id AND m.pos = c.pos WHERE c.seq_id = query OR c.pos BETWEEN lo AND hi),
mv AS (SELECT *, lag(kind) OVER o AS before, max(CASE WHEN is_match THEN pos END) OVER (PARTITION BY msa_id, seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mpos
  FROM st WHERE kind IS NOT NULL WINDOW o AS (PARTITION BY msa_id, seq_id ORDER BY pos)),
mw AS (SELECT msa_id, coalesce(mpos, 0)::INT AS pos, before AS from_state, kind AS to_state, sum(weight) AS weight FROM mv JOIN wt USING (msa_id, seq_id) WHERE before IS NOT NULL GROUP BY 1, 2, 3, 4)"""


def transition_pme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior means of the moves out of the match state, by alignment."""
    cells = _cells(spark, sf_dir)
    moves = msa.transitions(cells, msa.sequence_weights(cells)).where("from_state = 'M'")
    counts = moves.groupBy("msa_id", F.col("to_state").alias("state")).agg(F.sum("weight").alias("n"))
    prior = [(k[1], v) for k, v in msa.PRIOR.items() if k[0] == "M"]
    return msa.posterior_means(counts, ["msa_id"], prior).select("msa_id", "state", r6("prob").alias("prob"))


_M_PRIOR = ", ".join(f"('{k[1]}', {v})" for k, v in msa.PRIOR.items() if k[0] == "M")
PME = f"""
WITH {CELLS}, {MOVES}, n AS (SELECT msa_id, to_state AS state, sum(weight) AS n FROM mw WHERE from_state = 'M' GROUP BY 1, 2), pm(state, alpha) AS (VALUES {_M_PRIOR}),
g AS (SELECT d.msa_id, pm.state, coalesce(n, 0) + alpha AS raw FROM (SELECT DISTINCT msa_id FROM n) d CROSS JOIN pm LEFT JOIN n ON n.msa_id = d.msa_id AND n.state = pm.state)
SELECT msa_id, state, {sql6("raw / sum(raw) OVER (PARTITION BY msa_id)")} AS prob FROM g"""


def identity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.identities(_cells(spark, sf_dir), digits=DIGITS).select("msa_id", "seq_a", "seq_b", "segment", "matches", "identity")


PAIRS = """us AS (SELECT c.msa_id, c.seq_id, c.pos, c.code FROM c JOIN first USING (msa_id)
  JOIN (SELECT msa_id, seq_id, min(CASE WHEN code < 23 THEN pos END) AS lo, max(CASE WHEN code < 23 THEN pos END) AS hi FROM c GROUP BY 1, 2) e USING (msa_id, seq_id)
  WHERE c.code < 22 AND (c.seq_id = query OR c.pos BETWEEN lo AND hi)),
pr AS (SELECT a.msa_id, a.seq_id AS seq_a, b.seq_id AS seq_b, count(*) AS segment, sum((a.code = b.code)::INT)::BIGINT AS matches
  FROM us a JOIN us b ON a.msa_id = b.msa_id AND a.pos = b.pos AND a.seq_id < b.seq_id GROUP BY 1, 2, 3)"""


def identity_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.select_sequences(_cells(spark, sf_dir), 0.9).select("msa_id", "seq_id", "selected")


def greedy_identity_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences taken by falling identity with the query, each below 0.8 to all taken before it."""
    return clusters.select_sequences(_cells(spark, sf_dir), 0.8, wanted=1_000_000)


GREEDY = f"""
WITH RECURSIVE {CELLS}, sp AS (SELECT msa_id, seq_id, min(CASE WHEN code < 23 THEN pos END) AS lo, max(CASE WHEN code < 23 THEN pos END) AS hi FROM c GROUP BY 1, 2),
ow AS (SELECT c.msa_id, c.seq_id, c.pos, c.code FROM c JOIN m USING (msa_id, pos) JOIN first USING (msa_id) JOIN sp USING (msa_id, seq_id) WHERE c.seq_id = query OR c.pos BETWEEN lo AND hi),
pq AS (SELECT a.msa_id, a.seq_id AS x, b.seq_id AS y, sum((a.code = b.code)::INT) / count(*)::DOUBLE AS share
  FROM ow a JOIN ow b ON a.msa_id = b.msa_id AND a.pos = b.pos AND a.seq_id <> b.seq_id WHERE a.code < 22 AND b.code < 22 GROUP BY 1, 2, 3),
near AS (SELECT msa_id, x AS seq_id, list(y) AS alike FROM pq WHERE share >= 0.8 GROUP BY 1, 2),
od AS (SELECT f.msa_id, f.seq_id, row_number() OVER (PARTITION BY f.msa_id ORDER BY round_even(1000 * coalesce(share, 0), 0) DESC, f.seq_id) AS k
  FROM (SELECT DISTINCT msa_id, seq_id FROM ow) f JOIN first USING (msa_id) LEFT JOIN pq ON pq.msa_id = f.msa_id AND x = f.seq_id AND y = query WHERE f.seq_id <> query),
rc AS (SELECT msa_id, 0::BIGINT AS k, [query] AS taken FROM first
  UNION ALL SELECT rc.msa_id, od.k, CASE WHEN list_has_any(taken, coalesce(alike, [])) THEN taken ELSE list_append(taken, od.seq_id) END
  FROM rc JOIN od ON od.msa_id = rc.msa_id AND od.k = rc.k + 1 LEFT JOIN near ON near.msa_id = od.msa_id AND near.seq_id = od.seq_id),
en AS (SELECT msa_id, arg_max(taken, k) AS taken FROM rc GROUP BY msa_id)
SELECT sp.msa_id, sp.seq_id, list_contains(taken, sp.seq_id) AS selected FROM sp JOIN en USING (msa_id)"""


def single_linkage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.single_linkage(_cells(spark, sf_dir), IDENTITY)


LINKED = f"""{PAIRS}, ed AS (SELECT msa_id, seq_a AS a, seq_b AS b FROM pr WHERE matches >= {IDENTITY} * segment - 1e-12 UNION SELECT msa_id, seq_b, seq_a FROM pr WHERE matches >= {IDENTITY} * segment - 1e-12),
rc AS (SELECT DISTINCT msa_id, seq_id, seq_id AS other FROM c UNION SELECT rc.msa_id, rc.seq_id, ed.b FROM rc JOIN ed ON ed.msa_id = rc.msa_id AND ed.a = rc.other),
cl AS (SELECT msa_id, seq_id, min(other) AS cluster, count(*) AS size FROM rc GROUP BY 1, 2)"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    return clusters.held(clusters.between_cluster_counts(cells, clusters.single_linkage(cells, IDENTITY)))


def between_cluster_residue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.residue_counts(_counts(spark, sf_dir)).select("code", r6("n").alias("n"))


def between_cluster_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.pair_counts(_counts(spark, sf_dir)).select("a", "b", r6("n").alias("n"))


BETWEEN = f"""{LINKED}, wc AS (SELECT us.*, cluster, 1.0::DOUBLE / size AS w FROM us JOIN cl USING (msa_id, seq_id) WHERE code < 20),
bp AS (SELECT least(a.code, b.code) AS a, greatest(a.code, b.code) AS b, sum(a.w * b.w) AS n FROM wc a JOIN wc b ON a.msa_id = b.msa_id AND a.pos = b.pos AND a.seq_id < b.seq_id AND a.cluster <> b.cluster GROUP BY 1, 2),
br AS (SELECT code, sum(w) AS n FROM wc a WHERE EXISTS (SELECT 1 FROM wc b WHERE a.msa_id = b.msa_id AND a.pos = b.pos AND a.cluster <> b.cluster) GROUP BY 1)"""
SCORES = f"""{BETWEEN}, sq AS (SELECT a, b, n / sum(n) OVER () / CASE WHEN a = b THEN 1 ELSE 2 END AS target FROM bp),
mg AS (SELECT code, sum(target) AS m FROM (SELECT a AS code, target FROM sq UNION ALL SELECT b, target FROM sq WHERE a <> b) GROUP BY code),
sc AS (SELECT x.code AS a, y.code AS b, coalesce(target, 0) AS target, x.m * y.m AS product, CASE WHEN target > 0 THEN log2(target / (x.m * y.m)) ELSE -1000 / ln(2) END AS score
  FROM mg x JOIN mg y ON x.code <= y.code LEFT JOIN sq ON sq.a = x.code AND sq.b = y.code)"""


def logodds_from_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = clusters.substitution_scores(clusters.pair_counts(_counts(spark, sf_dir)))
    return s.select("a", "b", r6("target").alias("target"), r6("product").alias("product"), r6("score").alias("score"))


def logodds_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = clusters.score_summary(clusters.substitution_scores(clusters.pair_counts(_counts(spark, sf_dir))))
    return s.select(r6("entropy").alias("entropy"), r6("expected").alias("expected"), "scale")


def abstract_symbol_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(spark, sf_dir)
    s = clusters.abstract_scores(clusters.substitution_scores(clusters.pair_counts(counts)), clusters.residue_counts(counts))
    return s.select("a", "b", r6("score").alias("score"))


ABSTRACT = f"""
WITH RECURSIVE {CELLS}, {SCORES}, bg AS (SELECT code, n / sum(n) OVER () AS p FROM br),
sy AS (SELECT a, b, score FROM sc UNION ALL SELECT b, a, score FROM sc WHERE a <> b),
gr AS (SELECT code, p, unnest(CASE WHEN code IN (2, 3) THEN [20, 22, code] WHEN code IN (5, 6) THEN [21, 22, code] ELSE [22, code] END) AS sym FROM bg),
mn AS (SELECT x.sym AS a, y.sym AS b, sum(CASE WHEN x.sym < 20 THEN 1 ELSE x.p END * CASE WHEN y.sym < 20 THEN 1 ELSE y.p END * score)
    / sum(CASE WHEN x.sym < 20 THEN 1 ELSE x.p END * CASE WHEN y.sym < 20 THEN 1 ELSE y.p END) AS score
  FROM sy JOIN gr x ON x.code = sy.a JOIN gr y ON y.code = sy.b WHERE x.sym >= 20 OR y.sym >= 20 GROUP BY 1, 2),
st AS (SELECT DISTINCT sym AS a, 23 AS b, (SELECT min(score) FROM sc) AS score FROM gr),
en AS (SELECT sum(CASE WHEN a = b THEN 1 ELSE 2 END * score * target) AS h FROM sc)
SELECT a::INT AS a, b::INT AS b, {sql6("score")} AS score FROM (SELECT * FROM mn UNION ALL SELECT * FROM st UNION ALL SELECT b, a, score FROM st
  UNION ALL SELECT 23, 23, 1.0 / CASE WHEN h <= 0 THEN 1 ELSE greatest(2, round_even(2 / sqrt(h), 0)) END FROM en)"""


def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences written as FASTA texts, lines of 10, and read again."""
    rows = sequences(spark, sf_dir).select("msa_id", "seq_id", F.col("seq_id").cast("string").alias("title"), "seq")
    width = F.max(F.length("seq")).over(Window.partitionBy("msa_id"))
    padded = rows.withColumn("seq", F.rpad("seq", width, "-"))
    texts = files.to_fasta(padded, 10).select(F.col("msa_id").alias("path"), "value")
    return files.fasta(texts).select("msa_id", F.col("title").cast("long").alias("seq_id"), "seq")


def target_frequencies_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with a fixed weight of pseudo-frequencies."""
    cells = _cells(spark, sf_dir)
    out = msa.target_frequencies(msa.match_frequencies(cells, msa.sequence_weights(cells)), kind="fixed")
    return out.select("msa_id", "pos", "code", r6("target").alias("target"))


FIXED = f"""
WITH {CELLS}, {FREQS}, {RESIDUES}, kd AS (SELECT msa_id, pos, 10.0 / (greatest(count(*) - 1, 0) + 10.0) AS alpha FROM fr WHERE freq > 0 GROUP BY 1, 2)
SELECT kd.msa_id, kd.pos, r.code::INT AS code, {sql6("alpha * bg + (1 - alpha) * coalesce(freq, 0)")} AS target
FROM kd CROSS JOIN r LEFT JOIN fr ON fr.msa_id = kd.msa_id AND fr.pos = kd.pos AND fr.code = r.code"""


def position_specific_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extents.position_weights(_cells(spark, sf_dir), 4).withColumn("weight", r6("weight"))


def _position_weights_sql(least: int, extents: bool) -> str:
    """Each column on its own: its members, their common extent, their weights over it."""
    bounds = "l, r" if extents else "0 AS l, n - 1 AS r"
    return f"""
WITH {CELLS}, rs AS (SELECT c.msa_id, c.seq_id, c.pos, c.code, state - 1 AS col FROM c JOIN m USING (msa_id, pos) WHERE c.code < 23),
be AS (SELECT msa_id, seq_id, min(col) AS lo, max(col) AS hi FROM rs GROUP BY 1, 2), ln AS (SELECT msa_id, count(*) AS n FROM m GROUP BY 1),
ex AS (SELECT msa_id, state - 1 AS p, n, max(lo) AS l, min(hi) AS r FROM m JOIN ln USING (msa_id) JOIN be USING (msa_id) WHERE state - 1 BETWEEN lo AND hi GROUP BY 1, 2, 3),
e1 AS (SELECT *, least({least}, n) AS want, greatest(0, l - (greatest(0, least({least}, n) - (r - l + 1)) + 1) // 2) AS l1 FROM ex),
e2 AS (SELECT msa_id, p, n, l1, want, least(n - 1, l1 + greatest(r - l1, want - 1)) AS r FROM e1),
e3 AS (SELECT msa_id, p, n, greatest(0, least(l1, r - want + 1)) AS l, r FROM e2), ee AS (SELECT msa_id, p, {bounds} FROM e3),
x AS (SELECT ee.msa_id, p, rs.col, rs.seq_id, rs.code FROM ee JOIN be ON be.msa_id = ee.msa_id AND p BETWEEN lo AND hi JOIN rs ON rs.msa_id = be.msa_id AND rs.seq_id = be.seq_id AND rs.col BETWEEN l AND r),
k AS (SELECT msa_id, p, col, least(count(DISTINCT code), 20) AS k FROM x GROUP BY 1, 2, 3), nc AS (SELECT msa_id, p, col, code, count(*) AS n FROM x GROUP BY 1, 2, 3, 4),
u AS (SELECT msa_id, p, seq_id, sum(1.0::DOUBLE / (n * k)) AS w FROM x JOIN k USING (msa_id, p, col) JOIN nc USING (msa_id, p, col, code) GROUP BY 1, 2, 3)
SELECT u.msa_id, rs.pos, u.seq_id, {sql6("w / sum(w) OVER (PARTITION BY u.msa_id, u.p)")} AS weight, a.pos AS first, b.pos AS last
FROM u JOIN rs ON rs.msa_id = u.msa_id AND rs.seq_id = u.seq_id AND rs.col = u.p JOIN ee ON ee.msa_id = u.msa_id AND ee.p = u.p
JOIN m a ON a.msa_id = u.msa_id AND a.state = l + 1 JOIN m b ON b.msa_id = u.msa_id AND b.state = r + 1"""


def unbounded_position_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``position_specific_weights``, a column's members being compared over the whole alignment."""
    return extents.position_weights(_cells(spark, sf_dir), extents=False).withColumn("weight", r6("weight"))


def masked_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with low-complexity residues as X."""
    return msa.sequences(masking.mask_sequences(_cells(spark, sf_dir), 6, 1.6, 2.0))


QUERIES = {
    f.__name__: f
    for f in (
        column_counts, gap_column_filter, terminal_gap_trim, match_states, background_probs, henikoff_weights, column_information, profile_from_msa,
        profile_probabilities, effective_sequences, transition_counts, transition_pme, identity_pairs, identity_purge, greedy_identity_set, single_linkage_clusters,
        between_cluster_residue_counts, between_cluster_pair_counts, logodds_from_counts, logodds_summary, abstract_symbol_scores, fasta_roundtrip,
        target_frequencies_fixed, position_specific_weights, unbounded_position_weights, masked_sequences,
    )
}
ORACLES = {
    "column_counts": f"WITH {CELLS} SELECT msa_id, pos, count(*) AS n_sequences, sum((code < 23)::INT)::BIGINT AS n_residues, count(DISTINCT CASE WHEN code < 23 THEN code END) AS n_distinct FROM c GROUP BY 1, 2 HAVING sum((code < 23)::INT) > 0",
    "gap_column_filter": f"WITH {CELLS} SELECT msa_id, pos, {sql6('avg((code = 24)::INT)')} AS gap_share FROM c GROUP BY 1, 2 HAVING avg((code = 24)::INT) < 0.3",
    "terminal_gap_trim": TRIM,
    "match_states": f"WITH {CELLS} SELECT msa_id, pos, code, state FROM m",
    "background_probs": BACKGROUND,
    "henikoff_weights": f"WITH {CELLS}, {WEIGHTS} SELECT msa_id, seq_id, {sql6('weight')} AS weight FROM wt",
    "column_information": f"WITH {CELLS}, {TARGETS} SELECT msa_id, pos, {sql6('greatest(0, sum(CASE WHEN target > 0 THEN target * log2(target / bg) END))')} AS information FROM tg GROUP BY 1, 2",
    "profile_from_msa": f"WITH {CELLS}, {TARGETS} SELECT msa_id, pos, code::INT AS code, {sql6('target')} AS target, {sql6(f'CASE WHEN target > 0 THEN ln(target / bg) / {LAMBDA} END')} AS score FROM tg",
    "profile_probabilities": f"WITH {CELLS}, {TARGETS}, mt AS (SELECT msa_id, code, avg(target) AS m FROM tg GROUP BY 1, 2) SELECT msa_id, code::INT AS code, {sql6('m / sum(m) OVER (PARTITION BY msa_id)')} AS prob FROM mt",
    "effective_sequences": EFFECTIVE,
    "transition_counts": f"WITH {CELLS}, {MOVES} SELECT msa_id, pos, from_state, to_state, {sql6('weight')} AS weight FROM mw",
    "transition_pme": PME,
    "identity_pairs": f"WITH {CELLS}, {PAIRS} SELECT msa_id, seq_a, seq_b, segment, matches, {sql6('matches / segment')} AS identity FROM pr",
    "single_linkage_clusters": f"WITH RECURSIVE {CELLS}, {LINKED} SELECT * FROM cl",
    "between_cluster_residue_counts": f"WITH RECURSIVE {CELLS}, {BETWEEN} SELECT code, {sql6('n')} AS n FROM br",
    "between_cluster_pair_counts": f"WITH RECURSIVE {CELLS}, {BETWEEN} SELECT a, b, {sql6('n')} AS n FROM bp WHERE n > 1e-9",
    "logodds_from_counts": f"WITH RECURSIVE {CELLS}, {SCORES} SELECT a, b, {sql6('target')} AS target, {sql6('product')} AS product, {sql6('score')} AS score FROM sc",
    "logodds_summary": f"WITH RECURSIVE {CELLS}, {SCORES}, z AS (SELECT sum(CASE WHEN a = b THEN 1 ELSE 2 END * score * target) AS h, sum(CASE WHEN a = b THEN 1 ELSE 2 END * score * product) AS x FROM sc) SELECT {sql6('h')} AS entropy, {sql6('x')} AS expected, CASE WHEN h <= 0 THEN 1.0 ELSE greatest(2.0, round_even(2 / sqrt(h), 0)) END AS scale FROM z",
    "abstract_symbol_scores": ABSTRACT,
    "target_frequencies_fixed": FIXED,
    "greedy_identity_set": GREEDY,
    "position_specific_weights": _position_weights_sql(4, True),
    "unbounded_position_weights": _position_weights_sql(4, False),
    "fasta_roundtrip": f"WITH {CELLS} SELECT msa_id, seq_id, seq FROM f",
}
