"""Queries over pairs of positions: schemes, tables, masks, second-pass corrections, what expectations are made of.

A pair is a vector and the one with the next id, both as shares (softmax).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import alphabet as A
from tessella.functions import vectors as V
from tessella.operators import levels, profiles, scoring, significance, statistics
from tessella.plans._common import EVENT_TYPES, SERIES, VECTORS, r6, series, sql6, table, vectors
from tessella.sources import tables


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, q, s, qx, sx, ql, sl)``: shares, vectors and labels of both."""
    v = vectors(spark, sf_dir).where("x is not null").withColumn("f", V.softmax(F.col("x")))
    one = v.select(F.col("vec_id").alias("id"), F.col("f").alias("q"), F.col("x").alias("qx"), F.col("label").alias("ql"))
    return one.join(v.select((F.col("vec_id") - 1).alias("id"), F.col("f").alias("s"), F.col("x").alias("sx"), F.col("label").alias("sl")), "id")


PAIRS = f"""{VECTORS}, e AS (SELECT vec_id, label, x, list_transform(x, lambda v: exp(v)) AS e FROM v WHERE x IS NOT NULL),
t AS (SELECT vec_id, label, x, e, list_sum(e) AS z FROM e), f AS (SELECT vec_id, label, x, list_transform(e, lambda y: y / z) AS f FROM t),
p AS (SELECT a.vec_id AS id, a.f AS q, b.f AS s, a.x AS qx, b.x AS sx, a.label AS ql, b.label AS sl FROM f a JOIN f b ON b.vec_id = a.vec_id + 1)"""


def _sum(body: str) -> str:
    return f"list_sum(list_transform(range(1, len(q) + 1), lambda i: {body}))"


def lso_position_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-sum scheme, over the mean background of both."""
    bg = F.zip_with("q", "s", lambda a, b: (a + b) / 2)
    return pairs(spark, sf_dir).select("id", r6(scoring.log_sum_score(F.col("q"), F.col("s"), bg)).alias("score"))


LSO = f"WITH {PAIRS} SELECT id, {sql6('ln(' + _sum('q[i] * s[i] / ((q[i] + s[i]) / 2)') + ') - 0.0003')} AS score FROM p"


def profile_position_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile scheme, plain and weighted by observations."""
    odds = lambda c: F.transform(c, lambda x: F.ln(x * F.size(c)))
    p = pairs(spark, sf_dir).select("id", "q", "s", odds(F.col("q")).alias("qs"), odds(F.col("s")).alias("ss"), (F.col("id") % 7).cast("double").alias("qn"), (F.col("id") % 5).cast("double").alias("sn"))
    args = [F.col(c) for c in ("q", "ss", "s", "qs")]
    return p.select("id", r6(scoring.profile_score(*args)).alias("plain"), r6(scoring.profile_score(*args, F.col("qn"), F.col("sn"))).alias("weighted"))


PROFILE = f"""WITH {PAIRS}, d AS (SELECT id, {_sum("q[i] * ln(s[i] * len(q))")} AS a, {_sum("s[i] * ln(q[i] * len(q))")} AS b, (id % 7)::DOUBLE AS qn, (id % 5)::DOUBLE AS sn FROM p),
w AS (SELECT *, CASE WHEN qn > 0 THEN 1 - (1 + ln(qn)) / qn ELSE 0 END AS wq, CASE WHEN sn > 0 THEN 1 - (1 + ln(sn)) / sn ELSE 0 END AS ws FROM d),
u AS (SELECT *, CASE WHEN wq <= 0 AND ws <= 0 THEN 1.0 ELSE wq END AS uq, CASE WHEN wq <= 0 AND ws <= 0 THEN 1.0 ELSE ws END AS us FROM w)
SELECT id, {sql6("a + b")} AS plain,
  {sql6("2 * uq / CASE WHEN sn = 0 THEN 1 ELSE uq + us END * a + 2 * us / CASE WHEN sn = 0 THEN 1 ELSE uq + us END * b")} AS weighted FROM u"""

#: A table of cluster scores by levels of probability and sequences; one cell is missing.
LEVELS = [(p, e, r, c, None if (r, c) == (2, 0) and p == 0.4 else round(0.25 * (r + 1) * (c + 2) * p + 0.01 * e - 0.3, 6)) for p in (0.0, 0.4) for e in (0.0, 5.0) for r in range(3) for c in range(r + 1)]


def cluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two clusters from the level that both reach, and the same damped."""
    known = spark.createDataFrame(LEVELS, "plvl double, lvl double, row long, col long, score double")
    rows = pairs(spark, sf_dir).select(
        "id", (F.col("ql") % 3).cast("long").alias("row"), (F.col("sl") % 3).cast("long").alias("col"), F.element_at("q", 1).alias("p1"), F.element_at("s", 1).alias("p2"),
        (F.col("id") % 11).cast("double").alias("e1"), (F.col("id") % 13).cast("double").alias("e2"),
    ).withColumns({"p1": F.least(F.lit(1.0), F.col("p1") * 30), "p2": F.least(F.lit(1.0), F.col("p2") * 30)})
    out = rows.join(scoring.table_score(rows, known), "id")
    damped = scoring.damped(F.col("score"), F.col("e1"), F.col("e2"), F.col("p1"), F.col("p2"))
    return out.select("id", r6("score").alias("score"), r6(damped).alias("damped"))


_CELLS = ", ".join(f"({p}, {e}, {r}, {c}, {'NULL' if s is None else s})" for p, e, r, c, s in LEVELS)
CLUSTER = f"""WITH {PAIRS}, k(plvl, lvl, r, c, s) AS (VALUES {_CELLS}),
o AS (SELECT id, ql % 3 AS a, sl % 3 AS b, least(1, q[1] * 30) AS p1, least(1, s[1] * 30) AS p2, (id % 11)::DOUBLE AS e1, (id % 13)::DOUBLE AS e2 FROM p),
j AS (SELECT o.*, k.s, row_number() OVER (PARTITION BY id ORDER BY plvl DESC, lvl DESC) AS n FROM o LEFT JOIN k ON k.r = greatest(a, b) AND k.c = least(a, b) AND plvl <= least(p1, p2) AND lvl <= least(e1, e2)),
g AS (SELECT *, coalesce(s, 0) AS score FROM j WHERE n = 1)
SELECT id, {sql6("score")} AS score, {sql6("score * (0.4 + 0.6 * exp(-1.5e-5 * (0.47 * (e1 - 23) ** 4 + 0.47 * (e2 - 23) ** 4 + 0.94 * (e1 - 23) ** 2 * (e2 - 23) ** 2))) * exp(-7.5 * (0.37 * (p1 - 1) ** 2 + 0.37 * (p2 - 1) ** 2 + 2.34 * (p1 - 1) * (p2 - 1)))")} AS damped FROM g"""

#: Scores of three states; one cell is missing.
STATES = [(a, b, None if (a, b) == (1, 0) else 0.5 * (a == b) - 0.1 * a - 0.05 * b) for a in range(3) for b in range(3)]


#: Weights that stand for a caller's; they have no meaning of their own.
MODEL = significance.PairModel(
    by_thickness=[[[0.1, -0.2], [0.03, 0.05], [0.1, -0.05], [-0.02, 0.04], [0.08, 0.02]], [[0.2], [0.5], [-0.3]]],
    by_lambda=[[[0.05, 0.1, -0.1], [0.2, -0.3, 0.1], [0.05, 0.02, -0.04], [0.03, -0.01, 0.06]], [[0.3, 0.05], [0.2, -0.1], [-0.4, 0.1], [0.1, 0.2]]],
    location=(0.9, 0.5), location_by_lambda=(1.1, -0.2), scale=(0.12, 0.3), scale_factor=0.7, location_share=0.6, scale_share=0.3,
)


def pair_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location, scale and expectation of pairs from thicknesses, lengths and lambda."""
    size, key = F.col("p_size"), F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        key.alias("id"), (1 + size / 5.0).alias("qn"), (50 + key % 400).cast("double").alias("ql"), (1 + (key % 37) / 3.0).alias("sn"),
        (40 + size * 7).cast("double").alias("sl"), (0.2 + (size % 10) / 10.0).alias("lam"), (F.col("p_retailprice") % 97).alias("score"), (0.001 * (size + 1)).alias("k"),
    )
    law = MODEL.law(F.col("qn"), F.col("ql"), F.col("sn"), F.col("sl"), F.col("lam"))
    e = significance.over_space(significance.expectation(F.col("score"), law, F.col("k"), 0.02), F.col("ql"), F.col("sl"), F.lit(1e6))
    return p.select("id", r6(law[0]).alias("location"), r6(law[1]).alias("scale"), r6(F.log10(e)).alias("log_evalue"))


def _network_sql(inputs: list[str], weights: significance.Weights) -> list[str]:
    now = inputs
    for k, w in enumerate(weights):
        now = ["(" + " + ".join([repr(float(w[0][j])), *(f"{w[i + 1][j]!r} * {x}" for i, x in enumerate(now))]) + ")" for j in range(len(w[0]))]
        now = [f"(2.0 / (1 + exp(-{x})) - 1)" for x in now] if k < len(weights) - 1 else now
    return now


PAIR_EXPECTATIONS = f"""
WITH p AS (SELECT p_partkey AS id, 1 + p_size / 5.0 AS qn, (50 + p_partkey % 400)::DOUBLE AS ql, 1 + (p_partkey % 37) / 3.0 AS sn, (40 + p_size * 7)::DOUBLE AS sl,
  0.2 + (p_size % 10) / 10.0 AS lam, p_retailprice % 97 AS score, 0.001 * (p_size + 1) AS k FROM part),
o AS (SELECT *, CASE WHEN qn > sn OR (qn = sn AND ql >= sl) THEN [qn, ln(ql), sn, ln(sl)] ELSE [sn, ln(sl), qn, ln(ql)] END AS t, [lam, ln(greatest(ql, sl)), ln(least(ql, sl))] AS u FROM p),
n AS (SELECT *, greatest(3.0, 30 * {_network_sql(['t[1]', 't[2]', 't[3]', 't[4]'], MODEL.by_thickness)[0]}) AS me,
  greatest(3.0, 30 * {_network_sql(['u[1]', 'u[2]', 'u[3]'], MODEL.by_lambda)[0]}) AS ml, {_network_sql(['u[1]', 'u[2]', 'u[3]'], MODEL.by_lambda)[1]} AS s0, 0.1 * least(10.0, 1 / lam) AS inv FROM o),
b AS (SELECT *, least(5.0, greatest(0.1, 0.12 * me + 0.3)) AS se, least(5.0, greatest(0.1, 0.7 * (exp(greatest(0.1, 5 * s0)) - 1))) AS sr, 0.6 * (1 - inv) AS a, 0.3 + 0.7 * inv AS i FROM n),
l AS (SELECT *, a * (0.9 * me + 0.5) + (1 - a) * (1.1 * ml - 0.2) AS mu, (1 - i) * se + i * sr AS scale FROM b)
SELECT id, {sql6("mu")} AS location, {sql6("scale")} AS scale,
  {sql6("log10(CASE WHEN k > 0.02 AND k < 1 THEN k / 0.02 ELSE 1 END * exp((mu - score) / scale) * 1e6 / (ql * sl))")} AS log_evalue FROM l"""


#: Levels of effective sequences, probabilities of clusters and of states; one pair of levels has no table of its own.
E_LEVELS, P_LEVELS, CLUSTERS = (3, 6), (0.1, 0.5), 5


def _level_rows() -> list[tuple]:
    pairs_ = lambda x: [(a, b) for a in x for b in x if a <= b]
    rows = [
        (float(e), float(f), p, q, 0.0, 0.0, i, j, None if (i, j) == (4, 1) else 0.1 * i - 0.2 * j + 0.01 * e * f + p - q)
        for e, f in pairs_(E_LEVELS) for p, q in pairs_(P_LEVELS) for i in range(CLUSTERS) for j in range(i + 1)
    ]
    return [r for r in rows if r[:4] != (6.0, 6.0, 0.1, 0.5)]


def level_table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables by levels, written as a set of files' texts and read again, looked up for pairs of clusters."""
    texts = [(f"{e:g}{f:g}", text) for (e, f), text in tables.render_levels(_level_rows()).items()]
    known = tables.parsed(spark.createDataFrame(texts, "path string, value string"), tables.parse_levels, tables.LEVEL_TABLE)
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    rows = p.select(
        key.alias("id"), (size % CLUSTERS).alias("key1"), (key % CLUSTERS).alias("key2"), (size / 5.0).alias("e1"), (key % 17).cast("double").alias("e2"),
        (size / 50.0).alias("p1"), ((key % 10) / 10.0).alias("p2"), F.lit(0.4).alias("s1"), F.lit(0.9).alias("s2"),
    )
    return levels.level_scores(rows, known).select("id", r6("score").alias("score"))


def _level_bin(value: str, of: tuple[float, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {x} THEN {x}" for x in reversed(of)) + " END"


LEVEL_LOOKUP = f"""
WITH e(lo, hi) AS (VALUES (3, 3), (3, 6), (6, 6)), p(lo, hi) AS (VALUES (0.1, 0.1), (0.1, 0.5), (0.5, 0.5)),
t AS (SELECT e.lo AS e1, e.hi AS e2, p.lo AS p1, p.hi AS p2 FROM e, p WHERE NOT (e.lo = 6 AND p.lo = 0.1 AND p.hi = 0.5)),
x AS (SELECT p_partkey AS id, p_size % {CLUSTERS} AS k1, p_partkey % {CLUSTERS} AS k2, p_size / 5.0 AS e1, p_partkey % 17 AS e2, p_size / 50.0 AS p1, (p_partkey % 10) / 10.0 AS p2 FROM part),
b AS (SELECT id, greatest(k1, k2) AS i, least(k1, k2) AS j, {_level_bin('least(e1, e2)', E_LEVELS)} AS e1, {_level_bin('greatest(e1, e2)', E_LEVELS)} AS e2,
  {_level_bin('least(p1, p2)', P_LEVELS)} AS p1, {_level_bin('greatest(p1, p2)', P_LEVELS)} AS p2 FROM x),
c AS (SELECT b.id, b.i, b.j, max({{'a': t.e1, 'b': t.e2, 'c': t.p1, 'd': t.p2}}) AS t FROM b LEFT JOIN t ON t.e1 <= b.e1 AND t.e2 <= b.e2 AND t.p1 <= b.p1 AND t.p2 <= b.p2 GROUP BY 1, 2, 3)
SELECT id, {sql6("CASE WHEN t.a IS NULL OR (i = 4 AND j = 1) THEN 0 ELSE 0.1 * i - 0.2 * j + 0.01 * t.a * t.b + t.c - t.d END::DOUBLE")} AS score FROM c"""


def state_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected scores over three states, with a whole table and with one that lacks a cell.

    Every fifth pair is sure of its states, gives the missing cell no weight and so keeps its score; the others' is 0.
    """
    known = spark.createDataFrame(STATES, "a int, b int, score double")
    full = known.withColumn("score", F.coalesce("score", F.lit(0.2)))
    three = lambda c: F.transform(F.slice(c, 1, 3), lambda x: x / V.total(F.slice(c, 1, 3)))
    sure = F.array(*map(F.lit, (1.0, 0.0, 0.0)))
    own = lambda c: F.when(F.col("id") % 5 == 0, sure).otherwise(three(F.col(c)))
    rows = pairs(spark, sf_dir).select("id", own("q").alias("q"), own("s").alias("s"))
    return scoring.state_score(rows, full, 2.0).select("id", r6("score").alias("score")).join(
        scoring.state_score(rows, known, 2.0).select("id", r6("score").alias("gap")), "id"
    )


_STATES = ", ".join(f"({a}, {b}, {0.2 if s is None else s!r})" for a, b, s in STATES)
STATE = f"""WITH {PAIRS}, k(a, b, s) AS (VALUES {_STATES}), o AS (SELECT id, CASE WHEN id % 5 = 0 THEN [1.0, 0.0, 0.0] ELSE list_transform(q[1:3], lambda v: v / list_sum(q[1:3])) END AS q,
  CASE WHEN id % 5 = 0 THEN [1.0, 0.0, 0.0] ELSE list_transform(s[1:3], lambda v: v / list_sum(s[1:3])) END AS s FROM p),
j AS (SELECT id, sum(q[a + 1] * o.s[b + 1] * k.s) AS t, max((q[3] + 0.1) * (o.s[3] + 0.1) / 9.0) AS bonus FROM o, k GROUP BY id)
SELECT id, {sql6("2.0 * (t + bonus - 0.05)")} AS score, CASE WHEN id % 5 = 0 THEN {sql6("2.0 * (t + bonus - 0.05)")} ELSE 0.0 END AS gap FROM j"""


def context_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-odds of two context vectors, both of length 1."""
    unit = lambda c: V.scaled(c, 1 / V.norm2(c))
    p = pairs(spark, sf_dir).select("id", unit(F.col("qx")).alias("q"), unit(F.col("sx")).alias("s"))
    score = scoring.context_score(F.col("q"), F.col("s"), V.dot(F.col("q"), F.col("q")), V.dot(F.col("s"), F.col("s")), F.lit(0.3), F.lit(0.4), 0.1, 2.0, -3.5)
    return p.select("id", r6(score).alias("score"))


CONTEXT = f"""WITH {PAIRS}, n AS (SELECT id, list_dot_product(qx, sx) / sqrt(list_dot_product(qx, qx) * list_dot_product(sx, sx)) AS c FROM p)
SELECT id, {sql6("2.0 - 3.5 * ln(2.1 * 2.1 - (c + 0.1) * (c + 0.1)) - 0.7")} AS score FROM n"""


def masked_position_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of positions with little information scaled down, with the threshold of the second pass."""
    info = lambda c: V.total(F.transform(c, lambda x: x * F.ln(x * F.size(c))))
    p = pairs(spark, sf_dir).select("id", V.dot(F.col("qx"), F.col("sx")).alias("score"), info(F.col("q")).alias("qi"), info(F.col("s")).alias("si"))
    p = p.withColumn("e", F.exp(-(F.col("id") % 40).cast("double")))
    threshold = scoring.information_threshold(F.col("e"), 0.17, 4.4, 4.0, 1.0, 3.0)
    score, counted = scoring.masked_score(F.col("score"), F.col("qi"), F.col("si"), 0.0075, 0.5, "ignore")
    return p.select("id", r6(score).alias("score"), counted.alias("counted"), r6(threshold).alias("threshold"))


MASKED = f"""WITH {PAIRS}, o AS (SELECT id, list_dot_product(qx, sx) AS score, {_sum("q[i] * ln(q[i] * len(q))")} AS qi, {_sum("s[i] * ln(s[i] * len(q))")} AS si, -(id % 40)::DOUBLE AS v FROM p),
n AS (SELECT *, greatest(0.17 + 4.4 / (v - 4.0), CASE WHEN v + 3.0 = 0 THEN NULL ELSE -1.0 / (v + 3.0) END) AS new, qi < 0.0075 OR si < 0.0075 AS low FROM o)
SELECT id, {sql6("CASE WHEN low THEN score * 0.5 ELSE score END")} AS score, NOT low AS counted,
  {sql6("CASE WHEN v < -3.0 AND new >= 0 THEN least(new, 0.17) ELSE 0.17 END")} AS threshold FROM n"""


def repaired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of frequencies of which every second has none: what stands in for it, by residue."""
    residue = (F.col("p_size") % 23).cast("int")
    none = F.array_repeat(F.lit(0.0005), 20)
    some = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.when(i == F.col("p_size") % 20, 0.7).otherwise(0.0))
    rows = table(spark, sf_dir, "part").select("p_partkey", residue.alias("residue"), F.when(F.col("p_partkey") % 2 == 0, none).otherwise(some).alias("f"))
    out = rows.select("p_partkey", F.posexplode(scoring.repaired(F.col("f"), F.col("residue"))).alias("k", "x")).where("x > 0")
    return out.select("p_partkey", F.col("k").cast("long").alias("k"), r6("x").alias("x"))


def _shares(a: int, b: int) -> str:
    part = {k: round(100 * A.BACKGROUND[k] / (A.BACKGROUND[a] + A.BACKGROUND[b])) / 100 for k in (a, b)}
    return ", ".join(f"({k}, {x!r})" for k, x in part.items())


REPAIRED = f"""
WITH o AS (SELECT p_partkey, p_size % 23 AS residue, p_partkey % 2 = 0 AS bare, p_size % 20 AS own FROM part),
bg(k, x) AS (VALUES {", ".join(f"({k}, {x!r})" for k, x in enumerate(A.BACKGROUND))}), b(k, x) AS (VALUES {_shares(A.N, A.D)}), z(k, x) AS (VALUES {_shares(A.Q, A.E)})
SELECT p_partkey, k::BIGINT AS k, {sql6("x")} AS x FROM (
SELECT p_partkey, own AS k, 0.7 AS x FROM o WHERE NOT bare
UNION ALL SELECT p_partkey, residue, 1.0 FROM o WHERE bare AND residue < 20
UNION ALL SELECT p_partkey, k, x FROM o, bg WHERE bare AND residue = {A.X}
UNION ALL SELECT p_partkey, k, x FROM o, b WHERE bare AND residue = {A.B}
UNION ALL SELECT p_partkey, k, x FROM o, z WHERE bare AND residue = {A.Z})"""


def diagonal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ungapped hits on a diagonal, over a grid of 50 by 10 cells for each id."""
    v = vectors(spark, sf_dir).where("x is not null")
    row = F.floor(F.col("vec_id") / 50).cast("long")
    cells = v.select(F.floor(row / 10).cast("long").alias("id"), (F.col("vec_id") % 50).alias("q"), (row % 10).alias("s"), F.rint(F.element_at("x", 1) * 20).alias("score"))
    return scoring.diagonal_hits(cells, 1.0, 2, 3).select("id", "diagonal", "first_end", "second_end", "score")


DIAGONAL_PAIRS = f"""
WITH {VECTORS}, c AS (SELECT vec_id // 500 AS id, vec_id % 50 AS q, vec_id // 50 % 10 AS s, round_even(x[1] * 20, 0) AS score FROM v WHERE x IS NOT NULL),
h AS (SELECT a.id, a.q - a.s AS diagonal, a.q, a.score + b.score AS score FROM c a JOIN (SELECT *, lead(q) OVER (PARTITION BY id, q - s ORDER BY q) AS after FROM c) b
      ON a.id = b.id AND a.q - a.s = b.q - b.s AND a.q = b.after WHERE a.score + b.score >= 1),
j AS (SELECT h.id, h.diagonal, f.q AS first_end, h.q AS second_end, h.score + f.score AS score, row_number() OVER (PARTITION BY h.id, h.diagonal, h.q ORDER BY f.q DESC) AS n
      FROM h JOIN h f ON f.id = h.id AND f.diagonal = h.diagonal AND f.q BETWEEN h.q - 5 AND h.q - 2)
SELECT id, diagonal, first_end, second_end, score FROM j WHERE n = 1"""

#: Reference values of the derived parameters.
REFERENCE = {"lambda": 1.116276, "k": 0.115812, "gapped_lambda": 0.561132, "gapped_k": 0.001488}


def second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second pass makes of scores and expectations: shifts, corrections, derived parameters, mean lengths."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50 - 20).cast("double").alias("score"), F.exp(-(F.col("o_custkey") % 35).cast("double")).alias("e"))
    lam, k = statistics.derived_gapped(0.2 + (F.col("o_orderkey") % 9) / 10.0, 0.05 + (F.col("o_orderkey") % 4) / 50.0, REFERENCE)
    return o.select(
        "o_orderkey", r6(scoring.transformed_scores(F.col("score"), 1.3, 0.3)).alias("shifted"), r6(scoring.autocorrelation_correction(F.col("e"), 0.9, 4.0, 0.5, 0.3)).alias("correction"),
        r6(lam).alias("gapped_lambda"), r6(k).alias("gapped_k"), r6(statistics.mean_length(F.col("e") - 1e-9, 0.1, 0.2, F.col("score") * 1000)).alias("length"),
    )


_TOP = 0.9 / math.sqrt(0.3)
SECOND = f"""
WITH o AS (SELECT o_orderkey, (o_custkey % 50 - 20)::DOUBLE AS score, -(o_custkey % 35)::DOUBLE AS v FROM orders),
n AS (SELECT *, exp(v) - 1e-9 AS e, score * 1000 AS space FROM o)
SELECT o_orderkey, {sql6("score - 2 * ln(1.3) / 0.3")} AS shifted, {sql6(f"CASE WHEN v <= -4.0 - 1 / (0.5 * {_TOP!r}) THEN least({_TOP!r}, -1 / ((v + 4.0) * 0.5)) ELSE {_TOP!r} END")} AS correction,
  {sql6("(0.2 + (o_orderkey % 9) / 10.0) * 0.561132 / 1.116276")} AS gapped_lambda, {sql6("(0.05 + (o_orderkey % 4) / 50.0) * 0.001488 / 0.115812")} AS gapped_k,
  {sql6("CASE WHEN e < 0 THEN 0 WHEN e = 0 OR space <= 0 THEN 100000 ELSE ln(0.1 * space / e) / 0.2 END")} AS length FROM n"""

POWERS = [1.0, 0.5, 2.0, 1.5, 0.0, 3.0, 0.25, 1.0, 2.0]


def powered_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine moves to powers of their own; moves that do not occur stay 0."""
    p = pairs(spark, sf_dir)
    moves = F.transform(F.slice("q", 1, 9), lambda x, i: F.when((F.col("id") + i) % 4 == 0, 0.0).otherwise(x))
    out = p.select("id", F.posexplode(scoring.powered_moves(moves, POWERS)).alias("k", "x"))
    return out.select("id", F.col("k").cast("long").alias("k"), r6("x").alias("x"))


POWERED = f"""WITH {PAIRS}, o AS (SELECT id, k, CASE WHEN (id + k) % 4 = 0 THEN 0 ELSE q[k + 1] END AS x, {POWERS}[k + 1] AS e FROM p, (SELECT unnest(range(9)) AS k))
SELECT id, k, {sql6("CASE WHEN x > 0 THEN x ** e ELSE 0 END")} AS x FROM o"""


def mixture_evalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expectations over bins of profile pairs, averaged by the pairs' probabilities."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("id"), *((F.col("o_orderkey") % m).alias(c) for c, m in (("e1", 2), ("l1", 3), ("e2", 2), ("l2", 5))), F.col("o_totalprice").alias("evalue"))
    grid = [(a, b, c, d, 1.0 + a + 2 * b + 3 * d) for a in range(2) for b in range(3) for c in range(2) for d in range(4)]
    known = spark.createDataFrame(grid, "e1 long, l1 long, e2 long, l2 long, prob double")
    return scoring.mixture_expectation(o, known).select("id", r6("evalue").alias("evalue"))


MIXTURE = f"""
WITH o AS (SELECT o_custkey % 100 AS id, o_orderkey % 2 AS a, o_orderkey % 3 AS b, o_orderkey % 5 AS d, o_totalprice AS x FROM orders WHERE o_orderkey % 5 < 4)
SELECT id, {sql6("sum(x * (1 + a + 2 * b + 3 * d)) / sum(1 + a + 2 * b + 3 * d)")} AS evalue FROM o GROUP BY id"""


def vector_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norm, product, superposition and context weights of a vector and its successor."""
    weights = V.geometric_weights(2, 0.4)
    p = pairs(spark, sf_dir)
    mixed = V.superposed(F.col("qx"), F.col("sx"), F.lit(-0.5))
    near = F.aggregate(F.zip_with(F.slice("qx", 1, 5), F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return p.select(
        "id", r6(V.norm2(F.col("qx"))).alias("norm"), r6(V.dot(F.col("qx"), F.col("sx"))).alias("product"), r6(V.total(mixed)).alias("mixed"), r6(near).alias("context"),
        r6(V.total(V.unlogit(V.logit(F.col("q"))))).alias("whole"),
    )


#: The ratio of geometric weights 0.4 * r^|k|, k from -2 to 2, that sum to 1: r + r^2 = 0.75, so r = 0.5.
VECTOR_OPERATIONS = f"""WITH {PAIRS} SELECT id, {sql6("sqrt(list_dot_product(qx, qx))")} AS norm, {sql6("list_dot_product(qx, sx)")} AS product,
  {sql6("list_sum(qx) - 0.5 * list_sum(sx)")} AS mixed, {sql6("0.1 * qx[1] + 0.2 * qx[2] + 0.4 * qx[3] + 0.2 * qx[4] + 0.1 * qx[5]")} AS context, 1.0 AS whole FROM p"""


def thick_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as profiles: their events are positions, the kinds of them sequences."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("length"), F.count_distinct("event_type").alias("sequences"))
    return profiles.thick_enough(users, "sequences")


def profile_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of users against the same with some positions gone and some changed."""
    one = series(spark, sf_dir).select("id", "pos", F.col("symbol").alias("residue"))
    changed = F.when((F.col("id") % 7 == 1) & (F.col("pos") == 2), F.lit(EVENT_TYPES[0])).otherwise(F.col("residue"))
    other = one.where("id % 11 <> 3 and not (id % 5 = 0 and pos = 1)").withColumn("residue", changed)
    return profiles.incompatibilities(one, other)


COMPATIBILITY = f"""WITH {SERIES}, o AS (SELECT id, pos, CASE WHEN id % 7 = 1 AND pos = 2 THEN '{EVENT_TYPES[0]}' ELSE symbol END AS symbol FROM s WHERE id % 11 <> 3 AND NOT (id % 5 = 0 AND pos = 1)),
n AS (SELECT id, count(*) AS a, coalesce(any_value(b), 0) AS b FROM s LEFT JOIN (SELECT id, count(*) AS b FROM o GROUP BY id) USING (id) GROUP BY id),
d AS (SELECT DISTINCT s.id FROM s JOIN o USING (id, pos) WHERE s.symbol <> o.symbol)
SELECT id, CASE WHEN b = 0 THEN 'missing' WHEN a <> b THEN 'length' ELSE 'residue' END AS reason FROM n WHERE a <> b OR id IN (SELECT id FROM d)"""


def profile_scores_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty vectors as a profile, their first twenty components as scores of letters."""
    v = vectors(spark, sf_dir).where("x is not null")
    rows = v.select(F.floor(F.col("vec_id") / 50).alias("id"), F.transform(F.slice("x", 1, 20), lambda x: F.rint(x * 10)).alias("scores"))
    return profiles.profile_score_distribution(rows, A.BACKGROUND[:20]).select("id", "score", r6("p").alias("p"))


_LETTERS = ", ".join(f"({k + 1}, {x!r})" for k, x in enumerate(A.BACKGROUND[:20]))
PROFILE_SCORES = f"""WITH {VECTORS}, b(k, b) AS (VALUES {_LETTERS}), n AS (SELECT vec_id // 50 AS id, count(*) AS n FROM v WHERE x IS NOT NULL GROUP BY 1)
SELECT id, round_even(x[k] * 10, 0)::BIGINT AS score, {sql6("sum(b) / any_value(n)")} AS p FROM v JOIN n ON id = vec_id // 50 CROSS JOIN b WHERE x IS NOT NULL AND b > 0 GROUP BY 1, 2"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = V.dot(F.col("qx"), F.col("sx")) * 20
    return pairs(spark, sf_dir).select(F.floor(F.col("id") / 50).alias("id"), F.round(score, 6).alias("score"), (F.col("ql") + 1.0).alias("pq"), (F.col("sl") + 1.0).alias("ps"))


CELLS = f"{PAIRS}, c AS (SELECT id // 50 AS id, round(20 * list_dot_product(qx, sx), 6) AS score, (ql + 1.0) * (sl + 1.0) AS w FROM p)"


def weighted_scores_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumn("score", F.rint("score").cast("long"))
    return profiles.weighted_score_distribution(cells).select("id", "score", r6("p").alias("p"))


WEIGHTED = f"WITH {CELLS} SELECT id, round_even(score, 0)::BIGINT AS score, {sql6('sum(w) / any_value(t)')} AS p FROM c JOIN (SELECT id, sum(w) AS t FROM c GROUP BY id) USING (id) GROUP BY 1, 2"


def cell_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profiles.cell_statistics(_cells(spark, sf_dir), 0.25)
    return out.select("id", r6("expected").alias("expected"), r6("entropy").alias("entropy"))


CELL_ENTROPY = f"WITH {CELLS} SELECT id, {sql6('sum(score * w) / sum(w)')} AS expected, {sql6('0.25 * sum(score * w * exp(0.25 * score)) / sum(w)')} AS entropy FROM c GROUP BY id"


QUERIES = {
    f.__name__: f
    for f in (
        lso_position_scores, profile_position_scores, cluster_scores, pair_expectations, level_table_lookup, state_scores, context_scores, masked_position_scores, repaired_rows, diagonal_pairs,
        second_pass, powered_transitions, mixture_evalues, vector_operations, thick_profiles, profile_compatibility, profile_scores_distribution,
        weighted_scores_distribution, cell_entropy,
    )
}
ORACLES = {
    "lso_position_scores": LSO,
    "profile_position_scores": PROFILE,
    "cluster_scores": CLUSTER,
    "pair_expectations": PAIR_EXPECTATIONS,
    "level_table_lookup": LEVEL_LOOKUP,
    "state_scores": STATE,
    "context_scores": CONTEXT,
    "masked_position_scores": MASKED,
    "repaired_rows": REPAIRED,
    "diagonal_pairs": DIAGONAL_PAIRS,
    "second_pass": SECOND,
    "powered_transitions": POWERED,
    "mixture_evalues": MIXTURE,
    "vector_operations": VECTOR_OPERATIONS,
    "thick_profiles": "SELECT user_id, count(*) AS length, count(DISTINCT event_type) AS sequences FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 3",
    "profile_compatibility": COMPATIBILITY,
    "profile_scores_distribution": PROFILE_SCORES,
    "weighted_scores_distribution": WEIGHTED,
    "cell_entropy": CELL_ENTROPY,
}
