"""Queries over series and plain tables: entropy, segments, bins, lookups, sets, ranks, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import align, database, seg
from tessella.plans._common import EVENT_TYPES, SERIES, r6, series, sql6, table
from tessella.streaming import incremental

WINDOW, LOW, HIGH = 8, 1.2, 1.6


def _entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.window_entropy(series(spark, sf_dir), WINDOW, EVENT_TYPES)


def window_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entropies(spark, sf_dir).select("id", "pos", r6("entropy").alias("entropy"))


_COUNTS = ", ".join(f"sum((symbol = '{t}')::INT) OVER w AS n{i}" for i, t in enumerate(EVENT_TYPES))
_BITS = " + ".join(f"CASE WHEN n{i} > 0 THEN -(n{i} / {float(WINDOW)}) * log2(n{i} / {float(WINDOW)}) ELSE 0 END" for i in range(len(EVENT_TYPES)))
ENTROPY = (
    f"{SERIES}, n AS (SELECT id, pos, symbol, {_COUNTS} FROM s WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN {(WINDOW - 1) // 2} PRECEDING AND {WINDOW // 2} FOLLOWING)), "
    f"e AS (SELECT id, pos, symbol, CASE WHEN {' + '.join(f'n{i}' for i in range(len(EVENT_TYPES)))} = {WINDOW} THEN {_BITS} END AS entropy FROM n)"
)


def low_complexity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.segments(_entropies(spark, sf_dir), WINDOW, LOW, HIGH)


def high_complexity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.segments(_entropies(spark, sf_dir), WINDOW, 2.2, 2.1, high=True)


def _islands(trigger: str, inside: str) -> str:
    return f"""{ENTROPY}, r AS (SELECT *, coalesce({inside}, false) AS i, sum(CASE WHEN coalesce({inside}, false) THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY pos) AS run FROM e),
g AS (SELECT id, min(pos) - {(WINDOW - 1) // 2} AS l, max(pos) + {WINDOW // 2} AS r FROM r WHERE i GROUP BY id, run HAVING sum(({trigger})::INT) > 0),
b AS (SELECT *, CASE WHEN max(r) OVER (PARTITION BY id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= l THEN 0 ELSE 1 END AS b FROM g),
n AS (SELECT *, sum(b) OVER (PARTITION BY id ORDER BY l, r) AS island FROM b),
sg AS (SELECT id, min(l)::BIGINT AS "left", max(r)::BIGINT AS "right" FROM n GROUP BY id, island)"""


def _sql_islands(trigger: str, inside: str) -> str:
    return _islands(trigger, inside).replace("n AS (SELECT *, sum(b)", "nn AS (SELECT *, sum(b)").replace("FROM n GROUP BY id, island", "FROM nn GROUP BY id, island")


def mask_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = low_complexity_segments(spark, sf_dir)
    return seg.masked(series(spark, sf_dir), found).select("id", "pos", "symbol", "masked")


def segment_logprob_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seg.optimised(series(spark, sf_dir), low_complexity_segments(spark, sf_dir), len(EVENT_TYPES), 10)
    return out.withColumn("log_probability", r6("log_probability"))


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event covers as many positions as its value's tenth; intervals of a user that meet become one."""
    s = series(spark, sf_dir)
    spans = s.select("id", F.col("pos").alias("left"), (F.col("pos") + F.floor(F.col("value") / 20)).alias("right"))
    return seg.merged(spans)


MERGE = f"""
WITH {SERIES}, g AS (SELECT id, pos AS l, pos + floor(value / 20)::BIGINT AS r FROM s),
b AS (SELECT *, CASE WHEN max(r) OVER (PARTITION BY id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= l THEN 0 ELSE 1 END AS b FROM g),
n AS (SELECT *, sum(b) OVER (PARTITION BY id ORDER BY l, r) AS island FROM b)
SELECT id, min(l) AS "left", max(r) AS "right" FROM n GROUP BY id, island"""


def autocorrelation_gapcost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap costs from windows of four standardised values."""
    s = series(spark, sf_dir)
    centred = s.withColumn("v", F.col("value") - F.avg("value").over(Window.partitionBy("id")))
    frame = Window.partitionBy("id").orderBy("pos").rowsBetween(-1, 2)
    near = centred.withColumn("near", F.collect_list("v").over(frame)).where(F.size("near") == 4)
    return near.select("id", "pos", r6(align.gap_cost(F.col("near"))).alias("cost"))


def _gap_mean(size: int) -> str:
    """The mean product of a window of ``size`` values in the list ``w``."""
    terms = []
    for width in range(size, 0, -1):
        begin = (size - width + (size % 2)) // 2
        mid = width // 2 - (width % 2 == 0)
        for i in range(begin, begin + width):
            j = i + mid
            j = j - width if j >= width else j
            terms.append(f"w[{i + 1}] * w[{j + 1}]")
    return f"({' + '.join(terms)}) / {size * (size + 1) / 2}"


def _gap_sql() -> str:
    return f"""
WITH {SERIES}, v AS (SELECT id, pos, value - avg(value) OVER (PARTITION BY id) AS v FROM s),
w AS (SELECT id, pos, list(v) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS w FROM v),
t AS (SELECT id, pos, {_gap_mean(4)} AS m FROM w WHERE len(w) = 4)
SELECT id, pos, {sql6("CASE WHEN m > 0 THEN -sqrt(m) ELSE 0 END")} AS cost FROM t"""


WIDE = 8


def gap_cost_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap costs of every position from windows of eight standardised values, without those that hold an error."""
    s = series(spark, sf_dir)
    centred = s.select("id", "pos", (F.col("value") - F.avg("value").over(Window.partitionBy("id"))).alias("score"), (F.col("symbol") == "error").alias("masked"))
    return align.position_gap_costs(centred, WIDE).withColumn("cost", r6("cost"))


def _gap_windows_sql() -> str:
    short = " ".join(f"WHEN n = {n} AND k = {(n >> 1) - (n % 2 == 0)} AND len(w) = {n} THEN {_gap_mean(n)}" for n in range(1, WIDE))
    half = (WIDE >> 1) - (WIDE % 2 == 0)
    return f"""
WITH {SERIES}, v AS (SELECT id, pos, value - avg(value) OVER (PARTITION BY id) AS v, (symbol = 'error')::INT AS e, count(*) OVER (PARTITION BY id) AS n,
  row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS k FROM s),
w AS (SELECT *, CASE WHEN n < {WIDE} THEN list(v) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN {WIDE} PRECEDING AND {WIDE} FOLLOWING)
    ELSE list(v) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN {half} PRECEDING AND {WIDE - 1 - half} FOLLOWING) END AS w,
  CASE WHEN n < {WIDE} THEN max(e) OVER (PARTITION BY id) ELSE max(e) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN {half} PRECEDING AND {WIDE - 1 - half} FOLLOWING) END AS e2 FROM v),
m AS (SELECT id, pos, CASE WHEN e2 = 1 THEN NULL {short} WHEN n >= {WIDE} AND len(w) = {WIDE} THEN {_gap_mean(WIDE)} END AS m FROM w),
c AS (SELECT id, pos, CASE WHEN m > 0 THEN -sqrt(m) WHEN m IS NOT NULL THEN 0 END AS c FROM m),
f AS (SELECT id, pos, last_value(c IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
  first_value(c IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM c)
SELECT id, pos, {sql6("coalesce(b, a, 0)")} AS cost FROM f"""


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg((F.count_distinct(F.dayofmonth("ts")) / 2.0).alias("effective"), (F.count("*") * 5).alias("length"))


USERS = "us AS (SELECT user_id, count(DISTINCT day(ts)) / 2.0 AS effective, count(*) * 5 AS length FROM events GROUP BY user_id)"


def _bin_sql(value: str, levels: tuple[int, ...]) -> str:
    cases = " ".join(f"WHEN {value} < {(a + b) / 2} THEN {a}" for a, b in zip(levels, levels[1:], strict=False))
    return f"CASE {cases} ELSE {levels[-1]} END"


BINS = (
    f"{USERS}, b AS (SELECT {_bin_sql('effective', database.EFFECTIVE_LEVELS)} AS e, {_bin_sql('length', database.LENGTH_LEVELS)} AS l FROM us), "
    "n AS (SELECT e, l, count(*) AS n, count(*) / (SELECT count(*) FROM b) AS p FROM b GROUP BY e, l)"
)


def profile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database.profile_bins(_users(spark, sf_dir), "effective", "length").select("e", "l", "n", r6("p").alias("p"))


def profile_pair_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = database.pair_probabilities(database.profile_bins(_users(spark, sf_dir), "effective", "length"))
    return database.checked(out, "prob").withColumn("prob", r6("prob"))


def score_table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's score from a table by quantity and discount level: the highest level not above the value; 0 below the lowest.

    The table has one row for each level of quantity and discount, so it is
    broadcast; a missing cell counts as 0.
    """
    lines = table(spark, sf_dir, "lineitem")
    levels = [(q, d, None if (q, d) == (21, 4) else q * 10.0 + d) for q in range(1, 51, 10) for d in range(0, 11, 2)]
    scores = spark.createDataFrame(levels, "qlevel int, dlevel int, score double")
    q, d = F.col("l_quantity"), F.rint(F.col("l_discount") * 100)
    at = lines.select("l_orderkey", "l_linenumber", "l_partkey", q.alias("q"), d.alias("d"))
    near = at.withColumn("qlevel", (F.floor((F.col("q") - 1) / 10) * 10 + 1).cast("int")).withColumn("dlevel", (F.floor(F.col("d") / 2) * 2).cast("int"))
    found = near.join(F.broadcast(scores), ["qlevel", "dlevel"], "left")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("score", F.lit(0.0)).alias("score"))


LOOKUP = """
WITH t AS (SELECT q, d, CASE WHEN q = 21 AND d = 4 THEN NULL ELSE q * 10.0 + d END AS score FROM range(1, 51, 10) AS a(q), range(0, 11, 2) AS b(d)),
l AS (SELECT *, round_even(l_discount * 100, 0) AS dv FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce((SELECT max_by(score, (q, d)) FROM t WHERE q <= l_quantity AND d <= dv AND q > l_quantity - 10 AND d > dv - 2), 0.0)::DOUBLE AS score FROM l"""


def union_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    return database.concatenated(c, s)


def dedupe_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_profiles(spark, sf_dir).select("kind", "nation").distinct()


def shared_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with customers and suppliers, and those with customers alone."""
    u = union_profiles(spark, sf_dir)
    c, s = (u.where(F.col("kind") == k).select("nation") for k in ("customer", "supplier"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.exceptAll(s).distinct().join(s, "nation", "left_anti").withColumn("side", F.lit("customer")))


def topk_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most expensive orders of each customer; ties by key."""
    o = table(spark, sf_dir, "orders")
    return database.ranked(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "rank", "o_orderkey", "o_totalprice")


def order_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by region and priority: filter, joins and a sum over the plain tables."""
    line, order, cust, nation, region = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    taken = line.where("l_returnflag <> 'R'").join(order, line.l_orderkey == order.o_orderkey).join(cust, order.o_custkey == cust.c_custkey)
    named = taken.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey).join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    cents = F.rint(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")
    return named.groupBy("r_name", "o_orderpriority").agg(F.sum(cents).alias("cents"), F.count("*").alias("n"))


REVENUE = """
SELECT r_name, o_orderpriority, sum(round_even(l_extendedprice * (1 - l_discount) * 100, 0)::BIGINT)::BIGINT AS cents, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE l_returnflag <> 'R' GROUP BY 1, 2"""


def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream: counts and sums by day and type, from all files there are."""
    return incremental.event_totals(spark, f"{sf_dir}/events.parquet")


QUERIES = {
    f.__name__: f
    for f in (
        window_entropy, low_complexity_segments, high_complexity_segments, mask_segments, segment_logprob_min, interval_merge, autocorrelation_gapcost, gap_cost_windows,
        profile_bins, profile_pair_probs, score_table_lookup, union_profiles, dedupe_profiles, shared_nations, topk_generic, order_revenue, stream_event_counts,
    )
}
ORACLES = {
    "window_entropy": f"WITH {ENTROPY} SELECT id, pos, {sql6('entropy')} AS entropy FROM e",
    "low_complexity_segments": f'WITH {_sql_islands(f"entropy <= {LOW}", f"entropy <= {HIGH}")} SELECT * FROM sg',
    "high_complexity_segments": f'WITH {_sql_islands("entropy >= 2.2", "entropy >= 2.1")} SELECT * FROM sg',
    "mask_segments": f'WITH {_sql_islands(f"entropy <= {LOW}", f"entropy <= {HIGH}")} SELECT s.id, pos, CASE WHEN sg.id IS NULL THEN symbol ELSE \'X\' END AS symbol, sg.id IS NOT NULL AS masked FROM s LEFT JOIN sg ON sg.id = s.id AND pos BETWEEN "left" AND "right"',
    "interval_merge": MERGE,
    "autocorrelation_gapcost": _gap_sql(),
    "gap_cost_windows": _gap_windows_sql(),
    "profile_bins": f"WITH {BINS} SELECT e, l, n, {sql6('p')} AS p FROM n",
    "profile_pair_probs": f"WITH {BINS} SELECT a.e AS e1, a.l AS l1, b.e AS e2, b.l AS l2, {sql6('a.p * b.p * CASE WHEN a.e = b.e AND a.l = b.l THEN 1 ELSE 2 END')} AS prob FROM n a JOIN n b ON (a.e, a.l) >= (b.e, b.l)",
    "score_table_lookup": LOOKUP,
    "union_profiles": "SELECT 'customer' AS kind, c_custkey AS key, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier",
    "dedupe_profiles": "SELECT 'customer' AS kind, c_nationkey AS nation FROM customer UNION SELECT 'supplier', s_nationkey FROM supplier",
    "shared_nations": "SELECT nation, 'both' AS side FROM (SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT nation, 'customer' FROM (SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier)",
    "topk_generic": "SELECT * FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank, o_orderkey, o_totalprice FROM orders) WHERE rank <= 3",
    "order_revenue": REVENUE,
    "stream_event_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
