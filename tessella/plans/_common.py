"""Readers and helpers the catalogue's modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 6
#: Vectors of one profile: consecutive ids, 50 at a time.
PROFILE = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(x, DIGITS) + F.lit(0.0)


def sql6(x: str) -> str:
    return f"(round({x}, {DIGITS}) + 0.0)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, label, x)`` in doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(profile_id, pos, vec_id, x)``."""
    v = vectors(spark, sf_dir)
    return v.select(F.floor(F.col("vec_id") / PROFILE).alias("profile_id"), (F.col("vec_id") % PROFILE + 1).alias("pos"), "vec_id", "x")


VECTORS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"
POSITIONS = f"{VECTORS}, p AS (SELECT vec_id // {PROFILE} AS profile_id, vec_id % {PROFILE} + 1 AS pos, vec_id, x FROM v)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user in order: ``(id, pos, symbol, value)``."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select(F.col("user_id").alias("id"), pos.alias("pos"), F.col("event_type").alias("symbol"), "value")


SERIES = "s AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS symbol, value FROM events)"
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as rows of one alignment for each brand: ``(msa_id, seq_id, seq)``."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("msa_id"), F.col("p_partkey").alias("seq_id"), F.upper(F.translate("p_name", " ", "-")).alias("seq"))


CELLS = """q AS (SELECT p_brand AS msa_id, p_partkey AS seq_id, upper(replace(p_name, ' ', '-')) AS seq FROM part),
f AS (SELECT msa_id, seq_id, rpad(seq, max(length(seq)) OVER (PARTITION BY msa_id)::INT, '-') AS seq FROM q),
i AS (SELECT msa_id, seq_id, seq, unnest(range(1, length(seq) + 1)) AS pos FROM f),
c AS (SELECT msa_id, seq_id, pos::INT AS pos, CASE WHEN substr(seq, pos, 1) IN ('J', 'O', 'U') THEN 22 ELSE instr('ARNDCQEGHILKMFPSTWYVBZX*-', substr(seq, pos, 1)) - 1 END::INT AS code FROM i),
first AS (SELECT msa_id, min(seq_id) AS query FROM c GROUP BY msa_id),
m AS (SELECT c.msa_id, pos, code, row_number() OVER (PARTITION BY c.msa_id ORDER BY pos) AS state FROM c JOIN first ON first.msa_id = c.msa_id AND seq_id = query WHERE code < 22)"""
