"""Profile databases: distinct position vectors, their probabilities, profile statistics, set operations."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import special

#: Levels by which profiles are binned (effective sequences; length).
EFFECTIVE_LEVELS = (2, 4, 6, 8, 10, 12, 14)
LENGTH_LEVELS = (50, 100, 200, 400, 600, 800)


def distinct_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """``(key, n)``: different vectors and how often each occurs."""
    return vectors.groupBy(key).agg(F.count("*").alias("n"))


def discrete_probability(counts: DataFrame) -> DataFrame:
    """``p`` = n over the sum of n; the sum is a one-row aggregate, not a window over one partition."""
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_t")))).withColumn("p", F.col("n") / F.col("_t")).drop("_t")


def profile_log_probability(freqs: Column, background: list[float]) -> Column:
    """ln of prod P_a ** f_a."""
    logs = F.array(*(F.lit(math.log(p)) for p in background))
    return F.aggregate(F.zip_with(freqs, logs, lambda f, b: f * b), F.lit(0.0), lambda s, x: s + x)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x); Spark has no such function."""
    return special.column(math.lgamma, x)


def multinomial_log_probability(counts: pd.Series, background: list[float]) -> pd.Series:
    """ln of the multinomial probability of each array of counts."""
    logs = [math.log(p) for p in background]
    return counts.map(lambda c: math.lgamma(sum(c) + 1) - sum(math.lgamma(x + 1) for x in c) + sum(x * b for x, b in zip(c, logs, strict=True)))


def with_multinomial(vectors: DataFrame, counts: str, background: list[float]) -> DataFrame:
    """``vectors`` with ``log_p`` of the array of whole numbers in column ``counts``."""

    @F.pandas_udf("double")
    def log_p(c: pd.Series) -> pd.Series:
        return multinomial_log_probability(c, background)

    return vectors.withColumn("log_p", log_p(counts))


def normalised(table: DataFrame, p: str) -> DataFrame:
    """``p`` divided by its sum."""
    whole = table.agg(F.sum(p).alias("_t"))
    return table.crossJoin(F.broadcast(whole)).withColumn(p, F.col(p) / F.col("_t")).drop("_t")


def bin_of(value: Column, levels: tuple[int, ...]) -> Column:
    """The level nearest to a value, by midpoints between levels; a midpoint belongs to the upper one."""
    out = F.lit(levels[0])
    for low, high in zip(levels, levels[1:], strict=False):
        out = F.when(value >= (low + high) / 2, F.lit(high)).otherwise(out)
    return out


def profile_bins(profiles: DataFrame, effective: str, length: str) -> DataFrame:
    """``(e, l, n, p)``: how many profiles lie in each bin."""
    binned = profiles.select(bin_of(F.col(effective), EFFECTIVE_LEVELS).alias("e"), bin_of(F.col(length), LENGTH_LEVELS).alias("l"))
    return discrete_probability(binned.groupBy("e", "l").agg(F.count("*").alias("n")))


def pair_probabilities(bins: DataFrame) -> DataFrame:
    """Probability of each unordered pair of bins: p_i p_j, twice that off the diagonal.  At most 42 bins."""
    a = bins.select(F.col("e").alias("e1"), F.col("l").alias("l1"), F.col("p").alias("p1"))
    b = bins.select(F.col("e").alias("e2"), F.col("l").alias("l2"), F.col("p").alias("p2"))
    first, second = F.struct("e1", "l1"), F.struct("e2", "l2")
    prob = F.when(first == second, F.col("p1") * F.col("p2")).otherwise(2 * F.col("p1") * F.col("p2"))
    return a.crossJoin(F.broadcast(b)).where(first >= second).select("e1", "l1", "e2", "l2", prob.alias("prob"))


def checked(table: DataFrame, p: str, tolerance: float = 1e-4) -> DataFrame:
    """``table`` unchanged; raises when ``p`` does not sum to 1."""
    whole = table.agg(F.sum(p).alias("s")).first()["s"]
    if whole is not None and abs(whole - 1) > tolerance:
        raise ValueError(f"{p} sums to {whole}")
    return table


def members(rows: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose vector the store has."""
    return rows.join(store.select(*keys).distinct(), keys, "left_semi")


def missing(rows: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose vector the store lacks."""
    return rows.join(store.select(*keys).distinct(), keys, "left_anti")


def looked_up(rows: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the store's columns; a vector the store lacks raises when it is read."""
    found = rows.join(store.withColumn("_found", F.lit(True)), keys, "left")
    return found.where(F.when(F.col("_found").isNull(), F.raise_error(F.lit("vector not in the store")).cast("boolean")).otherwise(F.lit(True))).drop("_found")


def concatenated(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, columns by name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def ranked(table: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with ``rank``; Spark limits groups before it shuffles them."""
    w = Window.partitionBy(*by).orderBy(*order)
    return table.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class ProfileStore:
    """A database of profiles as tables under one folder: profiles, positions, distinct vectors, pair probabilities."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def make(self, profiles: DataFrame, positions: DataFrame, key: str) -> None:
        """``profiles(profile_id, effective, length)`` and ``positions(profile_id, pos, residue, <key>)``; X positions are skipped."""
        profiles.write.mode("overwrite").parquet(f"{self.root}/profiles")
        positions.write.mode("overwrite").parquet(f"{self.root}/positions")
        kept = self.positions().where("residue <> 22")
        discrete_probability(distinct_vectors(kept, key)).write.mode("overwrite").parquet(f"{self.root}/vectors")
        bins = profile_bins(self.profiles(), "effective", "length")
        pair_probabilities(bins).write.mode("overwrite").parquet(f"{self.root}/pairs")

    def append(self, profiles: DataFrame, positions: DataFrame) -> None:
        """Add profiles; vectors and probabilities stay as they are until ``make`` runs again."""
        profiles.write.mode("append").parquet(f"{self.root}/profiles")
        positions.write.mode("append").parquet(f"{self.root}/positions")

    def profiles(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/profiles")

    def positions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/positions")

    def vectors(self) -> DataFrame:
        """Distinct vectors; raises unless their numbers add up to the positions that were counted."""
        out = self.spark.read.parquet(f"{self.root}/vectors")
        if out.agg(F.sum("n")).first()[0] != self.positions().where("residue <> 22").count():
            raise ValueError("the vectors do not add up to the positions")
        return out

    def pairs(self) -> DataFrame:
        return checked(self.spark.read.parquet(f"{self.root}/pairs"), "prob")

    def header(self) -> DataFrame:
        """Number of profiles and of positions."""
        return self.profiles().agg(F.count("*").alias("n_profiles"), F.sum("length").alias("n_positions"))
