"""Checks of profiles, score distributions of one profile or of weighted cells, and wrapped descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: effective sequences below which a profile is left out.
LEAST_SEQUENCES = 3.0


def thick_enough(profiles: DataFrame, sequences: str, least: float = LEAST_SEQUENCES) -> DataFrame:
    """Profiles with at least ``least`` effective sequences; those without a number go."""
    return profiles.where(F.col(sequences) >= least)


def incompatibilities(one: DataFrame, other: DataFrame) -> DataFrame:
    """``(id, reason)`` of profiles that two tables ``(id, pos, residue)`` do not agree on.

    ``missing``: only one of them has it; ``length``: other numbers of positions;
    ``residue``: another residue, or none, at some position.  Null residues agree.
    """
    tagged = one.select("id", "pos", F.col("residue").alias("a"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b"), F.lit(None).cast(one.schema["residue"].dataType).alias("b")).unionByName(
        other.select("id", "pos", F.col("residue").alias("b"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b"), F.lit(None).cast(other.schema["residue"].dataType).alias("a"))
    )
    places = tagged.groupBy("id", "pos").agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b"), F.max("a").alias("a"), F.max("b").alias("b"))
    sums = places.groupBy("id").agg(F.sum("in_a").alias("n_a"), F.sum("in_b").alias("n_b"), F.count_if((F.col("in_a") != F.col("in_b")) | ~F.col("a").eqNullSafe(F.col("b"))).alias("apart"))
    reason = F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), "missing").when(F.col("n_a") != F.col("n_b"), "length").when(F.col("apart") > 0, "residue")
    return sums.select("id", reason.alias("reason")).where("reason is not null")


def profile_score_distribution(rows: DataFrame, background: list[float]) -> DataFrame:
    """``(id, score, p)``: how probable each whole score of ``rows(id, scores ARRAY)`` is under the background.

    A letter counts with its background probability at each position; null
    scores do not count, letters without probability are left out.
    """
    letters = F.array(*(F.lit(float(x)) for x in background))
    length = rows.groupBy("id").agg(F.count("*").alias("length"))
    cells = rows.select("id", F.explode(F.arrays_zip(F.col("scores").alias("s"), letters.alias("b"))).alias("c")).select("id", "c.s", "c.b").where("s is not null and b > 0")
    sums = cells.groupBy("id", F.col("s").cast("long").alias("score")).agg(F.sum("b").alias("b"))
    return sums.join(length, "id").select("id", "score", (F.col("b") / F.col("length")).alias("p"))


def weighted_score_distribution(cells: DataFrame) -> DataFrame:
    """``(id, score, p)`` of ``cells(id, score, pq, ps)``, each weighted by the product of its positions' weights."""
    sums = cells.groupBy("id", "score").agg(F.sum(F.col("pq") * F.col("ps")).alias("w"))
    whole = sums.groupBy("id").agg(F.sum("w").alias("whole"))
    return sums.join(whole, "id").select("id", "score", (F.col("w") / F.col("whole")).alias("p"))


def cell_statistics(cells: DataFrame, lam: float) -> DataFrame:
    """``(id, expected, entropy)`` from the cells themselves, without a histogram; scores need not be whole."""
    w, s = F.col("pq") * F.col("ps"), F.col("score")
    return cells.groupBy("id").agg((F.sum(s * w) / F.sum(w)).alias("expected"), (lam * F.sum(s * w * F.exp(lam * s)) / F.sum(w)).alias("entropy"))


def wrapped(text: Column, width: int, indent: int = 0, most: int | None = None) -> Column:
    """Words of ``text`` in lines of at most ``width`` characters, all but the first indented; longer words stand alone.

    More than ``most`` characters of text are cut there and end with ``...``.
    A null stays null.
    """
    if most is not None:
        text = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
    words = F.filter(F.split(F.regexp_replace(text, "[ \\t]+", " "), " "), lambda w: w != "")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def step(s: Column, w: Column) -> Column:
        fits = F.length(s["line"]) + 1 + F.length(w) <= width
        return (
            F.when(s["line"] == "", F.struct(s["done"].alias("done"), w.alias("line")))
            .when(fits, F.struct(s["done"].alias("done"), F.concat(s["line"], F.lit(" "), w).alias("line")))
            .otherwise(F.struct(F.concat(s["done"], s["line"], F.lit("\n")).alias("done"), F.concat(F.lit(" " * indent), w).alias("line")))
        )

    return F.aggregate(words, start, step, lambda s: F.concat(s["done"], s["line"]))
