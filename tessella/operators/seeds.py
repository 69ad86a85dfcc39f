"""Candidate pairs for alignment: profiles that share two words on one diagonal.

A position's code is the component in which it is strongest against its
background.  The index holds, for each position of a subject, the word of codes
that begins there.  A word that more than ``common`` positions begin with tells
little and costs much, so it gives way to the words that are one code longer,
until they are rare enough or ``longest`` codes long: the index is a trie whose
leaves are rare words, and every position stays in it.  A query looks up its
own words and those in which one code is replaced by its position's second
strongest.  Two hits on one diagonal, ``reach`` positions apart at most, make a
pair of profiles a candidate.

All of it is joins and counts on words; no profile is compared with another.
The join on a word brings ``common`` rows for each row of a query at most,
except for words that are still common at ``longest`` codes, which keep all of
theirs.  What the seeds miss, a search without them finds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.shared import written


@dataclass(frozen=True)
class Seeding:
    """Codes of the shortest and longest words, how many positions may share a word that is not lengthened, and the reach of two hits."""

    shortest: int = 2
    longest: int = 6
    common: int = 10_000
    reach: int = 40

    def __post_init__(self) -> None:
        if not 1 <= self.shortest <= self.longest or self.common < 1 or self.reach < 1:
            raise ValueError("words need a positive length, count and reach")


def _strength(v: Column, bg: Column | None) -> Column:
    if bg is None:
        return v
    return F.when(bg.isNull(), v).otherwise(F.zip_with(v, bg, lambda x, b: F.when(b > 0, x / b).otherwise(F.lit(0.0))))


def codes(profiles: DataFrame) -> DataFrame:
    """``(profile_id, codes, others)``: for each position its strongest and its second strongest component, ties to the first.

    ``profiles(profile_id, v)`` may have a background ``bg``, which the components are divided by.
    A position of one component has it twice.
    """
    bg = F.col("bg").cast("array<double>") if "bg" in profiles.columns else None

    def ranked(v: Column) -> Column:
        # array_sort orders by the first field: the negated strength, then the component
        return F.array_sort(F.transform(_strength(v, bg), lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))

    best = F.transform(F.col("v"), lambda v: F.transform(F.slice(ranked(v.cast("array<double>")), 1, 2), lambda s: s["i"]))
    out = profiles.where("v IS NOT NULL AND profile_id IS NOT NULL").select(F.col("profile_id").cast("long").alias("profile_id"), best.alias("_best"))
    return out.select(
        "profile_id",
        F.transform("_best", lambda b: F.get(b, F.lit(0))).alias("codes"),
        F.transform("_best", lambda b: F.coalesce(F.get(b, F.lit(1)), F.get(b, F.lit(0)))).alias("others"),
    )


def _starts(coded: DataFrame, size: int) -> DataFrame:
    """A row for each position at which a word of ``size`` codes fits: ``profile_id, pos`` (from 0), ``codes``, ``others``."""
    last = F.size("codes") - size
    fit = coded.where(last >= 0)
    return fit.select("profile_id", F.explode(F.sequence(F.lit(0), last)).alias("pos"), "codes", "others")


def _word(codes_: Column, pos: Column, size: int) -> Column:
    return F.array_join(F.transform(F.slice(codes_, pos + 1, size), lambda c: c.cast("string")), ".")


def _lookups(codes_: Column, others: Column, pos: Column, size: int) -> Column:
    """A word and those with one code replaced."""
    whole = F.slice(codes_, pos + 1, size)
    second = F.slice(others, pos + 1, size)
    changed = [F.concat(F.slice(whole, 1, k), F.slice(second, k + 1, 1), F.slice(whole, k + 2, size)) for k in range(size)]
    return F.array_distinct(F.transform(F.array(whole, *changed), lambda w: F.array_join(F.transform(w, lambda c: c.cast("string")), ".")))


def hits(queries: DataFrame, subjects: DataFrame, seeding: Seeding = Seeding()) -> DataFrame:  # noqa: B008
    """``(query_id, subject_id, q, s)``: positions (from 0) at which a query finds a leaf word of the subjects' index."""
    asked, held = codes(queries), written(codes(subjects), "codes")
    found: DataFrame | None = None
    open_words: DataFrame | None = None  # common words of the level before, whose longer words come next
    for size in range(seeding.shortest, seeding.longest + 1):
        own = _starts(held, size).select(F.col("profile_id").alias("subject_id"), F.col("pos").alias("s"), _word(F.col("codes"), F.col("pos"), size).alias("word"))
        looked = _starts(asked, size).select(
            F.col("profile_id").alias("query_id"), F.col("pos").alias("q"), F.explode(_lookups(F.col("codes"), F.col("others"), F.col("pos"), size)).alias("word")
        )
        if open_words is not None:
            stem = open_words.withColumnRenamed("word", "stem")
            own = own.withColumn("stem", F.substring_index("word", ".", size - 1)).join(stem, "stem", "left_semi").drop("stem")
        counts = own.groupBy("word").agg(F.count("*").alias("n"))
        if size < seeding.longest:
            counts = written(counts, "words")
            open_words = counts.where(F.col("n") > seeding.common).select("word")
            leaves = counts.where(F.col("n") <= seeding.common).select("word")
            own = own.join(leaves, "word", "left_semi")
        level = looked.join(own, "word").drop("word")
        found = level if found is None else found.unionByName(level)
        if size < seeding.longest and open_words.isEmpty():
            break
    return found.select("query_id", "subject_id", "q", "s")


def candidates(queries: DataFrame, subjects: DataFrame, seeding: Seeding = Seeding()) -> DataFrame:  # noqa: B008
    """``(query_id, subject_id, diagonals)``: pairs of profiles with two hits on a diagonal, and on how many diagonals they have them.

    Profiles without positions or ids, and those shorter than a word, are in no pair.
    """
    on = hits(queries, subjects, seeding).withColumn("diagonal", F.col("q") - F.col("s")).distinct()
    before = F.lag("q").over(Window.partitionBy("query_id", "subject_id", "diagonal").orderBy("q"))
    near = on.withColumn("gap", F.col("q") - before).where(F.col("gap") <= seeding.reach)
    return near.groupBy("query_id", "subject_id").agg(F.count_distinct("diagonal").alias("diagonals"))
