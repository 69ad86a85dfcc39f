"""Weights of sequences that differ from column to column of an alignment.

A column's weights come from the sequences that reach it (its members), over the
extent in which all of them are present: from the last of their beginnings to
the first of their ends, but at least ``least`` match columns around it.  A
sequence weighs the sum, over the extent's columns, of 1 / (its symbol's count *
number of symbols) among the members.  Columns with the same members share one
computation: a set of members lasts from one beginning or end of a sequence to
the next, so its first column names it.

Everything is joins and aggregates on (alignment, column) and (alignment, set,
column or sequence); no step gathers an alignment, or a column of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import alphabet as A
from tessella.operators import msa
from tessella.sources.shared import written

LEAST = 10


def residues(table: DataFrame) -> DataFrame:
    """``(msa_id, seq_id, col, pos, code, begin, end)``: residues of match columns, these numbered from 0, with a sequence's first and last."""
    columns = msa.match_states(table).select("msa_id", "pos", (F.col("state") - 1).cast("int").alias("col"))
    held = table.where(A.is_residue(F.col("code"))).join(columns, ["msa_id", "pos"])
    ends = held.groupBy("msa_id", "seq_id").agg(F.min("col").alias("begin"), F.max("col").alias("end"))
    return held.join(ends, ["msa_id", "seq_id"]).select("msa_id", "seq_id", "col", "pos", "code", "begin", "end")


def member_sets(held: DataFrame, least: int = LEAST, extents: bool = True) -> DataFrame:
    """``(msa_id, col, set, left, right)``: each column's set of members and its extent; columns no sequence reaches have none.

    Without ``extents`` every set's extent is the whole alignment.
    """
    spans = held.groupBy("msa_id", "begin", "end").agg(F.lit(1).alias("_one")).drop("_one")
    whole = held.groupBy("msa_id").agg((F.max("col") + 1).alias("reached"))
    columns = spans.select("msa_id", "begin", "end", F.explode(F.sequence("begin", "end")).alias("col"))
    bounds = columns.groupBy("msa_id", "col").agg(F.max("begin").alias("left"), F.min("end").alias("right"))
    # a set begins where a member begins, or after one that ends: among spans over a column these are its last begin and the last end before it
    changes = spans.select("msa_id", F.explode(F.array("begin", F.col("end") + 1)).alias("at")).distinct()
    steps = changes.select("msa_id", F.col("at").alias("col"), F.lit(1).alias("change"))
    from pyspark.sql import Window

    along = Window.partitionBy("msa_id").orderBy("col")
    marked = bounds.join(steps, ["msa_id", "col"], "left").withColumn("set", F.max(F.when(F.col("change") == 1, F.col("col"))).over(along))
    sized = marked.join(whole, "msa_id")
    if not extents:
        return sized.select("msa_id", "col", "set", F.lit(0).alias("left"), (F.col("reached") - 1).alias("right"))
    wanted = F.least(F.lit(least), F.col("length"))
    sized = sized.withColumnRenamed("reached", "length")
    short = F.greatest(F.lit(0), wanted - (F.col("right") - F.col("left") + 1))
    sized = sized.withColumn("left", F.greatest(F.lit(0), F.col("left") - F.floor((short + 1) / 2).cast("int")))
    sized = sized.withColumn("right", F.least(F.col("length") - 1, F.col("left") + F.greatest(F.col("right") - F.col("left"), wanted - 1)))
    sized = sized.withColumn("left", F.greatest(F.lit(0), F.least(F.col("left"), F.col("right") - wanted + 1)))
    return sized.select("msa_id", "col", "set", "left", "right")


def set_weights(held: DataFrame, sets: DataFrame) -> DataFrame:
    """``(msa_id, set, seq_id, w)``: what each member of each set of columns weighs over the set's extent."""
    wide = sets.select("msa_id", "set", "left", "right").distinct().select("msa_id", "set", F.explode(F.sequence("left", "right")).alias("col"))
    inside = wide.join(held, ["msa_id", "col"]).where(F.col("set").between(F.col("begin"), F.col("end"))).select("msa_id", "set", "col", "seq_id", "code")
    counts = inside.groupBy("msa_id", "set", "col", "code").agg(F.count("*").alias("n"))
    kinds = counts.groupBy("msa_id", "set", "col").agg(F.count("*").alias("kinds"))
    share = counts.join(kinds, ["msa_id", "set", "col"]).select(
        "msa_id", "set", "col", "code", (1.0 / (F.col("n") * F.least(F.col("kinds"), F.lit(A.RESIDUES)))).alias("share")
    )
    return inside.join(share, ["msa_id", "set", "col", "code"]).groupBy("msa_id", "set", "seq_id").agg(F.sum("share").alias("w"))


def position_weights(table: DataFrame, least: int = LEAST, extents: bool = True) -> DataFrame:
    """``(msa_id, pos, seq_id, weight, first, last)`` for the residues of match columns, with the extent's first and last column.

    A column's weights sum to 1.  Columns in which no sequence has a residue are left out.
    """
    held = written(residues(table), "residues")
    sets = written(member_sets(held, least, extents), "sets")
    place = msa.match_states(table).select("msa_id", (F.col("state") - 1).cast("int").alias("_col"), F.col("pos").alias("_pos"))
    own = held.join(sets, ["msa_id", "col"]).join(set_weights(held, sets), ["msa_id", "set", "seq_id"])
    total = own.groupBy("msa_id", "pos").agg(F.sum("w").alias("total"))
    bounds = sets.select("msa_id", "left", "right").distinct()
    for side, name in (("left", "first"), ("right", "last")):
        found = place.select("msa_id", F.col("_col").alias(side), F.col("_pos").alias(name))
        bounds = bounds.join(found, ["msa_id", side])
    return own.join(total, ["msa_id", "pos"]).join(bounds, ["msa_id", "left", "right"]).select(
        "msa_id", "pos", "seq_id", (F.col("w") / F.col("total")).alias("weight"), "first", "last"
    )
