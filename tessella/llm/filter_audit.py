"""Audit of how filters overlap, by executing the trie of their permutations.

Every order of the filters is a path in a trie; a node is the set of rows that
survive the filters above it.  The trie is walked depth first.  A survivor set
depends on which filters were applied, not on their order, so nodes with the
same set of filters are one state: it is executed once, and its counts are
shared by every path that meets it (2**n states in place of about e * n! nodes).
A state's survivors are its parent's persisted survivors without those that
fail one more filter; all edges that leave it are counted in one aggregation
over them.  At most one persisted table for each filter is alive at a time.

Filters are evaluated once for each row, into a narrow table in the shared
folder; what is persisted derives from it, so a lost executor costs a filter
over that table.

Rows without a text count as empty, without a part as ``''``.  A row is a
document even if its id is null or repeated; a null id is neither smaller nor
larger than another and has no labels.  Several labels of one document count
as one that holds if any does.  An empty table gives no rows.  Further columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._native import let, words
from tessella.llm._scratch import Scratch

FILTERS = "ABCDE"
LOSSES = ("good", "toxic")


def failures(text: Column) -> Column:
    """Struct of the failures that a text alone decides: too short, too repetitive, shouting, holding symbols."""
    upper = F.length(text) - F.length(F.translate(text, "".join(map(chr, range(65, 91))), ""))
    counts = let(words(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("kinds")))
    return let(
        counts,
        lambda c: F.struct(
            (c["n"] < 50).alias("A"),
            (100 * c["kinds"].cast("long") < 65 * c["n"].cast("long")).alias("B"),
            (100 * upper.cast("long") > 5 * F.length(text).cast("long")).alias("C"),
            text.rlike("[#$%&*|]").alias("D"),
        ),
    )


def verdicts(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """One narrow row for each row of ``docs(doc_id, text, source)``: its part, a flag for each filter it fails, its labels."""
    text = F.coalesce(F.col("text"), F.lit(""))
    alone = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.explode(F.array(failures(text))).alias("fails"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    alone = scratch.cut(alone.select("doc_id", "part", "fails.*", "digest"), "alone")
    repeated = alone.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = scratch.cut(repeated, "repeated")  # so that Spark can split the join of a text with many copies
    judged = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    judged = scratch.cut(judged, "labels")
    whole = alone.join(repeated, "digest", "left").join(judged, "doc_id", "left")
    flag = {"E": F.col("doc_id") > F.col("first_id")} | {x: F.col(x) for x in LOSSES}
    return scratch.cut(whole.select("part", *"ABCD", *(F.coalesce(f, F.lit(False)).alias(x) for x, f in flag.items())), "verdicts")


def _edges(survivors: DataFrame, applied: str, rest: Sequence[str]) -> DataFrame:
    """For each part that has survivors: how many, and for each filter that may come next what it removes."""
    counts = [F.count_if(F.col(f) & extra).alias(f"{f}_{name}") for f in rest for name, extra in (("removed", F.lit(True)), *((x, F.col(x)) for x in LOSSES))]
    edges = [F.struct(F.lit(f).alias("filter"), *(F.col(f"{f}_{x}").alias(x) for x in ("removed", *LOSSES))) for f in rest]
    by_part = survivors.groupBy("part").agg(F.count("*").alias("present"), *counts)
    return by_part.select("part", F.lit(applied).alias("applied"), "present", F.array(*edges).alias("edges"))


def walk(rows: DataFrame, filters: Sequence[str], scratch: Scratch) -> DataFrame:
    """``(part, applied, present, filter, removed, good, toxic)``: every edge between two states, with what it removes.

    ``filters`` are boolean columns of ``rows``, of one letter each and in the order of
    the alphabet, true where a row fails; ``applied`` names a state by its filters.
    """
    done: dict[str, DataFrame] = {}

    def visit(survivors: DataFrame, applied: frozenset[str]) -> None:
        rest = [f for f in filters if f not in applied]
        state = "".join(f for f in filters if f in applied)
        if not rest or state in done:
            return
        survivors = survivors.persist()
        done[state] = scratch.cut(_edges(survivors, state, rest), f"state{state}")
        for f in rest:
            visit(survivors.where(~F.col(f)), applied | {f})
        survivors.unpersist()

    visit(rows, frozenset())
    paths = [t._scratch_path for t in done.values()]
    return rows.sparkSession.read.schema(done[""].schema).parquet(*paths).selectExpr("part", "applied", "present", "inline(edges)")


def orders(edges: DataFrame, filters: Sequence[str]) -> DataFrame:
    """One row for each part, order of the filters and step, from the counts of the edges.

    A part's edges (n * 2**(n-1) at most) become one map, in which every order looks its steps up.
    """
    n = len(filters)
    weight = {k: math.factorial(k) * math.factorial(n - 1 - k) for k in range(n)}
    paths = F.element_at(F.create_map(*(F.lit(x) for kv in weight.items() for x in kv)), F.length("applied"))
    shapley = [F.sum(F.when(F.col("filter") == f, paths * F.col("removed")).otherwise(0)).cast("long").alias(f"shapley_{f}") for f in filters]
    entry = F.struct(F.concat_ws(">", "applied", "filter").alias("key"), F.struct("present", "removed", *LOSSES).alias("value"))
    parts = edges.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("at"), *shapley)

    def found(applied: Column | str, f: Column, field: str) -> Column:
        applied = F.lit(applied) if isinstance(applied, str) else applied
        return F.coalesce(F.element_at("at", F.concat_ws(">", applied, f))[field], F.lit(0).cast("long"))

    every = " ".join("".join(p) for p in permutations(filters))
    steps = parts.withColumn("filter_order", F.explode(F.split(F.lit(every), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    before = F.array_join(F.array_sort(F.split(F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1), "")), "")
    others = F.replace(F.lit("".join(filters)), F.col("f"), F.lit(""))
    steps = steps.withColumn("f", F.substring(F.col("filter_order"), F.col("step"), F.lit(1))).withColumn("before", before)
    return steps.select(
        "part",
        "filter_order",
        "step",
        (found(F.col("before"), F.col("f"), "present") - found(F.col("before"), F.col("f"), "removed")).alias("kept"),
        found(F.col("before"), F.col("f"), "removed").alias("removed"),
        (found("", F.col("f"), "removed") - found(F.col("before"), F.col("f"), "removed")).alias("redundant"),
        found(others, F.col("f"), "removed").alias("unique_fails"),
        *(found(F.col("before"), F.col("f"), x).alias(f"{x}_lost") for x in LOSSES),
        F.element_at(F.create_map(*(x for f in filters for x in (F.lit(f), F.col(f"shapley_{f}")))), F.col("f")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The interaction of the five filters on each source of ``docs``, with the labelled documents each removes."""
    scratch = scratch or Scratch(docs.sparkSession, "audit")
    return orders(walk(verdicts(docs, labels, scratch), FILTERS, scratch), FILTERS)
