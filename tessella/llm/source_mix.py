"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source.  A budget of tokens flows from the root:
each node shares its budget among its children by weight; a child that cannot
use its share (its documents times ``max_epochs``) takes what it can, and its
shortage goes to its siblings by weight before anything goes back to ancestors
(water-filling with subtree capacities).  A leaf repeats its documents for the
full epochs its budget holds and takes the prefix of one more epoch, whose order
is a seeded hash.

Amounts are whole numbers, so results do not depend on the order of sums.  The
tree's tables hold aggregates; a leaf's prefix is found by summing 4096 slices
of its hash order and then looking into the one slice where the budget ends, so
a leaf with most of the documents is never gathered in one task.

Null texts have no tokens; a null source or language is a child of its own
(''); rows with equal ids share their fate.  Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._native import words
from tessella.llm._scratch import Scratch

LEVELS = ("domain", "lang", "source")
#: Leaves up to which their table is broadcast: about 100 bytes each, 10 MB at most.
BROADCAST_LEAVES = 100_000
SLICE = 3  # hexadecimal digits: 4096 slices


@dataclass(frozen=True)
class Mix:
    """Weights of children by level and name (others have ``other``), and the amounts."""

    weights: dict[str, dict[str, int]] = field(
        default_factory=lambda: {
            "domain": {"web": 40, "code": 20, "books": 25, "news": 15},
            "lang": {"en": 55, "fr": 15, "de": 15, "es": 15},
            "source": {},
        }
    )
    other: int = 1
    percent: int = 70
    max_epochs: int = 2
    seed: int = 7
    domains: tuple[str, ...] = ("web", "code", "books", "news")


def domain_of(source: Column, mix: Mix) -> Column:
    """A source's domain, by the number its name ends with; the first domain without one."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    names = F.array(*map(F.lit, mix.domains))
    at = F.when(F.length(number) > 0, F.pmod(number.cast("long"), F.lit(len(mix.domains)))).otherwise(F.lit(0))
    return F.coalesce(F.get(names, at.cast("int")), F.lit(mix.domains[0]))


def _weight(level: str, mix: Mix) -> Column:
    out = F.lit(mix.other)
    for name, w in mix.weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def _key(epoch: Column, mix: Mix) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _share(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Split ``budget`` of each parent among its children by ``w`` and ``cap``; adds ``own``."""
    by = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("w"), "child")
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy(*parents)
    full = nodes.where("w > 0").withColumn("full", F.col("cap") * left <= (F.col("budget") - before) * F.col("w"))
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(whole)
    return full.withColumn("rest", rest).withColumn("open_w", open_w).withColumn(
        "own", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(rest * w) div open_w"))
    )


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves(domain, lang, source, tokens)`` with each leaf's ``budget``."""
    caps = leaves.withColumn("cap", F.col("tokens") * mix.max_epochs)
    level = caps.agg((F.sum("tokens") * mix.percent / 100).cast("long").alias("budget"))
    held: list[str] = []
    for name in LEVELS:
        nodes = caps.groupBy(*held, name).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(name, mix)).withColumn("child", F.col(name))
        joined = nodes.join(level, held) if held else nodes.crossJoin(level)
        level = _share(joined, held).select(*held, name, F.col("own").alias("budget"))
        held.append(name)
    return level


def _described(docs: DataFrame, mix: Mix) -> DataFrame:
    return docs.withColumns(
        {
            "n_tokens": F.size(words(F.coalesce("text", F.lit("")))).cast("long"),
            "domain": domain_of(F.col("source"), mix),
            "lang": F.coalesce("lang", F.lit("")),
            "source": F.coalesce("source", F.lit("")),
        }
    )


def leaf_plan(docs: DataFrame, mix: Mix, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The documents' measures, and for each leaf: full epochs and the last key of the epoch after them."""
    leaf = list(LEVELS)
    facts = scratch.cut(_described(docs.select("doc_id", "text", "lang", "source"), mix).select("doc_id", *leaf, "n_tokens"), "facts")
    sums = facts.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"))
    sums = scratch.cut(sums, "leaves")
    plan = sums.join(budgets(sums, mix), leaf, "left").withColumn("budget", F.coalesce("budget", F.lit(0).cast("long")))
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0).cast("long")))
    plan = scratch.cut(plan.withColumn("part", F.col("budget") - F.col("epochs") * F.col("tokens")), "plan")
    few = plan.count() <= BROADCAST_LEAVES
    small = (lambda t: F.broadcast(t)) if few else (lambda t: t)
    keyed = facts.join(small(plan.select(*leaf, "epochs", "part")), leaf).withColumn("key", _key(F.col("epochs"), mix))
    keyed = keyed.withColumn("slice", F.substring("key", 1, SLICE))
    slices = keyed.groupBy(*leaf, "slice").agg(F.sum("n_tokens").alias("n"), F.first("part").alias("part"))
    run = Window.partitionBy(*leaf).orderBy("slice")
    slices = scratch.cut(slices.withColumn("upto", F.sum("n").over(run)), "slices")
    whole = slices.where("upto <= part").groupBy(*leaf).agg(F.max("slice").alias("done"))
    edge = slices.where("upto > part").groupBy(*leaf).agg(F.min(F.struct("slice", (F.col("upto") - F.col("n")).alias("before"))).alias("e"))
    edge = edge.select(*leaf, F.col("e.slice").alias("slice"), F.col("e.before").alias("before"))
    within = Window.partitionBy(*leaf, "slice").orderBy("key")
    last = (
        keyed.join(small(edge), [*leaf, "slice"])
        .withColumn("upto", F.col("before") + F.sum("n_tokens").over(within))
        .where("upto <= part")
        .groupBy(*leaf)
        .agg(F.max("key").alias("last"))
    )
    ends = plan.join(whole, leaf, "left").join(last, leaf, "left")
    # every key of a whole slice comes before the slice's name followed by 'g'
    ends = ends.withColumn("last", F.greatest("last", F.concat("done", F.lit("g")))).select(*leaf, "budget", "epochs", "last")
    return facts, small(scratch.cut(ends, "ends"))


def _copies(mix: Mix) -> Column:
    return F.col("epochs") + F.coalesce((_key(F.col("epochs"), mix) <= F.col("last")).cast("long"), F.lit(0))


def mixture(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """For each row of ``docs(doc_id, text, lang, source)`` its leaf, tokens and number of copies in the mixture."""
    scratch = Scratch(docs.sparkSession, "mix")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    facts, ends = leaf_plan(docs, mix, scratch)
    return facts.join(ends, list(LEVELS)).select(
        "doc_id", *LEVELS, "n_tokens", F.col("budget").alias("leaf_budget"), _copies(mix).alias("copies")
    )


def mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of ``docs`` as often as the mixture has them, with their own columns only; texts are not shuffled."""
    scratch = Scratch(docs.sparkSession, "mix")
    _, ends = leaf_plan(docs, mix, scratch)
    rows = docs.select("doc_id", "source", "lang", F.struct("*").alias("_row"))
    rows = rows.withColumns({"domain": domain_of(F.col("source"), mix), "lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))})
    taken = rows.join(ends, list(LEVELS)).withColumn("copies", _copies(mix)).where("copies > 0")
    if mix.max_epochs > 1:
        taken = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select("_row.*")
