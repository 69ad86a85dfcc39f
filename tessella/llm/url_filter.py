"""URL filters: rules by host and path, and link-graph propagation for what no rule fits.

Hosts are vertices, links between hosts edges weighted by their number.
Personalised PageRank from hosts with pages that rules allow gives trust; the
same over reversed edges from hosts with pages that rules block gives distrust
to hosts that link to blocked ones.  A page without a rule gets its host's
verdict: blocked when distrust exceeds trust by more than ``MARGIN``.

All steps are DataFrame joins and sums; a hub's sums are taken in partial
aggregates.  ``ROUNDS`` is fixed: what is not settled by then is at most
``DAMPING ** ROUNDS`` of the rank, 4 %.  Null urls and urls without ``://`` have an empty host and path,
fit no rule and are judged as that host.  Null html has no links.  Repeated
rows count as further pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._scratch import Scratch

DAMPING = 0.85
ROUNDS = 20
MARGIN = 0.0
DIGITS = 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?:href|src|HREF|SRC)\s*=\s*["']?(?:[Hh][Tt][Tt][Pp][Ss]?:)?//([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of name and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def propagate(seeds: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(host, score)``: personalised PageRank of ``seeds(host, mass)`` over ``edges(src, dst, n)``.

    A host without out-links gives its rank back to the seeds.  All-zero seeds
    give zero scores.
    """
    whole = seeds.agg(F.sum("mass").alias("whole"))
    start = scratch.cut(
        seeds.crossJoin(F.broadcast(whole)).select("host", F.when(F.col("whole") > 0, F.col("mass") / F.col("whole")).otherwise(F.lit(0.0)).alias("seed")),
        "seeds",
    )
    out_of = edges.groupBy("src").agg(F.sum("n").alias("of"))
    share = scratch.cut(edges.join(out_of, "src").select("src", "dst", (F.col("n") / F.col("of")).alias("part")), "shares")
    ranks = start.select("host", F.col("seed").alias("score"))
    if not share.take(1):
        return ranks
    senders = share.select(F.col("src").alias("host")).distinct()
    for step in range(ROUNDS):
        lost = ranks.join(senders, "host", "left_anti").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        inflow = share.join(ranks, share.src == ranks.host).groupBy("dst").agg(F.sum(F.col("part") * F.col("score")).alias("got"))
        after = (
            start.join(inflow, start.host == inflow.dst, "left")
            .crossJoin(F.broadcast(lost))
            .select("host", ((1 - DAMPING + DAMPING * F.col("lost")) * F.col("seed") + DAMPING * F.coalesce("got", F.lit(0.0))).alias("score"))
        )
        before, ranks = ranks, scratch.cut(after, "ranks")
        if step:
            scratch.drop(before)
    return ranks


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the host's scores for each row of ``pages(page_id, url, html)``."""
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = split_url(F.col("url"))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), "html")
    found = named.withColumn("fit", matched(F.col("host"), F.col("path"), rules))
    links = F.transform(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1)), lambda x: F.translate(x, UPPER, LOWER))
    edges = (
        named.select(F.col("host").alias("src"), F.explode(links).alias("dst"))
        .where("src <> dst and src <> ''")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )
    edges = scratch.cut(edges, "edges")
    ruled = found.groupBy("host").agg(
        F.count_if(F.col("fit.verdict") == "allow").alias("allowed"), F.count_if(F.col("fit.verdict") == "block").alias("blocked")
    )
    known = edges.select(F.col("dst").alias("host")).distinct()
    hosts = scratch.cut(
        ruled.join(known, "host", "full").select("host", F.coalesce("allowed", F.lit(0)).alias("allowed"), F.coalesce("blocked", F.lit(0)).alias("blocked")),
        "hosts",
    )
    trust = propagate(hosts.select("host", F.col("allowed").alias("mass")), edges, scratch)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(hosts.select("host", F.col("blocked").alias("mass")), back, scratch)
    scores = trust.select("host", F.round("score", DIGITS).alias("trust")).join(
        distrust.select("host", F.round("score", DIGITS).alias("distrust")), "host"
    )
    scores = scratch.cut(scores, "scores")
    own = F.when(F.col("distrust") > F.col("trust") + MARGIN, F.lit("block")).otherwise(F.lit("allow"))
    return found.join(scores, "host").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "trust", "distrust"
    )
