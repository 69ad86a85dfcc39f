"""Trie of conversation prefixes, summed over subtrees by heavy-path decomposition.

A node is a distinct sequence of first turns; its fingerprint is the exclusive
or of one 128-bit hash for each (position, role, text), so two different
sequences of a table share one with a chance of about 2**-128 for each pair.
Because that sum is associative, nothing needs a whole conversation in one
task: rows are sorted into ranges, positions and fingerprints are computed
inside each range, and what comes before a range is added from a table with
one row for each conversation and range.

The child with the most members is its parent's heavy one (ties: the smaller
least member), so a step to a light child at least halves the members and a
path from the root holds at most log2(conversations) light steps.  Every heavy
path ends in one childless node and is stored as stretches of the turns of that
node's least member, (path, depth).  Sums over subtrees take three steps:

1. a path's own values are added up;
2. paths hand their totals to the path on which their top hangs, in rounds,
   until no path is left below another: log2(conversations) rounds at most, of
   one row for each path that still has something to hand on;
3. totals that arrive at a node join its own value, and suffix sums along the
   path arrays, in blocks of ``BLOCK`` depths, give each node's subtree.

The hash of a node's ends is of one long text, which no two tasks can share: the
text is composed in pieces of ``PIECE_IDS`` ids where the sorted ids lie, and
only the hashing of one node's pieces is sequential, a piece at a time.

Rows without a conversation are left out; null roles and texts are empty.  Turns
are ordered by turn (null first), then role, then the MD5 of the text; repeated
rows are repeated turns.  A conversation without turns of its own after the
rebuilding, and whose root conversation gives none, ends at the root.  An
empty table gives no rows.  Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._scratch import Scratch

WORD = "[^\\x20\\x09-\\x0D]+"
#: A conversation takes up to three turns of the one that opens its group of twenty.
GROUP, HEADS = 20, 4
#: Depths of a path that are summed in one window, and ids of one piece of hashed text.
BLOCK = 4096
PIECE_IDS = 4096
_KEY = ["k1", "k2"]
_PAGE = 33  # monotonically_increasing_id keeps the partition above this bit


def numbered(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns with their range and position, and one row for each conversation: its turns, how many it takes from which other."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("digest"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("n_words"),
        F.rand(11).alias("spread"),  # equal rows are interchangeable, and so may lie in several ranges
    )
    keys = ["conv_id", F.asc_nulls_first("turn"), "role", "digest", "spread"]
    placed = turns.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("turn", "spread")
    placed = scratch.cut(placed.withColumn("at", F.monotonically_increasing_id()), "turns")
    placed = placed.withColumn("range", F.shiftright("at", _PAGE))
    runs = placed.groupBy("conv_id", "range").agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    runs = scratch.cut(runs, "runs")
    convs = runs.groupBy("conv_id").agg(F.sum("n").alias("n"))
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    sizes = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0).cast("long")))
    convs = convs.join(sizes, "base", "left").withColumn("m", taken).withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = scratch.cut(convs.select("conv_id", "base", "h", "m", "length"), "convs")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(convs.select("conv_id", "h", "m", "length"), "conv_id")
    own = placed.join(runs.drop("n"), ["conv_id", "range"]).withColumn("pos", F.col("at") - F.col("first_at") + 1 + F.col("before"))
    return scratch.cut(own.select("conv_id", "range", "pos", "role", "digest", "n_words", "h", "m", "length"), "own"), convs


def instances(own: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(conv_id, depth, k1, k2, p1, p2, n_words, last)``: each rebuilt conversation's nodes, the root included, with the fingerprints of node and parent."""
    heads = own.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEADS)).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "role", "digest", "n_words")
    given = convs.where("m > 0").join(heads, "base").where("depth <= m").withColumn("range", F.lit(-1).cast("long"))
    cols = ["conv_id", "range", "depth", "role", "digest", "n_words", "length"]
    rows = given.select(cols).union(own.where("pos > h").withColumn("depth", F.col("pos") - F.col("h") + F.col("m")).select(cols))
    rows = rows.withColumn("g1", F.xxhash64("depth", "role", "digest")).withColumn("g2", F.xxhash64("digest", "role", "depth")).drop("role", "digest")
    inside = Window.partitionBy("conv_id", "range").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "range").agg(F.bit_xor("g1").alias("g1"), F.bit_xor("g2").alias("g2"))
    carried = totals.select("conv_id", "range", *(F.coalesce(F.bit_xor(f"g{i}").over(before), F.lit(0)).alias(f"c{i}") for i in (1, 2)))
    rows = rows.select("*", *(F.bit_xor(f"g{i}").over(inside).alias(f"x{i}") for i in (1, 2))).join(carried, ["conv_id", "range"])
    for i in (1, 2):
        rows = rows.withColumn(f"k{i}", F.col(f"x{i}").bitwiseXOR(F.col(f"c{i}"))).withColumn(f"p{i}", F.col(f"k{i}").bitwiseXOR(F.col(f"g{i}")))
    rows = rows.select("conv_id", "depth", "k1", "k2", "p1", "p2", "n_words", (F.col("depth") == F.col("length")).alias("last"))
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero, zero, zero, F.lit(None).cast("long"), F.lit(None).cast("long"), zero, F.col("length") == 0)
    return scratch.cut(rows.union(root), "instances")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(k1, k2, conv_id)`` to runs of one node's ids as text, ``PIECE_IDS`` ids at most in each."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        k1, k2 = (batch[c].to_numpy() for c in _KEY)
        begins = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        sizes = np.diff(np.r_[begins, n])
        begins = np.concatenate([np.arange(b, b + s, PIECE_IDS) for b, s in zip(begins, sizes, strict=True)])
        ends = np.r_[begins[1:], n].astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(np.r_[begins.astype(np.int32), ends[-1:]]), pc.cast(batch["conv_id"], pa.string()))
        yield pa.RecordBatch.from_arrays(
            [batch["k1"].take(begins), batch["k2"].take(begins), batch["conv_id"].take(begins), pc.binary_join(ids, ",")], [*_KEY, "first_id", "ids"]
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one hash for each node; the open node's hash goes on from batch to batch."""
    key, open_hash = None, None
    for batch in batches:
        done = []
        for k1, k2, ids in zip(*(batch[c].to_pylist() for c in (*_KEY, "ids")), strict=True):
            if (k1, k2) != key:
                if key is not None:
                    done.append((*key, open_hash.hexdigest()))
                key, open_hash = (k1, k2), hashlib.sha256(ids.encode())
            else:
                open_hash.update(b"," + ids.encode())
        yield _hashed(done)
    if key is not None:
        yield _hashed([(*key, open_hash.hexdigest())])


def _hashed(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], [*_KEY, "ends_sha256"])


def ends(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``(k1, k2, ends_sha256)`` of each node at which a conversation ends."""
    at = nodes.where("last").select(*_KEY, "conv_id")
    at = at.repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    pieces = scratch.cut(at.mapInArrow(_pieces, "k1 long, k2 long, first_id long, ids string"), "pieces")
    pieces = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first_id")
    return scratch.cut(pieces.mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string"), "ends", batch_rows=256)


def noded(rows: DataFrame, ended: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each node: least member, members, children, whether it is its parent's heavy child (the root is not), own values."""
    whole = rows.groupBy(*_KEY).agg(*(F.max(c).alias(c) for c in ("depth", "p1", "p2", "n_words")), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    whole = scratch.cut(whole, "members")
    best = F.max(F.struct("n_convs", F.bitwise_not("conv_id").alias("least"), *_KEY)).alias("best")
    below = whole.where("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children"), best)
    below = scratch.cut(below.select("p1", "p2", "n_children", "best.k1", "best.k2"), "children")
    counts = below.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children")
    heavy = below.select(*_KEY, F.lit(True).alias("heavy"))
    nodes = whole.drop("p1", "p2").join(counts, _KEY, "left").join(heavy, _KEY, "left").join(ended, _KEY, "left")
    nodes = nodes.select(
        *_KEY,
        "depth",
        "conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        F.coalesce("heavy", F.lit(False)).alias("heavy"),
        ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    return scratch.cut(nodes, "nodes")


def heavy_paths(rows: DataFrame, nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The nodes as arrays ``(path, depth)``, each with its parent's least member, and the top of each path.

    A path is named by the least member of the childless node in which it ends, and is
    what that member's turns hold from its last light node on.
    """
    leaves = nodes.where("n_children = 0").select(F.col("conv_id").alias("path"))
    chains = rows.select(F.col("conv_id").alias("path"), *_KEY, "depth").join(leaves, "path", "left_semi")
    nodes = nodes.withColumnRenamed("depth", "_depth")
    is_root = (F.col("k1") == 0) & (F.col("k2") == 0)
    below = chains.where(F.col("depth") > 0).join(nodes.where(~is_root), _KEY)
    first = chains.where(F.col("depth") == 0).join(F.broadcast(nodes.where(is_root)), _KEY)  # one row
    chains = scratch.cut(below.union(first).drop("_depth", *_KEY), "chains")
    tops = scratch.cut(chains.where(~F.col("heavy")).groupBy("path").agg(F.max("depth").alias("top")), "tops")  # so that Spark can split the join
    chains = chains.join(tops, "path").where("depth >= top - 1")
    above = chains.select("path", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    paths = scratch.cut(chains.where("depth >= top").join(above, ["path", "depth"], "left"), "paths")
    hung = paths.where("depth = top AND depth > 0").select("path", F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    spots = paths.select(F.col("path").alias("onto"), "conv_id", "depth")
    return paths, scratch.cut(hung.join(spots, ["conv_id", "depth"]).select("path", "onto", "depth"), "hung")


def subtree_sums(paths: DataFrame, hung: DataFrame, values: dict[str, str], scratch: Scratch) -> DataFrame:
    """``paths`` with the sum over each node's subtree of every value: new name to the column of own values."""

    def summed(frame: DataFrame, *by: str) -> DataFrame:
        return frame.groupBy(*by).agg(*(F.sum(v).alias(v) for v in values))

    arrays = paths.select("*", *(F.col(own).alias(v) for v, own in values.items()))
    handed = [scratch.cut(summed(arrays, "path"), "handed")]
    while True:
        up = handed[-1].join(hung.select("path", "onto"), "path").drop("path").withColumnRenamed("onto", "path")
        up = scratch.cut(summed(up, "path"), "handed")
        if up.isEmpty():
            break
        handed.append(up)
    total = summed(reduce(DataFrame.union, handed), "path")
    arrived = summed(total.join(hung, "path").drop("path").withColumnRenamed("onto", "path"), "path", "depth")
    arrived = arrived.select("path", "depth", *(F.col(v).alias(f"_{v}") for v in values))
    arrays = arrays.join(arrived, ["path", "depth"], "left")
    arrays = arrays.select(
        *paths.columns, *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values), F.floor(F.col("depth") / BLOCK).alias("block")
    )
    arrays = scratch.cut(arrays, "arrays")
    inside = Window.partitionBy("path", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("path").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    after = summed(arrays, "path", "block").select("path", "block", *(F.coalesce(F.sum(v).over(later), F.lit(0)).alias(f"_{v}") for v in values))
    arrays = arrays.select(*paths.columns, "block", *(F.sum(v).over(inside).alias(v) for v in values)).join(after, ["path", "block"])
    return arrays.select(*paths.columns, *((F.col(v) + F.col(f"_{v}")).alias(v) for v in values))


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of the rebuilt ``conversations(conv_id, turn, role, text)``."""
    scratch = Scratch(conversations.sparkSession, "trie")
    own, convs = numbered(conversations, scratch)
    rows = instances(own, convs, scratch)
    nodes = noded(rows, ends(rows, scratch), scratch)
    paths, hung = heavy_paths(rows, nodes, scratch)
    paths = paths.withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    out = subtree_sums(paths, hung, {"n_leaves": "leaf", "saved_tokens": "saved"}, scratch)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
