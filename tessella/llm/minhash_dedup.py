"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle space gives two signature values, the minimum
and the maximum, so a signature of 2 P values costs P evaluations of a hash.
The values are banded; documents that agree in all values of a band meet in a
bucket.  What follows is exact:

1. Documents with equal shingle sets form one class; only classes go on.
2. In every bucket each class is compared with the bucket's smallest class (a
   star, so rows grow with memberships, not with pairs): by the sizes of both
   sets, then on one-byte signatures, and what is left on full sets.  A centre's
   set is sent once for each ``BLOCK_ITEMS`` shingles of its members.
3. In buckets that still hold several components, the classes outside the
   bucket's largest component are compared with all of its classes, in blocks
   of about ``BLOCK`` classes and ``BLOCK_ITEMS`` shingles a side: first on one-byte
   signatures (margin in ``Plan``), and what comes near a class of another
   component on full sets.  At most a spanning forest of new links leaves a block.

Loss comes from banding and the one-byte signatures: a pair at the threshold
shares no band with a chance of at most ``MISS`` (1e-6) and falls under the
signatures' margin of five standard deviations with one of 3e-7, pairs above it
with less; each link found is confirmed on full sets.  Minimum and maximum of
one permutation never stand in one band: for a small set their agreement is
less likely together than apart, which makes a miss of both bands less likely.

Nulls and empty texts: a document without words has no shingles and is alone
in its component.  A null id takes no part in the minimum, but its row in the
links.  Repeated rows give repeated results; an empty table gives no rows.  The
sketches of very long texts cost memory in proportion to the one text (see
``_text``).  Other input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._scratch import Scratch
from tessella.llm._text import U64, mix64, shingles, slices, stream, word_hashes
from tessella.llm.components import components

BLOCK = 1024
#: Shingles of a block's side, 16 MB; one class with more is a side of its own size.
BLOCK_ITEMS = 1 << 21
#: Full sets that go to a Python worker at once.
SETS_AT_ONCE = 128
_OTHER = stream(5, 1)[0]
MISS = 1e-6
#: Node ids up to which the candidates' list is broadcast: 8 bytes each, 16 MB at most.
BROADCAST_ROWS = 2_000_000


@dataclass(frozen=True)
class Plan:
    """Settings of one run, all derived from the threshold (in percent)."""

    percent: int
    words: int = 5
    permutations: int = 128

    @property
    def rows(self) -> int:
        """The most values a band can have while the signature still misses at most ``MISS`` at the threshold."""
        j, n = self.percent / 100, 2 * self.permutations
        fits = [r for r in range(1, 9) if math.ceil(math.log(MISS) / math.log(1 - j**r)) * r <= n // 2]
        return max(fits, default=1)

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def least_equal(self) -> int:
        """Equal one-byte values (of 2 P) below which a pair is not looked at: five standard deviations under the threshold.

        Values that differ have equal bytes with a chance of 1 in 256.
        """
        n, j = 2 * self.permutations, self.percent / 100
        j += (1 - j) / 256
        return math.floor(n * j - 5 * math.sqrt(n * j * (1 - j)))


def min_max(sh: np.ndarray, at: np.ndarray, permutations: int) -> np.ndarray:
    """Signatures (texts x 2 P): minima of half of the permutations, their maxima, then the others'; zeros without shingles.

    Bands take columns in order, half of them at most, so they hold minima and
    maxima alike, and never both of one permutation (unless a single band does).
    """
    odd, flip = stream(3, permutations) | U64(1), stream(4, permutations)
    out = np.zeros((len(at) - 1, 2 * permutations), U64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        begins = at[:-1][full]
        half = permutations // 2
        for p in range(permutations):
            v = (sh ^ flip[p]) * odd[p]
            at = p if p < half else p + half
            out[full, at] = np.minimum.reduceat(v, begins)
            out[full, at + (half if p < half else permutations - half)] = np.maximum.reduceat(v, begins)
    return out


def band_keys(signatures: np.ndarray, plan: Plan) -> np.ndarray:
    r = plan.rows
    keys = np.empty((len(signatures), plan.bands), U64)
    for b in range(plan.bands):
        values = mix64(signatures[:, b * r : (b + 1) * r]) * (stream(50, r) | U64(1))
        keys[:, b] = mix64(values.sum(axis=1, dtype=U64) + stream(51, b + 1)[b])
    return keys


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    for a, b, raw, offsets in slices(texts):
        sh, at = shingles(*word_hashes(raw, offsets), k)
        yield a, b, sh, at, [np.unique(sh[at[i] : at[i + 1]]) for i in range(b - a)]


def _set_keys(sets: list[np.ndarray]) -> list[pa.Array]:
    """A 128-bit key of each set of shingles in two columns; null for an empty set."""
    out = np.zeros((2, len(sets)), U64)
    for i, s in enumerate(sets):
        out[0, i], out[1, i] = np.sum(mix64(s), dtype=U64), np.sum(mix64(s ^ _OTHER), dtype=U64)
    empty = np.array([not len(s) for s in sets], bool)
    return [pa.array(mix64(row).view(np.int64), mask=empty) for row in out]


def _sketch(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sh, at, sets in _sets(batch["text"], plan.words):
                sig = min_max(sh, at, plan.permutations)
                n = b - a
                counts = np.array([len(s) for s in sets], np.int64)
                flat = pa.array(band_keys(sig, plan).view(np.int64).ravel())
                low = np.ascontiguousarray((mix64(sig) & U64(255)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(a, n),
                        batch["__row1"].slice(a, n),
                        batch["__row2"].slice(a, n),
                        pa.array(counts),
                        *_set_keys(sets),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * plan.bands), flat),
                        pa.array([row.tobytes() for row in low], pa.binary()),
                    ],
                    ["doc_id", "__row1", "__row2", "n_shingles", "k1", "k2", "bands", "sig"],
                )

    return run


def _full_sets(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, _, sets in _sets(batch["text"], plan.words):
                full = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [*_set_keys(full), pa.array([s.tobytes() for s in full], pa.binary())], ["k1", "k2", "items"]
                )

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets without repeats have 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    merged = np.concatenate([a, b])
    merged.sort(kind="stable")
    both = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sieve(plan: Plan):
    """Pairs whose signatures are near enough; ``a`` and ``b`` are their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, 2 * plan.permutations) for c in ("a", "b"))
            near = np.count_nonzero(a == b, axis=1) >= plan.least_equal
            yield batch.select(["u", "v", "items"]).filter(pa.array(near))

    return run


def _confirm(percent: int):
    """Rows ``(u, chunk, node, centre, items)`` of stars, each chunk's centre first, to links of the centre; one centre is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held = None, np.zeros(0, U64)
        for batch in batches:
            links = []
            for u, chunk, node, first, items in zip(*(batch[c].to_pylist() for c in ("u", "chunk", "node", "centre")), batch["items"], strict=True):
                own = np.frombuffer(items.as_buffer(), U64)
                if first:
                    centre, held = (u, chunk), own.copy()
                elif (u, chunk) != centre:
                    raise ValueError("a member came before its centre")
                elif similar(held, own, percent):
                    links.append((u, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def _stars(members: DataFrame, wanted: DataFrame, sets: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """Links between the classes of a bucket and its smallest: ``u, v``."""
    small, large = F.least("items", "head_items"), F.greatest("items", "head_items")
    pairs = members.where((F.col("node") != F.col("head")) & (100 * small >= plan.percent * large))
    pairs = pairs.select(F.col("head").alias("u"), F.col("node").alias("v"), "items").distinct()
    signed = lambda key, name: wanted.select(F.col("node").alias(key), F.col("sig").alias(name))
    near = pairs.join(signed("u", "a"), "u").join(signed("v", "b"), "v").mapInArrow(_sieve(plan), "u long, v long, items long")
    near = scratch.cut(near, "near")
    sizes = near.groupBy("u").agg(F.ceil(F.sum("items") / BLOCK_ITEMS).cast("int").alias("chunks"))
    sizes = scratch.cut(sizes, "sizes")  # so that Spark can split the join of a centre with many members
    dealt = near.join(sizes, "u").select("u", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int").alias("chunk"), F.col("v").alias("node"), F.lit(False).alias("centre"))
    centres = sizes.select("u", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("u").alias("node"), F.lit(True).alias("centre"))
    rows = dealt.union(centres).join(sets.select("node", F.col("items").alias("items")), "node")
    rows = rows.repartition("u", "chunk").sortWithinPartitions("u", "chunk", F.desc("centre")).select("u", "chunk", "node", "centre", "items")
    links = scratch.cut(rows.mapInArrow(_confirm(plan.percent), "u long, v long").hint("rebalance"), "links", SETS_AT_ONCE)
    scratch.drop(near, sizes)
    return links


def _open_rows(plan: Plan):
    """The classes of a block whose signature comes near that of a class of another component."""

    def run(table: pa.Table) -> pa.Table:
        label, few = table["label"].to_numpy(), table["few"].to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(label), -1)
        cols = np.flatnonzero(~few)
        near = np.zeros(len(label), bool)
        for i in np.flatnonzero(few):
            hit = cols[label[cols] != label[i]]
            hit = hit[np.count_nonzero(sig[hit] == sig[i], axis=1) >= plan.least_equal]
            near[hit] = True
            near[i] |= len(hit) > 0
        return table.filter(pa.array(near))

    return run


def _compare_block(plan: Plan):
    """A spanning forest of new links between the classes of a block's two sides."""

    def run(table: pa.Table) -> pa.Table:
        label, few = table["label"].to_pylist(), table["few"].to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(label), -1)
        items = [np.frombuffer(x.as_buffer(), U64) for x in table["items"]]
        up = {x: x for x in label}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        cols = np.flatnonzero(~few)
        links = []
        for i in np.flatnonzero(few):
            for j in cols[np.count_nonzero(sig[cols] == sig[i], axis=1) >= plan.least_equal]:
                if top(label[i]) != top(label[j]) and similar(items[i], items[j], plan.percent):
                    up[top(label[i])] = top(label[j])
                    links.append((label[i], label[j]))
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

    return run


def _blocks(labelled: DataFrame, scratch: Scratch) -> DataFrame:
    """``labelled(bucket, node, items, label)``, of buckets that hold several labels, dealt to blocks ``(bucket, lo, hi)``.

    A block's side ``few`` is a part of the classes outside the bucket's largest
    component, the other side a part of all classes of the bucket.
    """
    sums = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("items").alias("items"))
    sides = sums.groupBy("bucket").agg(
        F.max(F.struct("n", "label"))["label"].alias("largest"),
        F.sum("n").alias("n"), F.sum("items").alias("items"),
        (F.sum("n") - F.max("n")).alias("n_few"),
        (F.sum("items") - F.max(F.struct("n", "label", "items"))["items"]).alias("items_few"),
    )
    parts = lambda n, items: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(items) / BLOCK_ITEMS)).cast("int")
    mixed = sides.select("bucket", "largest", parts("n_few", "items_few").alias("rows"), parts("n", "items").alias("cols"))
    own = labelled.join(scratch.cut(mixed, "mixed"), "bucket").drop("items")
    place = lambda name: F.pmod(F.xxhash64("node"), F.col(name)).cast("int")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    few = own.where("label <> largest").select("bucket", place("rows").alias("lo"), each("cols").alias("hi"), F.lit(True).alias("few"), "node", "label")
    every = own.select("bucket", each("rows").alias("lo"), place("cols").alias("hi"), F.lit(False).alias("few"), "node", "label")
    return few.union(every)


def _keys(docs: DataFrame) -> DataFrame:
    """``docs`` with a 128-bit key of id and text in two columns: equal for repeated rows alone, also among those without an id."""
    key = [F.col("doc_id").cast("long"), "text"]
    return docs.withColumns({"__row1": F.xxhash64(*key), "__row2": F.xxhash64(F.lit(1), *key)})


def _labelled(docs: DataFrame, plan: Plan, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Sketches of the rows of ``docs(doc_id, text, __row1, __row2)``, and ``k1, k2, least, label`` of each class.

    ``least`` is the row that stands for the class: by id, those without one
    last, then by key.  Classes of one component have one label.
    """
    sketch = scratch.cut(
        docs.mapInArrow(_sketch(plan), "doc_id long, __row1 long, __row2 long, n_shingles long, k1 long, k2 long, bands array<long>, sig binary"), "sketch"
    )
    nodes = scratch.cut(
        sketch.where("k1 is not null")
        .groupBy("k1", "k2")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row1", "__row2")).alias("least"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("n_shingles").alias("items"))
        .withColumn("node", F.monotonically_increasing_id()),  # fixed by the write
        "nodes",
    )
    bands = nodes.select("node", "items", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("head"), F.min_by("items", "node").alias("head_items")).where("n > 1")
    # what is joined by bucket is written before, here and below, so that Spark can split the join of a bucket with many classes
    members = scratch.cut(bands.join(scratch.cut(shared, "shared"), "bucket"), "members")

    wanted = scratch.cut(members.select("node").distinct().join(nodes, "node").select("node", "k1", "k2", "least", "sig"), "wanted")
    rows = wanted.select(F.col("least.__row1").alias("__row1")).distinct()
    rows = F.broadcast(rows) if wanted.count() <= BROADCAST_ROWS else rows
    found = docs.join(rows, "__row1", "left_semi").select("doc_id", "text").mapInArrow(_full_sets(plan), "k1 long, k2 long, items binary")
    found = found.groupBy("k1", "k2").agg(F.first("items").alias("items"))
    sets = scratch.cut(found.join(wanted, ["k1", "k2"]).select("node", "items", "sig"), "sets")

    stars = _stars(members, wanted, sets, plan, scratch)
    first = components(stars, scratch)

    labelled = members.join(first, "node", "left").select("bucket", "node", "items", F.coalesce("label", "node").alias("label"))
    several = labelled.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("bucket")
    blocks = _blocks(scratch.cut(labelled.join(scratch.cut(several, "several"), "bucket"), "labelled"), scratch)
    signed = blocks.join(wanted.select("node", "sig"), "node").select(*blocks.columns, "sig")
    near = scratch.cut(signed.groupBy("bucket", "lo", "hi").applyInArrow(_open_rows(plan), signed.schema), "near")
    ready = near.join(sets.select("node", "items"), "node")
    rest = scratch.cut(ready.groupBy("bucket", "lo", "hi").applyInArrow(_compare_block(plan), "u long, v long").hint("rebalance"), "links")
    merged = components(rest, scratch)
    final = (
        nodes.select("node", "k1", "k2", "least")
        .join(first, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
        .join(merged.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left")
        .select("k1", "k2", "least", F.coalesce("top", "label").alias("label"))
    )
    scratch.drop(members, wanted, sets, stars, near, rest)
    return sketch, final


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``.

    Two documents are linked when 100 * intersection >= percent * union of
    their sets of shingles of ``words`` words.
    """
    docs = _keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    sketch, final = _labelled(docs, Plan(percent, words), Scratch(docs.sparkSession, "minhash"))
    named = final.join(final.groupBy("label").agg(F.min("least.doc_id").alias("component_id")), "label").select("k1", "k2", "component_id")
    out = sketch.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(False)).alias("kept"),
    )


def survivors(docs: DataFrame, percent: int = 85, words: int = 5) -> DataFrame:
    """One row of ``docs`` for each component, whole: the one of the smallest id, one without an id only where no other is.

    Rows without words are alone in their components; of those that repeat id
    and text one stays.
    """
    keyed = _keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    sketch, final = _labelled(keyed, Plan(percent, words), Scratch(docs.sparkSession, "minhash"))
    best = final.groupBy("label").agg(F.min("least").alias("least")).select("least.__row1", "least.__row2")
    alone = sketch.where("k1 is null").select("__row1", "__row2")
    whole = _keys(docs).dropDuplicates(["__row1", "__row2"])
    return whole.join(best.union(alone), ["__row1", "__row2"], "left_semi").select(docs.columns)
