"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Fit (driver, bounded): at most ``SAMPLE_ROWS`` vectors and ``SAMPLE_BYTES``
bytes, taken by hash, give a mean and principal axes, ``MOST_BITS`` at most; the
first ``LEARN_ROWS`` of them in a seeded order teach rotations that make
balanced binary codes (iterative quantisation from several random starts).
Each code is cut into substrings of ``k`` bits; every substring is a table of
the index, so two vectors whose whole codes differ in fewer bits than there are
tables must meet.  The number of tables is raised until at most ``MISS`` of
simulated pairs at the threshold share none, both of pairs that differ in random
directions and of pairs that differ as sampled vectors do; the Hamming bound is
taken from the same pairs, six standard deviations beyond their mean.

Search (distributed): every vector enters every table.  Buckets are compared in
blocks by the Hamming distance of whole codes; a pair is judged in the first
table it shares.  Rows with such a pair are compared again with the original
vectors in double precision.  What leaves a block are the rows' numbers of links
and a spanning forest of the links, so rows do not grow with pairs.  Equal
vectors form one class, so a vector repeated any number of times is compared
once.

Vectors that are null or zero or hold null or non-finite components link with
nothing, nor do vectors of different lengths with each other.  Each vector is
scaled by a power of two before it is measured, so that very small and very
large ones have their cosines too.  A null id takes no part in minima.  Repeated
rows count as further vectors; an empty table gives no rows.
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
from tessella.llm.components import components

SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 32 << 20
BLOCK = 1024
STRIP = 256
MISS = 1e-4
MOST_TABLES = 192
#: Principal axes that codes see of wider vectors; the comparison itself uses all components.
MOST_BITS = 256
LEARN_ROWS = 4000
#: Vectors that share a bucket by chance; up to so many vectors there is one table of no bits, which is a full comparison.
OCCUPANCY = 32
PROBES = 20_000
SEED = 20_241


@dataclass(frozen=True)
class Index:
    """A fitted model: codes are signs of ``(x / |x| - mean) @ axes @ rotation``."""

    mean: np.ndarray
    rotations: list[np.ndarray]
    bits: int
    tables: int
    reach: int

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Rows by tables: the substrings of the codes as numbers."""
        if not self.bits:
            return np.zeros((len(x), 1), np.uint32)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True) - self.mean
        return np.hstack([substrings(unit, r, self.bits) for r in self.rotations])[:, : self.tables]

    def packed(self, x: np.ndarray) -> list[bytes]:
        """The same substrings as bytes, ``bits`` bits each."""
        bits = (self.keys(x)[:, :, None] >> np.arange(self.bits, dtype=np.uint32) & 1).astype(np.uint8)
        return [row.tobytes() for row in np.packbits(bits.reshape(len(x), -1), axis=1)]

    def unpacked(self, codes: list[bytes]) -> np.ndarray:
        if not self.bits:
            return np.zeros((len(codes), 1), np.uint32)
        raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        bits = np.unpackbits(raw, axis=1)[:, : self.tables * self.bits].reshape(len(codes), self.tables, self.bits)
        return bits.astype(np.uint32) @ (1 << np.arange(self.bits, dtype=np.uint32))


def substrings(centred: np.ndarray, rotation: np.ndarray, bits: int) -> np.ndarray:
    """The signs of rotated vectors in numbers of ``bits`` bits; bits that do not fill a number are left out."""
    each = rotation.shape[1] // bits
    signs = (centred @ rotation >= 0)[:, : each * bits].reshape(len(centred), each, bits)
    return (signs * (1 << np.arange(bits, dtype=np.uint32))).sum(axis=2, dtype=np.uint32)


def quantise(v: np.ndarray, rng: np.random.Generator, rounds: int = 25) -> np.ndarray:
    """A rotation that brings ``v``, projected and centred, close to its own signs."""
    r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return r


def fit(sample: np.ndarray, total: int, least_cos: float) -> Index:
    """An index for ``total`` vectors of which ``sample`` (rows, not zero) is a part."""
    most_bits = max(0, math.ceil(math.log2(max(total, 1) / OCCUPANCY)))
    if not most_bits:
        return Index(sample[0], [], 0, 1, 0)
    rng = np.random.default_rng(SEED)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    centred = unit - mean
    d = unit.shape[1]
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, : min(d, MOST_BITS)]
    # pairs exactly at the threshold, first in random directions, then in directions in which the vectors differ
    base = np.vstack([unit[rng.integers(0, len(unit), PROBES)]] * 2)
    off = np.vstack([rng.standard_normal((PROBES, d)), unit[rng.integers(0, len(unit), PROBES)] - base[PROBES:]])
    off -= (off * base).sum(axis=1, keepdims=True) * base
    length = np.linalg.norm(off, axis=1, keepdims=True)
    off = np.divide(off, length, out=np.zeros_like(off), where=length > 1e-9)
    mate = least_cos * base + math.sqrt(1 - least_cos**2) * off
    learn = (centred @ axes)[rng.permutation(len(centred))[:LEARN_ROWS]]
    share = lambda lost: max(lost[:PROBES].mean(), lost[PROBES:].mean())
    rotations: list[np.ndarray] = []
    for bits in range(min(axes.shape[1], most_bits), 0, -1):
        missed = np.ones(len(base), bool)
        codes: list[tuple[np.ndarray, np.ndarray]] = []
        tables = 0
        while tables < MOST_TABLES and share(missed) > MISS:
            if len(rotations) == len(codes):
                rotations.append(axes @ quantise(learn, rng))
            codes.append(tuple(substrings(x - mean, rotations[len(codes)], bits) for x in (base, mate)))
            for a, b in zip(codes[-1][0].T, codes[-1][1].T, strict=True):
                if share(missed) > MISS:
                    missed &= a != b
                    tables += 1
        if share(missed) <= MISS or bits == 1:
            a, b = (np.hstack(x)[:, :tables] for x in zip(*codes, strict=True))
            apart = np.bitwise_count(a ^ b).sum(axis=1)
            reach = max(int(apart.max()), *(math.ceil(x.mean() + 6 * x.std()) for x in (apart[:PROBES], apart[PROBES:])))
            return Index(mean, rotations[: len(codes)], bits, tables, reach)
    raise AssertionError


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector as bytes of float32 or float64 (as it came), null where it can link with nothing."""
    for batch in batches:
        x = batch["embedding"]
        wide = pa.types.is_float64(x.type.value_type)
        out = []
        for v in x:
            a = None if v.as_py() is None else v.values.to_numpy(zero_copy_only=False).astype(np.float64 if wide else np.float32)
            ok = a is not None and len(a) and np.isfinite(a).all() and a.any()
            out.append((a + 0).tobytes() if ok and v.values.null_count == 0 else None)
        yield pa.RecordBatch.from_arrays(
            [batch["vec_id"], pa.array(out, pa.binary()), pa.array([8 if wide else 4] * len(out), pa.int32())], ["vec_id", "raw", "width"]
        )


def _matrix(raw: list[bytes], width: int) -> np.ndarray:
    """The vectors in double precision, each scaled by a power of two to a largest component from 0.5 to 1."""
    x = np.frombuffer(b"".join(raw), np.float64 if width == 8 else np.float32).reshape(len(raw), -1).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _enter(index: Index, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = index.keys(_matrix(batch["raw"].to_pylist(), width))
            n, t = keys.shape
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch["node"].to_numpy(), t)),
                    pa.array(np.tile(np.arange(t, dtype=np.int32), n)),
                    pa.array(keys.ravel().astype(np.int64)),
                ],
                ["node", "place", "key"],
            )

    return run


def _codes(index: Index, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = index.packed(_matrix(batch["raw"].to_pylist(), width)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(codes, pa.binary())], ["node", "code"])

    return run


class _Block:
    """The rows of one pair of chunks of a bucket, and which of their pairs it has to judge."""

    def __init__(self, table: pa.Table, index: Index) -> None:
        self.node, chunk = table["node"].to_numpy(), table["chunk"].to_numpy()
        lo, hi, self.place = (table[c][0].as_py() for c in ("lo", "hi", "place"))
        self.codes = index.unpacked(table["code"].to_pylist())
        self.left, self.right, self.same, self.reach = np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi), lo == hi, index.reach

    def strips(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of the left chunk, ``STRIP`` at a time, and which rows of the right one each has to be compared with.

        Those are within reach and share no earlier table; each pair comes once.
        """
        for at in range(0, len(self.left), STRIP):
            rows = self.left[at : at + STRIP]
            ok = np.ones((len(rows), len(self.right)), bool)
            if self.same:
                ok = self.node[self.right] > self.node[rows][:, None]
            for t in range(self.place):
                ok &= self.codes[rows, t][:, None] != self.codes[self.right, t]
            i, j = np.nonzero(ok)
            apart = np.zeros(len(i), np.int32)
            for t in range(self.codes.shape[1]):
                apart += np.bitwise_count(self.codes[rows[i], t] ^ self.codes[self.right[j], t])
            ok[i, j] = apart <= self.reach
            yield rows, ok


def _near(index: Index):
    """The rows of a block that have a pair to judge."""

    def run(table: pa.Table) -> pa.Table:
        block = _Block(table, index)
        found = np.zeros(table.num_rows, bool)
        for rows, ok in block.strips():
            found[rows] |= ok.any(axis=1)
            found[block.right] |= ok.any(axis=0)
        return table.filter(pa.array(found))

    return run


def _links(least_cos: float, width: int, index: Index):
    """Measured in double precision: how many vectors each row links with (``n``), and a spanning forest of the links (``v``)."""

    def run(table: pa.Table) -> pa.Table:
        block = _Block(table, index)
        copies = table["copies"].to_numpy()
        x = _matrix(table["raw"].to_pylist(), width)
        norm = np.sqrt((x * x).sum(axis=1))
        others = np.zeros(len(x), np.int64)
        label = np.arange(len(x))
        forest = []
        for rows, ok in block.strips():
            ok &= x[rows] @ x[block.right].T / np.outer(norm[rows], norm[block.right]) >= least_cos
            others[rows] += ok @ copies[block.right]
            others[block.right] += copies[rows] @ ok
            for i, near in zip(rows, ok, strict=True):
                to = block.right[near]
                for j in to[np.unique(label[to], return_index=True)[1]]:
                    if label[j] != label[i]:
                        label[label == label[j]] = label[i]
                        forest.append((block.node[i], block.node[j]))
        at = np.flatnonzero(others)
        u, v = np.array(forest, np.int64).reshape(-1, 2).T
        return pa.table(
            {
                "u": pa.array(np.concatenate([block.node[at], u]), pa.int64()),
                "v": pa.array([*[None] * len(at), *v.tolist()], pa.int64()),
                "n": pa.array([*others[at].tolist(), *[None] * len(u)], pa.int64()),
            }
        )

    return run


def near_vectors(vectors: DataFrame, least_cos: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    kind = "double" if "double" in dict(vectors.dtypes)["embedding"] else "float"
    width = 8 if kind == "double" else 4
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    rows = scratch.cut(plain.mapInArrow(_classes, "vec_id long, raw binary, width int").drop("width"), "rows")
    nodes = scratch.cut(
        rows.where("raw is not null")
        .groupBy("raw")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("node", F.monotonically_increasing_id()),  # fixed by the write
        "nodes",
    )
    links = spark.createDataFrame([], "u long, v long, n long")
    for size, total in nodes.groupBy(F.length("raw")).count().collect():  # one row for each length of vector
        part = nodes.where(F.length("raw") == size)
        take = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // size))
        # about 1.2 times what is wanted goes on to be ordered, however many partitions there are
        share = math.ceil(min(1.0, 1.2 * take / total) * 2**32)
        drawn = part.where(F.pmod(F.xxhash64("raw"), F.lit(2**32)) < share)
        sample = drawn.orderBy(F.xxhash64("raw"), "raw").limit(take).select("raw").collect()
        index = fit(_matrix([bytes(r.raw) for r in sample], width), total, least_cos)
        entries = scratch.cut(part.select("node", "raw").mapInArrow(_enter(index, width), "node long, place int, key long"), "entries")
        shared = entries.groupBy("place", "key").agg(F.count("*").alias("n")).where("n > 1")
        codes = part.select("node", "raw").mapInArrow(_codes(index, width), "node long, code binary")
        chunks = F.ceil(F.col("n") / BLOCK).cast("int")
        blocks = (
            entries.join(shared, ["place", "key"])
            .join(codes, "node")
            .select("place", "key", "node", "code", F.pmod(F.xxhash64("node"), chunks).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("row"))
            .withColumns({"lo": F.least("chunk", "row"), "hi": F.greatest("chunk", "row")})
        )
        by = ["place", "key", "lo", "hi"]
        near = scratch.cut(blocks.groupBy(*by).applyInArrow(_near(index), blocks.schema), "near")
        ready = near.join(part.select("node", "copies", "raw"), "node")
        links = links.union(ready.groupBy(*by).applyInArrow(_links(least_cos, width, index), links.schema).hint("rebalance"))
    links = scratch.cut(links, "links")
    degree = links.where("n is not null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    final = (
        nodes.join(degree, "node", "left")
        .join(components(links.where("v is not null").select("u", "v"), scratch), "node", "left")
        .select("raw", "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("label", "node").alias("label"))
    )
    final = scratch.cut(final, "final")
    named = final.join(final.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("raw", "n_links", "component_id")
    component = F.coalesce("component_id", "vec_id")
    return rows.join(named, "raw", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
