"""Packing by lexical retrieval over a sharded BM25 index.

1. Documents become token ids with an end id and are written once, with a place
   each: ``_routing`` puts documents of like vocabulary close together.  Its
   router is fitted on about ``ROUTE_SAMPLE`` documents; every document is
   placed.  The same pass counts in how many documents each token id occurs.
2. The written documents are dealt by ranges of (place, row) and ordered, so a
   group of equal documents of any size is cut into ranges like any other rows.
   Runs of ``SHARD_TOKENS`` ids (or one longer document) are the shards of the
   index; a task streams its shards, so memory does not grow with the input.
3. A shard's inverted index holds all of its documents' terms, weighted by the
   document counts of the whole table.  A document's query is all of its
   distinct ids, however frequent.  The next unused document seeds a window; its best
   unused neighbours fill the window, first those that fit whole, then the best
   one cut to the room left, whose rest opens the next window.  What is left at
   the end of a shard opens the next shard's first window; a task's last window
   is cut at powers of two, which need no padding.

A seed asks the shard of its place, not all shards: each document shares terms
with nearly all others, so asking all would cost the square of the input.

A null text counts as empty: its only id is the end id.  A null id stays null.
Repeated rows are packed each for itself.  Ties go by row.  Very long texts are
shards of their own.  An empty table gives no rows; other columns are ignored.
Every id of every document lies in exactly one piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import _routing
from tessella.llm._scratch import Scratch
from tessella.llm._tokens import byte_bpe, default_path

END = 0
WINDOW = 1024
SHARD_TOKENS = 1 << 20
#: Ids in a task where there are more tasks than twice the cores.
TASK_TOKENS = 1 << 26
#: Documents, about, that the router is fitted on.
ROUTE_SAMPLE = 1024
ROUTE_SEED = 11
#: Documents that are placed at once.
PLACED = 256
#: A term that more than one in so many documents of a shard holds is scored for all of them at once, by a matrix product,
DENSE = 10
#: in shards of at most so many documents; elsewhere all scores come from postings.
DENSE_DOCS = 2048
K1, B = 1.2, 0.75
TOKENS = "doc_id long, place long, n_ids long, ids binary, counts array<long>"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Corpus:
    """What BM25 needs to know of all documents: their number, their mean length, and each term's document count."""

    n: int
    mean: float
    df: np.ndarray


def corpus_of(docs: list[np.ndarray]) -> Corpus:
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]))
    return Corpus(len(docs), float(np.mean([len(d) for d in docs])), df)


class Bm25:
    """An inverted index of a shard: for each term its documents with BM25 weights of the whole ``corpus``."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None) -> None:
        corpus = corpus or corpus_of(docs)
        n = len(docs)
        sizes = np.array([len(d) for d in docs], np.int64)
        pairs = np.concatenate(docs).astype(np.int64) << 32 | np.repeat(np.arange(n), sizes)
        pairs.sort()
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        tf = np.diff(np.append(first, len(pairs)))
        terms, self.docs = pairs[first] >> 32, pairs[first] & 0xFFFFFFFF
        self.terms, self.begin, df = np.unique(terms, return_index=True, return_counts=True)
        self.end = self.begin + df
        held = corpus.df[self.terms]
        idf = np.log1p((corpus.n - held + 0.5) / (held + 0.5))
        norm = K1 * (1 - B + B * sizes / corpus.mean)
        # in steps of 2^-32, so that sums are exact in any order and equal documents get equal scores
        self.weight = np.rint(np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.docs]) * 2.0**32) / 2.0**32
        # each document's query: its terms that another document has too
        useful = df > 1
        dense = useful & (DENSE * df > n) & (n <= DENSE_DOCS)
        term_of = np.repeat(np.arange(len(df)), df)
        at = np.flatnonzero((useful & ~dense)[term_of])
        at = at[np.argsort(self.docs[at], kind="stable")]
        self.start = np.searchsorted(self.docs[at], np.arange(n + 1))
        self.query = term_of[at]
        self.scores = None
        if dense.any():
            at = np.flatnonzero(dense[term_of])
            weights = np.zeros((n, int(dense.sum())))
            weights[self.docs[at], (np.cumsum(dense) - 1)[term_of[at]]] = self.weight[at]
            self.scores = (weights > 0).astype(np.float64) @ weights.T
        self.size = n

    def score(self, doc: int) -> np.ndarray:
        """BM25 scores of all documents for all terms of ``doc``."""
        score = np.zeros(self.size) if self.scores is None else self.scores[doc].copy()
        terms = self.query[self.start[doc] : self.start[doc + 1]]
        if len(terms):
            begin, size = self.begin[terms], self.end[terms] - self.begin[terms]
            at = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
            score += np.bincount(self.docs[at], self.weight[at], minlength=self.size)
        return score

    def neighbours(self, doc: int, free: np.ndarray) -> np.ndarray:
        """Other documents among ``free`` that share a term, best first; ties by position."""
        score = self.score(doc)
        score[doc] = 0
        hit = np.flatnonzero((score > 0) & free)
        return hit[np.argsort(-score[hit], kind="stable")]


class Packer:
    """Windows of one task; ``rows`` holds the pieces of closed windows."""

    def __init__(self, task: int, corpus: Corpus | None = None) -> None:
        self.corpus = corpus
        self.next_id = task << 33
        self.open: list[tuple[int | None, np.ndarray, int, int]] = []
        self.room = WINDOW
        self.rows: list[tuple] = []

    def place(self, doc_id: int | None, ids: np.ndarray, start: int) -> int:
        """Put ids from ``start`` on into the open window; returns where the rest starts."""
        piece = ids[start : start + self.room]
        self.open.append((doc_id, piece, start, len(ids)))
        self.room -= len(piece)
        if not self.room:
            self.close()
        return start + len(piece)

    def close(self) -> None:
        at = 0
        for doc_id, piece, start, whole in self.open:
            crc = zlib.crc32(np.ascontiguousarray(piece, "<u4").tobytes())
            self.rows.append((doc_id, start, len(piece), crc, whole, self.next_id, at))
            at += len(piece)
        self.next_id += 1
        self.open, self.room = [], WINDOW

    def shard(self, docs: list[tuple[int | None, np.ndarray]]) -> None:
        """Pack all of ``docs``; the last window may stay open."""
        index = Bm25([ids for _, ids in docs], self.corpus)
        sizes = np.array([len(ids) for _, ids in docs], np.int64)
        free = np.ones(len(docs), bool)
        at, seed = 0, -1
        while True:
            if seed < 0:
                while at < len(docs) and not free[at]:
                    at += 1
                if at == len(docs):
                    return
                seed = at
            free[seed] = False
            doc_id, ids = docs[seed]
            done = 0
            while done < len(ids):
                done = self.place(doc_id, ids, done)
            if self.room == WINDOW:
                seed = -1
                continue
            near = index.neighbours(seed, free)
            fit = near[sizes[near] <= self.room]
            least = np.minimum.accumulate(sizes[fit][::-1])[::-1]  # of this and all later ones
            for d, low in zip(fit.tolist(), least.tolist(), strict=True):
                if low > self.room:
                    break
                if len(docs[d][1]) <= self.room:
                    free[d] = False
                    self.place(*docs[d], 0)
                    if self.room == WINDOW:
                        break
            near = near[free[near]]
            seed = int(near[0]) if self.room < WINDOW and len(near) else -1

    def finish(self) -> None:
        """Cut the open window at powers of two."""
        rest = self.open
        total = sum(len(piece) for _, piece, _, _ in rest)
        while total:
            self.open, self.room = [], 1 << (total.bit_length() - 1)
            total -= self.room
            while self.room:
                doc_id, piece, start, whole = rest.pop(0)
                if len(piece) > self.room:
                    rest.insert(0, (doc_id, piece[self.room :], start + self.room, whole))
                    piece = piece[: self.room]
                self.open.append((doc_id, piece, start, whole))
                self.room -= len(piece)
            self.close()


_CODEC = "zstd"


def _packed(ids: np.ndarray) -> bytes:
    """Ids as compressed bytes, two or four for each id; the first byte tells which."""
    width = 2 if ids.max() < 1 << 16 else 4
    return bytes([width]) + pa.compress(ids.astype(f"<u{width}").tobytes(), _CODEC, asbytes=True)


def _unpacked(raw: pa.Buffer, n: int) -> np.ndarray:
    width = raw[0]
    return np.frombuffer(pa.decompress(raw.slice(1), n * width, _CODEC, asbytes=True), f"<u{width}").astype(np.uint32)


def _encoded(path: str, batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    """The ids of the batch's texts, a few documents at a time."""
    encoder = byte_bpe(path)
    for at in range(0, batch.num_rows, PLACED):
        texts = batch["text"].slice(at, PLACED)
        yield [np.append(encoder.encode(t.as_py() or ""), np.uint32(END)) for t in texts]


def _features(path: str):
    """The bins of each document as bytes of bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs in _encoded(path, batch):
                rows = np.packbits(_routing.presence(docs).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], ["bins"])

    return run


def _tokens(path: str, router: _routing.Router):
    """Each document's ids and place; after a task's documents one row with its document counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "place", "n_ids", "ids", "counts"]
        counts = np.zeros(0, np.int64)
        for batch in batches:
            at = 0
            for docs in _encoded(path, batch):
                n = len(docs)
                held = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=len(counts))
                held[: len(counts)] += counts
                counts = held
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(at, n),
                        pa.array(router.places(_routing.presence(docs))),
                        pa.array([len(d) for d in docs], pa.int64()),
                        pa.array([_packed(d) for d in docs], pa.binary()),
                        pa.nulls(n, pa.list_(pa.int64())),
                    ],
                    names,
                )
                at += n
        if len(counts):
            last = [pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.binary()), pa.array([counts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(last, names)

    return run


def _pack(corpus: Corpus):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), corpus)
        shard: list[tuple[int | None, np.ndarray]] = []
        held = 0

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.rows, strict=True)) if packer.rows else [()] * 7
            packer.rows = []
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        for batch in batches:
            for doc_id, n, raw in zip(batch["doc_id"].to_pylist(), batch["n_ids"].to_pylist(), batch["ids"], strict=True):
                shard.append((doc_id, _unpacked(raw.as_buffer(), n)))
                held += n
                if held >= SHARD_TOKENS:
                    packer.shard(shard)
                    shard, held = [], 0
                    yield out()
        if shard:
            packer.shard(shard)
        packer.finish()
        yield out()

    return run


def _corpus(tokens: DataFrame, whole: DataFrame) -> Corpus:
    """Counts over all documents; the driver gets one row for each token id of the vocabulary."""
    n, total = whole.agg(F.count("*"), F.sum("n_ids")).first()
    df = np.zeros(1, np.int64)
    for row in tokens.where("counts is not null").select(F.posexplode("counts")).groupBy("pos").agg(F.sum("col").alias("n")).where("n > 0").collect():
        if row.pos >= len(df):
            df = np.pad(df, (0, row.pos + 1 - len(df)))
        df[row.pos] = row.n
    return Corpus(n, total / n if n else 1.0, df)


def pack(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """The pieces of all sequences of ``docs(doc_id, text)``.

    ``tokenizer_path`` must be readable on the workers; by default the file of
    the installed vocabulary package.
    """
    spark = docs.sparkSession
    path = tokenizer_path or default_path()
    scratch = Scratch(spark, "packing")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    share = min(1.0, ROUTE_SAMPLE / max(plain.count(), 1))
    sample = [r.bins for r in plain.sample(share, ROUTE_SEED).select("text").mapInArrow(_features(path), "bins binary").collect()]
    bits = np.frombuffer(b"".join(sample), np.uint8).reshape(len(sample), _routing.BINS // 8)
    router = _routing.fit(np.unpackbits(bits, axis=1).astype(np.float32))
    tokens = scratch.cut(plain.mapInArrow(_tokens(path, router), TOKENS).withColumn("row", F.monotonically_increasing_id()), "tokens")
    whole = tokens.where("ids is not null").select("doc_id", "place", "row", "n_ids", "ids")
    corpus = _corpus(tokens, whole)
    ids = corpus.n * corpus.mean
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, round(ids / TASK_TOKENS), min(round(ids / SHARD_TOKENS), 2 * cores))
    dealt = whole.repartitionByRange(parts, "place", "row").sortWithinPartitions("place", "row")
    return dealt.select("doc_id", "n_ids", "ids").mapInArrow(_pack(corpus), SCHEMA)
