"""Token counts by source, language and tokenizer version, kept up by signed deltas.

A batch of deltas holds inserts (+), deletes (-) and revised counts (the old
count with -, the new one with +).  Each batch is summed by key, written to a
folder that nobody reads, and committed by renaming that folder to the batch's
name, so of two writers of one id one commits and the other finds it committed.
Applying an id again changes nothing, also with other contents, unless
``verify`` is set, which raises there.  A batch that died half-way left nothing
that counts.  ``compact`` sums what is committed into a base, so totals read the
latest base and the batches it does not cover.

Batch ids are letters, digits, ``_``, ``.`` and ``-``, beginning with a letter or
digit; others raise.  A null source or language is a key of its own (null); a null text has no
tokens but counts as a document; an empty batch commits and adds nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._tokens import byte_bpe, default_path

KEYS = ("source", "lang", "tokenizer_version")
SUMS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def counted(docs: DataFrame, tokenizer_version: str, tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id, source, lang, tokenizer_version, n_tokens`` of each row of ``docs(doc_id, text, source, lang)``."""
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(path)
        for batch in batches:
            n = [len(encoder.encode(t.as_py() or "")) for t in batch["text"]]
            rest = [batch[c] for c in ("doc_id", "source", "lang")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64())], ["doc_id", "source", "lang", "n_tokens"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")))
    out = plain.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long")
    return out.withColumn("tokenizer_version", F.lit(tokenizer_version))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas that take the counts of ``old`` back and put those of ``new`` in their place."""
    return deletes(old).unionByName(inserts(new))


def worded(docs: DataFrame, tokenizer_version: str, pattern: str) -> DataFrame:
    """The same columns as ``counted``, with matches of a pattern for tokens."""
    n = F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)).cast("long")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang")), n.alias("n_tokens"))
    return plain.withColumn("tokenizer_version", F.lit(tokenizer_version))


class Rollup:
    """Totals under ``root``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, prefix: str) -> list[str]:
        """What follows ``prefix`` in the names of committed folders."""
        root = self._path(self.root)
        found = [s.getPath().getName() for s in self.fs.listStatus(root)] if self.fs.exists(root) else []
        return sorted(n.removeprefix(prefix) for n in found if n.startswith(prefix))

    def _commit(self, made: str, name: str) -> bool:
        """Rename a written folder; False if the name is taken."""
        target = self._path(f"{self.root}/{name}")
        done = not self.fs.exists(target) and self.fs.rename(self._path(made), target)
        # a rename into a folder that came to be in the meantime lands inside it
        inside = self._path(f"{self.root}/{name}/{made.rpartition('/')[2]}")
        if done and self.fs.exists(inside):
            done = False
            self.fs.delete(inside, True)
        if not done:
            self.fs.delete(self._path(made), True)
        return done

    def committed(self, batch_id: str) -> bool:
        return self.fs.exists(self._path(f"{self.root}/batch={batch_id}"))

    def apply(self, batch_id: str, deltas: DataFrame, verify: bool = False) -> bool:
        """Commit a batch; False if it was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        if self.committed(batch_id):
            if verify:
                held = self.spark.read.schema(SUMS).parquet(f"{self.root}/batch={batch_id}")
                if sums.exceptAll(held).union(held.exceptAll(sums)).take(1):
                    raise ValueError(f"batch {batch_id} was committed with other contents")
            return False
        made = f"{self.root}/_open-{uuid.uuid4().hex}"
        sums.write.parquet(made)
        return self._commit(made, f"batch={batch_id}")

    def batches(self) -> list[str]:
        """Ids of committed batches."""
        return self._names("batch=")

    def _base(self) -> tuple[str | None, set[str]]:
        """The latest base and the ids it covers."""
        found = sorted(self._names("base="), key=int)
        if not found:
            return None, set()
        base = f"{self.root}/base={found[-1]}"
        return base, {r.batch for r in self.spark.read.schema("batch string").parquet(f"{base}/covers").collect()}

    def compact(self) -> bool:
        """Sum all committed batches into a new base; False if another writer made one meanwhile."""
        ids = self.batches()
        sums = self._sums(ids)
        number = max(map(int, self._names("base=")), default=0) + 1
        made = f"{self.root}/_open-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(b,) for b in ids], "batch string").write.parquet(f"{made}/covers")
        sums.write.parquet(f"{made}/sums")
        return self._commit(made, f"base={number}")

    def _sums(self, ids: list[str]) -> DataFrame:
        base, covered = self._base()
        paths = [f"{base}/sums"] * (base is not None) + [f"{self.root}/batch={b}" for b in ids if b not in covered]
        rows = self.spark.read.schema(SUMS).parquet(*paths) if paths else self.spark.createDataFrame([], SUMS)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """Sums over all committed batches; keys whose documents have all gone are left out."""
        return self._sums(self.batches()).where("n_docs <> 0 or n_tokens <> 0")
