"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names.

A job that loses an executor rereads the tables written here instead of
recomputing its whole lineage.  A table is deleted once a later one replaces
it; what is left goes when the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_roots: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="scratch-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one run of an operator."""

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self.written = 0
        _roots.append((spark, self.root))

    def cut(self, df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
        """Write ``df`` and return the written table.

        ``batch_rows`` bounds the rows of an Arrow batch during this write, for
        rows so large that the session's bound would hold too many at once.
        """
        path = f"{self.root}/{self.written:03d}-{name}"
        self.written += 1
        before = self.spark.conf.get(_BATCH_ROWS)
        if batch_rows:
            self.spark.conf.set(_BATCH_ROWS, batch_rows)
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_BATCH_ROWS, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later result reads."""
        for table in tables:
            _delete(self.spark, table._scratch_path)


@atexit.register
def _clean() -> None:
    for spark, root in _roots:
        try:
            _delete(spark, root)
        except Exception:  # the session has ended already; its folder is the cluster's to clear
            continue
