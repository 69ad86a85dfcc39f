"""Intermediate tables in the folder that driver and executors share.

A table written here is read by later jobs instead of being computed again, and
a job that loses an executor rereads it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a temporary folder only in local mode without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='tables-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(table: DataFrame, name: str) -> DataFrame:
    """``table`` computed once: written under the shared folder and read again."""
    spark = table.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended already; its folder is the cluster's to clear
            continue
