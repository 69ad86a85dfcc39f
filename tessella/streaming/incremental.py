"""Structured Streaming: searching profiles as they arrive, and totals of an event stream."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import search


def _state_dir(spark: SparkSession) -> str:
    """A folder for a query's progress: in the shared checkpoint folder, or a temporary one in local mode without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="stream-")
    return f"{root}/stream-{uuid.uuid4().hex}"


def arrivals(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream of the Parquet files that appear under ``path``, with the columns of ``like``."""
    return spark.readStream.schema(like.schema).parquet(path)


def search_arrivals(stream: DataFrame, queries: DataFrame, key: str, vector: str, k: int, out: str, state: str, scale: float = 1.0):
    """Search each new batch of ``stream`` for ``queries``; hits are written under ``out`` by batch, so a retried batch replaces its own."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        search.top_hits(queries, rows, key, vector, k, scale).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()


def best_hits(spark: SparkSession, out: str, k: int) -> DataFrame:
    """The ``k`` best hits of each query over all batches so far."""
    from pyspark.sql import Window

    hits = spark.read.parquet(out).select("query_id", "subject_id", "score")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "subject_id")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def windowed(events: DataFrame, size: str, late: str) -> DataFrame:
    """Counts and sums of ``events(ts, event_type, value)`` by tumbling window and type; later than ``late`` is dropped."""
    by = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def event_totals(spark: SparkSession, path: str) -> DataFrame:
    """Daily totals of all events there are, computed by a stream that reads every file once and stops."""
    static = spark.read.parquet(path)
    folder, name = os.path.split(path)
    source = spark.readStream.schema(static.schema).option("pathGlobFilter", "*.parquet")
    # a file is read through its folder; a table that is a folder as it is
    single = name.endswith(".parquet") and len(static.inputFiles()) == 1 and static.inputFiles()[0].endswith(f"/{name}")
    stream = source.option("pathGlobFilter", name).parquet(folder) if single else source.parquet(path)
    state = _state_dir(spark)
    daily = windowed(stream, "1 day", "3650 days")

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{state}/out/batch={batch_id}")

    job = daily.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{state}/progress").trigger(availableNow=True).start()
    job.awaitTermination()
    rows = spark.read.parquet(f"{state}/out")
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("t"))
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "t.n", F.round("t.total", 4).alias("total"))
