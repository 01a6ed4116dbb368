"""Polling as streams: changed files merged into a state, query logs counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG = "seq long, kind string, target string, agent long, ts timestamp"


def watch(spark: SparkSession, source: str, schema: str, state: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Merge new Parquet files of stamps (path, content_hash, seq) into ``state``.

    Each micro-batch writes one folder ``batch=<id>``; a batch that is run again overwrites
    its own.  A stamp without a hash says that its file is gone.  Without ``interval`` the
    stream stops when all files are read.
    """

    def merge(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by(F.struct("content_hash", "seq"), "seq").alias("x")).select("path", "x.*")
        newest.write.mode("overwrite").parquet(f"{state}/batch={number}")

    writer = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def current(spark: SparkSession, state: str) -> DataFrame:
    """The newest stamp of each path over all batches; files that are gone have none."""
    newest = spark.read.parquet(state).groupBy("path").agg(F.max_by(F.struct("content_hash", "seq"), "seq").alias("x"))
    return newest.filter("x.content_hash is not null").select("path", "x.content_hash", "x.seq")


def compacted(spark: SparkSession, state: str, target: str) -> None:
    """The state of a stream that has stopped as a single batch in another folder, for the next stream to go on from."""
    newest = spark.read.parquet(state).groupBy("path").agg(F.max_by(F.struct("content_hash", "seq"), "seq").alias("x")).select("path", "x.content_hash", "x.seq")
    newest.write.mode("errorifexists").parquet(f"{target}/batch=-1")


def operation_counts(log: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, kind, n) of a log stream in event-time windows; events later than ``late`` are not waited for."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def append_log(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return log.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
