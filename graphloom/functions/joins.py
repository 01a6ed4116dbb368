"""What joins and numberings need at scale, whatever the keys mean."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def apart(table: DataFrame, *keys: str) -> DataFrame:
    """``table`` with a second key made from ``keys``, for a join on both.

    A table summed by a key is dealt by that key already; a join on it alone would take it
    as it is, and a hot key's partition on the other side could not be split.
    """
    return table.withColumn("apart", F.xxhash64(*keys))


def input_bytes(df: DataFrame) -> int | None:
    """What the files below ``df`` hold, each as often as it is read; None if something else than files and small local rows is below it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(n).stats().sizeInBytes())) for n in range(leaves.size())]
    return None if any(size >= 1 << 60 for size in sizes) else sum(sizes)


def spread(df: DataFrame, *keys: Column | str, tasks: int | None = None, task_bytes: int = 8_000_000) -> DataFrame:
    """``df`` dealt by ``keys`` into as many tasks as its input's bytes ask for, so that a task's memory stays as the input grows.

    Sizes of shuffled bytes, by which Spark would join tasks together, tell little of
    memory: short keys that repeat compress well.  Both sides of a join need the same ``tasks``.
    """
    n = tasks or tasks_of(df, task_bytes=task_bytes)
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def tasks_of(*tables: DataFrame, task_bytes: int = 8_000_000) -> int | None:
    """The tasks that :func:`spread` makes of these tables; None leaves it to Spark where their size is not known."""
    sizes = [input_bytes(t) for t in tables]
    return None if None in sizes else sum(sizes) // task_bytes + 1


def few(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """``rows`` marked for broadcast if there are at most ``most``; else as they are."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def scratch(spark: SparkSession, name: str = "scratch") -> str:
    """A new folder in the one that all executors share; a machine-local one only where everything runs in one JVM."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` written and read again: its lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def numbered(rows: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """``rows`` with their place, from 1, in a total order of all rows.

    Rows are dealt by ranges of the order and numbered within; a row count of each range
    gives the places before it.  No task sees more than a range.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("own", F.monotonically_increasing_id())
    ranged = stored(ranged, "numbered")
    part = F.shiftright("own", 33)
    sizes = sorted((r.part, r.n) for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a range
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "part long, before long"))
    placed = ranged.withColumn("part", part.cast("long")).join(offsets, "part")
    return placed.withColumn(name, F.col("before") + F.col("own").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("own", "part", "before")
