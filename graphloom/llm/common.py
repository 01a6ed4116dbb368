"""Helpers shared by the operators: the shared folder, written tables, Arrow stages."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.joins import apart, delete  # noqa: F401  the operators take them from here


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    A session without the setting gets a folder of its own, but only when it
    runs in a single JVM; on a cluster a machine-local folder would lose rows.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders that :func:`written` made and nobody has deleted, by application.
_left: dict[str, set[str]] = {}


#: Bytes of its source tables for each file of a table whose size follows theirs.
FILE_BYTES = 8 << 20


def stored_bytes(*tables: DataFrame) -> int:
    """Bytes of the folders of tables that :func:`written` returned."""
    total = 0
    for table in tables:
        folder = (context := table.sparkSession.sparkContext)._jvm.org.apache.hadoop.fs.Path(table._written_to)
        total += folder.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return total


def written(df: DataFrame, name: str, partition_by: str | None = None, size: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here, and a
    lost executor costs a re-read instead of a recomputation.

    ``size``, where the table is about as large as others that are stored: their bytes.  It
    then has a file for each :data:`FILE_BYTES`, and at least two for each core, and not one
    for each shuffle partition.  The last step is run in as many tasks, so it should be a light one.

    The folder stays until :func:`discard` or :func:`sweep` deletes it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if size is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, size // FILE_BYTES))
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_to = remember(spark, path)
    return found


def remember(spark: SparkSession, path: str) -> str:
    """``path``, which :func:`sweep` will delete."""
    _left.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`written` returned, once all that is read from it has itself been written."""
    for table in tables:
        if path := vars(table).pop("_written_to", None):
            delete(table.sparkSession, path)
            _left[table.sparkSession.sparkContext.applicationId].discard(path)


def left(spark: SparkSession) -> frozenset[str]:
    """The folders that nobody has deleted yet."""
    return frozenset(_left.get(spark.sparkContext.applicationId, ()))


def sweep(spark: SparkSession, *keep: DataFrame, besides: frozenset[str] = frozenset()) -> None:
    """Delete every written table of this application but ``keep`` and the folders ``besides``: for the caller, when all results have been written."""
    for path in left(spark) - besides - {vars(table).get("_written_to") for table in keep}:
        delete(spark, path)
        _left[spark.sparkContext.applicationId].discard(path)


def small_arrow(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound Arrow batches by bytes, unless the session names a bound: a batch of many rows with long texts would be huge."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(size))


@cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which the worker gives memory that it does not use back:
    Spark keeps workers for later tasks, also for those of stages that need no Python."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if _libc():
            _libc().malloc_trim(0)

    return wrapped


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``rows`` rows, so that what Python makes of them stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id's decimal text modulo ``divisor`` (null ids: remainder null)."""
    return F.crc32(F.col(column).cast("string")) % divisor


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")
