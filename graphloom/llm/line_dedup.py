"""Line deduplication against levelled sorted runs of line hashes.

The hashes of all lines seen so far lie in runs: tables bucketed and sorted by hash.  A new
batch is merge-joined with the runs (both sides sorted by hash, the runs without a shuffle):
lines found there go, lines that are new to the runs are added as a run of their own.  When
a level holds ``fanout`` runs they are merged into one run of the next level before the
next batch, so a batch meets a number of runs that grows with the logarithm of the batches.

All of it is DataFrame code on built-in functions.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import apart, delete, fresh_path, shuffle_partitions, written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null doc_id: after all others.
LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """The line without space at its ends, with A-Z lower-cased (and no other letters)."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class LineRuns:
    """The runs: rows (h1, h2), a 128-bit hash of a line's key, each hash in one run only.

    A level that is full is merged into one run of the next level before the next batch
    meets the runs, never after a last one.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or shuffle_partitions(spark)
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, hashes: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = fresh_path(self.spark, name)
        (
            hashes.select("h1", "h2").repartition(self.buckets, "h1", "h2").write
            .bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
            .option("path", self.paths[name]).saveAsTable(name)
        )
        return name

    def _drop(self, names: list[str]) -> None:
        """From the catalogue and from the folder: they are external tables."""
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            delete(self.spark, self.paths.pop(name))

    def close(self) -> None:
        """Drop all runs."""
        self._drop(self.tables())
        self.levels = []

    def tables(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def seen(self, keys: DataFrame) -> DataFrame:
        """``keys`` with a column ``seen``: whether a run has the hash."""
        self._compact()
        names = self.tables()
        if not names:
            return keys.withColumn("seen", F.lit(False))
        for i, name in enumerate(names):
            keys = keys.join(self.spark.table(name).withColumn(f"in{i}", F.lit(True)), ["h1", "h2"], "left")
        return keys.withColumn("seen", F.coalesce(*[F.col(f"in{i}") for i in range(len(names))], F.lit(False))).drop(*[f"in{i}" for i in range(len(names))])

    def add(self, hashes: DataFrame) -> None:
        """Add hashes that no run has."""
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(hashes))

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(full := self.levels[level]) >= self.fanout:
                merged = self._write(reduce(DataFrame.unionAll, [self.spark.table(name) for name in full]))
                self._drop(full)
                self.levels[level] = []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(merged)
            level += 1


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("content"),
        F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("at", "line"),
    )


def _hashed(docs: DataFrame, min_chars: int) -> DataFrame:
    keyed = _lines(docs).select("did", "content", "at", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keyed.select("did", "content", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"))


def absorb(lines: DataFrame, runs: LineRuns) -> DataFrame:
    """Take a batch of hashed lines into the runs; the places (did, content, at) of the lines that go.

    Within the batch the smallest did keeps its lines; what the runs have goes from all.
    ``lines`` is read several times, so it must be a written table.
    """
    keys = lines.groupBy("h1", "h2").agg(F.min("did").alias("keeper"), F.max("did").alias("last"))
    keys = written(runs.seen(keys), "line-keys")
    runs.add(keys.filter(~F.col("seen")))
    repeated = keys.filter(F.col("seen") | (F.col("keeper") < F.col("last")))
    return (
        lines.join(repeated, ["h1", "h2"])
        .filter(F.col("seen") | (F.col("did") > F.col("keeper")))
        .select("did", "content", "at")
    )


def dedup_lines(docs: DataFrame, runs: LineRuns | None = None, batches: int = 4, min_chars: int = 10) -> DataFrame:
    """Drop repeated lines from ``docs`` (doc_id, text); returns all columns of ``docs`` with
    the new text, and n_lines (before) and n_dropped.

    A line's key is :func:`line_key`; keys of at least ``min_chars`` code points that are
    in at least 2 documents lose their lines in all but the smallest doc_id that has it.
    Documents are taken in ``batches`` by ascending doc_id, so an earlier batch keeps what
    a later one loses; ``runs`` from earlier calls make lines found there go as well, and
    keep this call's lines.  Without ``runs`` those of the call are dropped again.

    Null text: one empty line, text ''.  Null doc_ids: one document after all others.
    Rows of one doc_id are one document: its lines don't drop each other.  An empty table
    gives no rows.  Other columns pass through (those named n_lines, n_dropped or text
    are replaced).

    Hot lines: a key's documents are only ever reduced to a minimum (combined before the
    shuffle) or met by a join whose hot partitions Spark can split.
    """
    spark = docs.sparkSession
    own_runs = None if runs else LineRuns(spark)
    runs = runs or own_runs
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"))
    steps = [i / batches for i in range(1, batches)]
    bounds = (ids.agg(F.percentile_approx("did", steps, 1000)).first()[0] or []) if steps else []
    batch = F.lit(0)
    for bound in bounds:
        batch = batch + (F.col("did") > bound).cast("int")
    lines = written(_hashed(docs, min_chars).withColumn("batch", batch), "lines", "batch")
    gone = None
    for n in range(len(bounds) + 1):
        part = absorb(lines.filter(F.col("batch") == n).drop("batch"), runs)
        gone = part if gone is None else gone.unionAll(part)
    if own_runs:  # what goes is read from written tables, not from the runs
        own_runs.close()
    gone = gone.groupBy("did", "content").agg(F.sort_array(F.collect_set("at")).alias("gone"))

    text = F.coalesce(F.col("text"), F.lit(""))
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    split = apart(docs.select(
        *[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)],
        text.alias("own_text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.xxhash64(text).alias("content"),
    ), "did", "content").join(apart(gone, "did", "content"), ["did", "content", "apart"], "left").withColumn("own_lines", F.split("own_text", "\n"))
    ends = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("own_lines")))
    split = split.withColumn("ends", F.when(F.col("gone").isNotNull(), ends))
    between = F.transform(
        F.sequence(F.lit(1), F.size("ends") - 1),
        lambda i: F.slice("own_lines", F.get("ends", i - 1) + 2, F.get("ends", i) - F.get("ends", i - 1) - 1),
    )
    kept = F.when(F.col("gone").isNull(), F.col("own_text")).otherwise(F.array_join(F.flatten(between), "\n"))
    place = {c: f"own_{i}" for i, c in enumerate(own)}
    return split.select(
        *[kept.alias("text") if c == "text" else F.col(place[c]).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.size("own_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
