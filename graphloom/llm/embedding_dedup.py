"""Near-duplicate embeddings by p-stable hashing of normalised vectors.

For unit vectors a cosine is a Euclidean distance, and ``floor((a.x + b) / width)`` with a
Gaussian ``a`` puts close vectors into one cell the likelier the closer they are.  A table's
bucket is the cells of several such projections; there are enough tables that a pair at the
threshold meets in one of them with the asked-for chance.  Pairs that met by chance are
mostly told from 64 signs of further projections, the others by their exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.buckets import across_blocks, resolve, with_centres
from graphloom.llm.common import apart, discard, lean, small_arrow, written
from graphloom.llm.textscan import mixed
from graphloom.llm.vectors import close, common_length, cosines, matrix, unit, usable


def meeting_chance(distance: float, width: float) -> float:
    """The chance that one projection puts two vectors at ``distance`` into one cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, cosine: float, chance: float = 0.99, width: float = 2.2) -> tuple[int, int]:
    """(projections, tables): unrelated vectors meet about once a table, pairs at the threshold with ``chance``."""
    near = meeting_chance(math.sqrt(2 - 2 * cosine), width)
    far = meeting_chance(math.sqrt(2), width)
    projections = max(4, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return projections, math.ceil(math.log(1 - chance) / math.log(1 - near**projections))


def most_signs(cosine: float, deviations: float = 5.0) -> int:
    """Of 64 random hyperplanes, as many as may part a pair at the threshold (about one in three million is parted by more)."""
    share = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return math.ceil(64 * share + deviations * math.sqrt(64 * share * (1 - share)))


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, seed: int = 11, block: int = 8_192, signs: bool = True) -> DataFrame:
    """A row for each row of ``vectors`` (vec_id, embedding): vec_id, n_links (other vectors
    with a cosine of at least ``cosine``), component_id (smallest vec_id that links reach)
    and kept (vec_id = component_id).

    Vectors that are null, zero, hold null or non-finite components, have a null id or not
    the most frequent length link with nothing: n_links 0, component_id their own id.
    Rows count by their own vector: rows of one vec_id are judged apart, each has its links
    (those to other rows of its id included) and component.  Equal vectors (by a 128-bit
    hash) are one class: hashed once, each other's links, never expanded into pairs.  Links
    are counted within the components found, block by block, so all links between members
    count.  Without ``signs`` no pair is ruled out by them: every pair that shares a bucket
    is judged by its cosine.  An empty table gives no rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    small_arrow(spark)
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    every = every.withColumn("good", usable("embedding") & F.col("vec_id").isNotNull())
    length = common_length(every.filter("good"), "embedding")
    rows = written(every.withColumn("good", F.col("good") & (F.size("embedding") == length))
                   .withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit("vector"), F.col("embedding"))}), "vectors")
    classes = rows.filter("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    projections, tables = parameters(classes.count(), cosine)
    rng = np.random.default_rng(seed)
    width = 2.2
    drawn = spark.sparkContext.broadcast((rng.normal(size=(max(length, 1), projections * tables)), rng.uniform(0, width, projections * tables),
                                          rng.integers(1, 1 << 62, (tables, projections), dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.normal(size=(max(length, 1), 64))))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, odd, planes = drawn.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                x = unit(matrix(part.column(1), length))
                cells = np.floor((x @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(x), tables, projections)
                bucket = mixed((cells * odd[None]).sum(2) + np.arange(tables, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
                sketch = np.packbits(x @ planes > 0, axis=1).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel().view(np.int64)), *(pa.array(np.repeat(v, tables)) for v in (part.column(0).to_numpy(), sketch))], ["bucket", "id", "sketch"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(cosines(unit(matrix(batch.column(2), length)), unit(matrix(batch.column(3), length))) >= cosine)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    own = classes.select("id", "embedding")

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(own.select(F.col("id").alias("a"), F.col("embedding").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("embedding").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(lean(linked), "a long, b long")

    def compare(rest: pa.Table, every: pa.Table) -> pa.Table:
        """A link of each row with each other component that it has one with: more would join nothing more."""
        (ids, mine, x), (others, theirs, y) = ((t.column("id").to_numpy(), t.column("component").to_numpy(), unit(matrix(t.column("embedding"), length))) for t in (rest, every))
        order = np.argsort(theirs, kind="stable")
        others, theirs, y = others[order], theirs[order], y[order]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, hit in close(x, y, cosine):
            hit &= mine[at : at + len(hit), None] != theirs[None, :]
            i, j = np.nonzero(hit)
            first = np.ones(len(i), bool)
            first[1:] = (np.diff(i) != 0) | (np.diff(theirs[j]) != 0)
            a.append(ids[at + i[first]])
            b.append(others[j[first]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    def across(torn: DataFrame) -> DataFrame:
        return across_blocks(torn.join(own, "id"), compare, "a long, b long").distinct()

    met = written(with_centres(own.mapInArrow(lean(hashes), "bucket long, id long, sketch long")), "vector-buckets")
    placed = resolve(met, verify, across, (lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= most_signs(cosine)) if signs else None)
    discard(met)
    sizes = placed.groupBy("component").agg(F.count("*").alias("size"))
    clustered = apart(placed, "component").join(apart(sizes, "component"), ["component", "apart"]).drop("apart").join(classes, "id")
    clustered = written(clustered.select("id", "component", "size", "copies", "least", "embedding"), "linked-vectors")
    counted = _count_links(clustered, cosine, length, block)
    least = clustered.groupBy("component").agg(F.min("least").alias("component_id"))
    reached = apart(clustered.select("id", "component"), "component").join(apart(least, "component"), ["component", "apart"]).select("id", "component_id")
    found = classes.drop("embedding").join(reached, "id", "left").join(counted, "id", "left").select(
        "k1", "k2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    found = written(found, "vector-links")
    discard(placed, clustered, classes)
    every = rows.filter("good").select("vec_id", "k1", "k2").join(found, ["k1", "k2"]).select("vec_id", "n_links", "component_id").unionAll(
        rows.filter("not good").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _count_links(rows: DataFrame, cosine: float, length: int, block: int) -> DataFrame:
    """(id, others): the copies of other classes linked with each class of ``rows`` (id, component, size, copies, embedding).

    Components of up to ``block`` classes are dealt in lots of about that many; of larger
    ones a task holds two blocks, and a class is copied once for each block of its component.
    """
    block = max(256, min(block, (1 << 25) // (8 * max(length, 1))))  # at most 32 MB of vectors
    lots = -(-max(rows.count(), 1) // block)
    rows = rows.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    few = rows.filter("blocks <= 1").select(F.pmod(F.xxhash64("component"), F.lit(lots)).alias("lot"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("cut"), F.lit(True).alias("first"),
                                            "id", "component", "copies", "embedding")
    many = rows.filter("blocks > 1").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select(F.col("component").alias("lot"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.lit(True).alias("cut"), (F.col("mine") <= F.col("other")).alias("first"),
                       "id", "component", "copies", "embedding")

    def count(key, table):
        ids, component, copies = (table.column(c).to_numpy(zero_copy_only=False) for c in ("id", "component", "copies"))
        x, others = unit(matrix(table.column("embedding"), length)), np.zeros(table.num_rows, np.int64)
        if key[3].as_py() and key[1].as_py() < key[2].as_py():
            first = table.column("first").to_numpy(zero_copy_only=False)
            left, right = np.flatnonzero(first), np.flatnonzero(~first)
            for at, hit in close(x[left], x[right], cosine):
                others[left[at : at + len(hit)]] += hit @ copies[right]
                others[right] += copies[left[at : at + len(hit)]] @ hit
        else:
            order = np.argsort(component, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
                for at, hit in close(x[own], x[own], cosine):
                    hit[np.arange(len(hit)), at + np.arange(len(hit))] = False
                    others[own[at : at + len(hit)]] += hit @ copies[own]
        return pa.table({"id": ids, "others": others})

    counted = few.unionByName(many).groupBy("lot", "i", "j", "cut").applyInArrow(count, "id long, others long")
    return counted.groupBy("id").agg(F.sum("others").alias("others"))
