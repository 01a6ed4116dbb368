"""From buckets of candidates to components, without all pairs of a large bucket.

Rows of a bucket may be similar; whether two are is for the caller's exact check.  First
every row is compared with one centre only, the smallest of its buckets'.  What is found is
made into components, and from then on only rows of different components are compared:
all of them in small buckets; in large ones first with another centre, then those outside
the bucket's main component with all of the bucket, block by block within tasks.  So no
link between members of one bucket is lost to the size of the bucket, and no pairs of a
large bucket are ever written: two members end in one component, or were compared.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import apart, discard, stored_bytes, written
from graphloom.llm.graph import components, joined_up

Verify = Callable[[DataFrame], DataFrame]


def with_centres(buckets: DataFrame) -> DataFrame:
    """The rows of ``buckets`` (bucket, id, sketch) that have several ids, with the smallest (centre), its sketch and the number of rows."""
    sizes = buckets.groupBy("bucket").agg(F.min(F.struct("id", "sketch")).alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).filter("first.id < last")
    sizes = sizes.select("bucket", F.col("first.id").alias("centre"), F.col("first.sketch").alias("centre_sketch"), "n")
    return apart(buckets, "bucket").join(apart(sizes, "bucket"), ["bucket", "apart"]).drop("apart")


def labelled(rows: DataFrame, names: list[str], placed: DataFrame) -> DataFrame:
    """``rows`` with the component of each of the id columns ``names`` as c_<name>; an id without one is its own."""
    for n in names:
        rows = rows.join(placed.select(F.col("id").alias(n), F.col("component").alias(f"c_{n}")), n, "left").withColumn(f"c_{n}", F.coalesce(f"c_{n}", n))
    return rows


def across_blocks(torn: DataFrame, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block: int = 512) -> DataFrame:
    """What ``compare`` gives for rows of ``torn`` (bucket, id, component, ...) in different components of a bucket.

    Rows outside a bucket's main component (the one with most rows) meet all its rows.  Both
    sides are cut into blocks of about ``block`` rows, a task holds two blocks, and a row is
    copied once for each block of the other side.
    """
    counts = torn.groupBy("bucket", "component").agg(F.count("*").alias("own"))
    main = counts.groupBy("bucket").agg(F.max_by("component", F.struct("own", "component")).alias("main"), F.max("own").alias("most"), F.sum("own").alias("rows"))
    cut = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    main = main.select("bucket", "main", cut(F.col("rows") - F.col("most")).alias("rest_blocks"), cut(F.col("rows")).alias("all_blocks"))
    marked = apart(torn, "bucket").join(apart(main, "bucket"), ["bucket", "apart"]).drop("apart")
    place = lambda salt, blocks: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    keep = torn.columns
    rest = marked.filter("component <> main").select(*keep, place("rest", "rest_blocks").alias("i"), each("all_blocks").alias("j"), F.lit(True).alias("rest"))
    every = marked.select(*keep, each("rest_blocks").alias("i"), place("all", "all_blocks").alias("j"), F.lit(False).alias("rest"))

    def run(table: pa.Table) -> pa.Table:
        side = table.column("rest")
        return compare(table.filter(side), table.filter(pc.invert(side)))

    return rest.unionByName(every).groupBy("bucket", "i", "j").applyInArrow(run, schema)


def resolve(shared: DataFrame, verify: Verify, across: Verify, plausible: Callable[[Column, Column], Column] | None = None, small: int = 8, rounds: int = 2) -> DataFrame:
    """(id, component) of the ids that are linked; a written table.

    ``shared``: rows of :func:`with_centres`.  ``verify`` takes distinct pairs (a, b) and
    returns those linked; ``across`` takes rows (bucket, id, component) of large buckets and
    returns links (a, b) between components.  ``plausible`` judges two sketches; pairs that
    it rules out are not verified, except within large buckets, where all are compared.
    """
    may = plausible or (lambda x, y: F.lit(True))
    stars = shared.filter("centre < id").filter(may(F.col("centre_sketch"), F.col("sketch"))).groupBy("id").agg(F.min("centre").alias("a"))
    links = written(verify(stars.select("a", F.col("id").alias("b"))), "links")
    placed = components(links, size=stored_bytes(links))
    discard(links)

    def add(found: DataFrame) -> None:
        nonlocal placed
        more = written(found, "links")
        if not more.isEmpty():
            placed = joined_up(placed, more)
        discard(more)

    few = shared.filter(F.col("n") <= small).select("bucket", "id", "sketch")
    met = few.alias("x").join(few.alias("y"), "bucket").filter("x.id < y.id").filter(may(F.col("x.sketch"), F.col("y.sketch")))
    met = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    add(verify(labelled(met, ["a", "b"], placed).filter("c_a <> c_b").select("a", "b").distinct()))

    large = shared.filter(F.col("n") > small).select("bucket", "id", "sketch")
    for turn in range(1, rounds + 1):
        rows = labelled(large, ["id"], placed).withColumnRenamed("c_id", "component")
        centre = F.min_by(F.struct("id", "component", "sketch"), F.xxhash64("component", "id", F.lit(turn)))
        torn = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), centre.alias("centre")).filter("low < high")
        torn = torn.select("bucket", F.col("centre.id").alias("centre"), F.col("centre.component").alias("own"), F.col("centre.sketch").alias("centre_sketch"))
        torn = written(apart(rows, "bucket").join(apart(torn, "bucket"), ["bucket", "apart"]).drop("apart"), "torn")
        if torn.isEmpty():
            discard(torn)
            break
        if turn < rounds:
            met = torn.filter("component <> own").filter(may(F.col("centre_sketch"), F.col("sketch"))).groupBy("id").agg(F.min("centre").alias("centre"))
            add(verify(met.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()))
        else:
            add(across(torn.select("bucket", "id", "component")))
        discard(torn)
    return placed
