"""Connected components by alternating large-star and small-star steps.

Both steps reduce a node's neighbours to their minimum (combined before the shuffle) and
send it back along the edges by a join that Spark can split where a node is hot.  Every
round is written, so a lost executor costs at most a round; the round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import apart, discard, stored_bytes, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v) in both directions for the large star, from the larger to the smaller end for the small one."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = apart(edges, "u").join(apart(least, "u"), ["u", "apart"])
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def components(links: DataFrame, most_rounds: int = 40, size: int | None = None) -> DataFrame:
    """(id, component) of all nodes of ``links`` (a, b): the smallest id that links reach; a written table.

    Null ends, loops and repeats don't matter.  No links: no rows.  ``size``: the bytes of
    the written tables that the links are from, if they are.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = written(edges, "components", size=size)
    before = None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state.n:
            break
        before = state
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True).distinct()
        edges, old = written(_star(large, False).distinct(), "components", size=stored_bytes(edges)), edges
        discard(old)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    found = written(nodes, "placed", size=stored_bytes(edges))
    discard(edges)
    return found


def joined_up(placed: DataFrame, more: DataFrame) -> DataFrame:
    """The components of ``placed`` (id, component; deleted here) after links ``more`` (a, b) have come; both are written tables."""
    links = placed.select(F.col("component").alias("a"), F.col("id").alias("b")).filter("a <> b").unionAll(more.select("a", "b"))
    found = components(links, size=stored_bytes(placed, more))
    discard(placed)
    return found
