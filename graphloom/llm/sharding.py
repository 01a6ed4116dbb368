"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks in regions and shards in racks.  A row descends it: at
each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the row's
key and the child's path, and the smallest draw wins, so a child is taken with a
chance in proportion to its weight.  A change of weights below one node moves rows
only into or out of that node's subtree, because no other draw changes.

A tree grows by a region of its own for each added shard (:func:`grow`): the only
new draw is that region's, so a row either stays or goes to the new shard.

Everything is JVM-side: the tree is a literal of a few hundred bytes, the descent
three array scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import shuffle_partitions, written

#: region -> rack -> shard number -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def uniform_tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 4) -> Tree:
    """Shards 0 to ``shards - 1`` of weight 1, filling racks and regions in order."""
    tree: Tree = {}
    for n in range(shards):
        rack = n // shards_per_rack
        tree.setdefault(f"r{rack // racks_per_region}", {}).setdefault(f"k{rack}", {})[n] = 1.0
    return tree


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, numbered next, in a region of its own."""
    number = 1 + max((n for racks in tree.values() for rack in racks.values() for n in rack), default=-1)
    return {**tree, f"g{number}": {f"k{number}": {number: weight}}}


def _draw(key: Column, path: Column, weight: Column) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(key, path), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(unit) / weight


def _children(nodes: list[tuple[str, float]]) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("path"), F.lit(float(w)).alias("weight")) for name, w in nodes])


def place(key: Column, tree: Tree) -> Column:
    """The shard number of ``key`` (a null key is a key like any other)."""
    regions, racks, shards = [], {}, {}
    for region, inside in tree.items():
        total = sum(sum(rack.values()) for rack in inside.values())
        if total <= 0:
            continue
        regions.append((region, total))
        racks[region] = [(f"{region}/{rack}", sum(x.values())) for rack, x in inside.items() if sum(x.values()) > 0]
        for rack, leaves in inside.items():
            if sum(leaves.values()) > 0:
                shards[f"{region}/{rack}"] = [(f"{region}/{rack}/{n}", w) for n, w in leaves.items() if w > 0]
    if not regions:
        raise ValueError("the tree has no shard of positive weight")

    def winner(children: Column) -> Column:
        drawn = F.transform(children, lambda c: F.struct(_draw(key, c["path"], c["weight"]).alias("draw"), c["path"].alias("path")))
        return F.array_min(drawn)["path"]

    def table(levels: dict[str, list[tuple[str, float]]]) -> Column:
        return F.create_map(*[x for name, nodes in levels.items() for x in (F.lit(name), _children(nodes))])

    rack = winner(F.element_at(table(racks), winner(_children(regions))))
    return F.element_at(F.split(winner(F.element_at(table(shards), rack)), "/"), -1).cast("int")


def shard_documents(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """Place every row of ``docs`` (doc_id, text) by the ``key`` law.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard,
    slot (gapless from 0 within a shard) and grown_shard (with one more shard).

    Null text: size 1, crc32 of no bytes (0).  A null doc_id is one key of its own.
    Repeated doc_ids share a shard and get a slot each.  An empty table gives no
    rows.  Columns besides doc_id and text are neither read nor returned.

    Slots need no task with a whole shard: rows are numbered within (shard, hash
    block) and blocks are offset by the counts of the blocks before them.
    """
    tree = tree or uniform_tree(16)
    blocks = 16 * shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    thin = written(
        thin.select(
            "*",
            place(F.col("doc_id"), tree).alias("shard"),
            place(F.col("doc_id"), grow(tree)).alias("grown_shard"),
            F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks)).cast("int").alias("block"),
        ),
        "sharding",
    )
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        thin.groupBy("shard", "block").count()
        .select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    )
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    return (
        thin.withColumn("place", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                (F.col("base") + F.col("place")).cast("long").alias("slot"), "grown_shard")
    )
