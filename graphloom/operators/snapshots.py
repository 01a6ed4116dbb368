"""Two states compared: stamps, changed sets, semantic diff, workspace status, id migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.identifiers import symbol_hash
from graphloom.functions.joins import spread
from graphloom.sources.artifacts import replace_files


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed, changed or fresh, by content hash; one full join on the path."""
    a, b = old.select("path", F.col("content_hash").alias("was")), new.select("path", F.col("content_hash").alias("now"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("fresh")
    return a.join(b, "path", "full").select("path", kind.alias("change"))


def is_fresh(old_mtime: Column, old_size: Column, old_hash: Column, mtime: Column, size: Column, content_hash: Column, now: Column, racy_ns: int = 2_000_000_000) -> Column:
    """Whether a cached file is current: equal stats are trusted unless the file was written just now, else the content decides."""
    same = (old_mtime == mtime) & (old_size == size)
    return (same & ((old_hash == "") | (now - mtime >= racy_ns))) | ((old_hash != "") & (old_hash == content_hash))


def stale_report(found: DataFrame) -> DataFrame:
    return found.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed", "fresh")], F.count_if(F.col("change") != "fresh").alias("stale"))


def diff_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change): added, removed, signature, body or both, of rows (id, signature_hash, body_hash)."""
    a = old.select("id", F.col("signature_hash").alias("s1"), F.col("body_hash").alias("b1"), F.lit(True).alias("was"))
    b = new.select("id", F.col("signature_hash").alias("s2"), F.col("body_hash").alias("b2"), F.lit(True).alias("now"))
    signature, body = F.col("s1") != F.col("s2"), F.col("b1") != F.col("b2")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(signature & body, "both").when(signature, "signature").when(body, "body")
    return a.join(b, "id", "full").select("id", change.alias("change")).filter("change is not null")


def diff_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """(src, dst, change): calls added and removed.  Both states are summed by call at once, in as many tasks as their size asks for."""
    both = old.select("src", "dst", F.lit(1).alias("state")).unionAll(new.select("src", "dst", F.lit(2)))
    seen = spread(both, "src", "dst").groupBy("src", "dst").agg(F.min("state").alias("first"), F.max("state").alias("last"))
    return seen.filter("first = last").select("src", "dst", F.when(F.col("first") == 2, "added").otherwise("removed").alias("change"))


def id_migration(symbols: DataFrame, old_root: str = "") -> DataFrame:
    """(old_id, new_id) of symbols whose id changes when paths are made relative and lower-cased."""
    path = F.concat(F.lit(old_root), F.col("file"))
    old = F.sha2(F.concat_ws("|", "qualified_name", "scope", F.lit("sql"), path, F.lit("")), 256)
    new = symbol_hash(F.col("qualified_name"), F.col("scope"), F.lit("sql"), F.col("file"), F.lit(""))
    ids = symbols.select(F.concat("kind", F.lit("_"), F.substring(old, 1, 12)).alias("old_id"), F.concat("kind", F.lit("_"), F.substring(new, 1, 12)).alias("new_id")).distinct()
    return ids.filter("old_id <> new_id")


def migration_report(mapping: DataFrame, known: DataFrame) -> DataFrame:
    """One row: ids derived, changed and unchanged, those of ``known`` (id) that the mapping has (matched) or lacks (their file changed since)."""
    ids = known.select("id").distinct().join(mapping.select(F.col("old_id").alias("id"), F.lit(True).alias("hit")).distinct(), "id", "left")
    counts = ids.agg(F.count_if("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("unmatched"))
    changed = F.col("old_id") != F.col("new_id")
    return mapping.agg(F.count("*").alias("derived"), F.count_if(changed).alias("changed"), F.count_if(~changed).alias("unchanged")).crossJoin(F.broadcast(counts))


def remap(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``rows`` with old ids in ``column`` replaced; ids the map lacks stay."""
    renamed = mapping.select(F.col("old_id").alias(column), "new_id")
    return rows.join(renamed, column, "left").withColumn(column, F.coalesce("new_id", column)).drop("new_id")


def remap_keys(rows: DataFrame, key: str, column: str, mapping: DataFrame) -> DataFrame:
    """``rows`` (with a unique ``key``) whose map ``column`` has old ids as its keys, with the new ones."""
    each = rows.select(key, F.explode(column).alias("old_id", "value")).join(mapping.select("old_id", "new_id"), "old_id", "left")
    maps = each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("new_id", "old_id"), "value"))).alias("changed"))
    return rows.join(maps, key, "left").withColumn(column, F.coalesce("changed", column)).drop("changed")


def overwrite_files(rows: DataFrame, path: str) -> None:
    """Replace the rows of the files that ``rows`` has; other files' rows stay."""
    replace_files(rows.sparkSession, path, rows)
