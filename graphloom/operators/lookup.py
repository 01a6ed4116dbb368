"""Projections, point lookups and reference resolution.  Bulk forms: many references at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.joins import few
from graphloom.functions.predicates import looks_like_id


def with_files(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``symbols`` (file_id, ...) with the path and language of ``files`` (file_id, path, language)."""
    return symbols.join(files.select("file_id", F.col("path").alias("file"), "language"), "file_id").drop("file_id")


def projection(symbols: DataFrame) -> DataFrame:
    """What listings and searches read; never a body."""
    return symbols.select("id", "name", "qualified_name", "kind", "file")


def latest(symbols: DataFrame) -> DataFrame:
    """One row per id: ids may repeat across files, and the greatest file wins."""
    order = Window.partitionBy("id").orderBy(F.desc("file"), "qualified_name")
    return symbols.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def by_id(symbols: DataFrame, symbol_id: str) -> DataFrame:
    return symbols.filter(F.col("id") == symbol_id).orderBy(F.desc("file")).limit(1)


def body(symbols: DataFrame, symbol_id: str) -> DataFrame:
    """The text of a symbol: no row if it is unknown, '' if it has none."""
    return by_id(symbols, symbol_id).select("id", F.coalesce("body_text", F.lit("")).alias("body_text"))


def by_name(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Matches of ``names`` (ref): on the qualified name, or only if there is none on the name."""
    full = names.join(symbols, names["ref"] == symbols["qualified_name"]).withColumn("tier", F.lit(1))
    plain = names.join(symbols, names["ref"] == symbols["name"]).withColumn("tier", F.lit(2))
    found = full.unionByName(plain)
    best = found.withColumn("best", F.min("tier").over(Window.partitionBy("ref")))
    return best.filter("tier = best").select("ref", "id", "qualified_name", "file", "tier")


def ref_status(symbols: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """For each ``ref``: status (id, name, ambiguous, graph_only, not_found), the id if it is one, and how many matched.

    Ids come first, then names, then ids that only edges know.  Symbols and edges are
    scanned for the references, and nothing else of them is shuffled.
    """
    refs, own = few(refs), symbols.select("id", "name", "qualified_name")
    ids = own.join(refs, F.col("ref") == F.col("id")).select("ref", F.lit(1).alias("tier"), "id").distinct()
    names = own.join(refs, F.col("ref") == F.col("qualified_name")).select("ref", F.lit(2).alias("tier"), "id").distinct()
    plain = own.join(refs, F.col("ref") == F.col("name")).select("ref", F.lit(3).alias("tier"), "id").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).join(refs, F.col("ref") == F.col("id"))
    graph = ends.select("ref", F.lit(4).alias("tier"), "id").distinct()
    found = ids.unionAll(names).unionAll(plain).unionAll(graph).groupBy("ref", "tier").agg(F.count("*").alias("matches"), F.min("id").alias("id"))
    best = found.groupBy("ref").agg(F.min(F.struct("tier", "matches", "id")).alias("x")).select("ref", "x.*")
    status = (
        F.when(F.col("tier").isNull(), "not_found").when(F.col("tier") == 1, "id").when(F.col("tier") == 4, "graph_only").when(F.col("matches") > 1, "ambiguous").otherwise("name"))
    n = F.coalesce("matches", F.lit(0))
    return refs.join(best, "ref", "left").select("ref", status.alias("status"), F.when(n == 1, F.col("id")).alias("id"), n.alias("matches"))


def candidates(symbols: DataFrame, refs: DataFrame, most: int = 50) -> DataFrame:
    """(ref, id, qualified_name, file, not_shown): what an ambiguous name may mean, by file and id, at most ``most`` each."""
    found = by_name(symbols, refs)
    order = Window.partitionBy("ref").orderBy("file", "id")
    shown = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place", "tier")
    totals = found.groupBy("ref").agg(F.count("*").alias("total"))
    return shown.join(totals, "ref").withColumn("not_shown", F.greatest(F.lit(0), F.col("total") - most)).drop("total")


def id_shapes(refs: DataFrame) -> DataFrame:
    return refs.select("ref", looks_like_id(F.col("ref")).alias("is_id"), looks_like_id(F.col("ref"), strict=False).alias("may_be_id"))


def dictionary(symbols: DataFrame) -> DataFrame:
    """Rows as a dictionary shows them: a hash of the signature, 1-based lines, the language or '' where none is known."""
    language = F.coalesce("language", F.lit("")) if "language" in symbols.columns else F.lit("")
    return symbols.select("id", "qualified_name", "kind", "file", language.alias("language"), F.substring(F.sha2("signature", 256), 1, 8).alias("signature_hash"),
                          (F.col("span_start") + 1).alias("line_from"), (F.col("span_end") + 1).alias("line_to"))


def page(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows and in each the count of those not shown."""
    counted = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(limit).crossJoin(F.broadcast(counted)).withColumn("not_shown", F.greatest(F.lit(0), F.col("total") - limit)).drop("total")


def byte_cap(lines: DataFrame, most: int = 100_000) -> DataFrame:
    """The first lines (artifact, at, line) of each artifact that together stay within ``most`` bytes.

    A line has a byte at least, so only the first ``most`` of an artifact can be among
    them: these are picked where they lie, before an artifact's lines come together.
    """
    near = lines.withColumn("place", F.row_number().over(Window.partitionBy("artifact").orderBy("at"))).filter(F.col("place") <= most).drop("place")
    running = Window.partitionBy("artifact").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("bytes", F.sum(F.octet_length("line") + F.lit(1)).over(running)).filter(F.col("bytes") <= most).drop("bytes")
