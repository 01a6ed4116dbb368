"""Walks over the call graph: neighbours, bounded reach, impact, file dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.joins import few, spread, stored, tasks_of


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops."""
    return edges.filter("src <> dst").select("src", "dst").distinct()


def navigable(edges: DataFrame, symbols: DataFrame, kinds: tuple[str, ...] = ("f", "t", "m")) -> DataFrame:
    """Distinct edges whose ends are both symbols of these kinds."""
    ids = symbols.filter(F.col("kind").isin(*kinds)).select("id").distinct()
    kept = clean_edges(edges).join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return kept.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def adjacency(local: DataFrame, cross: DataFrame) -> DataFrame:
    """The calls within files and across them as one set of edges (src, dst)."""
    return local.select("src", "dst").union(cross.select("src", "dst")).distinct()


def with_names(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with both ends' names; an end that is no symbol shows its id."""
    names = symbols.select("id", "qualified_name")
    src = names.select(F.col("id").alias("src"), F.col("qualified_name").alias("src_known"))
    dst = names.select(F.col("id").alias("dst"), F.col("qualified_name").alias("dst_known"))
    return edges.join(src, "src", "left").join(dst, "dst", "left").select(
        "src", "dst", F.coalesce("src_known", "src").alias("src_name"), F.coalesce("dst_known", "dst").alias("dst_name"))


def callers(edges: DataFrame, symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, caller, caller_name) for each ``id`` of ``targets``; the whole set in one join.  With :func:`with_files` also the caller's file."""
    found = edges.join(few(targets.withColumnRenamed("id", "dst")), "dst").select("src", "dst").distinct()
    return with_names(found, symbols).select(F.col("dst").alias("id"), F.col("src").alias("caller"), F.col("src_name").alias("caller_name"))


def callees(edges: DataFrame, symbols: DataFrame, sources: DataFrame) -> DataFrame:
    found = edges.join(few(sources.withColumnRenamed("id", "src")), "src").select("src", "dst").distinct()
    return with_names(found, symbols).select(F.col("src").alias("id"), F.col("dst").alias("callee"), F.col("dst_name").alias("callee_name"))


def neighbours(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, direction, other): 'in' for callers, 'out' for callees."""
    own = few(targets.select("id").distinct())
    into = edges.join(own, edges["dst"] == own["id"]).select("id", F.lit("in").alias("direction"), F.col("src").alias("other"))
    out = edges.join(own, edges["src"] == own["id"]).select("id", F.lit("out").alias("direction"), F.col("dst").alias("other"))
    return into.unionAll(out).distinct()


def context(edges: DataFrame, symbols: DataFrame, targets: DataFrame, cap: int | None = 50) -> DataFrame:
    """Each target with the sorted names of its callers and callees, at most ``cap`` of each, and how many there are.

    A hub's names are cut to the first ``cap`` where they lie, before they come together.
    """
    found = targets.join(symbols.select("id", "qualified_name", "file"), "id")
    for side, rows in (("caller", callers(edges, symbols, targets)), ("callee", callees(edges, symbols, targets))):
        names = rows.select("id", F.col(f"{side}_name").alias("name")).distinct()
        first = names if cap is None else names.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("name"))).filter(F.col("place") <= cap)
        lists = first.groupBy("id").agg(F.sort_array(F.collect_list("name")).alias(f"{side}s"))
        found = found.join(lists, "id", "left").join(names.groupBy("id").agg(F.count("*").alias(f"n_{side}s")), "id", "left")
    empty = F.array().cast("array<string>")
    return found.select("id", "qualified_name", "file", *[F.coalesce(f"{s}s", empty).alias(f"{s}s") for s in ("caller", "callee")], *[F.coalesce(f"n_{s}s", F.lit(0)).alias(f"n_{s}s") for s in ("caller", "callee")])


def fan(edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out.  Edges are made distinct once, for both ends; a null id is no one's, so each end has its own row of it."""
    ends = lambda own, other, n: F.struct(F.col(own).alias("id"), F.when(F.col(own).isNull(), n).alias("end"), *[F.when(F.col(other).isNotNull() & (n == k), 1).otherwise(0).cast("long").alias(c) for k, c in enumerate(("fan_in", "fan_out"))])
    pairs = spread(edges.select("src", "dst"), "src", "dst").distinct()
    each = pairs.select(F.explode(F.array(ends("dst", "src", F.lit(0)), ends("src", "dst", F.lit(1)))).alias("x")).select("x.*")
    return each.groupBy("id", "end").agg(F.sum("fan_in").alias("fan_in"), F.sum("fan_out").alias("fan_out")).drop("end")


def reach(edges: DataFrame, starts: DataFrame, hops: int, backward: bool = False) -> DataFrame:
    """(start, id, distance) within ``hops``, the least distance; a start is not its own.

    Each hop is a join of the new frontier only, which is made distinct before the next.
    """
    a, b = ("dst", "src") if backward else ("src", "dst")
    step = edges.select(F.col(a).alias("here"), F.col(b).alias("there"))
    first = few(starts.select(F.col("id").alias("start")).distinct())
    frontier = first.select("start", F.col("start").alias("id"))
    found = frontier.withColumn("distance", F.lit(0))
    for hop in range(1, hops + 1):
        frontier = frontier.join(step, frontier["id"] == step["here"]).select("start", F.col("there").alias("id")).distinct()
        frontier = frontier.join(found, ["start", "id"], "left_anti")
        found = found.unionAll(frontier.withColumn("distance", F.lit(hop)))
    return found.filter("distance > 0")


def reach_fixpoint(edges: DataFrame, starts: DataFrame, most_hops: int = 1_000) -> DataFrame:
    """(start, id) without a bound of hops; a start is not its own.  Every round is written.

    A walk that has not settled after ``most_hops`` rounds is an error.
    """
    first = starts.select(F.col("id").alias("start")).distinct()
    return _settled(edges, first.select("start", F.col("start").alias("id")), ["start", "id"], most_hops).filter("start <> id")


def reachable(edges: DataFrame, starts: DataFrame, most_hops: int = 1_000) -> DataFrame:
    """(id) that any of ``starts`` reaches, without a bound of hops, starts left out: a walk of all together."""
    first = starts.select("id").distinct()
    return _settled(edges, first, ["id"], most_hops).join(first, "id", "left_anti")


def _settled(edges: DataFrame, frontier: DataFrame, keys: list[str], most_hops: int) -> DataFrame:
    """``frontier`` and all that it reaches; only what a round found anew goes on."""
    pairs = edges.select(F.col("src").alias("id"), F.col("dst").alias("next"))
    step = stored(spread(pairs, "id", "next").distinct(), "steps")
    seen = frontier = stored(frontier, "reach")
    for _ in range(most_hops):
        tasks = tasks_of(step, frontier)
        near = spread(frontier, "id", tasks=tasks)
        onward = spread(step, "id", tasks=tasks).join(near.hint("shuffle_hash") if keys == ["id"] else near, "id").drop("id").withColumnRenamed("next", "id").select(*keys).distinct()
        frontier = stored(onward.join(seen, keys, "left_anti"), "reach")
        if frontier.isEmpty():
            return seen
        seen = seen.unionAll(frontier)
    raise RuntimeError(f"the walk did not settle in {most_hops} hops")


def file_dependencies(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src_file, dst_file, calls) between different files."""
    files = symbols.select("id", "file")
    joined = edges.join(files.select(F.col("id").alias("src"), F.col("file").alias("src_file")), "src").join(files.select(F.col("id").alias("dst"), F.col("file").alias("dst_file")), "dst")
    return joined.filter("src_file <> dst_file").groupBy("src_file", "dst_file").agg(F.count("*").alias("calls"))


def impact(edges: DataFrame, symbols: DataFrame, salience: DataFrame, coverage: DataFrame, target: str, hops: int = 2, risky: float = 0.1) -> DataFrame:
    """(id, distance, file, score, status, bucket) of all that call ``target`` within ``hops``.

    Direct callers are covered, high_risk (not covered, salient) or low_risk; others are transitive.
    """
    start = edges.sparkSession.createDataFrame([(target,)], "id string")
    around = reach(edges, start, hops, backward=True)
    known = around.join(symbols.select("id", "file", "qualified_name"), "id").join(salience.select("id", "score"), "id", "left").join(coverage.select("id", "status", "test_count"), "id", "left")
    score, status, tests = F.coalesce("score", F.lit(0.0)), F.coalesce("status", F.lit("unknown")), F.coalesce("test_count", F.lit(0))
    bucket = F.when(F.col("distance") > 1, "transitive").when((status == "covered") | (tests > 0), "covered").when(score >= risky, "high_risk").otherwise("low_risk")
    return known.select("id", "qualified_name", "distance", "file", score.alias("score"), status.alias("status"), bucket.alias("bucket"))


def impact_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("bucket").agg(F.count("*").alias("symbols"), F.countDistinct("file").alias("files"))


def impact_report(found: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """The most salient of each bucket, as many as the report shows."""
    caps = caps or {"high_risk": 10, "covered": 5, "transitive": 5, "low_risk": 0}
    most = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    order = Window.partitionBy("bucket").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= F.element_at(most, F.col("bucket")))


def suggested_tests(found: DataFrame, most: int = 3) -> DataFrame:
    """The callers that a test would help most: the most salient of high risk."""
    return found.filter("bucket = 'high_risk'").orderBy(F.desc("score"), "id").limit(most).select("id", "score")


def with_files(rows: DataFrame, symbols: DataFrame, column: str) -> DataFrame:
    """``rows`` with the file of the ids in ``column`` as <column>_file; null for what is no symbol."""
    files = symbols.groupBy(F.col("id").alias(column)).agg(F.max("file").alias(f"{column}_file"))
    return rows.join(files, column, "left")


def touching(refs: DataFrame, file: str) -> DataFrame:
    """The cross references (source_file, target_file, ...) that leave or enter one file."""
    return refs.filter((F.col("source_file") == file) | (F.col("target_file") == file))
