"""Metrics of symbols: salience, attention, coverage, rollups, build totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.identifiers import half_up, reduction
from graphloom.functions.joins import few, spread, tasks_of
from graphloom.functions.predicates import is_private, is_test_file, is_vendor, top_folder, within
from graphloom.operators.graph import reach_fixpoint


def _placed(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    files = symbols.select("id", "file")
    return edges.join(files.select(F.col("id").alias("src"), F.col("file").alias("src_file")), "src").join(files.select(F.col("id").alias("dst"), F.col("file").alias("dst_file")), "dst")


def local_salience(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, file, fan_in, score): calls from the own file over the file's most."""
    inside = _placed(edges, symbols).filter("src_file = dst_file").groupBy("dst").agg(F.count("*").alias("n"))
    counted = symbols.select("id", "file").join(inside, F.col("id") == F.col("dst"), "left").select("id", "file", F.coalesce("n", F.lit(0)).alias("fan_in"))
    most = F.max("fan_in").over(Window.partitionBy("file"))
    return counted.withColumn("score", F.when(most > 0, F.col("fan_in") / most).otherwise(0.0))


def project_salience(edges: DataFrame, symbols: DataFrame, cross_weight: float = 2.0, file_weight: float = 1.5, test: float = 0.25, private: float = 0.5, vendor: float = 0.1) -> DataFrame:
    """(id, file, local_fan_in, cross_fan_in, score): weighted calls, cut for tests, private names and vendor code, over the project's most.

    The largest value is a scalar, joined back by a one-row broadcast.
    """
    files = symbols.select("id", "file")
    tasks = tasks_of(edges, symbols)
    ids = lambda own: spread(files.select(F.col("id").alias(own), F.col("file").alias(f"{own}_file")), own, tasks=tasks).hint("shuffle_hash")
    calls = spread(edges, "src", tasks=tasks).join(ids("src"), "src").groupBy("dst", "src_file").agg(F.count("*").alias("n"))
    placed = spread(calls, "dst", tasks=tasks).join(ids("dst"), "dst")
    crossing = F.col("src_file") != F.col("dst_file")
    # a file may be in several rows of a symbol that is listed more than once
    fan = placed.groupBy("dst", "src_file").agg(F.sum(F.when(~crossing, F.col("n"))).alias("local"), F.sum(F.when(crossing, F.col("n"))).alias("cross")).groupBy("dst").agg(
        F.sum("local").alias("local"), F.sum("cross").alias("cross"), F.count("cross").alias("files"))
    factor = (
        F.when(is_test_file(F.col("file")), test).otherwise(1.0) * F.when(is_private(F.col("name")), private).otherwise(1.0)
        * F.when(is_vendor(F.col("file")), vendor).otherwise(1.0)
    )
    n = lambda c: F.coalesce(c, F.lit(0))
    rows = symbols.join(fan, symbols["id"] == fan["dst"], "left").select(
        "id", "qualified_name", "file", n("local").alias("local_fan_in"), n("cross").alias("cross_fan_in"),
        ((n("local") + cross_weight * n("cross") + file_weight * n("files")) * factor).alias("raw"))
    most = F.broadcast(rows.agg(F.max("raw").alias("most")))
    return rows.crossJoin(most).select(
        "id", "qualified_name", "file", "local_fan_in", "cross_fan_in", F.when(F.col("most") > 0, half_up(F.col("raw") / F.col("most"), 4)).otherwise(0.0).alias("score"))


def attention(salience: DataFrame, adaptive_above: int = 1000, critical: float = 0.7, important: float = 0.3, peripheral: float = 0.05) -> DataFrame:
    """(id, score, level).  Above ``adaptive_above`` symbols the cuts are the scores of fixed places in the order.

    Scores have four decimals, so a histogram of at most 10,001 rows gives total and k-th
    score in one pass, whatever the number of symbols.
    """
    histogram = sorted(((r.score, r.n) for r in salience.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    total = sum(n for _, n in histogram)

    def at(k: int) -> float:
        for score, n in histogram:
            k -= n
            if k <= 0:
                return score
        return 0.0

    if total > adaptive_above:
        critical = max(at(min(max(50, int(total * 0.005)), total)), 0.01)
        important = max(min(at(min(max(200, int(total * 0.02)), total)), critical * 0.5), 0.001)
    s = F.col("score")
    level = F.when(s >= critical, "critical").when(s >= important, "important").when(s >= peripheral, "peripheral").otherwise("skip")
    return salience.select("id", "score", level.alias("level"))


def attention_budget(levels: DataFrame) -> DataFrame:
    """(level, symbols), with levels that nobody has."""
    every = levels.sparkSession.createDataFrame([(x,) for x in ("critical", "important", "peripheral", "skip")], "level string")
    return every.join(levels.groupBy("level").agg(F.count("*").alias("n")), "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("symbols"))


def coverage(edges: DataFrame, symbols: DataFrame, tests: DataFrame, hops: int = 2) -> DataFrame:
    """(id, file, status, test_count): reached from a test within ``hops``; the count is of tests that call it directly.

    All tests walk together: the frontier is a set of symbols, not of pairs with a test.
    """
    roots = tests.select(F.col("id").alias("test")).distinct()
    tasks = tasks_of(edges)
    calls = spread(edges, "src", tasks=tasks).join(spread(roots, "test", tasks=tasks).hint("shuffle_hash"), F.col("src") == F.col("test"))
    calls = spread(calls.filter("src <> dst").select("src", "dst"), "src", "dst", tasks=tasks).distinct()
    direct = calls.groupBy("dst").agg(F.count("*").alias("test_count"))
    frontier = direct.select(F.col("dst").alias("here"))
    onward = edges.select(F.col("src").alias("from"), F.col("dst").alias("there"))
    reached = direct.select("dst", "test_count")
    for _ in range(1, hops):
        near = spread(frontier, "here", tasks=tasks).hint("shuffle_hash")  # distinct, and few beside the edges
        frontier = spread(onward, "from", tasks=tasks).join(near, F.col("here") == F.col("from")).select(F.col("there").alias("here")).distinct()
        reached = reached.unionAll(frontier.select("here", F.lit(0)))
    reached = reached.groupBy("dst").agg(F.max("test_count").alias("test_count"))
    rest = symbols.select("id", "file").join(roots, F.col("id") == F.col("test"), "left_anti")
    return rest.join(reached, F.col("id") == F.col("dst"), "left").select(
        "id", "file", F.when(F.col("test_count").isNotNull(), "covered").otherwise("none").alias("status"), F.coalesce("test_count", F.lit(0)).alias("test_count"))


def file_coverage(edges: DataFrame, symbols: DataFrame, tests: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, file, status, test_count, uncovered) by the calls within each file, followed without a bound of hops.

    ``symbols``: id, name, kind, file; ``parents``: id, parent.  A test's walk goes through other tests but does not
    count them.  A type that is reached is partial if one of its functions is not; ``uncovered`` names those.
    """
    files = symbols.select("id", "file")
    inside = edges.join(files.withColumnRenamed("id", "src"), "src").join(files.select(F.col("id").alias("dst"), F.col("file").alias("dst_file")), "dst").filter("file = dst_file").select("src", "dst")
    roots = tests.select("id").distinct()
    reached = reach_fixpoint(inside, roots).join(roots, "id", "left_anti").groupBy("id").agg(F.count("*").alias("tests"))
    rows = symbols.select("id", "name", "kind", "file").join(roots, "id", "left_anti").join(reached, "id", "left")
    missing = rows.filter("kind = 'f' and tests is null").join(parents.filter("parent is not null").select("id", "parent"), "id")
    missing = missing.groupBy(F.col("parent").alias("id")).agg(F.sort_array(F.collect_list("name")).alias("uncovered"))
    some = (F.col("kind") == "t") & F.col("uncovered").isNotNull()
    status = F.when(F.col("tests").isNull(), "none").when(some, "partial").otherwise("covered")
    empty = F.array().cast("array<string>")
    return rows.join(missing, "id", "left").select("id", "file", status.alias("status"), F.coalesce("tests", F.lit(0)).alias("test_count"), F.when(status == "partial", F.col("uncovered")).otherwise(empty).alias("uncovered"))


def project_coverage(base: DataFrame, wide: DataFrame) -> DataFrame:
    """``base`` (of :func:`file_coverage`) raised by ``wide`` (of :func:`coverage`): what other files' tests reach is covered, and the larger count of direct tests stays."""
    more = wide.select("id", F.col("status").alias("wide"), F.col("test_count").alias("direct"))
    raised = (F.col("status") == "none") & F.coalesce(F.col("wide") == "covered", F.lit(False))
    count = F.when(raised, F.col("direct")).otherwise(F.greatest("test_count", F.coalesce("direct", F.lit(0))))
    return base.join(more, "id", "left").select("id", "file", F.when(raised, "covered").otherwise(F.col("status")).alias("status"), count.alias("test_count"))


def partial_types(found: DataFrame, parents: DataFrame) -> DataFrame:
    """``found`` with types 'partial' if a child (parents: id, parent) is not covered."""
    open_ = parents.join(found.filter("status = 'none'").select("id"), "id").select(F.col("parent").alias("id")).distinct().withColumn("open", F.lit(True))
    return found.join(open_, "id", "left").withColumn("status", F.when(F.col("open") & (F.col("status") == "covered"), "partial").otherwise(F.col("status"))).drop("open")


def coverage_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("symbols"), *[F.count_if(F.col("status") == s).alias(s) for s in ("covered", "partial", "none")])


def uncovered_salient(found: DataFrame, salience: DataFrame, least: float = 0.05) -> DataFrame:
    rows = found.filter("status = 'none'").select("id", "file").join(salience.select("id", "score"), "id")
    return rows.filter((F.col("score") >= least) & ~is_vendor(F.col("file")) & ~is_test_file(F.col("file")))


def map_rollup(files: DataFrame) -> DataFrame:
    """(folder, files, symbols) of rows (file, id); with columns original and compressed also their tokens' sums."""
    sums = [F.sum(c).alias(c) for c in ("original", "compressed") if c in files.columns]
    return files.groupBy(top_folder(F.col("file")).alias("folder")).agg(F.countDistinct("file").alias("files"), F.count("*").alias("symbols"), *sums)


def file_map(files: DataFrame, prefix: str = "", limit: int = 200, rollup_above: int = 500) -> DataFrame:
    """What a map of files (file, symbols, original, compressed) shows: folders if there are many files and no ``prefix``
    is given, else the first ``limit`` files below the prefix, with the number of those not shown."""
    files = files.filter(within(F.col("file"), prefix)) if prefix else files
    total = files.count()
    if not prefix and total > rollup_above:
        return files.groupBy(top_folder(F.col("file")).alias("file")).agg(
            F.count("*").alias("files"), *[F.sum(c).alias(c) for c in ("symbols", "original", "compressed")]).withColumn("not_shown", F.lit(0)).orderBy("file")
    shown = files.orderBy("file").limit(limit) if limit > 0 else files.orderBy("file")
    return shown.select("file", F.lit(1).alias("files"), "symbols", "original", "compressed", F.lit(max(0, total - limit) if limit > 0 else 0).alias("not_shown"))


def build_totals(symbols: DataFrame, edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """symbols, files and edges; with ``files`` (file, original, compressed, rebuilt) also tokens, their reduction, and files rebuilt and reused."""
    counted = symbols.agg(F.count("*").alias("symbols"), F.countDistinct("file").alias("files"))
    totals = counted.crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))
    if files is None:
        return totals
    sums = files.agg(F.coalesce(F.sum("original"), F.lit(0)).alias("original"), F.coalesce(F.sum("compressed"), F.lit(0)).alias("compressed"), F.count_if("rebuilt").alias("rebuilt"), F.count_if(~F.col("rebuilt")).alias("reused"))
    return totals.crossJoin(F.broadcast(sums)).withColumn("reduction", reduction(F.col("original"), F.col("compressed")))


def build_line(totals: DataFrame) -> DataFrame:
    """(line): what a build of :func:`build_totals` (with files) has to tell, in a line."""
    return totals.select(F.concat(
        F.format_string("%d files (%d rebuilt, %d reused), %d symbols, %d calls, ", "files", "rebuilt", "reused", "symbols", "edges"),
        F.format_string("%d -> %d tokens (", "original", "compressed"), F.call_function("format_number", 100 * F.col("reduction"), F.lit("0.0")), F.lit("% less)")).alias("line"))


def in_salience_order(salience: DataFrame) -> DataFrame:
    """The most salient first, then by file and id."""
    return salience.orderBy(F.desc("score"), "file", "id")


def having(metrics: DataFrame, column: str, value, ids: DataFrame | None = None) -> DataFrame:
    """The rows of a metric whose ``column`` is ``value``; of the symbols ``ids`` only, if given."""
    found = metrics.filter(F.col(column) == value)
    return found if ids is None else found.join(few(ids.select("id").distinct()), "id", "left_semi")


def enriched(symbols: DataFrame, salience: DataFrame, stability: DataFrame, found: DataFrame) -> DataFrame:
    """Symbols with their metrics; what is missing is 0 or 'unknown'."""
    return (
        symbols.select("id", "qualified_name", "file")
        .join(salience.select("id", "score"), "id", "left").join(stability.select("id", "stability"), "id", "left").join(found.select("id", "status"), "id", "left")
        .select("id", "qualified_name", "file", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("stability", F.lit("unknown")).alias("stability"), F.coalesce("status", F.lit("unknown")).alias("coverage"))
    )


def shared_names(symbols: DataFrame) -> DataFrame:
    """(name, projects): names that more than one project has."""
    return symbols.groupBy("name").agg(F.countDistinct("project").alias("projects")).filter("projects > 1")


def bench_summary(rows: DataFrame) -> DataFrame:
    """Medians and accuracy by task type of rows (type, tokens, calls, ms, correct)."""
    return rows.groupBy("type").agg(*[F.percentile(c, F.lit(0.5)).alias(f"median_{c}") for c in ("tokens", "calls", "ms")], F.avg(F.col("correct").cast("int")).alias("accuracy"))
