"""Change history: churn, stability, hot files, decay of confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.identifiers import half_up


def stability_of(churn: Column) -> Column:
    return F.when(churn >= 3, "volatile").when(churn >= 1, "active").otherwise("stable")


def churn_label(churn: Column) -> Column:
    return F.when(churn >= 3, "high").when(churn >= 1, "medium").otherwise("low")


def file_history(commits: DataFrame, reference: str, window_days: int = 90, least_commits: int = 3) -> DataFrame:
    """(path, commits, age_days, last_modified_days, churn, stability) from commits (path, sha, ts).

    Churn is the distinct days with a commit within the window; files of fewer commits
    than ``least_commits`` are stable, with zeros.
    """
    now = F.lit(reference).cast("timestamp_ntz")
    since = now - F.expr(f"INTERVAL '{window_days}' DAY")
    rows = commits.groupBy("path").agg(
        F.count("*").alias("commits"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.count_distinct(F.when(F.col("ts") >= since, F.col("ts").cast("date"))).alias("days"))
    enough = F.col("commits") >= least_commits
    days = lambda c: F.when(enough, F.timestamp_diff("DAY", c, now)).otherwise(0).cast("long")
    churn = F.when(enough, F.col("days")).otherwise(0)
    return rows.select("path", "commits", days(F.col("first")).alias("age_days"), days(F.col("last")).alias("last_modified_days"), churn.alias("churn"), stability_of(churn).alias("stability"))


def blamed_spans(spans: DataFrame, lines: DataFrame, reference: str, window_days: int = 90, block: int = 64) -> DataFrame:
    """(file, start, stop, first, last, days) of the distinct spans that hold dated lines.

    Lines are summed first, to their dates' extremes and distinct recent days; files are cut
    into blocks of lines, so a span meets only the lines of the blocks that it touches.
    """
    since = F.lit(reference).cast("timestamp_ntz") - F.expr(f"INTERVAL '{window_days}' DAY")
    cut = lambda line: F.floor(line / block).cast("long")
    day = F.when(F.col("ts") >= since, F.col("ts").cast("date"))
    dated = lines.groupBy("file", "line", day.alias("day")).agg(F.min("ts").alias("first"), F.max("ts").alias("last")).withColumn("block", cut(F.col("line")))
    each = spans.select("file", "start", "stop").distinct().withColumn("block", F.explode(F.sequence(cut(F.col("start")), cut(F.greatest("start", "stop")))))
    met = each.join(dated, ["file", "block"]).filter(F.col("line").between(F.col("start"), F.col("stop")))
    return met.groupBy("file", "start", "stop").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count_distinct("day").alias("days"))


def span_history(spans: DataFrame, lines: DataFrame, reference: str, window_days: int = 90) -> DataFrame:
    """(id, age_days, last_modified_days, churn) of symbols (id, file, start, stop) from the dates of their lines (file, line, ts)."""
    now = F.lit(reference).cast("timestamp_ntz")
    found = blamed_spans(spans, lines, reference, window_days)
    return spans.join(found, ["file", "start", "stop"]).select(
        "id", F.timestamp_diff("DAY", "first", now).alias("age_days"), F.timestamp_diff("DAY", "last", now).alias("last_modified_days"), F.col("days").alias("churn"))


def symbol_history(spans: DataFrame, lines: DataFrame, commits: DataFrame, reference: str, window_days: int = 90, least_commits: int = 3) -> DataFrame:
    """(id, file, age_days, last_modified_days, churn, stability) of every symbol, as far as history tells.

    Lines of several dates: each symbol by its own lines (zeros if none is dated).  Lines of
    one date: that date, and the file's commits as churn.  No lines: the file's first and
    last commit, and its days within the window.  A repository of under ``least_commits``
    commits: stable, zeros.  No commits and no lines of the file: by its lines, or active.
    """
    now = F.lit(reference).cast("timestamp_ntz")
    since = now - F.expr(f"INTERVAL '{window_days}' DAY")
    days = lambda c: F.greatest(F.lit(0), F.timestamp_diff("DAY", c, now)).cast("long")
    blamed = lines.groupBy("file").agg(F.count_distinct("ts").alias("dates"), F.min("ts").alias("only"))
    logged = commits.groupBy(F.col("path").alias("file")).agg(
        F.count("*").alias("commits"), F.min("ts").alias("begun"), F.max("ts").alias("ended"), F.count_distinct(F.when(F.col("ts") >= since, F.col("ts").cast("date"))).alias("busy"))
    repository = F.broadcast(commits.agg(F.count_distinct("sha").alias("all_commits")))
    own = blamed_spans(spans, lines, reference, window_days)
    rows = spans.select("id", "file", "start", "stop").join(own, ["file", "start", "stop"], "left").join(blamed, "file", "left").join(logged, "file", "left").crossJoin(repository)
    by_line, tracked = F.coalesce("dates", F.lit(0)) > 1, F.col("commits").isNotNull() | F.col("dates").isNotNull()
    case = (
        F.when(by_line, "lines").when(~tracked, "untracked").when(F.col("all_commits") < least_commits, "short")
        .when(F.col("dates").isNull(), "log").when(F.col("commits").isNotNull(), "uniform").otherwise("lines"))
    rows = rows.withColumn("case", case)
    pick = lambda lined, logged, uniform: F.when(F.col("case") == "lines", lined).when(F.col("case") == "log", logged).when(F.col("case") == "uniform", uniform)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    churn = zero(pick(F.col("days"), F.col("busy"), F.col("commits")))
    return rows.select(
        "id", "file", zero(pick(days("first"), days("begun"), days("only"))).alias("age_days"), zero(pick(days("last"), days("ended"), days("only"))).alias("last_modified_days"),
        churn.alias("churn"), F.when(F.col("case") == "untracked", "active").otherwise(stability_of(churn)).alias("stability"))


def insufficient(history: DataFrame) -> DataFrame:
    """Whether the history tells files apart at all."""
    return history.agg((F.greatest(F.countDistinct("stability"), F.countDistinct("age_days"), F.countDistinct("churn")) <= 1).alias("insufficient"))


def hot_files(commits: DataFrame, most: int = 200) -> DataFrame:
    """The ``most`` files that were changed last."""
    return commits.groupBy("path").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "path").limit(most)


def decayed(inferences: DataFrame, stability: DataFrame, reference: str) -> DataFrame:
    """``inferences`` (seq, target, confidence, ts) with what is left of their confidence; volatile code forgets fastest."""
    rate = F.when(F.col("stability") == "volatile", 0.05).when(F.col("stability") == "active", 0.02).when(F.col("stability") == "stable", 0.005).otherwise(0.01)
    age = F.timestamp_diff("DAY", F.col("ts"), F.lit(reference).cast("timestamp_ntz"))
    joined = inferences.join(stability.select(F.col("path").alias("target"), "stability"), "target", "left").withColumn("stability", F.coalesce("stability", F.lit("stable")))
    return joined.select("seq", "target", "stability", half_up(F.col("confidence") * F.exp(-rate * age), 3).alias("confidence"))


def in_order(history: DataFrame) -> DataFrame:
    """Volatile first, then by churn."""
    rank = F.when(F.col("stability") == "volatile", 0).when(F.col("stability") == "active", 1).otherwise(2)
    return history.orderBy(rank, F.desc("churn"), "path")


def hottest(commits: DataFrame, lines: DataFrame, most: int = 200) -> DataFrame:
    """The lines (file, line, ts) of the ``most`` files that were changed last; the others' history is left to their commits."""
    return lines.join(F.broadcast(hot_files(commits, most).select(F.col("path").alias("file"))), "file", "left_semi")
