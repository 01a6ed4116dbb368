"""Several projects as one: union with a project column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.predicates import task_words
from graphloom.operators.graph import callers
from graphloom.operators.search import search


def tagged(projects: dict[str, DataFrame]) -> DataFrame:
    """The union of tables with project and position (its place in the configuration)."""
    return reduce(DataFrame.unionByName, [df.withColumn("project", F.lit(name)).withColumn("position", F.lit(i)) for i, (name, df) in enumerate(projects.items())])


def opened(projects: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(tables, warnings): the projects whose table can be read, and why others can't; none stops the rest."""
    tables, warnings = {}, {}
    for name, table in projects.items():
        try:
            tables[name] = table()
            tables[name].limit(1).collect()
        except Exception as error:  # noqa: BLE001  whatever fails belongs in the warning
            tables.pop(name, None)
            warnings[name] = f"{type(error).__name__}: {str(error)[:200]}"
    return tables, warnings


def search_all(projects: dict[str, DataFrame], query: str, limit: int = 25) -> DataFrame:
    """Each project's hits, each by its own token weights, in one ranking; all projects are scanned at once."""
    hits = search(tagged(projects), query, "project")
    return hits.select("id", "qualified_name", "kind", "file", "score", "match", "project").orderBy(F.desc("score"), "project", "qualified_name", "id").limit(limit)


def callers_all(projects: dict[str, tuple[DataFrame, DataFrame]], targets: DataFrame) -> DataFrame:
    """(id, caller, caller_name, project): the callers of ``targets`` in every project (edges, symbols)."""
    return tagged({name: callers(edges, symbols, targets) for name, (edges, symbols) in projects.items()}).drop("position")


def resolve_first(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, project): the first project, in the configuration's order, that has the id."""
    first = Window.partitionBy("id").orderBy("position", "file")
    return symbols.join(ids, "id").withColumn("place", F.row_number().over(first)).filter("place = 1").select("id", "project", "qualified_name")


def brief_all(projects: dict[str, DataFrame], task: str, most: int = 15, per_project: int = 5) -> DataFrame:
    """(project, id, qualified_name, kind, file, score, match, shared): the best hits for a task over all projects.

    Content words first, the task as it stands if they find nothing.  Of the ``most`` best at most ``per_project`` of a
    project are shown; ``shared`` lists the projects among the best that have a symbol of the same simple name.
    """
    top = search_all(projects, " ".join(task_words(task)) or task, most)
    if top.isEmpty():
        top = search_all(projects, task, most)
    top = F.broadcast(top.withColumn("simple", F.element_at(F.split("qualified_name", "::"), -1)))
    names = top.groupBy("simple").agg(F.sort_array(F.collect_set("project")).alias("shared")).filter(F.size("shared") > 1)
    order = Window.partitionBy("project").orderBy(F.desc("score"), "qualified_name", "id")
    shown = top.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_project).drop("place")
    return shown.join(F.broadcast(names), "simple", "left").select(
        "project", "id", "qualified_name", "kind", "file", "score", "match", F.coalesce("shared", F.array().cast("array<string>")).alias("shared"))


def status(changes: dict[str, DataFrame]) -> DataFrame:
    """(project, files, stale) from each project's changes (path, change)."""
    return tagged(changes).groupBy("project").agg(F.count_if(F.col("change") != "removed").alias("files"), F.count_if(F.col("change") != "fresh").alias("stale"))


def build_report(projects: dict[str, callable]) -> list[dict]:
    """Each project's build, a callable that returns a one-row DataFrame; a failure is reported and the others go on."""
    report = []
    for name, build in projects.items():
        try:
            report.append({"project": name, "ok": True} | build().first().asDict())
        except Exception as error:  # noqa: BLE001  whatever fails belongs in the report
            report.append({"project": name, "ok": False, "error": str(error)[:200]})
    return report
