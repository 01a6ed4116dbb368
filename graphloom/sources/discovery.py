"""Source trees: which files count, their language, stamps and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Suffixes of the languages.
LANGUAGES = {
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".h": "cpp", ".rs": "rust", ".py": "python", ".ts": "typescript", ".tsx": "tsx",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".go": "go", ".java": "java",
}
# Folders of others' code, left out unless asked for.
VENDORED = ("vendor", "third_party", "thirdparty")
# Folders that are never source.
SKIP = (
    ".venv", "venv", ".env", "env",
    ".git", ".hg", ".svn",
    ".hypothesis", ".pytest_cache", "__pycache__",
    "node_modules", ".tox", ".mypy_cache", ".ruff_cache",
    "build", "dist", ".eggs",
    "target",
    "out", "output",
    "bin", "obj",
    "pkg",
    ".next",
    "coverage",
) + VENDORED


def ignore_rules(text: str) -> tuple[set[str], set[str]]:
    """Folders to skip and to keep, from lines ``name``, ``!name`` and ``# comment``."""
    rules = [line.strip().rstrip("/") for line in text.splitlines() if line.strip() and not line.strip().startswith("#")]
    return {r for r in rules if not r.startswith("!")}, {r[1:] for r in rules if r.startswith("!")}


def skip_set(ignores: set[str] = frozenset(), keeps: set[str] = frozenset(), with_vendor: bool = False) -> set[str]:
    return (set(SKIP) | set(ignores)) - (set(VENDORED) if with_vendor else set()) - set(keeps)


def pathspecs(skip: set[str]) -> list[str]:
    """What a version control log is asked for: the suffixes of the languages, without the folders skipped."""
    return [f"*{suffix}" for suffix in sorted(LANGUAGES)] + [spec for folder in sorted(skip) for spec in (f":(exclude){folder}", f":(exclude)*/{folder}/*")]


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def is_source(path: Column, skip: set[str]) -> Column:
    """A known suffix, and no folder that is skipped or hidden."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    bad = F.exists(folders, lambda p: p.isin(*sorted(skip)) | (p.startswith(".") & (p != ".") & (p != "..")))
    return language(path).isNotNull() & ~bad


def folders(spark: SparkSession, root: str, skip: set[str]) -> list[str]:
    """The folders of a tree that may hold sources; skipped and hidden ones are not entered."""
    start = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = start.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, rest = [], [system.makeQualified(start)]
    while rest:
        here = rest.pop()
        found.append(here.toString())
        rest += [s.getPath() for s in system.listStatus(here) if s.isDirectory() and s.getPath().getName() not in skip and not s.getPath().getName().startswith(".")]
    return sorted(found)


def discover(spark: SparkSession, root: str, skip: set[str] | None = None) -> DataFrame:
    """(path, language, text, size, modified, content_hash) of the tree's sources; path is relative to ``root``.

    Only folders that count are listed and only files with a language's suffix are read.
    """
    skip = skip if skip is not None else skip_set()
    where = folders(spark, root, skip)
    either = lambda suffix: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*{" + ",".join(either(s) for s in LANGUAGES) + "}").load(where)
    base = min(where, key=len).rstrip("/")
    path = F.substring(F.col("path"), F.lit(len(base) + 2), F.length("path"))
    found = files.select(path.alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return found.filter(is_source(F.col("path"), skip)).select(
        "path", language(F.col("path")).alias("language"), F.decode("content", "utf-8").alias("text"), "size", "modified", F.sha2("content", 256).alias("content_hash"))


def stamps(spark: SparkSession, root: str, skip: set[str] | None = None) -> DataFrame:
    """(path, size, modified) of the tree's sources; no file is read."""
    return discover(spark, root, skip).select("path", "size", "modified")


def commit_log(spark: SparkSession, path: str, most: int | None = 5_000) -> DataFrame:
    """(path, sha, ts, added, deleted) from the text of ``git log --numstat --format='commit %H %cI'``, one file a repository.

    A log is read commit by commit, so a long one is no single row.  Of each repository the
    newest ``most`` commits count.
    """
    text = spark.read.option("lineSep", "\ncommit ").text(path).select(F.input_file_name().alias("log"), F.regexp_replace("value", "^commit ", "").alias("block")).filter("trim(block) <> ''")
    head = text.select(
        "log", F.regexp_extract("block", r"^(\S+)", 1).alias("sha"), F.to_timestamp_ntz(F.regexp_extract("block", r"^\S+ (\S{19})", 1), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("ts"), "block")
    if most is not None:
        newest = Window.partitionBy("log").orderBy(F.desc("ts"), "sha")
        head = head.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= most)
    stat = r"^(\d+|-)\t(\d+|-)\t(.+)$"
    lines = head.select("sha", "ts", F.explode(F.split("block", "\n")).alias("line")).filter(F.col("line").rlike(stat))
    return lines.select(
        F.regexp_extract("line", stat, 3).alias("path"), "sha", "ts", F.regexp_extract("line", stat, 1).try_cast("int").alias("added"), F.regexp_extract("line", stat, 2).try_cast("int").alias("deleted"))


def blame(texts: DataFrame) -> DataFrame:
    """(file, line, ts) from texts (file, text) of ``git blame --line-porcelain``; lines from 0, broken blocks left out."""
    blocks = texts.select("file", F.explode(F.split("text", r"(?m)^(?=[0-9a-f]{40} \d+ \d+)")).alias("block"))
    line = F.regexp_extract("block", r"^[0-9a-f]{40} \d+ (\d+)", 1).try_cast("int") - 1
    seconds = F.regexp_extract("block", r"(?m)^author-time (\d+)$", 1).try_cast("long")
    rows = blocks.filter(F.col("block").rlike(r"(?m)^\t")).select("file", line.alias("line"), F.timestamp_seconds(seconds).alias("at"))
    return rows.filter("line is not null and at is not null").select("file", "line", F.to_timestamp_ntz(F.date_format("at", "yyyy-MM-dd HH:mm:ss")).alias("ts"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(conv, turn, role, text) from JSON files, each a list of messages or an object with ``messages``."""
    message = "array<struct<role:string,content:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("conv"), "value")
    wrapped = F.from_json("value", f"struct<messages:{message}>")["messages"]
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", message))
    return raw.select("conv", F.posexplode(F.coalesce(listed, wrapped)).alias("turn", "m")).select("conv", "turn", F.coalesce("m.role", F.lit("unknown")).alias("role"), F.coalesce("m.content", F.lit("")).alias("text"))


def workspace(spark: SparkSession, path: str) -> dict[str, str]:
    """Project name -> folder, relative to the file's own; an empty or broken file is an error."""
    text = "\n".join(r.value for r in spark.read.text(path).collect())  # a configuration file
    import json
    import posixpath

    projects = json.loads(text)
    if not isinstance(projects, dict) or not projects:
        raise ValueError(f"no projects in {path}")
    return {name: posixpath.normpath(posixpath.join(posixpath.dirname(path), where)) for name, where in projects.items()}
