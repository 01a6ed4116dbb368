"""Text artifacts: tables as sections of lines, written and read back; the JSON index; the store.

A line is ``key=value`` pairs after the record's id; a section starts with ``[NAME]``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.joins import delete, exists, numbered, stored

SCHEMA_VERSION = "1"


def _escaped(value: Column) -> Column:
    return F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))


#: How the rows of each section of the project's artifacts are told: what begins the line, the attributes
#: (name, expression) that follow, and the order of the lines.
SECTIONS: dict[str, tuple[str, tuple[tuple[str, str], ...], tuple[str, ...]]] = {
    "FILES": ("path", (("hash", "hash"), ("lang", "language"), ("syms", "symbols"), ("calls", "calls"), ("tokens", "concat(original, '->', compressed)"),
                       ("reduction", "concat(format_number(reduction * 100, '0.0'), '%')")), ("path",)),
    "SYMBOLS": ("concat(id, '=', qualified_name)", (("file", "file"), ("kind", "kind"), ("scope", "nullif(scope, '')"), ("sig", "nullif(signature_hash, '')"),
                                                    ("span", "if(line_from > 0, concat(line_from, '-', line_to), null)"), ("lang", "nullif(language, '')")), ("file", "id")),
    "IMPORTS": ("concat(id, '=', qualified_name)", (("file", "file"), ("kind", "kind")), ("file", "id")),
    "TREE": ("path", (("lang", "language"), ("syms", "symbols")), ("path",)),
    "DEPS": ("concat(source, '->', target)", (("syms", "symbols"),), ("source", "target")),
    "XREFS": ("concat(caller, '(', caller_name, ')->', callee, '(', callee_name, ')')", (("src", "source_file"), ("dst", "target_file")), ("source_file", "caller", "callee")),
    "FILEDEPS": ("concat(source, '->', target)", (("refs", "refs"),), ("source", "target")),
    "SCORES": ("concat(id, ' ', qualified_name)", (("file", "file"), ("score", "score"), ("local", "local_fan_in"), ("xfile", "cross_fan_in"), ("total", "local_fan_in + cross_fan_in")), ("-score", "file", "id")),
    "BUDGET": ("concat(level, '=', symbols)", (), ("level",)),
    "ENTRIES": ("concat(id, ' ', level, ' ', qualified_name)", (("file", "file"), ("score", "score")), ("-score", "id")),
    "TEMPORAL": ("id", (("age", "concat(age_days, 'd')"), ("last", "concat(last_modified_days, 'd')"), ("churn", "churn_label"), ("stability", "stability")),
                 ("case stability when 'volatile' then 0 when 'active' then 1 else 2 end", "-churn", "file", "id")),
    "COVERED": ("concat(id, ' ', qualified_name)", (("tests", "test_count"), ("file", "file")), ("file", "id")),
    "UNCOVERED": ("concat(id, ' ', qualified_name)", (("file", "file"),), ("-score", "id")),
    "CALLS": ("concat(src, '->', dst)", (), ("src", "dst")),
    "CALLMETA": ("concat_ws('|', caller, callee_name, status, coalesce(resolved_id, ''), candidates)", (), ("caller", "callee_name")),
    "INTENTS": ("concat(id, ' ', tag, ':', description, ' [', confidence, ']')", (), ("id", "tag", "description")),
    "SOURCES": ("concat(id, ' ', error, ' ', propagation, ' -> caller')", (), ("id", "error")),
    "BOUNDARIES": ("id", (("catches", "catches"), ("recovery", "recovery")), ("id",)),
    "UNHANDLED": ("concat(id, ' ', error, ': No error boundary in ', id, ' for ', error)", (), ("id", "error")),
    "COVERAGE": ("id", (("status", "status"), ("tests", "coalesce(nullif(tests, ''), 'none')"), ("uncovered", "nullif(uncovered, '')")), ("id",)),
    "TESTS": ("id", (("covers", "coalesce(nullif(covers, ''), 'none')"), ("behaviors", "coalesce(nullif(behaviors, ''), 'none')")), ("id",)),
}


def told(rows: DataFrame, section: str) -> DataFrame:
    """(section, at, line): the rows as the lines of a section of :data:`SECTIONS`, numbered in its order."""
    head, attributes_, order = SECTIONS[section]
    pairs = [f"concat('{name}=', {value})" for name, value in attributes_]
    line = F.expr(f"concat_ws(' ', {', '.join([head, *pairs])})")
    key = [F.desc(o[1:]) if o.startswith("-") else F.expr(o) for o in order]
    return numbered(rows, key, "at").select(F.lit(section).alias("section"), "at", line.alias("line"))


def write_sections(sections: list[DataFrame], path: str, header: str = "") -> None:
    """Sections of :func:`told` as one text file in their order, each between ``[NAME]`` and ``[/NAME]``."""
    spark, parts = sections[0].sparkSession, []
    for n, rows in enumerate(sections):
        name = rows.select("section").limit(1).collect()
        if not name:
            continue
        marks = spark.createDataFrame([(n, -1, f"[{name[0].section}]"), (n, 1 << 62, f"[/{name[0].section}]")], "part int, at long, line string")
        parts += [marks, rows.select(F.lit(n).alias("part"), F.col("at").cast("long"), "line")]
    if header:
        parts.insert(0, spark.createDataFrame([(-1, i, h) for i, h in enumerate(header.split("\n"))], "part int, at long, line string"))
    rows = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], "part int, at long, line string")
    rows.repartitionByRange("part", "at").sortWithinPartitions("part", "at").select("line").write.mode("overwrite").text(path)


def header_of(spark: SparkSession, path: str, lines_read: int = 8) -> dict[str, str]:
    """The ``[KEY:value]`` lines among the first few of an artifact; empty if it is missing or has none."""
    if not exists(spark, path):
        return {}
    first = [r.value.strip() for r in spark.read.text(path).limit(lines_read).collect()]
    return {found[1]: found[2] for x in first if (found := re.fullmatch(r"\[([A-Z_]+):(.*)\]", x))}


def staleness(header: dict[str, str], live_roots: tuple[str, ...], scheme: int) -> str | None:
    """Why ids of artifacts with this header may be out of date: case, location, scheme, or None."""
    if not header:
        return None
    root = header.get("ROOT")
    if root and root not in live_roots:
        return "case" if root.lower() in {r.lower() for r in live_roots} else "location"
    recorded = header.get("ID_SCHEME", "1")
    return "scheme" if (int(recorded) if recorded.isdigit() else 1) < scheme else None


def artifact_folder(spark: SparkSession, project: str, subfolder: str, markers: tuple[str, ...]) -> str:
    """Where a project's artifacts lie: in ``subfolder`` if that holds one of ``markers``, else in the project itself."""
    inner = f"{project.rstrip('/')}/{subfolder}"
    return inner if any(exists(spark, f"{inner}/{m}") for m in markers) else project


def lines(rows: DataFrame, section: str, key: str = "id") -> DataFrame:
    """(section, line) for each row."""
    rest = [c for c in rows.columns if c != key]
    pairs = [F.concat(F.lit(f"{c}="), _escaped(F.col(c))) for c in rest]
    return rows.select(F.lit(section).alias("section"), F.concat_ws(" ", _escaped(F.col(key)), *pairs).alias("line"))


def write_artifact(sections: DataFrame, path: str) -> None:
    """Files of ordered lines, one folder a section."""
    sections.repartitionByRange("section", "line").sortWithinPartitions("section", "line").write.mode("overwrite").partitionBy("section").text(path)


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line").select("section", "line")


def attributes(line: Column) -> Column:
    """The ``key=value`` pairs of a line as a map."""
    return F.str_to_map(F.regexp_replace(line, r"^\S+\s*", ""), F.lit(" "), F.lit("="))


def parsed(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """The inverse of :func:`lines`: columns of the types in ``fields``."""
    back = lambda c: F.replace(F.replace(c, F.lit("%20"), F.lit(" ")), F.lit("%25"), F.lit("%"))
    pairs = attributes(F.col("line"))
    return rows.select(back(F.regexp_extract("line", r"^(\S+)", 1)).alias(key), *[back(F.element_at(pairs, name)).cast(kind).alias(name) for name, kind in fields.items()])


def read_sections(texts: DataFrame) -> DataFrame:
    """(artifact, section, at, line) of texts (artifact, text) with ``[NAME]`` headings; a heading holds until the next."""
    split = texts.select("artifact", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    heading = F.nullif(F.regexp_extract("line", r"^\[([A-Z_ ]+)\]", 1), F.lit(""))
    order = Window.partitionBy("artifact").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return split.withColumn("section", F.last(heading, ignorenulls=True).over(order)).filter("line <> ''").filter(heading.isNull())


def bundle(symbols: DataFrame, calls: DataFrame, bodies: DataFrame) -> DataFrame:
    """(file, json): each file's symbols, calls (src, dst) and bodies (id, level, content, original) as one JSON text."""
    own = symbols.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("id", "kind", "name", "qualified_name", "scope"))).alias("symbols"))
    files = symbols.select("id", "file")
    sent = calls.join(files.withColumnRenamed("id", "src"), "src").groupBy("file").agg(F.sort_array(F.collect_set(F.struct("src", "dst"))).alias("calls"))
    kept = bodies.join(files, "id").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("id", "level", "content", "original"))).alias("bodies"))
    rows = own.join(sent, "file", "left").join(kept, "file", "left")
    return rows.select("file", F.to_json(F.struct(F.lit("1.0").alias("version"), F.col("file").alias("source_file"), "symbols", "calls", "bodies")).alias("json"))


#: The JSON index: for each file its symbols with the hashes of their signatures and bodies, and its calls.
INDEX = ("struct<symbols:array<struct<id:string,qualified_name:string,kind:string,signature_hash:string,body_hash:string>>,"
         "calls:array<struct<src:string,dst:string>>>")


def index(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, symbols, calls): the index, a row a file; symbols need signature and body_text."""
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    row = F.struct("id", "qualified_name", "kind", digest("signature").alias("signature_hash"), digest("body_text").alias("body_hash"))
    by_file = symbols.groupBy("file").agg(F.sort_array(F.collect_list(row)).alias("symbols"))
    calls = edges.join(symbols.select(F.col("id").alias("src"), "file"), "src").groupBy("file").agg(F.sort_array(F.collect_set(F.struct("src", "dst"))).alias("calls"))
    return by_file.join(calls, "file", "left")


def write_index(rows: DataFrame, path: str) -> None:
    """The index as JSON lines {"file": ..., "entry": ...}."""
    rows.select("file", F.struct("symbols", F.coalesce("calls", F.array().cast("array<struct<src:string,dst:string>>")).alias("calls")).alias("entry")).write.mode("overwrite").json(path)


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """symbols (file, id, qualified_name, kind, signature_hash, body_hash) and calls (file, src, dst) of an index; a missing one is empty, broken lines are left out."""
    schema = f"file string, entry {INDEX}"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return {"symbols": rows.select("file", F.explode("entry.symbols").alias("s")).select("file", "s.*"), "calls": rows.select("file", F.explode("entry.calls").alias("c")).select("file", "c.*")}


def read_cache(spark: SparkSession, path: str, version: str, entry: str) -> DataFrame:
    """(path, entry) of a JSON build cache {"version": ..., "files": {path: entry}}; none if it is missing, broken or of another version."""
    files = f"map<string,{entry}>"
    empty = spark.createDataFrame([], f"path string, entry {entry}")
    if not exists(spark, path):
        return empty
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<version:string,files:{files}>").alias("x"))
    return rows.filter(F.col("x.version") == version).select(F.explode("x.files").alias("path", "entry"))


BUCKETS = 64


def _bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("file"), F.lit(BUCKETS)).cast("int"))


def replace_files(spark: SparkSession, path: str, rows: DataFrame, gone: DataFrame | None = None) -> None:
    """Rows of a table of files (in ``BUCKETS`` folders by a hash of the file): those of the files that ``rows`` has are
    replaced, those of the files ``gone`` (file) deleted, all others stay.  Only folders concerned are written."""
    fresh = stored(rows, "fresh")
    changed = fresh.select("file").distinct()
    changed = stored(changed.unionAll(gone.select("file")).distinct() if gone is not None else changed, "changed")
    touched = sorted(r.bucket for r in _bucketed(changed).select("bucket").distinct().collect())  # at most BUCKETS numbers
    if not touched:
        if not exists(spark, path):
            _bucketed(fresh).write.partitionBy("bucket").parquet(path)
        return
    out = _bucketed(fresh)
    if exists(spark, path):
        old = spark.read.schema(out.schema).parquet(path).filter(F.col("bucket").isin(touched))
        out = stored(old.join(changed, "file", "left_anti").select(*out.columns).unionAll(out), "replaced")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    left = {r.bucket for r in out.select("bucket").distinct().collect()}
    for bucket in set(touched) - left:  # a folder without rows is not written over
        delete(spark, f"{path}/bucket={bucket}")


def save_store(tables: dict[str, DataFrame], path: str, gone: DataFrame | None = None) -> None:
    """Parquet tables with a version; a table with a file column is replaced file by file, others as a whole."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        if "file" in df.columns:
            replace_files(spark, f"{path}/{name}", df, gone)
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([("schema_version", SCHEMA_VERSION)], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def persist_build(spark: SparkSession, path: str, files: DataFrame, per_file: dict[str, DataFrame], derived: dict[str, DataFrame]) -> dict[str, int]:
    """A build into the store: rebuilt files' rows are replaced, vanished files' deleted, derived tables written whole.

    ``files`` (file, rebuilt) are all that exist now; ``per_file`` tables have the rows of the rebuilt ones.  Returns the
    numbers of files written and removed.
    """
    now = files.select("file").distinct()
    known = read_table(spark, f"{path}/files")
    gone = known.select("file").distinct().join(now, "file", "left_anti") if known is not None else spark.createDataFrame([], "file string")
    gone = stored(gone, "gone")
    removed = gone.count()
    written = files.filter("rebuilt").select("file").distinct().count()
    for name, df in per_file.items():
        rest = files.filter("rebuilt").select("file").join(df.select("file").distinct(), "file", "left_anti")  # rebuilt, but without rows now
        replace_files(spark, f"{path}/{name}", df, gone.unionAll(rest))
    replace_files(spark, f"{path}/files", files.filter("rebuilt"), gone)
    for name, df in derived.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([("schema_version", SCHEMA_VERSION)], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return {"files_written": written, "files_removed": removed}


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path).drop("bucket") if exists(spark, path) else None


def load_store(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a store of the current version; another version, or none, counts as no store."""
    if not exists(spark, f"{path}/meta"):
        return {}
    version = {r.key: r.value for r in spark.read.parquet(f"{path}/meta").collect()}.get("schema_version")
    if version != SCHEMA_VERSION:
        return {}
    return {name: read_table(spark, f"{path}/{name}") for name in names}


def compact(spark: SparkSession, path: str, target: str, files: int) -> None:
    """The table in fewer files, in another folder: a folder is not read and overwritten at once."""
    spark.read.parquet(path).repartition(files).write.mode("overwrite").parquet(target)


class Versions:
    """A small table kept as numbered versions: a save is a new folder, complete or not there, and the last good ones stay.

    A version that can't be read is set aside and the one before it counts; without any the
    state is empty.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, kept: int = 2):
        self.spark, self.path, self.schema, self.kept = spark, path.rstrip("/"), schema, kept

    def _numbers(self) -> list[int]:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
        return sorted(int(n[2:]) for n in names if re.fullmatch(r"v=\d+", n) and system.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def load(self) -> DataFrame:
        for number in reversed(self._numbers()):
            try:
                rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/v={number}")
                rows.foreach(lambda _: None)  # every file of it must be readable
                return rows
            except Exception:  # noqa: BLE001  whatever makes it unreadable, the version before it counts
                self._set_aside(number)
        return self.spark.createDataFrame([], self.schema)

    def _set_aside(self, number: int) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        system = place(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        system.rename(place(f"{self.path}/v={number}"), place(f"{self.path}/corrupt-{number}"))

    def save(self, rows: DataFrame) -> int:
        number = max(self._numbers(), default=0) + 1
        rows.write.mode("errorifexists").parquet(f"{self.path}/v={number}")
        for old in self._numbers()[: -self.kept]:
            delete(self.spark, f"{self.path}/v={old}")
        return number

    def change(self, edit: Callable[[DataFrame], DataFrame]) -> int:
        """Read, edit and save; if somebody else saved meanwhile the folder exists already and nothing is written."""
        number = max(self._numbers(), default=0) + 1
        rows = edit(self.load())
        rows.write.mode("errorifexists").parquet(f"{self.path}/v={number}")
        for old in self._numbers()[: -self.kept]:
            delete(self.spark, f"{self.path}/v={old}")
        return number
