"""Symbols and links from call sites: identity, enclosing spans, resolution, hierarchy, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.joins import apart, few, spread, stored, tasks_of
from graphloom.functions.predicates import is_vendor

# Names of builtins and standard libraries, which link no files.
BUILTIN_NAMES = (
    # Python
    "print", "len", "range", "str", "int", "float", "bool", "list", "dict",
    "set", "tuple", "type", "isinstance", "issubclass", "hasattr", "getattr",
    "setattr", "delattr", "super", "open", "close", "read", "write", "append",
    "extend", "pop", "get", "keys", "values", "items", "update", "format",
    "join", "split", "strip", "replace", "startswith", "endswith", "encode",
    "decode", "sort", "sorted", "reversed", "enumerate", "zip", "map", "filter",
    "any", "all", "min", "max", "sum", "abs", "round", "iter", "next", "hash",
    "id", "repr", "input", "exit", "vars", "dir", "help", "property",
    "staticmethod", "classmethod", "callable",
    "run", "call", "dump", "dumps", "load", "loads", "copy", "move", "remove",
    "exists", "mkdir", "makedirs", "walk", "glob", "match", "search", "find",
    "compile", "execute", "connect", "send", "recv", "accept", "listen", "bind",
    "sleep", "time", "now",
    # C, C++, Rust
    "main", "malloc", "free", "sizeof", "printf", "fprintf", "scanf",
    "memcpy", "memset", "strlen", "strcmp", "strcpy",
    "push", "push_back", "emplace_back", "begin", "end", "size", "empty",
    "insert", "erase", "clear", "front", "back", "top", "data",
    "lock", "unlock", "try_lock", "clone", "drop", "into", "from",
    "unwrap", "expect", "ok", "err", "some", "none",
    "unwrap_or_else", "unwrap_or", "unwrap_or_default",
    "and_then", "or_else", "ok_or_else", "ok_or",
    "map_err", "map_or", "map_or_else",
    "is_some", "is_none", "is_ok", "is_err",
    "as_ref", "as_mut", "as_slice", "as_ptr",
    "into_iter", "iter", "iter_mut",
    "to_string", "to_owned", "to_vec",
    "fmt", "eq", "ne", "cmp", "partial_cmp",
    "hash", "default", "deref", "deref_mut",
    "index", "index_mut",
    "try_from", "try_into", "from_str", "parse",
    "new", "build", "with_capacity",
    # JavaScript, TypeScript
    "constructor", "prototype", "toString", "valueOf", "hasOwnProperty",
    "addEventListener", "removeEventListener", "querySelector",
    "getElementById", "createElement", "appendChild",
    "then", "catch", "finally", "resolve", "reject",
    "require", "exports",
    "readFileSync", "writeFileSync", "readFile", "writeFile",
    "existsSync", "mkdirSync", "readdirSync", "statSync", "unlinkSync",
    "warn", "info", "error", "debug", "log", "trace",
    "finish", "destroy", "pipe", "emit", "on", "once", "off",
    "render", "mount", "unmount", "dispose",
    # Go
    "make", "cap", "panic", "recover", "string", "byte", "rune",
    "Println", "Printf", "Sprintf", "Fprintf", "Errorf",
    "Error", "String", "Close", "Read", "Write",
    "Len", "Cap", "Append", "Copy", "Delete",
)


def deduplicated(symbols: DataFrame) -> DataFrame:
    """The first of each identity (qualified name, scope, file), by pos."""
    order = Window.partitionBy("qualified_name", "scope", "file").orderBy("pos")
    return symbols.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def with_ids(symbols: DataFrame, digest: Column) -> DataFrame:
    """``symbols`` with symbol_id: kind and 6 hex digits, 8 or 12 where names of one file would share it."""
    rows = symbols.withColumn("digest", digest)
    for size in (6, 8):
        rows = rows.withColumn(f"names{size}", F.size(F.collect_set("qualified_name").over(Window.partitionBy("file", "kind", F.substring("digest", 1, size)))))
    size = F.when(F.col("names6") == 1, 6).when(F.col("names8") == 1, 8).otherwise(12)
    return rows.withColumn("symbol_id", F.concat("kind", F.lit("_"), F.substring("digest", F.lit(1), size))).drop("digest", "names6", "names8")


def id_collisions(ids: DataFrame) -> DataFrame:
    """(symbol_id, names): ids that several qualified names share."""
    return ids.groupBy("symbol_id").agg(F.countDistinct("qualified_name").alias("names")).filter("names > 1")


def fingerprints(symbols: DataFrame) -> DataFrame:
    """(file, fingerprint) whatever the order of the file's symbols; bodies are not part of it."""
    row = F.concat_ws("|", "id", "kind", "scope", "qualified_name")  # a file's symbols are one task's
    return symbols.groupBy("file").agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), "\n"), 256), 1, 12).alias("fingerprint"))


def enclosing(sites: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, line, id): the smallest span of ``spans`` (file, id, start, stop, pos) that holds each line; the first of equals.

    A span is cut into blocks of 1, 4, 16, ... lines, the largest that fit, each at a multiple
    of its size: a few for each size, however long it is.  The best span of each block is taken
    before lines meet them, and a line meets one block of each size, however many spans
    lie around it.
    """
    rows = spans.select("file", "id", "pos", F.col("start").cast("long").alias("start"), (F.col("stop").cast("long") + 1).alias("end")).filter("start < end")
    longest = rows.agg(F.max(F.col("end") - F.col("start"))).first()[0]
    sizes = [n for n in range(31) if n == 0 or 1 << (2 * n) <= (longest or 0)]
    cuts = F.concat(*[_blocks(n) for n in sizes])
    size = F.struct((F.col("end") - F.col("start")).alias("size"), "pos", "id")
    dealt = spread(rows, "file", "id", task_bytes=100_000)  # each row becomes many
    best = dealt.select("file", size.alias("best"), F.explode(cuts).alias("at")).groupBy("file", "at").agg(F.min("best").alias("best"))
    around = F.array(*[F.struct(F.lit(n).alias("n"), F.shiftright(F.col("line").cast("long"), 2 * n).alias("block")) for n in sizes])
    met = sites.select("file", "line").distinct().withColumn("at", F.explode(around)).join(best, ["file", "at"])
    return met.groupBy("file", "line").agg(F.min("best").alias("best")).select("file", "line", "best.id")


def _blocks(n: int) -> Column:
    """The blocks of 4 ** ``n`` lines within start to end that lie in none of four times the size."""
    first = lambda k: -F.shiftright(-F.col("start"), 2 * k)
    after = lambda k: F.shiftright(F.col("end"), 2 * k)
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    whole = first(n + 1) < after(n + 1)
    own = F.when(whole, F.concat(span(first(n), first(n + 1) * 4), span(after(n + 1) * 4, after(n)))).otherwise(span(first(n), after(n)))
    return F.transform(own, lambda block: F.struct(F.lit(n).alias("n"), block.alias("block")))


def resolve_calls(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """(site, status, resolved_id, candidates) of call sites (site, callee_name, caller_scope) by a cascade.

    Qualified names first (of equals the last), then names or what follows the last ``::``:
    unique, unique in the caller's scope, unique below it; else ambiguous or unresolved.

    The name and the scope decide, so each pair of them is resolved once and sites meet the
    outcome in one join.  Symbols are summed by name, by name and scope, and by name and each
    scope around them before: a pair joins one row of each, however common its name.
    """
    counted = lambda name: [F.count("*").alias(f"n_{name}"), F.min("id").alias(name)]
    full = symbols.groupBy(F.col("qualified_name").alias("callee_name")).agg(F.max_by("id", "pos").alias("full_id"))
    by_name = symbols.groupBy(F.col("name").alias("by")).agg(*counted("only"))
    by_scope = symbols.groupBy(F.col("name").alias("by"), F.col("scope").alias("caller_scope")).agg(*counted("same"))
    parts = F.split("qualified_name", "::")
    around = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "::"))
    below = symbols.filter(F.size(parts) > 1).select(F.col("name").alias("by"), "id", F.explode(around).alias("caller_scope")).filter("caller_scope <> ''")
    by_outer = below.groupBy("by", "caller_scope").agg(*counted("below"))
    suffix = F.element_at(F.split("callee_name", "::"), -1)
    known = by_name.select(F.col("by").alias("callee_name"), F.lit(True).alias("known"))
    asked = sites.select("callee_name", "caller_scope").distinct()
    rows = apart(asked, "callee_name").join(apart(full, "callee_name"), ["callee_name", "apart"], "left").join(apart(known, "callee_name"), ["callee_name", "apart"], "left").drop("apart")
    rows = apart(rows.withColumn("by", F.when(F.col("known"), F.col("callee_name")).otherwise(suffix)), "by")
    rows = rows.join(apart(by_name, "by"), ["by", "apart"], "left").drop("apart")
    rows = apart(rows, "by", "caller_scope")
    for table in (by_scope, by_outer):
        rows = rows.join(apart(table, "by", "caller_scope"), ["by", "caller_scope", "apart"], "left")
    n = F.coalesce("n_only", F.lit(0))
    status = (
        F.when(F.col("full_id").isNotNull(), "resolved_qualified").when(n == 0, "unresolved").when(n == 1, "resolved_unique")
        .when(F.col("n_same") == 1, "resolved_same_scope").when(F.col("n_below") == 1, "resolved_nested_scope").otherwise("ambiguous"))
    chosen = (
        F.when(F.col("status") == "resolved_qualified", F.col("full_id")).when(F.col("status") == "resolved_unique", F.col("only"))
        .when(F.col("status") == "resolved_same_scope", F.col("same")).when(F.col("status") == "resolved_nested_scope", F.col("below")))
    found = stored(rows.withColumn("status", status).select(
        F.col("callee_name").alias("of_name"), F.col("caller_scope").alias("of_scope"), "status", chosen.alias("resolved_id"),
        F.when(F.col("status") == "resolved_qualified", 1).otherwise(n).cast("long").alias("candidates")), "resolved")
    met = F.col("callee_name").eqNullSafe(F.col("of_name")) & F.col("caller_scope").eqNullSafe(F.col("of_scope"))
    return sites.join(few(found), met).select("site", "status", "resolved_id", "candidates")


def imports(directives: DataFrame) -> DataFrame:
    """(file, name, part): what each file imports, with the parts of the module's name.  Directives: (file, text)."""
    text = F.trim("text")
    source = F.regexp_extract(text, r"^from\s+(\S+)\s+import\s", 1)
    names = F.transform(F.split(F.regexp_extract(text, r"\simport\s+(.*)$", 1), ","), lambda n: F.trim(F.split(F.trim(n), r"\s+as\s+")[0]))
    froms = directives.filter(source != "").select("file", F.explode(names).alias("name"), F.split(source, r"\.").alias("parts"))
    module = F.regexp_extract(text, r"^import\s+([^\s,]+)", 1)
    plain = directives.filter((source == "") & (module != "")).select("file", F.element_at(F.split(module, r"\."), -1).alias("name"), F.split(module, r"\.").alias("parts"))
    return froms.unionAll(plain).filter("name <> ''").select("file", "name", F.explode("parts").alias("part")).distinct()


def cross_file_links(sites: DataFrame, symbols: DataFrame, imported: DataFrame, builtin_names: tuple[str, ...] = BUILTIN_NAMES) -> DataFrame:
    """(caller, callee, source_file, target_file) of unresolved sites (caller, callee_name, file).

    A name that one other file defines is taken, unless that leads from own into vendor
    code; of several, the only one in a file that the import of the name matches.  Names are
    summed by file first, so a common name without an import is one row a site.
    """
    known = symbols.select(F.col("name").alias("callee_name"), F.col("id").alias("callee"), F.col("file").alias("target_file")).union(
        symbols.filter("name <> qualified_name").select("qualified_name", "id", "file"))
    open_ = sites.filter(~F.col("callee_name").isin(*builtin_names))
    by_file = known.groupBy("callee_name", "target_file").agg(F.count("*").alias("n"), F.min("callee").alias("callee"))
    # a name with one candidate elsewhere is in two files at most: the caller's own and that
    files = by_file.groupBy("callee_name").agg(F.count("*").alias("files"), F.min(F.struct("target_file", "n", "callee")).alias("x"), F.max(F.struct("target_file", "n", "callee")).alias("y")).filter("files <= 2")
    met = apart(open_, "callee_name").join(apart(files, "callee_name").hint("shuffle_hash"), ["callee_name", "apart"]).drop("apart")  # a row a name, so sites need no sort
    other = F.when(F.col("x.target_file") != F.col("file"), F.when((F.col("files") == 1) | (F.col("y.target_file") == F.col("file")), F.col("x"))).when(F.col("files") == 2, F.col("y"))
    single = met.withColumn("other", other).filter("other.n = 1").select("caller", "file", F.col("other.callee").alias("callee"), F.col("other.target_file").alias("target_file"))
    single = single.filter(~(~is_vendor(F.col("file")) & is_vendor(F.col("target_file"))))
    # of several only those in files that an import of the name matches; names without an import are not spread out
    parts = imported.groupBy("file", F.col("name").alias("callee_name")).agg(F.collect_set("part").alias("parts"))
    totals = known.groupBy("callee_name").agg(F.count("*").alias("total"))
    asked = open_.join(parts, ["file", "callee_name"]).join(totals, "callee_name").join(
        by_file.select("callee_name", F.col("target_file").alias("file"), F.col("n").alias("own")), ["callee_name", "file"], "left").filter(F.col("total") - F.coalesce("own", F.lit(0)) > 1)
    path = F.transform(F.split("target_file", "/"), lambda p: F.regexp_replace(p, r"\.[A-Za-z0-9]+$", ""))
    several = asked.join(known, "callee_name").filter("target_file <> file").filter(F.arrays_overlap(path, F.col("parts")))
    several = several.groupBy("caller", "file", "callee_name").agg(F.count("*").alias("m"), F.min("callee").alias("callee"), F.min("target_file").alias("target_file")).filter("m = 1")
    cols = ["caller", "callee", F.col("file").alias("source_file"), "target_file"]
    links = spread(single.select(*cols).unionAll(several.select(*cols)), "caller", "callee", tasks=tasks_of(sites))
    return links.groupBy("caller", "callee").agg(F.min(F.struct("source_file", "target_file")).alias("x")).select("caller", "callee", "x.*")


def hierarchy(symbols: DataFrame) -> DataFrame:
    """(id, parent): a symbol's parent has its scope as qualified name, in the same file; of equals the last; null for roots."""
    parents = symbols.groupBy("file", F.col("qualified_name").alias("scope")).agg(F.max_by("id", "pos").alias("parent"))
    return symbols.join(parents, ["file", "scope"], "left").select("id", "file", F.when(F.col("scope") != "", F.col("parent")).alias("parent"))


def hierarchy_text(found: DataFrame, most_depth: int = 64) -> DataFrame:
    """(file, path, line) of symbols (file, id, parent, pos): ids indented by their depth; in the order of ``path`` a file's lines are its tree, each below its parent."""
    rows = found.select("file", "id", "parent", F.lpad(F.col("pos").cast("string"), 10, "0").alias("own"))
    level = rows.filter("parent is null").select("file", "id", F.col("own").alias("path"), F.lit(0).alias("depth"))
    tree = level = stored(level, "tree-level")
    for depth in range(1, most_depth):
        level = stored(rows.join(level.select("file", F.col("id").alias("parent"), "path"), ["file", "parent"]).select("file", "id", F.concat_ws("/", "path", "own").alias("path"), F.lit(depth).alias("depth")), "tree-level")
        if level.isEmpty():
            return tree.select("file", "path", F.concat(F.expr("repeat('  ', depth)"), "id").alias("line"))
        tree = tree.unionAll(level)
    raise RuntimeError(f"symbols are nested deeper than {most_depth} levels")


def containment(parents: DataFrame, calls: DataFrame) -> DataFrame:
    """The semantic graph's edges (source, target, kind)."""
    return parents.filter("parent is not null").select(F.col("parent").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind")).unionAll(
        calls.select("src", "dst", F.lit("calls")))


def cross_file_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller, callee, source_file, target_file, caller_name, callee_name): local edges whose callee lies in another file."""
    files = symbols.groupBy("id").agg(F.max_by(F.struct("file", "qualified_name"), "file").alias("at"))
    rows = edges.select(F.col("src").alias("caller"), F.col("dst").alias("callee"))
    for side in ("caller", "callee"):
        rows = rows.join(files.select(F.col("id").alias(side), F.col("at").alias(f"{side}_at")), side)
    return rows.filter("caller_at.file <> callee_at.file").select(
        "caller", "callee", F.col("caller_at.file").alias("source_file"), F.col("callee_at.file").alias("target_file"),
        F.col("caller_at.qualified_name").alias("caller_name"), F.col("callee_at.qualified_name").alias("callee_name")).distinct()
