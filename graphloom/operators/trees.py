"""Symbols, calls and facts from syntax trees given as rows, for any language with a parser.

A tree is rows (file, language, node, parent, pos, type, name, text, head, start, stop):
``node`` and ``parent`` are numbers within the file, ``pos`` the place in the file, ``name``
what the grammar calls the node's name (or null), ``head`` the text before the body, and
``start`` and ``stop`` lines from 0.  Parsers run where files are read; what their nodes mean
is joined from tables here, so a new language is a parser and rows of those tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.joins import stored
from graphloom.operators.linking import enclosing

# The kinds of TypeScript and JavaScript nodes.
SCRIPT = {
    "function_declaration": "f", "method_definition": "f", "arrow_function": "f", "generator_function_declaration": "f",
    "class_declaration": "t", "import_statement": "d", "export_statement": "d",
}
TYPED_SCRIPT = SCRIPT | {"interface_declaration": "t", "type_alias_declaration": "t", "enum_declaration": "t", "module": "m"}
# The kind of each node that is a symbol (f function, t type, m module, v variable, c constant, d dependency).
KINDS = {
    "cpp": {
        "function_definition": "f", "class_specifier": "t", "struct_specifier": "t", "enum_specifier": "t", "namespace_definition": "m",
        "field_declaration": "v", "type_definition": "t", "template_declaration": "t", "preproc_def": "c", "enumerator": "c",
        "preproc_include": "d", "using_declaration": "d",
    },
    "rust": {
        "function_item": "f", "impl_item": "t", "struct_item": "t", "enum_item": "t", "trait_item": "t", "type_item": "t", "mod_item": "m",
        "static_item": "v", "const_item": "c", "use_declaration": "d",
    },
    "python": {"function_definition": "f", "class_definition": "t", "import_statement": "d", "import_from_statement": "d"},
    "typescript": TYPED_SCRIPT,
    "tsx": TYPED_SCRIPT,
    "javascript": SCRIPT,
    "go": {
        "function_declaration": "f", "method_declaration": "f", "type_declaration": "t", "const_declaration": "c", "var_declaration": "v",
        "package_clause": "m", "import_declaration": "d",
    },
    "java": {
        "class_declaration": "t", "interface_declaration": "t", "enum_declaration": "t", "record_declaration": "t", "annotation_type_declaration": "t",
        "method_declaration": "f", "constructor_declaration": "f", "annotation_type_element_declaration": "f", "field_declaration": "v",
        "enum_constant": "c", "import_declaration": "d", "package_declaration": "m",
    },
}
# Symbols whose inside holds no further symbols; the last two only in Java.
LEAVES = ("function_definition", "function_item", "function_declaration", "arrow_function", "method_definition", "generator_function_declaration", "method_declaration")
JAVA_LEAVES = ("constructor_declaration", "field_declaration")
# Nodes that call something.
CALLS = {
    "cpp": ("call_expression",), "rust": ("call_expression", "macro_invocation"), "python": ("call",), "typescript": ("call_expression", "new_expression"),
    "tsx": ("call_expression", "new_expression"), "javascript": ("call_expression", "new_expression"), "go": ("call_expression",),
    "java": ("method_invocation", "object_creation_expression"),
}
# What a node of a type says about intent if its text matches.
INTENTS = (
    ("cpp", "call_expression", r"^assert", "PRECONDITION", "assert() call", "inferred:high"),
    ("rust", "macro_invocation", r"^\w*assert\w*!", "PRECONDITION", None, "inferred:high"),
    ("python", "assert_statement", "", "PRECONDITION", "assert statement", "inferred:high"),
    ("cpp", "throw_statement", "", "PRECONDITION", "throw in function body", "inferred:high"),
    ("cpp", "try_statement", "", "INTENT", "error-boundary", "inferred:medium"),
    ("python", "try_statement", "", "INTENT", "error-boundary", "inferred:medium"),
    ("rust", "unsafe_block", "", "INTENT", "unsafe:reason-unknown", "inferred:medium"),
    ("cpp", "type_qualifier", "const", "INVARIANT", "immutable", "inferred:high"),
    ("rust", "attribute_item", "bench", "INTENT", "perf-critical", "inferred:medium"),
)
# Nodes that raise errors: the pattern that tells, the one that names the error, its default, how it travels.
ERRORS = (
    ("cpp", "throw_statement", "", r"throw\s+(?:std::)?(\w+)", "exception", "throws"),
    ("python", "raise_statement", "", r"raise\s+(\w+)", "Exception", "throws"),
    ("rust", "try_expression", "", r"^()$", "Error", "propagates via ?"),
    ("rust", "call_expression", r"^Err\(", r"^Err\((\w+)", "Error", "returns Err(...)"),
    ("rust", "macro_invocation", r"^(?:panic|bail|anyhow)!", r"^(\w+)!", "panic", "throws"),
)


def _dimension(spark, rows: dict[str, dict[str, str]]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(language, kind_of, kind) for language, types in rows.items() for kind_of, kind in types.items()], "language string, type string, kind string"))


def kinds(nodes: DataFrame) -> DataFrame:
    """``nodes`` that are symbols, with their kind; a Java field that is static and final is a constant."""
    found = nodes.join(_dimension(nodes.sparkSession, KINDS), ["language", "type"])
    fixed = (F.col("language") == "java") & (F.col("type") == "field_declaration") & F.col("text").rlike(r"^[^=;{]*\bstatic\b") & F.col("text").rlike(r"^[^=;{]*\bfinal\b")
    return found.withColumn("kind", F.when(fixed, "c").otherwise(F.col("kind")))


def name_of(language: Column, kind: Column, type_: Column, name: Column, head: Column, text: Column) -> Column:
    """The grammar's name; else by rule: what ``using`` imports, a dependency's text, the word before the parameters, the last word of the head."""
    bare = F.trim(F.regexp_replace(text, r";\s*$", ""))
    used = F.regexp_replace(bare, r"^using\s+(?:namespace\s+)?", "")
    dependency = F.when((language == "cpp") & (type_ == "using_declaration"), used).when(language == "cpp", F.trim(text)).otherwise(bare)
    called = F.regexp_extract(head, r"([~\w]+(?:::[~\w]+)*)\s*\(", 1)
    last = F.regexp_extract(head, r"(\w+)\W*$", 1)
    return F.nullif(F.when(kind == "d", F.coalesce(name, dependency)).otherwise(F.coalesce(name, F.nullif(F.when(kind == "f", called), F.lit("")), last)), F.lit(""))


def symbols(nodes: DataFrame, most_depth: int = 64) -> DataFrame:
    """(file, pos, name, qualified_name, kind, scope, signature, body_text, span_start, span_end) of all trees.

    A type or module is a scope for the symbols within it; nothing within a function is a
    symbol.  A Java package is a scope for what follows it in its file.  The scopes around a
    symbol are found by walking up from all nodes at once, one level a round.
    """
    leaf = F.col("type").isin(*LEAVES) | ((F.col("language") == "java") & F.col("type").isin(*JAVA_LEAVES))
    named = kinds(nodes).withColumn("name", name_of(*[F.col(c) for c in ("language", "kind", "type", "name", "head", "text")])).filter("name is not null").withColumn("leaf", leaf)
    named = stored(named.select("file", "language", "node", "parent", "pos", "type", "kind", "name", "head", "text", "start", "stop", "leaf"), "tree-symbols")
    packages = named.filter("language = 'java' and type = 'package_declaration'").groupBy("file").agg(F.min(F.struct("pos", "name")).alias("package"))
    up = stored(nodes.select("file", F.col("node").alias("here"), F.col("parent").alias("above")).join(
        named.select("file", F.col("node").alias("here"), F.col("name").alias("own"), F.col("kind").alias("own_kind"), F.col("leaf").alias("own_leaf")), ["file", "here"], "left"), "tree-parents")
    walk = named.select("file", "node", F.col("parent").alias("here"), F.array().cast("array<string>").alias("scopes"), F.lit(False).alias("hidden"))
    done = None
    for _ in range(most_depth):
        met = stored(walk.join(up, ["file", "here"], "left").select(
            "file", "node", F.col("above").alias("here"),
            F.when(F.col("own_kind").isin("t", "m") & ~F.col("own_leaf"), F.concat(F.array("own"), "scopes")).otherwise(F.col("scopes")).alias("scopes"),
            (F.col("hidden") | F.coalesce("own_leaf", F.lit(False))).alias("hidden")), "tree-walk")
        ended = met.filter("here is null and not hidden")
        done = ended if done is None else done.unionAll(ended)
        walk = met.filter("here is not null and not hidden")
        if walk.isEmpty():
            break
    else:
        raise RuntimeError(f"trees are deeper than {most_depth} levels")
    rows = named.join(done.select("file", "node", "scopes"), ["file", "node"]).join(packages, "file", "left")
    inside = F.col("package").isNotNull() & (F.col("pos") > F.col("package.pos"))
    scopes = F.when(inside, F.concat(F.array("package.name"), "scopes")).otherwise(F.col("scopes"))
    scope = F.array_join(scopes, "::")
    return rows.select(
        "file", "pos", "name", F.when(scope == "", F.col("name")).otherwise(F.concat_ws("::", scope, "name")).alias("qualified_name"), "kind", scope.alias("scope"),
        F.coalesce("head", F.lit("")).alias("signature"), F.col("text").alias("body_text"), F.col("start").alias("span_start"), F.col("stop").alias("span_end"))


def unmapped(nodes: DataFrame, known: tuple[str, ...] = (), most: int = 200) -> DataFrame:
    """(language, types): node types that no table has, at most ``most`` a language; ``known`` are types that are no symbols."""
    rest = nodes.select("language", "type").distinct().join(_dimension(nodes.sparkSession, KINDS), ["language", "type"], "left_anti").filter(~F.col("type").isin(*known))
    first = rest.withColumn("place", F.row_number().over(Window.partitionBy("language").orderBy("type"))).filter(F.col("place") <= most)
    return first.groupBy("language").agg(F.sort_array(F.collect_list("type")).alias("types"))


def calls(nodes: DataFrame) -> DataFrame:
    """(file, line, callee_name) of the nodes that call something: what stands before the arguments, without its receiver but in C++ and Rust with its scope."""
    table = _dimension(nodes.sparkSession, {language: {t: "" for t in types} for language, types in CALLS.items()})
    found = nodes.join(table, ["language", "type"])
    head = F.regexp_replace(F.regexp_extract("text", r"(?s)^(?:new\s+)?([^({!]*)", 1), r"<[^<>]*>", "")
    scoped, plain = F.regexp_extract(head, r"([~\w]+(?:::[~\w]+)*)\s*$", 1), F.regexp_extract(head, r"(\w+)\s*$", 1)
    name = F.coalesce("name", F.when(F.col("language").isin("cpp", "rust"), scoped).otherwise(plain))
    return found.select("file", F.col("start").alias("line"), name.alias("callee_name")).filter("callee_name <> ''")


def _owned(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (file, line, ...) with the id of the smallest function of ``found`` (file, id, kind, span_start, span_end, pos) around each."""
    spans = found.filter("kind = 'f'").select("file", "id", F.col("span_start").alias("start"), F.col("span_end").alias("stop"), "pos")
    return rows.join(enclosing(rows.select("file", "line").distinct(), spans), ["file", "line"])


def intents(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, tag, description, confidence) of the functions around telling nodes, each once."""
    rules = F.broadcast(nodes.sparkSession.createDataFrame(list(INTENTS), "language string, type string, pattern string, tag string, description string, confidence string"))
    macro = F.concat(F.regexp_extract("text", r"^(\w+)!", 1), F.lit(" macro"))
    met = nodes.join(rules, ["language", "type"]).filter(F.regexp_like("text", F.col("pattern")))
    rows = met.select("file", F.col("start").alias("line"), "tag", F.coalesce("description", macro).alias("description"), "confidence")
    return _owned(rows, found).select("id", "tag", "description", "confidence").distinct()


def error_sources(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, error, propagation) of the functions around nodes that raise or pass on errors."""
    rules = F.broadcast(nodes.sparkSession.createDataFrame(list(ERRORS), "language string, type string, pattern string, naming string, fallback string, propagation string"))
    met = nodes.join(rules, ["language", "type"]).filter(F.regexp_like("text", F.col("pattern")))
    error = F.coalesce(F.nullif(F.coalesce(F.regexp_substr("text", F.col("naming")), F.lit("")), F.lit("")), F.col("fallback"))
    error = F.when(F.col("type") == "throw_statement", F.regexp_replace(error, r"^throw\s+(?:std::)?", "")).when(F.col("type") == "raise_statement", F.regexp_replace(error, r"^raise\s+", "")).when(
        F.col("type") == "call_expression", F.regexp_replace(error, r"^Err\(", "")).when(F.col("type") == "macro_invocation", F.regexp_replace(error, "!$", "")).otherwise(F.col("fallback"))
    return _owned(met.select("file", F.col("start").alias("line"), error.alias("error"), "propagation"), found).select("id", "error", "propagation")


def error_boundaries(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, catches, recovery) of the functions around ``try`` statements, and around Rust matches on results."""
    text = F.col("text")
    tries = nodes.filter("type = 'try_statement' and language in ('cpp', 'python')")
    types = F.when(F.col("language") == "cpp", F.regexp_extract_all(text, F.lit(r"catch\s*\(\s*(?:const\s+)?(?:std::)?(\w+)"), F.lit(1))).otherwise(F.regexp_extract_all(text, F.lit(r"except\s+(\w+)"), F.lit(1)))
    recovery = (
        F.when(text.contains("return"), "returns").when(text.contains("raise") | text.contains("throw"), "re-raises")
        .when(F.lower(text).contains("log") | text.contains("print") | text.contains("cerr"), "logs").otherwise("handles"))
    line = F.col("start").alias("line")
    rows = tries.select("file", line, F.when(F.size(types) > 0, F.array_join(types, ", ")).otherwise("all").alias("catches"), recovery.alias("recovery"))
    matches = nodes.filter("type = 'match_expression' and language = 'rust'").filter(text.contains("Err(") | text.contains("None"))
    rows = rows.unionAll(matches.select("file", line, F.lit("Result/Option"), F.lit("match arms")))
    return _owned(rows, found).select("id", "catches", "recovery")


def unhandled(sources: DataFrame, boundaries: DataFrame) -> DataFrame:
    """The error sources whose function has no boundary."""
    return sources.join(boundaries.select("id").distinct(), "id", "left_anti")
