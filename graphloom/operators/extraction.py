"""Symbols, calls, intents and error flow from Python sources, and signature parsing for others.

Sources are parsed where they lie, in a Python stage over (path, text); everything after is
DataFrame code.  Only Python has a parser in the standard library; a parser of another
language plugs in as a function of the same form.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOL_SCHEMA = "file string, pos int, name string, qualified_name string, kind string, scope string, signature string, body_text string, span_start int, span_end int"
FACT_SCHEMA = "file string, line int, fact string, text string, scope string"


def python_symbols(text: str) -> list[tuple]:
    """Functions, types, constants, variables and imports of a module; functions are leaves."""
    found: list[tuple] = []
    lines = text.splitlines()

    def body(node: ast.AST) -> str:
        return "\n".join(lines[node.lineno - 1 : node.end_lineno])

    def head(node: ast.AST) -> str:
        """The text before the body, wherever that begins, without the colon."""
        first = min([node.body[0], *getattr(node.body[0], "decorator_list", [])], key=lambda x: (x.lineno, x.col_offset))
        start = len(lines[node.lineno - 1].encode()[: node.col_offset].decode())
        rows = lines[node.lineno - 1 : first.lineno]
        rows[-1] = rows[-1].encode()[: first.col_offset].decode()
        rows[0] = rows[0][start:]
        return "\n".join(rows).strip().removesuffix(":").strip()

    def add(node, name, kind, scope, signature):
        full = "::".join([*scope, name])
        found.append((len(found), name, full, kind, "::".join(scope), signature, body(node), node.lineno - 1, node.end_lineno - 1))

    def walk(nodes, scope):
        for node in nodes:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                add(node, node.name, "f", scope, head(node))
            elif isinstance(node, ast.ClassDef):
                add(node, node.name, "t", scope, head(node))
                walk(node.body, [*scope, node.name])
            elif isinstance(node, (ast.Import, ast.ImportFrom)):
                add(node, ast.unparse(node), "d", scope, "")
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(target, ast.Name):
                        add(node, target.id, "c" if target.id.isupper() else "v", scope, body(node).split("\n")[0])

    walk(ast.parse(text).body, [])
    return found


def python_facts(text: str) -> list[tuple]:
    """(line, fact, text, scope): calls, raises, catches, asserts and decorators with the qualified name around them."""
    found: list[tuple] = []

    def name_of(node) -> str:
        return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ""

    def walk(node, scope):
        for child in ast.iter_child_nodes(node):
            inner = [*scope, child.name] if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else scope
            where = "::".join(inner)
            if isinstance(child, ast.Call) and name_of(child.func):
                found.append((child.lineno - 1, "call", name_of(child.func), where))
            elif isinstance(child, ast.Raise):
                raised = child.exc.func if isinstance(child.exc, ast.Call) else child.exc
                found.append((child.lineno - 1, "raise", name_of(raised) if raised is not None else "", where))
            elif isinstance(child, (ast.Try, ast.TryStar)):
                types = [name_of(t) for h in child.handlers for t in (h.type.elts if isinstance(h.type, ast.Tuple) else [h.type] if h.type else [])]
                code = ast.unparse(child)
                told = (("returns", "return" in code), ("re-raises", "raise" in code), ("logs", "log" in code.lower() or "print" in code), ("handles", True))
                found.append((child.lineno - 1, "catch", ", ".join(t for t in types if t) or "all", where))
                found.append((child.lineno - 1, "recovery", next(word for word, is_so in told if is_so), where))
            elif isinstance(child, ast.Assert):
                found.append((child.lineno - 1, "assert", ast.unparse(child.test), where))
            for decorator in getattr(child, "decorator_list", []):
                found.append((decorator.lineno - 1, "decorator", ast.unparse(decorator), where))
            walk(child, inner)

    walk(ast.parse(text), [])
    return found


def parsed(files: DataFrame, parse: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """``parse`` over files (path, text); a file that does not parse gives no rows."""
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(path, *row) for row in parse(text or "")]
                except SyntaxError:
                    continue
            columns = [list(c) for c in zip(*rows)] or [[] for _ in fields]
            types = [pa.int32() if "int" in f.split()[1] else pa.string() for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], fields)

    return files.select("path", "text").mapInArrow(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    return parsed(files, python_symbols, SYMBOL_SCHEMA)


def facts(files: DataFrame) -> DataFrame:
    return parsed(files, python_facts, FACT_SCHEMA)


def unhandled(found: DataFrame) -> DataFrame:
    """Raises whose function catches nothing."""
    return found.filter("fact = 'raise'").join(found.filter("fact = 'catch'").select("file", "scope").distinct(), ["file", "scope"], "left_anti")


# What a fact says about intent, and how surely; a decorator says something if its text has the word.
INTENTS = (
    ("assert", "", "PRECONDITION", "assert statement", "inferred:high"), ("raise", "", "PRECONDITION", "throw in function body", "inferred:high"),
    ("catch", "", "INTENT", "error-boundary", "inferred:medium"), ("decorator", "property", "INTENT", "accessor", "inferred:medium"),
    ("decorator", "staticmethod", "INTENT", "static", "inferred:medium"), ("unsafe", "", "INTENT", "unsafe:reason-unknown", "inferred:medium"),
    ("const", "", "INVARIANT", "immutable", "inferred:high"), ("attribute", "bench", "INTENT", "perf-critical", "inferred:medium"),
)


def intents(found: DataFrame, rules: tuple[tuple[str, str, str, str, str], ...] = INTENTS) -> DataFrame:
    """(file, scope, tag, description, confidence) from facts by a table of rules; each once.  Of one decorator the first rule counts."""
    table = found.sparkSession.createDataFrame([(n, *r) for n, r in enumerate(rules)], "n int, fact string, word string, tag string, description string, confidence string")
    met = found.join(F.broadcast(table), "fact").filter(F.contains("text", F.col("word")))
    first = met.groupBy("file", "line", "fact", "text", "scope").agg(F.min_by(F.struct("tag", "description", "confidence"), "n").alias("x"))
    return first.select("file", "scope", "x.*").distinct()


def unknown_kinds(found: DataFrame, known: DataFrame, most: int = 200) -> DataFrame:
    """(language, kinds): node types (language, node_type) that no table has."""
    rest = found.select("language", "node_type").distinct().join(known, ["language", "node_type"], "left_anti")
    return rest.groupBy("language").agg(F.slice(F.sort_array(F.collect_list("node_type")), 1, most).alias("kinds"))


NESTED, _OUTSIDE = 5, r"[^<(\[{>)\]}]"
_GROUP = reduce(lambda inner, _: rf"[<(\[{{](?:{_OUTSIDE}++|{inner})*+[>)\]}}]", range(NESTED - 1), rf"[<(\[{{]{_OUTSIDE}*+[>)\]}}]")  # any bracket closes any other, as in the counting


def signature_params(signature: Column, language: Column | None = None) -> Column:
    """The parameters of a signature, split at commas outside brackets.

    They stand between the first parenthesis and the last one in C++, the next one in Rust
    and Python; other languages have none.  Without a language: as in C++.

    Brackets that are closed and nested no deeper than NESTED are matched by an expression,
    others counted piece by piece, which is several times slower.
    """
    wide, narrow = F.regexp_extract(signature, r"(?s)\((.*)\)", 1), F.regexp_extract(signature, r"(?s)^[^(]*\((.*?)\)", 1)
    inside = wide if language is None else F.when(language == "cpp", wide).when(language.isin("rust", "python"), narrow).otherwise(F.lit(""))
    empty = F.array().cast("array<string>")
    state = F.struct(F.lit(0).alias("depth"), empty.alias("open"), empty.alias("done"))
    opening = lambda p: F.length(p) - F.length(F.regexp_replace(p, r"[<(\[{]", ""))
    closing = lambda p: F.length(p) - F.length(F.regexp_replace(p, r"[>)\]}]", ""))

    def step(a: Column, piece: Column) -> Column:
        """A piece between commas ends a parameter where no bracket is open after it."""
        depth = (a["depth"] + opening(piece) - closing(piece)).cast("int")
        parts = F.array_append(a["open"], piece)
        return F.struct(
            depth.alias("depth"), F.when(depth == 0, empty).otherwise(parts).alias("open"),
            F.when(depth == 0, F.array_append(a["done"], F.trim(F.array_join(parts, ",")))).otherwise(a["done"]).alias("done"))

    split = F.aggregate(F.split(inside, ","), state, step, lambda a: F.when(F.size(a["open"]) > 0, F.array_append(a["done"], F.trim(F.array_join(a["open"], ",")))).otherwise(a["done"]))
    plain = (F.length(inside) <= 10_000) & inside.rlike(f"^(?:{_OUTSIDE}++|{_GROUP})*+$")
    pieces = F.transform(F.regexp_extract_all(inside, F.lit(f"((?:{_OUTSIDE[:-1]},]++|{_GROUP})++)"), F.lit(1)), lambda p: F.trim(p))
    return F.filter(F.when(plain, pieces).otherwise(split), lambda p: p != "")


def return_type(signature: Column, language: Column) -> Column:
    """What stands before the name in C++, after the arrow in Rust and Python; '' elsewhere."""
    before = F.trim(F.regexp_extract(signature, r"(?s)^([^(]*)\(", 1))
    arrow = F.trim(F.regexp_extract(signature, r"(?s)->(.*)$", 1))
    return F.when(language == "cpp", F.regexp_extract(before, r"(?s)^(.*\S)\s+\S+$", 1)).when(language == "rust", arrow).when(language == "python", F.regexp_replace(arrow, ":+$", "")).otherwise(F.lit(""))


def visibility(name: Column, language: Column, body: Column, signature: Column | None = None) -> Column:
    """By marks in a C++ body, ``pub`` before a Rust signature, underscores of a Python name; public elsewhere."""
    text = F.trim(body)
    head = F.ltrim(signature if signature is not None else body)
    return (
        F.when(language == "python", F.when(name.startswith("__") & ~name.endswith("__"), "private").when(name.startswith("_"), "protected").otherwise("public"))
        .when(language == "rust", F.when(head.startswith("pub"), "public").otherwise("private"))
        .when(language == "cpp", F.when(body.contains("private:") | text.startswith("private"), "private").when(body.contains("protected:") | text.startswith("protected"), "protected").otherwise("public"))
        .otherwise("public")
    )


def test_behaviours(name: Column) -> Column:
    """What a test's name says it tests; the name itself if nothing else."""
    words = F.filter(F.split(F.regexp_replace(name, "^test_?", ""), "_"), lambda w: w != "")
    return F.when(F.size(words) > 0, words).otherwise(F.array(name))
