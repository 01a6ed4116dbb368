"""How much of a body is kept, its summary, and the names in it replaced and put back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_count(text: Column) -> Column:
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)


def body_level(kind: Column, body: Column, stability: Column, coverage: Column, docstring_above: int = 10, omit_above: int = 50) -> Column:
    """FULL for data, volatile or uncovered code and empty bodies; else the longer the less."""
    n = line_count(body)
    always = kind.isin("c", "v", "d") | F.coalesce(stability == "volatile", F.lit(False)) | F.coalesce(coverage == "none", F.lit(False))
    return F.when(always, "FULL").when(n > omit_above, "OMIT").when(n > docstring_above, "DOCSTRING").when(n > 0, "SUMMARY").otherwise("FULL")


def _capped(text: Column, most: int, kept: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, kept), F.lit("..."))).otherwise(text)


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _comment_block(body: Column, mark: str, skip: str | None = None) -> Column:
    """The first run of lines that begin with ``mark``, joined; nothing if a line that matches ``skip`` comes before it."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(x))
    is_doc = lambda x: x.startswith(mark)
    first = F.array_position(F.transform(lines, is_doc), True).cast("int")
    before = F.slice(lines, 1, F.greatest(first - 1, F.lit(0)))
    rest = F.slice(lines, F.greatest(first, F.lit(1)), F.size(lines))
    length = F.array_position(F.concat(F.transform(rest, is_doc), F.array(F.lit(False))), False).cast("int") - 1
    doc = F.array_join(F.transform(F.slice(rest, 1, F.greatest(length, F.lit(0))), lambda x: F.trim(F.substring(x, F.lit(len(mark) + 1), F.length(x)))), " ")
    stopped = F.exists(before, lambda x: x.rlike(skip)) if skip else F.lit(False)
    return F.when((first > 0) & ~stopped, doc).otherwise(F.lit(""))


def docstring(body: Column, language: Column, most: int = 200) -> Column:
    """The text that documents a body, '' for none: Python's first triple-quoted string within five lines, Rust's ``///``
    lines, elsewhere ``/** */`` or leading ``//`` lines.  Long ones are cut."""
    head = F.array_join(F.slice(F.split(body, "\n"), 1, 5), "\n")
    quoted = lambda q: F.regexp_extract(body, f"(?s){q}(.*?){q}", 1)
    python = F.when(head.contains('"""'), quoted('"""')).when(head.contains("'''"), quoted("'''")).otherwise(F.lit(""))
    starred = _bare(F.regexp_replace(F.regexp_extract(body, r"(?s)/\*\*(.*?)\*/", 1), r"\s*\*\s*", " "))
    slashed = _comment_block(body, "//", r"^(func|function|def|pub|fn|class|type|const|var|let) ")
    return (
        F.when(F.coalesce(F.length(body), F.lit(0)) == 0, F.lit("")).when(language == "python", _capped(_bare(python), most, most - 3))
        .when(language == "rust", _capped(_comment_block(body, "///"), most, most)).otherwise(_capped(F.when(body.rlike(r"(?s)/\*\*.*?\*/"), starred).otherwise(slashed), most, most)))


def summary(kind: Column, name: Column, signature: Column, calls: Column, callers: Column, members: Column, body: Column, doc: Column) -> Column:
    """The facts of a symbol: of a function its parameters, result, calls (numbers) and lines, of a type or module its members; then its documentation."""
    none = F.lit(None).cast("string")
    inside = F.regexp_extract(signature, r"(?s)\((.*)\)", 1)
    n = F.size(F.filter(F.split(inside, ","), lambda p: F.trim(p) != ""))
    has_list = signature.rlike(r"(?s)\(.*\)")
    parts = F.concat_ws(
        "; ", F.concat(F.lit("fn "), name), F.when(has_list, F.when(n > 0, F.concat(F.lit("("), n.cast("string"), F.lit(" params)"))).otherwise(F.lit("(no params)"))).otherwise(none),
        F.when(signature.contains("->"), F.concat(F.lit("-> "), F.trim(F.regexp_extract(signature, r"(?s)->(.*)$", 1)))).otherwise(none),
        F.when(calls > 0, F.concat(F.lit("calls "), calls.cast("string"), F.lit(" symbols"))).otherwise(none),
        F.when(callers > 0, F.concat(F.lit("called by "), callers.cast("string"))).otherwise(none),
        F.concat(F.lit("["), F.greatest(line_count(body), F.lit(1)).cast("string"), F.lit(" lines]")))
    text = (
        F.when(kind == "f", parts).when(kind == "t", F.concat(F.lit("type "), name, F.lit(" ("), members.cast("string"), F.lit(" members)")))
        .when(kind == "m", F.concat(F.lit("module "), name, F.lit(" ("), members.cast("string"), F.lit(" definitions)"))).otherwise(F.concat(kind, F.lit(" "), name)))
    return F.when(F.coalesce(doc, F.lit("")) != "", F.concat(text, F.lit("\n  doc: "), doc)).otherwise(text)


def documented(name: Column, signature: Column, doc: Column) -> Column:
    """What stands for a body of which only the documentation is kept: the signature (or name) with it."""
    head = F.coalesce(F.nullif(signature, F.lit("")), name)
    return F.when(F.coalesce(doc, F.lit("")) != "", F.concat(head, F.lit("\n  doc: "), doc)).otherwise(head)


#: Quoted strings with their escapes; one without an end reaches to the end of the text.
LITERAL = re.compile(r"\"(?:\\[\s\S]?|[^\"\\])*(?:\"|$)|'(?:\\[\s\S]?|[^'\\])*(?:'|$)")


def replace_outside_literals(text: str, names: dict[str, str], own_id: str | None = None) -> str:
    """``names`` (name -> id) replaced as whole words, the longest first, but not in string literals, and not the symbol's own."""
    names = {name: i for name, i in names.items() if len(name) >= 2 and i != own_id}
    if not names:
        return text
    words = re.compile(r"\b(?:" + "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n))) + r")\b")
    out, at = [], 0
    for literal in LITERAL.finditer(text):
        out += [words.sub(lambda m: names[m[0]], text[at : literal.start()]), literal[0]]
        at = literal.end()
    return "".join(out) + words.sub(lambda m: names[m[0]], text[at:])


def with_simple_names(names: dict[str, str]) -> dict[str, str]:
    """``names`` (qualified name -> id) and, where that is free, the part after the last ``::`` of each."""
    found = dict(names)
    for name, i in names.items():
        found.setdefault(name.rsplit("::", 1)[-1], i)
    return found


def substituted(bodies: DataFrame) -> DataFrame:
    """``bodies`` (id, body, names: map qualified name -> id) with compressed: names of two letters or more replaced, but the symbol's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [replace_outside_literals(b or "", with_simple_names(dict(n or [])), i) for i, b, n in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "compressed"])

    return bodies.select("id", "body", "names").mapInArrow(run, "id string, compressed string")


def compressed(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """(id, level, content, original) of symbols: each body as its level has it.

    ``symbols``: id, name, kind, language, signature, body_text, stability, coverage, calls,
    callers, members; ``names``: id and a map of the names that its file knows.  Only bodies
    that are kept in full go to Python for their names.
    """
    level = body_level(F.col("kind"), F.col("body_text"), F.col("stability"), F.col("coverage"))
    rows = symbols.withColumn("level", level).withColumn("doc", docstring(F.col("body_text"), F.col("language")))
    full = substituted(rows.filter("level = 'FULL'").select("id", F.col("body_text").alias("body")).join(names, "id"))
    short = F.when(F.col("level") == "DOCSTRING", documented(F.col("name"), F.col("signature"), F.col("doc"))).when(
        F.col("level") == "SUMMARY", summary(*[F.col(c) for c in ("kind", "name", "signature", "calls", "callers", "members", "body_text", "doc")])).when(F.col("level") == "OMIT", F.lit(""))
    return rows.join(full, "id", "left").select("id", "level", F.coalesce(short, "compressed", F.coalesce("body_text", F.lit(""))).alias("content"), F.col("body_text").alias("original"))


def expanded(rows: DataFrame) -> DataFrame:
    """The inverse, of rows (id, compressed, original, names): the original if kept, else ids back to names."""
    pairs = F.sort_array(F.transform(F.map_entries("names"), lambda e: F.struct((-F.length(e["value"])).alias("order"), e["value"].alias("id"), e["key"].alias("name"))))
    back = F.aggregate(pairs, F.col("compressed"), lambda s, p: F.replace(s, p["id"], p["name"]))
    return rows.select("id", F.coalesce("original", back).alias("body"))


def navigation_profile(symbols: DataFrame) -> DataFrame:
    """(file, profile): the text whose length stands for the compressed file."""
    return symbols.groupBy("file").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "kind", "qualified_name"))), "\n").alias("profile"))
