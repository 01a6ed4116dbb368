"""Approved patches as notes in Python sources.

A note goes to the top of the body of its symbol, below a docstring.  Which definition that
is, the parsed source tells: one of the name that begins within the lines on record; without
such, the only one of the name; of several, the only one within the class that the qualified
name ends in.  Anything else is reported with the places of all that it might be.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def definitions(tree: ast.AST, name: str, around: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], ast.AST]]:
    """(enclosing names, node) of each definition of ``name``."""
    for child in ast.iter_child_nodes(tree):
        inside = (*around, child.name) if isinstance(child, DEFINITIONS) else around
        if isinstance(child, DEFINITIONS) and child.name == name:
            yield around, child
        yield from definitions(child, name, inside)


def insert_note(text: str, name: str, qualified_name: str, start: int, stop: int, note: list[str]) -> tuple[str | None, str]:
    """(new text, '') or (None, what is wrong); ``start`` and ``stop`` are 1-based lines, 0 if unknown."""
    try:
        found = list(definitions(ast.parse(text), name))
    except SyntaxError as error:
        return None, f"the source does not parse: {error.msg}"
    within = [node for _, node in found if start > 0 and start <= node.lineno <= stop]
    if within:
        node = within[0]
    elif not found:
        return None, f"no definition of {name}"
    else:
        owner = qualified_name.replace("::", ".").split(".")[:-1]
        named = [node for around, node in found if owner and around and around[-1] == owner[-1]]
        choice = [node for _, node in found] if len(found) == 1 else named
        if len(choice) != 1:
            places = ", ".join(f"{'::'.join([*around, name])} at {n.lineno}" for around, n in found)
            return None, f"{len(found)} definitions of {name}: {places}"
        node = choice[0]
    first = node.body[0]
    if first.lineno == node.lineno:
        return None, f"{name} has its body on its own line"
    documented = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
    at = first.end_lineno if documented else min([first.lineno, *(d.lineno for d in getattr(first, "decorator_list", []))]) - 1
    lines = text.splitlines(keepends=True)
    if at and not lines[at - 1].endswith("\n"):
        lines[at - 1] += "\n"
    indent = " " * first.col_offset
    return "".join(lines[:at] + [f"{indent}# {line}\n" for line in note] + lines[at:]), ""


def apply(patches: DataFrame) -> DataFrame:
    """(patch_id, path, text, error) of patches (patch_id, path, text, name, qualified_name, start, stop, intent)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [insert_note(text or "", name, full or "", start or 0, stop or 0, [f"TODO [{patch}]: {line}" for line in (intent or "").splitlines() or [""]])
                    for patch, _, text, name, full, start, stop, intent in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())],
                                             ["patch_id", "path", "text", "error"])

    columns = patches.selectExpr("patch_id", "path", "text", "name", "qualified_name", "cast(start as int) start", "cast(stop as int) stop", "intent")
    return columns.mapInArrow(run, "patch_id string, path string, text string, error string")
