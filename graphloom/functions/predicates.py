"""Predicates on paths, names and kinds.  There are three rules for what a test is; all are kept."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders of code that is not the project's own.
VENDOR = ("vendor", "vendors", "third_party", "third-party", "external", "extern", "deps", "node_modules", "_vendor", ".cargo/registry")
# Words without content in a question of a transcript.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "we", "should", "do", "does", "did", "to", "for", "in", "on", "of", "and",
    "or", "not", "this", "that", "it", "be", "have", "has", "will", "can", "about", "with", "from", "i", "you", "our",
    "if", "but", "so", "at", "by", "how", "what", "when",
)

# Words that say nothing about where in the code a task lies.
TASK_STOP_WORDS = (
    "fix", "add", "update", "change", "modify", "refactor", "implement",
    "debug", "investigate", "check", "review", "improve", "optimize",
    "the", "a", "an", "in", "on", "for", "to", "of", "and", "or",
    "is", "are", "was", "with", "from", "by", "at", "this", "that",
    "how", "why", "what", "where", "when", "does", "do", "can",
    "i", "we", "need", "want", "should", "would", "could",
    "new", "bug", "issue", "error", "broken", "work", "make",
)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def is_test_path(path: Column) -> Column:
    """For ranking: a tests folder, test_* or *_test.py."""
    return F.lower(path).rlike(r"(^|/)tests/|(^|/)test_[^/]*$|_test\.py$")


def is_test_file(path: Column) -> Column:
    """For salience."""
    return basename(path).rlike(r"^test_|\.test\.|\.spec\.") | path.rlike(r"/tests?/|/__tests__/")


def is_test_function(name: Column, qualified_name: Column, language: Column) -> Column:
    """For coverage."""
    return (
        F.when(language == "python", name.startswith("test"))
        .when(language == "rust", name.startswith("test_") | qualified_name.contains("tests::"))
        .when(language == "cpp", name.startswith("TEST") | name.startswith("test_"))
        .otherwise(F.lit(False))
    )


def is_vendor(path: Column, folders: tuple[str, ...] = VENDOR) -> Column:
    return F.lower(path).rlike("(^|/)(" + "|".join(re.escape(f) for f in folders) + ")/")


def is_private(name: Column) -> Column:
    return name.startswith("_") & ~name.startswith("__")


def top_folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(F.lit("."))


def looks_like_id(ref: Column, strict: bool = True) -> Column:
    """A kind's letter, ``_`` and at least six hex digits; else letters and digits will do, as ids have that only edges know."""
    return F.trim(ref).rlike("^[ftvcmds]_[0-9a-f]{6,}$" if strict else "^[ftvcmds]_[0-9A-Za-z]+$")


def task_words(task: str, longer_than: int = 1) -> list[str]:
    """The words of a task that may name something in the code."""
    return [w for w in re.findall(r"\S+", task.lower()) if len(w) > longer_than and w not in TASK_STOP_WORDS]


def about_tests(text: str) -> bool:
    return re.search(r"\b(?:tests?|fixtures?|coverage|pytest)\b", text, re.IGNORECASE) is not None


def within(path: Column, prefix: str) -> Column:
    """Paths that begin with ``prefix``, whichever way their slashes lean."""
    return F.replace(path, F.lit("\\"), F.lit("/")).startswith(prefix.replace("\\", "/"))


def contained(root: str, path: str) -> str | None:
    """``path`` as an absolute path if it lies in ``root`` (links followed), else None."""
    root = os.path.realpath(root)
    found = os.path.realpath(os.path.join(root, path))
    return found if os.path.commonpath([root, found]) == root else None
