"""Operators that no query of the catalogue runs, and odd cases of those that one does."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import identifiers, joins, predicates
from graphloom.operators import compression, extraction, graph, linking, lookup, memory, metrics, search, snapshots, temporal, trees, workspace
from graphloom.sources import artifacts, discovery
from graphloom.streaming import watch


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_paths_and_numbers(spark):
    rows = table(spark, "p string", ("/r/Proj/src/A.py",), ("/r/other/b.py",), ("src\\\\C.py".replace("\\\\", "\\"),), ("/r/proj/x.py",))
    assert [r[0] for r in rows.select(identifiers.relative_path(F.col("p"), "/r/Proj/")).collect()] == ["src/a.py", "../other/b.py", "src/c.py", "../proj/x.py"]
    many = spark.range(1000).repartition(7).withColumn("k", F.col("id") % 10)
    got = {r.id: r.rank for r in joins.numbered(many, [F.desc("k"), "id"]).collect()}
    want = sorted(range(1000), key=lambda i: (-(i % 10), i))
    assert [got[i] for i in want] == list(range(1, 1001))
    assert predicates.contained("/tmp", "../etc/passwd") is None and predicates.contained("/tmp", "a/b").endswith("/a/b") and predicates.contained("/tmp", "/tmpx") is None
    assert predicates.about_tests("the Tests") and not predicates.about_tests("latest")
    inside = table(spark, "p string", ("src\\a",), ("src/b",), ("lib/c",)).filter(predicates.within(F.col("p"), "src/"))
    assert inside.count() == 2
    refs = table(spark, "ref string", ("f_0a1b2c",), (" f_target ",), ("name",))
    assert values(lookup.id_shapes(refs), "is_id", "may_be_id") == [(False, False), (False, True), (True, True)]


def test_token_counts(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

    def encoding():
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    texts = ["a short text", "", None, "naïve"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(identifiers.bpe_tokens(F.col("t"), encoding)).collect()]
    assert got == [len(encoding().encode(t)) if t else 0 for t in texts]


NAMES = "id string, name string, qualified_name string, kind string, scope string, file string, signature string, body_text string"
SYMBOLS = [
    ("f_1", "load_cache", "a::load_cache", "f", "a", "src/a.py", "def load_cache(x)", "def load_cache(x):\n  return 1"), ("f_2", "store", "a::store", "f", "a", "src/a.py", "", "x"),
    ("f_3", "test_store", "t::test_store", "f", "t", "tests/test_a.py", "", ""), ("t_4", "Box", "b::Box", "t", "b", "src/b.py", "class Box", "class Box"),
    ("f_5", "open_box", "b::Box::open_box", "f", "b::Box", "src/b.py", "", ""), ("f_6", "shut_box", "b::Box::shut_box", "f", "b::Box", "src/b.py", "", ""),
    ("f_7", "test_box", "b::test_box", "f", "b", "src/b.py", "", ""), ("d_8", "import box", "import box", "d", "", "src/c.py", "", ""),
]


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame(SYMBOLS, NAMES).cache()


def test_coverage_in_files_and_beyond(spark, symbols):
    edges = table(spark, "src string, dst string", ("f_7", "f_5"), ("f_7", "t_4"), ("f_5", "f_7"), ("f_3", "f_1"), ("f_1", "f_2"), ("f_2", "f_6"))
    tests, parents = table(spark, "id string", ("f_3",), ("f_7",)), table(spark, "id string, parent string", ("f_5", "t_4"), ("f_6", "t_4"), ("f_1", None))
    base = metrics.file_coverage(edges, symbols.filter("kind <> 'd'"), tests, parents)
    found = {r.id: (r.status, r.test_count, r.uncovered) for r in base.collect()}
    assert found == {"f_1": ("none", 0, []), "f_2": ("none", 0, []), "t_4": ("partial", 1, ["shut_box"]), "f_5": ("covered", 1, []), "f_6": ("none", 0, [])}
    wide = metrics.coverage(edges, symbols, tests)
    assert values(metrics.project_coverage(base, wide), "id", "status", "test_count") == [("f_1", "covered", 1), ("f_2", "covered", 0), ("f_5", "covered", 1), ("f_6", "none", 0), ("t_4", "partial", 1)]
    assert values(graph.reachable(edges, tests), "id") == [("f_1",), ("f_2",), ("f_5",), ("f_6",), ("t_4",)]
    with pytest.raises(RuntimeError):
        graph.reach_fixpoint(edges, tests, 1)
    assert values(graph.navigable(edges, symbols, ("f",)), "src", "dst") == [("f_1", "f_2"), ("f_2", "f_6"), ("f_3", "f_1"), ("f_5", "f_7"), ("f_7", "f_5")]
    cross = linking.cross_file_edges(edges, symbols)
    assert values(cross, "caller", "callee", "target_file") == [("f_2", "f_6", "src/b.py"), ("f_3", "f_1", "src/a.py")]
    assert graph.touching(cross, "src/b.py").count() == 1 and graph.adjacency(edges, edges).count() == 6
    assert graph.with_files(graph.callers(edges, symbols, table(spark, "id string", ("f_2",))), symbols, "caller").first().caller_file == "src/a.py"


def test_rollups(spark, symbols):
    files = table(spark, "file string, symbols long, original long, compressed long", ("src/a.py", 2, 100, 40), ("src/b.py", 4, 50, 10), ("x.py", 1, 10, 10))
    assert [(r.file, r.not_shown) for r in metrics.file_map(files, limit=2).collect()] == [("src/a.py", 1), ("src/b.py", 1)]
    assert [(r.file, r.files, r.original) for r in metrics.file_map(files, rollup_above=2).collect()] == [(".", 1, 10), ("src", 2, 150)]
    assert metrics.file_map(files, "src\\", rollup_above=1).count() == 2
    built = metrics.build_totals(symbols, table(spark, "src string, dst string", ("a", "b")), files.withColumn("rebuilt", F.col("symbols") > 1)).first()
    assert (built.symbols, built.edges, built.original, built.rebuilt, built.reused) == (8, 1, 160, 2, 1) and abs(built.reduction - 0.625) < 1e-9
    scores = table(spark, "id string, file string, score double", ("a", "y", 0.5), ("b", "x", 0.5), ("c", "x", 0.9))
    assert [r.id for r in metrics.in_salience_order(scores).collect()] == ["c", "b", "a"]
    assert metrics.having(scores, "score", 0.5, table(spark, "id string", ("a",))).count() == 1
    many = lookup.candidates(symbols.unionAll(symbols.withColumn("id", F.concat("id", F.lit("x")))), table(spark, "ref string", ("store",)), 1)
    assert [(r.id, r.not_shown) for r in many.collect()] == [("f_2", 1)]
    assert lookup.with_files(table(spark, "file_id int, id string", (1, "a")), table(spark, "file_id int, path string, language string", (1, "p", "rust"))).first().language == "rust"


def test_briefs(spark, symbols):
    salience = table(spark, "id string, score double", ("f_1", 0.9), ("f_2", 0.0), ("f_3", 0.0))
    assert [r.id for r in search.brief(symbols, salience, "fix the load_cache").collect()][0] == "f_1"
    assert [r.id for r in search.task_hits(symbols, "qqq open_box").collect()][0] == "f_5"
    assert search.brief(symbols, salience, "the").count() == 0
    edges = table(spark, "src string, dst string", ("f_3", "f_1"), ("f_1", "f_2"))
    known = table(spark, "id string, score double, stability string, coverage string", ("f_1", 0.9, "volatile", "none"), ("f_3", 0.2, "stable", "none"))
    notes = table(spark, "seq int, target string, confidence double, text string", (1, "f_1", 0.5, "slow"), (2, "f_9", 0.5, "other"))
    told = search.brief_sections(search.brief(symbols, salience, "load_cache"), edges, symbols, known, notes).collect()
    by = lambda name: [r.text for r in told if r.section == name]
    assert by("volatile") == ["a::load_cache"] and by("callers") == ["t::test_store"] and by("callees") == ["a::store"]
    assert by("impact") == ["direct=1 all=1 risky=1"] and by("known") == ["f_1 [0.5] slow"]
    projects, warnings = workspace.opened({"x": lambda: symbols, "bad": lambda: spark.read.parquet("/nowhere/at/all"), "y": lambda: symbols.filter("file = 'src/a.py'")})
    assert list(projects) == ["x", "y"] and list(warnings) == ["bad"]
    both = workspace.brief_all(projects, "fix the store").collect()
    assert {(r.project, tuple(r.shared)) for r in both if r.id == "f_2"} == {("x", ("x", "y")), ("y", ("x", "y"))}
    assert values(workspace.callers_all({"x": (edges, symbols), "y": (edges, symbols)}, table(spark, "id string", ("f_2",))), "project", "caller") == [("x", "f_1"), ("y", "f_1")]


def test_hybrid_and_vectors(spark, symbols):
    lexical = search.search(symbols, "cache of boxes")
    semantic = table(spark, "id string, rank int", ("f_5", 1), ("f_2", 2), ("f_3", 3))
    fused = {r.id: (r.score, r.match) for r in search.hybrid(symbols, lexical, semantic, "cache of boxes").collect()}
    assert fused["f_2"][1] == "semantic" and fused["f_3"][0] < fused["f_2"][0] and "d_8" not in fused
    assert {m for _, m in fused.values()} >= {"semantic"} and search.hybrid(symbols, lexical, semantic, "box").count() == lexical.count()
    vectors = table(spark, "file string, embedding array<double>", ("src/a.py", [1.0]))
    made = search.embed_missing(symbols, vectors)
    assert values(made, "id") == [("f_3",), ("f_5",), ("f_6",), ("f_7",), ("t_4",)]
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 for r in made.collect())
    assert [search.semantic_status(None, True), search.semantic_status(vectors, False), search.semantic_status(vectors, True)] == ["no-index", "no-dependency", "ok"]


def test_sentences_of_other_scripts_are_not_merged(spark):
    rows = [(1, i, "user", t, "open_question", 0.6, 0) for i, t in enumerate(("Это вопрос?", "Другой вопрос?", "これは何?", "这是什么?", "Это вопрос?!"))]
    entries = table(spark, "conv_id int, turn int, role string, sentence string, category string, confidence double, at int", *rows)
    assert memory.dedup(entries).count() == 4


def test_summary_falls_back_on_the_assistant(spark):
    rows = [(1, 0, "user", "Hi. There"), (1, 1, "assistant", "Sure. Let me look at the slow cache of the store first. Then more."), (1, 2, "user", "ok"), (2, 0, "assistant", "I'll do it."), (3, 0, "user", "x" * 40)]
    got = {r.conv_id: r.summary for r in memory.context_summary(table(spark, "conv_id int, turn int, role string, text string", *rows)).collect()}
    assert got == {1: "Task: Let me look at the slow cache of the store first.", 2: "No context available.", 3: "Task: " + "x" * 40}


def test_memory_and_briefing_as_text(spark):
    entries = table(spark, "conv_id int, place int, category string, sentence string, confidence double, refs array<string>",
                    (1, 1, "decision", "use s_aaaaaa", 0.9, ["s_aaaaaa"]), (1, 2, "conclusion", "it is slow", 0.8, []), (2, 1, "error", "it failed", 0.85, []))
    names = table(spark, "conv_id int, entity string, symbol string", (1, "Store", "s_aaaaaa"))
    summaries, counts = table(spark, "conv_id int, summary string", (1, "Task: a"), (2, "Task: b")), table(spark, "conv_id int, messages int, tokens long", (1, 3, 50), (2, 1, 9))
    texts = memory.memory_text(entries, names, summaries, counts)
    assert "use s_aaaaaa [0.9] refs=s_aaaaaa" in texts.filter("conv_id = 1").first().text
    back = memory.read_memory(texts)
    assert values(back["entries"], "conv_id", "category", "sentence", "confidence") == [(1, "conclusion", "it is slow", 0.8), (1, "decision", "use s_aaaaaa", 0.9), (2, "error", "it failed", 0.8)]
    assert values(back["summaries"], "conv_id", "summary") == [(1, "Task: a"), (2, "Task: b")] and values(back["counts"], "conv_id", "messages", "original_tokens") == [(1, 3, 50), (2, 1, 9)]
    assert values(back["dictionary"], "entity", "symbol") == [("Store", "s_aaaaaa")]

    inferences = table(spark, "seq int, target string, confidence double, text string", *[(i, f"f_{i}", i / 20, "fast store code") for i in range(12)])
    flags = table(spark, "target string, text string, verified boolean", ("f_1", "check", True), ("f_2", "look", False))
    patches = table(spark, "patch_id string, target string, text string, status string", ("patch_1", "f_1", "speed up", "pending"), ("patch_2", "f_1", "no", "applied"))
    told = memory.briefing(inferences, flags, patches, entries.withColumn("seq", F.col("conv_id") == 1).withColumn("seq", F.col("seq").cast("long")), names)
    by = lambda rows, name: [r.text for r in rows if r.section == name]
    rows = told.collect()
    assert len(by(rows, "inferences")) == 10 and set(by(rows, "flags")) == {"f_1 check [VERIFIED]", "f_2 look"} and by(rows, "patches") == ["patch_1 f_1 speed up"]
    assert by(rows, "decisions") == ["use Store"] and by(rows, "learned") == ["it is slow"]
    text = memory.briefing_text(told, "Task: a")
    again = memory.read_briefing(text.select(F.lit("r").alias("artifact"), "text")).collect()
    assert by(again, "context") == ["Task: a"] and by(again, "inferences")[0] == "f_11 [0.55] fast store code" and [r.verified for r in again if r.section == "flags"].count(True) == 1
    page = memory.prompt(told).collect()
    assert [r.section for r in page] == ["inferences", "flags", "patches", "decisions", "learned"] and "- use Store" in page[3].markdown
    facts = table(spark, "category string, key string, value string", ("inference", "f_11", "store is fast"), ("inference", "f_0", "store"), ("flag", "f_1", "check it"), ("patch", "patch_1", "quite other words"), ("decision", "", "use store"))
    keyed = told.filter("section in ('inferences', 'flags', 'patches')").select("section", F.substring_index("text", " ", 1).alias("key"), "text").unionAll(told.filter("section in ('decisions', 'learned')").select("section", F.lit(""), "text"))
    assert {r.category: r.found for r in memory.fidelity(facts, keyed).collect()} == {"inference": 0.5, "flag": 1.0, "patch": 0.0, "decision": 1.0}


def node(file, language, number, parent, type_, text, name=None, head=None, start=0, stop=0):
    return file, language, number, parent, number, type_, name, text, head, start, stop


NODE = "file string, language string, node int, parent int, pos int, type string, name string, text string, head string, start int, stop int"


def test_trees_of_several_languages(spark):
    java = [
        node("A.java", "java", 0, None, "program", "", stop=9), node("A.java", "java", 1, 0, "import_declaration", "import x.Y;", start=0), node("A.java", "java", 2, 0, "package_declaration", "package com.app;", "com.app", start=1, stop=1),
        node("A.java", "java", 3, 0, "class_declaration", "class Account {}", "Account", "class Account", 2, 9), node("A.java", "java", 4, 3, "class_body", "{}", start=2, stop=9),
        node("A.java", "java", 5, 4, "field_declaration", "private static final int MAX = 1;", "MAX", start=3, stop=3), node("A.java", "java", 6, 4, "field_declaration", "int count = staticfinal;", "count", start=4, stop=4),
        node("A.java", "java", 7, 4, "method_declaration", "void pay() { new Bill(); }", "pay", "void pay()", 5, 7), node("A.java", "java", 8, 7, "class_declaration", "class Local {}", "Local", start=6, stop=6),
        node("A.java", "java", 9, 7, "object_creation_expression", "new Bill()", start=6, stop=6), node("A.java", "java", 10, 4, "mystery", "?", start=8)]
    cpp = [
        node("b.cpp", "cpp", 0, None, "translation_unit", "", stop=9), node("b.cpp", "cpp", 1, 0, "namespace_definition", "namespace ns {}", "ns", "namespace ns", 0, 9), node("b.cpp", "cpp", 2, 1, "field_declaration", "struct Inner {} nested;", "nested", start=1, stop=3),
        node("b.cpp", "cpp", 3, 2, "struct_specifier", "struct Inner {}", None, "struct Inner", 1, 2), node("b.cpp", "cpp", 4, 1, "function_definition", "int run(int a) { }", None, "int run(int a)", 4, 8),
        node("b.cpp", "cpp", 5, 4, "throw_statement", 'throw std::runtime_error("x");', start=5, stop=5), node("b.cpp", "cpp", 6, 4, "call_expression", "a::go(1)", start=6, stop=6), node("b.cpp", "cpp", 7, 4, "call_expression", "assert(x)", start=6, stop=6),
        node("b.cpp", "cpp", 8, 4, "try_statement", "try { f(); } catch (const std::out_of_range& e) { std::cerr; }", start=7, stop=7), node("b.cpp", "cpp", 9, 1, "using_declaration", "using Base::method;", start=8, stop=8)]
    rust = [
        node("c.rs", "rust", 0, None, "source_file", "", stop=9), node("c.rs", "rust", 1, 0, "function_item", "fn f() {}", "f", "fn f()", 0, 9), node("c.rs", "rust", 2, 1, "macro_invocation", 'bail!("x")', start=1, stop=1),
        node("c.rs", "rust", 3, 1, "try_expression", "g()?", start=2, stop=2), node("c.rs", "rust", 4, 1, "call_expression", "Err(Bad::new())", start=3, stop=3), node("c.rs", "rust", 5, 1, "macro_invocation", "debug_assert!(x)", start=4, stop=4)]
    nodes = table(spark, NODE, *java, *cpp, *rust).cache()
    found = trees.symbols(nodes).withColumn("id", F.concat_ws(":", "file", "name")).cache()
    assert values(found, "file", "qualified_name", "kind") == sorted([
        ("A.java", "import x.Y", "d"), ("A.java", "com.app", "m"), ("A.java", "com.app::Account", "t"), ("A.java", "com.app::Account::MAX", "c"), ("A.java", "com.app::Account::count", "v"), ("A.java", "com.app::Account::pay", "f"),
        ("b.cpp", "ns", "m"), ("b.cpp", "ns::nested", "v"), ("b.cpp", "ns::Inner", "t"), ("b.cpp", "ns::run", "f"), ("b.cpp", "ns::Base::method", "d"), ("c.rs", "f", "f")])
    assert values(trees.calls(nodes), "file", "callee_name") == [("A.java", "Bill"), ("b.cpp", "a::go"), ("b.cpp", "assert"), ("c.rs", "Err"), ("c.rs", "bail"), ("c.rs", "debug_assert")]
    assert values(trees.intents(nodes, found), "id", "tag", "description") == [
        ("b.cpp:run", "INTENT", "error-boundary"), ("b.cpp:run", "PRECONDITION", "assert() call"), ("b.cpp:run", "PRECONDITION", "throw in function body"), ("c.rs:f", "PRECONDITION", "debug_assert macro")]
    raised, caught = trees.error_sources(nodes, found), trees.error_boundaries(nodes, found)
    assert values(raised, "id", "error", "propagation") == [("b.cpp:run", "runtime_error", "throws"), ("c.rs:f", "Bad", "returns Err(...)"), ("c.rs:f", "Error", "propagates via ?"), ("c.rs:f", "bail", "throws")]
    assert values(caught, "id", "catches", "recovery") == [("b.cpp:run", "out_of_range", "logs")] and trees.unhandled(raised, caught).select("id").distinct().count() == 1
    assert "mystery" in {r.language: r.types for r in trees.unmapped(nodes).collect()}["java"] and trees.unmapped(nodes, ("mystery", "program", "class_body", "object_creation_expression")).filter("language = 'java'").count() == 0


def test_bodies_by_level(spark):
    rows = [
        ("1", "f1", "f", "python", "def f1(a, b) -> int", 'def f1(a, b) -> int:\n  """Says hi."""\n  return go("go") + Other', None, None, 2, 1, 0), ("2", "f2", "f", "python", "def f2()", "\n".join(["x"] * 20), None, None, 0, 0, 0),
        ("3", "f3", "f", "rust", "fn f3()", "\n".join(["x"] * 60), None, None, 0, 0, 0), ("4", "go", "f", "python", "def go()", "def go(): go() or Other 'unended go", "volatile", None, 0, 0, 0), ("5", "T", "t", "cpp", "class T", "class T", None, "covered", 0, 0, 3)]
    symbols = table(spark, "id string, name string, kind string, language string, signature string, body_text string, stability string, coverage string, calls int, callers int, members int", *rows)
    names = symbols.select("id", F.create_map(F.lit("a::go"), F.lit("4"), F.lit("m::Other"), F.lit("9")).alias("names"))
    got = {r.id: (r.level, r.content) for r in compression.compressed(symbols, names).collect()}
    assert got == {
        "1": ("SUMMARY", "fn f1; (2 params); -> int; calls 2 symbols; called by 1; [3 lines]\n  doc: Says hi."), "2": ("DOCSTRING", "def f2()"), "3": ("OMIT", ""),
        "4": ("FULL", "def go(): go() or 9 'unended go"), "5": ("SUMMARY", "type T (3 members)")}
    docs = table(spark, "b string, l string", ("#[x]\n/// One\n///two\nfn f() {}\n/// no", "rust"), ("int x;\n// lead\n// er\nint f();", "cpp"), ("func f() {}\n// late", "go"), ("/** a\n * b */ x", "java"), ("x = 1\n\n\n\n\n\'\'\'late\'\'\'", "python"), ("", "cpp"), (None, "rust"))
    assert [r[0] for r in docs.select(compression.docstring(F.col("b"), F.col("l"))).collect()] == ["One two", "lead er", "", "a b", "", "", ""]
    parts = table(spark, "s string, l string, n string, b string", ("const T& get(int a, map<b, c> d) const", "cpp", "get", "private: x"), ("pub fn f(x: (A, B), y: C) -> Vec<D>", "rust", "f", ""), ("def __init__(self) -> None:", "python", "__init__", ""), ("void f(int a)", "java", "__x", ""))
    got = parts.select(extraction.return_type(F.col("s"), F.col("l")).alias("r"), extraction.signature_params(F.col("s"), F.col("l")).alias("p"), extraction.visibility(F.col("n"), F.col("l"), F.col("b"), F.col("s")).alias("v")).collect()
    assert [(r.r, r.p, r.v) for r in got] == [("const T&", ["int a", "map<b, c> d"], "private"), ("Vec<D>", ["x: (A, B"], "public"), ("None", ["self"], "protected"), ("", [], "public")]
    assert [r[0] for r in table(spark, "n string", ("test_a_b",), ("test",)).select(extraction.test_behaviours(F.col("n"))).collect()] == [["a", "b"], ["test"]]


def test_store_of_a_project(spark, tmp_path):
    path = f"{tmp_path}/store"
    files = lambda *r: table(spark, "file string, rebuilt boolean", *r)
    rows = lambda *r: table(spark, "file string, id string", *r)
    first = artifacts.persist_build(spark, path, files(("a", True), ("b", True), ("c", True)), {"symbols": rows(("a", "1"), ("b", "2"), ("c", "3"))}, {"salience": table(spark, "id string", ("1",))})
    second = artifacts.persist_build(spark, path, files(("a", False), ("b", True), ("d", True)), {"symbols": rows(("b", "9"))}, {"salience": table(spark, "id string", ("9",))})
    assert first == {"files_written": 3, "files_removed": 0} and second == {"files_written": 2, "files_removed": 1}
    kept = artifacts.load_store(spark, path, ["symbols", "files", "salience"])
    assert values(kept["symbols"], "file", "id") == [("a", "1"), ("b", "9")] and values(kept["files"], "file") == [("a",), ("b",), ("d",)] and values(kept["salience"], "id") == [("9",)]
    assert artifacts.load_store(spark, f"{tmp_path}/none", ["symbols"]) == {}


def test_versions_recover(spark, tmp_path):
    book = artifacts.Versions(spark, f"file://{tmp_path}/state", "id string, n int")
    assert book.load().count() == 0
    book.save(table(spark, "id string, n int", ("a", 1)))
    book.change(lambda rows: rows.unionAll(table(spark, "id string, n int", ("b", 2))))
    assert values(book.load(), "id") == [("a",), ("b",)]
    for part in (tmp_path / "state/v=2").glob("*.parquet"):
        part.write_bytes(b"broken")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert values(book.load(), "id") == [("a",)] and (tmp_path / "state/corrupt-2").is_dir()
    for _ in range(3):
        book.save(table(spark, "id string, n int", ("c", 3)))
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("v=")]) == 2


def test_artifact_files(spark, tmp_path):
    scores = table(spark, "id string, qualified_name string, file string, score double, local_fan_in int, cross_fan_in int", ("f_1", "a::x", "z.py", 0.5, 1, 2), ("f_2", "a::y", "b.py", 0.5, 0, 0), ("f_3", "q", "c.py", 1.0, 3, 0))
    path = f"{tmp_path}/salience"
    artifacts.write_sections([artifacts.told(scores, "SCORES")], path, "[SALIENCE:1.0]\n[ROOT:/Old/Root]\n[ID_SCHEME:2]")
    lines = [r.value for r in spark.read.text(path).collect()]
    assert sorted(lines) == sorted(["[SALIENCE:1.0]", "[ROOT:/Old/Root]", "[ID_SCHEME:2]", "[SCORES]", "f_3 q file=c.py score=1.0 local=3 xfile=0 total=3", "f_2 a::y file=b.py score=0.5 local=0 xfile=0 total=0", "f_1 a::x file=z.py score=0.5 local=1 xfile=2 total=3", "[/SCORES]"])
    header = artifacts.header_of(spark, path)
    assert artifacts.staleness(header, ("/old/root",), 2) == "case" and artifacts.staleness(header, ("/new",), 2) == "location"
    assert artifacts.staleness(header, ("/Old/Root",), 2) is None and artifacts.staleness(header, ("/Old/Root",), 3) == "scheme" and artifacts.staleness({}, (), 1) is None and artifacts.header_of(spark, f"{tmp_path}/no") == {}
    for section, (head, pairs, order) in artifacts.SECTIONS.items():
        assert head and order, section
    assert artifacts.artifact_folder(spark, str(tmp_path), "salience", ("_SUCCESS",)) == f"{tmp_path}/salience" and artifacts.artifact_folder(spark, str(tmp_path), "salience", ("db",)) == str(tmp_path)
    symbols = table(spark, "id string, file string, kind string, name string, qualified_name string, scope string, signature string, body_text string", ("f_1", "a", "f", "x", "m::x", "m", "x()", None), ("f_2", "b", "f", "y", "y", "", "", "b"))
    calls = table(spark, "src string, dst string", ("f_1", "f_2"))
    artifacts.write_index(artifacts.index(symbols, calls), f"{tmp_path}/index")
    back = artifacts.read_index(spark, f"{tmp_path}/index")
    assert values(back["symbols"], "file", "id") == [("a", "f_1"), ("b", "f_2")] and values(back["calls"], "file", "dst") == [("a", "f_2")] and artifacts.read_index(spark, f"{tmp_path}/no")["calls"].count() == 0
    assert len({r.signature_hash for r in back["symbols"].collect()}) == 2
    packed = {r.file: json.loads(r.json) for r in artifacts.bundle(symbols, calls, table(spark, "id string, level string, content string, original string", ("f_1", "FULL", "c", "o"))).collect()}
    assert packed["a"]["bodies"][0]["level"] == "FULL" and packed["a"]["calls"] == [{"src": "f_1", "dst": "f_2"}] and packed["b"]["source_file"] == "b"
    (tmp_path / "cache.json").write_text(json.dumps({"version": "3", "files": {"a.py": {"n": 1}}}))
    (tmp_path / "bad.json").write_text("{not json")
    read = lambda name, version: values(artifacts.read_cache(spark, f"{tmp_path}/{name}", version, "struct<n:int>").select("path", "entry.n"), "path", "n")
    assert read("cache.json", "3") == [("a.py", 1)] and read("cache.json", "4") == [] and read("bad.json", "3") == [] and read("none.json", "3") == []


def test_history_sources(spark, tmp_path):
    (tmp_path / "log").write_text("".join(f"commit c{i} 2001-02-0{i + 1}T00:00:00+00:00\n\n1\t{i}\ta.py\n" for i in range(4)))
    assert values(discovery.commit_log(spark, f"{tmp_path}/log", 2), "sha", "deleted") == [("c2", 2), ("c3", 3)]
    sha = "0123456789" * 4
    text = f"{sha} 5 1 2\nauthor A\nauthor-time 981158400\n\tx = 1\n{sha} 6 2\nauthor-time 981244800\n\ty\n{sha} 7 3\nauthor-time oops\n\tz\n"
    assert [(r.line, str(r.ts)) for r in discovery.blame(table(spark, "file string, text string", ("a", text))).orderBy("line").collect()] == [(0, "2001-02-03 00:00:00"), (1, "2001-02-04 00:00:00")]
    assert discovery.pathspecs({"vendor"})[-2:] == [":(exclude)vendor", ":(exclude)*/vendor/*"] and "*.py" in discovery.pathspecs(set())
    commits = table(spark, "path string, sha int, ts string", ("a", 1, "2001-07-01"), ("b", 2, "2001-07-02")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    lines = table(spark, "file string, line int, ts string", ("a", 1, "2001-07-01"), ("b", 1, "2001-07-01")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert values(temporal.hottest(commits, lines, 1), "file") == [("b",)]
    short = temporal.symbol_history(table(spark, "id string, file string, start int, stop int", ("x", "a", 0, 3), ("y", "gone", 0, 1)), lines, commits, "2001-08-01")
    assert values(short, "id", "churn", "stability") == [("x", 0, "stable"), ("y", 0, "active")]


def test_ids_move(spark):
    mapping = table(spark, "old_id string, new_id string", ("a", "x"), ("b", "b"), ("c", "z"))
    report = snapshots.migration_report(mapping, table(spark, "id string", ("a",), ("q",))).first()
    assert (report.derived, report.changed, report.unchanged, report.matched, report.unmatched) == (3, 2, 1, 1, 1)
    tables = table(spark, "n int, names map<string,string>", (1, {"a": "A", "q": "Q"}), (2, None))
    assert {r.n: r.names for r in snapshots.remap_keys(tables, "n", "names", mapping).collect()} == {1: {"x": "A", "q": "Q"}, 2: None}


def test_files_that_go(spark, tmp_path):
    state = f"{tmp_path}/state"
    schema = "path string, content_hash string, seq long"
    table(spark, schema, ("a", "1", 1), ("b", "1", 2), ("a", None, 3)).write.parquet(f"{state}/batch=0")
    assert values(watch.current(spark, state), "path", "seq") == [("b", 2)]
    watch.compacted(spark, state, f"{tmp_path}/next")
    table(spark, schema, ("b", "2", 4)).write.parquet(f"{tmp_path}/next/batch=0")
    assert values(watch.current(spark, f"{tmp_path}/next"), "path", "content_hash") == [("b", "2")]
