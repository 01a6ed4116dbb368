"""Operators on hand-made tables: ties, cycles, duplicates, unknown ids, thresholds."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import identifiers, predicates
from graphloom.operators import compression, extraction, graph, linking, lookup, memory, metrics, search, snapshots, state, temporal, workspace

SYMBOLS = [  # id, name, qualified_name, kind, scope, file, signature, body_text, span_start, span_end, pos
    ("f_1", "load", "a::load", "f", "a", "src/a.py", "def load(x)", "def load(x):\n  return 1", 0, 3, 0),
    ("f_2", "loadBuildCache", "a::loadBuildCache", "f", "a", "src/a.py", "def b()", None, 5, 9, 1),
    ("f_3", "_hidden", "b::_hidden", "f", "b", "src/b.py", "", "", 0, 1, 2),
    ("t_4", "Cache", "b::Cache", "t", "b", "vendor/c.py", "class Cache", "class Cache", 0, 20, 3),
    ("f_5", "test_load", "t::test_load", "f", "t", "tests/test_a.py", "", "", 0, 2, 4),
    ("d_6", "from src.a import load as l, other", "d::x", "d", "", "src/b.py", "", "", 0, 0, 5),
    ("f_1", "load", "z::load", "f", "z", "src/z.py", "def load()", "z", 0, 1, 6),
]
NAMES = "id string, name string, qualified_name string, kind string, scope string, file string, signature string, body_text string, span_start int, span_end int, pos int"
EDGES = [("f_1", "f_2"), ("f_1", "f_2"), ("f_2", "f_3"), ("f_3", "f_1"), ("f_3", "f_3"), ("f_5", "f_1"), ("gone", "f_2"), ("f_1", "t_4")]


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame(SYMBOLS, NAMES).cache()


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string").cache()


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def test_lookup(spark, symbols, edges):
    assert lookup.by_id(symbols, "f_1").first().file == "src/z.py"
    assert lookup.latest(symbols).count() == 6
    assert lookup.body(symbols, "f_2").first().body_text == "" and lookup.body(symbols, "no").count() == 0
    refs = spark.createDataFrame([("load",), ("a::load",), ("f_3",), ("gone",), ("nothing",)], "ref string")
    status = {r.ref: (r.status, r.id) for r in lookup.ref_status(symbols, edges, refs).collect()}
    assert status == {"load": ("name", "f_1"), "a::load": ("name", "f_1"), "f_3": ("id", "f_3"), "gone": ("graph_only", "gone"), "nothing": ("not_found", None)}
    assert {r.tier for r in lookup.by_name(symbols, refs.filter("ref = 'a::load'")).collect()} == {1}
    page = lookup.page(symbols.select("id", "pos"), [F.col("pos")], 3).collect()
    assert len(page) == 3 and page[0].not_shown == 4
    lines = spark.createDataFrame([("x", i, "é" * 3) for i in range(5)], "artifact string, at int, line string")
    assert lookup.byte_cap(lines, 21).count() == 3
    assert lookup.dictionary(symbols).filter("id = 'f_2'").first().line_from == 6


def test_graph(spark, symbols, edges):
    assert graph.clean_edges(edges).count() == 6
    found = {(r.id, r.distance) for r in graph.reach(edges, ids(spark, "f_2"), 2, backward=True).collect()}
    assert found == {("f_1", 1), ("gone", 1), ("f_3", 2), ("f_5", 2)}
    cyclic = {(r.id, r.distance) for r in graph.reach(edges, ids(spark, "f_1"), 3).collect()}
    assert cyclic == {("f_2", 1), ("t_4", 1), ("f_3", 2)}
    assert {r.id for r in graph.reach_fixpoint(edges, ids(spark, "f_5")).collect()} == {"f_1", "f_2", "f_3", "t_4"}
    names = {r.caller: r.caller_name for r in graph.callers(edges, lookup.latest(symbols), ids(spark, "f_2")).collect()}
    assert names == {"f_1": "z::load", "gone": "gone"}
    assert graph.neighbours(edges, ids(spark, "f_3")).count() == 4
    row = graph.context(edges, lookup.latest(symbols), ids(spark, "f_1")).first()
    assert row.callers == ["b::_hidden", "t::test_load"] and row.callees == ["a::loadBuildCache", "b::Cache"]


def test_salience_and_attention(spark):
    symbols = spark.createDataFrame([("a", "a", "a", "x.py"), ("b", "_b", "b", "y.py"), ("c", "c", "c", "vendor/z.py"), ("d", "d", "d", "test_d.py")], "id string, name string, qualified_name string, file string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("b", "a"), ("d", "a")], "src string, dst string")
    score = {r.id: r.score for r in metrics.project_salience(edges, symbols).collect()}
    assert score == {"a": 1.0, "b": 0.25, "c": 0.05, "d": 0.125}
    levels = lambda n: {r.level: r.symbols for r in metrics.attention_budget(metrics.attention(spark.range(n).select(F.col("id"), ((F.col("id") + 1) / n).alias("score")))).collect()}
    assert levels(1000) == {"critical": 301, "important": 400, "peripheral": 250, "skip": 49}
    assert levels(1001)["critical"] == 50
    assert {r.score for r in metrics.local_salience(edges, symbols).collect()} == {0.0}


def test_coverage(spark, edges, symbols):
    found = {r.id: (r.status, r.test_count) for r in metrics.coverage(edges, lookup.latest(symbols), ids(spark, "f_5")).collect()}
    assert found["f_1"] == ("covered", 1) and found["f_2"] == ("covered", 0) and found["f_3"] == ("none", 0)
    partial = metrics.partial_types(spark.createDataFrame([("t", "covered"), ("m", "none")], "id string, status string"), spark.createDataFrame([("m", "t")], "id string, parent string"))
    assert {r.id: r.status for r in partial.collect()} == {"t": "partial", "m": "none"}


def test_temporal(spark):
    rows = [("a", 1, "2001-05-03 00:00:00"), ("a", 2, "2001-05-02 23:59:59"), ("a", 3, "2001-07-01 10:00:00"), ("a", 4, "2001-07-01 12:00:00"), ("b", 5, "2001-07-31 00:00:00"), ("b", 6, "2001-07-30 00:00:00")]
    commits = spark.createDataFrame(rows, "path string, sha int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.path: (r.commits, r.churn, r.stability) for r in temporal.file_history(commits, "2001-08-01").collect()}
    assert got == {"a": (4, 2, "active"), "b": (2, 0, "stable")}
    assert [r.path for r in temporal.hot_files(commits, 1).collect()] == ["b"]


@pytest.mark.parametrize("text, want", [
    ("parseHTTPResponse2JSON", ["parse", "http", "response", "2", "json"]), ("load_build_cache", ["load", "build", "cache"]), ("", []),
    ("a::B/c-d.e", ["a", "b", "c", "d", "e"]), ("HTTPServer", ["http", "server"]), ("AB1c", ["ab", "1", "c"])])
def test_tokens(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(identifiers.tokens(F.col("t"))).first()[0] == want
    assert identifiers.token_list(text) == list(dict.fromkeys(want))


def test_variants(spark):
    words = ["paths", "queries", "classes", "class", "go", "is", "tokens"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", identifiers.variants_of(F.col("w")).alias("v")).collect()
    assert all(sorted(r.v) == identifiers.variants(r.w) for r in rows)
    assert identifiers.variants("queries") == ["queri", "querie", "queries", "query"]


def test_search(symbols):
    top = search.ranked(search.search(symbols, "load")).collect()
    assert [(r.id, r.match) for r in top[:2]] == [("f_1", "exact"), ("f_1", "exact")] and top[2].match == "prefix"
    assert search.search(symbols, "f_3").first().match == "exact-id"
    tiers = {r.qualified_name: r.match for r in search.search(symbols, "build caches").collect()}
    assert tiers["a::loadBuildCache"] == "subtoken"
    assert search.nearest(symbols, "hidden things").first().id == "f_3"
    assert search.nearest(symbols, "idde").first().score == 0.1
    assert search.search(symbols, "  ").count() == 0
    assert predicates.task_words("fix the") == [] and predicates.task_words("How to load a cache") == ["load", "cache"]


def test_fusion(spark):
    first = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    second = spark.createDataFrame([("a", 1), ("c", 2)], "id string, rank int")
    got = {r.id: (r.score, r.match) for r in search.fuse(first, second).collect()}
    assert got["a"] == (1.0, "hybrid") and got["b"][1] == "lexical" and got["c"] == (0.492, "semantic")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [2.0, 0.0]), (5, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in search.cosine_topk(v, 1).collect()] == [1, 4, 5]


def test_windows(spark):
    hits = spark.createDataFrame([("k", 10), ("k", 100), ("k", 400)], "key string, line int")
    assert sorted((r.start, r.stop) for r in search.windows_of(hits).collect()) == [(1, 160), (340, 460)]


MESSAGES = [
    (1, 0, "user", "How should the cache store work? We should keep it."), (1, 1, "assistant", "We should keep the `Store` small. Error: it failed! I changed the function."),
    (1, 2, "assistant", "It turns out the cache store is slow. We decided to use the cache store."), (1, 3, "user", "It turns out the cache store is slow!"), (1, 4, "user", "The store.py file, store.py, because."),
]


def test_memory(spark):
    messages = spark.createDataFrame(MESSAGES, "conv_id int, turn int, role string, text string")
    entries = memory.classify(memory.sentences(messages))
    kinds = sorted((r.turn, r["at"], r.category, r.confidence) for r in entries.collect())
    assert kinds == [(0, 0, "open_question", 0.6), (1, 0, "decision", 0.85), (1, 1, "error", 0.85), (1, 2, "code_change", 0.85),
                     (2, 0, "conclusion", 0.8), (2, 1, "decision", 0.9), (3, 0, "conclusion", 0.8), (4, 0, "conclusion", 0.8)]
    kept = memory.dedup(entries)
    assert kept.count() == 7
    assert memory.open_questions(kept).filter("category = 'open_question'").count() == 0
    found = {r.entity: r.n for r in memory.entities(messages).collect()}
    assert found == {"Store": 1, "store.py": 2}
    words = memory.entity_dictionary(memory.entities(messages), messages)
    marked = memory.with_symbols(entries, words).filter("turn = 1 and at = 0").first()
    assert "Store" not in marked.sentence and len(marked.refs) == 1
    back = memory.decompress(memory.with_symbols(entries, words), words).filter("turn = 1 and at = 0").first()
    assert back.sentence == "We should keep the `Store` small."
    final = memory.compress(messages).collect()
    assert len(final) == 5 and {r.category for r in final} == {"decision", "error", "conclusion", "code_change"}
    assert memory.context_summary(messages).first().summary.startswith("Task: ")
    long = spark.createDataFrame([("x" * 151,)], "t string").select(memory.shortened(F.col("t"))).first()[0]
    assert len(long) == 150 and long.endswith("...")


def test_state(spark):
    log = spark.createDataFrame([(1, "flag", "a"), (2, "verify", "a"), (3, "flag", "a"), (4, "flag", "b"), (5, "verify", "b")], "seq int, kind string, target string")
    assert {r.target: r.verified for r in state.flags(log).collect()} == {"a": False, "b": True}
    patches = spark.createDataFrame([(1, "propose", "p1"), (2, "reject", "p1"), (3, "apply", "p1"), (4, "propose", "p2")], "seq int, kind string, patch_id string")
    assert {r.patch_id: r.status for r in state.patches(patches).collect()} == {"p1": "rejected", "p2": "pending"}
    assert state.next_patch_number(spark.createDataFrame([("patch_9",), ("patch_12",)], "patch_id string")).first().number == 13


def test_snapshots(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, content_hash string")
    assert {r.path: r.change for r in snapshots.changes(old, new).collect()} == {"a": "fresh", "b": "changed", "c": "removed", "d": "added"}
    rows = [(1, 1, "h", 1, 1, "x", 10**10), (1, 1, "h", 1, 1, "x", 5), (1, 1, "h", 2, 1, "h", 5), (1, 1, "", 1, 1, "x", 5), (1, 1, "", 2, 1, "x", 5)]
    frame = spark.createDataFrame(rows, "om long, os long, oh string, m long, s long, h string, now long")
    assert [r[0] for r in frame.select(snapshots.is_fresh(*map(F.col, ("om", "os", "oh", "m", "s", "h", "now")))).collect()] == [True, False, True, True, False]
    mapped = snapshots.remap(spark.createDataFrame([("x", 1), ("y", 2)], "id string, n int"), "id", spark.createDataFrame([("x", "z")], "old_id string, new_id string"))
    assert sorted((r.id, r.n) for r in mapped.collect()) == [("y", 2), ("z", 1)]


def test_linking(spark, symbols):
    sites = spark.createDataFrame([(1, "a::load", "a"), (2, "load", "a"), (3, "x::Cache", ""), (4, "nope", ""), (5, "load", "q")], "site int, callee_name string, caller_scope string")
    got = {r.site: (r.status, r.resolved_id) for r in linking.resolve_calls(sites, symbols).collect()}
    assert got[1] == ("resolved_qualified", "f_1") and got[2] == ("resolved_same_scope", "f_1") and got[3] == ("resolved_unique", "t_4")
    assert got[4] == ("unresolved", None) and got[5] == ("ambiguous", None)
    spans = spark.createDataFrame([("f", "outer", 0, 10, 0), ("f", "inner", 2, 4, 1), ("f", "twin", 2, 4, 2)], "file string, id string, start int, stop int, pos int")
    lines = spark.createDataFrame([("f", 3), ("f", 9), ("f", 50)], "file string, line int")
    assert {r.line: r.id for r in linking.enclosing(lines, spans).collect()} == {3: "inner", 9: "outer"}
    text = spark.createDataFrame([("m.py", "from a import load as l, other"), ("m.py", "import x.y as z")], "file string, text string")
    found = {(r.name, r.part) for r in linking.imports(text).collect()}
    assert found == {("load", "a"), ("other", "a"), ("y", "x"), ("y", "y")}
    calls = spark.createDataFrame([("c1", "load", "m.py"), ("c1", "Cache", "m.py"), ("c1", "print", "m.py"), ("c1", "_hidden", "m.py")], "caller string, callee_name string, file string")
    links = lambda *names: {(r.callee, r.target_file) for r in linking.cross_file_links(calls, symbols, linking.imports(text), *names).collect()}
    assert links() == {("f_3", "src/b.py")}  # load is a name that libraries have
    assert links(("print",)) == {("f_1", "src/a.py"), ("f_3", "src/b.py")}
    nested = spark.createDataFrame([("1", "A", "", "f", 0), ("2", "A::m", "A", "f", 1), ("3", "A", "", "f", 2), ("4", "B::x", "B", "f", 3)], "id string, qualified_name string, scope string, file string, pos int")
    assert {r.id: r.parent for r in linking.hierarchy(nested).collect()} == {"1": None, "2": "3", "3": None, "4": None}


SOURCE = '''
import os
from a.b import c

LIMIT = 3

class Store(Base):
    """Keeps things."""
    def load(self, key: str) -> int:
        try:
            return self._find(key)
        except (KeyError, OSError):
            raise NotFound(key)

def test_load():
    assert Store().load("x")
    raise ValueError
'''


def test_extraction(spark):
    files = spark.createDataFrame([("s.py", SOURCE), ("bad.py", "def ("), ("none.py", None)], "path string, text string")
    found = {(r.qualified_name, r.kind) for r in extraction.symbols(files).collect()}
    assert {("Store", "t"), ("Store::load", "f"), ("test_load", "f"), ("LIMIT", "c"), ("import os", "d")} <= found
    facts = extraction.facts(files).cache()
    assert {(r.scope, r.text) for r in extraction.unhandled(facts).collect()} == {("test_load", "ValueError")}
    assert facts.filter("fact = 'catch'").first().text == "KeyError, OSError" and facts.filter("fact = 'recovery'").first().text == "returns"
    assert {(r.scope, r.tag, r.description) for r in extraction.intents(facts).collect()} == {
        ("test_load", "PRECONDITION", "assert statement"), ("test_load", "PRECONDITION", "throw in function body"), ("Store::load", "PRECONDITION", "throw in function body"), ("Store::load", "INTENT", "error-boundary")}
    heads = {r.name: r.signature for r in extraction.symbols(spark.createDataFrame([("o.py", "def one(a: int = 1): return {1: 2}\n\n@x\nclass Two(A,\n  B):\n    'doc'\n")], "path string, text string")).collect()}
    assert heads == {"one": "def one(a: int = 1)", "Two": "class Two(A,\n  B)"}
    row = spark.createDataFrame([("int f(map<int, list<a>> x, b[1, 2] y)", "f()")], "s string, e string").select(extraction.signature_params(F.col("s")).alias("s"), extraction.signature_params(F.col("e")).alias("e")).first()
    assert row.s == ["map<int, list<a>> x", "b[1, 2] y"] and row.e == []


def test_compression(spark):
    body = "\n".join(["x"] * 51)
    rows = [("f", body, None, None), ("f", "\n".join(["x"] * 11), None, None), ("f", "x", None, None), ("f", "", None, None), ("c", body, None, None), ("f", body, "volatile", None), ("f", body, None, "none")]
    frame = spark.createDataFrame(rows, "k string, b string, s string, c string")
    assert [r[0] for r in frame.select(compression.body_level(F.col("k"), F.col("b"), F.col("s"), F.col("c"))).collect()] == ["OMIT", "DOCSTRING", "SUMMARY", "FULL", "FULL", "FULL", "FULL"]
    text = 'load("load") + loader + load'
    short = compression.replace_outside_literals(text, {"load": "f_1", "loader": "f_2"})
    assert short == 'f_1("load") + f_2 + f_1'
    table = spark.createDataFrame([("1", short, None, {"load": "f_1", "loader": "f_2"})], "id string, compressed string, original string, names map<string,string>")
    assert compression.expanded(table).first().body == text
    doc = spark.createDataFrame([('def f():\n  """' + "d" * 300 + '"""',)], "b string").select(compression.docstring(F.col("b"), F.lit("python"))).first()[0]
    assert len(doc) == 200 and doc.endswith("...")


def test_workspace(spark, symbols):
    one = workspace.search_all({"x": symbols, "y": symbols.filter("file = 'src/a.py'")}, "loadBuildCache")
    assert [r.project for r in one.collect()][:2] == ["x", "y"]
    report = workspace.build_report({"good": lambda: symbols.agg(F.count("*").alias("n")), "bad": lambda: symbols.select("no such column")})
    assert report[0]["n"] == 7 and not report[1]["ok"]


def test_predicates(spark):
    paths = ["tests/a.py", "src/test_x.py", "x_test.py", "src/x.py", "a/vendor/x.py", "vendored/x.py", "x.spec.ts", "single"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(
        predicates.is_test_path(F.col("p")).alias("t"), predicates.is_test_file(F.col("p")).alias("f"), predicates.is_vendor(F.col("p")).alias("v"), predicates.top_folder(F.col("p")).alias("d")).collect()
    assert [r.t for r in rows] == [True, True, True, False, False, False, False, False]
    assert [r.f for r in rows] == [False, True, False, False, False, False, True, False]
    assert [r.v for r in rows] == [False] * 4 + [True] + [False] * 3 and rows[-1].d == "."
