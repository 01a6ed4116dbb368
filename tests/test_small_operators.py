"""The shorter operators, each on a table of a few rows."""

from pyspark.sql import functions as F

from graphloom.functions import identifiers, predicates
from graphloom.operators import compression, extraction, linking, memory, metrics, search, state, temporal, workspace
from graphloom.streaming import watch


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_names_of_tests(spark):
    rows = table(spark, "n string, q string, l string", ("test_a", "test_a", "python"), ("a", "tests::a", "rust"), ("TEST_F", "TEST_F", "cpp"), ("test_a", "test_a", "java"), ("a", "a", "python"))
    got = [r[0] for r in rows.select(predicates.is_test_function(F.col("n"), F.col("q"), F.col("l"))).collect()]
    assert got == [True, True, True, False, False]
    private = table(spark, "n string", ("_x",), ("__x",), ("x",)).select(predicates.is_private(F.col("n")))
    assert [r[0] for r in private.collect()] == [True, False, False]


def test_containment_and_unknown_kinds(spark):
    parents, calls = table(spark, "id string, parent string", ("a", None), ("b", "a")), table(spark, "src string, dst string", ("b", "a"))
    assert sorted(map(tuple, linking.containment(parents, calls).collect())) == [("a", "b", "contains"), ("b", "a", "calls")]
    met, known = table(spark, "language string, node_type string", ("py", "x"), ("py", "x"), ("py", "y"), ("go", "z")), table(spark, "language string, node_type string", ("go", "z"), ("py", "y"))
    assert [(r.language, r.kinds) for r in extraction.unknown_kinds(met, known).collect()] == [("py", ["x"])]


def test_trees_and_lines(spark):
    nested = table(spark, "file string, id string, parent string, pos int", ("f", "a", None, 0), ("f", "c", "a", 9), ("f", "b", "a", 2), ("f", "d", "b", 10), ("f", "e", None, 11))
    assert [r.line for r in linking.hierarchy_text(nested).orderBy("path").collect()] == ["a", "  b", "    d", "  c", "e"]
    totals = table(spark, "symbols long, files long, edges long, original long, compressed long, rebuilt long, reused long, reduction double", (9, 3, 2, 100, 25, 1, 2, 0.75))
    assert metrics.build_line(totals).first().line == "3 files (1 rebuilt, 2 reused), 9 symbols, 2 calls, 100 -> 25 tokens (75.0% less)"
    sizes = table(spark, "n long", (0,), (1023,), (1024,), (1536,), (5 * 1024**3,))
    assert [r[0] for r in sizes.select(identifiers.human_size(F.col("n"))).collect()] == ["0 B", "1023 B", "1 KB", "1.5 KB", "5 GB"]


def test_reports(spark):
    changes = {"x": table(spark, "path string, change string", ("a", "fresh"), ("b", "changed"), ("c", "removed")), "y": table(spark, "path string, change string", ("a", "fresh"))}
    assert sorted((r.project, r.files, r.stale) for r in workspace.status(changes).collect()) == [("x", 2, 2), ("y", 1, 0)]
    runs = table(spark, "type string, tokens int, calls int, ms double, correct boolean", ("find", 10, 1, 2.0, True), ("find", 30, 2, 4.0, False), ("find", 20, 2, 9.0, True))
    row = metrics.bench_summary(runs).first()
    assert (row.median_tokens, row.median_calls, row.median_ms) == (20.0, 2.0, 4.0) and abs(row.accuracy - 2 / 3) < 1e-9
    entries = table(spark, "conv_id int, turn int, at int, category string, sentence string", (1, 2, 0, "error", "b" * 40), (1, 1, 0, "error", "a"), (1, 1, 1, "decision", "c"))
    assert {r.category: [i.sentence[0] for i in r["items"]] for r in memory.by_category(entries).collect()} == {"error": ["a", "b"], "decision": ["c"]}
    assert memory.entry_tokens(entries).first().tokens == 12


def test_orders_and_words(spark):
    history = table(spark, "path string, churn int, stability string", ("a", 1, "active"), ("b", 0, "stable"), ("c", 4, "volatile"), ("d", 5, "volatile"))
    assert [r.path for r in temporal.in_order(history).collect()] == ["d", "c", "a", "b"]
    words = search.keywords(table(spark, "key int, text string", (1, "Where is the Cache of the cache_store and ab")), ("where", "the", "and"), 2).first().keywords
    assert words == ["cache", "cache_store"]
    symbols = table(spark, "file string, kind string, qualified_name string", ("x", "t", "b"), ("x", "f", "a"))
    assert compression.navigation_profile(symbols).first().profile == "f a\nt b"


def test_sessions(spark, tmp_path):
    kept, made = table(spark, "project string, text string", ("a", "old")), table(spark, "project string, text string", ("a", "new"), ("b", "new"))
    assert sorted(map(tuple, state.resume(kept, made).collect())) == [("a", "old"), ("b", "new")]
    symbols = table(spark, "id string, signature string", ("a", "x()"))
    same = symbols.select(F.substring(F.sha2("signature", 256), 1, 8)).first()[0]
    asked = table(spark, "patch_id string, id string, signature_hash string", ("p1", "a", same), ("p2", "a", "other"), ("p3", "gone", same))
    assert sorted(r.patch_id for r in state.drifted(asked, symbols).collect()) == ["p2", "p3"]
    log = table(spark, "seq long, kind string, target string, agent long, ts string", (1, "infer", "a", 0, "2001-01-01 01:00:00")).withColumn("ts", F.col("ts").cast("timestamp"))
    log.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        watch.append_log(spark.readStream.schema(watch.LOG).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
    seen = table(spark, "seq long, conv_id int, sentence string", (1, 9, "x"), (2, 3, "y"))
    memory.append_memory(seen.filter("conv_id = 9").drop("seq"), f"{tmp_path}/memories", 1)
    memory.append_memory(seen.filter("conv_id = 3").drop("seq"), f"{tmp_path}/memories", 2)
    assert [r.sentence for r in memory.latest_memory(spark.read.parquet(f"{tmp_path}/memories")).collect()] == ["y"]
