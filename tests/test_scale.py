"""What keeps a task's memory and the shuffled bytes in proportion to the input, and the same results."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.joins import spread, tasks_of
from graphloom.operators import extraction, graph, linking, metrics, search, snapshots


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_tasks_follow_the_bytes_of_the_input(spark, tmp_path):
    spark.range(40_000).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    few, many = tasks_of(rows, task_bytes=100_000), tasks_of(rows, task_bytes=10_000)
    assert few < many and spread(rows, "id", task_bytes=10_000).distinct().rdd.getNumPartitions() == many
    assert tasks_of(spark.sparkContext.parallelize([(1,)]).toDF(["id"])) is None  # not known: left to Spark


def test_windows_with_equal_hits(spark):
    hits = [("a", 500), ("a", 500), ("a", 300), ("a", 300), ("a", 380)]
    found = search.windows_of(spark.createDataFrame(hits, "key string, line long"))
    assert sorted(map(tuple, found.collect())) == [("a", 240, 560)]


def test_enclosing_takes_a_block_of_each_size(spark):
    deal = random.Random(1)
    spans = [(deal.choice("ab"), n, start, start + deal.choice((-3, 0, 1, 7, 40, 900)), n) for n, start in enumerate(deal.randrange(-50, 400) for _ in range(300))]
    sites = [(f, line) for f in "abc" for line in range(-60, 600, 3)]
    want = {}
    for f, line in sites:
        around = [(stop - start, pos, i) for g, i, start, stop, pos in spans if g == f and start <= line <= stop]
        if around:
            want[f, line] = min(around)[2]
    found = linking.enclosing(spark.createDataFrame(sites, "file string, line long"), spark.createDataFrame(spans, "file string, id long, start long, stop long, pos long"))
    assert {(r.file, r.line): r.id for r in found.collect()} == want
    assert "stop" not in plan(found).split("Join")[0]  # spans are summed before lines meet them


def test_edges_are_compared_in_one_shuffle(spark):
    schema = "src string, dst string"
    old = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("n", None)], schema)
    new = spark.createDataFrame([("a", "b"), ("d", "e"), ("d", "e"), ("n", None), (None, "x")], schema)
    found = snapshots.diff_edges(old, new)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("a", "c", "removed"), ("d", "e", "added"), (None, "x", "added")], key=str)
    assert plan(found).count("Exchange") == 1


def test_fan_makes_edges_distinct_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "b"), ("b", "b"), (None, "a"), ("a", None)], "src string, dst string")
    found = graph.fan(edges)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("a", 0, 1), ("b", 3, 1), ("c", 0, 1), (None, 1, 0), (None, 0, 1)], key=str)
    assert plan(found).count("Exchange") == 2 and "Join" not in plan(found)


@pytest.mark.parametrize("symbols", [[("a", "f"), ("b", "g"), ("c", "g")], [("a", "f"), ("b", "g"), ("b", "f"), ("c", "g")]])
def test_salience_counts_calls_before_it_places_the_callee(spark, symbols):
    rows = spark.createDataFrame([(i, i, i, file) for i, file in symbols], "id string, name string, qualified_name string, file string")
    found = metrics.project_salience(spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "b"), ("b", "a")], "src string, dst string"), rows)
    files = lambda i: [f for j, f in symbols if j == i]
    pairs = lambda own: [(f, g) for s, t in (("a", "b"), ("a", "b"), ("c", "b"), ("b", "a")) if t == own for f in files(s) for g in files(t)]
    got = {r.id: (r.local_fan_in, r.cross_fan_in) for r in found.collect()}
    assert got == {i: (sum(f == g for f, g in pairs(i)), sum(f != g for f, g in pairs(i))) for i, _ in symbols}
    assert plan(found).count("ShuffledHashJoin") >= 2


def test_calls_of_a_name_and_scope_are_resolved_once(spark):
    symbols = spark.createDataFrame([("1", "f", "A::f", "A", 0), ("2", "f", "B::f", "B", 1)], "id string, name string, qualified_name string, scope string, pos int")
    sites = spark.createDataFrame([("x", "f", "A"), ("y", "f", "A"), ("z", "f", None), ("u", None, "A"), ("v", "B::f", None)], "site string, callee_name string, caller_scope string")
    found = linking.resolve_calls(sites, symbols)
    got = {r.site: (r.status, r.resolved_id, r.candidates) for r in found.collect()}
    assert got == {"x": ("resolved_same_scope", "1", 2), "y": ("resolved_same_scope", "1", 2), "z": ("ambiguous", None, 2), "u": ("unresolved", None, 0), "v": ("resolved_qualified", "2", 1)}
    assert plan(found).count("Join") == 1


def test_signatures_with_any_brackets(spark):
    def split(text):
        depth, now, done = 0, [], []
        for piece in text.split(","):
            depth += sum(c in "<([{" for c in piece) - sum(c in ">)]}" for c in piece)
            now.append(piece)
            if depth == 0:
                done, now = done + [",".join(now).strip(" ")], []
        return [p for p in done + ([",".join(now).strip(" ")] if now else []) if p]

    deal = random.Random(2)
    inner = ["".join(deal.choice(["a", " ", ",", ", ", "<b,c>", "(x, [y, {z, w}])", "<", ")", "<(,)>", "((((((d,e))))))"]) for _ in range(deal.randrange(9))) for _ in range(400)]
    rows = spark.createDataFrame([(n, f"f({text})", text) for n, text in enumerate(inner)], "n int, signature string, text string")
    found = rows.select("text", extraction.signature_params(F.col("signature"), F.lit("cpp")).alias("params"))
    assert "regexp_extract_all" in plan(found)  # closed brackets are not counted piece by piece
    assert all(r.params == split(r.text) for r in found.collect())
