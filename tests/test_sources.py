"""Sources and sinks: trees, logs, transcripts, artifacts, the store, streams."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.sources import artifacts, discovery
from graphloom.streaming import watch


def test_discovery(spark, tmp_path):
    for name in ("a.py", "sub/b.rs", "node_modules/c.js", ".hidden/d.py", "e.txt", "vendor/f.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    found = {r.path: (r.language, r.text) for r in discovery.discover(spark, str(tmp_path)).collect()}
    assert found == {"a.py": ("python", "x = 1\n"), "sub/b.rs": ("rust", "x = 1\n")}
    ignores, keeps = discovery.ignore_rules("# no\nsub/\n!vendor\n")
    assert set(r.path for r in discovery.discover(spark, str(tmp_path), discovery.skip_set(ignores, keeps)).collect()) == {"a.py", "vendor/f.py"}


def test_commit_log(spark, tmp_path):
    (tmp_path / "log").write_text("commit abc 2001-02-03T04:05:06+00:00\n\n3\t1\tsrc/a.py\n-\t-\tbin.png\ncommit def 2001-02-04T04:05:06+00:00\n\n1\t0\tsrc/a.py\n")
    rows = discovery.commit_log(spark, str(tmp_path / "log")).orderBy("path", "ts").collect()
    assert [(r.path, r.sha, r.added) for r in rows] == [("bin.png", "abc", None), ("src/a.py", "abc", 3), ("src/a.py", "def", 1)]


def test_transcripts_and_workspace(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.json").write_text(json.dumps({"messages": [{"role": "user", "content": "hi"}]}))
    (tmp_path / "t/b.json").write_text(json.dumps([{"role": "assistant", "content": "yes"}, {"content": "no"}]))
    assert sorted((r.turn, r.role, r.text) for r in discovery.transcripts(spark, str(tmp_path / "t")).collect()) == [(0, "assistant", "yes"), (0, "user", "hi"), (1, "unknown", "no")]
    (tmp_path / "w.json").write_text('{"x": "one", "y": "../two"}')
    assert discovery.workspace(spark, str(tmp_path / "w.json"))["x"] == f"{tmp_path}/one"
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        discovery.workspace(spark, str(tmp_path / "bad.json"))


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([("a b", 1.5, "x%y"), ("c", -2.0, "")], "id string, score double, note string")
    artifacts.write_artifact(artifacts.lines(rows, "S"), str(tmp_path / "a"))
    back = artifacts.parsed(artifacts.read_artifact(spark, str(tmp_path / "a")), "id", {"score": "double", "note": "string"})
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    text = spark.createDataFrame([("m", "[MAP]\nx\ny\n[DICT]\nz\n")], "artifact string, text string")
    assert [(r.section, r.line) for r in artifacts.read_sections(text).orderBy("at").collect()] == [("MAP", "x"), ("MAP", "y"), ("DICT", "z")]


def test_store_replaces_files_only(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *r: spark.createDataFrame(list(r), "id string, file string")
    artifacts.save_store({"symbols": rows(("1", "a"), ("2", "b"))}, path)
    artifacts.save_store({"symbols": rows(("3", "a"))}, path)
    loaded = artifacts.load_store(spark, path, ["symbols"])["symbols"]
    assert sorted((r.id, r.file) for r in loaded.collect()) == [("2", "b"), ("3", "a")]
    spark.createDataFrame([("schema_version", "0")], "key string, value string").write.mode("overwrite").parquet(f"{path}/meta")
    assert artifacts.load_store(spark, path, ["symbols"]) == {}
    artifacts.compact(spark, f"{path}/symbols", f"{path}/small", 1)
    assert spark.read.parquet(f"{path}/small").count() == 2


def test_watch_is_idempotent(spark, tmp_path):
    source, state, mark = (str(tmp_path / n) for n in ("in", "state", "mark"))
    schema = "path string, content_hash string, seq long"
    add = lambda *rows: spark.createDataFrame(list(rows), schema).write.mode("append").parquet(source)
    add(("a", "1", 1), ("b", "1", 2))
    watch.watch(spark, source, schema, state, mark).awaitTermination()
    add(("a", "2", 3))
    for _ in range(2):
        watch.watch(spark, source, schema, state, mark).awaitTermination()
    assert {r.path: r.content_hash for r in watch.current(spark, state).collect()} == {"a": "2", "b": "1"}


def test_log_windows(spark, tmp_path):
    rows = [(1, "infer", "a", 0, "2001-01-01 01:00:00"), (2, "infer", "a", 0, "2001-01-01 02:00:00"), (3, "flag", "a", 0, "2001-01-09 02:00:00")]
    spark.createDataFrame(rows, "seq long, kind string, target string, agent long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "log"))
    stream = watch.operation_counts(spark.readStream.schema(watch.LOG).parquet(str(tmp_path / "log")))
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.kind, r.n) for r in spark.table("counts").collect()) == [("flag", 1), ("infer", 2)]
