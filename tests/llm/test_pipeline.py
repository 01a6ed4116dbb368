"""The pipeline's stages, each against its definition on what the stage before kept."""

import hashlib
import random

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_text_operators import components, spans


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(8)
    prose = lambda n: " ".join("".join(rnd.choice(["ta", "re", "lo", "mi", "su", "ne"]) for _ in range(rnd.randrange(1, 5))) for _ in range(n))
    texts, labels = [], []
    for i in range(600):
        good = i % 5 > 0
        text = f"Terms of use line\n{prose(60)}\n{prose(30)}." if good else " ".join([prose(1)] * 50) if i % 2 else " ".join(w + "%%%" for w in prose(60).split())
        if good and i % 7 == 0:
            text += ' token = "abcdefgh12345678"'
        texts.append(text)
        if i % 3:
            labels.append((i, int(good), 0))
    originals = [t for i, t in enumerate(texts) if i % 5][:30]
    texts += originals + [" ".join(t.split()[:-1]) + " changed" for t in originals]
    out = tmp_path_factory.mktemp("pipeline")
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)] + [(len(texts), None, None, None, None), (len(texts) + 1, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages(spark, folder, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_runs", "near_duplicates", "secret_scan", "mixture_packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else {}
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "mixture_packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            after = {r.doc_id: r.text for r in out.collect()}
            assert set(after) <= set(before) and len(after) == out.count()
        if name == "quality_classifier":
            wrong = [i for i in before if i < 600 and (i in after) != (i % 5 > 0)]
            assert len(wrong) <= 6, wrong
        elif name == "line_runs":
            first = {}
            for i in sorted(before):
                for line in (before[i] or "").split("\n"):
                    first.setdefault(line.strip(" \t\n\x0b\x0c\r").lower(), i)
            for i, t in before.items():
                want = [x for x in (t or "").split("\n") if len(x.strip(" \t\n\x0b\x0c\r")) < 10 or first[x.strip(" \t\n\x0b\x0c\r").lower()] == i]
                assert after[i] == "\n".join(want)
            assert out.filter(F.coalesce(F.length("text"), F.lit(0)) != F.col("n_chars")).count() == 0
        elif name == "near_duplicates":
            ids = sorted(before)
            assert sorted(after) == sorted(i for i, _, c in components([before[i] for i in ids], ids) if i == c)
            assert all(after[i] == before[i] for i in after)
        elif name == "secret_scan":
            for i, t in before.items():
                parts, at = [], 0
                for kind, start, stop in spans(t or ""):
                    if stop > at:
                        parts += [t[at:start], f"<{kind}>"] if start >= at else []
                        at = stop
                assert after[i] == (None if t is None else "".join(parts) + t[at:])
            assert any(a != before[i] for i, a in after.items())
        else:
            tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            for r in out.collect():
                kept.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
            assert set(kept) == set(before)
            for i, parts in kept.items():
                assert sum(n for _, n, _ in parts) == parts[0][2] == len(tokenizer.encode(before[i] or "", add_special_tokens=False).ids) + 1
        docs = out


def test_run_is_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 300


def test_rows_are_judged_by_their_own_text(spark, folder):
    rnd = random.Random(13)
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 600")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good, bad = [texts[i] for i in range(600) if i % 5], [texts[i] for i in range(600) if i % 5 == 0]
    extra = [(None, good[0]), (None, bad[0]), (9000, good[1]), (9000, bad[1]), (9000, good[2])]
    rows = [(i, t, "en", "s", len(t)) for i, t in extra]
    out = corpus_pipeline.quality_classifier(spark, docs.unionAll(spark.createDataFrame(rows, docs.schema)), folder).collect()
    assert sorted([(r.doc_id, r.text) for r in out if r.doc_id is None or r.doc_id == 9000], key=str) == sorted([e for e in extra if e[1] not in bad], key=str)

    a, b, c, d, e = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(40)) for _ in range(5))
    given = [(1, a), (2, a + " more"), (2, b), (None, a + " other"), (None, c), (None, c), (None, c + " more"), (None, d), (3, e), (3, e), (3, e + " more"), (None, ""), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in given], docs.schema)
    out = sorted([(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()], key=str)
    first = lambda *t: min(t, key=lambda x: hashlib.md5(x.encode()).hexdigest())
    assert out == sorted([(1, a), (2, b), (None, first(c, c + " more")), (None, d), (3, first(e, e + " more")), (None, ""), (None, None), (None, "")], key=str)


def test_stages_take_odd_tables(spark, folder):
    """No rows, other columns, null and repeated ids, and a very long text."""
    schema = "extra string, doc_id long, text string, lang string, source string, n_chars long, score double, label long, text_key string"
    rnd = random.Random(15)
    long = "\n".join(" ".join(f"w{rnd.randrange(10**5)}" for _ in range(20)) for _ in range(4_000)) + "\npassword = abcdefgh1234"
    given = [(1, long), (1, "one line of text\nsecond line of text"), (None, "one line of text\nthird line of text"), (None, None), (None, ""), (7, "one line of text")]
    docs = spark.createDataFrame([("e", i, t, "en", None, 3, 0.1, 5, "k") for i, t in given], schema)
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        out = stage(spark, docs, folder)
        if name != "mixture_packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        got[name] = out.collect()
    texts = lambda name: sorted([(r.doc_id, r.text) for r in got[name]], key=str)
    assert set(texts("quality_classifier")) <= set(given)
    assert texts("line_runs") == sorted([(1, long), (1, given[1][1]), (None, "third line of text"), (None, ""), (None, ""), (7, "")], key=str)
    assert texts("near_duplicates") == sorted(given, key=str)
    assert texts("secret_scan") == sorted([(i, t and t.replace("password = abcdefgh1234", "<assign>")) for i, t in given], key=str)
    ends = [(r.doc_id, r.doc_tokens) for r in got["mixture_packing"] if r.start == 0]
    assert len(ends) == len(given) and ends.count((None, 1)) == 2


def test_a_run_leaves_only_what_its_result_reads(spark, folder):
    from graphloom.llm import common

    before = common.left(spark)
    rows = corpus_pipeline.run(spark, folder)
    n = rows.count()
    common.sweep(spark, besides=before)
    assert n > 300 and common.left(spark) == before
