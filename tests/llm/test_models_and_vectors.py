"""Classifiers by held-out accuracy, embeddings by brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, embedding_dedup, quality, toxicity
from graphloom.llm.common import id_text_remainder
from graphloom.llm.textscan import SPACE, slices


def corpus(n):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice(["ta", "re", "lo", "mi", "su"]) for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(20, 120))]
        toxic, good = rnd.random() < 0.2, rnd.random() < 0.8
        if toxic:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(["vilely", "foulish", "nastier", "Vile"])
        if not good:
            words = [w + "%%%" for w in words] if rnd.random() < 0.5 else [words[0]] * len(words)
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(good), int(toxic)))
    return rows + [(n, None), (n + 1, ""), (None, "text of no id"), (3, "repeated id")], labels


def held(i, divisor, rest):
    return zlib.crc32(str(i).encode()) % divisor == rest


def test_toxicity(spark):
    rows, labels = corpus(3_000)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known, id_text_remainder("doc_id", 4) != 2)
    scores = toxicity.score_documents(docs, model).collect()
    assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)
    got = {r.doc_id: r.score >= 0.3 for r in scores}
    test = [(i, t) for i, _, t in labels if held(i, 4, 2) and i != 3]
    assert sum(got[i] == bool(t) for i, t in test) / len(test) > 0.95
    empty = toxicity.fit(docs, known.filter("toxic = 0"), id_text_remainder("doc_id", 4) != 2)
    assert toxicity.score_documents(docs.limit(0), empty).count() == 0


def test_the_step_turns_round_when_the_risk_on_negatives_falls_below_zero():
    is_pos, prior = np.arange(6) < 2, 0.4
    for logits, below in ((np.array([3.0, 4.0, 0.5, 0.5, 0.5, 0.5]), True), (np.array([-1.0, 0.2, 2.0, 1.0, 3.0, 0.1]), False)):
        loss = lambda g, y: np.logaddexp(0, -g if y else g)
        bracket = lambda g: loss(g[2:], 0).mean() - prior * loss(g[:2], 0).mean()
        slopes, found = toxicity.risk_slopes(logits, is_pos, prior)
        assert abs(found - bracket(logits)) < 1e-12 and (found < 0) == below
        risk = (lambda g: -bracket(g)) if below else (lambda g: prior * loss(g[:2], 1).mean() + bracket(g))
        for i in range(6):
            step = np.zeros(6)
            step[i] = 1e-6
            assert abs((risk(logits + step) - risk(logits - step)) / 2e-6 - slopes[i]) < 1e-6
        if below:
            assert bracket(logits - 0.1 * slopes) > found


def test_training_meets_and_leaves_the_region_below_zero():
    rng, met = np.random.default_rng(0), []
    rows = [np.array([i % 5]) if i < 50 else rng.choice(np.arange(5, 50), 2, replace=False) for i in range(400)]
    slopes = toxicity.risk_slopes
    try:
        toxicity.risk_slopes = lambda *a: met.append(slopes(*a)[1]) or slopes(*a)
        w, b = toxicity.fit_member(rows, np.arange(400) < 50, 50, 0.3, 1)
    finally:
        toxicity.risk_slopes = slopes
    below = [i for i, x in enumerate(met) if x < 0]
    assert below and any(met[i] > x for i, x in ((i + 1, met[i]) for i in below if i + 1 < len(met)))
    assert np.isfinite(w).all() and abs(b) < 40


def test_scores_of_long_texts_and_other_columns(spark):
    rows, labels = corpus(600)
    long = " ".join(["tare lomi su"] * 60_000)
    rows += [(5_000, long), (5_001, long + " vile vilely foulish nastier vilely")]
    wide = spark.createDataFrame([(i, t, 0.5, 7, "x") for i, t in rows], "doc_id long, text string, score double, found int, features string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain = wide.select("doc_id", "text")
    for learn, score in ((lambda d: toxicity.fit(d, known, F.lit(True)), toxicity.score_documents), (lambda d: None, lambda d, _: quality.score_documents(d, known, F.lit(True)))):
        got, want = (sorted([(r.doc_id or -1, round(r.score, 9)) for r in score(d, learn(d)).collect()]) for d in (wide, plain))
        assert got == want and len(got) == len(rows)
    model = toxicity.fit(plain, known, F.lit(True))
    by = {r.doc_id: r.score for r in toxicity.score_documents(plain, model).collect()}
    assert by[5_001] > by[5_000]


def test_quality(spark):
    rows, labels = corpus(3_000)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scores = quality.score_documents(docs, known, id_text_remainder("doc_id", 5) != 0).collect()
    assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)
    got = {r.doc_id: r.score >= 0.3 for r in scores}
    test = [(i, q) for i, q, _ in labels if held(i, 5, 0) and i != 3]
    assert sum(got[i] == bool(q) for i, q in test) / len(test) > 0.97
    one = quality.score_documents(docs, known.filter("quality = 1"), id_text_remainder("doc_id", 5) != 0)
    assert one.select("score").distinct().count() == 1
    assert quality.score_documents(docs.limit(0), known, F.lit(True)).count() == 0


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(2)
    x = rng.random((4_000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_tables(x, y)
    assert (0, 1) in model.pairs
    assert ((model.scores(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(3)
    x = np.round(rng.random((500, 4)), 2)
    model = quality.fit_tables(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float), rounds=20, pair_rounds=10, n_pairs=3)
    assert len(model.pairs) == 3
    for row, score in zip(x, model.scores(x)):
        bins = [sum(edge <= v for edge in edges) for edges, v in zip(model.edges, row)]
        logit = model.base + sum(table[b] for table, b in zip(model.tables, bins))
        for (i, j), table in zip(model.pairs, model.pair_tables):
            logit += table[model.coarse[i][bins[i]], model.coarse[j][bins[j]]]
        assert abs(score - 1 / (1 + np.exp(-logit))) < 1e-12


def test_words_of_slices():
    texts = ["ab  Cd", "", None, "ef\x0bgh", "é ü"]
    found = []
    for piece in slices(pa.array(texts), size=4):
        starts, ends, owner = piece.words(~SPACE)
        found += [(piece.first + o, piece.data[a:b].tobytes().decode()) for a, b, o in zip(starts, ends, owner)]
    assert found == [(0, "ab"), (0, "Cd"), (3, "ef"), (3, "gh"), (4, "é"), (4, "ü")]


VECTORS = "vec_id long, embedding array<float>, label int, id string, score double, bucket string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "a", 1.0, "b") for i, v in rows], VECTORS)


def points():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 16))
    rows = [*base, *(base[:20] + 0.05 * rng.normal(size=(20, 16))), *([base[3]] * 30), *(base[5] + 0.02 * rng.normal(size=(40, 16))), base[7] * 3]
    return [np.float32(v).tolist() for v in rows]


BAD = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (None, [1.0] * 16), (904, [1.0, 2.0]), (905, [float("inf")] * 16)]


def reference_links(rows, cosine=0.9):
    """(vec_id, n_links, component_id) of every row by comparing all."""
    usable = [i is not None and v is not None and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v) for i, v in rows]
    m = np.array([v if ok else [0.0] * 16 for (_, v), ok in zip(rows, usable)], float)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    links = (m @ m.T >= cosine) & np.outer(usable, usable)
    np.fill_diagonal(links, False)
    ids = [i for i, _ in rows]
    reach = np.array([i if ok else -1 for i, ok in zip(ids, usable)])
    while True:
        new = np.array([min([r, *reach[near]]) if ok else -1 for r, near, ok in zip(reach, links, usable)])
        if (new == reach).all():
            break
        reach = new
    return sorted([(i, int(n), int(r) if ok else i) for i, n, r, ok in zip(ids, links.sum(1), reach, usable)], key=str)


@pytest.mark.parametrize("signs", [True, False])
def test_near_duplicate_embeddings(spark, signs):
    rows = [*enumerate(points()), *BAD]
    found = embedding_dedup.near_duplicates(vectors(spark, rows).repartition(3), signs=signs).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in found], key=str) == reference_links(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in found)
    assert embedding_dedup.near_duplicates(vectors(spark, [(1, [1.0])]).limit(0)).count() == 0


def test_rows_of_one_vec_id_are_judged_by_their_own_vectors(spark):
    x = points()
    rows = [(i % 60, v) for i, v in enumerate(x)] + [(1, x[3]), (1, x[3]), (2, x[5]), (500, x[0]), (500, x[1]), (500, x[1])]
    found = embedding_dedup.near_duplicates(vectors(spark, rows).repartition(3)).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in found], key=str) == reference_links(rows)


def test_links_of_a_large_component_are_counted_by_blocks(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=16)
    x = [np.float32(base + rng.choice([0.02, 0.25]) * rng.normal(size=16)).tolist() for _ in range(700)] + points()
    rows = list(enumerate(x))
    found = embedding_dedup.near_duplicates(vectors(spark, rows).repartition(3), block=256).collect()
    got = {r.vec_id: r for r in found}
    m = np.array(x)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    same = np.array([got[i].component_id for i in range(len(x))])
    links = (m @ m.T >= 0.9) & (same[:, None] == same[None, :])
    np.fill_diagonal(links, False)
    assert [got[i].n_links for i in range(len(x))] == links.sum(1).tolist()
    assert sum(1 for i, n, c in reference_links(rows) if got[i].component_id != c) <= 2


def test_large_buckets_are_compared_in_blocks(spark):
    from graphloom.llm.buckets import across_blocks

    rows = [(b, i, 0 if i % 10 else i) for b in (1, 2) for i in range(60)]
    torn = spark.createDataFrame(rows, "bucket long, id long, component long")

    def compare(rest, every):
        seen = [(a, b) for a, ca in zip(rest["id"].to_pylist(), rest["component"].to_pylist()) for b, cb in zip(every["id"].to_pylist(), every["component"].to_pylist()) if ca != cb]
        return pa.table({"a": pa.array([a for a, _ in seen], pa.int64()), "b": pa.array([b for _, b in seen], pa.int64())})

    got = across_blocks(torn, compare, "a long, b long", block=7).collect()
    want = {(i, j) for i in range(10, 60, 10) for j in range(60) if j % 10 or j != i}
    assert {(r.a, r.b) for r in got} == want and len(got) == 2 * len(want)


def test_search(spark):
    x = points()
    docs = vectors(spark, [*enumerate(x), *BAD]).repartition(3)
    rows = ann.search(docs, F.col("vec_id") % 20 == 0, k=7, block_rows=100, query_rows=5).collect()
    m, hits, total = np.array(x), 0, 0
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, len(x), 20))
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 8)) and q not in [r.vec_id for r in found]
        exact = (m * m[q]).sum(1)
        assert all(abs(r.score - exact[r.vec_id]) < 1e-9 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        exact[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -exact))[:7]
        hits += len(set(best.tolist()) & {r.vec_id for r in found})
        total += 7
    assert hits / total >= 0.9
    assert ann.search(docs.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0])])
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]


def test_search_with_repeated_ids_and_many_equal_rows(spark):
    rng = np.random.default_rng(8)
    near = rng.normal(size=8)
    x = [np.float32(v).tolist() for v in rng.normal(size=(300, 8))]
    rows = [(i % 100, v) for i, v in enumerate(x)] + [(0, x[7]), (0, x[7])] + [(i, x[7]) for i in range(200, 260)] + [(0, x[7])] * 30
    rows += [(i, np.float32(near + 0.02 * rng.normal(size=8)).tolist()) for i in range(400, 640)]
    found = ann.search(vectors(spark, rows).repartition(3), F.col("vec_id") % 20 == 0, k=5, block_rows=150, query_rows=7).collect()
    asked = [(i, v) for i, v in rows if i % 20 == 0]
    want = []
    for q, v in asked:
        each = sorted((-float((np.array(c) * np.array(v)).sum()), i) for i, c in rows if i != q)[:5]
        want += [(q, n + 1, i, round(-s, 9)) for n, (s, i) in enumerate(each)]
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in found]
    assert len(got) == len(want) == 5 * len(asked)
    missed = Counter(want) - Counter(got)
    assert sum(missed.values()) <= 0.02 * len(want)
    assert not [m for m in missed if m[3] == round(float((np.array(x[7]) ** 2).sum()), 9)]
