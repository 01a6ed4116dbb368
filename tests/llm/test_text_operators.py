"""Operators on documents against their definitions, with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import bpe, line_dedup, packing, secrets, sharding, shingle_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, gone int, spans string"
RANKS = bpe.load_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())


def make(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 4 else None, 0, 7, "x", 1, "y") for i, t in zip(ids, texts)], SCHEMA)


def words(rnd, n):
    return " ".join(rnd.choice(["alpha", "beta", "Gamma", "délta", "e1", "zeta,", "of", "the"]) + str(rnd.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    base = [words(rnd, rnd.choice([3, 8, 30, 80])) for _ in range(40)]
    near = [t + " tail" for t in base[:10]] + [t.replace("alpha", "other", 1) for t in base[10:20]]
    lines = ["Shared boiler plate line\n" + t + "\n  shared BOILER plate line\t\n\nshort" for t in base[:8]]
    secret = ['my password = "abcdefgh1234" and TOKEN: short, api-key', "AKIA" + "A1" * 8 + " é " + "deadbeef" * 4 + "0 token=secret=xyzxyzxyz", "secret : secret : longenough1"]
    return [None, "", " \n\t", "one", "a b c d", *base, *base[:5], *near, *lines, *secret, words(rnd, 30_000), "x" * 50_000]


def test_shards(spark, texts):
    docs = make(spark, texts + texts[:3], [*range(len(texts)), None, 3, 3])
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(texts) + 3
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16 and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    of = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i, t in enumerate(texts):
        assert of[i].size == len((t or "").encode()) + 1 and of[i].text_crc32 == zlib.crc32((t or "").encode())
    assert sharding.shard_documents(make(spark, []).limit(0)).count() == 0


def test_weights_confine_movement(spark):
    tree = {"a": {"k": {0: 1.0, 1: 2.0}, "m": {2: 1.0}}, "b": {"n": {3: 4.0}}}
    changed = {"a": {"k": {0: 2.0, 1: 1.0}, "m": {2: 1.0}}, "b": {"n": {3: 4.0}}}
    keys = spark.range(20_000)
    rows = keys.select(sharding.place(F.col("id"), tree).alias("x"), sharding.place(F.col("id"), changed).alias("y")).groupBy("x", "y").count().collect()
    assert all(r.x == r.y or {r.x, r.y} == {0, 1} for r in rows)
    share = {n: sum(r["count"] for r in rows if r.x == n) / 20_000 for n in range(4)}
    assert all(abs(share[n] - w / 8) < 0.02 for n, w in ((0, 1), (1, 2), (2, 1), (3, 4)))


def test_shards_are_those_of_a_walk_down_the_tree(spark):
    import math
    import struct

    import xxhash

    def draw(key, path, weight):
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        return -math.log(((xxhash.xxh64_intdigest(path.encode(), seed) >> 11) + 0.5) / (1 << 53)) / weight

    def walk(key, tree):
        region = min((r for r in tree), key=lambda r: draw(key, r, sum(sum(x.values()) for x in tree[r].values())))
        rack = min((k for k in tree[region]), key=lambda k: draw(key, f"{region}/{k}", sum(tree[region][k].values())))
        return min((n for n in tree[region][rack]), key=lambda n: draw(key, f"{region}/{rack}/{n}", tree[region][rack][n]))

    tree = {"a": {"k": {0: 1.0, 1: 2.5}, "m": {2: 1.0}}, "b": {"n": {3: 4.0, 4: 0.5}}}
    keys = [None, 0, -1, *range(1, 2_000, 7), 1 << 40]
    docs = make(spark, ["x"] * len(keys), keys)
    rows = sharding.shard_documents(docs, tree).select("doc_id", "shard", "grown_shard").collect()
    assert len(rows) == len(keys)
    for r in rows:
        assert (r.shard, r.grown_shard) == (walk(r.doc_id, tree), walk(r.doc_id, sharding.grow(tree)))
    assert sharding.uniform_tree(16) == {f"r{i}": {f"k{2 * i + j}": {4 * (2 * i + j) + n: 1.0 for n in range(4)} for j in range(2)} for i in range(2)}


def test_encoding_is_tiktokens(spark, texts):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    rows = bpe.encode_documents(make(spark, texts), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        want = own.encode_ordinary(text)
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="etaoin shrdluéßñ中🙂\n\t'0123!?.ABC", max_size=80), st.integers(1, 7))
def test_transducer_and_stream(text, cut):
    codec = test_transducer_and_stream.codec
    own = test_transducer_and_stream.own
    ids = codec.encode(text).tolist()
    assert ids == own.encode_ordinary(text)
    data = text.encode()
    parts = codec.transducer.stream(data[i : i + cut] for i in range(0, len(data), cut))
    assert [i for p in parts for i in p] == bpe.merge_greedily(data, RANKS)
    stream = bpe.Utf8Stream()
    assert "".join(stream.feed(data[i : i + cut]) for i in range(0, len(data), cut)) + stream.close() == text


test_transducer_and_stream.codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
test_transducer_and_stream.own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_automaton_can_be_dropped_at_any_time():
    small = bpe.Transducer(RANKS, max_moves=50, max_pairs=20)
    for text in ("internationalisation", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "zażółć gęślą jaźń"):
        assert small.encode(text.encode()) == (bpe.merge_greedily(text.encode(), RANKS) if text.encode() not in RANKS else [RANKS[text.encode()]])


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = make(spark, texts + ["İΣς 中文 <|endoftext|> x"]).repartition(3)
    rows = packing.pack_documents(docs, path).collect()
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts + ["İΣς 中文 <|endoftext|> x"])}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, ids in want.items():
        got = b"".join(r.ids for r in sorted(by_doc[i], key=lambda r: r.start))
        assert list(memoryview(got).cast("I")) == ids and all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids) for r in by_doc[i])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at & (at - 1) == 0 and at <= 4096
    assert packing.pack_documents(make(spark, ["a"]).limit(0), path).count() == 0


def poured(totals, weights, sizes):
    """Window by window what each queue has given, if tokens were a fluid: shares of the window, made up for where a queue runs dry."""
    left, given, out = [Fraction(t) for t in totals], [Fraction(0)] * len(totals), []
    for size in sizes:
        need = Fraction(size)
        while need:
            going = [q for q in range(len(totals)) if left[q]]
            whole = sum(weights[q] for q in going)
            gifts = {q: min(left[q], need * weights[q] / whole) for q in going}
            for q, gift in gifts.items():
                left[q] -= gift
                given[q] += gift
            need -= sum(gifts.values())
        out.append([float(g) for g in given])
    return out


@pytest.mark.parametrize("totals", [[10_000, 3, 50_000, 0], [4096 * 7], [1, 1, 1], [30_000, 29_999, 100, 7], [1_000 + 37 * q for q in range(100)]])
@pytest.mark.parametrize("weighted", [False, True])
def test_round_robin_keeps_the_mixture(totals, weighted):
    weights = [1 + q % 7 for q in range(len(totals))] if weighted else None
    plan, got = packing.Plan(packing.plan(totals, weights, 512)), {}
    for q, total in enumerate(totals):
        at = 0
        for start, length, sequence, offset in plan.pieces(q, 0, total):
            assert start == at and length > 0
            at += length
            got.setdefault(sequence, []).append((offset, length, q))
        assert at == total
    sizes, given, windows = [], [0] * len(totals), []
    for sequence in range(len(got)):
        at = 0
        for offset, length, q in sorted(got[sequence]):
            assert offset == at
            at += length
            given[q] += length
        sizes.append(at)
        windows.append(list(given))
    full = sum(totals) // 512
    assert sizes[:full] == [512] * full and all(s & (s - 1) == 0 and s < 512 for s in sizes[full:])
    # deficits of under two tokens, and shares are kept in units of 1/64 token a window
    for n, (have, want) in enumerate(zip(windows, poured(totals, weights or totals, sizes))):
        assert max(abs(h - w) for h, w in zip(have, want)) <= 2 + (n + 1) / 32, n


@pytest.mark.parametrize("joined", [False, True])
def test_pieces_are_the_same_where_bases_are_joined(spark, texts, joined, monkeypatch):
    monkeypatch.setattr(packing, "MAX_BROADCAST_ROWS", 0 if joined else 200_000)
    rows = packing.pack_documents(make(spark, texts).repartition(4, "doc_id"), public_tokenizers.path("word_bpe_49k.json"), weights={"s1": 3.0, "s2": 1.0}).drop("ids").collect()
    test_pieces_are_the_same_where_bases_are_joined.seen.append(sorted(map(tuple, rows), key=str))
    assert all(x == test_pieces_are_the_same_where_bases_are_joined.seen[0] for x in test_pieces_are_the_same_where_bases_are_joined.seen)


test_pieces_are_the_same_where_bases_are_joined.seen = []


def test_lines(spark, texts):
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(make(spark, texts).repartition(3), batches=3).collect()}
    assert list(make(spark, texts).columns) == [c for c in rows[0].asDict() if c not in ("n_lines", "n_dropped")]
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            first.setdefault(key(line), i)
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == i]
        assert (rows[i].text, rows[i].n_lines, rows[i].n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept)), i
    assert line_dedup.dedup_lines(make(spark, ["a"]).limit(0)).count() == 0


def test_lines_of_null_and_repeated_ids_and_later_batches(spark):
    runs = line_dedup.LineRuns(spark, 2, fanout=2)
    docs = make(spark, ["a long line here\nother", "A LONG line here\nelse", "a long line here", "a long line here"], [7, None, 7, 9])
    rows = line_dedup.dedup_lines(docs, runs, batches=1).select("doc_id", "text").collect()
    assert sorted((r.doc_id or 99, r.text) for r in rows) == [(7, "a long line here"), (7, "a long line here\nother"), (9, ""), (99, "else")]
    later = line_dedup.dedup_lines(make(spark, ["a long line here\nfresh line of text", "fresh line of text"], [1, 2]), runs, batches=2).collect()
    assert sorted((r.doc_id, r.text) for r in later) == [(1, "fresh line of text"), (2, "")]
    assert sum(spark.table(t).count() for t in runs.tables()) == 2


def test_runs_are_compacted_and_dropped(spark):
    from pathlib import Path

    runs = line_dedup.LineRuns(spark, 2, fanout=2)
    for n in range(5):
        line_dedup.dedup_lines(make(spark, [f"line of batch number {n}\nline of every batch"]), runs, batches=1).collect()
    assert [len(level) for level in runs.levels] == [1, 0, 1] and sum(spark.table(t).count() for t in runs.tables()) == 6
    names, folders = runs.tables(), [Path(p.removeprefix("file://")) for p in runs.paths.values()]
    assert len(folders) == 2 and all(f.is_dir() for f in folders)
    runs.close()
    assert not any(f.exists() for f in folders) and not any(spark.catalog.tableExists(n) for n in names)


def spans(text):
    found = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_secrets(spark, texts):
    rows = {r.doc_id: r for r in secrets.scan_documents(make(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = spans(t or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert rows[i].spans == joined and rows[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex] == [sum(k == x for k, *_ in want) for x in ("assign", "access", "hex")]
    assert sum(r.n_assign + r.n_access + r.n_hex for r in rows.values()) >= 4
    assert secrets.scan_documents(make(spark, ["a"]).limit(0)).count() == 0


def test_ledger_scans_unseen_pairs_only(spark):
    ledger = secrets.BlobLedger(spark)
    scans = lambda book: book.rows().filter("start is null")
    ledger.scan(make(spark, ["token=abcdefgh1", "token=abcdefgh1", "clean"]))
    assert scans(ledger).count() == 2 * 3 and ledger.spans().count() == 1
    ledger.scan(make(spark, ["token=abcdefgh1", "new"]))
    assert scans(ledger).count() == 3 * 3
    bumped = secrets.BlobLedger(spark, ledger.path, (secrets.BASE_RULES[0], secrets.Rule("access", 2, "AKIA[A-Z0-9]{12,}"), secrets.BASE_RULES[2]))
    bumped.scan(make(spark, ["token=abcdefgh1", "clean"]))
    assert scans(bumped).count() == 9 + 2 and scans(bumped).filter("version = 2").count() == 2


def test_many_secrets_in_a_text(spark):
    rnd = random.Random(4)
    text = " ".join(rnd.choice(["é" * rnd.randrange(90), "deadbeef" * 4, "token=abcdefgh1", "AKIA" + "B2" * 9, "password: " + "deadbeef" * 5]) for _ in range(9_000))
    docs = make(spark, [text, text[5_000:9_000], "x" * 4_096 + "token=abcdefgh1", "token=abcdefgh1" + "y" * 4_081])
    rows, clean = {r.doc_id: r for r in secrets.scan_documents(docs).collect()}, {r.doc_id: r.text for r in secrets.redact_documents(docs).collect()}
    for r in docs.collect():
        want = spans(r.text)
        assert rows[r.doc_id].spans == ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        parts, at = [], 0
        for k, s, e in want:
            if e > at:
                if s >= at:
                    parts += [r.text[at:s], f"<{k}>"]
                at = e
        assert clean[r.doc_id] == "".join(parts) + r.text[at:]


def test_redaction(spark, texts):
    docs = make(spark, texts)
    out = secrets.redact_documents(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    for i, t in enumerate(texts):
        want, at = [], 0
        for k, s, e in spans(t or ""):
            if e > at:
                if s >= at:
                    want += [t[at:s], f"<{k}>"]
                at = e
        assert got[i] == (None if t is None else "".join(want) + t[at:])


def components(texts, ids, percent=80, width=5):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, own in enumerate(ids):
        if sets[i]:
            r = find(i)
            least[r] = own if least.get(r) is None else least[r] if own is None else min(least[r], own)
    return sorted([(own if own is not None else -1, len(sets[i]), (least[find(i)] if sets[i] else own)) for i, own in enumerate(ids)], key=str)


@pytest.mark.parametrize("limit, sent", [(512, 1_000_000), (2, 1_000_000), (2, 0)])
def test_shingle_join(spark, texts, limit, sent):
    rnd = random.Random(3)
    long = words(rnd, 120).split()
    group = []
    for i in range(30):  # a group of near copies, larger than a frequent signature, some not alike to each other
        copy = list(long)
        for _ in range(rnd.randrange(4)):
            copy[rnd.randrange(len(copy))] = f"new{i}"
        group.append(" ".join(copy))
    all_ = texts + group + ["a b c d e f g h i j", "a b c d e f g h i", "A B C D", "a b c d e", "z a b c d e f g h i j"]
    ids = [*range(len(all_))]
    ids[7], ids[9] = None, 8
    rows = shingle_join.join_documents(make(spark, all_, ids).repartition(3), cell_limit=limit, most_sent=sent).collect()
    assert sorted([(r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in rows], key=str) == components(all_, ids)
    assert shingle_join.join_documents(make(spark, ["a"]).limit(0)).count() == 0


def test_every_similar_pair_shares_what_the_bands_promise():
    import numpy as np

    rnd, bands = random.Random(9), shingle_join.Bands(80)
    for size in (1, 2, 3, 4, 5, 7, 8, 9, 16, 31, 33, 64, 100, 257, 600):
        for _ in range(20):
            x = {rnd.randrange(1 << 60) for _ in range(size)}
            y = set(x)
            while True:
                z = set(y)
                if rnd.random() < 0.5 and z:
                    z.discard(rnd.choice(sorted(z)))
                else:
                    z.add(rnd.randrange(1 << 60))
                if not z or 100 * len(x & z) < 80 * len(x | z):
                    break
                y = z
                if rnd.random() < 0.02:
                    break
            sides = []
            for s in (x, y):
                s = np.array(sorted(s), np.uint64)
                sides.append({b: shingle_join.signatures(s, b, bands.segments(b), need) for b, need in bands.bands_of(len(s))})
            shared = {b: len(set(sides[0][b][0].tolist()) & set(sides[1][b][0].tolist())) for b in sides[0] if b in sides[1]}
            assert any(n > max(sides[0][b][1], sides[1][b][1]) for b, n in shared.items()), (len(x), len(y))


def test_small_similar_sets_pass_the_share_count():
    import numpy as np

    rnd, bands = random.Random(10), shingle_join.Bands(80)
    for _ in range(6000):
        x = [rnd.randrange(1 << 60) for _ in range(rnd.randrange(4, 24))]
        y = x + [rnd.randrange(1 << 60) for _ in range(rnd.randrange(len(x) // 4 + 1))]
        sides = []
        for found in (x, y):
            found = np.array(sorted(found), np.uint64)
            sides.append({b: shingle_join.signatures(found, b, bands.segments(b), need) for b, need in bands.bands_of(len(found))})
        shared = {b: len(set(sides[0][b][0].tolist()) & set(sides[1][b][0].tolist())) for b in sides[0] if b in sides[1]}
        assert any(n > max(sides[0][b][1], sides[1][b][1]) for b, n in shared.items()), (len(x), len(y))


def test_small_texts_with_one_more_word_are_linked(spark):
    import numpy as np
    import pyarrow as pa

    rnd, bands, all_ = random.Random(11), shingle_join.Bands(80), []
    while len(all_) < 8:  # texts with shingles in too few segments, few enough that no signature is frequent
        text = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(8))
        found = next(shingle_join.shingles(pa.array([text]), 5))
        [band, need] = bands.bands_of(len(found))[0]
        if len(np.unique(found)) == 4 and shingle_join.signatures(found, band, bands.segments(band), need)[1] != 0:
            more = [f"{text} m{i}" for i in range(50)]
            sets = list(shingle_join.shingles(pa.array(more), 5))
            more = [m for m, x in zip(more, sets) if len(set(shingle_join.signatures(x, band, bands.segments(band), need)[0].tolist())
                                                         & set(shingle_join.signatures(found, band, bands.segments(band), need)[0].tolist())) == 1]
            if more:
                all_ += [text, more[0]]
    ids = [*range(len(all_))]
    rows = shingle_join.join_documents(make(spark, all_, ids).repartition(3)).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in rows], key=str) == components(all_, ids)


@pytest.mark.parametrize("sent", [4_000_000, 0])
def test_null_ids_link_by_their_texts(spark, sent):
    rnd = random.Random(12)
    base = [[f"w{rnd.randrange(10**6)}" for _ in range(40)] for _ in range(3)]
    near = lambda t, *at: " ".join("new" if i in at else w for i, w in enumerate(t))
    # a null id near a document; two documents linked only through a null id; null ids alone
    all_ = [near(base[0]), near(base[0], 0), near(base[1], 0, 1), near(base[1]), near(base[1], 38, 39), near(base[2]), near(base[2], 0)]
    all_[2], all_[4] = near(base[1], *range(3)), near(base[1], 37, 38, 39)
    ids = [10, None, 20, None, 30, None, None]
    rows = shingle_join.join_documents(make(spark, all_, ids).repartition(3), most_sent=sent).collect()
    want = components(all_, ids)
    assert sum(c == 20 for _, _, c in want) == 3
    assert sorted([(r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in rows], key=str) == want


def test_many_sources_keep_their_queues_and_weights(spark):
    rnd = random.Random(14)
    rows = [(i, words(rnd, 3000 if i == 0 else 200), f"s{i}") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    path, weights = public_tokenizers.path("word_bpe_49k.json"), {f"s{i}": 31.0 if i == 0 else 1.0 for i in range(70)}
    for given in (None, weights):
        pieces = packing.pack_documents(docs, path, weights=given).collect()
        assert {(r.doc_id, r.queue) for r in pieces} == {(i, s) for i, _, s in rows}
        total = {s: sum(r.length for r in pieces if r.queue == s) for _, _, s in rows}
        share = given or total
        for s in total:
            assert abs(sum(r.length for r in pieces if r.sequence_id == 0 and r.queue == s) - 4096 * share[s] / sum(share.values())) <= 3
