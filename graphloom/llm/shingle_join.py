"""Jaccard self-join of texts' word shingles by universe partition and the pigeonhole.

Two sets of sizes a >= b with a Jaccard similarity of at least t differ in at most
``(1 - t) / (1 + t) * (a + b)`` shingles.  The universe is cut into more segments than that
by a hash; sets that differ in fewer shingles than there are segments agree in some
segment.  Sizes form bands in which the larger is under twice the smaller; a band has its
own cut.  A set is indexed in its band and probes it, and probes the band below if smaller
partners may lie there.

A segment can be given one of three weights in the sum that must exceed the number of
differences: nothing, one (the subset itself is the signature) or two (the subsets with one
shingle less are signatures too, which meet if the segment differs by one shingle).  Costs
decide: a segment without shingles would meet everything and gets nothing; others get one
at one signature each; where too few are left, the sets' smallest segments, cheapest in
neighbours, of a few set aside get two.  The number of segments has room for that.

A set has more signatures than it needs, and a similar partner shares all that it could do
without, and one more: pairs that share fewer are dropped before any comparison.  Small sets
whose shingles fall into too few segments sign the empty ones too.  A partner that has
enough without does not, so these signatures are no part of what must be shared: such sets
could do without less than none, and any shared signature makes a pair.  A
signature that many sets share is not counted, and costs nothing to sets that have enough
others: if either set of a pair does, the pair shares one of these.  Only sets that depend
on frequent signatures (as those of a large group of near copies do) are compared within
them.

Sets that share signatures, directly or by others, form a cell.  A cell's sets are brought
together once and linked there exactly; in cells too large for a task, sizes and
parity bits rule out most pairs and the rest is compared step by step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.buckets import across_blocks, labelled
from graphloom.llm.common import apart, discard, lean, shuffle_partitions, small_arrow, stored_bytes, written
from graphloom.llm.graph import components, joined_up
from graphloom.llm.textscan import SPACE, mixed, slices

#: Segments with one-deletion neighbours, the last of each band's cut.
FLEXIBLE = 2
#: A signature of more sets than this is frequent.
FREQUENT = 16


def shingles(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles."""
    for piece in slices(texts):
        starts, ends, text = piece.words(~SPACE)
        words = piece.hashes().of(starts, ends)
        counts = np.bincount(text, minlength=piece.n)
        first = np.concatenate([[0], np.cumsum(counts)])
        rolled = np.zeros(max(len(words) - width + 1, 0), np.uint64)
        for i in range(width):
            rolled += mixed(words[i : i + len(rolled)] + np.uint64(i + 1))
        rolled = mixed(rolled)
        for n in range(piece.n):
            if counts[n] >= width:
                yield np.unique(rolled[first[n] : first[n + 1] - width + 1])
            elif counts[n]:
                few, total = words[first[n] : first[n + 1]], np.uint64(counts[n])
                for i, w in enumerate(few):
                    total = mixed(np.array([total ^ mixed(np.array([w + np.uint64(i + 1)]))[0]]))[0]
                yield np.array([total])
            else:
                yield np.zeros(0, np.uint64)


class Bands:
    """Bands of sizes and their cuts, for a similarity of ``percent`` hundredths."""

    def __init__(self, percent: int):
        self.percent = percent

    def differences(self, a: int, b: int) -> int:
        """The most shingles that similar sets of these sizes differ in."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def segments(self, band: int) -> int:
        """Segments of a band's cut: what the largest sets need, and a fifth more."""
        small = (2 << band) - 1
        return (self.differences(small, small * 100 // self.percent) + 1) * 6 // 5 + 2

    def bands_of(self, size: int) -> list[tuple[int, int]]:
        """(band, weight needed) for each band where partners lie: the own one, and that below for smaller ones."""
        own = size.bit_length() - 1
        found = [(own, self.differences(size, size * 100 // self.percent) + 1)]
        below = (1 << own) - 1
        if own and 100 * below >= self.percent * size:
            found.append((own - 1, self.differences(size, below) + 1))
        return found


def signatures(found: np.ndarray, band: int, segments: int, need: int) -> tuple[np.ndarray, int]:
    """A set's signatures in a band's cut, and how many of those of its own shingles it could do without (below zero if it needs more)."""
    segment = ((mixed(found ^ np.uint64(band + 1)) >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    count = np.bincount(segment, minlength=segments)
    value = mixed(found + np.uint64(0x51ED270B0F1C5A11))
    running = np.zeros(len(found) + 1, np.uint64)
    np.cumsum(value[np.argsort(segment, kind="stable")], out=running[1:])
    ends = np.cumsum(count)
    sums = running[ends] - running[ends - count]
    name = mixed(np.arange(segments, dtype=np.uint64) + np.uint64(band << 40))
    full = count > 0
    out, weight = [mixed(sums[full] + name[full])], int(full.sum())
    for s in range(max(segments - FLEXIBLE, 0), segments):
        if count[s] >= 2:
            out.append(mixed(sums[s] - value[segment == s] + name[s]))
            weight += 1
    if weight < need:
        out.append(mixed(name[~full]))
    return np.concatenate(out), weight - need


def _class_of(found: np.ndarray) -> int:
    """A 63-bit number of a set: equal sets have equal ones."""
    return int(mixed(np.array([np.add.reduce(mixed(found ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64)]))[0] >> np.uint64(1))


def _docs(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)


def _sizes(docs: DataFrame, width: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size and class of every text's set, and the string columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), _class_of(s)) for s in shingles(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (zip(*sets) if sets else ([], []))), *batch.columns[2:]], ["doc_id", "size", "class", *keep])

    return docs.mapInArrow(lean(run), "doc_id long, size long, class long" + "".join(f", {k} string" for k in keep))


def _signed(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """bucket, id (the set's class) and meta (band and spare) for each signature; a task signs equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        signed, ids, metas = [], [], []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (signed, ids, metas)], ["bucket", "id", "meta"])

        for batch in batches:
            for found in shingles(batch.column(1), width):
                if not len(found) or (own := _class_of(found)) in seen:
                    continue
                seen.add(own)
                for band, need in bands.bands_of(len(found)):
                    values, spare = signatures(found, band, bands.segments(band), need)
                    signed.append(values.view(np.int64))
                    ids.append(np.full(len(values), own, np.int64))
                    metas.append(np.full(len(values), spare << 6 | band, np.int32))
                if sum(map(len, signed[-64:])) > 50_000 or len(signed) > 512:
                    yield rows()
                    signed, ids, metas = [], [], []
        if signed:
            yield rows()

    return docs.mapInArrow(lean(run), "bucket long, id long, meta int")


def _counted(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (a, b, band, spare of a, spare of b, n) with those of the same pair and band added up."""
    a, b, band, spare_a, spare_b, n = rows
    order = np.lexsort((band, b, a))
    a, b, band, spare_a, spare_b, n = (x[order] for x in rows)
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(band) != 0)
    at = np.flatnonzero(new)
    return [a[at], b[at], band[at], spare_a[at], spare_b[at], np.add.reduceat(n, at) if len(at) else n]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket and id: the pairs that meet in rare buckets, with how often,
    and the rows of frequent ones (hot; a is the bucket, b the id, centre its smallest id, n 0).

    Holds a batch, the last bucket's rows if they are few, and a bounded number of pairs.
    """
    held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32)]
    going: tuple[int, int, int] | None = None  # bucket, smallest and last id of a frequent bucket that goes on
    pairs: list[list[np.ndarray]] = []
    waiting = 0

    def emit(rows, hot):
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64()))), pa.array(np.full(len(rows[0]), hot))],
                                          ["a", "b", "band", "spare_a", "spare_b", "n", "centre", "hot"])

    def emit_pairs(rows):
        return emit([*rows, np.zeros(len(rows[0]), np.int64)], False)

    def emit_hot(bucket, ids, meta, centre):
        return emit([bucket, ids, meta & 63, meta >> 6, meta >> 6, np.zeros(len(ids), np.int32), centre], True)

    def work(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, going, pairs, waiting
        bucket, ids, meta = held
        if going and len(bucket):
            run = int(np.searchsorted(bucket, going[0], "right"))
            if run:
                fresh = np.diff(ids[:run], prepend=going[2]) != 0
                yield emit_hot(bucket[:run][fresh], ids[:run][fresh], meta[:run][fresh], np.full(int(fresh.sum()), going[1]))
                going = (*going[:2], int(ids[run - 1]))
                bucket, ids, meta = bucket[run:], ids[run:], meta[run:]
            if len(bucket):
                going = None
        if len(bucket):
            fresh = np.ones(len(bucket), bool)
            fresh[1:] = (np.diff(bucket) != 0) | (np.diff(ids) != 0)
            bucket, ids, meta = bucket[fresh], ids[fresh], meta[fresh]
            starts = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0]))
            sizes = np.diff(np.append(starts, len(bucket)))
            keep = len(bucket)
            if not last:
                if sizes[-1] > FREQUENT:
                    going = (int(bucket[-1]), int(ids[starts[-1]]), int(ids[-1]))
                else:
                    keep = int(starts[-1])
                    starts, sizes = starts[:-1], sizes[:-1]
            hot = np.repeat(sizes > FREQUENT, sizes)
            if hot.any():
                centre = np.repeat(ids[starts], sizes)
                yield emit_hot(bucket[:keep][hot], ids[:keep][hot], meta[:keep][hot], centre[hot])
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for size in np.unique(sizes[(sizes > 1) & (sizes <= FREQUENT)]).tolist():
                i, j = np.triu_indices(size, 1)
                first = starts[sizes == size][:, None]
                left.append((first + i).ravel())
                right.append((first + j).ravel())
            x, y = np.concatenate(left), np.concatenate(right)
            if len(x):
                pairs.append([ids[x], ids[y], meta[x] & 63, meta[x] >> 6, meta[y] >> 6, np.ones(len(x), np.int32)])
                waiting += len(x)
            bucket, ids, meta = (c[keep:].copy() for c in (bucket, ids, meta))
        held = [bucket, ids, meta]
        if waiting > 250_000:
            merged = _counted([np.concatenate(c) for c in zip(*pairs)])
            if len(merged[0]) > 125_000:
                yield emit_pairs(merged)
                merged = [c[:0] for c in merged]
            pairs, waiting = [merged], len(merged[0])

    coming: list[pa.RecordBatch] = []
    for batch in batches:
        coming.append(batch)
        if sum(b.num_rows for b in coming) >= 50_000:
            held = [np.concatenate([h, *(b.column(i).to_numpy() for b in coming)]) for i, h in enumerate(held)]
            coming = []
            yield from work(False)
    held = [np.concatenate([h, *(b.column(i).to_numpy() for b in coming)]) for i, h in enumerate(held)]
    yield from work(True)
    if pairs:
        yield emit_pairs(_counted([np.concatenate(c) for c in zip(*pairs)]))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def link_cell(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the number of the first one that links reach; pairs already joined are not compared."""
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            a, b = find(i), find(j)
            if a != b and similar(sets[i], sets[j], percent):
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def join_documents(docs: DataFrame, percent: int = 80, width: int = 5, cell_limit: int = 512, most_sent: int = 1_000_000) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id.

    Words are runs of bytes other than ``[\\x20\\x09-\\x0D]``, A-Z lower-cased.  A text's
    set: its distinct shingles of ``width`` words; with fewer words, all of them as one;
    without words (or null): empty, linked with nothing, component_id its own doc_id.  Two
    texts link if their intersection is at least ``percent`` hundredths of their union;
    component_id is the smallest doc_id that links reach.  Shingles are compared by 64-bit
    hashes, equal sets by 63-bit ones.

    Rows of one doc_id each count by their text; a null doc_id is never the smallest, and
    a group of such rows only has a null component_id.  An empty table gives no rows.
    Other columns are not read.

    Equal sets are one class, however many there are, and never make pairs.  Tables of up
    to ``most_sent`` numbers are broadcast after they have been counted, larger ones joined.
    """
    labels = group_documents(docs, percent, width, cell_limit, most_sent)
    named = labels.filter("label is not null")
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = apart(named, "label").join(apart(least, "label"), ["label", "apart"])
    return linked.select("doc_id", F.col("size").alias("n_shingles"), "component_id").unionAll(labels.filter("label is null").select("doc_id", "size", "doc_id"))


def group_documents(docs: DataFrame, percent: int = 80, width: int = 5, cell_limit: int = 512, most_sent: int = 1_000_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of ``docs``: doc_id, size of its set, label, and the string columns ``keep``.

    Links are those of :func:`join_documents`; rows that links reach have the same label,
    whatever their ids.  A text without words has no label.
    """
    small_arrow(docs.sparkSession)
    bands = Bands(percent)
    sized = written(_sizes(_docs(docs, keep), width, keep), "shingle-sizes")
    placed = _components(_docs(docs), sized, bands, width, cell_limit, most_sent)
    worded = sized.filter("size > 0").join(placed.withColumnRenamed("id", "class"), "class", "left").select("doc_id", "size", F.coalesce("component", "class").alias("label"), *keep)
    found = written(worded.unionAll(sized.filter("size = 0").select("doc_id", "size", F.lit(None).cast("long"), *keep)), "shingle-labels")
    discard(sized, placed)
    return found


def _components(texts: DataFrame, sized: DataFrame, bands: Bands, width: int, cell_limit: int, most_sent: int, cell_bytes: int = 16 << 20) -> DataFrame:
    """(id, component) of the classes that are linked with others; a written table."""
    spark = texts.sparkSession
    signed = _signed(texts, width, bands)
    runs = written(signed.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "id")
                   .mapInArrow(lean(_runs), "a long, b long, band int, spare_a int, spare_b int, n int, centre long, hot boolean"), "shingle-runs", "hot")
    hot = runs.filter("hot").select(F.col("a").alias("bucket"), F.col("b").alias("id"), "centre", "band", F.col("spare_a").alias("spare"))
    frequent = written(hot.groupBy("id", "band").agg(F.count("*").alias("lost"), F.max("spare").alias("spare")), "shingle-frequent", size=stored_bytes(runs))
    # of a set's signatures its similar partners share more than it could do without; less those among the frequent
    pairs = runs.filter("not hot").groupBy("a", "b", "band").agg(F.sum("n").alias("n"), F.max("spare_a").alias("spare_a"), F.max("spare_b").alias("spare_b"))
    for side in ("a", "b"):
        pairs = pairs.join(frequent.select(F.col("id").alias(side), "band", F.col("lost").alias(f"lost_{side}")), [side, "band"], "left")
    shares = lambda side: F.col(f"spare_{side}") - F.coalesce(f"lost_{side}", F.lit(0))
    pairs = pairs.filter(F.col("n") > F.greatest(shares("a"), shares("b"))).select("a", "b")
    hot = written(_needing(hot, frequent.filter("lost > spare").select("id", "band"), most_sent), "shingle-hot")
    edges = written(pairs.unionAll(hot.filter("centre < id").select("centre", "id")).distinct(), "shingle-edges", size=stored_bytes(runs))
    discard(runs, frequent)
    linked = components(edges, size=stored_bytes(edges))
    classes = sized.filter("size > 0").groupBy(F.col("class").alias("id")).agg(F.min("doc_id").alias("doc_id"), F.any_value("size").alias("size"))
    members = written(linked.join(classes, "id"), "shingle-members", size=stored_bytes(linked, sized))
    weights = members.groupBy("component").agg(F.count("*").alias("members"), (8 * F.sum("size")).alias("bytes"))
    cells = written(apart(members, "component").join(apart(weights, "component"), ["component", "apart"]).drop("apart").withColumn(
        "large", (F.col("members") > cell_limit) | (F.col("bytes") > cell_bytes)), "shingle-cells", size=stored_bytes(members))
    discard(linked, members)
    total, size = cells.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not total:
        return cells.select("id", "component")
    # classes of null ids only are told by their sets
    named, unnamed = cells.filter("doc_id is not null").select("doc_id"), cells.filter("doc_id is null").select("id")
    if total <= most_sent:  # 8 bytes each
        sent = spark.sparkContext.broadcast(tuple(np.sort(rows.toArrow().column(0).to_numpy()) for rows in (named, unnamed)))
        wanted = texts
    else:
        sent, wanted = None, texts.join(named, "doc_id", "left_semi").select("doc_id", "text")
        if not unnamed.isEmpty():
            wanted = wanted.unionAll(texts.filter("doc_id is null"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        ids, sets = [], []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "shingles"])

        for batch in batches:
            text, null = batch.column(1), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            unnamed = None
            if sent is not None:
                named, unnamed = sent.value
                keep = np.where(null, len(unnamed) > 0, np.isin(batch.column(0).fill_null(0).to_numpy(), named))
                text, null = text.filter(pa.array(keep)), null[keep]
            for found, nameless in zip(shingles(text, width), null.tolist()):
                if not len(found) or (own := _class_of(found)) in seen:
                    continue
                if not nameless or unnamed is None or unnamed[min(np.searchsorted(unnamed, own), len(unnamed) - 1)] == own:
                    seen.add(own)
                    ids.append(own)
                    sets.append(found.tobytes())
                    if len(ids) >= 256 or sum(map(len, sets[-16:])) > 1 << 20:
                        yield rows()
                        ids, sets = [], []
        yield rows()

    sets = written(wanted.mapInArrow(lean(collect), "id long, shingles binary").join(cells.select("id", "component", "large"), "id"), "shingle-sets")
    lots = max(64, 8 * size // (4 << 20))
    percent = bands.percent

    def settle(table):
        """The cells of a lot: some megabytes of sets, and at most one cell's more."""
        ids, owner = table.column("id").to_numpy(), table.column("component").to_numpy()
        raw = table.column("shingles")
        order = np.lexsort((ids, owner))
        out = np.empty(len(ids), np.int64)
        cuts = np.flatnonzero(np.diff(owner[order], prepend=owner[order][0] - 1, append=owner[order][-1] + 1))
        for a, b in zip(cuts, cuts[1:]):
            members = order[a:b]
            first = members[np.concatenate([[True], np.diff(ids[members]) != 0])]
            roots = link_cell([np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in first], percent)
            of = dict(zip(ids[first].tolist(), [int(ids[first[r]]) for r in roots]))
            out[members] = [of[i] for i in ids[members].tolist()]
        return pa.table({"id": ids, "component": out})

    small = sets.filter("not large").withColumn("lot", F.pmod(F.xxhash64("component"), F.lit(lots)))
    settled = small.groupBy("lot").applyInArrow(settle, "id long, component long").distinct()
    large = sets.filter("large")
    if large.isEmpty():
        found = written(settled, "shingle-components", size=stored_bytes(cells))
        discard(sets, cells, edges, hot)
        return found

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    large = written(large.groupBy("id").agg(F.any_value("shingles").alias("shingles")), "shingle-large", size=stored_bytes(sets))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(large.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(large.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(lean(compare), "a long, b long")

    inside = written(edges.join(cells.filter("large").select(F.col("id").alias("a")), "a", "left_semi"), "shingle-edges", size=stored_bytes(edges))
    rest = _settle_large(inside, hot, large, verify, percent, most_sent)
    found = written(settled.unionAll(rest), "shingle-components", size=stored_bytes(cells, rest))
    discard(sets, cells, edges, inside, hot, large, rest)
    return found


def _needing(hot: DataFrame, needy: DataFrame, most_sent: int) -> DataFrame:
    """The rows of ``hot`` (bucket, id, centre, band) whose id and band are among ``needy``."""
    if needy.count() > most_sent:
        return hot.join(needy, ["id", "band"], "left_semi").select("bucket", "id", "centre")
    name = lambda ids, bands: mixed(ids.view(np.uint64) + bands.astype(np.uint64))  # noqa: E731  a clash only keeps a row more
    table = needy.toArrow()
    sent = needy.sparkSession.sparkContext.broadcast(np.sort(name(table.column("id").to_numpy(), table.column("band").to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(np.isin(name(batch.column(1).to_numpy(), batch.column(3).to_numpy()), sent.value))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(3)], ["bucket", "id", "centre"])

    return hot.select("bucket", "id", "centre", "band").mapInArrow(lean(run), "bucket long, id long, centre long")


def _labelled(rows: DataFrame, names: list[str], placed: DataFrame, most_sent: int) -> DataFrame:
    """``rows`` (longs only) with the component of each of the id columns ``names``, as c_name; an id without one is its own."""
    if placed.count() > most_sent:
        return labelled(rows, names, placed)
    table = placed.orderBy("id").toArrow()
    sent = rows.sparkSession.sparkContext.broadcast((table.column("id").to_numpy(), table.column("component").to_numpy()))
    fields = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, component = sent.value
        for batch in batches:
            out = []
            for n in names:
                own = batch.column(fields.index(n)).to_numpy()
                at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                out.append(pa.array(np.where(known[at] == own, component[at], own) if len(known) else own))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*fields, *(f"c_{n}" for n in names)])

    return rows.mapInArrow(lean(run), ", ".join(f"{c} long" for c in [*fields, *(f"c_{n}" for n in names)]))


def _sketched(rows: DataFrame, buckets: DataFrame, sketch: DataFrame, most_sent: int) -> DataFrame:
    """The rows (bucket, id, c_id) of ``buckets`` with their id's sketch, if it has one."""
    if buckets.count() > 8 * most_sent or sketch.count() > most_sent:
        return rows.join(buckets, "bucket", "left_semi").join(sketch, "id").select("bucket", "id", "c_id", *sketch.columns[1:])
    table = sketch.orderBy("id").toArrow()
    sent = rows.sparkSession.sparkContext.broadcast((np.sort(buckets.toArrow().column(0).to_numpy()), *(c.to_numpy() for c in table.columns)))
    names = sketch.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, ids, *columns = sent.value
        for batch in batches:
            own = batch.column(1).to_numpy()
            at = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
            keep = np.isin(batch.column(0).to_numpy(), wanted) & ((ids[at] == own) if len(ids) else np.zeros(len(own), bool))
            yield pa.RecordBatch.from_arrays([*(c.filter(pa.array(keep)) for c in batch.columns), *(pa.array(c[at[keep]]) for c in columns)], ["bucket", "id", "c_id", *names])

    return rows.select("bucket", "id", "c_id").mapInArrow(lean(run), "bucket long, id long, c_id long, " + ", ".join(f"{n} long" for n in names))


def parities(found: np.ndarray) -> bytes:
    """512 bits: for each the parity of the shingles hashed to it.  Two sets' bits differ in at most as many as their shingles."""
    counts = np.bincount((mixed(found ^ np.uint64(0x0F0F)) >> np.uint64(55)).astype(np.int64), minlength=512)
    return np.packbits(counts.astype(np.uint8) & 1).tobytes()


def _settle_large(edges: DataFrame, hot: DataFrame, large: DataFrame, verify, percent: int, most_sent: int) -> DataFrame:
    """(id, component) within cells too large for a task; a written table.

    Sizes and parity bits rule out the pairs that differ in too many shingles, so that sets
    which share a passage only are not fetched.  Of the candidate edges left, one per set
    is verified first, then those whose ends are still apart, then the members of frequent
    buckets across components: these are compared by their bits in blocks within tasks, and
    only the pairs that the bits leave are written.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            words = np.frombuffer(b"".join(parities(x) for x in sets), np.int64).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(8))],
                                             ["id", "size", *(f"w{i}" for i in range(8))])

    sketch = written(large.select("id", "shingles").mapInArrow(lean(bits), "id long, size long, " + ", ".join(f"w{i} long" for i in range(8))), "shingle-bits")

    def possible(x: str, y: str):
        size = lambda s: F.col(f"{s}.size")
        differing = sum(F.bit_count(F.col(f"{x}.w{i}").bitwiseXOR(F.col(f"{y}.w{i}"))) for i in range(8))
        fits = 100 * F.least(size(x), size(y)) >= percent * F.greatest(size(x), size(y))
        return fits & (differing * (100 + percent) <= (100 - percent) * (size(x) + size(y)))

    def compare(rest: pa.Table, every: pa.Table) -> pa.Table:
        (ids, mine, size, words), (others, theirs, sizes, their_words) = (
            (*(t.column(c).to_numpy() for c in ("id", "component", "size")), np.stack([t.column(f"w{i}").to_numpy() for i in range(8)], axis=1)) for t in (rest, every))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(ids), 64):
            part = slice(at, at + 64)
            both = size[part, None] + sizes[None, :]
            may = (mine[part, None] != theirs[None, :]) & (100 * np.minimum(size[part, None], sizes[None, :]) >= percent * np.maximum(size[part, None], sizes[None, :]))
            differing = np.bitwise_count(words[part, None, :] ^ their_words[None, :, :]).sum(axis=2, dtype=np.int64)
            i, j = np.nonzero(may & (differing * (100 + percent) <= (100 - percent) * both))
            a.append(np.minimum(ids[at + i], others[j]))
            b.append(np.maximum(ids[at + i], others[j]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    near = edges.join(sketch.alias("x"), F.col("a") == F.col("x.id")).join(sketch.alias("y"), F.col("b") == F.col("y.id"))
    near = written(near.filter(possible("x", "y")).select("a", "b"), "shingle-possible")
    links = written(verify(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")), "links")
    placed = components(links, size=stored_bytes(links))
    discard(links)

    def add(pairs: DataFrame) -> None:
        nonlocal placed
        more = written(verify(pairs), "links")
        if not more.isEmpty():
            placed = joined_up(placed, more)
        discard(more)

    add(_labelled(near, ["a", "b"], placed, most_sent).filter("c_a <> c_b").select("a", "b"))
    # written, as a task with two Python steps has two workers, and Spark keeps both for all tasks to come
    members = written(_labelled(hot.select("bucket", "id"), ["id"], placed, most_sent), "hot-members")
    torn = written(members.groupBy("bucket").agg(F.min("c_id").alias("low"), F.max("c_id").alias("high")).filter("low < high").select("bucket"), "torn-buckets", size=stored_bytes(hot))
    marked = written(_sketched(members, torn, sketch, most_sent // 8), "torn")
    if not marked.isEmpty():
        add(across_blocks(marked.withColumnRenamed("c_id", "component"), compare, "a long, b long").distinct())
    discard(near, members, torn, marked, sketch)
    return placed
