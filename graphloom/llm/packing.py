"""Mixture-controlled packing of token sequences.

Each source is a queue of tokens.  Deficit round robin fills every window (a sequence of
4096 tokens) to the target proportions: each window adds a queue's quantum to its deficit,
the queue gives the whole tokens of its deficit, tokens still missing come from the queues
with the largest deficits, and what is left is carried on.  Deficits are kept in units of
1/64 token, so the gifts repeat after 64 windows or so, and the place of every token
follows from its place in its queue by arithmetic.  Where a queue runs dry the others make
up for it in the same window, and a new phase starts with the deficits they have by then
and the quanta of those that are left.  So no task follows the windows one by one:
partitions only need how much of each queue lies before them (:func:`pack_documents`), and
carry on with the same deficits.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import lean, small_arrow, small_batches, written

#: A deficit of so many units is a token; so many windows of equal quanta give whole tokens.
UNITS = 64
MAX_BROADCAST_ROWS = 200_000


def _shares(weights: np.ndarray, units: int, least: int = 0) -> np.ndarray:
    """``units`` in proportion to ``weights``, as whole numbers, at least ``least`` where a weight is."""
    exact = units * (weights / weights.sum())
    out = np.where(weights > 0, np.maximum(least, np.floor(exact)), 0).astype(np.int64)
    short = units - int(out.sum())
    if short > 0:
        out[np.lexsort((np.arange(len(out)), np.floor(exact) - exact))[:short]] += 1
    else:
        out[int(np.argmax(out))] += short
    return out


def serve(deficits: np.ndarray, quanta: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(gifts, deficits after) of a window that no queue is too short for; deficits and quanta sum to ``size`` tokens."""
    deficits = deficits + quanta
    gifts = np.maximum(deficits // UNITS, 0)
    rest = deficits - gifts * UNITS
    missing = size - int(gifts.sum())
    if missing > 0:  # to the largest rests, one token each
        most = np.lexsort((np.arange(len(rest)), -rest))
        most = most[quanta[most] > 0][:missing]
        gifts[most] += 1
        rest[most] -= UNITS
    while missing < 0:  # queues below zero got nothing, so others got too much
        q = min((q for q in range(len(rest)) if gifts[q]), key=lambda q: (rest[q], q))
        less = min(-missing, int(gifts[q]))
        gifts[q] -= less
        rest[q] += less * UNITS
        missing += less
    return gifts, rest


def serve_short(deficits: np.ndarray, weights: np.ndarray, size: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gifts, deficits after) of a window in which queues may run dry: rounds until it is full.

    A dry queue's deficit goes, and the others share what is missing by their weights.
    """
    deficits, gifts = deficits.copy(), np.zeros(len(left), np.int64)
    while (need := size - int(gifts.sum())) > 0:
        room = left - gifts
        deficits[room == 0] = 0
        units = need * UNITS - int(deficits.sum())
        if units > 0:
            deficits += _shares(np.where(room > 0, weights, 0.0), units)
        give = np.clip(deficits // UNITS, 0, room)
        missing = need - int(give.sum())
        order = np.flatnonzero(room > 0)
        order = order[np.argsort(-(deficits - give * UNITS)[order], kind="stable")].tolist()
        for q in order:
            if missing > 0 and give[q] < room[q]:
                give[q] += 1
                missing -= 1
        for q in reversed(order):
            if missing < 0:
                less = min(int(give[q]), -missing)
                give[q] -= less
                missing += less
        gifts += give
        deficits -= give * UNITS
    deficits[left == gifts] = 0
    return gifts, deficits


class Phase:
    """Windows ``first`` to ``first + n - 1`` of ``size`` tokens that the same queues fill.

    ``used``: the tokens of each queue before them.  Either ``quanta`` and the deficits at
    the start, from which the gifts are worked out when asked for, or the ``gifts`` of a
    single window.
    """

    def __init__(self, first: int, n: int, size: int, used: np.ndarray, deficits: np.ndarray | None = None, quanta: np.ndarray | None = None, gifts: np.ndarray | None = None):
        self.first, self.n, self.size, self.used, self.deficits, self.quanta, self.gifts = first, n, size, used, deficits, quanta, gifts
        self.tables: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"tables": None}

    def unrolled(self, most: int = 64 * UNITS) -> tuple[np.ndarray, np.ndarray, int | None]:
        """(tokens given before each window, tokens of earlier queues in each window, first window of the cycle).

        Windows are followed until the deficits are those before an earlier window; from
        there on they repeat.  Should they not repeat within ``most`` windows, the phase
        has no more windows than those.
        """
        if self.tables is None:
            if self.gifts is not None:
                given, start = [np.zeros_like(self.gifts), self.gifts], None
            else:
                given, deficits, start = [np.zeros_like(self.used)], self.deficits, None
                met = {deficits.tobytes(): 0}
                while start is None and len(given) <= most:
                    gifts, deficits = serve(deficits, self.quanta, self.size)
                    given.append(given[-1] + gifts)
                    start = met.get(deficits.tobytes())
                    met[deficits.tobytes()] = len(given) - 1
            table = np.stack(given)
            each = np.diff(table, axis=0)
            self.tables = table, np.cumsum(each, axis=1) - each, start
        return self.tables

    def given(self, windows: int) -> np.ndarray:
        """Tokens of each queue in the first ``windows`` windows."""
        table, _, start = self.unrolled()
        last = len(table) - 1
        if windows <= last:
            return table[windows]
        turns, rest = divmod(windows - start, last - start)
        return table[start + rest] + turns * (table[last] - table[start])

    def deficits_after(self, windows: int) -> np.ndarray:
        return self.deficits + windows * self.quanta - UNITS * self.given(windows)


def plan(totals: list[int], weights: list[float] | None = None, window: int = 4096) -> list[Phase]:
    """The phases that use up ``totals`` tokens of each queue.

    ``weights`` are the target proportions, by default those of the tokens that are left,
    with which all queues end together.  All windows are full, but that the last tokens
    (fewer than a window) make sequences whose lengths are powers of two.  Deficits are
    carried through all windows: from phase to phase too, but for those of dry queues,
    which the others make up for.
    """
    total = np.array(totals, np.int64)
    used, first, phases, deficits = np.zeros(len(total), np.int64), 0, [], np.zeros(len(total), np.int64)
    asked = None if weights is None else np.maximum(np.array(weights, float), 1e-12)
    while (tokens := int((total - used).sum())) > 0:
        left = total - used
        target = np.where(left > 0, left.astype(float) if asked is None else asked, 0.0)
        size = window if tokens >= window else 1 << (tokens.bit_length() - 1)
        deficits = np.where(left > 0, deficits, 0)
        if (lost := int(deficits.sum())) > 0:
            deficits -= _shares(target, lost)
        elif lost < 0:
            deficits += _shares(target, -lost)
        low = high = 0
        if size == window:
            phase = Phase(first, 0, size, used, deficits, _shares(target, size * UNITS, 1))
            table, _, start = phase.unrolled()
            high = tokens // size if start is not None else min(tokens // size, len(table) - 1)
        while low < high:
            middle = (low + high + 1) // 2
            if (phase.given(middle) <= left).all():
                low = middle
            else:
                high = middle - 1
        if low:
            phase.n, deficits = low, phase.deficits_after(low)
            used = used + phase.given(low)
        else:
            gifts, deficits = serve_short(deficits, target, size, left)
            phase = Phase(first, 1, size, used, gifts=gifts)
            used = used + gifts
        phase.tables = None
        phases.append(phase)
        first += phase.n
    return phases


class Plan:
    """The phases as workers use them: the tables of a few phases are kept at a time."""

    def __init__(self, phases: list[Phase], kept: int = 16):
        self.phases, self.kept = phases, kept
        self.used = np.stack([p.used for p in phases]) if phases else np.zeros((0, 0), np.int64)
        self.starts: dict[int, list[int]] = {}
        self.columns: dict[int, dict[int, tuple[list[int], list[int]]]] = {}

    def _column(self, i: int, queue: int) -> tuple[list[int], list[int]]:
        """A queue's tokens before each window of a phase, and the tokens of earlier queues in it."""
        columns = self.columns.get(i)
        if columns is None:
            if len(self.columns) >= self.kept:
                old = next(iter(self.columns))
                del self.columns[old]
                self.phases[old].tables = None
            columns = self.columns[i] = {}
        if queue not in columns:
            table, earlier, _ = self.phases[i].unrolled()
            columns[queue] = table[:, queue].tolist(), earlier[:, queue].tolist()
        return columns[queue]

    def pieces(self, queue: int, start: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset there) of a document at ``start`` of its queue."""
        at, end = start, start + length
        if queue not in self.starts:
            self.starts[queue] = self.used[:, queue].tolist()
        starts = self.starts[queue]
        i = bisect_right(starts, at) - 1
        while at < end:
            phase, (given, earlier) = self.phases[i], self._column(i, queue)
            token, base, window = at - starts[i], starts[i], 0
            if token >= given[-1]:  # past the table: whole cycles before
                cycle = phase.unrolled()[2]
                each = given[-1] - given[cycle] if cycle is not None else 0
                if not each:
                    i += 1
                    continue
                turns, rest = divmod(token - given[cycle], each)
                token, base, window = given[cycle] + rest, base + turns * each, turns * (len(given) - 1 - cycle)
            row = bisect_right(given, token) - 1
            window += row
            if window >= phase.n:
                i += 1
                continue
            begin, stop = base + given[row], min(end, base + given[row + 1])
            yield at - start, stop - at, phase.first + window, earlier[row] + at - begin
            at = stop


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 stands for itself, the rest is numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokens:
    """Ids of texts by a tokenizer that lower-cases, drops white space and never joins words.

    Texts within Latin-1, where composing and lower-casing go letter by letter, are split
    here into the tokenizer's words, and each word's ids come from its merges; all other
    texts, and those with special strings, are given to the tokenizer in parts between
    ASCII white space.  Ids are looked up in two generations, so memory is bounded.
    """

    #: The tokenizer's split of lower-cased text, with the classes' members below U+0100.
    LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|"
                       "[^\\t-\\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")

    def __init__(self, definition: str, generation: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        merges, letters = self.tokenizer.model.tokenize, _byte_letters()

        class Known(dict):
            old: dict = {}

            def __missing__(self, key):
                ids = self.old.get(key)
                if ids is None:
                    ids = self.find(key)
                if len(key) <= 64:
                    if len(self) >= generation:
                        self.old = dict(self)
                        self.clear()
                    self[key] = ids
                return ids

        def word(piece: str) -> bytes:
            found = merges(piece if piece.isascii() and piece.isprintable() else piece.encode("utf-8").decode("latin-1").translate(letters))
            return pack(f"<{len(found)}I", *[t.id for t in found])

        def part(piece: bytes) -> bytes:
            found = self.tokenizer.encode(piece.decode("utf-8"), add_special_tokens=False).ids
            return pack(f"<{len(found)}I", *found)

        self.words, self.parts = Known(), Known()
        self.words.find, self.parts.find = word, part

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if _is_latin(text) and not any(s in text for s in self.special):
            return b"".join(map(self.words.__getitem__, self.LATIN.findall(text.lower())))
        return b"".join(map(self.parts.__getitem__, text.encode("utf-8").split()))


#: The tokenizer of this Python worker: later tasks find the words.
_tokenizers: dict[int, WordTokens] = {}


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = 4096,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Pack all ``docs`` (doc_id, text, source) into sequences of at most ``window`` tokens.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, queue, ids (binary, little-endian unsigned 32-bit).

    A null or empty text is the end id alone.  A null source is the queue ''.  Rows are
    packed each by itself, so repeated doc_ids and null ids are kept (their pieces are
    told apart by their sequences).  An empty table gives no pieces.  Other columns are
    not read.  Every source has a queue of its own, however many there are, and ``weights``
    are by source (others: next to nothing, until all named ones are used up); the driver
    makes the plan from one total a source.

    One pass makes the ids and writes them with each document's place among its queue's
    tokens in its partition; then partitions get the tokens before them, and every
    partition cuts its own documents.  A source with a third of all rows is no single
    task's: queues are split by partition.
    """
    spark = docs.sparkSession
    small_arrow(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    key, shipped = zlib.crc32(definition.encode()), spark.sparkContext.broadcast(definition)
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    end = end_id.to_bytes(4, "little")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _tokenizers:
            _tokenizers.clear()
            _tokenizers[key] = WordTokens(shipped.value)
        encode, part, seen = _tokenizers[key].encode, TaskContext.get().partitionId(), {}
        for batch in small_batches(batches):
            ids, starts = [], []
            queues = batch.column(2).to_pylist()
            for text, queue in zip(batch.column(1).to_pylist(), queues):
                ids.append(encode(text or "") + end)
                starts.append(seen.get(queue, 0))
                seen[queue] = starts[-1] + len(ids[-1]) // 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()),
                 pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "queue", "part", "begin", "doc_tokens", "ids"])

    coded = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), source.alias("queue"))
        .mapInArrow(lean(tokens), "doc_id long, queue string, part int, begin long, doc_tokens long, ids binary"), "packing")
    parts = coded.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("tokens"))
    totals = {r.queue: r.tokens for r in parts.groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect()}
    names = sorted(totals)
    phases = spark.sparkContext.broadcast(plan([totals[n] for n in names], [weights.get(n, 0.0) for n in names] if weights else None, window))
    numbers = {n: i for i, n in enumerate(names)}
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(parts.select("queue", "part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base")), "packing-bases")
    if bases.count() <= MAX_BROADCAST_ROWS:  # a row for each queue and partition; else the ids are shuffled
        bases = F.broadcast(bases)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Plan(phases.value)
        for batch in small_batches(batches):
            rows = []
            for doc, queue, begin, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                for start, length, sequence, offset in own.pieces(numbers[queue], begin, n):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(part), n, sequence, offset, queue, part))
            columns = list(zip(*rows)) or [[]] * 9
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 7, pa.string(), pa.binary()])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "ids"])

    return (
        coded.join(bases, ["queue", "part"])
        .select("doc_id", "queue", (F.col("begin") + F.col("base")).alias("begin"), "doc_tokens", "ids")
        .mapInArrow(lean(cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string, ids binary")
    )
