"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

Every prefix of a piece has exactly one encoding, and a row of tokens is that encoding
exactly if each pair of neighbours is the encoding of its own bytes.  So the transducer
keeps each place from which a token may still extend over the bytes read, with the last
token before it; on a byte it extends these, and exactly one of them closes a token at the
new place, which the move records.  Going back along the records from every kept place
gives the tokens on which all agree; those are emitted, so the lookahead is bounded by the
longest token.  The kept places are the state; states and moves are made when first met,
and kept within a bound.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import lean, small_arrow


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a .tiktoken file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge_greedily(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: join the neighbours of lowest rank, leftmost first, until none is known."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes pieces; ``max_moves`` bounds what is kept of the automaton."""

    def __init__(self, ranks: dict[bytes, int], max_moves: int = 900_000, max_pairs: int = 500_000):
        self.ranks, self.max_moves, self.max_pairs = ranks, max_moves, max_pairs
        self.spelled = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.beginnings = {token[:n] for token in ranks for n in range(1, len(token) + 1)}
        self.longest = max(map(len, ranks))
        self.pairs: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: ((last token up to a place, or -1; bytes read since), ...), earliest place first
        first = ((-1, b""),)
        self.numbers, self.states = {first: 0}, [first]
        self.moves: dict[int, int] = {}  # state << 8 | byte -> next state << 24 | token closed at the new place

    def _follows(self, left: int, right: int) -> bool:
        known = self.pairs.get(left << 24 | right)
        if known is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            ids = [right] if left < 0 else [left, right]
            known = merge_greedily(b"".join(self.spelled[i] for i in ids), self.ranks) == ids
            self.pairs[left << 24 | right] = known
        return known

    def _move(self, number: int, byte: int) -> int:
        kept, closed = [], None
        for last, read in self.states[number]:
            read += bytes((byte,))
            if read in self.beginnings:
                kept.append((last, read))
                if closed is None:
                    token = self.ranks.get(read)
                    if token is not None and self._follows(last, token):
                        closed = token
        if closed is None:
            raise ValueError("the ranks give some bytes no encoding")
        state = (*kept, (closed, b""))
        to = self.numbers.get(state)
        if to is None:
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
        move = self.moves[number << 8 | byte] = to << 24 | closed
        return move

    def _back(self, closing: list[int], place: int) -> list[int]:
        """The tokens up to ``place``, last first."""
        ids = []
        while place:
            ids.append(closing[place - 1])
            place -= self.lengths[ids[-1]]
        return ids

    def stream(self, blocks: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of one piece that comes in blocks; those that can't change any more are emitted."""
        at, closing, before = 0, [], 0
        for block in blocks:
            if len(self.moves) > self.max_moves:
                state = self.states[at]
                self._reset()
                at = self.numbers.setdefault(state, len(self.states))
                if at == len(self.states):
                    self.states.append(state)
            moves = self.moves
            for byte in block:
                move = moves.get(at << 8 | byte)
                if move is None:
                    move = self._move(at, byte)
                at = move >> 24
                closing.append(move & 0xFFFFFF)
            places = [len(closing) - len(read) for _, read in self.states[at]]
            if places[0] > self.longest:
                chains = [self._back(closing, p)[::-1] for p in places]
                done = 0
                while all(len(c) > done and c[done] == chains[0][done] for c in chains):
                    done += 1
                if done:
                    yield chains[0][:done]
                    del closing[: sum(self.lengths[i] for i in chains[0][:done])]
        if closing:
            yield self._back(closing, len(closing))[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 512 or len(self.moves) > self.max_moves:
            return [i for part in self.stream(piece[k : k + 4096] for k in range(0, len(piece), 4096)) for i in part]
        at, closing, known = 0, [], self.moves.get
        for byte in piece:
            move = known(at << 8 | byte)
            if move is None:
                move = self._move(at, byte)
            at = move >> 24
            closing.append(move & 0xFFFFFF)
        ids = self._back(closing, len(closing))
        ids.reverse()
        return ids


class Utf8Stream:
    """Incremental UTF-8: bytes in blocks of any cut, whole characters out.

    The state is the head of a character whose rest has not come yet (at most 3 bytes).
    Bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self) -> None:
        self.head = b""

    def feed(self, block: bytes) -> str:
        block = self.head + block
        cut = len(block)
        for back in range(1, min(3, cut) + 1):
            byte = block[cut - back]
            if byte & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= byte <= 0xDF else 3 if byte & 0xF0 == 0xE0 else 4 if 0xF0 <= byte <= 0xF4 else 1
            cut -= back if need > back else 0
            break
        self.head = block[cut:]
        return block[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.head = self.head, b""
        return rest.decode("utf-8", "replace")


def ascii_split(pattern: str):
    """``pattern`` for texts of ASCII only, where letters and digits are plain ranges; else None."""
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    return None if r"\p" in plain else re.compile(plain, re.ASCII).findall


class Codec:
    """Texts to ids and back.

    Pieces met before are looked up in two generations: when the young one is full it
    becomes the old one, so memory is bounded and frequent pieces stay.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, generation: int = 250_000):
        self.transducer = Transducer(ranks)
        self.split, self.split_ascii = regex.compile(pattern).findall, ascii_split(pattern)
        encode_piece = self.transducer.encode

        class Known(dict):
            old: dict[str, bytes] = {}

            def __missing__(self, piece: str) -> bytes:
                ids = self.old.get(piece)
                if ids is None:
                    found = encode_piece(piece.encode("utf-8"))
                    ids = pack(f"<{len(found)}I", *found)
                if len(piece) <= 64:
                    if len(self) >= generation:
                        self.old = dict(self)
                        self.clear()
                    self[piece] = ids
                return ids

        self.known = Known()
        self.spelled = self.transducer.spelled

    def encode(self, text: str) -> np.ndarray:
        split = self.split_ascii if self.split_ascii and text.isascii() else self.split
        return np.frombuffer(b"".join(map(self.known.__getitem__, split(text))), dtype="<u4")

    def decode_blocks(self, ids: Iterable[int], block: int = 8192) -> Iterator[str]:
        """The text of ``ids`` as it becomes known."""
        stream, ids = Utf8Stream(), list(ids)
        for i in range(0, len(ids), block):
            yield stream.feed(b"".join(map(self.spelled.__getitem__, ids[i : i + block])))
        yield stream.close()


#: The codec of this Python worker: later tasks find its automaton and pieces.
_codecs: dict[tuple[str, str], Codec] = {}


def _codec(key: str, data: bytes, pattern: str) -> Codec:
    if (key, pattern) not in _codecs:
        _codecs.clear()
        _codecs[key, pattern] = Codec(load_ranks(data), pattern)
    return _codecs[key, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text), decode the ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the decoded bytes); with ``keep_ids`` also ids (array of int).

    Null text counts as empty: no tokens, both digests of no bytes.  Rows are
    independent, so repeated ids or texts and null ids are kept as they are; an empty
    table gives no rows.  Other columns are not read.  The driver reads the rank file
    (under 1 MB) and broadcasts it, so executors need no copy of it.
    """
    spark = docs.sparkSession
    small_arrow(spark)
    with open(ranks_path, "rb") as f:
        data = f.read()
    key, shipped = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shipped.value, pattern)
        decimal = {i: str(i) for i in codec.spelled}
        for batch in batches:
            counts, ids_sha, decoded_sha, kept = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text or "").tolist()
                digest = hashlib.sha256()
                for part in codec.decode_blocks(ids):
                    digest.update(part.encode("utf-8"))
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(digest.hexdigest())
                if keep_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), schema)
