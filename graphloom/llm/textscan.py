"""Whole texts as byte arrays: words and their hashes by array operations.

Texts are taken from Arrow's buffers in slices of some hundred kilobytes, so memory is bounded
by the longest text.  A word's hash is a polynomial in an odd base modulo 2**64 over a
table of random byte values: differences of one running sum give the hash of any range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Letters and digits of ASCII, and all bytes of other characters.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n + n // 4, 1 << 19)
        _powers, _inverses = (np.full(size, x, np.uint64) for x in (_BASE, _INVERSE))
        _powers[0] = _inverses[0] = 1
        _powers, _inverses = np.multiply.accumulate(_powers), np.multiply.accumulate(_inverses)
    return _powers, _inverses


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Slice:
    """Some texts: ``data`` (bytes), ``offsets`` (of the texts), ``first`` (their number in the batch)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each run of bytes that ``inside`` has; runs end with their text."""
        mask = np.zeros(len(self.data) + 1, np.int8)
        mask[:-1] = inside[self.data]
        change = np.diff(mask, prepend=np.int8(0))
        begin, end = change == 1, change == -1
        inner = self.offsets[1:-1]
        joined = inner[(inner > 0) & (inner < len(self.data))]
        joined = np.unique(joined[(mask[joined - 1] == 1) & (mask[joined] == 1)])
        begin[joined] = True
        end[joined] = True
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def hashes(self, lower: np.ndarray = LOWER) -> "Ranges":
        return Ranges(_BYTES[lower[self.data]])


class Ranges:
    """Hashes of byte ranges."""

    def __init__(self, values: np.ndarray):
        powers, self.inverse = _tables(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[: len(values)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def slices(texts: pa.Array, size: int = 1 << 18) -> Iterator[Slice]:
    """The texts (nulls as empty) in slices of about ``size`` bytes, each text whole."""
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield Slice(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to
