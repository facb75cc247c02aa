"""Words and word windows of many texts at once, as arrays of hashes.

The texts are the UTF-8 bytes of an Arrow column, one after another. Hashes are
polynomials modulo 2**64, so that equal words or windows always have equal
hashes; whoever needs certainty compares the bytes as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes whose hashes are computed in one step.
STEP_BYTES = 1 << 20
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1B54A32D192ED03
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls and its row offsets."""
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@cache
def _known_powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def powers(base: int, size: int) -> np.ndarray:
    """1, base, base**2 and so on, modulo 2**64."""
    usual = 2 * STEP_BYTES
    return _known_powers(base, usual)[:size] if size <= usual else _known_powers.__wrapped__(base, size)


def span_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[start:stop] for each pair."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(base, len(values)), out=sums[1:])
    inverse = pow(base, -1, 1 << 64)
    return mixed((sums[stop] - sums[start]) * powers(inverse, len(values) + 1)[start])


def parts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about 4 * STEP_BYTES of one column, a longer text alone."""
    for b in batches:
        _, at = utf8(b.column(column))
        first = 0
        while first < len(b):
            last = max(first + 1, int(np.searchsorted(at, at[first] + 4 * STEP_BYTES, "right")) - 1)
            yield b.slice(first, last - first)
            first = last


class Words:
    """The words of a batch of texts: their row, their bytes from ``start`` to ``stop``, and a hash of each."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = utf8(column)
        blank = SPACES[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        before = np.append(True, blank[:-1])[: len(blank)] | edge[:-1]
        after = np.append(blank[1:], True)[: len(blank)] | edge[1:]
        self.start = np.flatnonzero(~blank & before)
        self.stop = np.flatnonzero(~blank & after) + 1
        self.row = np.searchsorted(self.offsets, self.start, "right") - 1
        #: The first word of each row, and the end of the last.
        self.first = np.searchsorted(self.row, np.arange(len(column) + 1))

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        cuts = np.searchsorted(self.start // STEP_BYTES, np.arange(len(self.data) // STEP_BYTES + 2))
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if a < z:
                low = self.start[a]
                out[a:z] = span_hashes(self.data[low : self.stop[z - 1]] + np.uint64(1), self.start[a:z] - low, self.stop[a:z] - low, BYTE_BASE)
        return mixed(out + (self.stop - self.start).astype(np.uint64))

    def windows(self, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the ``size`` words from each word on, and whether they lie in one text."""
        n = max(0, len(words) - size + 1)
        at = np.arange(n)
        return span_hashes(words, at, at + size, WORD_BASE), self.row[:n] == self.row[size - 1 :] if n else np.zeros(0, bool)


def window_minima(key: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive keys."""
    m = 1
    while 2 * m <= width:
        key = np.minimum(key[:-m], key[m:])
        m *= 2
    rest = width - m
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def window_anchors(words: np.ndarray, found: Words, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, hashes, first, last): the anchors of all windows of ``size`` words that lie in one text.

    A window's anchor are its ``k`` words in a row with the smallest hash, of
    equal ones the first; ``first`` to ``last`` are the windows that share it.
    """
    none = np.zeros(0, np.int64)
    if len(words) < size:
        return none, np.zeros(0, np.uint64), none, none
    hashes, _ = found.windows(words, k)
    bits = np.uint64(max(1, int(len(words)).bit_length()))
    key = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    least = window_minima(key, size - k + 1) & ((np.uint64(1) << bits) - np.uint64(1))
    n = len(words) - size + 1
    starts = np.flatnonzero(found.row[:n] == found.row[size - 1 :])
    if not len(starts):
        return none, np.zeros(0, np.uint64), none, none
    anchors = least[starts].astype(np.int64)
    cut = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
    return anchors[cut], hashes[anchors[cut]], starts[cut], starts[np.append(cut[1:], len(starts)) - 1]
