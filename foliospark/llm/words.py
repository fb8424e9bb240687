"""Words of whole texts as numpy arrays over the bytes of an Arrow column.

A word is a run of bytes other than blank and 0x09-0x0D, which in UTF-8 is a run of such characters.
All hashes are polynomials modulo 2**64 (Karp-Rabin): a window's hash is the difference of two prefix
sums times an inverse power, so every window of a text costs a few operations, whatever its width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE_BYTES = (9, 10, 11, 12, 13, 32)
CHUNK_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True
IS_PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = {}


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: xor-shifts and odd factors, a bijection."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(33)
    return values


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. n - 1`` modulo 2**64; the longest table of a process is kept."""
    known = _BASE.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 12)
        known = np.empty(size, np.uint64)
        known[0] = 1
        filled, factor = 1, base
        while filled < size:
            step = min(filled, size - filled)
            known[filled : filled + step] = known[:step] * np.uint64(factor)
            filled += step
            factor = factor * factor % (1 << 64)
        _BASE[base] = known
    return known[:n]


class Rolling:
    """Hashes of any run of a sequence from its prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        self.inverse = pow(base, -1, 1 << 64)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), out=self.sums[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mixed hashes of the runs ``[start, end)``."""
        shift = powers(self.inverse, len(self.sums))[starts]
        return mixed((self.sums[ends] - self.sums[starts]) * shift)

    def windows(self, width: int) -> np.ndarray:
        """Mixed hashes of all windows of one width."""
        n = max(len(self.sums) - width, 0)
        return mixed((self.sums[width:] - self.sums[:n]) * powers(self.inverse, n)) if n else self.sums[:0]


BYTE_BASE = 0x2545F4914F6CDD1D
WORD_BASE = 0x9FB21C651E98DF25


class Words:
    """The words of several texts: ``starts`` and ``ends`` in ``data``; ``first[d]:first[d + 1]`` are
    those of text ``d``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_SPACE):
        self.data, self.offsets = data, offsets
        solid = ~breaks[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = ~solid[:-1]
        edge[offsets] = True
        self.starts = np.flatnonzero(solid & edge[:-1])
        edge[:-1] = True
        edge[:-2] = ~solid[1:]
        edge[offsets[1:] - 1] = True
        self.ends = np.flatnonzero(solid & edge[:-1]) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return Rolling(BYTE_VALUES[self.data], BYTE_BASE).runs(self.starts, self.ends)

    def texts(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


BLANK = 32


class Chars:
    """Character n-grams of several texts, each with a blank on both sides and every blank alike.

    An n-gram lies within a word; its first and last character may be the blank next to it.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.edges = offsets + np.arange(len(offsets))
        chars = np.insert(data, offsets, BLANK)
        chars = np.where(IS_SPACE[chars], np.uint8(BLANK), LOWER[chars] if lower else chars)
        self.rolling = Rolling(BYTE_VALUES[chars], BYTE_BASE)
        self.begins = np.append(np.flatnonzero((chars & 0xC0) != 0x80), len(chars))
        self.blank = chars[self.begins[:-1]] == BLANK
        self.blanks = np.append(0, np.cumsum(self.blank))

    def _first(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(starts, self.edges)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes in text order, and where each text begins among them."""
        ends = self.begins[np.flatnonzero(~self.blank[:-1] & self.blank[1:]) + 1]
        starts = self.begins[np.flatnonzero(self.blank[:-1] & ~self.blank[1:]) + 1]
        return self.rolling.runs(starts, ends), self._first(starts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        count = max(len(self.blank) - n + 1, 0)
        if n <= 2:
            inner = np.flatnonzero(self.blanks[n : n + count] - self.blanks[:count] < n)
        else:
            inner = np.flatnonzero(self.blanks[n - 1 : n - 1 + count] == self.blanks[1 : 1 + count])
        starts = self.begins[inner]
        return self.rolling.runs(starts, self.begins[inner + n]), self._first(starts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def pieces(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: first and last row, bytes, offsets.

    Bounds the working memory of one step, whatever the number of rows in an Arrow batch; only a single
    longer text makes a longer piece.
    """
    data, offsets = text_bytes(column)
    at, n = 0, len(column)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
