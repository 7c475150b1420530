"""Vectorised text primitives for Arrow batches: byte views, words and 64-bit word hashes.

Python workers get Arrow string columns.  The functions here look at the column's own
UTF-8 buffer, so no Python string is made for a word.  All separators used are ASCII,
which makes byte positions safe in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of a batch are worked on in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19


def separator_table(kind: str) -> np.ndarray:
    """True for the bytes that end a word: ``space`` is ``[\\x20\\x09-\\x0D]``, ``alnum`` is all ASCII but letters and digits."""
    sep = np.zeros(256, bool)
    if kind == "space":
        sep[0x20] = True
        sep[0x09:0x0E] = True
    elif kind == "alnum":
        sep[:0x80] = True
        for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
            sep[a:b] = False
    else:
        raise ValueError(kind)
    return sep


def lower_table() -> np.ndarray:
    """Lower-cases A-Z only."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, raw = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, one row at least."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


class Words:
    """Words of some rows: byte ``starts`` and ``ends`` in ``data``, and ``bounds`` with the words of row r at bounds[r]:bounds[r + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, sep: np.ndarray):
        inside = ~sep[data]
        before = np.zeros_like(inside)
        after = np.zeros_like(inside)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        cut = offsets[:-1][np.diff(offsets) > 0]
        before[cut] = False
        after[cut[1:] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.inside = inside


class SpanHasher:
    """64-bit hashes of many byte spans from one running sum: sum of r[byte] * p**position, shifted back to position 0 and mixed with the length."""

    P = 0x9E3779B97F4A7C15 | 1

    def __init__(self, seed: int = 7):
        self.values = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = 1 << int(n).bit_length()
            for name, base in (("up", self.P), ("down", pow(self.P, -1, 1 << 64))):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=total[1:])
        h = (total[ends] - total[starts]) * self.down[starts]
        return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes; fewer than k words give the whole run as one, no word gives none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = words[: n - k + 1].copy()
    for i in range(1, k):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[i : n - k + 1 + i]
    return mix64(out + np.uint64(k))
