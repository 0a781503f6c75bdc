"""Words of whole Arrow text columns as 64-bit hashes, without a Python object per word.

All functions take a text as UTF-8 bytes; a null counts as an empty text.  Work arrays are bounded by ``PIECE``
characters (or one word, if a word is longer), however long a text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
#: For functions that make several numbers a word: so many bytes of text at a time.
FINE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BASE = 0x9E3779B97F4A7C15
ODD = np.uint64(BASE)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown when longer pieces come."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int):
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up, self.down


_POWERS = _Powers(BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each text starts (one more entry than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    n, skip = len(column), column.offset
    if n == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(at, wide)[skip : skip + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of ``inside`` bytes within one text; how many runs each text has."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    first = np.zeros(len(inside), bool)
    first[offsets[:-1][offsets[:-1] < len(inside)]] = True  # where a text starts, a run starts anew
    start = inside & first
    start[1:] |= inside[1:] & ~inside[:-1]
    stop = np.zeros(len(inside), bool)
    stop[:-1] = inside[:-1] & (~inside[1:] | first[1:])
    stop[-1] = inside[-1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return s, e, np.diff(np.searchsorted(s, offsets))


def run_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for every run, from running sums of a polynomial."""
    out = np.empty(len(s), np.uint64)
    at = 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(e, s[at] + PIECE, "right")))
        low, high = s[at], e[to - 1]
        up, down = _POWERS.to(int(high - low))
        sums = np.zeros(int(high - low) + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        a, b = s[at:to] - low, e[at:to] - low
        out[at:to] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * ODD
        at = to
    return mix(out)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, and the number of words of each text."""
    data, offsets = buffers(column)
    s, e, n = spans(~SPACE[data], offsets)
    return run_hashes(FOLD[data], s, e), n


def shingles(w: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes; a shorter text is one shingle, an empty one none."""
    n = len(w)
    if n == 0:
        return w
    k = min(size, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = h * ODD + w[j : n - k + 1 + j]
    h = np.sort(mix(h))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Parts of a batch with about ``limit`` bytes of text, at least one row each."""
    data = batch.column(batch.schema.get_field_index(column))
    if not len(batch):
        return
    _, at, _ = data.buffers()
    wide = np.int64 if pa.types.is_large_string(data.type) else np.int32
    ends = np.frombuffer(at, wide)[data.offset + 1 : data.offset + len(batch) + 1].astype(np.int64)
    begin = 0
    base = int(np.frombuffer(at, wide)[data.offset])
    while begin < len(batch):
        end = max(begin + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(begin, end - begin)
        base, begin = int(ends[end - 1]), end
