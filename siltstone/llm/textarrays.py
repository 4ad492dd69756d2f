"""Vectorised text primitives shared by the corpus operators.

Everything here works on an Arrow string column as flat numpy buffers, so a
batch of documents costs a handful of array passes, never a Python loop over
characters or words.  Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)
#: Text is processed in slices of about this many bytes, which bounds memory
#: whatever the Arrow batch or the document length.
SLICE_BYTES = 1_000_000


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased ASCII bytes, and which bytes belong to words.

    ASCII letters, digits and every byte of a multi-byte UTF-8 sequence belong
    to words; ASCII space, punctuation and control characters separate them.
    """
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, dtype=bool)
    word[48:58] = word[65:91] = word[97:123] = True
    word[128:] = True
    return lower, word


LOWER, WORD = _byte_classes()
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        grown = np.full(n, _R, dtype=np.uint64)
        grown[0] = 1
        _POW = np.multiply.accumulate(grown)
        grown[1:] = np.uint64(_R_INV)
        _INV = np.multiply.accumulate(grown)
    return _POW[:n], _INV[:n]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 row offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges of about ``limit`` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = WORD, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, their start and end bytes, and each row's word offsets.

    A word is a maximal run of ``word_bytes`` inside one row.  With ``fold``
    ASCII letters are lower-cased first.  Equal words have equal hashes.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    is_word = word_bytes[data]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    begins[inner] = is_word[inner]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:]
    last = inner[inner > 0] - 1
    ends[last] = is_word[last]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    power, inverse = _powers(n + 1)
    prefix = np.empty(n + 1, dtype=np.uint64)
    prefix[0] = 0
    symbols = (LOWER[data] if fold else data).astype(np.uint64) + np.uint64(1)
    np.cumsum(symbols * power[:n], out=prefix[1:])
    hashes = mix((prefix[end] - prefix[start]) * inverse[start])
    return hashes, start, end, np.searchsorted(start, offsets)


def ngrams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows and the row offsets into them.

    A row of 1 to n - 1 words has one window: all its words.
    """
    sizes = np.diff(rows)
    total = len(hashes)
    acc = np.zeros(total, dtype=np.uint64)
    row_end = np.repeat(rows[1:], sizes)
    at = np.arange(total)
    for k in range(n):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        if k == 0:
            acc += hashes
        elif total > k:
            inside = at[:-k] + k < row_end[:-k]
            acc[:-k] += np.where(inside, hashes[k:], np.uint64(0))
    keep = (at + n <= row_end) | (at == np.repeat(rows[:-1], sizes))
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    return mix(acc[keep]), np.concatenate([[0], np.cumsum(counts)])


def unique_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts each row's values and drops repeats; returns values and row offsets."""
    values = values.copy()
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        values[a:b].sort()
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = values[1:] != values[:-1]
    keep[rows[:-1][rows[:-1] < len(values)]] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[rows]
