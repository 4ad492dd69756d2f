"""Postings as Arrow arrays: made of lists of terms, packed into blocks, and back.

All terms of a document stand in one row, so its postings need no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: So many terms (or positions) are worked on at once; a longer row stands alone.
PIECE = 500_000


def pieces(sizes: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Stretches of rows that have about so many terms."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (most or PIECE), side="right")))
        yield a, b
        a = b


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def sizes_of(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, seven bits in each, the lowest first, and each value's number of them."""
    values = values.astype(np.uint64)
    count = np.ones(len(values), np.int64)
    rest = values >> np.uint64(7)
    while rest.any():
        count += rest > 0
        rest >>= np.uint64(7)
    at = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint8)
    for k in range(int(count.max(initial=0))):
        live = count > k
        part = (values[live] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[live] + k] = part.astype(np.uint8) | np.where(k < count[live] - 1, 128, 0).astype(np.uint8)
    return out, count


def unvarints(data: np.ndarray) -> np.ndarray:
    """The values whose bytes these are."""
    stop = np.flatnonzero(data < 128)
    start = np.append(0, stop[:-1] + 1)[: len(stop)]
    count = stop - start + 1
    out = np.zeros(len(stop), np.uint64)
    for k in range(int(count.max(initial=0))):
        live = count > k
        out[live] |= (data[start[live] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.view(np.int64)


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of bytes that lie end to end."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.cumsum([0, *sizes], dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def flat_binary(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, end to end, and each row's number of them."""
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], np.diff(off)


def grouped(tokens: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of each row and term: the row, the term, how often; and all positions, ascending in each."""
    sizes = sizes_of(tokens)
    held = tokens.flatten().dictionary_encode()
    code = held.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    key = row * len(held.dictionary) + code
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    at = order[first]
    return row[at], held.dictionary.take(pa.array(code[at])), np.diff(np.append(first, len(order))), within(sizes)[order]


def as_gaps(positions: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each position less the one before of its list (the first is its own)."""
    gap = np.diff(positions, prepend=0)
    begin = (np.cumsum(counts) - counts)[counts > 0]
    gap[begin] = positions[begin]
    return gap


def as_positions(gaps: np.ndarray, counts: np.ndarray, strict: bool = True) -> np.ndarray:
    """Back from gaps; if ``strict``, an error where a position doesn't rise."""
    begin = (np.cumsum(counts) - counts)[counts > 0]
    rises = gaps > 0
    rises[begin] |= gaps[begin] == 0
    if strict and not rises.all():
        raise ValueError("positions must rise")
    run = np.cumsum(gaps)
    return run - np.repeat(run[begin] - gaps[begin], counts[counts > 0])


def lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)


def packed(segment: pa.Array, term: pa.Array, doc_id: pa.Array, tf: np.ndarray, positions: np.ndarray) -> pa.RecordBatch:
    """One block a segment and term: its documents by id, their tf and gaps as bytes."""
    seg, name, ids = segment.dictionary_encode(), term.dictionary_encode(), doc_id.dictionary_encode()
    # nulls come last
    place = np.append(pc.rank(ids.dictionary, "ascending", tiebreaker="first").to_numpy().astype(np.int64), len(ids.dictionary) + 1)
    nth = place[ids.indices.fill_null(len(ids.dictionary)).to_numpy(zero_copy_only=False)]
    key = seg.indices.fill_null(len(seg.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64) * len(name.dictionary) + name.indices.to_numpy()
    order = np.lexsort((nth, key))
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    many = np.diff(np.append(first, len(order)))
    count = tf[order]
    gaps = as_gaps(positions, tf)[np.repeat((np.cumsum(tf) - tf)[order], count) + within(count)]
    codes, width = varints(count)
    bytes_, size = varints(gaps)
    gap_bytes = np.add.reduceat(size, np.cumsum(count) - count) if len(count) else size
    at = pa.array(order[first])
    starts = np.append(first, len(order))[:-1]
    total = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0, np.int64)
    by_id = doc_id.take(pa.array(order))
    return pa.RecordBatch.from_arrays([segment.take(at), term.take(at), doc_id.take(at), lists(by_id, many), binaries(codes, total(width)), binaries(bytes_, total(gap_bytes))], names=["segment_id", "term", "first", "ids", "tfs", "gaps"])


def unpacked(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``segment_id, term, doc_id, tf, positions`` of the blocks, in their order."""
    for a, b in pieces(flat_binary(block.column(5))[1]):
        part = block.slice(a, b - a)
        tf = unvarints(flat_binary(part.column(4))[0])
        row = pa.array(np.repeat(np.arange(len(part)), sizes_of(part.column(3))))
        # rows of one id were merged: a position may stand in several
        positions = as_positions(unvarints(flat_binary(part.column(5))[0]), tf, strict=False)
        yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), part.column(3).flatten(), pa.array(tf), lists(pa.array(positions.astype(np.int32)), tf)], names=["segment_id", "term", "doc_id", "tf", "positions"])
