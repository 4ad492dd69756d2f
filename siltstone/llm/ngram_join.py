"""N-gram Jaccard join by universe partition and pigeonhole.

Documents are sets of hashed word n-grams.  The join finds the pairs with
Jaccard similarity of at least ``threshold``; as a group of g near copies has
g * g / 2 of them, the result is the groups that the pairs form (connected
components of the exact join), with one exactly verified partner and the exact
number of links a document, never the list of all pairs.

Method
------
1. Equal texts are one node.  An n-gram held by a single node can't be shared:
   an exact count by n-gram (one shuffle of 32-bit keys, whose collisions only
   let more pass) leaves the nodes of which at least ``threshold`` of the
   n-grams are shared.  No other node can have a partner.
2. Sets are put in bands by size.  In a band whose largest size is u, the
   universe of hashes is cut into ``m`` segments, m twice the bound H of the
   symmetric difference of two similar sets, plus one.  The larger of two
   similar sets indexes all its segments in its own band; the smaller probes in
   its own band and the next.  As at most H(x) segments differ, probing any
   H(x) + 1 segments finds the pair.  Which ones is a matter of cost: the
   probes go to the segments with the shortest lists.  A set that has too few
   segments which aren't empty also probes one-deletion neighbourhoods of some
   (matching up to one difference, so counting for two), and only at the end
   empty ones.
3. Dense groups first: each node is verified against the node with which it
   shares most index entries.  Then all pairs of nodes that share an entry and
   aren't yet in one component are verified, exactly, on their whole sets.
4. Every link lies within a component.  There all pairs of different texts are
   counted by products of their sets' 0/1 matrices, a pair of tiles a task.

Scale: the survivors of step 1 are sent to the scan of the texts, up to
``broadcast_rows`` of them; beyond that a filter of bounded size is, and only
texts that it lets through are shuffled.  N-grams are moved as packed arrays, a
row per slice of documents and bucket; a set's id, size and bitmap go to every
bucket in which it has keys, so that part of the shuffle grows with the number
of buckets until a set has about one key in each.  Step 4 grows with the square
of a component's different texts; a set goes to as many tasks as its component
has tiles (of ``TILE_GRAMS`` n-grams or ``TILE_SETS`` sets).

Defined results
---------------
* Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased
  where ASCII; a text of fewer words than n has one n-gram, all its words.
* Null and empty texts, and those without words, aren't in any group.
* Rows with a null id are left out; repeated rows count once; rows with the
  same id and different texts stand for each of the texts.
* Result columns: ``doc_id, group_id`` (the least id of the group),
  ``partner_id`` and ``jaccard`` of a verified pair, and ``links``, the number
  of other rows (told apart by id and text, copies included) that reach the
  threshold.  Documents without a link, a class of their own, aren't listed.  Other columns don't pass.  An empty table, or one
  without similar pairs, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from .frames import BROADCAST_ROWS, by_bucket, by_place, column, joined, saved, scratch, tuned, ways
from .textarrays import buffers, mix, ngrams, slices, unique_by_row, words

N = 3
THRESHOLD = 0.6
FLEX = 8
#: Bytes of packed keys in a bucket.  A set's id, size and bitmap go to every
#: bucket in which it has keys, so there are as few buckets as memory allows.
BUCKET_BYTES = 32_000_000
HOT = 16
#: A task of the last step holds two tiles of so many n-grams and sets.
TILE_GRAMS, TILE_SETS = 2_000_000, 8192
U64 = np.uint64


# ---- packed moves ----------------------------------------------------------


def _batches(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _bucket_of(values: np.ndarray, n: int) -> np.ndarray:
    return (((values >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


def _spread(bucket: np.ndarray, n: int, *arrays: np.ndarray):
    """For each bucket that occurs, its part of the arrays, in the old order."""
    order = np.argsort(bucket.astype(np.uint16) if n <= 65536 else bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    moved = [a[order] for a in arrays]
    for b in np.flatnonzero(np.diff(ends)):
        yield int(b), [a[ends[b] : ends[b + 1]] for a in moved]


def _gathered(batches, *dtypes):
    """All packed columns (after the bucket) of a partition, each as one array."""
    parts: list[list[np.ndarray]] = [[] for _ in dtypes]
    for batch in batches:
        for k, dtype in enumerate(dtypes):
            parts[k] += [np.frombuffer(x.as_buffer(), dtype=dtype) for x in batch.column(k + 1)]
    return [np.concatenate([*p, np.zeros(0, d)]) for p, d in zip(parts, dtypes)]


# ---- step 1: nodes that may have partners ----------------------------------


def shingles(col: pa.Array, n: int):
    """Per slice: first row, sorted distinct n-gram hashes, row offsets."""
    data, offsets = buffers(col)
    for i, j in slices(offsets):
        hashed, _, _, rows = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, *unique_by_row(*ngrams(hashed, rows, n))


def survivors(nodes: DataFrame, n: int, threshold: float, cut: int) -> DataFrame:
    """``tid`` of the nodes that share enough n-grams with other nodes."""

    def send(batches):
        for batch in batches:
            tids = batch.column(0).to_numpy()
            for i, grams, rows in shingles(batch.column(1), n):
                owner = np.repeat(np.arange(len(rows) - 1, dtype=np.int64), np.diff(rows))
                out = []
                for b, (key, own) in _spread(_bucket_of(grams, cut), cut, grams.astype(np.uint32), owner):
                    first = np.flatnonzero(np.diff(own, prepend=-1))
                    runs = np.diff(np.append(first, len(own))).astype(np.uint32)
                    out.append((b, key.tobytes(), tids[i + own[first]].tobytes(), runs.tobytes()))
                # rows without keys: the nodes' numbers of distinct keys, once each
                pairs = (owner.astype(U64) << U64(32)) | (grams & U64(0xFFFFFFFF))
                pairs.sort()
                size = np.bincount((pairs[np.append(True, pairs[1:] != pairs[:-1])] >> U64(32)).astype(np.int64), minlength=len(rows) - 1) if len(pairs) else np.zeros(len(rows) - 1, np.int64)
                own = tids[i : i + len(size)]
                for b, (t, n_) in _spread(_bucket_of(mix(own.view(U64)), cut), cut, own, size.astype(np.uint32)):
                    out.append((b, b"", t.tobytes(), n_.tobytes()))
                if out:
                    yield _batches(out, ["bucket", "keys", "tids", "runs"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()])

    def count(batches):
        keys, tids, runs, sizes = [], [], [], []
        for batch in batches:
            for b, k, t, r in zip(*(batch.column(c) for c in range(4))):
                if not len(k.as_buffer()):
                    sizes.append((b.as_py(), t.as_py(), bytes(4 * (len(r.as_buffer()) // 4)), r.as_py()))
                    continue
                keys.append(np.frombuffer(k.as_buffer(), dtype=np.uint32))
                tids.append(np.frombuffer(t.as_buffer(), dtype=np.int64))
                runs.append(np.frombuffer(r.as_buffer(), dtype=np.uint32))
        kinds = ["bucket", "tids", "shared", "sizes"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        if sizes:
            yield _batches(sizes, *kinds)
        if not keys:
            return
        keys = np.concatenate(keys)
        names, node = np.unique(np.concatenate(tids), return_inverse=True)
        pairs = (keys.astype(U64) << U64(32)) | np.repeat(node.astype(U64), np.concatenate(runs))
        del keys, tids, runs
        pairs.sort()
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
        key, node = pairs >> U64(32), (pairs & U64(0xFFFFFFFF)).astype(np.int64)
        same = key[1:] == key[:-1]
        shared = np.append(False, same) | np.append(same, False)
        some = np.bincount(node[shared], minlength=len(names)).astype(np.int32)
        # nodes that share nothing here needn't be named
        names, some = names[some > 0], some[some > 0]
        out = [(b, t.tobytes(), c.tobytes(), bytes(4 * len(c))) for b, (t, c) in _spread(_bucket_of(mix(names.view(U64)), cut), cut, names, some)]
        if out:
            yield _batches(out, *kinds)

    def total(batches):
        tids, some, size = _gathered(batches, np.int64, np.int32, np.int32)
        names, node = np.unique(tids, return_inverse=True)
        # a repeated row tells its size again
        most = np.zeros(len(names))
        np.maximum.at(most, node, size)
        some, size = np.bincount(node, some, len(names)), most
        # one more for a long set: two of its own n-grams may have one 32-bit key
        kept = (some > 0) & (some + (size > 256) >= threshold * size - 1e-9)
        yield pa.RecordBatch.from_arrays([pa.array(names[kept])], names=["tid"])

    sent = by_bucket(nodes.mapInArrow(send, "bucket int, keys binary, tids binary, runs binary"), cut)
    counted = by_bucket(sent.mapInArrow(count, "bucket int, tids binary, shared binary, sizes binary"), cut)
    return counted.mapInArrow(total, "tid long")


def node_sets(nodes: DataFrame, n: int) -> DataFrame:
    """Each node's sorted distinct n-gram hashes, as 64-bit words."""

    def run(batches):
        for batch in batches:
            tids = batch.column(0).to_numpy()
            for i, grams, rows in shingles(batch.column(1), n):
                ids = tids[i : i + len(rows) - 1]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(rows).astype(np.int32)), pa.array([grams[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:])], pa.binary()), batch.column(2).slice(i, len(ids))], names=["tid", "size", "grams", "many"])

    return nodes.mapInArrow(run, "tid long, size int, grams binary, many boolean").where("size > 0")


# ---- step 2: the index -----------------------------------------------------


class Layout:
    """Bands of set sizes and their numbers of segments, for one threshold."""

    def __init__(self, threshold: float):
        self.t = threshold
        self.slack = (1 - threshold) / (1 + threshold)
        self.ratio = threshold**-2 if threshold < 0.95 else 1.2
        self.tops = [1]
        while self.tops[-1] < 1 << 31:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * self.ratio)))
        self.tops = np.array(self.tops, dtype=np.int64)
        self.segments = 2 * (np.floor(2 * self.slack * self.tops + 1e-9).astype(np.int64) + 1)

    def band(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops, size)

    def most(self, size: np.ndarray, band: np.ndarray) -> np.ndarray:
        """The bound of the symmetric difference with a partner no smaller, in that band."""
        partner = np.minimum(self.tops[band], np.floor(size / self.t + 1e-9))
        return np.floor(self.slack * (size + partner) + 1e-9).astype(np.int64)


def entries(layout: Layout, grams: np.ndarray, rows: np.ndarray, hot: tuple[np.ndarray, np.ndarray] | None = None):
    """Index (role 1) and probe (role 2) entries: keys, set numbers, roles.

    The entries of empty segments have 4 in their role.
    """
    size = np.diff(rows)
    own = layout.band(size)
    keys, sets, roles = [], [], []
    mixed = mix(grams)
    reach = size / layout.t
    step = 0
    while True:
        band = own + step
        # a partner in this band is larger than the top of the band before
        live = np.flatnonzero((size > 0) & ((step == 0) | (layout.tops[np.maximum(band - 1, 0)] < reach + 1e-9)))
        if not len(live):
            break
        m = layout.segments[band[live]]
        base = np.concatenate([[0], np.cumsum(m)])
        taken = np.concatenate([np.arange(rows[i], rows[i + 1]) for i in live]) if len(live) < len(size) else np.arange(len(grams))
        holder = np.repeat(np.arange(len(live)), size[live])
        slot = base[holder] + ((grams[taken] >> U64(32)) * m[holder].astype(U64) >> U64(32)).astype(np.int64)
        n = np.bincount(slot, minlength=base[-1])
        content = np.zeros(base[-1], dtype=U64)
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        content[slot[first]] = np.add.reduceat(mixed[taken], first)
        who = np.repeat(np.arange(len(live)), m)
        segment = np.arange(base[-1]) - base[who]
        place = mix((segment.astype(U64) << U64(8)) + band[live][who].astype(U64) + U64(1))
        key = mix(content + place)
        cost = np.where(n == 0, 1 << 40, np.where(n == 1, 2, 1)).astype(np.int64)
        if hot is not None and len(hot[0]):
            at = np.minimum(np.searchsorted(hot[0], key), len(hot[0]) - 1)
            cost = np.where((hot[0][at] == key) & (n > 0), hot[1][at] + 2, cost)
        need = layout.most(size[live], band[live]) + 1
        flexible = (segment < FLEX) & (n >= 2)
        # deficits: sets with too few segments that aren't empty
        full = np.bincount(who[n > 0], minlength=len(live))
        lacking = np.maximum(need - full, 0)
        doubled = np.zeros(len(n), dtype=bool)
        if lacking.any():
            at = np.flatnonzero(flexible & (lacking[who] > 0))
            at = at[np.lexsort((cost[at], who[at]))]
            nth = np.arange(len(at)) - np.searchsorted(who[at], who[at])
            doubled[at[nth < lacking[who[at]]]] = True
        need = need - np.bincount(who[doubled], minlength=len(live))
        order = np.lexsort((segment, cost, ~doubled, who))
        nth = np.arange(len(order)) - base[who[order]]
        probe = np.zeros(len(n), dtype=bool)
        probe[order[nth < need[who[order]]]] = True
        # empty segments are indexed too, for the sets that must probe them
        role = np.where(n == 0, 4, 0) * (probe | (step == 0)) + probe * 2 + (step == 0)
        used = role > 0
        keys.append(key[used])
        sets.append(live[who[used]])
        roles.append(role[used].astype(np.uint8))
        for index in (True, False):
            chosen = flexible if index else doubled
            if index and step:
                continue
            inside = chosen[slot]
            if not inside.any():
                continue
            s = slot[inside]
            without = content[s] - mixed[taken][inside]
            tag = U64(0xD1) if index else U64(0)
            keys.append(mix(without + place[s] + (tag << U64(56))))
            sets.append(live[who[s]])
            roles.append(np.full(len(s), 1 if index else 2, dtype=np.uint8))
            if not index:
                s = np.flatnonzero(doubled)
                keys.append(mix(content[s] + place[s] + (U64(0xD1) << U64(56))))
                sets.append(live[who[s]])
                roles.append(np.full(len(s), 2, dtype=np.uint8))
        step += 1
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return np.concatenate(keys), np.concatenate(sets), np.concatenate(roles)


def bitmaps(grams: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps of the sets, as 64-bit words, and the words of each.

    Each n-gram flips one bit, so two bitmaps differ in no more bits than the
    sets in n-grams.  A bitmap has 1.25 to 2.5 bits an n-gram, 128 to 32768: with
    64, many pairs of sets of some 40 n-grams would pass that share nearly none.
    """
    size = np.diff(rows)
    width = np.clip(1 << np.ceil(np.log2(np.maximum(size, 1) / 51.2)).astype(np.int64).clip(0), 2, 512)
    base = np.concatenate([[0], np.cumsum(width)])
    bit = (grams & (np.repeat(width, size) * 64 - 1).astype(U64)).astype(np.int64)
    flips = np.bincount(np.repeat(base[:-1], size) * 64 + bit, minlength=int(base[-1]) * 64)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").view(U64), width


class Bitmaps:
    """Bitmaps of nodes by width, each also folded to half its width."""

    def __init__(self, maps: np.ndarray, width: np.ndarray):
        base = np.concatenate([[0], np.cumsum(width)])
        self.width, self.rows, self.at = width, {}, {}
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            rows = maps[base[own][:, None] + np.arange(w)]
            self._add(w, own, rows)
            if w > 1:
                self._add(w // 2, own, rows[:, : w // 2] ^ rows[:, w // 2 :])

    def _add(self, w, nodes, rows):
        if w not in self.rows:
            self.rows[w], self.at[w] = rows, np.full(len(self.width), -1)
            self.at[w][nodes] = np.arange(len(nodes))
        else:
            self.at[w][nodes] = len(self.rows[w]) + np.arange(len(nodes))
            self.rows[w] = np.concatenate([self.rows[w], rows])

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """A lower bound of the n-grams in which sets differ; 0 where widths are too far apart."""
        out = np.zeros(len(x), dtype=np.int64)
        low, high = np.minimum(self.width[x], self.width[y]), np.maximum(self.width[x], self.width[y])
        for w in np.unique(low).tolist():
            some = np.flatnonzero((low == w) & (high <= 2 * w))
            step = max(1, 4_000_000 // w)
            for a in range(0, len(some), step):
                k = some[a : a + step]
                out[k] = np.bitwise_count(self.rows[w][self.at[w][x[k]]] ^ self.rows[w][self.at[w][y[k]]]).sum(axis=1)
        return out


def _send_entries(frame: DataFrame, threshold: float, cut: int, hot=None) -> DataFrame:
    """Entries of all sets (columns tid, size, grams, comp), packed by bucket.

    ``hot``: keys of long lists, their lengths, and the keys of empty segments
    that some set probes.  Other empty segments aren't sent; before these are
    known, only the probes are.
    """
    layout = Layout(threshold)

    def send(batches):
        table = None if hot is None else hot.value
        for batch in batches:
            tid, size, comp = (batch.column(k).to_numpy() for k in (0, 1, 3))
            data, offsets = buffers_of(batch.column(2))
            for i, j in slices(offsets * 8, 400_000):
                grams, rows = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                key, owner, role = entries(layout, grams, rows, None if table is None else table[:2])
                sent = (role < 4) | (role & 2 > 0)
                if table is not None and len(table[2]):
                    sent |= table[2][np.minimum(np.searchsorted(table[2], key), len(table[2]) - 1)] == key
                key, owner, role = key[sent], owner[sent], role[sent]
                maps, width = bitmaps(grams, rows) if table is not None else (np.zeros(0, U64), np.zeros(j - i, np.int64))
                base = np.concatenate([[0], np.cumsum(width)])
                owner = owner + i
                out = []
                for b, (k, o, r) in _spread(_bucket_of(key, cut), cut, key, owner, role):
                    seen, local = np.unique(o, return_inverse=True)
                    out.append((b, k.tobytes(), local.astype(np.int32).tobytes(), r.tobytes(), tid[seen].tobytes(), size[seen].astype(np.int32).tobytes(), comp[seen].tobytes(), width[seen - i].astype(np.uint16).tobytes(), maps[np.repeat(base[seen - i], width[seen - i]) + _within(width[seen - i])].tobytes()))
                if out:
                    yield _batches(out, ["bucket", "keys", "local", "roles", "tids", "sizes", "comps", "widths", "maps"], [pa.int32(), *[pa.binary()] * 8])

    return by_bucket(frame.select("tid", "size", "grams", "comp").mapInArrow(send, "bucket int, keys binary, local binary, roles binary, tids binary, sizes binary, comps binary, widths binary, maps binary"), cut)


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def buffers_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column of 64-bit words: the words and the row offsets."""
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    flat = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]]
    # words that begin at a multiple of eight bytes are read where they stand
    words_ = flat.view(U64) if flat.ctypes.data % 8 == 0 else np.frombuffer(flat.tobytes(), dtype=U64)
    return words_, (off - off[0]) // 8


def _lists(batches):
    """Entries of a bucket sorted by key, those with equal set and key merged."""
    keys, nodes, roles, tids, sizes, comps, widths, maps = [], [], [], [], [], [], [], []
    base = 0
    for batch in batches:
        cols = [batch.column(k) for k in range(1, 9)]
        for k, local, r, t, s, c, w, m in zip(*cols):
            widths.append(np.frombuffer(w.as_buffer(), dtype=np.uint16))
            maps.append(np.frombuffer(m.as_buffer(), dtype=U64))
            keys.append(np.frombuffer(k.as_buffer(), dtype=U64))
            nodes.append(np.frombuffer(local.as_buffer(), dtype=np.int32) + np.int64(base))
            roles.append(np.frombuffer(r.as_buffer(), dtype=np.uint8))
            tids.append(np.frombuffer(t.as_buffer(), dtype=np.int64))
            sizes.append(np.frombuffer(s.as_buffer(), dtype=np.int32))
            comps.append(np.frombuffer(c.as_buffer(), dtype=np.int64))
            base += len(tids[-1])
    if not keys:
        return None
    tids, sizes, comps = np.concatenate(tids), np.concatenate(sizes), np.concatenate(comps)
    names, first, number = np.unique(tids, return_index=True, return_inverse=True)
    keys, nodes, roles = np.concatenate(keys), number[np.concatenate(nodes)], np.concatenate(roles)
    order = np.argsort(keys, kind="stable")
    keys, nodes, roles = keys[order], nodes[order], roles[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    ends = np.append(starts[1:], len(keys))
    width = np.concatenate(widths).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(width)])[first]
    bits = np.concatenate(maps)[np.repeat(at, width[first]) + _within(width[first])]
    return keys, nodes, roles, starts, ends, names, sizes[first], comps[first], (bits, width[first])


def leaders(sent: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, votes): b shares entries with a, the most central node of the list; and
    rows (a, null, votes): entry a is in the lists of so many nodes, or for 0 votes,
    it is an empty segment that some set probes."""

    def run(batches):
        got = _lists(batches)
        if got is None:
            return
        keys, nodes, roles, starts, ends, names, sizes, *_ = got
        long = (ends - starts >= 2) & (roles[starts] < 4)
        member = np.repeat(long, ends - starts)
        lengths = (ends - starts)[long]
        nodes, sets = nodes[member], np.repeat(np.arange(len(lengths)), lengths)
        # the node in the middle of a group stands in the longest lists
        weight = np.bincount(nodes, lengths[sets], minlength=len(names)).astype(np.int64)
        rank = np.empty(len(names), dtype=np.int64)
        rank[np.lexsort((names, -weight))] = np.arange(len(names))
        by_rank = np.argsort(rank)
        lead = by_rank[np.minimum.reduceat(rank[nodes], np.append(0, np.cumsum(lengths))[:-1])[sets]] if len(nodes) else nodes
        fits = (nodes != lead) & (np.minimum(sizes[nodes], sizes[lead]) >= threshold * np.maximum(sizes[nodes], sizes[lead]) - 1e-9)
        pair, votes = np.unique(lead[fits] * len(names) + nodes[fits], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(names[pair // len(names)]), pa.array(names[pair % len(names)], pa.int64()), pa.array(votes)], names=["a", "b", "votes"])
        empty = roles[starts] >= 4
        told = empty | (ends - starts >= HOT)
        if told.any():
            n = int(told.sum())
            yield pa.RecordBatch.from_arrays([pa.array(keys[starts[told]].view(np.int64)), pa.nulls(n, pa.int64()), pa.array(np.where(empty, 0, ends - starts)[told].astype(np.int64))], names=["a", "b", "votes"])

    return sent.mapInArrow(run, "a long, b long, votes long")


def crossing(entered: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that an entry brings together, that no component holds yet, and
    whose bitmaps don't show that they differ too much."""
    most = 2_000_000
    slack = (1 - threshold) / (1 + threshold)

    def run(batches):
        got = _lists(batches)
        if got is None:
            return
        _, nodes, roles, starts, ends, names, sizes, comps, bits = got
        maps = Bitmaps(*bits)
        comp = comps[nodes]
        mixed_up = (np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)) & (np.bitwise_or.reduceat(roles, starts) & 3 == 3)
        held: list[np.ndarray] = []
        n, done = 0, np.zeros(0, np.int64)

        def fresh() -> np.ndarray:
            nonlocal done
            pair = np.setdiff1d(np.concatenate(held), done)
            done = np.union1d(done, pair) if len(done) + len(pair) <= 4 * most else pair
            x, y = pair // len(names), pair % len(names)
            return pair[maps.differ(x, y) <= slack * (sizes[x] + sizes[y]) + 1e-9]

        def sent(pair):
            return pa.RecordBatch.from_arrays([pa.array(names[pair // len(names)]), pa.array(names[pair % len(names)])], names=["a", "b"])

        def cross(probe, index):
            nonlocal n
            for a in range(0, len(probe), max(1, 1_000_000 // max(len(index), 1))):
                part = probe[a : a + max(1, 1_000_000 // max(len(index), 1))]
                x, y = np.repeat(part, len(index)), np.tile(index, len(part))
                ok = (comps[x] != comps[y]) & ((sizes[x] < sizes[y]) | ((sizes[x] == sizes[y]) & (x != y))) & (sizes[x] >= threshold * sizes[y] - 1e-9)
                if ok.any():
                    held.append(np.unique(np.minimum(x[ok], y[ok]) * len(names) + np.maximum(x[ok], y[ok])))
                    n += len(held[-1])
                if n > most:
                    yield sent(fresh())
                    held.clear()
                    n = 0

        for s, e in zip(starts[mixed_up].tolist(), ends[mixed_up].tolist()):
            own, role = nodes[s:e], roles[s:e]
            # the largest component's nodes needn't meet each other
            names_, count = np.unique(comps[own], return_counts=True)
            major = comps[own] == names_[count.argmax()]
            index, probe = role & 1 > 0, role & 2 > 0
            yield from cross(own[probe & ~major], own[index])
            yield from cross(own[probe & major], own[index & ~major])
        if held:
            yield sent(fresh())

    return entered.mapInArrow(run, "a long, b long").distinct()


# ---- step 3: verification and groups ---------------------------------------


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    one = np.concatenate([x, y])
    one.sort()
    common = int((one[1:] == one[:-1]).sum())
    return common / max(len(one) - common, 1)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold, with ``jaccard``.

    The pairs are sent to the sets while they are few, so that only the sets
    that some pair names move; beyond that they are joined.
    """
    pairs = saved(pairs.select("a", "b"))
    few = F.broadcast if pairs.count() <= broadcast_rows else lambda df: df
    right = sets.select(F.col("tid").alias("b"), F.col("grams").alias("y")).join(few(pairs), "b")
    left = sets.select(F.col("tid").alias("a"), F.col("grams").alias("x")).join(few(pairs.select("a").distinct()), "a", "left_semi")
    both = right.join(left, "a").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            x, xo = buffers_of(batch.column(2))
            y, yo = buffers_of(batch.column(3))
            score = np.array([_jaccard(x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]]) for i in range(len(batch))])
            ok = score >= threshold - 1e-12
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok)), pa.array(score[ok])], names=["a", "b", "jaccard"])

    return both.mapInArrow(run, "a long, b long, jaccard double")


def verified_at_components(pairs: DataFrame, sets: DataFrame, comp: DataFrame, threshold: float, cut: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same for many pairs between components: no set is moved once a pair.

    A set that is near a dense group makes a pair with each of its sets.  So the
    pairs go to buckets by the larger component of the two (and a tile of its
    sets), and a set goes once to each part of a bucket in which some pair names it.
    """
    known = saved(sets.select("tid", "size").join(comp, "tid"))
    sized = known.groupBy("comp").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / TILE_GRAMS).alias("tiles"))
    of = saved(known.join(sized, "comp").select("tid", F.struct("n", "comp").alias("rank"), F.pmod(F.xxhash64("comp", F.pmod(F.xxhash64("tid"), F.col("tiles"))), F.lit(cut)).cast("int").alias("bucket")))
    a, b = (of.select(F.col("tid").alias(k), F.col("rank").alias(f"{k}_rank"), F.col("bucket").alias(f"{k}_bucket")) for k in ("a", "b"))
    larger = F.col("a_rank") > F.col("b_rank")
    met = saved(pairs.select("a", "b").join(a, "a").join(b, "b").select(F.when(larger, F.col("a_bucket")).otherwise(F.col("b_bucket")).alias("bucket"), "a", "b", F.when(larger, F.col("b")).otherwise(F.col("a")).alias("other")))
    dealt = saved(in_parts(met, known.select("tid", "size")))
    named = saved(dealt.select("bucket", "part", F.col("a").alias("tid")).union(dealt.select("bucket", "part", "b")).distinct())
    few = F.broadcast if named.count() <= broadcast_rows else lambda df: df
    held = sets.select("tid", "grams").join(few(named), "tid").select("bucket", "part", "tid", "grams")

    def meet(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        x, y = pairs["a"].to_numpy(), pairs["b"].to_numpy()
        tid = sets["tid"].to_numpy()
        grams = [g for chunk in sets["grams"].chunks for data, offsets in [buffers_of(chunk)] for g in np.split(data, offsets[1:-1])]
        order = np.argsort(tid)
        i, j = (order[np.searchsorted(tid[order], v)] for v in (x, y))
        score = np.array([_jaccard(grams[p], grams[q]) for p, q in zip(i.tolist(), j.tolist())], dtype=float)
        ok = score >= threshold - 1e-12
        return pa.table({"a": x[ok], "b": y[ok], "jaccard": score[ok]})

    return dealt.groupBy("bucket", "part").cogroup(held.groupBy("bucket", "part")).applyInArrow(meet, "a long, b long, jaccard double")


def in_parts(met: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs (bucket, a, b, other) with ``part``: a task holds the sets of a part at once.

    The sets of the larger components are spread over the buckets, but a bucket
    gets every other set that is near one of its own, and those grow with the
    pairs.  They are cut into parts of about ``BUCKET_BYTES``.
    """
    others = met.select("bucket", F.col("other").alias("tid")).distinct().join(sizes, "tid")
    parts = others.groupBy("bucket").agg(F.ceil(F.sum("size") * 8 / BUCKET_BYTES).cast("int").alias("parts"))
    return met.join(F.broadcast(parts), "bucket").select("bucket", F.pmod(F.xxhash64("other", F.lit(1)), "parts").cast("int").alias("part"), "a", "b")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``tid, comp``: the least node of each node's connected component.

    Every round each node takes the least label among its neighbours' and then
    the label of its label, so that the rounds grow with the logarithm of the
    longest path.  Rounds are cut by writing to the shared folder.
    """
    spark = nodes.sparkSession
    links = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    alone = nodes.select("tid").join(links.select(F.col("a").alias("tid")), "tid", "left_anti").select("tid", F.col("tid").alias("comp"))
    labels = links.groupBy(F.col("a").alias("tid")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    while True:
        labels = saved(labels)
        low = links.join(labels.withColumnRenamed("tid", "b"), "b").groupBy(F.col("a").alias("tid")).agg(F.min("comp").alias("low"))
        step = labels.join(low, "tid").select("tid", "comp", F.least("comp", "low").alias("new"))
        jump = labels.select(F.col("tid").alias("new"), F.col("comp").alias("further"))
        after = saved(step.join(jump, "new", "left").select("tid", F.col("comp").alias("old"), F.least("new", F.coalesce("further", "new")).alias("comp")))
        labels = after.select("tid", "comp")
        if not after.where("old != comp").limit(1).count():
            return alone.unionByName(labels)


# ---- step 4: links ---------------------------------------------------------


def _common(x: np.ndarray, xr: np.ndarray, nx: int, y: np.ndarray, yr: np.ndarray, ny: int) -> np.ndarray:
    """Shared n-grams of every pair of two blocks of sets (their n-grams and row numbers)."""
    ux, cx = np.unique(x, return_counts=True)
    uy, cy = np.unique(y, return_counts=True)
    shared, i, j = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
    if not len(shared):
        return np.zeros((nx, ny), np.int64)
    at, bt = (np.minimum(np.searchsorted(shared, v), len(shared) - 1) for v in (x, y))
    a, b = shared[at] == x, shared[bt] == y
    at, xr, bt, yr = at[a], xr[a], bt[b], yr[b]
    if 100 * float(cx[i] @ cy[j]) < float(nx) * ny * len(shared):
        # few n-grams meet: count them one by one
        order, begin = np.argsort(bt, kind="stable"), np.append(0, np.cumsum(cy[j]))
        out = np.zeros(nx * ny, np.int64)
        times = cy[j][at]
        ends = np.append(0, np.cumsum(times))
        for a, b in slices(ends, 4_000_000):
            other = yr[order[np.repeat(begin[at[a:b]], times[a:b]) + _within(times[a:b])]]
            out += np.bincount(np.repeat(xr[a:b], times[a:b]) * ny + other, minlength=nx * ny)
        return out.reshape(nx, ny)
    out = np.zeros((nx, ny), np.float32)
    for k in range(0, len(shared), 4096):
        wide = min(4096, len(shared) - k)
        p, q = np.zeros((nx, wide), np.float32), np.zeros((ny, wide), np.float32)
        a, b = (at >= k) & (at < k + wide), (bt >= k) & (bt < k + wide)
        p[xr[a], at[a] - k] = 1
        q[yr[b], bt[b] - k] = 1
        out += p @ q.T
    return np.rint(out).astype(np.int64)


def tile_links(grams: np.ndarray, rows: np.ndarray, copies: np.ndarray, side: np.ndarray, threshold: float, block: int = 1024) -> np.ndarray:
    """Per set, the copies of the sets that it is linked with.

    With two values in ``side`` only pairs across them count, else all pairs.
    """
    size = np.diff(rows)
    out = np.zeros(len(size), np.int64)
    cross = side.min() != side.max()
    parts = [np.flatnonzero(side == v) for v in ((side.min(), side.max()) if cross else (side[0],))]
    blocks = []
    for part in parts:
        part = part[np.argsort(size[part], kind="stable")]
        blocks.append([part[k : k + block] for k in range(0, len(part), block)])

    def held(of):
        return grams[np.repeat(rows[of], size[of]) + _within(size[of])], np.repeat(np.arange(len(of)), size[of])

    for p, x in enumerate(blocks[0]):
        own = None
        for q, y in enumerate(blocks[-1]):
            if (not cross and q < p) or size[x[-1]] < threshold * size[y[0]] - 1e-9 or size[y[-1]] < threshold * size[x[0]] - 1e-9:
                continue
            own = held(x) if own is None else own
            same = not cross and p == q
            common = _common(*own, len(x), *(own if same else held(y)), len(y))
            linked = common / np.maximum(size[x][:, None] + size[y][None, :] - common, 1) >= threshold - 1e-12
            if same:
                np.fill_diagonal(linked, False)
            out[x] += linked @ copies[y]
            if not same:
                out[y] += copies[x] @ linked
    return out


def link_counts(sets: DataFrame, comp: DataFrame, copies: DataFrame, threshold: float, cut: int, broadcast_rows: int) -> DataFrame:
    """``tid, linked``: the rows (``copies`` a node) whose other texts reach the threshold."""
    known = saved(sets.select("tid", "size").join(comp, "tid").join(copies, "tid"))
    tiles = F.greatest(F.ceil(F.count("*") / TILE_SETS), F.ceil(F.sum("size") / TILE_GRAMS)).cast("int")
    several = known.groupBy("comp").agg(F.count("*").alias("n"), tiles.alias("tiles")).where("n > 1")
    placed = known.join(several, "comp").withColumn("side", F.pmod(F.xxhash64("tid"), F.col("tiles")).cast("int"))
    dealt = placed.select("tid", "comp", "copies", "side", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = saved(dealt.select("tid", "comp", "copies", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")))
    few = F.broadcast if dealt.count() <= broadcast_rows else lambda df: df
    given = sets.select("tid", "grams").join(few(dealt), "tid").repartition(cut, "comp", "i", "j").sortWithinPartitions("comp", "i", "j")

    def run(batches):
        held, key = [], None

        def told():
            side = np.concatenate([h[2] for h in held])
            # a tile without sets has no pairs with another
            if key[1] == key[2] or side.min() != side.max():
                rows = np.append(0, np.cumsum(np.concatenate([np.diff(h[4]) for h in held])))
                tid = np.concatenate([h[0] for h in held])
                linked = tile_links(np.concatenate([h[3] for h in held]), rows, np.concatenate([h[1] for h in held]), side, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(tid[linked > 0]), pa.array(linked[linked > 0])], names=["tid", "linked"])

        for batch in batches:
            tid, copies, side, comp, i, j = (batch.column(k).to_numpy() for k in (0, 3, 4, 2, 5, 6))
            data, offsets = buffers_of(batch.column(1))
            new = np.flatnonzero((comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(tid)]):
                now = comp[a], i[a], j[a]
                if now != key and held:
                    yield from told()
                    held.clear()
                key = now
                held.append((tid[a:b], copies[a:b], side[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1]))
        if held:
            yield from told()

    order = given.select("tid", "grams", "comp", "copies", "side", "i", "j")
    return order.mapInArrow(run, "tid long, linked long").groupBy("tid").agg(F.sum("linked").alias("linked"))


def groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = 500_000, tries: int = 1) -> DataFrame:
    """The groups of the exact join: see the module.  Only the result's table is kept."""
    return members(docs, n, threshold, text, doc_id, broadcast_rows, hot_rows, tries, True).select("doc_id", "group_id", "partner_id", "jaccard", "links")


def members(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = 500_000, tries: int = 1, count: bool = False) -> DataFrame:
    """The groups with ``tid``, the hash of the text that is meant, and ``head``.

    Only with ``count`` are links counted (``links`` is null else).  The head of a group is one text of its least id: the one of the least hash.
    """
    spark = tuned(docs.sparkSession)
    with scratch(spark):
        return saved(_groups(spark, docs, n, threshold, text, doc_id, broadcast_rows, hot_rows, tries, count), keep=True)


def _groups(spark, docs: DataFrame, n: int, threshold: float, text: str, doc_id: str, broadcast_rows: int, hot_rows: int, tries: int, count: bool) -> DataFrame:
    body = column(docs, text).cast("string")
    rows = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("tid"), body.alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))
    held = saved(rows.select("doc_id", "tid", F.octet_length("text").cast("long").alias("bytes")))
    ids = held.select("doc_id", "tid")
    # a word of about five bytes has one n-gram of four
    found = survivors(rows.select("tid", "text"), n, threshold, ways(spark, held.agg(F.sum("bytes")).head()[0] or 0, BUCKET_BYTES))
    # each node's text is read from the rows of its least id; if these are several, they are made one
    first_row = ids.groupBy("tid", "doc_id").count().groupBy("tid").agg(F.min_by(F.struct("doc_id", "count"), "doc_id").alias("r"))
    kept = saved(found.join(first_row, "tid").select(F.xxhash64("r.doc_id", "tid").alias("__key"), (F.col("r.count") > 1).alias("many")))
    chosen = joined(rows, F.xxhash64("doc_id", "tid"), kept, "inner", broadcast_rows)
    every = node_sets(chosen.select("tid", "text", "many"), n)
    if kept.where("many").limit(1).count():
        every = saved(every)
        every = every.where("not many").unionByName(every.where("many").dropDuplicates(["tid"]))
    sets = saved(every.drop("many"))
    # an n-gram makes one entry of 13 bytes, or a little more
    cut = ways(spark, 16 * (sets.agg(F.sum("size")).head()[0] or 0), BUCKET_BYTES)

    # dense groups: one verified partner each
    near = saved(leaders(_send_entries(sets.withColumn("comp", F.col("tid")), threshold, cut), threshold))
    order = Window.partitionBy("b").orderBy(F.desc("votes"), "a")
    best = near.where("b is not null").groupBy("a", "b").agg(F.sum("votes").alias("votes")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= tries).select("a", "b")
    first = saved(verified(best, sets, threshold))
    comp = saved(components(sets.select("tid"), first))
    hot = near.where("b is null and votes > 0").orderBy(F.desc("votes"), "a").limit(hot_rows).select("a", "votes").toPandas()
    keys = hot["a"].to_numpy(dtype=np.int64).view(U64)
    by_key = np.argsort(keys)
    # at most the segments of all bands: their number follows the longest text, not the rows
    empty = np.sort(near.where("b is null and votes = 0").select("a").distinct().toPandas()["a"].to_numpy(dtype=np.int64).view(U64))
    table = spark.sparkContext.broadcast((keys[by_key], hot["votes"].to_numpy(dtype=np.int64)[by_key], empty))

    # everything else
    rest = crossing(_send_entries(sets.join(comp, "tid"), threshold, cut, table), threshold)
    second = saved(verified_at_components(rest, sets, comp, threshold, cut, broadcast_rows))
    edges = first.unionByName(second)
    comp = saved(components(sets.select("tid"), edges))

    # back to documents
    other = edges.union(edges.select("b", "a", "jaccard")).groupBy(F.col("a").alias("tid")).agg(F.max_by("b", F.struct("jaccard", -F.col("b"))).alias("mate"), F.max("jaccard").alias("jaccard"))
    texts = ids.groupBy("tid").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.countDistinct("doc_id").alias("copies"))
    met = link_counts(sets, comp, texts.select("tid", "copies"), threshold, cut, broadcast_rows) if count else comp.select("tid", F.lit(None).cast("long").alias("linked"))
    links = F.coalesce("linked", F.lit(0)) + F.col("copies") - 1 if count else F.col("linked")
    named = texts.join(comp, "tid", "left").join(other, "tid", "left").join(met, "tid", "left").select("tid", "low", "high", "copies", F.coalesce("comp", "tid").alias("comp"), "mate", "jaccard", links.alias("links"))
    mates = named.join(texts.select(F.col("tid").alias("mate"), F.col("low").alias("mate_low")), "mate", "left")
    heads = named.groupBy("comp").agg(F.min("low").alias("group_id"), F.min(F.struct("low", "tid"))["tid"].alias("head_tid"), F.sum("copies").alias("all"))
    listed = mates.join(heads.where("`all` > 1"), "comp").select("tid", "low", "high", "group_id", "head_tid", "mate_low", "jaccard", "links")
    copied = F.col("low") != F.col("high")
    return ids.distinct().join(listed, "tid").select(
        "doc_id",
        "group_id",
        F.when(F.col("doc_id") != F.col("low"), F.col("low")).when(copied, F.col("high")).otherwise(F.col("mate_low")).alias("partner_id"),
        F.when(copied, 1.0).otherwise(F.col("jaccard")).alias("jaccard"),
        "links",
        "tid",
        ((F.col("doc_id") == F.col("group_id")) & (F.col("tid") == F.col("head_tid"))).alias("head"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Groups and links of near copies among all documents: word trigrams, Jaccard 0.6."""
    return groups(spread(tuned(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def stage(spark, docs: DataFrame, sf_dir: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pipeline stage: of each group only one text of the least id stays.

    Rows go by id and text: where an id stands on several texts, those in no
    group stay.  Rows that repeat the head, rows without an id, and documents
    in no group, all stay.
    """
    named, (doc_id, text) = by_place(docs, "doc_id", "text")
    gone = members(named, doc_id=doc_id, text=text, broadcast_rows=broadcast_rows).where("not head").select(F.xxhash64("doc_id", "tid").alias("__key"))
    own = column(named, doc_id).cast("long")
    key = F.when(own.isNotNull(), F.xxhash64(own, F.xxhash64(column(named, text).cast("string"))))
    return joined(named, key, gone, "left_anti", broadcast_rows).toDF(*docs.columns)
