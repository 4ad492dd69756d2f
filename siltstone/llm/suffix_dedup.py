"""Repeated passages by suffix arrays of document collections.

A passage is a run of at least ``least`` (50) words that also occurs in
another document.  All of them are found, exactly:

1. Anchors.  Of every 50 consecutive words the 25-word run with the least hash
   is an anchor, so equal passages have an equal anchor at the same place.
   Anchors that occur in one document only are dropped.
2. Windows.  The words around an anchor that a passage holding it can reach
   (25 before, 50 from its start on) form a window.  Equal windows of an anchor
   are one text of a collection, with a list of the places where it stands.
3. The suffix array, Burrows-Wheeler transform and longest common prefixes of a
   collection of windows are built column by column: each round takes one more
   symbol of every text, from the right, and makes the arrays of the longer
   suffixes from those of the round before, read in sequence.  Neighbours in
   suffix order with a common prefix of 50 words or more are equal passages.
4. Passages of a document are merged into spans.

The first place of a passage (least id, then position) is kept; the others are
cut.  Where passages overlap, words that any of them cuts go.

Scale: collections hold at most ``CHUNK`` windows.  An anchor with more of them
is cut into several collections, whose classes of equal passages are then
joined by hash, so nothing is missed and no collection grows with the data.
Cuts are sent to the texts while no more than ``broadcast_rows`` texts have
any; beyond that a filter of bounded size is, and only the texts that it lets
through are shuffled.
A collection is a few MB, so its columns are kept in memory, one array after
another, where the published method keeps them in files: a folder of the
machine wouldn't survive it, and a shared one would be read every round.

Defined results
---------------
* Words are runs of characters other than ASCII white space, compared exactly
  (by 64-bit hashes).
* Null and empty texts and those of fewer words than ``least`` have no
  passages.  Rows with a null id take no part.
* Rows with equal id and text are one document; rows with equal id and
  different texts are documents of their own.
* Result columns: ``doc_id, start_word, end_word, cut``: the spans of all
  passages (``cut`` false), and the parts of them that are cut (true).  Other
  columns don't pass.  Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from .frames import BROADCAST_ROWS, by_bucket, by_place, column, joined, partitions, saved, scratch, tuned
from .ngram_join import _batches, _bucket_of, _gathered, _spread
from .textarrays import SPACE, _powers, buffers, mix, slices, words

LEAST = 50
CHUNK = 800
U64 = np.uint64
TOP = U64(0xFFFFFFFFFFFFFFFF)


# ---- anchors ---------------------------------------------------------------


def _sliding(values: np.ndarray, width: int, op, fill) -> np.ndarray:
    """``op`` over each ``width`` values from a place on; ``fill`` past the end."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = op(out, np.append(out[step:], np.full(min(step, len(out)), fill, out.dtype))[: len(out)])
        reach += step
    return out


def raw_words(data, offsets):
    return words(data, offsets, ~SPACE, fold=False)


def prefix_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(len(hashes) + 1)
    prefix = np.zeros(len(hashes) + 1, dtype=U64)
    np.cumsum(hashes * power[:-1], out=prefix[1:])
    return prefix, inverse


def anchors(hashes: np.ndarray, rows: np.ndarray, least: int):
    """Owner, place, hash, window hash, words before and from there, of all anchors."""
    k = least // 2
    span = least - k + 1
    total = len(hashes)
    prefix, inverse = prefix_hash(hashes)
    at = np.arange(total)
    end = np.repeat(rows[1:], np.diff(rows))
    gram = np.full(total, TOP)
    full = np.flatnonzero(at + k <= end)
    gram[full] = mix((prefix[full + k] - prefix[full]) * inverse[full]) >> U64(1)
    low = _sliding(gram, span, np.minimum, TOP)
    low[at + least > end] = 0
    best = _sliding(low[::-1], span, np.maximum, U64(0))[::-1]
    # windows that begin in the row before can't reach here: their least is of their own row
    chosen = np.flatnonzero((best == gram) & (gram != TOP))
    begin = np.repeat(rows[:-1], np.diff(rows))[chosen]
    lead = np.minimum(chosen - begin, least - k)
    tail = np.minimum(end[chosen] - chosen, least)
    a, b = chosen - lead, chosen + tail
    window = mix((prefix[b] - prefix[a]) * inverse[a] + (lead * (1 << 20) + tail).astype(U64))
    owner = np.searchsorted(rows, chosen, side="right") - 1
    return owner, chosen - begin, gram[chosen], window, lead, tail


# ---- the collection's arrays -----------------------------------------------


def suffix_arrays(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all suffixes in order: text, offset, and common prefix with the one before.

    Every text ends in its own least symbol, in the order of the texts.
    """
    w = len(texts)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    _, code = np.unique(np.concatenate([*texts, np.zeros(0, U64)]), return_inverse=True)
    # text i has size + 1 places, the last of them its end mark
    place0 = np.concatenate([[0], np.cumsum(size + 1)])
    text_of = np.repeat(np.arange(w), size + 1)
    left = np.zeros(int(place0[-1]), dtype=np.uint16 if len(code) < 65535 else np.int64)
    left[np.arange(len(code)) + np.repeat(np.arange(w), size) + 1] = code + 1
    left[place0[:-1]] = 0
    suffix = place0[1:] - 1  # the end marks, in the order of the texts
    # common prefixes are no longer than the longest text
    kind = np.uint8 if size.max(initial=0) < 255 else np.int32
    common = np.zeros(w, dtype=kind)
    for _ in range(int(size.max(initial=0))):
        bwt = left[suffix]
        order = np.argsort(bwt, kind="stable")
        order = order[int((bwt == 0).sum()) :]
        if not len(order):
            break
        same = bwt[order[1:]] == bwt[order[:-1]]
        lo, hi = order[:-1][same] + 1, order[1:][same]
        width = hi - lo + 1
        level = np.frexp(width.astype(np.float64))[1] - 1
        least = np.zeros(len(lo), dtype=kind)
        table = common
        for k in range(int(level.max(initial=0)) + 1):
            at = np.flatnonzero(level == k)
            least[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k) + 1])
            if len(table) > 1 << k:
                table = np.minimum(table[: -(1 << k)], table[1 << k :])
        longer = np.zeros(len(order), dtype=kind)
        longer[1:][same] = least + 1
        suffix = np.concatenate([place0[1:] - 1, suffix[order] - 1])
        common = np.concatenate([np.zeros(w, kind), longer])
    return text_of[suffix], suffix - place0[text_of[suffix]], common


def passages(texts: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, text and offset of every run of ``least`` words of the texts.

    Runs have one class where their words are equal.
    """
    text, offset, common = suffix_arrays(texts)
    cls = np.cumsum(common < least)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    long = offset + least <= size[text]
    return cls[long], text[long], offset[long]


# ---- spans -----------------------------------------------------------------


def merge_spans(owner: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Unites overlapping spans of an owner (small numbers); sorted by owner, start."""
    if not len(owner):
        return owner, start, end
    big = np.int64(1) << 40
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    reach = np.maximum.accumulate(owner * big + end)
    fresh = np.append(True, owner[1:] * big + start[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    return owner[first], start[first], np.append(reach[first[1:] - 1], reach[-1]) - owner[first] * big


def _runs(text, offset, low_doc, low_at, least):
    """Runs of consecutive offsets of a text whose first places also follow each other."""
    order = np.lexsort((offset, text))
    text, offset, doc, at = text[order], offset[order], low_doc[order], low_at[order]
    new = np.append(True, (text[1:] != text[:-1]) | (offset[1:] != offset[:-1] + 1) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text)) - 1
    return text[first], offset[first], offset[last] + least, doc[first], at[first]


def resolve(keys, window, uid, doc, place, lead, tail, contents: dict, least: int):
    """Spans of all places: uid, doc, start, end, cut.  Places are sorted by key, window."""
    new = np.append(True, (keys[1:] != keys[:-1]) | (window[1:] != window[:-1]))
    first = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    zero = place - lead  # the document's word where the window begins
    order = np.lexsort((zero, uid, doc, number))
    head = order[np.flatnonzero(np.append(True, number[order][1:] != number[order][:-1]))]
    least_uid, most_uid = np.minimum.reduceat(uid, first), np.maximum.reduceat(uid, first)
    wkey, wname, wsize = keys[first], window[first], (lead + tail)[first]
    low_doc, low_at, low_uid = doc[head], zero[head], uid[head]
    key_start = np.flatnonzero(np.append(True, wkey[1:] != wkey[:-1]))
    key_count = np.diff(np.append(key_start, len(wkey)))
    cls_all, text_all, off_all = [], [], []
    shift = 0
    # an anchor with one window: each of its passages is a class of its own
    lone = np.repeat(key_count == 1, key_count) & (wsize >= least)
    runs = np.where(lone, wsize - least + 1, 0)
    if runs.any():
        text = np.repeat(np.arange(len(runs)), runs)
        off = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
        cls_all.append(np.arange(len(text)))
        text_all.append(text)
        off_all.append(off)
        shift = len(text)
    # the others in collections, an anchor's windows together
    pending: list[int] = []

    def collect(held: list[int]):
        nonlocal shift
        cls, text, off = passages([contents[int(wkey[i]), int(wname[i])] for i in held], least)
        cls_all.append(cls + shift)
        text_all.append(np.array(held, dtype=np.int64)[text])
        off_all.append(off)
        shift += int(cls.max(initial=0)) + 1

    for s, n in zip(key_start.tolist(), key_count.tolist()):
        if n == 1:
            continue
        if n > CHUNK:
            mark = len(cls_all)
            for a in range(s, s + n, CHUNK):
                collect(list(range(a, min(a + CHUNK, s + n))))
            # classes of the several collections, joined by their words' hash
            text, off = np.concatenate(text_all[mark:]), np.concatenate(off_all[mark:])
            name = np.zeros(len(text), dtype=U64)
            by_text = np.argsort(text, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(text[by_text]) > 0)) if len(text) else []
            for part in np.split(by_text, cuts[1:]) if len(text) else []:
                prefix, inverse = prefix_hash(contents[int(wkey[text[part[0]]]), int(wname[text[part[0]]])])
                name[part] = (prefix[off[part] + least] - prefix[off[part]]) * inverse[off[part]]
            _, cls = np.unique(name, return_inverse=True)
            cls_all[mark:], text_all[mark:], off_all[mark:] = [cls + shift], [text], [off]
            shift += len(cls)
            continue
        if len(pending) + n > CHUNK:
            collect(pending)
            pending = []
        pending += range(s, s + n)
    if pending:
        collect(pending)
    none = np.zeros(0, np.int64)
    cls, text, off = (np.concatenate([*x, none]).astype(np.int64) for x in (cls_all, text_all, off_all))
    if not len(cls):
        return none, none, none, none, np.zeros(0, bool)
    order = np.lexsort((low_at[text] + off, low_uid[text], low_doc[text], cls))
    cls, text, off = cls[order], text[order], off[order]
    start = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
    count = np.diff(np.append(start, len(cls)))
    several = np.minimum.reduceat(least_uid[text], start) != np.maximum.reduceat(most_uid[text], start)
    keep = np.repeat(several, count)
    if not keep.any():
        return none, none, none, none, np.zeros(0, bool)
    first_uid = np.repeat(low_uid[text[start]], count)[keep]
    first_at = np.repeat((low_at[text] + off)[start], count)[keep]
    text, begin, finish, first_uid, first_at = _runs(text[keep], off[keep], first_uid, first_at, least)
    # every place of a window has all its runs
    sizes = np.bincount(number, minlength=len(first))
    each = sizes[text]
    run = np.repeat(np.arange(len(text)), each)
    hit = np.repeat(first[text], each) + np.arange(len(run)) - np.repeat(np.cumsum(each) - each, each)
    cut = (uid[hit] != first_uid[run]) | (zero[hit] + begin[run] != first_at[run])
    return uid[hit], doc[hit], zero[hit] + begin[run], zero[hit] + finish[run], cut


def _doc_rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    body = column(docs, text).cast("string")
    return docs.select(column(docs, doc_id).cast("long").alias("doc_id"), F.xxhash64(column(docs, doc_id).cast("long"), body).alias("uid"), body.alias("text")).where("doc_id is not null and text is not null")


def spans(docs: DataFrame, least: int = LEAST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``uid, doc_id, start_word, end_word, cut``: see the module."""
    spark = tuned(docs.sparkSession)
    cut = partitions(spark)
    rows = _doc_rows(docs, text, doc_id)
    HIT = "bucket int, keys binary, windows binary, uids binary, docs binary, places binary, leads binary, tails binary"
    names = [x.split()[0] for x in HIT.split(", ")]
    short = np.uint8 if least < 256 else np.int32
    kinds = [np.uint64, np.uint64, np.int64, np.int64, np.int32, short, short]

    def send(batches):
        for batch in batches:
            doc, uid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = buffers(batch.column(2))
            for i, j in slices(offsets):
                hashed, _, _, rowed = raw_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                owner, place, gram, window, lead, tail = anchors(hashed, rowed, least)
                owner = owner + i
                out = []
                for b, (k, w, o, p, x, y) in _spread(_bucket_of(mix(gram), cut), cut, gram, window, owner, place.astype(np.int32), lead.astype(short), tail.astype(short)):
                    out.append((b, k.tobytes(), w.tobytes(), uid[o].tobytes(), doc[o].tobytes(), p.tobytes(), x.tobytes(), y.tobytes()))
                if out:
                    yield _batches(out, names, [pa.int32(), *[pa.binary()] * 7])

    def shared(batches):
        batches = list(batches)
        if not batches:
            return
        key, *rest = _gathered(batches, *kinds)
        bucket = batches[0].column(0)[0].as_py()
        del batches
        order = np.lexsort((rest[0], key))
        key, rest = key[order], [r[order] for r in rest]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(start, len(key)))
        keep = np.repeat(np.minimum.reduceat(rest[1], start) != np.maximum.reduceat(rest[1], start), count)
        key, rest = key[keep], [r[keep] for r in rest]
        # in parts of whole anchors, so that no row is long
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1 if len(key) else []
        a = 0
        while a < len(key):
            b = int(ends[min(np.searchsorted(ends, a + 200_000), len(ends) - 1)])
            yield _batches([(bucket, key[a:b].tobytes(), *(r[a:b].tobytes() for r in rest))], names, [pa.int32(), *[pa.binary()] * 7])
            a = b

    hits = saved(by_bucket(rows.mapInArrow(send, HIT), cut).mapInArrow(shared, HIT))

    def wanted(batches):
        """One place of each window of the anchors that have several windows."""
        for batch in batches:
            for r in range(len(batch)):
                key, window, uid, _, place, lead, tail = _gathered([batch.slice(r, 1)], *kinds)
                new = np.append(True, (key[1:] != key[:-1]) | (window[1:] != window[:-1]))
                first = np.flatnonzero(new)
                k = key[first]
                begin = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                first = first[np.repeat(np.diff(np.append(begin, len(k))) > 1, np.diff(np.append(begin, len(k))))]
                n = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(uid[first]), pa.array(key[first].view(np.int64)), pa.array(window[first].view(np.int64)), pa.array(place[first] - lead[first].astype(np.int32)), pa.array(lead[first].astype(np.int32) + tail[first]), pa.array(np.full(n, batch.column(0)[r].as_py(), np.int32))], names=["uid", "key", "name", "start", "size", "bucket"])

    asked = hits.mapInArrow(wanted, "uid long, key long, name long, start int, size int, bucket int")
    asked = asked.groupBy("uid").agg(F.collect_list(F.struct("key", "name", "start", "size", "bucket")).alias("asked"))
    held = rows.select("uid", "text").join(asked, "uid")
    WINDOW = "bucket int, keys binary, windows binary, sizes binary, words binary"

    def fetch(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            lists = batch.column(2)
            for i, j in slices(offsets):
                hashed, _, _, rowed = raw_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                part = lists.slice(i, j - i)
                flat = part.flatten()
                key, name, start, size, bucket = (flat.field(c).to_numpy() for c in range(5))
                start = start + np.repeat(rowed[:-1], part.value_lengths().to_numpy())
                out = []
                for b, (k, w, s, z) in _spread(bucket.astype(np.int64), cut, key, name, start, size):
                    at = np.repeat(s, z) + np.arange(z.sum()) - np.repeat(np.cumsum(z) - z, z)
                    out.append((b, k.tobytes(), w.tobytes(), z.astype(np.int32).tobytes(), hashed[at].tobytes()))
                if out:
                    yield _batches(out, ["bucket", "keys", "windows", "sizes", "words"], [pa.int32(), *[pa.binary()] * 4])

    windows = held.mapInArrow(fetch, WINDOW)
    both = hits.select("*", *[F.lit(None).cast("binary").alias(c) for c in ("sizes", "words")]).unionByName(windows, allowMissingColumns=True)
    SPAN = "bucket int, uids binary, docs binary, starts binary, ends binary, cuts binary"

    def solve(batches):
        parts, contents = [], {}
        for batch in batches:
            for r in range(len(batch)):
                if batch.column(8)[r].is_valid:
                    k, w, z, x = (np.frombuffer(batch.column(c)[r].as_buffer(), dtype=d) for c, d in ((1, U64), (2, U64), (8, np.int32), (9, U64)))
                    ends = np.cumsum(z)
                    for a, b, e, s in zip(k.tolist(), w.tolist(), ends.tolist(), z.tolist()):
                        contents[a, b] = x[e - s : e].copy()
                else:
                    parts.append(_gathered([batch.slice(r, 1)], *kinds))
        for key, window, uid, doc, place, lead, tail in parts:
            uid, doc, start, end, gone = resolve(key, window, uid, doc, place.astype(np.int64), lead.astype(np.int64), tail.astype(np.int64), contents, least)
            out = [(b, u.tobytes(), d.tobytes(), s.astype(np.int32).tobytes(), e.astype(np.int32).tobytes(), g.tobytes()) for b, (u, d, s, e, g) in _spread(_bucket_of(mix(uid.view(U64)), cut), cut, uid, doc, start, end, gone)]
            if out:
                yield _batches(out, ["bucket", "uids", "docs", "starts", "ends", "cuts"], [pa.int32(), *[pa.binary()] * 5])

    def unite(batches):
        uid, doc, start, end, gone = _gathered(batches, np.int64, np.int64, np.int32, np.int32, np.bool_)
        if not len(uid):
            return
        name, first, owner = np.unique(uid, return_index=True, return_inverse=True)
        for flag in (False, True):
            some = gone | (not flag)
            o, s, e = merge_spans(owner[some], start[some].astype(np.int64), end[some].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(name[o]), pa.array(doc[first][o]), pa.array(s), pa.array(e), pa.array(np.full(len(o), flag))], names=["uid", "doc_id", "start_word", "end_word", "cut"])

    solved = by_bucket(by_bucket(both, cut).mapInArrow(solve, SPAN), cut)
    return solved.mapInArrow(unite, "uid long, doc_id long, start_word long, end_word long, cut boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """All passages of 50 words or more that documents share."""
    return spans(spread(tuned(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))).drop("uid")


def cut_words(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the words of the given spans and the space after them."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    _, begin, _, rows = raw_words(data, np.array([0, len(data)]))
    begin = np.append(begin, len(data))
    keep = np.ones(len(data), dtype=bool)
    for s, e in zip(starts, ends):
        keep[begin[s] : begin[min(e, len(begin) - 1)]] = False
    return data[keep].tobytes().decode("utf-8", "surrogatepass").rstrip() if not keep.all() else text


def without_passages(docs: DataFrame, least: int = LEAST, text: str = "text", doc_id: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents with all but the first place of each passage cut.

    ``n_chars`` follows the text; a document of which no word is left goes.
    Columns and all other rows stay as they are.
    """
    names = docs.columns
    docs, (text, doc_id, n_chars) = by_place(docs, text, doc_id, "n_chars")
    if not text:
        return docs.toDF(*names)
    with scratch(docs.sparkSession):
        found = spans(docs, least, text, doc_id).where("cut")
        # a row for each text with cuts; their number bounds what is sent to the texts
        by_doc = saved(found.groupBy(F.col("uid").alias("__key")).agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("cuts")), keep=True)
    fields = docs.schema.fields
    body = column(docs, text).cast("string")
    keyed = docs.select("*", F.when(column(docs, doc_id).isNotNull(), F.xxhash64(column(docs, doc_id).cast("long"), body)).alias("uid"))
    cut = joined(keyed, F.col("uid"), by_doc, "left", broadcast_rows).select(*docs.columns, "cuts")
    at = [f.name for f in fields].index(text)
    chars = next((i for i, f in enumerate(fields) if f.name == n_chars), None)

    def run(batches):
        for batch in batches:
            cols = [batch.column(i) for i in range(len(fields))]
            cuts = batch.column(len(fields))
            some = [i for i in range(len(batch)) if cuts[i].is_valid]
            if some:
                texts = cols[at].to_pylist()
                for i in some:
                    spans_ = cuts[i].as_py()
                    texts[i] = cut_words(texts[i], [s["start_word"] for s in spans_], [s["end_word"] for s in spans_])
                cols[at] = pa.array(texts, cols[at].type)
                if chars is not None:
                    sizes = cols[chars].to_pylist()
                    for i in some:
                        sizes[i] = len(texts[i])
                    cols[chars] = pa.array(sizes, cols[chars].type)
                gone = {i for i in some if not texts[i].strip()}
                kept = pa.array([i not in gone for i in range(len(batch))])
                cols = [c.filter(kept) for c in cols]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return cut.mapInArrow(run, T.StructType(fields)).toDF(*names)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: passages that an earlier document has are cut."""
    return without_passages(docs)
