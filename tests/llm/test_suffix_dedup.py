import random

import numpy as np
import pytest

from siltstone.llm import suffix_dedup as S
from siltstone.llm.textarrays import mix


def brute_spans(rows, least):
    """Spans of the words of passages that other documents have, and of those cut."""
    rows = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    held = {}
    for k, (_, t) in enumerate(rows):
        w = t.split()
        for a in range(len(w) - least + 1):
            held.setdefault(tuple(w[a : a + least]), []).append((k, a))
    every, cut = {}, {}
    for places in held.values():
        if len({k for k, _ in places}) > 1:
            first = min(places)
            for k, a in places:
                every.setdefault(k, set()).update(range(a, a + least))
                if (k, a) != first:
                    cut.setdefault(k, set()).update(range(a, a + least))
    out = []
    for words, flag in ((every, False), (cut, True)):
        for k, at in words.items():
            at = sorted(at)
            start = at[0]
            for x, y in zip(at, at[1:] + [None]):
                if y != x + 1:
                    out.append((rows[k][0], start, x + 1, flag))
                    start = y
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(50)]
    shared = [rng.choices(words, k=rng.choice([49, 50, 51, 60, 130])) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += rng.choices(words, k=rng.randrange(60))
            if rng.random() < 0.5:
                parts += rng.choice(shared)
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = S.spans(spark.createDataFrame(rows, "doc_id long, text string")).drop("uid").collect()
    merged = sorted((r["doc_id"], r["start_word"], r["end_word"], r["cut"]) for r in got)
    touching = lambda spans: sorted(_united(spans))
    assert touching(merged) == touching(brute_spans(rows, 50))


def _united(spans):
    """Spans that touch as one: both readings cover the same words."""
    out = []
    for d, s, e, c in sorted(spans, key=lambda x: (x[0], x[3], x[1])):
        if out and out[-1][0] == d and out[-1][3] == c and out[-1][2] >= s:
            out[-1] = (d, out[-1][1], max(e, out[-1][2]), c)
        else:
            out.append((d, s, e, c))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_suffix_arrays_match_sorting(seed):
    rng = random.Random(seed)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(0, 30))] for _ in range(rng.randrange(1, 9))]
    text, offset, common = S.suffix_arrays([mix(np.array(t, dtype=np.uint64)) for t in texts])
    code = {int(mix(np.array([v], dtype=np.uint64))[0]): v for v in range(3)}
    order = {v: r for r, v in enumerate(sorted(code))}
    rank = {code[h]: order[h] + len(texts) for h in code}
    suffixes = sorted(([rank[v] for v in t[a:]] + [i], i, a) for i, t in enumerate(texts) for a in range(len(t) + 1))
    assert [(i, a) for _, i, a in suffixes] == list(zip(text.tolist(), offset.tolist()))
    for (x, _, _), (y, _, _), c in zip(suffixes, suffixes[1:], common[1:].tolist()):
        same = 0
        while same < min(len(x), len(y)) and x[same] == y[same]:
            same += 1
        assert c == same


def test_large_collections_are_joined(spark, monkeypatch):
    """An anchor with more windows than a collection holds."""
    rng = random.Random(9)
    middle = [f"m{k}" for k in range(30)]
    left = [[f"l{rng.randrange(2)}" for _ in range(4)] + [f"c{k}" for k in range(12)] for _ in range(40)]
    rows = [(i, " ".join([f"x{i}"] * 3 + left[i] + middle + [f"d{k}" for k in range(10)] + [f"y{i}"])) for i in range(40)]
    expected = _united(brute_spans(rows, 50))
    windows = [np.array([hash(w) & (2**63 - 1) for w in t.split()], dtype=np.uint64) for _, t in rows]
    # all texts have one anchor: its windows in collections of 7
    monkeypatch.setattr(S, "CHUNK", 7)
    keys = np.zeros(40, np.uint64)
    names = np.arange(40).astype(np.uint64)
    lead = np.full(40, 20, np.int64)
    tail = np.array([len(w) - 20 for w in windows], np.int64)
    uid, doc, start, end, cut = S.resolve(keys, names, np.arange(40), np.arange(40), lead, lead, tail, {(0, i): w for i, w in enumerate(windows)}, 50)
    got = [(int(d), int(s), int(e), f) for d, s, e, c in zip(doc, start, end, cut) for f in ([False, True] if c else [False])]
    assert sorted(_united(got)) == sorted(expected)


def test_first_place_stays_and_others_are_cut(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(2, f"before\n{passage} after"), (1, f"{passage} end"), (3, passage), (4, "clean text"), (5, " ".join(f"q{k}" for k in range(49))), (6, " ".join(f"q{k}" for k in range(49)))]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in S.without_passages(docs).collect()}
    assert set(got) == {1, 2, 4, 5, 6}
    assert got[1]["text"] == rows[1][1] and got[2]["text"] == "before\nafter" and got[2]["n_chars"] == len("before\nafter")
    assert all(got[i]["text"] == dict(rows)[i] for i in (4, 5, 6))


def test_hard_tables(spark, hard_docs, empty_docs):
    got = S.spans(hard_docs).drop("uid").collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3} and {r["doc_id"] for r in got if r["cut"]} == {2, 3}
    assert S.spans(empty_docs).count() == 0
    kept = S.stage(spark, hard_docs, "")
    assert kept.columns == hard_docs.columns
    by_id = {}
    for r in kept.collect():
        by_id.setdefault(r["doc_id"], []).append(r)
    assert len(by_id[1]) == 2 and 2 not in by_id and by_id[3][0]["text"] == "tail" and len(by_id[None]) == 2
    assert by_id[8][0]["text"] == hard_docs.where("doc_id = 8").head()["text"]


@pytest.mark.parametrize("least", [10, 50, 255, 300])
def test_any_length_of_passages(spark, least):
    rng = random.Random(least)
    shared = [[f"s{rng.randrange(40)}" for _ in range(least + k)] for k in (-1, 0, 1, least)]
    rows = []
    for i in range(30):
        words = []
        for _ in range(3):
            words += [f"o{i}x{rng.randrange(9999)}" for _ in range(rng.randrange(40))] + rng.choice(shared)
        rows.append((i, " ".join(words)))
    got = S.spans(spark.createDataFrame(rows, "doc_id long, text string"), least).drop("uid").collect()
    assert _united(tuple(r) for r in got) == _united(brute_spans(rows, least))


def test_cuts_are_the_same_whichever_way_they_reach_the_texts(spark):
    docs = spark.createDataFrame(corpus(4), "doc_id long, text string")
    a, b = (sorted(map(tuple, S.without_passages(docs, broadcast_rows=n).collect())) for n in (1_000_000, 0))
    assert a == b
