import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import ngram_join as J


def grams(text, n=3):
    w = re.findall(r"[0-9a-z]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_groups(rows, threshold=J.THRESHOLD):
    """Least id of each document's component, of documents with a partner."""
    rows = sorted({(i, t) for i, t in rows if i is not None and t and grams(t)})
    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if rows[x][0] != rows[y][0] and jaccard(sets[x], sets[y]) >= threshold - 1e-12:
                up[root(x)] = root(y)
    held = {}
    for x in range(len(rows)):
        held.setdefault(root(x), []).append(x)
    return {rows[x][0]: min(rows[y][0] for y in xs) for xs in held.values() if len({rows[y][0] for y in xs}) > 1 for x in xs}


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    while len(texts) < n:
        body = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 8, 20, 60, 300]))
        texts.append(" ".join(body))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            near = list(body)
            for _ in range(rng.choice([0, 1, 2, max(1, len(near) // 20), max(1, len(near) // 12)])):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near + rng.choices(vocabulary, k=rng.choice([0, 0, 1]))))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = J.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["group_id"] for r in got} == brute_groups(rows)
    sets = {i: grams(t) for i, t in rows}
    for r in got:
        assert r["jaccard"] == pytest.approx(jaccard(sets[r["doc_id"]], sets[r["partner_id"]]))


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8])
def test_similar_sets_share_an_entry(threshold):
    """The pigeonhole: a probe of the smaller meets an index entry of the larger."""
    rng = np.random.default_rng(int(threshold * 10))
    layout = J.Layout(threshold)
    met = 0
    for _ in range(300):
        size = int(rng.choice([1, 2, 3, 4, 6, 9, 15, 40, 200]))
        base = rng.integers(0, 2**64, size, dtype=np.uint64)
        drop = int(rng.integers(0, max(1, int(size * (1 - threshold)) + 1)))
        other = np.concatenate([base[drop:], rng.integers(0, 2**64, int(rng.integers(0, max(1, int(size * (1 - threshold)) + 1))), dtype=np.uint64)])
        a, b = sorted((np.unique(base), np.unique(other)), key=len)
        if not len(a) or len(np.intersect1d(a, b)) < threshold * len(np.union1d(a, b)) - 1e-9:
            continue
        key, owner, role = J.entries(layout, np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        probe = set(key[(owner == 0) & (role & 2 > 0)].tolist())
        index = set(key[(owner == 1) & (role & 1 > 0)].tolist())
        assert probe & index, (len(a), len(b))
        met += 1
    assert met > 100


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(5)
    sets = [np.sort(rng.integers(0, 2**64, int(k), dtype=np.uint64)) for k in (5, 40, 60, 700, 1300)]
    sets += [np.sort(np.concatenate([s[3:], rng.integers(0, 2**64, 2, dtype=np.uint64)])) for s in sets]
    rows = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    maps = J.Bitmaps(*J.bitmaps(np.concatenate(sets), rows))
    x, y = (v.ravel() for v in np.meshgrid(np.arange(10), np.arange(10)))
    true = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(x, y)])
    assert (maps.differ(x, y) <= true).all()
    assert maps.differ(np.array([3]), np.array([4]))[0] > 100


def test_hard_tables(spark, hard_docs, empty_docs):
    got = {r["doc_id"]: r for r in J.groups(hard_docs).collect()}
    assert set(got) == {1, 2, 3} and all(r["group_id"] == 1 for r in got.values())
    assert got[1]["partner_id"] == 2 and got[2]["partner_id"] == 1 and got[3]["jaccard"] < 1
    assert J.groups(empty_docs).count() == 0
    assert J.groups(hard_docs.where("doc_id in (6, 7)")).count() == 0
    kept = J.stage(spark, hard_docs, "")
    assert kept.columns == hard_docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, -1, 1, 1, 4, 5, 6, 7, 8, 9, 10]


def test_stage_drops_by_id_and_text(spark):
    """Ids on several texts: clean ones stay, near copies under the head's id go."""
    body, other, third = (" ".join(f"{w}{i}" for i in range(60)) for w in ("a", "b", "c"))
    rows = [(1, body), (2, body + " tail"), (2, "clean text " + other), (3, third), (3, third + " tail"), (4, third), (None, None), (5, None)]
    kept = [tuple(r) for r in J.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert [t for i, t in kept if i in (1, 2)] in ([body, "clean text " + other], ["clean text " + other, body])
    assert len([t for i, t in kept if i in (3, 4)]) == 1 and 4 not in {i for i, _ in kept}
    assert (None, None) in kept and (5, None) in kept and len(kept) == 5


def test_many_buckets_and_no_broadcasts(spark, monkeypatch):
    """Past every switch of cost: texts joined by filter and shuffle, many buckets."""
    rows = corpus(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(J, "BUCKET_BYTES", 3000)
    got = J.groups(docs, broadcast_rows=0).collect()
    assert {r["doc_id"]: r["group_id"] for r in got} == brute_groups(rows)
    kept = sorted(r["doc_id"] for r in J.stage(spark, docs, "", broadcast_rows=0).collect())
    assert kept == sorted(set(range(len(rows))) - {r["doc_id"] for r in got if r["doc_id"] != r["group_id"]})


def test_a_third_of_all_rows_repeats_one(spark):
    body = " ".join(f"b{k}" for k in range(40))
    rows = [(0, body)] * 200 + [(i, body) for i in range(1, 200)] + [(i, body + f" e{i}") for i in range(200, 400)]
    got = J.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 400 and {r["group_id"] for r in got} == {0}


def brute_links(rows, threshold=J.THRESHOLD):
    """For each row (repeats once), the number of other rows that reach the threshold."""
    rows = sorted({(i, t) for i, t in rows if i is not None and t and grams(t)})
    sets = [grams(t) for _, t in rows]
    return sorted((rows[x][0], n) for x in range(len(rows)) if (n := sum(jaccard(sets[x], sets[y]) >= threshold - 1e-12 for y in range(len(rows)) if x != y)))


@pytest.mark.parametrize("tile", [(2_000_000, 8192), (500, 8192), (2_000_000, 4)])
def test_links_match_brute_force(spark, monkeypatch, tile):
    """No link within a group is lost: dense groups, a chain, copies, repeated rows."""
    monkeypatch.setattr(J, "TILE_GRAMS", tile[0])
    monkeypatch.setattr(J, "TILE_SETS", tile[1])
    rng = random.Random(11)
    body = [f"d{k}" for k in range(80)]
    rows = corpus(3, 60)
    rows += [(1000 + k, " ".join(body[: rng.randrange(55, 81)] + [f"x{k % 5}"])) for k in range(60)]
    rows += [(2000 + k, " ".join(f"c{i}" for i in range(6 * k, 6 * k + 40))) for k in range(30)]
    rows += rows[60:90] + [(5000 + k, rows[k][1]) for k in range(0, 120, 7)]
    got = J.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["links"]) for r in got) == brute_links(rows)


def test_tile_links_both_ways_of_counting():
    rng = np.random.default_rng(2)
    for dense in (True, False):
        pool = rng.integers(0, 2**64, 40 if dense else 4000, dtype=np.uint64)
        sets = [np.unique(rng.choice(pool[k % 3 :] if dense else pool[k // 2 * 30 : k // 2 * 30 + 30], 60)) for k in range(50)]
        rows = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        copies, side = rng.integers(1, 4, 50), np.arange(50) // 2 % 2
        for across in (side, np.zeros(50, np.int64)):
            got = J.tile_links(np.concatenate(sets), rows, copies, across, 0.6, block=16)
            near = [[x != y and (across is not side or side[x] != side[y]) and jaccard(set(sets[x]), set(sets[y])) >= 0.6 for y in range(50)] for x in range(50)]
            assert got.tolist() == (np.array(near) @ copies).tolist()


def test_a_set_isnt_moved_once_a_pair(spark):
    """Sets near a dense group make a pair with each of its sets, but are moved once."""
    rng = np.random.default_rng(4)
    core = rng.integers(0, 2**64, 90, dtype=np.uint64)
    own = [np.unique(np.append(core, rng.integers(0, 2**64, 10, dtype=np.uint64))) for _ in range(40)]
    own += [np.unique(np.append(core[: 55 + k], rng.integers(0, 2**64, 35 - k, dtype=np.uint64))) for k in range(30)]
    sets = spark.createDataFrame([(k, len(s), bytearray(s.tobytes())) for k, s in enumerate(own)], "tid long, size int, grams binary")
    comp = spark.createDataFrame([(k, k if k >= 40 else 0) for k in range(70)], "tid long, comp long")
    pairs = spark.createDataFrame([(a, b) if a % 2 else (b, a) for a in range(40, 70) for b in range(40)], "a long, b long")
    for most in (0, 200_000):
        out = J.verified_at_components(pairs, sets, comp, 0.6, 4, most)
        got = {frozenset((r["a"], r["b"])): r["jaccard"] for r in out.collect()}
        want = {frozenset((a, b)): jaccard(set(own[a]), set(own[b])) for a in range(40, 70) for b in range(40)}
        assert got == {k: pytest.approx(v) for k, v in want.items() if v >= 0.6} and 0 < len(got) < 1200


def test_small_sets_have_bitmaps_that_tell_them_apart():
    rng = np.random.default_rng(6)
    grams = np.sort(rng.integers(0, 2**64, (400, 45), dtype=np.uint64), axis=1)
    maps = J.Bitmaps(*J.bitmaps(grams.ravel(), np.arange(401) * 45))
    x, y = np.triu_indices(400, 1)
    assert (maps.differ(x, y) <= 0.25 * 90).mean() < 0.001


def test_sets_that_meet_a_large_group_come_in_parts(spark, monkeypatch):
    """One component is near every other set: a task never holds all of these at once."""
    own = {i: sorted({1000 + j for j in range(40)} - {1000 + i % 40} | ({5000 + i} if i >= 40 else set())) for i in range(640)}
    sets = spark.createDataFrame([(i, len(g), np.array(g, dtype=np.uint64).tobytes()) for i, g in own.items()], "tid long, size int, grams binary")
    comp = spark.createDataFrame([(i, 0 if i < 40 else i) for i in own], "tid long, comp long")
    pairs = spark.createDataFrame([(a, b) for a in range(40, 640) for b in range(40)], "a long, b long")
    monkeypatch.setattr(J, "BUCKET_BYTES", 20_000)
    met = pairs.select(F.lit(0).alias("bucket"), "a", "b", F.col("a").alias("other"))
    parts = J.in_parts(met, sets.select("tid", "size")).collect()
    assert {(r["a"], r["b"]) for r in parts} == {(a, b) for a in range(40, 640) for b in range(40)} and len(parts) == 24_000
    held = {}
    for r in parts:
        held.setdefault(r["part"], set()).add(r["a"])
    assert len(held) == 10 and max(sum(8 * len(own[i]) for i in p) for p in held.values()) < 40_000
    got = {(r["a"], r["b"]) for r in J.verified_at_components(pairs, sets, comp, 0.6, 4, 0).collect()}
    assert got == {(a, b) for a in range(40, 640) for b in range(40) if jaccard(set(own[a]), set(own[b])) >= 0.6} and got
