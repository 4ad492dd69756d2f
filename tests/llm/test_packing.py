import random

import pytest

from siltstone.llm import packing


def brute(lengths, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters):
        fits = [(left, k) for k, (left, ss, cs) in enumerate(bins) if left >= n and (s < 0 or s not in ss) and (c < 0 or c not in cs)]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append([capacity, set(), set()])
        bins[k][0] -= n
        bins[k][1].add(s)
        bins[k][2].add(c)
        out.append(k)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_best_fit_matches_brute_force(seed):
    rng = random.Random(seed)
    n, capacity = rng.randrange(0, 150), rng.choice([10, 64, 200])
    lengths = sorted((rng.randint(1, capacity) for _ in range(n)), reverse=True)
    sources = [rng.randint(-1, rng.choice([0, 3, 12])) for _ in range(n)]
    clusters = [rng.choice([-1, -1, rng.randint(0, 3)]) for _ in range(n)]
    assert packing.best_fit(lengths, sources, clusters, capacity) == brute(lengths, sources, clusters, capacity)


def test_every_token_once_and_no_conflict(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 9, 40, 150])) + f" {i % 80}", f"s{i % 5}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = packing.pack(docs, capacity=64, group_rows=200).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    text = {i: t for i, t, _ in rows}
    parts, bins = {}, {}
    for r in out:
        parts.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
        bins.setdefault((r["pack_group"], r["bin"]), []).append(r)
    for i, held in parts.items():
        at = 0
        for start, n in sorted(held):
            assert start == at
            at += n
        assert at == size[i]
    assert set(parts) == set(size)
    for held in bins.values():
        assert sum(r["n_tokens"] for r in held) <= 64
        ids = [r["doc_id"] for r in held]
        assert len({source[i] for i in ids}) == len(ids) == len({text[i] for i in ids})
        assert sorted(r["position"] for r in held) == list(range(len(held)))


def test_hard_tables(hard_docs, empty_docs):
    out = packing.pack(hard_docs).collect()
    ids = [r["doc_id"] for r in out]
    assert 4 not in ids and 5 not in ids and ids.count(None) == 1
    assert ids.count(1) == 2 and ids.count(8) == -(-240_002 // 2048)
    assert packing.pack(empty_docs).count() == 0


def test_sequences_have_the_texts_of_repeated_ids(spark):
    rng = random.Random(2)
    rows = [(i % 40, " ".join(f"t{i}x{k}" for k in range(rng.choice([1, 5, 30, 100]))) + "\t end ", f"s{i % 3}") for i in range(80)] + [(None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = packing.sequences(docs, capacity=32, group_rows=50).collect()
    pieces = {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r["piece"])
    for i in {r[0] for r in rows}:
        assert sorted(" ".join(pieces[i]).split()) == sorted(w for j, t, _ in rows if j == i for w in t.split())
    assert packing.sequences(docs.limit(0)).count() == 0


def test_bins_of_the_stage_follow_the_mix(spark):
    """Groups are stretches of a shard; bins are in the order of their first documents there."""
    from siltstone.llm import mixing

    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([5, 60, 400, 900])) + f" {i}", f"s{i % 7}", i) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    place = {r["doc_id"]: (r["shard"], r["position"]) for r in mixing.mix(docs).collect()}
    assert len({s for s, _ in place.values()}) > 1
    firsts, group_of = {}, {}
    for r in packing.stage(spark, mixing.stage(spark, docs, ""), "", group_rows=100).collect():
        shard, at = place[r["doc_id"]]
        group_of.setdefault(r["pack_group"], set()).add((shard, at // 100))
        key = (r["pack_group"], r["bin"])
        firsts[key] = min(firsts.get(key, at), at)
    assert all(len(x) == 1 for x in group_of.values()) and len(group_of) >= 15
    for g in group_of:
        inside = [at for (group, _), at in sorted(firsts.items()) if group == g]
        assert inside == sorted(inside)


def test_the_stage_packs_rows_as_they_were_stored(spark, tmp_path):
    """Groups and bins follow the stored order, whatever the ids: the mix is what the stage before wrote."""
    from siltstone.llm import frames, mixing

    schema = "doc_id long, text string, source string, n_chars long"
    rows = [(i * 7919 % 1009, " ".join(["w"] * (5 + i % 300)) + f" {i}", f"s{i % 7}", i) for i in range(300)]
    seen = []
    for k, given in enumerate((rows, rows[::-1])):
        spark.createDataFrame(given, schema).coalesce(1).write.parquet(str(tmp_path / f"t{k}"))
        out = packing.stage(spark, spark.read.parquet(str(tmp_path / f"t{k}")), "", group_rows=100).collect()
        groups = {g: {r["doc_id"] for r in out if r["pack_group"] == g} for g in range(3)}
        assert [groups[g] for g in range(3)] == [{r[0] for r in given[a : a + 100]} for a in (0, 100, 200)]
        place = {r[0]: j for j, r in enumerate(given)}
        for g in range(3):
            firsts = {}
            for r in out:
                if r["pack_group"] == g:
                    firsts[r["bin"]] = min(firsts.get(r["bin"], 999), place[r["doc_id"]])
            assert [firsts[b] for b in sorted(firsts)] == sorted(firsts.values())
        seen.append(groups[0])
    assert seen[0] != seen[1]
    mixed = frames.saved(mixing.stage(spark, spark.createDataFrame(rows, schema), ""))
    out = packing.stage(spark, mixed, "", group_rows=100).collect()
    shards = {}
    for r in mixing.mix(spark.createDataFrame(rows, schema)).collect():
        shards.setdefault(r["shard"], set()).add(r["doc_id"])
    assert len(shards) > 1 and all(len(s) <= 100 for s in shards.values())
    assert [{r["doc_id"] for r in out if r["pack_group"] == g} for g in range(len(shards))] == [shards[k] for k in sorted(shards)]
