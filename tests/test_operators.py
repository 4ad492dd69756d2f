"""Index, ranking, vectors, fusion, snippets, duplicates, crawl, metrics: small cases."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siltstone.operators import crawl, dedup, evaluate, hybrid, index, rank, snippet, vector

TEXTS = ["sunscreen leaves no white", "the sunscreen does not leave a white cast", "cast white", ""]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.fixture(scope="module")
def stored(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    index.write_index(docs, path, F.pmod("doc_id", F.lit(2)))
    return path


def test_postings(docs):
    got = {(r["term"], r["doc_id"]): (r["tf"], r["positions"]) for r in index.postings(docs).collect()}
    assert got["sunscreen", 0] == (1, [0]) and got["sunscreen", 1] == (1, [1])


def test_documents_without_terms_count(docs):
    lengths = index.doc_lengths(docs)
    assert {r["doc_id"]: r["dl"] for r in lengths.collect()} == {0: 4, 1: 8, 2: 2, 3: 0}
    assert tuple(index.corpus_stats(lengths).head()) == (4, 3.5)


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tuple(index.corpus_stats(index.doc_lengths(none)).head()) == (0, 0.0)
    assert rank.bm25(none, rank.query_terms(spark, {0: "a b"})).count() == 0


def test_gaps_and_sizes(spark):
    occ = spark.createDataFrame([(0, "a", 3 * i) for i in range(1, 1001)], "doc_id long, term string, pos int")
    sizes = index.gaps(occ).agg(F.sum(index.varint_bytes(F.col("gap").cast("long"))))
    assert sizes.head()[0] == 1000
    with pytest.raises(PySparkException):
        index.increasing(spark.createDataFrame([(0, "a", 0, 5), (0, "a", 1, 5)], "doc_id long, term string, nth int, pos int")).count()


def test_ids_must_run_from_zero(spark):
    with pytest.raises(PySparkException):
        index.contiguous(spark.createDataFrame([(1,), (2,)], "doc_id long")).collect()


def test_phrases(spark, docs, stored):
    held = index.Index(spark, stored)
    for phrase, ids in {"white cast": [1], "does not leave": [1], "sunscreen": [0, 1], "purple cast": [], "": []}.items():
        assert sorted(r[0] for r in rank.with_phrase(docs, phrase).collect()) == ids
        assert sorted(r[0] for r in rank.with_phrase_index(held, phrase).collect()) == ids


def test_bm25(spark, docs, stored):
    terms = rank.query_terms(spark, {0: "white cast cast"})
    raw = {r["doc_id"]: round(r["score"], 9) for r in rank.bm25(docs, terms).collect()}
    kept = {r["doc_id"]: round(r["score"], 9) for r in rank.bm25_index(index.Index(spark, stored), terms).collect()}
    assert raw == kept and set(raw) == {0, 1, 2}
    order = [r["doc_id"] for r in rank.ranked(rank.bm25(docs, terms)).orderBy("rank").collect()]
    assert order[0] == 2
    once = {r["doc_id"]: r["score"] for r in rank.bm25(docs, rank.query_terms(spark, {0: "cast"})).collect()}
    twice = {r["doc_id"]: r["score"] for r in rank.bm25(docs, rank.query_terms(spark, {0: "cast cast"})).collect()}
    assert twice[2] == pytest.approx(2 * once[2])


def test_idf_is_never_negative(spark):
    got = [r[0] for r in spark.createDataFrame([(10, 1), (10, 9), (10, 10)], "n long, df long").select(rank.idf(F.col("n"), F.col("df"))).collect()]
    assert got[0] > got[1] > got[2] >= 0


def test_ties_go_by_id(spark):
    scores = spark.createDataFrame([(0, 7, 1.0), (0, 3, 1.0)], "query_id long, doc_id long, score double")
    assert [r["doc_id"] for r in rank.ranked(scores).orderBy("rank").collect()] == [3, 7]


def test_merge_drops_deleted_documents(spark, stored, tmp_path):
    gone = spark.createDataFrame([(0,), (1,)], "doc_id long")
    index.merge_index(spark, stored, gone, str(tmp_path))
    new = index.Index(spark, str(tmp_path))
    assert new.documents.count() == 2 and new.frequency("sunscreen").count() == 0
    assert new.lookup("white").head()["positions"] == [1]
    assert sorted(r["local_id"] for r in new.documents.collect()) == [0, 1]


def test_term_filter_reaches_the_scan(spark, stored):
    plan = index.Index(spark, stored).lookup("white")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(term,white)" in plan or "In(term, [white])" in plan


def test_upsert_and_neighbours(spark):
    old = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1])], "vec_id string, embedding array<float>")
    new = spark.createDataFrame([("c", [0.0, 1.0], 0), ("c", [0.8, 0.2], 1), ("b", [0.7, 0.3], 2)], "vec_id string, embedding array<float>, seq int")
    held = vector.upserted(old, new)
    assert held.count() == 3
    gone = spark.createDataFrame([("a",)], "vec_id string")
    assert [r["vec_id"] for r in vector.nearest(held, [1.0, 0.0], 2).collect()] == ["a", "c"]
    assert [r["vec_id"] for r in vector.nearest_live(held, [1.0, 0.0], 2, gone).collect()] == ["c", "b"]
    assert [r["vec_id"] for r in vector.nearest_live_overfetch(held, [1.0, 0.0], 2, gone).collect()] == ["c", "b"]
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, q array<double>")
    assert {(r["query_id"], r["vec_id"]) for r in vector.nearest_many(held, asked, 1).collect()} == {(1, "a"), (2, "b")}


def test_fusion(spark):
    a = spark.createDataFrame([("x", 1), ("z", 2)], "doc_id string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "doc_id string, rank int")
    assert [r["doc_id"] for r in hybrid.fused([a, b]).orderBy("rank").collect()] == ["z", "x", "y"]


def test_embedder(spark):
    encode = hybrid.hashing_encoder(8)
    rows = spark.createDataFrame([("p", "white cast"), ("q", "")], "passage_id string, text string")
    got = {r["passage_id"]: r["embedding"] for r in hybrid.embedded(rows, lambda ts: [encode(t) for t in ts]).collect()}
    assert sum(v * v for v in got["p"]) == pytest.approx(1) and got["q"] == [0.0] * 8


def test_snippets(spark):
    assert snippet.snippet("SPF50", {"spf", "50"}) == ("SPF50", [(0, 3), (3, 5)])
    assert snippet.snippet("...", {"a"}) == ("...", [])
    long = " ".join(["w"] * 20 + ["a", "b", "a"] + ["w"] * 20)
    body, spans = snippet.snippet(long, {"a", "b"})
    assert len(spans) == 3 and body.startswith("… ") and body.endswith(" …")
    assert [body.encode()[s:e].decode() for s, e in spans] == ["a", "b", "a"]
    assert snippet.snippet(long, {"zzz"})[0].startswith("w") and not snippet.snippet(long, {"zzz"})[1]
    assert snippet.marked('<b>"x" & y\'s</b>', [(3, 4)]) == "&lt;b&gt;<mark>&#34;</mark>x&#34; &amp; y&#39;s&lt;/b&gt;"
    docs = spark.createDataFrame([(1, long), (2, "")], "doc_id long, text string")
    assert [tuple(r) for r in snippet.windows(docs, "a b").collect()] == [(1, 11, 3)]
    row = docs.where("doc_id = 1").select(snippet.snippets(F.col("text"), "a b").alias("s")).head()["s"]
    assert row["text"] == body and [(m["start"], m["end"]) for m in row["matches"]] == spans


def test_simhash(spark):
    texts = ["the cat sat on the mat near the door", "the cat sat on the mat near the window", "quantum field theory lectures for graduate students", "", "!!"]
    fp = {r["doc_id"]: r["fp"] for r in dedup.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert bits(fp[0], fp[1]) < bits(fp[0], fp[2]) and fp[3] == fp[4] == 0


def test_near_pairs_are_all_pairs(spark):
    values = [0b1, 0b11, 0b111, 1 << 63, (1 << 63) | 1, 0, 0b1]
    fp = spark.createDataFrame([(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(values)], "doc_id long, fp long")
    # document 6 has the fingerprint of document 0, which stands for it
    brute = {(i, j, bin(a ^ b).count("1")) for i, a in enumerate(values[:6]) for j, b in enumerate(values[:6]) if i < j and a and b and bin(a ^ b).count("1") <= 2}
    for spare in (0, 1, 2):
        assert {tuple(r) for r in dedup.near_pairs(fp, 2, spare).collect()} == brute
    assert {tuple(r) for r in dedup.members(fp).collect()} == {(0, 0, 2), (1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 5, 1), (6, 0, 2)}


def test_seen_addresses(spark):
    found = spark.createDataFrame([(i, f"u{i % 60}") for i in range(120)], "seq long, url string")
    known = spark.createDataFrame([("u0",), ("u1",)], "url string")
    got = [r["url"] for r in dedup.admitted(found, known).orderBy("seq").collect()]
    assert got == [f"u{i}" for i in range(2, 42)]


def test_schedule_waits_by_host(spark):
    t = dt.datetime(2024, 1, 1)
    q = spark.createDataFrame([("a", 0, t), ("a", 1, t), ("b", 0, t), ("a", 2, t + dt.timedelta(seconds=60))], "host string, seq int, ts timestamp")
    got = {(r["host"], r["seq"]): (r["ready_at"] - t).total_seconds() for r in crawl.schedule(q).collect()}
    assert got == {("a", 0): 0, ("a", 1): 5, ("b", 0): 0, ("a", 2): 60}


def test_robots():
    body = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /p\nAllow: /p/open\nDisallow: /*.pdf$ # files\n"
    allows = lambda p, a="bot/1.0": crawl.robots_allows(body, a, p)
    assert allows("/") and allows("/p/open/x") and not allows("/p/x") and not allows("/a.pdf") and allows("/a.pdf?x")
    assert not allows("/", "other/2") and crawl.robots_allows("", "bot", "/x") and crawl.robots_allows(None, "bot", "/x")


def test_robots_status(spark):
    df = spark.createDataFrame([(404, False), (200, True), (200, False), (503, True)], "s int, a boolean")
    assert [r[0] for r in df.select(crawl.robots_decision(F.col("s"), F.col("a"))).collect()] == [True, True, False, False]


def test_redirects_stop_at_loops(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    starts = spark.createDataFrame([("a",), ("x",), ("z",)], "url string")
    assert {tuple(r) for r in crawl.redirect_targets(links, starts).collect()} == {("a", "c", 2), ("z", "z", 0)}


def test_hosts_without_policy_fail(spark):
    rows = spark.createDataFrame([("http://a.com/1",), ("http://b.com/2",)], "url string")
    policies = spark.createDataFrame([("http://a.com", 1, "blog"), ("http://a.com", 2, "forum")], "host string, seq int, source_type string")
    assert crawl.attributed(rows.where("url like '%a.com%'"), policies).head()["source_type"] == "forum"
    with pytest.raises(PySparkException):
        crawl.attributed(rows, policies).collect()


def test_metrics(spark):
    queries = spark.createDataFrame([(q,) for q in range(4)], "query_id long")
    ranking = spark.createDataFrame([(0, 5, 1), (1, 6, 1), (1, 7, 2), (1, 5, 3), (2, 9, 1)], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(0, 5, 2), (1, 5, 1), (2, 9, 0)], "query_id long, doc_id long, relevance int")
    each = evaluate.by_query(queries, ranking, qrels, 5)
    assert {r["query_id"]: (r["p_at_k"], round(r["rr"], 4)) for r in each.collect()} == {0: (0.2, 1.0), 1: (0.2, 0.3333), 2: (0.0, 0.0), 3: (0.0, 0.0)}
    assert evaluate.means(each).head()["mrr"] == pytest.approx((1 + 1 / 3) / 4)


def test_varint_bytes_come_back(spark):
    values = [0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**62, 2**63 - 1]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", index.varint(F.col("v")).alias("b"))
    got = rows.select("v", "b", index.unvarint(F.col("b")).alias("back"), index.varint_bytes(F.col("v")).alias("n")).collect()
    assert all(r["back"] == r["v"] and len(r["b"]) == 2 * r["n"] for r in got)
    assert {r["v"]: r["b"] for r in got}[300].upper() == "AC02"


def test_decoding_fails_where_positions_do_not_rise(spark):
    kind = "doc_id long, term string, nth int, gap int"
    assert [r["pos"] for r in index.undone(spark.createDataFrame([(0, "a", 0, 0), (0, "a", 1, 3), (0, "a", 2, 1)], kind)).orderBy("nth").collect()] == [0, 3, 4]
    with pytest.raises(PySparkException):
        index.undone(spark.createDataFrame([(0, "a", 0, 5), (0, "a", 1, 0)], kind)).collect()


def test_more_terms_than_a_plan_holds(spark, docs, monkeypatch):
    terms = rank.query_terms(spark, {0: "white cast", 1: "skin"})
    few = sorted(map(tuple, rank.bm25(docs, terms).collect()))
    monkeypatch.setattr(rank, "FEW", 1)
    assert sorted(map(tuple, rank.bm25(docs, terms).collect())) == few


def test_stored_vectors_by_cell(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 5 == j) + 0.01 * i for j in range(5)]) for i in range(50)], "vec_id long, embedding array<float>")
    vector.write_vectors(rows, str(tmp_path), 8)
    held, q = vector.StoredVectors(spark, str(tmp_path)), [1.0, 0.0, 0.0, 0.0, 0.0]
    exact = [tuple(r) for r in vector.nearest(rows, q, 5).collect()]
    assert [tuple(r) for r in held.nearest(q, 5).collect()] == exact == [tuple(r) for r in held.nearest(q, 5, 8).collect()]
    assert held.nearest(q, 5, 1).head()["vec_id"] == exact[0][0]


def test_listings_known_skipped_and_over(spark):
    urls = ["http://a/tag/1", "http://a/p1", "http://b/p2", "http://a/p3", "http://a/p4", None]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    known = spark.createDataFrame([("http://a/p1",)], "url string")
    got = {r["page_id"]: r["kind"] for r in crawl.split_listings(pages, "^/tag/", known, ("a",), 1).collect()}
    assert got == {0: "listing", 1: "known", 2: "skipped", 3: "content", 4: "over", 5: "skipped"}


def test_places_of_ties_in_stretches(spark, monkeypatch):
    """Half of the rows tie; stretches of 8 ids; several queries."""
    monkeypatch.setattr(rank, "STRETCH", 3)
    rows = [(q, i, 1.5 if i % 2 else float(i % 7) / 10) for q in (0, 1) for i in range(100)]
    got = rank.numbered(spark.createDataFrame(rows, "query_id long, doc_id long, score double"), F.col("score"), "doc_id", ("query_id",)).collect()
    for q in (0, 1):
        order = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        assert [(r["doc_id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(r[1], k + 1) for k, r in enumerate(order)]


def test_simhash_of_long_texts_in_pieces(spark):
    """Terms are taken a piece at a time, as Arrow arrays, from batches of bounded size."""
    from siltstone.functions.hashing import fnv1a

    texts = [" ".join(f"w{i * j % 977}" for j in range(3_000 * (i % 4))) for i in range(120)]
    held = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for i, fp in dedup.fingerprints(held).collect():
        words = {}
        for w in texts[i].split():
            for part in (w[0], w[1:]):
                words[part] = words.get(part, 0) + 1
        hashes = {w: fnv1a(w.encode()) for w in words}
        votes = [sum(n if hashes[w] >> b & 1 else -n for w, n in words.items()) for b in range(64)]
        assert fp & (2**64 - 1) == sum(1 << b for b in range(64) if votes[b] > 0)


def test_postings_of_rows_are_not_shuffled(spark, docs):
    """All terms of a document stand in one row; only rows of one id are merged."""
    for made in (index.postings(docs), index.term_frequency(docs), index.decoded(index.coded(docs))):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    twice = spark.createDataFrame([(0, "a b a"), (0, "b c"), (None, "a"), (None, "a"), (1, None), (2, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["term"]): (r["tf"], r["positions"]) for r in index.postings(twice).collect()}
    assert got == {(0, "a"): (2, [0, 2]), (0, "b"): (2, [0, 1]), (0, "c"): (1, [1]), (None, "a"): (2, [0, 0])}
    assert {(r["doc_id"], r["term"]): r["tf"] for r in index.term_frequency(twice).collect()} == {k: v[0] for k, v in got.items()}


def test_stored_postings_come_from_blocks(spark, tmp_path, monkeypatch):
    """Ids that repeat, that are negative or strings; few and many of them; files sorted by term."""
    texts = [" ".join(f"w{i * j % 19}" for j in range(i % 40)) for i in range(200)]
    rows = [(i - 100 if i % 50 else 7, t) for i, t in enumerate(texts)]
    for kind in ("long", "string"):
        held = spark.createDataFrame([(i if kind == "long" else f"d{i}", t) for i, t in rows], f"doc_id {kind}, text string")
        want = {(r["term"], r["doc_id"]): (r["tf"], r["positions"]) for r in index.postings(held).collect()}
        for cut in (1, 3):
            monkeypatch.setattr(index, "FEW_IDS", cut)
            path = str(tmp_path / f"{kind}{cut}")
            index.write_index(held, path, F.length(F.col("doc_id").cast("string")) % 3)
            stored = index.Index(spark, path)
            got = [((r["term"], r["doc_id"]), (r["tf"], r["positions"])) for r in stored.postings.collect()]
            assert dict(got) == want and len(got) == len(want)
            assert stored.frequency("11").head()["df"] == sum(t == "11" for t, _ in want)
            files = {}
            for r in stored.postings.select("term", "segment_id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).collect():
                files.setdefault(r["f"], []).append((r["i"], r["term"]))
            assert all([t for _, t in sorted(v)] == sorted(t for _, t in v) for v in files.values())
            target = f"{path}-merged"
            gone = {k for _, k in want if hash(str(k)) % 2}
            index.merge_index(spark, path, spark.createDataFrame([(k,) for k in gone], f"doc_id {kind}"), target)
            merged = {(r["term"], r["doc_id"]): (r["tf"], r["positions"]) for r in index.Index(spark, target).postings.collect()}
            assert merged == {k: v for k, v in want.items() if k[1] not in gone}


def test_codes_of_postings():
    import numpy as np

    from siltstone.functions import postings

    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**62, 2**63 - 1], dtype=np.int64)
    data, size = postings.varints(values)
    assert postings.unvarints(data).tolist() == values.tolist() and size.sum() == len(data)
    assert data[size[:4].sum() : size[:5].sum()].tobytes().hex() == "ac02"
    counts = np.array([2, 1, 3])
    positions = np.array([0, 4, 9, 0, 1, 7])
    assert postings.as_gaps(positions, counts).tolist() == [0, 4, 9, 0, 1, 6]
    assert postings.as_positions(postings.as_gaps(positions, counts), counts).tolist() == positions.tolist()
    with pytest.raises(ValueError):
        postings.as_positions(np.array([5, 0]), np.array([2]))
    assert len(postings.varints(np.zeros(0, np.int64))[0]) == 0 == len(postings.unvarints(np.zeros(0, np.uint8)))


def test_blocks_unpack_in_pieces(monkeypatch):
    """Batches longer than a piece, slices of batches, null ids and segments."""
    import pyarrow as pa

    from siltstone.functions import postings

    tokens = pa.array([[f"t{i * j % 7}" for j in range(i % 9)] for i in range(60)] + [None]).slice(3)
    row, term, tf, positions = postings.grouped(tokens)
    ids = pa.array([None if i % 11 == 0 else 500 - i for i in range(len(tokens))]).take(pa.array(row))
    seg = pa.array([None if i % 13 == 0 else i % 3 for i in range(len(tokens))]).take(pa.array(row))
    kept = list(zip(seg.to_pylist(), term.to_pylist(), ids.to_pylist(), tf.tolist(), postings.lists(pa.array(positions), tf).to_pylist()))
    block = postings.packed(seg, term, ids, tf, positions)
    assert len(block) == len({k[:2] for k in kept})
    for piece in (1, 40, 1_000_000):
        monkeypatch.setattr(postings, "PIECE", piece)
        for a in (0, 5):
            got = [tuple(r.values()) for b in postings.unpacked(block.slice(a)) for r in b.to_pylist()]
            first = {(r["segment_id"], r["term"]) for r in block.slice(a).to_pylist()}
            assert sorted(got, key=repr) == sorted((k for k in kept if k[:2] in first), key=repr)


def test_best_of_many_queries_moves_no_scores(spark):
    """The first of each query, with ties at the last place, as ranking all scores gives them; ids that repeat too."""
    rows = [(i, " ".join(f"w{chr(97 + i * j % 11)}" for j in range(i % 6))) for i in range(120)] + [(500, None)]
    held = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for queries in ({q: f"wa w{chr(97 + q)} w{chr(97 + q)} zz" for q in range(9)}, {"x": "wa wb", "y": ""}, {0: "zz"}):
        terms = rank.query_terms(spark, queries)
        for docs in (held, held.union(spark.createDataFrame([(3, "wa wb")], held.schema)), held.limit(0)):
            rounded = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
            assert rounded(rank.best(docs, terms, 4)) == rounded(rank.ranked(rank.bm25(docs, terms), 4))
    # df and scores are made in the rows: what is shuffled has at most k rows a query and batch
    plan = rank.best(held, rank.query_terms(spark, {q: "wa" for q in range(9)}), 4)._jdf.queryExecution().executedPlan().toString()
    assert "Explode" not in plan and plan.count("Exchange hashpartitioning") == 1
