"""Files, logs, embedding files, streams and the search answer."""

import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException

from siltstone import api
from siltstone.sources import files
from siltstone.streaming import crawl as stream

CORPUS = [{"text": "White cast on dark skin", "source": "s1", "product": "A"}, {"text": "No cast", "source": "s2", "skin_tone": "deep"}]


def test_jsonl_skips_blank_lines(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text(json.dumps(CORPUS[0]) + "\n\n" + json.dumps(CORPUS[1]) + "\n")
    rows = files.experiences(spark, str(path)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["source"], r["climate"]) for r in rows] == [(0, "s1", ""), (1, "s2", "")]
    assert files.as_passages(files.experiences(spark, str(path))).columns[2] == "source_url"


def test_bad_lines_fail(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text('{"text": "a"}\n{"text": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.experiences(spark, str(path)).collect()


def test_judged_queries(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps([{"query": "a", "judgments": [{"doc_id": 1, "relevance": 2}]}, {"query": "b", "note": "n", "judgments": []}]))
    queries, judgments = files.judged_queries(spark, str(path))
    assert [tuple(r) for r in queries.orderBy("query_id").collect()] == [(0, "a"), (1, "b")]
    assert [tuple(r) for r in judgments.collect()] == [(0, 1, 2)]


def test_replay_stops_at_a_torn_line(spark, tmp_path):
    path = tmp_path / "log"
    path.write_text('{"url": "a"}\n{"url": "b"}\n{"ur\n{"url": "c"}\n')
    assert [r["url"] for r in files.replayed(files.lines(spark, str(path)), "url string").orderBy("line_no").collect()] == ["a", "b"]


def test_embedder_input_checks_ids(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text(json.dumps({"id": "0" * 64, "text": "a"}) + "\n")
    assert files.embedder_input(spark, str(path)).count() == 1
    path.write_text(json.dumps({"id": "0", "text": "a"}) + "\n")
    with pytest.raises(PySparkException):
        files.embedder_input(spark, str(path)).collect()


def test_embedding_files(spark, tmp_path):
    spark.dataSource.register(files.EmbeddingFiles)
    path = str(tmp_path / "e.bin")
    rows = [(f"{i:064d}", [float(i), 0.5]) for i in range(3)]
    files.write_embedding_file(path, rows, "m", 7)
    assert files.read_embedding_file(path) == ({"version": 1, "dim": 2, "generated_at": 7, "model": "m"}, rows)
    got = spark.read.format("tte1").option("path", path).load()
    assert sorted((r[0], list(r[1])) for r in got.collect()) == rows
    data = bytearray(open(path, "rb").read())
    data[-10] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        files.read_embedding_file(path)


def drained(query):
    query.processAllAvailable()
    query.stop()


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = tmp_path / "log"
    src.mkdir()
    (src / "0.json").write_text('{"url": "a", "passage_id": "p"}\n{"url": "a", "passage_id": "q"}\n{"url": "b", "passage_id": "p"}\n')
    log = stream.log(spark, str(src), "url string, passage_id string")
    drained(stream.first_seen(log).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c1")).start())
    drained(stream.deletions(log).writeStream.format("memory").queryName("gone").option("checkpointLocation", str(tmp_path / "c2")).start())
    assert sorted(r["url"] for r in spark.table("seen").collect()) == ["a", "b"]
    assert sorted(r["passage_id"] for r in spark.table("gone").collect()) == ["p", "q"]


def test_politeness_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = tmp_path / "q"
    src.mkdir()
    lines = [{"host": h, "seq": i, "ts": "2024-01-01T00:00:00Z"} for i, h in enumerate("aab")]
    (src / "0.json").write_text("\n".join(map(json.dumps, lines)))
    rows = spark.readStream.schema("host string, seq long, ts timestamp").json(str(src))
    drained(stream.scheduled(rows).writeStream.format("memory").queryName("times").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start())
    t = dt.datetime(2024, 1, 1)
    assert sorted((r["host"], (r["ready_at"] - t).total_seconds()) for r in spark.table("times").collect()) == [("a", 0), ("a", 5), ("b", 0)]


def test_segments_from_a_stream(spark, tmp_path):
    src = tmp_path / "p"
    src.mkdir()
    (src / "0.json").write_text('{"doc_id": 1, "text": "white cast"}\n')
    rows = spark.readStream.schema("doc_id long, text string").json(str(src))
    stream.append_segments(rows, str(tmp_path / "ix"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "ix/postings")).where("term = 'cast'").head()["positions"] == [1]


def test_a_streamed_index_is_searched(spark, tmp_path):
    from siltstone.operators import index, rank

    src = tmp_path / "p"
    src.mkdir()
    docs = [(1, "white cast"), (2, "no cast here"), (3, "white paper")]
    for k, (i, t) in enumerate(docs):
        (src / f"{k}.json").write_text(json.dumps({"doc_id": i, "text": t}) + "\n")
        rows = spark.readStream.schema("doc_id long, text string").json(str(src))
        stream.append_segments(rows, str(tmp_path / "ix"), str(tmp_path / "c")).awaitTermination(120)
    held = index.Index(spark, str(tmp_path / "ix"))
    terms = rank.query_terms(spark, {0: "white cast"})
    whole = rank.bm25(spark.createDataFrame(docs, "doc_id long, text string"), terms)
    ranked = lambda rows: sorted((r["doc_id"], round(r["score"], 9)) for r in rows.collect())
    assert ranked(rank.bm25_index(held, terms)) == ranked(whole) and held.documents.select("segment_id").distinct().count() == 3
    assert [r["doc_id"] for r in rank.with_phrase_index(held, "white cast").collect()] == [1]


def test_log_is_appended_and_replayed(spark, tmp_path):
    path = str(tmp_path / "log")
    for part in (["a", "b"], ["c"]):
        stream.append_log(spark.createDataFrame([(u,) for u in part], "url string"), path)
    assert sorted(r["url"] for r in files.replayed(files.lines(spark, path), "url string").collect()) == ["a", "b", "c"]


def test_lines_are_numbered_over_files_and_pieces(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.jsonl").write_text("".join(json.dumps({"text": f"t{k}-{i}", "source": "x" * (i % 7)}) + "\n" * (1 + i % 2) for i in range(200)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = files.experiences(spark, str(tmp_path)).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["doc_id"], r["text"]) for r in got] == [(200 * k + i, f"t{k}-{i}") for k in range(3) for i in range(200)]


def test_corpus_is_rewritten_with_new_pages(spark):
    kind = "source_url string, text string"
    old, new = spark.createDataFrame([("u1", "a")], kind), spark.createDataFrame([("u1", "b"), ("u2", "c"), ("u2", "d")], kind)
    assert sorted(map(tuple, files.rewritten(old, new).collect())) == [("u1", "a"), ("u2", "c"), ("u2", "d")]


def test_search_answer(spark):
    docs = spark.createDataFrame([(0, "white <b> cast", "s", "deep"), (1, "other words", "t", None), (2, "cast iron", "u", None)], "doc_id long, text string, source string, skin_tone string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (9, [0.9, 0.1])], "vec_id long, embedding array<float>")
    with pytest.raises(api.BadRequest):
        api.search(docs, "")
    assert api.search(docs, "zzz") == "[]"
    got = json.loads(api.search(docs, "cast", vectors, lambda q: [1.0, 0.0]))
    assert {r["doc_id"] for r in got} == {0, 1, 2}
    first = next(r for r in got if r["doc_id"] == 0)
    assert first["snippet_html"] == "white &lt;b&gt; <mark>cast</mark>" and first["skin_tone"] == "deep" and first["product"] == ""

    def broken(_):
        raise OSError("down")

    assert {r["doc_id"] for r in json.loads(api.search(docs, "cast", vectors, broken))} == {0, 2}
