import collections
import types

import pytest
from pyspark.sql import functions as F

from siltstone.llm import frames, html_text, language_id, mixing, quality_rank, url_filter


def test_filter_misses_no_key(spark):
    keys = spark.range(0, 30_000, 3).select(F.col("id").alias("__key"))
    held = spark.sparkContext.broadcast(frames.key_filter(keys, 10_000))
    may = frames.in_filter(held)
    rows = spark.range(-5, 30_000).select(F.when(F.col("id") >= 0, F.col("id")).alias("id")).withColumn("may", may("id")).collect()
    assert all(r["may"] for r in rows if r["id"] is not None and r["id"] % 3 == 0)
    assert sum(r["may"] for r in rows if r["id"] is None or r["id"] % 3) < 1000
    assert not frames.key_filter(keys.limit(0), 0).any()


@pytest.mark.parametrize("how", ["inner", "left_anti", "left"])
def test_both_ways_of_joining_agree(spark, how):
    """A third of the rows has one key; null keys have no partner."""
    rows = spark.createDataFrame([(i, None if i % 11 == 0 else 7 if i % 3 == 0 else i) for i in range(600)], "n long, k long")
    table = frames.saved(spark.createDataFrame([(k, f"v{k}") for k in (7, 20, 40, 41, 5000)], "__key long, v string"))
    few, many = (frames.joined(rows, F.col("k"), table, how, most) for most in (1_000_000, 0))
    a, b = (collections.Counter(map(tuple, x.select(*sorted(x.columns)).collect())) for x in (few, many))
    assert a == b and sum(a.values()) == {"inner": 185, "left_anti": 415, "left": 600}[how]


def test_a_cluster_without_shared_folder_is_an_error():
    def session(master):
        return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master=master))

    assert frames.shared_dir(session("local[4]")).startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            frames.shared_dir(session(master))


def test_scratch_deletes_and_keeps(spark):
    import os

    with frames.scratch(spark):
        gone = frames.saved(spark.range(3))
        with frames.scratch(spark):
            inner = frames.saved(spark.range(3))
            kept = frames.saved(spark.range(3), keep=True)
        assert not os.path.exists(inner.saved_in.removeprefix("file://"))
        assert gone.count() == 3
    assert kept.count() == 3 and not os.path.exists(gone.saved_in.removeprefix("file://"))
    frames.discard(kept)


def test_columns_of_any_name_pass(spark):
    """Names of the operators' own columns, in other letters, and twice."""
    names = ["doc_id", "text", "source", "n_chars", "__key", "__source", "__text", "__of", "__may", "c0", "in0", "c0"]
    rows = spark.createDataFrame([(i, f"some text {i}", "s", 9, *[f"{n}-{i}" for n in names[4:]]) for i in range(40)]).toDF(*names)
    clash = rows.toDF(*names[:-1], "Shard")
    out = mixing.mix(clash)
    assert out.columns == [*names[:-1], "shard", "position", "block"] and sorted(r["doc_id"] for r in out.collect()) == list(range(40))
    assert all(r["__key"] == f"__key-{r['doc_id']}" for r in out.collect())
    assert mixing.mix(rows).count() == 40
    model = language_id.train(rows.limit(0))
    for made, new in (
        (language_id.identify(rows.toDF(*names[:-1], "Language"), model), ["language", "confidence", "accepted"]),
        (url_filter.filter_urls(rows.toDF(*names[:-1], "SCORE"), url_filter.Trees(0.0, 0.1, {"": (0.0, 0.5)}), url="text"), ["score", "keep"]),
        (quality_rank.classify(rows.toDF(*names[:-1], "Keep"), spark.createDataFrame([], "doc_id long, quality int, toxic int")), ["score", "keep"]),
        (html_text.extract_pages(rows.toDF(*names[:-1], "N_blocks"), page="__text"), ["text", "n_blocks", "n_content"]),
    ):
        assert made.columns[-len(new) :] == new and len(set(made.columns)) == len(made.columns)
        assert {(r["doc_id"], r["__key"]) for r in made.collect()} == {(i, f"__key-{i}") for i in range(40)}
