import numpy as np
import pytest

from siltstone.llm import language_id

SF = "/root/testdata/sf0.001/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs.where("doc_id % 2 = 0"))
    got = language_id.identify(docs.where("doc_id % 2 = 1 and length(text) >= 100"), model, keep_text=False).collect()
    assert np.mean([r["language"] == r["lang"] for r in got]) > 0.97


def test_scores_match_a_direct_product():
    texts = ["Hello, World! hello", "été à Noël", "x"]
    model = language_id.fit_counts({"a": language_id.counts(texts[:1]), "b": language_id.counts(texts[1:2])})
    scores, seen = model.scores(texts)
    for i, t in enumerate(texts):
        c = language_id.counts([t])
        assert seen[i] == c.sum()
        assert scores[i] == pytest.approx(c @ model.weights[:-1].astype(float) + model.prior, rel=1e-5)


def test_counts_are_of_whole_texts():
    one = language_id.counts(["ab cd"])
    assert language_id.counts(["ab cd " * 1000])[one > 0].min() >= 999


def test_hard_tables(spark, hard_docs, empty_docs):
    model = language_id.train(hard_docs)
    got = {r["doc_id"]: r for r in language_id.identify(hard_docs.where("doc_id is not null"), model).collect()}
    assert not any(got[i]["accepted"] for i in (4, 5, 7)) and got[5]["language"] is None
    assert got[1]["language"] == "en" and got[6]["language"] == "de" and got[8]["accepted"]
    assert language_id.identify(empty_docs, model).count() == 0
    none = language_id.train(empty_docs)
    assert language_id.identify(hard_docs, none).where("accepted").count() == 0
    kept = language_id.stage(spark, hard_docs, "")
    assert kept.columns == hard_docs.columns and kept.where("doc_id in (1, 2, 3, 6, 8)").count() == 6


def test_parts_of_a_text_lose_nothing(monkeypatch):
    texts = ["Une phrase, puis... une autre!   Été à Noël " * 50, "short", "", "x" * 300, "1234 " * 200 + "end"]
    whole = [language_id.counts([t]) for t in texts]
    for size in (7, 64, 100):
        monkeypatch.setattr(language_id, "CHUNK", size)
        assert all((language_id.counts([t]) == w).all() for t, w in zip(texts, whole))
        assert (language_id.counts(texts) == sum(whole)).all()


def test_planted_junk_goes_and_clean_documents_stay(spark):
    import random
    import string

    rng = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    clean = {r["doc_id"] for r in docs.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1 and toxic = 0"), "doc_id", "left_semi").collect()}
    noise = [
        "".join(rng.choice(string.ascii_lowercase + "   ") for _ in range(600)),
        "".join(rng.choice("0123456789abcdef") for _ in range(600)),
        "xkcd qwrt zzxv bnmp jjqk " * 20,
        "這是一個沒有學過的文字系統，不應該被接受。" * 5,
        "привет, как дела? сегодня хорошая погода. " * 5,
        "for (int i=0;i<n;i++) { return x[i]*y[i]; } " * 10,
        "%%% &&& *** " * 30,
    ]
    junk = spark.createDataFrame([(10_000 + i, t, None) for i, t in enumerate(noise)], docs.schema)
    kept = {r["doc_id"] for r in language_id.stage(spark, docs.unionByName(junk), "").select("doc_id").collect()}
    assert not {i for i in kept if i >= 10_000}
    assert len(clean & kept) >= 0.99 * len(clean) and len(kept) >= 0.98 * docs.count()


def test_too_many_labels_are_an_error(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    assert len(language_id.train(docs, max_languages=5).languages) == 5
    with pytest.raises(ValueError):
        language_id.train(docs, max_languages=4)
