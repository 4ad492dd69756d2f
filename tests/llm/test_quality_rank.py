import numpy as np

from siltstone.llm import quality_rank


def test_pairs_put_the_better_first():
    value = np.array([0.0, 1.0, -2.0, 1.0, 0.0])
    better, worse = quality_rank.pairs(value, 1000)
    assert (value[better] > value[worse]).all() and set(better) | set(worse) == set(range(5))
    assert not len(quality_rank.pairs(np.ones(4), 10)[0]) and not len(quality_rank.pairs(np.zeros(0), 10)[0])


def test_fit_learns_the_order():
    rng = np.random.default_rng(0)
    dense = rng.normal(size=(400, 3))
    truth = dense @ np.array([2.0, -1.0, 0.0])
    better, worse = quality_rank.pairs(truth, 4000)
    model = quality_rank.fit_pairs(np.zeros(401, np.int64), np.zeros(0, np.int32), np.zeros(0), dense, better, worse)
    assert np.corrcoef(dense @ model.dense, truth)[0, 1] > 0.99


def test_held_out_ranking(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rank.train(docs, labels.where("doc_id % 2 = 0"))
    held = labels.where("doc_id % 2 = 1").join(quality_rank.rank(docs, model, keep_text=False).select("doc_id", "score"), "doc_id").toPandas()
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.75


def test_threshold_is_the_exact_quantile(spark):
    values = np.round(np.random.default_rng(3).normal(size=997), 2)
    scored = spark.createDataFrame([(float(v),) for v in values], "score double")
    for q in (0.0, 0.1, 0.5, 0.999):
        cut = quality_rank.threshold(scored, q).head()["cut"]
        assert cut == np.sort(values)[max(1, int(np.ceil(997 * q))) - 1]


def test_hard_tables(spark, hard_docs, empty_docs):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (8, 0, 1), (9, None, None), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_rank.classify(hard_docs, labels)
    assert out.columns == [c for c in hard_docs.columns if c not in ("score", "keep")] + ["score", "keep"] and out.count() == 13
    assert out.where("text is null or text = ''").agg({"score": "max"}).head()[0] == 0
    assert quality_rank.classify(empty_docs, labels).count() == 0
    free = quality_rank.classify(hard_docs, labels.limit(0))
    assert free.where("keep and score = 0").count() == 13


def test_fit_reaches_the_least_loss():
    """The weights against a brute-force minimiser of the same loss (Newton steps, few features)."""
    rng = np.random.default_rng(2)
    dense = rng.normal(size=(60, 3))
    value = dense @ np.array([1.0, -0.5, 0.2]) + rng.normal(size=60)
    better, worse = quality_rank.pairs(value, 3000)
    d = dense[better] - dense[worse]
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(d @ w))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-5 * np.eye(3), d.T @ p / len(d) - 1e-5 * w)
    got = quality_rank.fit_pairs(np.zeros(61, np.int64), np.zeros(0, np.int32), np.zeros(0), dense, better, worse).dense
    assert np.abs(got - w).max() < 0.02
