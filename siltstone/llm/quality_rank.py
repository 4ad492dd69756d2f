"""Document quality by Bradley-Terry pairwise ranking.

Each document has a latent score, linear in its features; the probability that
one is preferred to another is the logistic function of the difference of
their scores.  The weights minimise the logistic loss on the feature
differences of preference pairs, drawn from a bounded sample of labelled
documents.  All documents are then scored over their whole text and those
under a quantile of all scores fall.

Preferences: a document that isn't toxic goes before one that is; among
equals, higher quality goes before lower.  Equal labels give no pair.

Features: which hashed words occur (unit length), and ten shares and sizes.

Defined results
---------------
* A null or empty text has all features zero and the score of such a vector, 0.
* The threshold is the exact lower quantile of the scores, rounded to six
  places, over all rows; rows that tie with it are kept.
* Without preference pairs all scores are 0 and everything is kept.
* Labels that are null, or of documents that aren't there, aren't used; where
  a document has several labels, each counts as a labelled row.
* Repeated rows score alike; other columns pass, and an input column named as
  a result column (``score``, ``keep``) is replaced.
* An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from .frames import column, extended, saved, tuned
from .textarrays import SPACE, buffers, slices, words

BITS = 15
BUCKETS = 1 << BITS
STATS = 10
RESULT = ("score", "keep")


def _class_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)


def features(data: np.ndarray, offsets: np.ndarray):
    """Row offsets, columns and values of the sparse part, and the dense part."""
    hashed, start, end, rows = words(data, offsets)
    bucket = (hashed >> np.uint64(64 - BITS)).astype(np.int32)
    counts = np.diff(rows)
    kept = np.zeros(len(bucket), dtype=bool)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b > a:
            own = bucket[a:b]
            own.sort()
            kept[a] = True
            kept[a + 1 : b] = own[1:] != own[:-1]
    at = np.concatenate([[0], np.cumsum(kept)])[rows]
    distinct = np.diff(at)
    values = np.repeat(1.0 / np.sqrt(np.maximum(distinct, 1)), distinct)
    size = np.diff(offsets).astype(np.float64)
    some = np.maximum(size, 1)
    gap = SPACE[data]
    symbol = (data < 128) & ~gap & ~((data >= 48) & (data <= 57)) & ~((data >= 65) & (data <= 90)) & ~((data >= 97) & (data <= 122))
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    runs = symbol.copy()
    runs[1:] &= symbol[:-1]
    runs[offsets[:-1][offsets[:-1] < len(data)]] = False
    n = counts.astype(np.float64)
    dense = np.stack(
        [
            np.log1p(n) / 10,
            _class_sums(symbol, offsets) / some * 5,
            _class_sums(runs, offsets) / some * 5,
            _class_sums(upper, offsets) / some * 5,
            _class_sums(digit, offsets) / some * 5,
            _class_sums(data == 124, offsets) / some * 10,
            _class_sums(data == 10, offsets) / some * 10,
            np.where(n > 0, distinct / np.maximum(n, 1), 0),
            np.where(n > 0, size / np.maximum(n, 1), 0) / 10,
            np.where(n > 0, n / some, 0) * 5,
        ],
        axis=1,
    )
    dense[counts == 0] = 0
    return at, bucket[kept], values, dense


def _rows(col: pa.Array):
    data, offsets = buffers(col)
    for i, j in slices(offsets):
        yield features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


@dataclass
class Model:
    words: np.ndarray
    dense: np.ndarray

    def score(self, col: pa.Array) -> np.ndarray:
        out = []
        for at, bucket, values, dense in _rows(col):
            sums = np.concatenate([[0.0], np.cumsum(self.words[bucket] * values)])
            out.append(sums[at[1:]] - sums[at[:-1]] + dense @ self.dense)
        return np.concatenate(out) if out else np.zeros(0)


def fit_pairs(at, bucket, values, dense, better: np.ndarray, worse: np.ndarray, rounds: int = 300, rate: float = 0.1, l2: float = 1e-5) -> Model:
    """Minimises the mean logistic loss over the pairs (Adam, whole batch)."""
    n, k = len(at) - 1, dense.shape[1]
    owner = np.repeat(np.arange(n), np.diff(at))
    w = np.zeros(BUCKETS + k)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1 if len(better) else 1):
        score = np.bincount(owner, w[bucket] * values, minlength=n) + dense @ w[BUCKETS:]
        pull = 1.0 / (1.0 + np.exp(np.clip(score[better] - score[worse], -30, 30))) / len(better)
        g = np.bincount(better, pull, minlength=n) - np.bincount(worse, pull, minlength=n)
        grad = np.concatenate([np.bincount(bucket, g[owner] * values, minlength=BUCKETS), g @ dense]) - l2 * w
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    return Model(w[:BUCKETS], w[BUCKETS:])


def pairs(value: np.ndarray, most: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` preference pairs, all rows taking part."""
    rng = np.random.default_rng(seed)
    order = np.argsort(value, kind="stable")
    value = value[order]
    above = np.searchsorted(value, value, side="right")
    able = np.flatnonzero(above < len(value))
    if not len(able):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    each = max(1, most // len(able))
    low = np.repeat(able, each)[:most]
    high = rng.integers(above[low], len(value))
    better, worse = order[high], order[low]
    # every better row takes part too
    below = np.searchsorted(value, value, side="left")
    able = np.flatnonzero(below > 0)[:most]
    return np.concatenate([better, order[able]]), np.concatenate([worse, order[rng.integers(0, below[able])]])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", max_labelled: int = 6000, max_pairs: int = 200_000, seed: int = 11) -> Model:
    """Learns from at most ``max_labelled`` labelled documents, by hash of their id.

    Only the sample's ids (bounded) are sent to the scan of the documents, and
    only its features come to the driver.
    """
    tuned(docs.sparkSession)
    value = (F.coalesce(column(labels, "quality"), F.lit(0)) - 2 * F.coalesce(column(labels, "toxic"), F.lit(0))).cast("double")
    sample = labels.select(column(labels, "doc_id").cast("long").alias("__id"), value.alias("__value")).where("__id is not null").orderBy(F.xxhash64(F.lit(seed), "__id"), "__id", "__value").limit(max_labelled)
    rows = docs.select(column(docs, "doc_id").cast("long").alias("__id"), column(docs, text).cast("string").alias("__text")).join(F.broadcast(sample), "__id").select("__value", "__text")

    def run(batches):
        for b in batches:
            values = b.column("__value").to_numpy(zero_copy_only=False)
            done = 0
            for at, bucket, weight, dense in _rows(b.column("__text")):
                n = len(at) - 1
                own = [bucket[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_pydict({"value": values[done : done + n], "bucket": own, "dense": [d.tobytes() for d in dense]}, schema=pa.schema([("value", pa.float64()), ("bucket", pa.binary()), ("dense", pa.binary())]))
                done += n

    got = rows.mapInArrow(run, "value double, bucket binary, dense binary").toPandas().sort_values(["value", "bucket", "dense"], ignore_index=True)
    parts = [np.frombuffer(x, dtype=np.int32) for x in got["bucket"]]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    bucket = np.concatenate([*parts, np.zeros(0, np.int32)])
    dense = np.stack([np.frombuffer(x) for x in got["dense"]]) if len(got) else np.zeros((0, STATS))
    better, worse = pairs(got["value"].to_numpy(dtype=float), max_pairs, seed)
    return fit_pairs(at, bucket, np.repeat(1.0 / np.sqrt(np.maximum(sizes, 1)), sizes), dense, better, worse)


def rank(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``score``, rounded to six places, to every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    result = T.StructType([T.StructField("score", T.DoubleType())])
    out = extended(docs, [text], lambda body: (pa.array(np.round(held.value.score(body), 6)),), result, () if keep_text else (text,))
    return out.drop("keep")


def threshold(scored: DataFrame, quantile: float) -> DataFrame:
    """One row, ``cut``: the lower quantile of all scores, exactly.

    The distribution is an exact count by score, made map-side first.  The
    running total goes over score bands, each band then over its own scores, so
    that no task holds more than one band of the distinct scores.
    """
    by_score = scored.groupBy("score").count().withColumn("band", F.floor(F.col("score") * 1000))
    bands = by_score.groupBy("band").agg(F.sum("count").alias("n"))
    total = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bands = bands.select("band", "n", F.sum("n").over(total).alias("upto"), F.sum("n").over(every).alias("all"))
    goal = F.greatest(F.lit(1), F.ceil(F.col("all") * F.lit(quantile)))
    band = bands.where((F.col("upto") >= goal) & (F.col("upto") - F.col("n") < goal)).select("band", (goal - F.col("upto") + F.col("n")).alias("rest"))
    within = Window.partitionBy("band").orderBy("score")
    inside = by_score.join(F.broadcast(band), "band").withColumn("reached", F.sum("count").over(within))
    return inside.where(F.col("reached") >= F.col("rest")).agg(F.min("score").alias("cut"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.2, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``score`` and ``keep`` to every row."""
    # scored once, kept in the shared folder
    scored = saved(rank(docs, train(docs, labels, text), text, keep_text))
    cut = threshold(scored.select("score"), quantile).collect()[0]["cut"]
    return scored.withColumn("keep", F.lit(True) if cut is None else F.col("score") >= F.lit(cut))


def query(spark, sf_dir: str) -> DataFrame:
    """Score of every document and whether it is above the lower quantile."""
    docs = spread(tuned(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, keep_text=False)
