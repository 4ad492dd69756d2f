"""URL filtering by gradient-boosted trees on lexical features.

Features of the address alone: lengths, depth, shares of digits, hyphens and
vowels, character entropies, numbers of labels and parameters, how common its
suffix and suffix pair are and, from the labelled URLs, their smoothed rate of
unwanted ones.  Trees are grown on the gradient of the logistic loss over
feature histograms; leaves take Newton steps.

Labels come with a table of URLs.  The registered query learns from the URLs
of ``url_labels``, labelled by hand, of which no host is in the crawl that it
scores.  Where a list of unwanted hosts is at hand, ``labelled_by_hosts`` labels
a crawl's own URLs by it; the trees see only the lexical features, never the
host itself.

Defined results
---------------
* A null or empty URL, or one without a host, has zero lengths; it is scored
  like any other.  Text that can't be parsed as a URL is all path.
* Suffixes and classes are counted over all labelled URLs.  The trees are grown
  on at most ``max_rows`` of each class, by hash, each weighing as many URLs of
  its class as it stands for, so that scores are probabilities at the classes'
  real shares.  Null URLs and labels aren't used.  With no label, or one class
  only, the score is the smoothed share of that class for all.
* Result columns ``score`` (rounded to six places) and ``keep`` replace input
  columns of these names; other columns pass; repeated rows score alike.  An
  empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import column, extended, tuned
from .url_labels import LABELLED

RESULT = ("score", "keep")
BINS = 32


def parts(url: str | None) -> tuple[str, str, str]:
    """Host, path and query, lower-cased."""
    rest = (url or "").strip().lower().partition("#")[0]
    if "://" in rest:
        rest = rest.partition("://")[2]
    elif "." not in rest.partition("/")[0]:
        return "", rest.partition("?")[0], rest.partition("?")[2]
    address, _, query = rest.partition("?")
    host, slash, path = address.partition("/")
    return host.rpartition("@")[2].partition(":")[0], slash + path, query


def suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


def entropy(text: str) -> float:
    if not text:
        return 0.0
    n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True)[1] / len(text)
    return float(-(n * np.log2(n)).sum())


def lexical(url: str | None, rates: dict[str, tuple[float, float]]) -> list[float]:
    host, path, query = parts(url)
    labels = [x for x in host.split(".") if x]
    name = labels[-3] if len(labels) > 2 else labels[0] if labels else ""
    steps = [x for x in path.split("/") if x]
    whole = host + path + query
    size = max(len(whole), 1)
    out = [
        len(whole),
        len(host),
        len(path),
        len(query),
        len(steps),
        len(labels),
        sum(c.isdigit() for c in whole) / size,
        sum(c.isdigit() for c in host) / max(len(host), 1),
        host.count("-"),
        path.count("-") + path.count("_"),
        sum(c in "aeiou" for c in host) / max(len(host), 1),
        entropy(host),
        entropy(path),
        entropy(name),
        len(name),
        max((len(x) for x in steps), default=0),
        query.count("=") if query else 0,
        whole.count("%"),
        float(path.rpartition(".")[2] in ("html", "htm", "php", "asp")),
        float((url or "").strip().lower().startswith("https")),
    ]
    for s in suffixes(host):
        out += rates.get(s, rates[""])
    return out


def suffix_counts(urls, labels) -> dict[str, list[int]]:
    """URLs and those of label 1 by suffix of one and two labels, and of all under a null key."""
    held: dict[str | None, list[int]] = {}
    for u, y in zip(urls, labels):
        for s in {None, *suffixes(parts(u)[0])}:
            t = held.setdefault(s, [0, 0])
            t[0] += 1
            t[1] += int(y)
    return held


def suffix_rates(counts: dict[str | None, tuple[int, int]], prior: float = 20.0, least: int = 30) -> dict[str, tuple[float, float]]:
    """For each suffix of one and two labels: log count, smoothed rate of label 1."""
    total, ones = counts.get(None, (0, 0))
    base = ones / total if total else 0.5
    # two-label suffixes are names; only those of several URLs say anything
    return {"": (0.0, base)} | {s: (float(np.log1p(n)), (k + prior * base) / (n + prior)) for s, (n, k) in counts.items() if s is not None and n >= least}


def counted(rows: DataFrame, least: int = 30) -> dict[str | None, tuple[int, int]]:
    """``suffix_counts`` of all rows (``url, label``); suffixes of fewer than ``least`` URLs are left out."""

    def run(batches):
        for b in batches:
            held = suffix_counts(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([k for _, k in held.values()], pa.int64())], names=["suffix", "n", "k"])

    sums = rows.select("url", "label").mapInArrow(run, "suffix string, n long, k long").groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    got = sums.where(F.col("suffix").isNull() | (F.col("n") >= least)).toPandas()
    return {s if isinstance(s, str) else None: (int(n), int(k)) for s, n, k in zip(got["suffix"], got["n"], got["k"])}


@dataclass
class Trees:
    base: float
    rate: float
    rates: dict[str, tuple[float, float]]
    #: per tree: feature (-1 at a leaf), threshold, value; node k has children 2k + 1 and 2k + 2
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out += self.rate * value[at]
        return out

    def score(self, urls: list[str | None]) -> np.ndarray:
        if not urls:
            return np.zeros(0)
        x = np.array([lexical(u, self.rates) for u in urls], dtype=np.float64)
        return 1.0 / (1.0 + np.exp(-self.raw(x)))


def grow(x: np.ndarray, y: np.ndarray, rates=None, trees: int = 60, depth: int = 4, rate: float = 0.2, least: int = 5, l2: float = 1.0, weight: np.ndarray | None = None) -> Trees:
    """Boosted trees for labels 0 and 1; a row counts ``weight`` times, once by default."""
    n = len(y)
    weight = np.ones(n) if weight is None else weight
    share = ((weight * y).sum() + 1.0) / (weight.sum() + 2.0)
    model = Trees(float(np.log(share / (1 - share))), rate, rates or {"": (0.0, float(share))})
    if n == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    raw = np.full(n, model.base)
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-raw))
        g, h = weight * (y - p), weight * p * (1 - p)
        size = 2 ** (depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        at = np.zeros(n, dtype=np.int64)
        for node in range(size):
            own = np.flatnonzero(at == node)
            if not len(own):
                continue
            gs, hs = g[own].sum(), h[own].sum()
            value[node] = gs / (hs + l2)
            if node >= 2**depth - 1 or len(own) < 2 * least:
                continue
            best = (1e-6, -1, 0)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[own, f]
                left_n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                left_g = np.cumsum(np.bincount(b, g[own], minlength=len(c) + 1))[:-1]
                left_h = np.cumsum(np.bincount(b, h[own], minlength=len(c) + 1))[:-1]
                gain = left_g**2 / (left_h + l2) + (gs - left_g) ** 2 / (hs - left_h + l2) - gs**2 / (hs + l2)
                gain[(left_n < least) | (len(own) - left_n < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
            if best[1] >= 0:
                _, f, k = best
                feature[node], cut[node] = f, cuts[f][k]
                at[own] = 2 * node + 1 + (binned[own, f] > k)
        model.trees.append((feature, cut, value))
        raw += rate * value[at]
    return model


def train(labelled: DataFrame, url: str = "url", label: str = "label", max_rows: int = 20_000, seed: int = 3) -> Trees:
    """Fits on all labelled URLs' suffixes and ``max_rows`` URLs of each class (by hash of the URL)."""
    rows = labelled.select(column(labelled, url).cast("string").alias("url"), column(labelled, label).cast("int").alias("label")).where("url is not null and label in (0, 1)")
    order = F.xxhash64(F.lit(seed), "url")
    counts = counted(rows)
    total, ones = counts.get(None, (0, 0))
    got = [rows.where(F.col("label") == k).orderBy(order, "url").limit(max_rows).toPandas() for k in (0, 1)]
    urls = [*got[0]["url"], *got[1]["url"]]
    y = np.concatenate([np.zeros(len(got[0])), np.ones(len(got[1]))])
    stands = [all_ / max(len(g), 1) for all_, g in zip((total - ones, ones), got)]
    weight = np.repeat(stands, [len(g) for g in got])
    rates = suffix_rates(counts)
    x = np.array([lexical(u, rates) for u in [*urls, ""]], dtype=np.float64)[:-1]
    return grow(x, y, rates, weight=weight)


def filter_urls(rows: DataFrame, model: Trees, url: str = "url", most: float = 0.5, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds ``score``, the probability of an unwanted URL, and ``keep`` (below ``most``)."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    result = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def run(urls):
        score = np.round(held.value.score(urls.to_pylist()), 6)
        return pa.array(score), pa.array(score < most)

    return extended(rows, [url], run, result, keep=keep)


def labelled_by_hosts(pages: DataFrame, blocked: tuple[str, ...]) -> DataFrame:
    """The distinct URLs with label 1 where a label of the host is on the list."""
    host = F.split(F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/?#:]*)", 1), r"\.")
    return pages.select("url").where("url is not null").distinct().select("url", F.arrays_overlap(host, F.array(*map(F.lit, blocked))).cast("int").alias("label"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every page's URL, scored and kept or not."""
    pages = tuned(spark).read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, train(spark.createDataFrame(LABELLED, "url string, label int")), keep=("page_id", "url"))
