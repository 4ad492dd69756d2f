"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log-probabilities, one row per hash bucket and one
column per class.  It is fitted on a bounded sample of labelled rows, broadcast
(its size is fixed by ``BUCKETS`` and the number of languages), and applied to
whole texts as a sparse product: each n-gram occurrence adds one matrix row to
its document's scores.

Defined results
---------------
* A null or empty text, or one without letters, has a null language, a
  confidence of 0 and is rejected.
* Letters are folded to lower case; everything that isn't a letter is a space,
  runs of spaces count once, and n-grams of spaces alone don't count.
* The background is fitted on the labelled texts with each one's letters in
  random order: words of the same letters that are no language's.  A text is
  rejected where its best language doesn't explain it better than the
  background by ``min_margin`` an n-gram on average (noise, codes, scripts that
  weren't learned), or where the posterior of the best language is below
  ``min_confidence`` (texts too short to tell).
* Texts of any length are scored whole, in parts that hand their last symbols
  on, so no n-gram is lost between them.
* Ties between languages go to the first in alphabetical order.
* Repeated rows are scored alike; other columns are passed through, and a
  column of the input whose name is that of a result column is replaced.
* With no labelled row, all is rejected.  More than ``max_languages`` labels are
  an error: the broadcast matrix grows with them.  An empty table gives an
  empty result.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from .frames import by_place, column, extended, tuned

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Characters taken at once: bounds memory for texts of any length.
CHUNK = 500_000
SPACE = 32
#: Code points from here on are held to be no letters.
LETTERS_END = 0x32400
MIN_CONFIDENCE = 0.5
MIN_MARGIN = 0.0
RESULT = ("language", "confidence", "accepted")


@cache
def _fold() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    table = np.full(LETTERS_END, SPACE, dtype=np.uint32)
    for cp in range(LETTERS_END - 1):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
        elif unicodedata.category(ch).startswith("M"):
            table[cp] = cp
    return table


def _folded(raw: str) -> np.ndarray:
    joined = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _fold()[np.minimum(joined, LETTERS_END - 1)]


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, each within spaces, and their offsets."""
    folded = _folded("".join(f" {t} " for t in texts))
    sizes = np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = (folded[1:] != SPACE) | (folded[:-1] != SPACE)
    keep[offsets[:-1]] = True
    return folded[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def _grams(symbols: np.ndarray, offsets: np.ndarray, carried: int = 0):
    """Per order, bucket of the n-gram at each place; ``BUCKETS`` where there is none.

    ``carried``: so many symbols at the beginning belong to the part before, of
    which n-grams aren't counted again.
    """
    owner_end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(len(symbols))
    code = np.zeros(len(symbols), dtype=np.uint32)
    letters = symbols != SPACE
    some = np.zeros(len(symbols), dtype=bool)
    for n in range(1, max(ORDERS) + 1):
        k, m = n - 1, max(len(symbols) - n + 1, 0)
        code *= np.uint32(0x01000193)
        code[:m] += symbols[k : k + m] + np.uint32(1)
        some[:m] |= letters[k : k + m]
        if n in ORDERS:
            h = code * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            bucket = (h >> np.uint32(32 - 15)).astype(np.int32)
            yield np.where((at + n <= owner_end) & some & (at + n > carried), bucket, BUCKETS)


def _pieces(texts: list[str]):
    """Rows, symbols, offsets and carried symbols, of about ``CHUNK`` characters.

    A longer row comes in parts; each begins with the last symbols of the one
    before, as many as an n-gram across the break may need.
    """
    rows: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if rows and size + len(t) > CHUNK:
            yield np.array(rows), *_symbols([texts[r] for r in rows]), 0
            rows, size = [], 0
        if len(t) <= CHUNK:
            rows.append(i)
            size += len(t)
            continue
        tail = np.zeros(0, np.uint32)
        for a in range(0, len(t), CHUNK):
            held = np.concatenate([tail, _folded(" " * (a == 0) + t[a : a + CHUNK] + " " * (a + CHUNK >= len(t)))])
            keep = np.append(True, (held[1:] != SPACE) | (held[:-1] != SPACE))
            symbols, carried = held[keep], len(tail)
            yield np.array([i]), symbols, np.array([0, len(symbols)]), carried
            tail = symbols[-(max(ORDERS) - 1) :]
    if rows:
        yield np.array(rows), *_symbols([texts[r] for r in rows]), 0


def counts(texts: list[str]) -> np.ndarray:
    """N-gram counts of all texts together, by bucket."""
    total = np.zeros(BUCKETS + 1, dtype=np.int64)
    for _, symbols, offsets, carried in _pieces(texts):
        for bucket in _grams(symbols, offsets, carried):
            total += np.bincount(bucket, minlength=BUCKETS + 1)
    return total[:BUCKETS]


def shuffled_counts(texts: list[str], seed: int = 7) -> np.ndarray:
    """The same with the symbols inside each text in random order."""
    total = np.zeros(BUCKETS + 1, dtype=np.int64)
    for _, symbols, offsets, carried in _pieces(texts):
        rng = np.random.default_rng([seed, len(symbols)])
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        mixed = symbols[np.lexsort((rng.random(len(symbols)), owner))]
        for bucket in _grams(mixed, offsets, carried):
            total += np.bincount(bucket, minlength=BUCKETS + 1)
    return total[:BUCKETS]


@dataclass
class Model:
    languages: list[str]
    #: BUCKETS + 1 rows; one column per language, then the background; the last row is zero.
    weights: np.ndarray
    prior: np.ndarray

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log joint probability per text and class, and each text's number of n-grams."""
        out = np.zeros((len(texts), self.weights.shape[1]))
        seen = np.zeros(len(texts), dtype=np.int64)
        for at, symbols, offsets, carried in _pieces(texts):
            for bucket in _grams(symbols, offsets, carried):
                for c in range(self.weights.shape[1]):
                    sums = np.concatenate([[0.0], np.cumsum(self.weights[:, c][bucket], dtype=np.float64)])
                    np.add.at(out[:, c], at, sums[offsets[1:]] - sums[offsets[:-1]])
                found = np.concatenate([[0], np.cumsum(bucket < BUCKETS)])
                np.add.at(seen, at, found[offsets[1:]] - found[offsets[:-1]])
        return out + self.prior, seen

    def predict(self, texts: list[str], min_confidence: float = MIN_CONFIDENCE, min_margin: float = MIN_MARGIN):
        n, k = len(texts), len(self.languages)
        if not k:
            return [None] * n, np.zeros(n), np.zeros(n, dtype=bool)
        scores, seen = self.scores(texts)
        own = scores[:, :k]
        best = own.argmax(axis=1)
        top = own[np.arange(n), best]
        confidence = np.where(seen > 0, 1.0 / np.exp(own - top[:, None]).sum(axis=1), 0.0)
        accepted = (seen > 0) & (confidence >= min_confidence) & (top - scores[:, k] >= min_margin * seen)
        return [self.languages[b] if s else None for b, s in zip(best, seen)], confidence, accepted


def fit_counts(by_language: dict[str, np.ndarray], smoothing: float = 0.5, background: np.ndarray | None = None) -> Model:
    """Without counts of a background it holds every bucket equally likely."""
    languages = sorted(by_language)
    k = len(languages)
    weights = np.zeros((BUCKETS + 1, k + 1), dtype=np.float32)
    for c, held in enumerate([*(by_language[name] for name in languages), np.zeros(BUCKETS) if background is None else background]):
        held = held + smoothing
        weights[:BUCKETS, c] = np.log(held / held.sum())
    return Model(languages, np.asfortranarray(weights), np.full(k + 1, -np.log(max(k, 1))))


def train(docs: DataFrame, text: str = "text", label: str = "lang", max_rows_per_language: int = 3000, max_languages: int = 512, seed: int = 7) -> Model:
    """Fits on at most ``max_rows_per_language`` labelled rows a language.

    The sample is a Bernoulli one by a hash of the text, at a rate that follows
    from the exact count of each language.  Rows without label or text are not
    used.    """
    spark = tuned(docs.sparkSession)
    rows = docs.select(column(docs, label).cast("string").alias("label"), column(docs, text).cast("string").alias("text")).where("label is not null and text is not null")
    found = rows.groupBy("label").count().limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not found:
        return fit_counts({})
    rate = spark.createDataFrame([(r["label"], min(1.0, max_rows_per_language / r["count"])) for r in found], "label string, rate double")
    draw = (F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1_000_000)) + 0.5) / 1_000_000
    chosen = rows.join(F.broadcast(rate), "label").where(draw < F.col("rate")).select("label", "text")

    def count(batches):
        held: dict[str, list[np.ndarray]] = {}
        for b in batches:
            labels = np.array(b.column("label").to_pylist(), dtype=object)
            texts = b.column("text").to_pylist()
            for name in set(labels):
                own = [texts[i] for i in np.flatnonzero(labels == name)]
                new = [counts(own), shuffled_counts(own, seed)]
                held[name] = [x + y for x, y in zip(held[name], new)] if name in held else new
        if held:
            yield pa.RecordBatch.from_pydict({"label": list(held), "counts": [np.concatenate(c).tobytes() for c in held.values()]}, schema=pa.schema([("label", pa.string()), ("counts", pa.binary())]))

    def add(key, batch):
        arrays = [np.frombuffer(x, dtype=np.int64) for x in batch.column("counts").to_pylist()]
        return pa.table({"label": [key[0].as_py()], "counts": [sum(arrays[1:], arrays[0].copy()).tobytes()]})

    parts = chosen.mapInArrow(count, "label string, counts binary").groupBy("label").applyInArrow(add, "label string, counts binary")
    got = {r["label"]: np.frombuffer(r["counts"], dtype=np.int64).reshape(2, BUCKETS) for r in parts.collect()}
    return fit_counts({name: c[0] for name, c in got.items()}, background=sum(c[1] for c in got.values()) / len(got) if got else None)


def identify(docs: DataFrame, model: Model, text: str = "text", min_confidence: float = MIN_CONFIDENCE, keep_text: bool = True, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Adds ``language``, ``confidence`` and ``accepted`` to every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    result = T.StructType([T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def run(texts):
        language, confidence, accepted = held.value.predict([t or "" for t in texts.to_pylist()], min_confidence, min_margin)
        return pa.array(language, pa.string()), pa.array(confidence), pa.array(accepted, pa.bool_())

    return extended(docs, [text], run, result, () if keep_text else (text,))


def query(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents' own labels."""
    docs = spread(tuned(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))
    found = identify(docs, train(docs), keep_text=False)
    return found.withColumn("confidence", F.round("confidence", 6))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language isn't accepted go; columns stay as they are."""
    held = spark.sparkContext.broadcast(train(docs))
    named, (text,) = by_place(docs, "text")
    given = named.select("*", column(named, text).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            _, _, accepted = held.value.predict([t or "" for t in b.column(len(b.schema) - 1).to_pylist()])
            yield b.select(list(range(len(b.schema) - 1))).filter(pa.array(accepted, pa.bool_()))

    return given.mapInArrow(run, named.schema).toDF(*docs.columns)
