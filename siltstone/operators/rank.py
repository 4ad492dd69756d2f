"""Lexical ranking: BM25, phrases, conjunctions, tombstones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.postings import pieces, sizes_of, within
from ..functions.text import fold, runs, tokenized

K1, B = 1.5, 0.75
#: Ties are numbered in stretches of 2 ** STRETCH ids.
STRETCH = 20
#: So many terms of all queries together are literals in the plan.
FEW = 2000


def query_terms(spark: SparkSession, queries: dict) -> DataFrame:
    """``query_id, term, qtf``: each query's terms and how often it has them."""
    rows: dict[tuple, int] = {}
    for name, text in queries.items():
        for term, _, _ in runs(text or ""):
            rows[name, term] = rows.get((name, term), 0) + 1
    kind = "string" if any(isinstance(k, str) for k in queries) else "long"
    return spark.createDataFrame([(q, t, n) for (q, t), n in rows.items()], f"query_id {kind}, term string, qtf long")


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def saturation(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """A term's frequency, damped and set against the document's length."""
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avgdl))


def few(terms: DataFrame) -> list[str] | None:
    """The distinct terms if they are few enough to stand in a plan, else none."""
    got = [r["term"] for r in terms.select("term").distinct().limit(FEW + 1).collect()]
    return got if len(got) <= FEW else None


def matches(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id, dl, found``: each document's length and those of its terms that are wanted.

    Few terms are sent to the scan, where each document's own terms are
    filtered before anything is exploded or shuffled; of more all are kept, for
    a join.
    """
    wanted = few(terms)
    held = tokenized(docs.select("doc_id", "text"))
    found = F.col("tokens") if wanted is None else F.filter("tokens", lambda t: t.isin(wanted)) if wanted else F.array().cast("array<string>")
    return held.select("doc_id", F.size("tokens").cast("long").alias("dl"), found.alias("found"))


def weights(df: DataFrame, stats: DataFrame, terms: DataFrame) -> DataFrame:
    """``query_id, term, avgdl, w``; the statistics are one row."""
    return terms.join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", "avgdl", (idf(F.col("n"), F.col("df")) * F.col("qtf")).alias("w"))


def scored(tf: DataFrame, weight: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``query_id, doc_id, score`` of all documents with any term.

    ``tf`` has each document's length.  A term that a query repeats counts as
    often.  Spark broadcasts the weights by their size.
    """
    return tf.join(weight, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias("score"))


def bm25(docs: DataFrame, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 of raw documents for any number of queries: ``query_id, doc_id, score``.

    One pass makes each document's length and matching terms; df and the
    averages come from the same narrow rows.
    """
    held = matches(docs, terms)
    stats = held.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    tf = held.where(F.size("found") > 0).select("doc_id", "dl", F.explode("found").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    # reads tf, so that both uses of tf have the same columns and share one exchange
    df = tf.groupBy("term").agg(F.sum((F.col("tf") > 0).cast("long")).alias("df"))
    return scored(tf, weights(df, stats, terms), k1, b)


#: So many weights of terms are sent to the documents for ``best``.
WEIGHTS = 1_000_000
#: A block of documents has so many scores, of all queries, at most.
_SCORES = 2_000_000


def best(docs: DataFrame, terms: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """The first k documents of each query by BM25: ``query_id, doc_id, score, rank``.

    For many queries, of which nearly every document has some term.  Documents
    are scored in their own rows, where the weights of all terms are sent, and of
    each piece of documents only a query's first k go on; so neither terms nor
    scores are shuffled.  Where ids repeat, or weights are too many to be sent,
    all scores are made and ranked.
    """
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1)
    if dict(docs.dtypes)["doc_id"] not in ("bigint", "int") or terms.limit(WEIGHTS + 1).count() > WEIGHTS or not repeated.isEmpty():
        return ranked(bm25(docs, terms, k1, b), k)
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast({r["term"] for r in terms.select("term").distinct().collect()})
    held = tokenized(docs.select("doc_id", "text")).select("doc_id", "tokens")

    def seen(batches):
        of = pa.array(sorted(wanted.value), pa.string())
        df, n, length = np.zeros(len(of), np.int64), 0, 0
        for batch in batches:
            for row, code, _, sizes in _found(batch.column(1), of):
                df += np.bincount(code, minlength=len(of))
                n, length = n + len(sizes), length + int(sizes.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([of.take(pa.array(some)), pa.array(df[some])], names=["term", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None, None], pa.string()), pa.array([n, -length - 1])], names=["term", "n"])

    # rows without a term: the documents, and (below 0, less 1) their lengths
    counts = held.mapInArrow(seen, "term string, n bigint").groupBy("term", F.expr("n < 0").alias("dl")).agg(F.sum(F.when(F.col("n") < 0, F.col("n") + 1).otherwise(F.col("n"))).alias("n")).collect()
    n = next((r["n"] for r in counts if r["term"] is None and not r["dl"]), 0)
    avgdl = -next((r["n"] for r in counts if r["term"] is None and r["dl"]), 0) / max(n, 1)
    df = spark.createDataFrame([(r["term"], r["n"]) for r in counts if r["term"] is not None], "term string, df long")
    weighed = terms.join(F.broadcast(df), "term").select("query_id", "term", (idf(F.lit(float(n)), F.col("df")) * F.col("qtf")).alias("w")).orderBy("term", "query_id").toPandas()
    names, first = np.unique(weighed["term"].to_numpy(dtype=object).astype(str), return_index=True) if len(weighed) else (np.zeros(0, str), np.zeros(0, np.int64))
    # code points, as Python orders strings, are also the order of UTF-8 bytes
    queries, number = np.unique(weighed["query_id"].to_numpy(), return_inverse=True)
    table = spark.sparkContext.broadcast((names.tolist(), np.append(first, len(weighed)), queries, number, weighed["w"].to_numpy(dtype=float)))
    schema = T.StructType([terms.schema["query_id"], docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def score(batches):
        names, begin, queries, number, w = table.value
        of, many = pa.array(names, pa.string()), np.diff(begin)
        for batch in batches:
            ids = batch.column(0)
            at = 0
            for row, code, tf, sizes in _found(batch.column(1), of, max(1, _SCORES // max(len(queries), 1))):
                each = saturation(tf.astype(float), sizes[row], avgdl, k1, b)
                times = many[code]
                entry = np.repeat(begin[code], times) + within(times)
                place = np.repeat(row, times) * len(queries) + number[entry]
                total = np.bincount(place, np.repeat(each, times) * w[entry], minlength=len(sizes) * len(queries)).reshape(len(sizes), len(queries))
                hit = np.flatnonzero(np.bincount(place, minlength=total.size))
                part = ids.slice(at, len(sizes))
                at += len(sizes)
                doc, query = hit // max(len(queries), 1), hit % max(len(queries), 1)
                value = total.ravel()[hit]
                # ranks go by rounded scores: those that may round to the k-th best one's all go on
                order = np.lexsort((part.to_numpy(zero_copy_only=False)[doc], -value, query))
                nth = within(np.bincount(query, minlength=len(queries)))
                low = np.full(len(queries), -np.inf)
                last = order[nth == k - 1]
                low[query[last]] = value[last]
                kept = np.flatnonzero(value >= low[query] - 2e-9)
                yield pa.RecordBatch.from_arrays([pa.array(queries[query[kept]]).cast(kind), part.take(pa.array(doc[kept])), pa.array(value[kept])], names=schema.names)

    kind = pa.int64() if schema["query_id"].dataType == T.LongType() else pa.int32() if schema["query_id"].dataType == T.IntegerType() else pa.string()
    return ranked(held.mapInArrow(score, schema), k)


def _found(tokens: pa.Array, of: pa.Array, most_rows: int = 1 << 20):
    """For pieces of rows: row, number in ``of``, and tf of each wanted term, and the rows' lengths."""
    for a, b in pieces(sizes_of(tokens)):
        for c in range(a, b, most_rows):
            part = tokens.slice(c, min(most_rows, b - c))
            sizes = sizes_of(part)
            code = pc.index_in(part.flatten(), value_set=of)
            here = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
            key = np.repeat(np.arange(len(sizes)), sizes)[here] * len(of) + code.fill_null(0).to_numpy(zero_copy_only=False)[here]
            key, tf = np.unique(key, return_counts=True)
            yield key // max(len(of), 1), key % max(len(of), 1), tf, sizes


def bm25_index(index, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """The same over a stored index, whose term filter reaches the scan."""
    wanted = few(terms)
    lengths = index.documents.select("doc_id", "dl")
    stats = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    if wanted is None:
        tf, df = index.postings, index.dictionary.groupBy("term").agg(F.sum("df").alias("df"))
    else:
        tf, df = index.lookup(*wanted), index.frequency(*wanted)
    return scored(tf.select("term", "doc_id", "tf").join(lengths, "doc_id"), weights(df, stats, terms), k1, b)


def numbered(rows: DataFrame, by: Column, then: str, within: tuple[str, ...] = (), into: str = "rank") -> DataFrame:
    """Adds each row's place from 1: ``by`` descending (none below 0), then ``then``.

    Without a limit all rows of a query have places, and one task would sort
    them.  So rows fall into bands of values a thousandth apart, and where a band
    has but one value, however many rows, into stretches of ``then``: of integers by
    their higher bits, of strings by how they begin.
    The counts of these pieces, a small table, give each one's first place, and
    only pieces are sorted.
    """
    words = dict(rows.dtypes)[then] == "string"
    part = F.substring(then, 1, 4) if words else F.shiftright(F.col(then).cast("long"), STRETCH)
    held = rows.withColumn("__by", by).withColumn("__band", F.floor(F.log(F.greatest(F.col("__by").cast("double"), F.lit(1e-300))) * 1000)).withColumn("__part", F.coalesce(part, F.lit("") if words else F.lit(0).cast("long")))
    counts = held.groupBy(*within, "__band", "__part").agg(F.count("*").alias("__n"), F.min("__by").alias("__lo"), F.max("__by").alias("__hi"))
    band = Window.partitionBy(*within, "__band")
    piece = F.when(F.min("__lo").over(band) == F.max("__hi").over(band), F.col("__part"))
    pieces = counts.withColumn("__piece", F.coalesce(piece, F.lit("") if words else F.lit(0).cast("long"))).select(*within, "__band", "__part", "__piece", "__n")
    before = Window.partitionBy(*within).orderBy(F.desc("__band"), "__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy(*within, "__band", "__piece").agg(F.sum("__n").alias("__n")).select(*within, "__band", "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    named = pieces.drop("__n").join(offsets, [*within, "__band", "__piece"])
    place = Window.partitionBy(*within, "__band", "__piece").orderBy(F.desc("__by"), then)
    return held.join(named, [*within, "__band", "__part"]).select(*rows.columns, (F.row_number().over(place) + F.col("__before")).alias(into))


def ranked(scores: DataFrame, k: int | None = None, id_column: str = "doc_id") -> DataFrame:
    """Adds ``rank`` by score, then id; the first k of each query."""
    if k is None:
        return numbered(scores, F.round("score", 9), id_column, ("query_id",))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), id_column)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def without(rows: DataFrame, deleted: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Rows whose id isn't deleted; statistics made before don't change."""
    return rows.join(deleted.select(id_column).distinct(), id_column, "left_anti")


def with_phrase(docs: DataFrame, phrase: str) -> DataFrame:
    """``doc_id`` of the documents that have the phrase's terms in a row."""
    terms = [t for t, _, _ in runs(phrase)]
    if not terms:
        return docs.select("doc_id").limit(0)
    # terms have no line feeds, so a run of terms is a substring of the joined list
    held = F.concat(F.lit("\n"), F.array_join("tokens", "\n"), F.lit("\n"))
    return tokenized(docs.select("doc_id", "text")).where(held.contains("\n" + "\n".join(terms) + "\n")).select("doc_id")


def with_phrase_index(index, phrase: str) -> DataFrame:
    """The same over stored postings: an equi-join a term, the rarest first."""
    terms = [fold(t) for t, _, _ in runs(phrase)]
    if not terms:
        return index.documents.select("doc_id").limit(0)
    df = {r["term"]: r["df"] for r in index.frequency(*terms).collect()}
    if any(t not in df for t in terms):
        return index.documents.select("doc_id").limit(0)
    out = None
    for i, t in sorted(enumerate(terms), key=lambda x: df[x[1]]):
        starts = index.lookup(t).select("doc_id", F.transform("positions", lambda p: p - F.lit(i)).alias(f"s{i}"))
        out = starts.withColumnRenamed(f"s{i}", "s") if out is None else out.join(starts, "doc_id").select("doc_id", F.array_intersect("s", f"s{i}").alias("s")).where(F.size("s") > 0)
    return out.select("doc_id").distinct()


def with_all_terms(docs: DataFrame, query: str) -> DataFrame:
    """``doc_id`` of the documents that have every term of the query."""
    terms = sorted({t for t, _, _ in runs(query)})
    held = tokenized(docs.select("doc_id", "text"))
    has = F.lit(bool(terms))
    for t in terms:
        has = has & F.array_contains("tokens", t)
    return held.where(has).select("doc_id")
