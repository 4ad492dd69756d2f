"""The inverted index as tables: postings, documents, dictionary, segments.

A posting is a row ``(segment_id, term, doc_id, tf, positions)``.  Stored, the
postings are partitioned by segment and sorted by term, so a term lookup reads
few row groups; document lengths and the dictionary are tables of their own,
so scoring never reads positions and df never reads postings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import postings as codes
from ..functions.text import tokenized


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, pos, term`` of every term, positions from 0."""
    return tokenized(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", F.posexplode("tokens").alias("pos", "term"))


def _in_rows(docs: DataFrame, result: list[str]) -> DataFrame:
    """Of each row, its columns but for the text, and ``term`` with some of ``tf,
    positions, gaps`` (as varint bytes); nothing is shuffled."""
    kept = [c for c in docs.columns if c != "text"]
    held = tokenized(docs).select(*kept, "tokens")
    kinds = {"term": T.StringType(), "tf": T.LongType(), "positions": T.ArrayType(T.IntegerType()), "gaps": T.BinaryType()}
    schema = T.StructType([*held.drop("tokens").schema.fields, *(T.StructField(c, kinds[c]) for c in ("term", *result))])

    def run(batches):
        for batch in batches:
            for a, b in codes.pieces(codes.sizes_of(batch.column(len(kept)))):
                part = batch.slice(a, b - a)
                row, term, tf, positions = codes.grouped(part.column(len(kept)))
                made = {"tf": lambda: pa.array(tf), "positions": lambda: codes.lists(pa.array(positions.astype(np.int32)), tf), "gaps": lambda: _coded(positions, tf)}
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(at) for i in range(len(kept))), term, *(made[c]() for c in result)], names=schema.names)

    return held.mapInArrow(run, schema)


def _coded(positions: np.ndarray, tf: np.ndarray) -> pa.Array:
    data, size = codes.varints(codes.as_gaps(positions, tf))
    return codes.binaries(data, np.add.reduceat(size, np.cumsum(tf) - tf) if len(tf) else size)


#: A table of ids of at most so many rows is sent to the documents.
FEW_IDS = 1_000_000


def small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(FEW_IDS + 1).count() <= FEW_IDS else ids


def by_id(docs: DataFrame, made, merge) -> DataFrame:
    """``made`` of the documents, where rows of one id count as one document.

    Only rows whose id stands on several are merged, by a shuffle.
    """
    again = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id"))
    if again.isEmpty():
        return made(docs)
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    again = small(again)
    return made(docs.join(again, same, "left_anti")).unionByName(merge(made(docs.join(again, same, "left_semi"))))


def term_frequency(docs: DataFrame) -> DataFrame:
    """``doc_id, term, tf``."""
    return by_id(docs.select("doc_id", "text"), lambda d: _in_rows(d, ["tf"]), lambda tf: tf.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")))


def postings(docs: DataFrame) -> DataFrame:
    """``term, doc_id, tf, positions`` (ascending)."""
    return by_id(docs.select("doc_id", "text"), lambda d: _in_rows(d, ["tf", "positions"]), lambda p: p.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))).select("term", "doc_id", "tf", "positions")


def doc_lengths(docs: DataFrame) -> DataFrame:
    """``doc_id, dl``; documents without terms have length 0."""
    return tokenized(docs.select("doc_id", "text")).select("doc_id", F.size("tokens").cast("long").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row ``n, avgdl``; 0 for an empty corpus."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def dictionary(tf: DataFrame) -> DataFrame:
    return tf.select("term").distinct()


def gaps(occ: DataFrame) -> DataFrame:
    """Each position less the one before of the same term and document (the first is its own)."""
    w = Window.partitionBy("doc_id", "term").orderBy("pos")
    return occ.withColumn("gap", (F.col("pos") - F.lag("pos", 1, 0).over(w)).cast("int"))


def posting_gaps(post: DataFrame) -> DataFrame:
    """``doc_id, term, pos, gap`` of postings: each position less the one before (the first is its own)."""
    gap = F.transform("positions", lambda p, i: p - F.coalesce(F.get("positions", i - 1), F.lit(0)))
    return post.select("doc_id", "term", F.explode(F.arrays_zip(F.col("positions").alias("pos"), gap.alias("gap"))).alias("g")).select("doc_id", "term", "g.pos", "g.gap")


def coded(docs: DataFrame) -> DataFrame:
    """``doc_id, term, gaps``: the positions of each row's terms as gaps, in varint bytes."""
    return _in_rows(docs.select("doc_id", "text"), ["gaps"])


def decoded(held: DataFrame) -> DataFrame:
    """``doc_id, term, positions`` back from the bytes; running it fails where positions don't rise."""
    kind = dict(held.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            for a, b in codes.pieces(codes.flat_binary(batch.column(2))[1]):
                part = batch.slice(a, b - a)
                data, size = codes.flat_binary(part.column(2))
                # a value ends with a byte below 128
                count = np.diff(np.append(0, np.cumsum(data < 128))[np.append(0, np.cumsum(size))])
                positions = codes.as_positions(codes.unvarints(data), count)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), codes.lists(pa.array(positions.astype(np.int32)), count)], names=["doc_id", "term", "positions"])

    return held.select("doc_id", "term", "gaps").mapInArrow(run, f"doc_id {kind}, term string, positions array<int>")


def undone(gapped: DataFrame) -> DataFrame:
    """Positions back from gaps (columns doc_id, term, nth, gap): a running sum.

    Running it fails where a position doesn't rise, as decoding does.
    """
    w = Window.partitionBy("doc_id", "term").orderBy("nth")
    rises = (F.col("gap") > 0) | ((F.row_number().over(w) == 1) & (F.col("gap") == 0))
    held = gapped.withColumn("__ok", F.assert_true(rises, F.lit("positions must rise"))).withColumn("pos", F.sum("gap").over(w).cast("int"))
    return held.where("__ok is null").drop("__ok")


def varint(value: Column) -> Column:
    """The bytes of a value, seven bits in each, the lowest first, in hex."""
    last = F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / F.lit(7))).cast("int") - 1
    part = lambda i: F.shiftrightunsigned(value, 7 * i).bitwiseAND(F.lit(127).cast("long")) + F.when(F.lit(i) < last, F.lit(128)).otherwise(F.lit(0))
    return F.concat_ws("", *[F.when(F.lit(i) <= last, F.lpad(F.hex(part(i)), 2, "0")) for i in range(10)])


def unvarint(digits: Column) -> Column:
    """The value of the bytes that ``varint`` made."""
    bytes_ = F.transform(F.sequence(F.lit(0), (F.length(digits) / F.lit(2)).cast("int") - 1), lambda i: F.conv(F.substr(digits, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(F.reverse(bytes_), F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 7) + b.bitwiseAND(F.lit(127).cast("long")))


def varint_bytes(value: Column) -> Column:
    """Bytes of the value, seven bits in each."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / F.lit(7))).cast("long")


def increasing(occ: DataFrame) -> DataFrame:
    """The same rows; running it fails where positions don't rise strictly."""
    w = Window.partitionBy("doc_id", "term").orderBy("nth")
    rising = F.coalesce(F.col("pos") > F.lag("pos").over(w), F.lit(True))
    return occ.withColumn("__ok", F.assert_true(rising, F.lit("positions must rise"))).where("__ok is null").drop("__ok")


def contiguous(docs: DataFrame) -> DataFrame:
    """One row; running it fails unless ids run from 0 without gaps or repeats."""
    s = docs.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    ok = (F.col("n") == 0) | ((F.col("n") == F.col("ids")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1))
    return s.withColumn("__ok", F.assert_true(ok, F.lit("ids must run from 0"))).where("__ok is null").drop("__ok")


def checksums(df: DataFrame, columns: list[str]) -> DataFrame:
    """CRC-32 of the columns' text of each row, for integrity checks."""
    return df.withColumn("crc", F.crc32(F.concat_ws("\0", *[F.col(c).cast("string") for c in columns])))


# ---- segments --------------------------------------------------------------


def segment_docs(docs: DataFrame, segment: Column) -> DataFrame:
    """Adds ``segment_id`` and ``local_id``, from 0 in each segment by id."""
    w = Window.partitionBy("segment_id").orderBy("doc_id")
    return docs.withColumn("segment_id", segment).withColumn("local_id", (F.row_number().over(w) - 1).cast("long"))


def bases(segmented: DataFrame) -> DataFrame:
    """``segment_id, n, base``: where each segment's ids begin in the joint id space."""
    w = Window.orderBy("segment_id").rowsBetween(Window.unboundedPreceding, -1)
    return segmented.groupBy("segment_id").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0)))


def global_ids(segmented: DataFrame) -> DataFrame:
    """Adds ``global_id``: the segment's base and the local id."""
    return segmented.join(F.broadcast(bases(segmented)), "segment_id").withColumn("global_id", F.col("base") + F.col("local_id")).drop("n", "base")


def located(ids: DataFrame, base: DataFrame, column: str = "global_id") -> DataFrame:
    """Segment and local id of joint ids: a range join with the (few) bases."""
    return ids.join(F.broadcast(base), (F.col(column) >= F.col("base")) & (F.col(column) < F.col("base") + F.col("n"))).withColumn("local_id", F.col(column) - F.col("base")).drop("n", "base")


def joint_avgdl(segmented: DataFrame) -> DataFrame:
    """Average length over segments from each one's own average."""
    each = segmented.groupBy("segment_id").agg(F.count("*").alias("n"), F.avg("dl").alias("a"))
    return each.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.col("a") * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("avgdl"))


def merged(segmented: DataFrame, deleted: DataFrame) -> DataFrame:
    """Survivors of all segments as one, renumbered in segment order.

    ``new_id`` counts on through the segments: each survivor's rank in its
    segment and the survivors of the segments before.
    """
    live = segmented.join(deleted.select("doc_id").distinct(), "doc_id", "left_anti")
    w = Window.partitionBy("segment_id").orderBy("local_id")
    ranked = live.withColumn("nth", F.row_number().over(w) - 1)
    return ranked.join(F.broadcast(bases(live)), "segment_id").withColumn("new_id", (F.col("base") + F.col("nth")).cast("long")).drop("nth", "n", "base")


def _blocks(post: DataFrame) -> DataFrame:
    """Postings packed into blocks: of each piece of rows, one a segment and term."""
    rows = post.select("segment_id", "term", "doc_id", "tf", "positions")
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            for a, b in codes.pieces(codes.sizes_of(batch.column(4))):
                part = batch.slice(a, b - a)
                yield codes.packed(*(part.column(i) for i in range(3)), part.column(3).to_numpy(), part.column(4).flatten().to_numpy().astype(np.int64))

    return rows.mapInArrow(run, f"segment_id {kinds['segment_id']}, term string, first {kinds['doc_id']}, ids array<{kinds['doc_id']}>, tfs binary, gaps binary")


def _store(blocks: DataFrame, path: str) -> None:
    """Writes postings, clustered by segment and term, and the dictionary.

    Blocks, not postings, are moved and sorted, so that a term's text moves once
    a block; postings are made of them again as they are written.
    """
    spark = blocks.sparkSession
    kinds = dict(blocks.dtypes)
    ordered = blocks.repartitionByRange("segment_id", "term", "first").sortWithinPartitions("segment_id", "term", "first")

    def run(batches):
        for batch in batches:
            yield from codes.unpacked(batch)

    rows = ordered.mapInArrow(run, f"segment_id {kinds['segment_id']}, term string, doc_id {kinds['first']}, tf bigint, positions array<int>")
    # a task has few segments, in order: without this all postings would be sorted by segment once more
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, "8")
    try:
        rows.write.mode("overwrite").partitionBy("segment_id").parquet(f"{path}/postings")
    finally:
        spark.conf.set(key, before)
    stored = spark.read.parquet(f"{path}/postings")
    stored.groupBy("segment_id", "term").agg(F.count("*").alias("df")).write.mode("overwrite").partitionBy("segment_id").parquet(f"{path}/dictionary")


def write_index(docs: DataFrame, path: str, segment: Column | None = None, terms_per_file: int | None = None) -> None:
    """Writes an index: ``postings``, ``documents`` and ``dictionary`` under the path.

    Each document goes to a segment; postings are clustered by term in it.
    Texts are never shuffled.
    """
    named = docs.withColumn("segment_id", segment if segment is not None else F.lit(0))
    lengths = tokenized(named).select("segment_id", "doc_id", F.size("tokens").cast("long").alias("dl"))
    segment_docs(lengths, F.col("segment_id")).select("segment_id", "local_id", "doc_id", "dl").write.mode("overwrite").partitionBy("segment_id").parquet(f"{path}/documents")
    post = by_id(
        named.select("segment_id", "doc_id", "text"),
        lambda d: _in_rows(d, ["tf", "positions"]),
        lambda p: p.groupBy("segment_id", "doc_id", "term").agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions")),
    )
    _store(_blocks(post), path)


class Index:
    """A stored index; its tables are read with their partitions and statistics."""

    def __init__(self, spark: SparkSession, path: str):
        self.postings = spark.read.parquet(f"{path}/postings")
        self.documents = spark.read.parquet(f"{path}/documents")
        self.dictionary = spark.read.parquet(f"{path}/dictionary")

    def lookup(self, *terms: str) -> DataFrame:
        """Postings of the terms; the filter reaches the scan."""
        return self.postings.where(F.col("term").isin(*terms))

    def frequency(self, *terms: str) -> DataFrame:
        return self.dictionary.where(F.col("term").isin(*terms)).groupBy("term").agg(F.sum("df").alias("df"))


def merge_index(spark: SparkSession, path: str, deleted: DataFrame, target: str, segment_id: int = 0) -> None:
    """All segments without the deleted documents, as one segment of a new index.

    Terms that are left without documents vanish with their last posting.
    """
    old = Index(spark, path)
    live = merged(old.documents, deleted)
    live.select(F.lit(segment_id).alias("segment_id"), F.col("new_id").alias("local_id"), "doc_id", "dl").write.mode("overwrite").partitionBy("segment_id").parquet(f"{target}/documents")
    gone = small(deleted.select("doc_id").distinct())
    _store(_blocks(old.postings.join(gone, "doc_id", "left_anti").withColumn("segment_id", F.lit(segment_id))), target)
