"""File sources and sinks: corpora, queries, logs, embedding files."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

EXPERIENCE = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "source", "product", "skin_tone", "climate")])
CRAWL = T.StructType([T.StructField("text", T.StringType()), T.StructField("source_url", T.StringType()), T.StructField("fetched_at", T.StringType())])
QUERY = T.StructType([T.StructField("query", T.StringType()), T.StructField("note", T.StringType()), T.StructField("judgments", T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("relevance", T.IntegerType())])))])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no`` (from 0), ``line`` of text files, in the order of files and lines."""
    return _numbered(_placed(spark, path), "line_no").select("line_no", "line")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, its piece, and an order inside the piece: files are split as usual."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__piece"), F.monotonically_increasing_id().alias("__at"), F.col("value").alias("line"))


def _numbered(placed: DataFrame, into: str) -> DataFrame:
    """Numbers from 0: pieces are counted, and each then numbers its own lines from its first."""
    before = Window.orderBy("__file", "__piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("__file", "__piece").agg(F.count("*").alias("__n"))
    first = counts.select("__file", "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("__file", "__piece").orderBy("__at")
    return placed.join(first, ["__file", "__piece"]).withColumn(into, (F.col("__first") + F.row_number().over(within) - 1).cast("long"))


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``doc_id`` (order of the lines that aren't blank) and the fields; a bad line fails."""
    held = _numbered(_placed(spark, path).where(F.trim("line") != ""), "doc_id").select("doc_id", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r"))
    return held.select("doc_id", *[F.coalesce(f"r.{f.name}", F.lit("")).alias(f.name) for f in schema.fields])


def experiences(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, EXPERIENCE)


def crawled(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, CRAWL).select("doc_id", "text", "source_url")


def known_pages(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, CRAWL).select("source_url").distinct()


def as_passages(docs: DataFrame) -> DataFrame:
    """Corpus rows as passages: the source stands for the address."""
    return docs.select("doc_id", "text", F.col("source").alias("source_url"), "product", F.lit("").alias("product_category"), "skin_tone", "climate", F.lit("").alias("duration_of_use"))


def embedder_input(spark: SparkSession, path: str) -> DataFrame:
    """``id, text``; running it fails where an id hasn't 64 characters."""
    rows = spark.read.schema("id string, text string").option("mode", "FAILFAST").json(path)
    return rows.withColumn("__ok", F.assert_true(F.length("id") == 64, F.lit("ids have 64 characters"))).where("__ok is null").drop("__ok")


def judged_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Queries (``query_id, query``) and judgments (``query_id, doc_id, relevance``), in file order."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", T.ArrayType(QUERY), {"mode": "FAILFAST"})).alias("query_id", "q"))
    whole = whole.withColumn("query_id", F.col("query_id").cast("long"))
    return whole.select("query_id", "q.query"), whole.select("query_id", F.explode("q.judgments").alias("j")).select("query_id", "j.doc_id", "j.relevance")


def replayed(log: DataFrame, schema: T.StructType | str, order: str = "line_no", line: str = "line") -> DataFrame:
    """A log's entries up to the first line that can't be read.

    The first bad line is one aggregate over the log; no global sort.
    """
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    with_bad = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    read = log.where(F.trim(line) != "").select(order, F.from_json(line, with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = read.where(F.col("r").isNull() | F.col("r._bad").isNotNull()).agg(F.min(order).alias("__stop"))
    return read.crossJoin(F.broadcast(bad)).where(F.col("__stop").isNull() | (F.col(order) < F.col("__stop"))).select(order, *[f"r.{f.name}" for f in kind.fields])


def rewritten(existing: DataFrame, new: DataFrame, key: str = "source_url") -> DataFrame:
    """A corpus with the new rows after the old ones; pages that it had aren't taken again."""
    return existing.unionByName(new.join(existing.select(key).distinct(), key, "left_anti").select(*existing.columns))


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


# ---- embedding files -------------------------------------------------------

_HEAD = struct.Struct("<4sIIqQQQQ")


def read_embedding_file(path: str) -> tuple[dict, list[tuple[str, list[float]]]]:
    """Header and records; a wrong checksum or signature fails."""
    data = open(path, "rb").read()
    if len(data) < _HEAD.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError(f"{path}: checksum")
    magic, version, dim, made, n, name_at, name_size, at = _HEAD.unpack_from(data)
    if magic != b"TTE1":
        raise ValueError(f"{path}: signature")
    rows = []
    for i in range(n):
        o = at + i * (64 + 4 * dim)
        rows.append((data[o : o + 64].decode(), list(struct.unpack_from(f"<{dim}f", data, o + 64))))
    return {"version": version, "dim": dim, "generated_at": made, "model": data[name_at : name_at + name_size].decode()}, rows


def write_embedding_file(path: str, rows: list[tuple[str, list[float]]], model: str = "", generated_at: int = 0) -> None:
    dim = len(rows[0][1]) if rows else 0
    name = model.encode()
    body = _HEAD.pack(b"TTE1", 1, dim, generated_at, len(rows), _HEAD.size, len(name), _HEAD.size + len(name)) + name
    for key, vector in rows:
        if len(key) != 64:
            raise ValueError("ids have 64 characters")
        body += key.encode() + struct.pack(f"<{dim}f", *vector)
    with open(path, "wb") as f:
        f.write(body + struct.pack("<I", zlib.crc32(body)))


class EmbeddingFiles(DataSource):
    """``spark.read.format("tte1")``: passage_id, vector; one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "tte1"

    def schema(self) -> str:
        return "passage_id string, vector array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("model", ""))


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(p) for p in self.path.split(",")]

    def read(self, partition):
        yield from read_embedding_file(partition.value)[1]


class _Writer(DataSourceWriter):
    """Each task writes a file of its own beside the given path."""

    def __init__(self, path: str, model: str):
        self.path, self.model = path, model

    def write(self, iterator):
        from pyspark import TaskContext

        rows = [(r["passage_id"], list(r["vector"])) for r in iterator]
        write_embedding_file(f"{self.path}.{TaskContext.get().partitionId():05d}", rows, self.model)
        return WriterCommitMessage()
