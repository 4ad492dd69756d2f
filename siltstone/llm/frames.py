"""Spark plumbing that the corpus operators share."""

from __future__ import annotations

import math
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir, tuned
from .textarrays import mix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str):
    """The column of that exact name; a null literal where it is missing."""
    return df[f"`{name}`"] if name in df.columns else F.lit(None)


def by_place(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """The rows with columns named by place, ``c0`` and on, and the new names of some.

    No name of the input can then clash with those an operator makes; ``toDF``
    with the old names brings them back.  A column that is missing has no name.
    """
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(df.columns)))}
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [at.get(n, "") for n in names]


def extended(docs: DataFrame, using: list[str], fn: Callable, result: T.StructType, drop: tuple[str, ...] = (), keep: tuple[str, ...] | None = None) -> DataFrame:
    """The rows with the result's columns, which ``fn`` makes of Arrow arrays of strings.

    Columns of the input pass, whatever their names, but for those named as a
    result column (in any case of letters), those to drop, and, if ``keep`` is
    given, those that it doesn't name.
    """
    tuned(docs.sparkSession)
    named, places = by_place(docs, *using)
    gone = {f.name.lower() for f in result.fields}
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in gone and c not in drop and (keep is None or c in keep)]
    given = named.select(*[F.col(f"c{i}") for i in kept], *[column(named, p).cast("string").alias(f"in{j}") for j, p in enumerate(places)])
    schema = T.StructType([*(T.StructField(f"c{i}", named.schema.fields[i].dataType) for i in kept), *result.fields])

    def run(batches):
        for b in batches:
            made = fn(*(b.column(len(kept) + j) for j in range(len(places))))
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(len(kept))), *made], names=schema.names)

    return given.mapInArrow(run, schema).toDF(*[docs.columns[i] for i in kept], *result.names)


#: The tables that the innermost ``scratch`` of this thread deletes.
_scope: ContextVar[list[str] | None] = ContextVar("siltstone_scope", default=None)


def _files(spark: SparkSession, path: str):
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), name


def saved(df: DataFrame, keep: bool = False) -> DataFrame:
    """Writes the rows to the shared folder and reads them back.

    This cuts the lineage in a way that survives the loss of any executor.
    Within ``scratch`` the files last until its end, unless they are to be kept;
    what is kept, and what isn't within one, lasts as long as the application.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    scope = _scope.get()
    if scope is not None and not keep:
        scope.append(path)
    df.write.parquet(path)
    if scope is None or keep:
        files, name = _files(spark, path)
        files.deleteOnExit(name)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_in = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that ``saved`` wrote and that is read no more."""
    files, name = _files(df.sparkSession, df.saved_in)
    files.delete(name, True)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end what was saved within, so that no step leaves its tables to the next."""
    token = _scope.set([])
    try:
        yield
    finally:
        for path in _scope.get():
            files, name = _files(spark, path)
            files.delete(name, True)
        _scope.reset(token)


# ---- joins of texts with tables of keys ------------------------------------

#: A table of keys that is sent to texts as it is has so many rows at most: some 70 MB.
BROADCAST_ROWS = 200_000
#: A filter of keys never has more bytes; with more than some 20 million keys it
#: lets more rows through, which the join then settles.
FILTER_BYTES = 32 << 20
_HASHES = 5


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key in a filter of a power of two of them."""
    shift = np.uint64(65 - bits.bit_length())
    return np.stack([mix(keys + np.uint64(0x9E3779B97F4A7C15) * np.uint64(j + 1)) >> shift for j in range(_HASHES)], axis=1)


def key_filter(keys: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the keys (one column of longs), of at most ``FILTER_BYTES``.

    Its slices are made apart, each by one task, so that the driver gets the
    filter once and no more.
    """
    bits = min(FILTER_BYTES * 8, max(1 << 13, 1 << math.ceil(math.log2(max(n, 1) * 10))))
    slices = min(64, bits >> 13)
    each = bits // slices

    def send(batches):
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_numpy().view(np.uint64), bits))
            ends = np.searchsorted(at, (np.arange(slices + 1) * each).astype(np.uint64))
            some = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([(at[ends[s] : ends[s + 1]] - np.uint64(s * each)).astype(np.uint32).tobytes() for s in some], pa.binary())], names=["bucket", "bits"])

    def fill(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(s, np.zeros(each, np.uint8))[np.frombuffer(b.as_buffer(), dtype=np.uint32)] = 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], names=["bucket", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    kind = "bucket int, bits binary"
    for r in by_bucket(keys.mapInArrow(send, kind), slices).mapInArrow(fill, kind).collect():
        out[r["bucket"] * each // 8 : (r["bucket"] + 1) * each // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def in_filter(held):
    """Whether a key may be in the (broadcast) filter; never wrong where it says no."""

    @F.pandas_udf(T.BooleanType())
    def may(key):
        table = held.value
        at = _places(key.fillna(0).to_numpy(dtype=np.int64).view(np.uint64), len(table) * 8)
        return key.notna() & ((table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    return may


def joined(rows: DataFrame, key: Column, table: DataFrame, how: str, broadcast_rows: int) -> DataFrame:
    """Texts joined (inner, left_anti or left) with a saved table by its column ``__key``.

    A table of at most ``broadcast_rows`` rows is sent to the texts.  For a
    larger one a filter of bounded size is: texts whose key isn't in it have no
    partner and stay where they are, and only the rest is shuffled.
    """
    spark = rows.sparkSession
    n = table.count()
    rows = rows.withColumn("__of", key)

    def join(rows, table):
        return rows.join(table, F.col("__of") == F.col("__key"), how).drop("__of", "__key")

    if n <= broadcast_rows:
        return join(rows, F.broadcast(table))
    may = in_filter(spark.sparkContext.broadcast(key_filter(table.select("__key"), n)))
    flagged = rows.withColumn("__may", may("__of"))
    some = join(flagged.where("__may").drop("__may"), table)
    if how == "inner":
        return some
    return flagged.where("not __may or __may is null").drop("__may", "__of").unionByName(some, allowMissingColumns=True)


def partitions(spark: SparkSession) -> int:
    """How many ways to cut a shuffle: the session's setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ways(spark: SparkSession, size: float, most: int) -> int:
    """How many buckets of at most so many bytes, two a core at least."""
    return max(2 * spark.sparkContext.defaultParallelism, math.ceil(size / most))


def by_bucket(df: DataFrame, n: int, name: str = "bucket") -> DataFrame:
    """Moves each row to the partition that its bucket number names."""
    return df.repartitionById(n, F.col(name))


def bounded(n: float, least: int, most: int) -> int:
    return int(min(max(math.ceil(n), least), most))
