"""Embeddings: upsert, exact nearest neighbours, tombstones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upserted(existing: DataFrame, batch: DataFrame, key: str = "vec_id", seq: str = "seq") -> DataFrame:
    """The batch's last row of each key replaces what was there."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    last = batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", seq)
    return existing.join(last.select(key), key, "left_anti").unionByName(last.select(existing.columns))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, vector: list[float], k: int, key: str = "vec_id") -> DataFrame:
    """``key, similarity`` of the k most similar rows: a literal query, a top-k by task."""
    q = F.array(*[F.lit(float(v)) for v in vector])
    sim = vectors.select(key, F.round(cosine(F.col("embedding"), q), 9).alias("similarity"))
    return sim.orderBy(F.desc("similarity"), key).limit(k)


def with_rank(top: DataFrame, key: str = "vec_id") -> DataFrame:
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), key)))


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """Top k for each row of ``queries`` (``query_id, q``), few enough to be sent to all tasks."""
    sim = vectors.crossJoin(F.broadcast(queries)).select("query_id", key, F.round(cosine(F.col("embedding"), F.col("q")), 9).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return sim.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_live_overfetch(vectors: DataFrame, vector: list[float], k: int, deleted: DataFrame, key: str = "vec_id", factor: int = 3) -> DataFrame:
    """The first k that aren't deleted of the first ``factor * k``: maybe fewer than k."""
    return nearest(vectors, vector, factor * k, key).join(deleted.select(key).distinct(), key, "left_anti").orderBy(F.desc("similarity"), key).limit(k)


def nearest_live(vectors: DataFrame, vector: list[float], k: int, deleted: DataFrame, key: str = "vec_id") -> DataFrame:
    """The k most similar rows that aren't deleted."""
    return nearest(vectors.join(deleted.select(key).distinct(), key, "left_anti"), vector, k, key)


# ---- stored index ----------------------------------------------------------


def write_vectors(vectors: DataFrame, path: str, cells: int = 64, key: str = "vec_id", seed: int = 1) -> None:
    """Stores vectors by cell: each goes to the most similar of ``cells`` of the rows.

    ``centres`` has the cells; ``vectors`` is partitioned by cell, so a search
    reads the cells that it visits and no others.
    """
    rows = vectors.select(key, "embedding").where("embedding is not null")
    rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(cells).select(F.monotonically_increasing_id().alias("cell"), "embedding").write.mode("overwrite").parquet(f"{path}/centres")
    centres = vectors.sparkSession.read.parquet(f"{path}/centres").toPandas()
    ids, at = centres["cell"].to_numpy(), np.stack([np.asarray(v, dtype=np.float64) for v in centres["embedding"]])
    at /= np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-30)

    @F.pandas_udf(T.LongType())
    def cell(embedding: pd.Series) -> pd.Series:
        x = np.stack(embedding.to_numpy()).astype(np.float64) if len(embedding) else np.zeros((0, at.shape[1]))
        return pd.Series(ids[(x @ at.T).argmax(axis=1)] if len(x) else np.zeros(0, np.int64))

    rows.withColumn("cell", cell("embedding")).repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")


class StoredVectors:
    """A stored vector index, opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.vectors = spark.read.parquet(f"{path}/vectors")
        self.centres = spark.read.parquet(f"{path}/centres")

    def nearest(self, vector: list[float], k: int, visits: int | None = None, key: str = "vec_id") -> DataFrame:
        """The k most similar rows of the ``visits`` nearest cells; of all without it."""
        if visits is None:
            return nearest(self.vectors, vector, k, key)
        cells = [r["cell"] for r in nearest(self.centres, vector, visits, "cell").collect()]
        return nearest(self.vectors.where(F.col("cell").isin(cells)), vector, k, key)
