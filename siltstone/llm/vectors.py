"""What the vector operators share: clean rows, and tiles that meet each other."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import column


def cleaned(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int, int]:
    """``vec_id, embedding`` of the rows that can be compared, their dimension and number.

    Left out: null ids, null vectors, vectors with a null, NaN or infinite
    value, and those that haven't the commonest dimension (ties: the larger).
    """
    e = column(vectors, embedding).cast("array<float>")
    rows = vectors.select(column(vectors, vec_id).cast("long").alias("vec_id"), e.alias("embedding"))
    rows = rows.where("vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < float('inf'))")
    dims = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim, n = (dims[0]["d"], dims[0]["count"]) if dims else (0, 0)
    return rows.where(F.size("embedding") == dim), dim, n


def clean(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    return cleaned(vectors, vec_id, embedding)[0]


def matrix(col: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0), np.float32)


def tiles(n: int, tile_rows: int) -> int:
    return max(1, math.ceil(n / tile_rows))
