"""Near copies among embeddings by int8 tile products with rigorous bounds.

Vectors are scaled to unit length and quantised to int8, each with its own
step.  A tile of vectors meets another in one product of int8 values, exact in
float32.  For x = s * q + r the product of two vectors differs from that of
their quantised forms by at most |s q| |r'| + |r| |s' q'| + |r| |r'|; the norms are
computed, so the bound is rigorous for each pair.  Pairs whose upper bound is
under the threshold aren't linked, those whose lower bound reaches it are, and
only what lies between is computed again, in float64.

The result has a row for each vector, with its class (the connected component
of the links) and its number of links; pairs are never listed.  Equal vectors
are one node, which counts as often as it has rows, and a tile hands on, for
each node with a link, the number of its links and one node of its component
within the tile: so many rows at most as the tile has, whatever the groups.

Scale: every node takes part with every other, so the products grow with the
square of the distinct vectors; a node is sent to as many tasks as there are
tiles, and tiles get larger with the square root of the rows beyond
``tile_rows`` so that a node is never sent to more than ``most_tiles`` of them.
Each task holds two tiles and one block of their products.

Defined results
---------------
* Rows that can't be compared (see ``vectors.cleaned``) and zero vectors have
  no links and are a class of their own; rows without an id are left out.
* Rows are told apart by id and vector; repeated rows count once.  Rows of one
  id with different vectors are rows of their own and may be linked.
* ``class_id`` is the least id of the class; ``links`` is the number of other
  rows at a cosine of at least the threshold.
* Other columns don't pass.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import column, saved, scratch, tuned
from .ngram_join import components
from .vectors import cleaned, matrix, tiles

THRESHOLD = 0.9


def quantise(x: np.ndarray):
    """Unit vectors, int8 values (held as float32), steps, norms of form and rest."""
    x = x.astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    step = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
    q = np.rint(x / step[:, None])
    form = q * step[:, None]
    # a little more than the norms, for their own rounding
    return x, q.astype(np.float32), step, np.linalg.norm(form, axis=1) * (1 + 1e-12), np.linalg.norm(x - form, axis=1) * (1 + 1e-12) + 1e-15


def near_pairs(left, right, threshold: float, same: bool, block: int = 1024):
    """Rows of two quantised tiles whose cosine reaches the threshold, a block of products at a time."""
    x, q, s, f, r = left
    y, p, t, g, e = right
    for a in range(0, len(x), block):
        for b in range(a if same else 0, len(y), block):
            m, n = slice(a, a + block), slice(b, b + block)
            about = (q[m] @ p[n].T).astype(np.float64)
            about *= s[m, None] * t[None, n]
            off = f[m, None] * e[None, n] + r[m, None] * (g[n] + e[n])[None, :]
            linked = about - off >= threshold + 1e-12
            i, j = np.nonzero((about + off >= threshold - 1e-12) & ~linked)
            exact = np.einsum("ij,ij->i", x[m][i], y[n][j])
            linked[i, j] = exact >= threshold
            i, j = np.nonzero(linked)
            i, j = i + a, j + b
            if same:
                once = i < j
                i, j = i[once], j[once]
            if len(i):
                yield i, j


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins the components of the pairs; each node's root is its component's least."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (further := root[root]).tobytes() != root.tobytes():
            root = further


def links(vectors: DataFrame, threshold: float = THRESHOLD, tile_rows: int = 8192, most_tiles: int = 1024) -> DataFrame:
    """``vec_id, class_id, links`` of every row: see the module."""
    spark = tuned(vectors.sparkSession)
    with scratch(spark):
        return saved(_links(vectors, threshold, tile_rows, most_tiles), keep=True)


def _links(vectors: DataFrame, threshold: float, tile_rows: int, most_tiles: int) -> DataFrame:
    rows = cleaned(vectors)[0].where("exists(embedding, x -> x != 0)").distinct()
    grouped = rows.groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("times"))
    # the number is of the written rows: it doesn't change when a task is run again
    nodes = saved(grouped.withColumn("tid", F.monotonically_increasing_id()))
    n = min(tiles(nodes.count(), tile_rows), most_tiles)
    tiled = nodes.select("tid", "times", "embedding", F.pmod(F.xxhash64("tid"), F.lit(n)).cast("int").alias("tile"))
    every = F.sequence(F.lit(0), F.lit(n - 1))
    left = tiled.select("*", F.explode(F.filter(every, lambda k: k >= F.col("tile"))).alias("other")).select(F.col("tile").alias("i"), F.col("other").alias("j"), "tid", "times", "embedding")
    right = tiled.select("*", F.explode(F.filter(every, lambda k: k < F.col("tile"))).alias("other")).select(F.col("other").alias("i"), F.col("tile").alias("j"), "tid", "times", "embedding")

    def meet(key, a: pa.Table, b: pa.Table) -> pa.Table:
        same = key[0].as_py() == key[1].as_py()
        ids, times, x = a["tid"].to_numpy(), a["times"].to_numpy(), matrix(a["embedding"])
        if not same:
            ids, times = np.concatenate([ids, b["tid"].to_numpy()]), np.concatenate([times, b["times"].to_numpy()])
        count, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        if len(x) and (same or b.num_rows):
            one = quantise(x)
            for i, j in near_pairs(one, one if same else quantise(matrix(b["embedding"])), threshold, same):
                j = j if same else j + len(x)
                count += np.bincount(i, times[j], len(ids)).astype(np.int64) + np.bincount(j, times[i], len(ids)).astype(np.int64)
                root = unite(root, i, j)
        some = np.flatnonzero(count)
        return pa.table({"tid": ids[some], "links": count[some], "root": ids[root[some]]})

    met = saved(left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, "tid long, links long, root long"))
    comp = components(nodes.select("tid"), met.where("tid != root").select(F.col("tid").alias("a"), F.col("root").alias("b")))
    total = met.groupBy("tid").agg(F.sum("links").alias("links"))
    named = nodes.select("tid", "low", "times", "embedding").join(comp, "tid").join(total, "tid", "left")
    classes = named.groupBy("comp").agg(F.min("low").alias("class_id"))
    found = named.join(classes, "comp").select("embedding", "class_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"))
    # every row with an id; those that weren't compared find no vector
    given = vectors.select(column(vectors, "vec_id").cast("long").alias("vec_id"), column(vectors, "embedding").cast("array<float>").alias("embedding")).where("vec_id is not null").distinct()
    return given.join(found, "embedding", "left").select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def query(spark, sf_dir: str) -> DataFrame:
    """Class and number of links of every embedding, at a cosine of 0.9 or more."""
    return links(tuned(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def loose_query(spark, sf_dir: str) -> DataFrame:
    """The same at 0.4, where vectors that aren't copies meet too."""
    return links(tuned(spark).read.parquet(f"{sf_dir}/embeddings.parquet"), 0.4)


def sql(threshold: float) -> str:
    return f"""
        WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
        p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= {threshold}),
        reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM reach r JOIN p ON p.a = r.b),
        c AS (SELECT a AS vec_id, min(b) AS class_id FROM reach GROUP BY a)
        SELECT vec_id, class_id, (SELECT count(*) FROM p WHERE p.a = c.vec_id) AS links FROM c"""
