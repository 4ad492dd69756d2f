"""Maximum inner product search with score-aware (anisotropic) quantisation.

Vectors are product-quantised: two dimensions a subspace, 16 codewords each,
so four bits.  The codebooks minimise a loss that weighs the part of the
residual parallel to the vector more than the rest, as that part is what
changes large inner products.  Codes are assigned by coordinate descent on the
same loss.  A query makes a table of its products with all codewords, adds up
the entries of each vector's codes (two subspaces at once: a byte of codes
selects from 256 sums), and the best by this score are ranked again by exact
products.  So is every other row whose score plus a bound of its residual's
product reaches the k-th of these: within the visited cells the result is exact,
however many rows are nearly alike.

The registered query asks for every row whose id is divisible by 100, against
all rows.  Rows fall into cells around pivot rows; a query visits the cells of
the nearest pivots.  ``probe_share`` is the share of cells that it visits.  It
is 1 by default (no cells are made), since the vectors of these tables have no
clusters (their nearest neighbours are at a cosine of about 0.4) and recall
would fall under 0.9 with less; clustered embeddings keep theirs with a share.

Scale: codebook and pivots are fitted on a sample of ``fit_rows`` rows; all
rows are indexed, once, in the shared folder.  Queries are taken in blocks of
about ``query_rows``, which are broadcast, a bounded size; each block is a scan
of the index in which a task keeps the k best of each query, so vectors are
never shuffled, only results are.  With cells, rows are sorted by cell: a cell
may be of any size, as no task gathers one.

Defined results
---------------
* Rows left out: see ``vectors.clean``.
* ``queries``, an SQL condition, says which rows ask; without it all do.
* A row isn't its own neighbour, nor is any row with its id.  Repeated ids are
  answered once, with their first best; ties go to the smaller id.
* Result: ``vec_id, neighbor_id, rank`` (from 1) ``, score``, the exact inner
  product rounded to six places.  Fewer than k where there are no more rows.
* Other columns don't pass.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import saved, scratch, tuned
from .vectors import cleaned, matrix

CODES = 16
RESULT = "vec_id long, neighbor_id long, score double"


def _pad(x: np.ndarray) -> np.ndarray:
    """To a dimension that four divides."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % 4))).astype(np.float32)


def parallel_weight(dim: int, threshold: float = 0.2) -> float:
    """Weight of the parallel part relative to the rest, for cosines over the threshold."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def assign(x: np.ndarray, book: np.ndarray, weight: float, sweeps: int = 2) -> np.ndarray:
    """Codes of the rows (n, subspaces), by coordinate descent on the loss."""
    n, m = len(x), book.shape[0]
    parts = x.reshape(n, m, 2)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    along = unit.reshape(n, m, 2)
    codes = np.empty((n, m), dtype=np.uint8)
    for j in range(m):
        codes[:, j] = ((parts[:, j, None, :] - book[j]) ** 2).sum(axis=2).argmin(axis=1)
    rest = parts - book[np.arange(m), codes]
    total = np.einsum("njk,njk->n", rest, along)
    for _ in range(sweeps):
        for j in range(m):
            others = total - np.einsum("nk,nk->n", rest[:, j], along[:, j])
            gap = parts[:, j, None, :] - book[j]
            lengthwise = others[:, None] + np.einsum("nck,nk->nc", gap, along[:, j])
            best = ((gap**2).sum(axis=2) + (weight - 1) * lengthwise**2).argmin(axis=1)
            codes[:, j] = best
            rest[:, j] = gap[np.arange(n), best]
            total = lengthwise[np.arange(n), best]
    return codes


def statistics(x: np.ndarray, book: np.ndarray, weight: float) -> np.ndarray:
    """Sums from which the next codebook follows: per codeword a 2 x 2 matrix and a vector."""
    n, m = len(x), book.shape[0]
    codes = assign(x, book, weight)
    parts = x.reshape(n, m, 2).astype(np.float64)
    along = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).reshape(n, m, 2).astype(np.float64)
    rest = parts - book[np.arange(m), codes]
    share = np.einsum("njk,njk->nj", rest, along)
    others = share.sum(axis=1, keepdims=True) - share
    pull = others + np.einsum("njk,njk->nj", parts, along)
    slot = codes + np.arange(m) * CODES
    out = np.zeros((m * CODES, 6))
    for k, value in enumerate((1 + (weight - 1) * along[..., 0] ** 2, (weight - 1) * along[..., 0] * along[..., 1], 1 + (weight - 1) * along[..., 1] ** 2, parts[..., 0] + (weight - 1) * pull * along[..., 0], parts[..., 1] + (weight - 1) * pull * along[..., 1], np.ones((n, m)))):
        out[:, k] = np.bincount(slot.ravel(), value.ravel(), minlength=m * CODES)
    return out


def update(book: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The codewords that minimise the loss for the assignment; unused ones stay."""
    a, b, d, u, v, n = sums.T
    det = a * d - b * b
    ok = (n > 0) & (det > 1e-9)
    det = np.where(ok, det, 1)
    new = np.stack([(d * u - b * v) / det, (a * v - b * u) / det], axis=1)
    return np.where(ok[:, None], new, book.reshape(-1, 2)).reshape(book.shape).astype(np.float32)


def train(x: np.ndarray, rounds: int = 4, seed: int = 5) -> np.ndarray:
    """The codebook (subspaces, 16, 2), fitted on the sample's rows."""
    weight = parallel_weight(x.shape[1])
    x = _pad(x)
    m = x.shape[1] // 2
    rng = np.random.default_rng(seed)
    parts = x.reshape(len(x), m, 2)
    book = np.stack([parts[rng.choice(len(x), CODES, replace=len(x) < CODES), j] for j in range(m)])
    for k in range(5 + rounds):
        book = update(book, statistics(x, book, 1.0 if k < 5 else weight))
    return book


def scores(q: np.ndarray, packed: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The table scores of all rows; ``packed`` holds their codes, two subspaces a number."""
    m = book.shape[0]
    table = np.einsum("mck,mk->mc", book, q.reshape(m, 2))
    table = (table[0::2, :, None] + table[1::2, None, :]).reshape(m // 2, CODES * CODES)
    score = table[0].take(packed[0])
    for j in range(1, m // 2):
        score += table[j].take(packed[j])
    return score


def residuals(x: np.ndarray, codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    """By how much a unit query's product can exceed each row's score, rounding included."""
    m = book.shape[0]
    rest = np.linalg.norm(_pad(x).astype(np.float64) - book[np.arange(m), codes].reshape(len(x), -1), axis=1)
    return rest + 2e-7 * (m + 8) * (rest + np.linalg.norm(x.astype(np.float64), axis=1))


def nearest(q: np.ndarray, own: int, x: np.ndarray, ids: np.ndarray, score: np.ndarray, reach: np.ndarray, k: int, most: int, repeats: bool, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact products of the ``k`` best ids of those that reach ``least``;
    ``x`` is in order of ``ids``.

    The k-th of the ``most`` best by score is what all others must be able to reach.
    """

    def ranked(found, least):
        # not by BLAS: equal rows must have equal products wherever they stand
        exact = np.einsum("ij,j->i", x[found], q)
        ok = (ids[found] != own) & (exact >= least)
        found, exact = found[ok], exact[ok]
        best = np.argsort(-exact, kind="stable")
        if repeats:
            best = best[np.sort(np.unique(ids[found[best]], return_index=True)[1])]
        return found[best[:k]], exact[best[:k]]

    n = len(score)
    if least == -np.inf:
        if most >= n:
            return ranked(np.arange(n), -np.inf)
        first = ranked(np.sort(np.argpartition(score, n - most)[n - most :]), -np.inf)[1]
        least = first[-1] if len(first) == k else -np.inf
    # scores that overflowed say nothing
    return ranked(np.flatnonzero(~((score + reach < least) & (score > -np.inf))), least)


def build(rows: DataFrame, book: np.ndarray, pivots: np.ndarray | None = None) -> DataFrame:
    """The index of all rows: ``vec_id, embedding, codes`` (two a byte) ``, reach, cell``."""
    held = rows.sparkSession.sparkContext.broadcast((book, pivots))
    weight = parallel_weight(pivots.shape[1] if pivots is not None else 2 * len(book))

    def run(batches):
        book, pivots = held.value
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column(1))
            codes = assign(_pad(x), book, weight)
            cell = np.zeros(len(x), np.int64) if pivots is None else (x @ pivots.T).argmax(axis=1)
            packed = codes[:, 0::2] * CODES + codes[:, 1::2]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in packed], pa.binary()), pa.array(residuals(x, codes, book)), pa.array(cell.astype(np.int32))], names=["vec_id", "embedding", "codes", "reach", "cell"])

    index = rows.mapInArrow(run, "vec_id long, embedding array<float>, codes binary, reach double, cell int")
    return index if pivots is None else index.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id")


def scan(index: DataFrame, own: np.ndarray, q: np.ndarray, book: np.ndarray, k: int, rerank: int, visits: np.ndarray | None = None) -> DataFrame:
    """``vec_id, neighbor_id, score``: each task's k best of every query of a block.

    ``visits`` has a row of cells for each query; without it all rows are seen.
    """
    held = index.sparkSession.sparkContext.broadcast((own, q, book, visits))

    def run(batches):
        own, q, book, visits = held.value
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(own)
        exact, padded, norm = q.astype(np.float64), _pad(q), np.linalg.norm(q.astype(np.float64), axis=1)
        for batch in batches:
            cell = batch.column(4).to_numpy()
            for c in np.unique(cell):
                order = np.flatnonzero(cell == c)
                order = order[np.argsort(batch.column(0).to_numpy()[order], kind="stable")]
                b = batch.take(pa.array(order))
                x, ids, reach = matrix(b.column(1)).astype(np.float64), b.column(0).to_numpy(), b.column(3).to_numpy()
                packed = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint8).reshape(len(x), -1).T.astype(np.intp)
                # so many rows have at least ``rerank`` ids
                repeats = int(np.unique(ids, return_counts=True)[1].max())
                for i in range(len(own)) if visits is None else np.flatnonzero((visits == c).any(axis=1)):
                    had, product = best[i]
                    place, found = nearest(exact[i], own[i], x, ids, scores(padded[i], packed, book), reach * norm[i], k, rerank * repeats, repeats > 1, product[-1] if len(had) == k else -np.inf)
                    if len(place):
                        both, product = np.concatenate([had, ids[place]]), np.concatenate([product, found])
                        by = np.lexsort((both, -product))
                        by = by[np.sort(np.unique(both[by], return_index=True)[1])][:k]
                        best[i] = both[by], product[by]
        sizes = [len(b[0]) for b in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, sizes)), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))], names=["vec_id", "neighbor_id", "score"])

    return index.mapInArrow(run, RESULT)


def search(vectors: DataFrame, k: int = 10, rerank: int = 200, cell_rows: int = 8192, query_rows: int = 32_768, probe_share: float = 1.0, seed: int = 5, queries: str | None = None, fit_rows: int = 10_000, max_cells: int = 4096) -> DataFrame:
    """The ``k`` rows of largest inner product for the rows that ask.

    ``rerank`` rows are ranked exactly at first; it doesn't bound those that follow.
    """
    spark = tuned(vectors.sparkSession)
    rows, dim, n = cleaned(vectors)
    if not n:
        return spark.createDataFrame([], "vec_id long, neighbor_id long, rank int, score double")
    # by chance, not by hash of the row: equal rows mustn't be taken all at once
    draw = rows if n <= fit_rows else rows.where(F.rand(seed) < fit_rows / n).limit(2 * fit_rows)
    sample = np.stack(draw.toPandas().sort_values("vec_id", kind="stable")["embedding"].to_numpy()).astype(np.float32)
    book, pivots = train(sample, seed=seed), None
    if probe_share < 1:
        chosen = np.random.default_rng(seed).permutation(len(sample))
        pivots = sample[chosen[: max(1, min(max_cells, -(-n // cell_rows)))]]
    asking = rows.where(queries) if queries else rows
    blocks = max(1, -(-asking.count() // query_rows))
    block = F.pmod(F.xxhash64(F.lit(seed), "vec_id", "embedding"), F.lit(blocks))
    parts = []
    with scratch(spark):
        index = saved(build(rows, book, pivots))
        for b in range(blocks):
            got = asking.where(block == b).distinct().toPandas()
            if not len(got):
                continue
            q = np.stack(got["embedding"].to_numpy()).astype(np.float32)
            visits = None
            if pivots is not None:
                visits = np.argsort(-(q @ pivots.T), axis=1, kind="stable")[:, : max(1, int(np.ceil(len(pivots) * probe_share)))]
            met = scan(index, got["vec_id"].to_numpy(dtype=np.int64), q, book, k, rerank, visits)
            once = met.groupBy("vec_id", "neighbor_id").agg(F.max("score").alias("score"))
            order = Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbor_id")
            parts.append(saved(once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), keep=True))
    found = parts[0] if parts else spark.createDataFrame([], "vec_id long, neighbor_id long, score double, rank int")
    for p in parts[1:]:
        found = found.unionByName(p)
    if len(parts) > 1:  # the rows of an id may be of several blocks
        once = found.groupBy("vec_id", "neighbor_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbor_id")
        found = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("vec_id", "neighbor_id", "rank", F.round("score", 6).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours, among all embeddings, of those whose id is divisible by 100."""
    return search(tuned(spark).read.parquet(f"{sf_dir}/embeddings.parquet"), queries="vec_id % 100 = 0")


SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    p AS (SELECT q.vec_id, v.vec_id AS neighbor_id, list_dot_product(q.e, v.e) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
    SELECT vec_id, neighbor_id, rank::INT AS rank, round(score, 6) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) AS rank FROM p) WHERE rank <= 10"""
