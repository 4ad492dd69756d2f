"""Rank fusion and hybrid search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import bm25, bm25_index, numbered, query_terms, ranked
from .vector import nearest, with_rank

K = 60
SEMANTIC = 10


def fused(rankings: list[DataFrame], k: int = K, key: str = "doc_id") -> DataFrame:
    """Reciprocal-rank fusion of rankings (key, rank): ``key, rrf, rank``.

    A key that stands twice in a ranking counts twice; ties go by key.
    """
    every = rankings[0].select(key, "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select(key, "rank"))
    total = every.groupBy(key).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"))
    return numbered(total, F.round("rrf", 12), key)


def hybrid(docs: DataFrame, vectors: DataFrame | None, query: str, embed: Callable[[str], list[float]] | None, semantic: int = SEMANTIC) -> DataFrame:
    """BM25 fused with the nearest vectors (``vec_id`` = ``doc_id``): ``doc_id, rrf, rank``.

    Without an embedder, or where it fails, the BM25 order stands.
    """
    terms = query_terms(docs.sparkSession, {0: query})
    return _with_vectors(ranked(bm25(docs, terms)), vectors, query, embed, semantic)


def hybrid_index(index, vectors: DataFrame | None, query: str, embed: Callable[[str], list[float]] | None, semantic: int = SEMANTIC) -> DataFrame:
    """The same over a stored index."""
    terms = query_terms(index.postings.sparkSession, {0: query})
    return _with_vectors(ranked(bm25_index(index, terms)), vectors, query, embed, semantic)


def _with_vectors(ranking: DataFrame, vectors: DataFrame | None, query: str, embed, semantic: int) -> DataFrame:
    lexical = ranking.select("doc_id", "rank")
    vector = None
    if embed is not None and vectors is not None:
        try:
            vector = embed(query)
        except Exception:  # any failure of the service means lexical search only
            vector = None
    if vector is None:
        return fused([lexical])
    return fused([lexical, with_rank(nearest(vectors, vector, semantic)).select(F.col("vec_id").alias("doc_id"), "rank")])


def hashing_encoder(dim: int = 64) -> Callable[[str], list[float]]:
    """A deterministic stand-in for a model: signed hashed terms, unit length."""
    from ..functions.hashing import fnv1a
    from ..functions.text import runs

    def embed(text: str) -> list[float]:
        out = [0.0] * dim
        for term, _, _ in runs(text or ""):
            h = fnv1a(term.encode())
            out[h % dim] += 1.0 if h >> 63 else -1.0
        norm = sum(v * v for v in out) ** 0.5
        return [v / norm for v in out] if norm else out

    return embed


def embedded(passages: DataFrame, encode: Callable[[list[str]], list[list[float]]], key: str = "passage_id", text: str = "text") -> DataFrame:
    """``key, embedding`` by an injected batch encoder, a batch of rows at a time."""
    import pyarrow as pa

    kind = dict(passages.dtypes)[key]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encode(b.column(1).to_pylist()), pa.list_(pa.float32()))], names=[key, "embedding"])

    return passages.select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<float>")
