"""Search as a service answers it: status and JSON."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.hybrid import hybrid
from .operators.snippet import snippet_html


class BadRequest(ValueError):
    """A request without a query; a server answers 400."""


def results(docs: DataFrame, query: str, vectors: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None, most: int | None = None) -> DataFrame:
    """``doc_id, rank, snippet_html`` and display columns of the fused ranking.

    Ranks are those of the fused list; ids without a document are left out, so
    that ranks may have gaps.  Texts are read for listed documents only.
    """
    if not query:
        raise BadRequest("missing query parameter: q")
    ranking = hybrid(docs, vectors, query, embed)
    if most is not None:
        ranking = ranking.where(F.col("rank") <= most)
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in docs.columns else F.lit("").alias(c) for c in ("source", "product", "skin_tone", "climate")]
    return docs.join(ranking.select("doc_id", "rank"), "doc_id").select("doc_id", "rank", snippet_html(F.col("text"), query).alias("snippet_html"), *shown)


def search(docs: DataFrame, query: str, vectors: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None, most: int | None = None) -> str:
    """The results as a JSON array, in rank order."""
    rows = results(docs, query, vectors, embed, most).orderBy("rank").select(F.to_json(F.struct("*")).alias("j")).collect()
    return json.dumps([json.loads(r["j"]) for r in rows], ensure_ascii=False)
