"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import anisotropic_ann, embedding_dedup, html_text, language_id, mixing, ngram_join, packing, quality_rank, suffix_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.query,
    "op2_packing": packing.query,
    "op3_anisotropic_ann": anisotropic_ann.query,
    "op4_embedding_dedup": embedding_dedup.query,
    "embedding_links_loose": embedding_dedup.loose_query,
    "op5_language_id": language_id.query,
    "op6_url_filter": url_filter.query,
    "op8_html_text": html_text.query,
    "op7_ngram_join": ngram_join.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_quality_rank": quality_rank.query,
}

SQL: dict[str, str] = {
    "op3_anisotropic_ann": anisotropic_ann.SQL,
    "op4_embedding_dedup": embedding_dedup.sql(embedding_dedup.THRESHOLD),
    "embedding_links_loose": embedding_dedup.sql(0.4),
}
