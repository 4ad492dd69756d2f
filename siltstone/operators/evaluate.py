"""Relevance metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """The ranking with ``relevance``; what isn't judged has 0.

    Judgments without ``query_id`` hold for every query.
    """
    on = ["query_id", "doc_id"] if "query_id" in qrels.columns else ["doc_id"]
    return ranking.join(qrels, on, "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))


def by_query(queries: DataFrame, ranking: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, p_at_k, rr`` of every query, those without results too."""
    good = F.col("relevance") >= 1
    each = judged(ranking, qrels).groupBy("query_id").agg(F.sum((good & (F.col("rank") <= k)).cast("int")).alias("hits"), F.min(F.when(good, F.col("rank"))).alias("first"))
    return queries.select("query_id").join(each, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("p_at_k"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def means(each: DataFrame) -> DataFrame:
    return each.agg(F.avg("p_at_k").alias("mean_p_at_k"), F.avg("rr").alias("mrr"))
