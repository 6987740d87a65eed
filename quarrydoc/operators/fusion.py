"""Reciprocal-rank fusion and reranking of ranked candidate lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fusion_key, tokens

RRF_K = 60
LEG = 1_000_000


def rrf(ranked: DataFrame, k: int = 20, key: Column | None = None, keep: tuple[str, ...] = ("source", "page", "text")) -> DataFrame:
    """ranked: (query_id, leg 0/1, rank, keep...). Sum of 1 / (60 + rank) per key, ranked; ties go to the key seen first.

    The key is source, page and the first 80 characters, so chunks that share them are one and
    add up even within a leg; the first one seen stands for all.
    """
    key = fusion_key(F.col("source"), F.col("page"), F.col("text")) if key is None else key
    seen = (F.col("leg") * LEG + F.col("rank")).cast("long")
    d = ranked.withColumn("fusion_key", key).withColumn("seen", seen)
    d = d.groupBy("query_id", "fusion_key").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.min("seen").alias("first_seen"), F.min_by(F.struct(*keep), "seen").alias("c"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "first_seen")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "fusion_key", "score", "first_seen", "rank", "c.*")


def coverage_score(question: Column, text: Column) -> Column:
    """Deterministic stand-in for a cross-encoder: 10 * (share of distinct question terms found) - 5."""
    q = F.array_distinct(tokens(question))
    found = F.size(F.array_intersect(q, F.array_distinct(tokens(text))))
    return F.when(F.size(q) == 0, F.lit(-5.0)).otherwise(10.0 * found / F.size(q) - 5.0)


def rerank(candidates: DataFrame, score: Column, k: int = 5, tie: str = "rank") -> DataFrame:
    """The k best candidates per query by `score` (any column expression or pandas UDF); ties keep their order."""
    d = candidates.withColumn("rerank_score", score)
    w = Window.partitionBy("query_id").orderBy(F.round("rerank_score", 9).desc(), tie)
    return d.withColumn("rerank_rank", F.row_number().over(w)).where(F.col("rerank_rank") <= k)


def gate(reranked: DataFrame, queries: DataFrame, threshold: float = -3.0) -> tuple[DataFrame, DataFrame]:
    """(kept candidates, refusal per query). A specific query is refused when it has no candidate or its best scores below the threshold."""
    kept = reranked.where((F.col("mode") != "specific") | (F.col("rerank_score") >= threshold))
    best = reranked.groupBy("query_id").agg(F.max("rerank_score").alias("best"), F.count(F.lit(1)).alias("n"))
    d = queries.join(best, "query_id", "left")
    refused = F.col("n").isNull() | ((F.col("mode") == "specific") & (F.col("best") < threshold))
    return kept, d.select("query_id", "mode", "best", refused.alias("refused"))
