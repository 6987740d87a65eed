"""Whole plans: hybrid retrieval, answer contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context, dense, fusion, lexical, routing
from ..scratch import hinted, table

LEG_K = 20


def dense_leg(vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, chunk_id): the k nearest chunks of each query's own session. vectors: chunk_id, chat_session_id, embedding."""
    asked = queries.select("query_id", "chat_session_id")
    near = dense.knn(vectors, query_vectors.join(asked, "query_id", "left_semi"), k, group="chat_session_id")
    return near.join(asked, ["query_id", "chat_session_id"], "left_semi").select("query_id", "rank", "chunk_id")


def hybrid(chunks: DataFrame, queries: DataFrame, k: int = 20, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, index: str | None = None) -> DataFrame:
    """Fused candidates per query. The lexical leg is BM25; the dense leg is exact kNN over `vectors` of the session, where there are any.

    index: a folder of lexical.build_index over `chunks`; without one, a few questions are answered from the texts. Texts are read again for the ranked chunks only.
    """
    meta = chunks.select("chunk_id", F.col("filename").alias("source"), "page", "text")
    leg = lexical.bm25_search(chunks, queries, LEG_K, index=index).select("query_id", F.lit(1).alias("leg"), "rank", "chunk_id")
    if vectors is not None:
        near = dense_leg(vectors, queries, query_vectors, LEG_K).select("query_id", F.lit(0).alias("leg"), "rank", "chunk_id")
        leg = near.unionByName(leg)
    leg = table(leg, "hybrid-legs")  # LEG_K rows per query and leg
    return fusion.rrf(meta.join(hinted(leg), "chunk_id").select("query_id", "leg", "rank", "source", "page", "text"), k)


def answer_contexts(chunks: DataFrame, questions: DataFrame, documents: DataFrame, vectors: DataFrame, query_vectors: DataFrame, k: int = 5, index: str | None = None) -> DataFrame:
    """(query_id, mode, rank, source, page, text, rerank_score) for all questions at once, each by its mode.

    specific: hybrid candidates of both legs reranked; broad: a spread sample of every document; comparison: the k
    nearest of every target document. vectors: chunk_id, chat_session_id, embedding; query_vectors: query_id, query_vector.
    """
    q = routing.route(questions)
    meta = chunks.select("chunk_id", "chat_session_id", F.col("filename").alias("source"), "page", "text")
    ask = q.select("query_id", "chat_session_id", F.col("search_query").alias("question"), "mode")
    specific = ask.where("mode = 'specific'")
    fused = hybrid(chunks, specific, 20, vectors, query_vectors, index).join(specific.select("query_id", "question"), "query_id")
    best = fusion.rerank(fused, fusion.coverage_score(F.col("question"), F.col("text")), k)
    a = best.select("query_id", F.lit("specific").alias("mode"), F.col("rerank_rank").alias("rank"), "source", "page", "text", "rerank_score")
    a = a.where("rerank_score >= -3.0")
    spread = spread_texts(chunks, ask.where("mode = 'broad'").select("chat_session_id").distinct())
    b = spread.join(ask.where("mode = 'broad'"), "chat_session_id").select("query_id", F.lit("broad").alias("mode"), F.row_number().over(_window("filename", "page")).alias("rank"), F.col("filename").alias("source"), "page", "text", F.lit(None).cast("double").alias("rerank_score"))
    compare = ask.where("mode = 'comparison'")
    targets = routing.comparison_targets(questions.join(compare.select("query_id"), "query_id"), documents)
    pairs = table(targets.join(compare.select("query_id", "chat_session_id"), "query_id").withColumn("document", F.to_json(F.struct("chat_session_id", "filename"))), "targets")
    place = meta.select("chunk_id", F.to_json(F.struct("chat_session_id", F.col("source").alias("filename"))).alias("document")).join(hinted(pairs).select("document").distinct(), "document", "left_semi")
    own = vectors.select("chunk_id", "embedding").join(place, "chunk_id")
    near = dense.knn(own, query_vectors.join(compare.select("query_id"), "query_id", "left_semi"), k, group="document")
    near = table(near.join(pairs.select("query_id", "document"), ["query_id", "document"], "left_semi").select("query_id", "chunk_id", "rank"), "nearest")  # k rows per target
    found = hinted(near).join(meta, "chunk_id")
    c = found.select("query_id", F.lit("comparison").alias("mode"), F.row_number().over(_window("source", F.col("rank"))).alias("rank"), "source", "page", "text", F.lit(None).cast("double").alias("rerank_score"))
    return a.unionByName(b).unionByName(c)


def spread_texts(chunks: DataFrame, sessions: DataFrame) -> DataFrame:
    """(chat_session_id, filename, page, text): the spread samples of every document of the sessions; texts are read for these chunks only.

    Of chunks alike in session, file, page and id as many are taken as were sampled, the least texts first.
    """
    from pyspark.sql import Window

    keys = ["chat_session_id", "filename", "page", "chunk_id"]
    sampled = routing.spread_sample(chunks.select(*keys).join(hinted(table(sessions, "broad-sessions")), "chat_session_id", "left_semi"))
    taken = table(sampled.groupBy(*keys).agg(F.count(F.lit(1)).alias("taken")), "spread")
    t = hinted(taken).select(*[F.col(k).alias(f"_{k}") for k in keys], "taken")
    on = [F.col("chat_session_id") == F.col("_chat_session_id"), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys[1:]]]
    w = Window.partitionBy(*keys).orderBy("text")
    d = chunks.select(*keys, "text").join(t, on).withColumn("_r", F.row_number().over(w)).where("_r <= taken")
    return d.select("chat_session_id", "filename", "page", "text")


def _window(*order):
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(*order)


def prompts(contexts: DataFrame, questions: DataFrame) -> DataFrame:
    """One prompt per query from its candidates."""
    text = context.context_text(contexts)
    modes = contexts.select("query_id", "mode").distinct()
    d = text.join(modes, "query_id").join(questions.select("query_id", "question"), "query_id")
    return d.select("query_id", "mode", context.prompt(F.col("question"), F.col("context"), F.col("mode")).alias("prompt"))
