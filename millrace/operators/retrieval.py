"""Hybrid retrieval as one plan: semantic top-k, keyword top-k without those, their union, and a reranker's order."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import keyword, vectors

HIT = ["file_id", "chunk_index", "score", "preview"]
KEY = ["file_id", "chunk_index"]


def semantic_search(chunks: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The k chunks nearest to a query vector, whatever the sign of their score; equal scores by key."""
    score = F.round(vectors.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])), 6)
    found = chunks.where(F.col("embedding").isNotNull()).withColumn("score", score) if any(query) else chunks.withColumn("score", F.lit(0.0)).where("false")
    order = [F.desc("score"), "file_id", "chunk_index"]
    return found.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rerank(hits: DataFrame, scorer: Callable[[pd.Series], pd.Series] | None, k: int = 8) -> DataFrame:
    """The first k hits with their `position`: by the scorer's value of a hit's content, or in the given order without
    one. Hits without content take no part under a scorer; if it fails or has nothing to score, the given order stays."""
    given = [F.col("source_rank"), F.col("rank")]
    if scorer is None:
        order = given
    else:

        def scores(content: pd.Series) -> pd.Series:
            try:
                return scorer(content)
            except Exception:  # whatever a model raises
                return pd.Series([None] * len(content), dtype=float)

        # a handful of hits: what the searches found
        filled, everywhere = F.coalesce("content", F.lit("")) != "", Window.partitionBy()
        hits = hits.withColumn("rerank_score", F.when(filled, F.pandas_udf(scores, "double")(F.coalesce("content", F.lit("")))))
        scored = (F.count_if(filled).over(everywhere) > 0) & (F.count_if(filled & (F.col("rerank_score").isNull() | F.isnan("rerank_score"))).over(everywhere) == 0)
        hits = hits.withColumn("_scored", scored).where(~F.col("_scored") | filled)
        order = [F.when(F.col("_scored"), F.col("rerank_score")).desc_nulls_last(), *given]
    best = hits.orderBy(*order).limit(k)
    return best.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def hybrid_search(chunks: DataFrame, query: str, query_vector: list[float], semantic_k: int = 5, keyword_k: int = 5, k: int = 8, scorer=None) -> DataFrame:
    """position, source, key, score and preview. chunks: file_id, chunk_index, content, embedding; they are read by each
    search, so a table should be given. A blank query finds nothing; without a reranker semantic hits come first. The
    searches rank keys; contents are fetched for what they found."""
    if not query.strip():
        return rerank(chunks.select(*KEY, "content", F.lit(0).alias("source_rank"), F.lit(0).alias("rank"), F.lit(0.0).alias("score"), F.lit("").alias("source")).where("false"), None, k)
    near = semantic_search(chunks.select(*KEY, "embedding"), query_vector, semantic_k).select(*KEY, "score", "rank", F.lit("semantic").alias("source"), F.lit(0).alias("source_rank"))
    words = keyword.keyword_search(chunks.select(*KEY, "content"), query, keyword_k, exclude=near).select(*KEY, "score", "rank", F.lit("keyword").alias("source"), F.lit(1).alias("source_rank"))
    # at most semantic_k + keyword_k keys
    hits = chunks.select(*KEY, "content").join(F.broadcast(near.unionByName(words)), KEY)
    return rerank(hits, scorer, k).withColumn("preview", T.preview(F.col("content")))


def search_each(chunks: DataFrame, query: str, group: str, k: int = 5) -> DataFrame:
    """Keyword search in every collection for itself: the k best of each, no order between collections."""
    hits = keyword.scored(chunks, query)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*keyword.order()))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def hybrid_each(chunks: DataFrame, query: str, query_vector: list[float], group: str, semantic_k: int = 5, keyword_k: int = 5, k: int = 8) -> DataFrame:
    """Hybrid search in every collection for itself: its position in the collection beside the columns of a hit. Ranks are
    limited before the shuffle, so a collection sends on a few rows of each task."""
    within = lambda order: F.row_number().over(Window.partitionBy(group).orderBy(*order))
    if not query.strip():
        return hybrid_each(chunks.where("false"), "-", query_vector, group)
    key, shape = [group, *KEY], ["content", "score", "rank"]
    score = F.round(vectors.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query_vector])), 6)
    near = chunks.where(F.col("embedding").isNotNull() & F.lit(any(query_vector))).withColumn("score", score)
    near = near.withColumn("rank", within([F.desc("score"), *KEY])).where(F.col("rank") <= semantic_k).select(*key, *shape)
    words = keyword.scored(chunks, query).join(near.select(*key), key, "left_anti")
    words = words.withColumn("rank", within(keyword.order())).where(F.col("rank") <= keyword_k).select(*key, *shape)
    both = near.withColumns({"source": F.lit("semantic"), "source_rank": F.lit(0)}).unionByName(words.withColumns({"source": F.lit("keyword"), "source_rank": F.lit(1)}))
    return both.withColumn("position", within(["source_rank", "rank"])).where(F.col("position") <= k).withColumn("preview", T.preview(F.col("content")))
