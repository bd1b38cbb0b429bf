"""Fusion of ranked lists and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperweir.functions.text import rerank_tokens


def rrf(lists: DataFrame, k: int, weights: dict[str, float], rrf_k: int = 60, key: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """Reciprocal-rank fusion: `key, rank, item, score, provenance`.

    `lists` has `key, backend, rank, item, raw_score`; backends count in the order of `weights`, and one of
    weight zero is left out. Equal scores keep the order in which items were first seen: earlier backend, then
    better rank. `provenance` lists `backend, rank, raw_score, normalized_score, rrf_contribution`.
    """
    if k <= 0:
        raise ValueError("top_k must be > 0")
    if rrf_k <= 0:
        raise ValueError("rrf_k must be > 0")
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must be >= 0")
    if not any(weights.values()):
        raise ValueError("one weight must be > 0")
    named = [(i, b, w) for i, (b, w) in enumerate(weights.items()) if w > 0]
    order = F.create_map(*[F.lit(x) for i, b, _ in named for x in (b, i)])
    weight = F.create_map(*[F.lit(x) for _, b, w in named for x in (b, float(w))])
    rows = lists.where(F.col("backend").isin([b for _, b, _ in named])).withColumn("o", order[F.col("backend")])
    part = weight[F.col("backend")] / (F.lit(rrf_k) + F.col("rank"))
    entry = F.struct("o", "rank", "backend", "raw_score", (1.0 / F.col("rank")).alias("normalized_score"), part.alias("rrf_contribution"))
    fused = rows.groupBy(key, item).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    fused = fused.withColumn("score", F.aggregate("entries", F.lit(0.0), lambda s, e: s + e["rrf_contribution"]))
    seen = F.struct(F.col("entries")[0]["o"].alias("o"), F.col("entries")[0]["rank"].alias("rank"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), seen)
    kept = fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    provenance = F.transform("entries", lambda e: F.struct(e["backend"].alias("backend"), e["rank"].alias("rank"), e["raw_score"].alias("raw_score"), e["normalized_score"].alias("normalized_score"), e["rrf_contribution"].alias("rrf_contribution")))
    return kept.select(key, "rank", item, "score", provenance.alias("provenance"))


def lexical_score(query: Column | str, text: Column | str, rank: Column | str, lexical_weight: float = 0.7, rank_weight: float = 0.3) -> Column:
    """Share of the query's words in the text and reciprocal rank, weighted. A query without words leaves the ranks."""
    if lexical_weight < 0 or rank_weight < 0:
        raise ValueError("weights of the rerank must be >= 0")
    if lexical_weight == 0 and rank_weight == 0:
        raise ValueError("one weight of the rerank must be > 0")
    q = rerank_tokens(query)
    r = F.col(rank) if isinstance(rank, str) else rank
    overlap = F.size(F.array_intersect(q, rerank_tokens(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))) / F.size(q)
    return F.when(F.size(q) == 0, rank_weight / r).otherwise(lexical_weight * overlap + rank_weight / r)


def rerank(results: DataFrame, key: str = "query_id", query: str = "query", text: str = "text", **weights: float) -> DataFrame:
    """Results ordered anew by `lexical_score`, ties by the old rank: `new_rank` and `rerank_score` are added."""
    scored = results.withColumn("rerank_score", lexical_score(query, text, "rank", **weights))
    w = Window.partitionBy(key).orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("new_rank", F.row_number().over(w))


def generation_context(results: DataFrame, k: int, reranked: bool = True, key: str = "query_id") -> DataFrame:
    """The first k results of a question, after reranking all of them if asked."""
    ordered = rerank(results, key) if reranked else results.withColumn("new_rank", F.col("rank"))
    return ordered.where(F.col("new_rank") <= k)
