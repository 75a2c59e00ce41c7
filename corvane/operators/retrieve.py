"""Ranking, fusion, filters, diversity and reranking over hits (query_id, key, score, rank)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.index import ranked

RRF_CONSTANT = 60


def fuse(dense: DataFrame, sparse: DataFrame, k: int, constant: int = RRF_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion of two lists; ties go to the better rank, then the higher dense score, then the key."""
    one = dense.select("query_id", "key", "rank", F.col("score").alias("dense"))
    two = sparse.select("query_id", "key", "rank", F.lit(None).cast("double").alias("dense"))
    fused = one.unionByName(two).groupBy("query_id", "key").agg(
        F.sum(1.0 / (F.lit(constant) + F.col("rank"))).alias("score"), F.min("rank").alias("best"), F.max("dense").alias("dense")
    )
    order = [F.desc("score"), F.asc("best"), F.desc_nulls_last("dense"), F.asc("key")]
    return ranked(fused, k, order).select("query_id", "key", "score", "rank")


def score_floor(hits: DataFrame, floor: float | None) -> DataFrame:
    return hits if floor is None else hits.where(F.col("score") >= floor)


def metadata_filter(hits: DataFrame, source_contains: str | None = None, page: int | None = None) -> DataFrame:
    """Hits whose source holds a text, in any case, and whose page is the given one. Needs source and page columns."""
    if source_contains:
        hits = hits.where(F.lower("source").contains(source_contains.lower()))
    return hits if page is None else hits.where(F.col("page") == page)


def renumbered(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "key"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def mmr(hits: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """Maximal marginal relevance over each query's candidates (query_id, key, query, embedding): relevance to the query
    against the most similar selected one. Scores are relevances; ties go to the smaller key."""

    def select(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", ignore_index=True)
        vectors = np.stack(group["embedding"].to_numpy()).astype(np.float32)
        query = np.asarray(group["query"].iloc[0], dtype=np.float32)
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = vectors / np.where(norms == 0, 1, norms)
        relevance = vectors @ (query / (np.linalg.norm(query) or 1.0))
        redundancy, chosen = np.zeros(len(group)), []
        open_ = np.ones(len(group), dtype=bool)
        for _ in range(min(k, len(group))):
            value = np.where(open_, weight * relevance.astype(float) - (1 - weight) * redundancy, -np.inf)
            best = int(np.argmax(value))
            chosen.append(best)
            open_[best] = False
            near = (vectors @ vectors[best]).astype(float)
            redundancy = near if len(chosen) == 1 else np.maximum(redundancy, near)
        return pd.DataFrame({"query_id": group["query_id"].iloc[chosen], "key": group["key"].iloc[chosen], "score": relevance[chosen].astype(float), "rank": np.arange(1, len(chosen) + 1)})

    kinds = dict(hits.dtypes)
    if k <= 0:
        return hits.limit(0).select("query_id", "key", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank"))
    return hits.groupBy("query_id").applyInPandas(select, f"query_id {kinds['query_id']}, key {kinds['key']}, score double, rank long")


def overlap_scorer(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the query's distinct terms that a text has."""
    from corvane.functions.text import terms

    own = F.array_distinct(terms(query))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, terms(text))) / F.size(own)).otherwise(0.0)


def rerank(hits: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = overlap_scorer) -> DataFrame:
    """Hits with query and text columns, in order of ``scorer(query, text)``, then of the key. A scorer may be a pandas UDF."""
    scored = hits.withColumn("score", scorer(F.col("query"), F.col("text")))
    return ranked(scored.drop("rank"), k, [F.desc("score"), F.asc("key")])


def staged(hits: DataFrame, top_n: int = 20, top_k: int = 5, floor: float | None = None, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The first ``top_n``, those above the floor, then reranked, or cut to ``top_k`` and numbered again."""
    kept = score_floor(hits.where(F.col("rank") <= top_n), floor)
    return rerank(kept, top_k, scorer) if scorer else renumbered(kept, top_k)


def hybrid(dense: DataFrame, sparse: DataFrame, top_k: int) -> DataFrame:
    """Fusion of lists that hold max(top_k, 20) hits each."""
    deep = max(top_k, 20)
    return fuse(dense.where(F.col("rank") <= deep), sparse.where(F.col("rank") <= deep), top_k)


def first_of_source(hits: DataFrame) -> DataFrame:
    """query_id, source, rank: distinct sources in order of their first hit."""
    firsts = hits.groupBy("query_id", "source").agg(F.min("rank").alias("first"))
    return firsts.select("query_id", "source", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "source")).alias("rank"))
