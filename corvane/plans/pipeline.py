"""Questions against a store of chunks, end to end: search, fuse, rank, pack, answer, check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.config import Settings
from corvane.functions import text
from corvane.operators import index, retrieve
from corvane.operators.generate import FixedProvider, Provider, answer, expand_query, pack_prompts


def prepared(questions: DataFrame, settings: Settings, provider: Provider | None = None) -> DataFrame:
    """query_id, question and text (what is searched for). Questions are a stated, small set; expansion is paid for on the driver."""
    if settings.query_preprocess == "query_expansion":
        if provider is None:
            raise ValueError("query expansion needs a provider")
        plain = questions.select("query_id", "question", text.preprocess_query(F.col("question"))["processed"].alias("text")).collect()
        rows = [(r["query_id"], r["question"], expand_query(r["text"], provider) if r["text"] else "") for r in plain]
        return questions.sparkSession.createDataFrame(rows, f"query_id {dict(questions.dtypes)['query_id']}, question string, text string")
    return questions.select("query_id", "question", text.preprocess_query(F.col("question"), settings.query_preprocess)["processed"].alias("text"))


def search(chunks: DataFrame, questions: DataFrame, settings: Settings, vectors: DataFrame | None = None, provider: Provider | None = None) -> DataFrame:
    """query_id, key, score, rank, question, text, source of each question's hits. BM25 alone needs no vectors."""
    asked = prepared(questions, settings, provider)
    n = settings.retrieve_top_n
    sparse = index.bm25_search(index.bm25_build(chunks), asked, n) if settings.retriever != "dense" else None
    dense = None
    if settings.retriever != "bm25":
        vectors = chunks.select(F.col("id").alias("key"), index.hashing_embedder(F.col("text")).alias("embedding")) if vectors is None else vectors
        embedded = asked.where(F.col("text") != "").select("query_id", index.hashing_embedder(F.col("text")).alias("embedding"))
        dense = index.dense_search(vectors, embedded, n, "cosine")
    hits = retrieve.fuse(dense, sparse, n) if dense is not None and sparse is not None else (dense if sparse is None else sparse)
    joined = hits.join(chunks.select(F.col("id").alias("key"), F.col("text"), "source"), "key").join(asked.select("query_id", "question", F.col("text").alias("query")), "query_id")
    ranked = retrieve.staged(joined, n, settings.top_k, settings.score_floor, retrieve.overlap_scorer if settings.reranker else None)
    return ranked.select("query_id", "key", "score", "rank", "question", "text", "source")


def ask(chunks: DataFrame, questions: DataFrame, settings: Settings, make_provider: Callable[[], Provider] = FixedProvider, vectors: DataFrame | None = None) -> DataFrame:
    """query_id, answer, abstained, cited, invalid, valid, tokens and cost. Prompts hold the question as it was asked."""
    hits = search(chunks, questions, settings, vectors, make_provider() if settings.query_preprocess == "query_expansion" else None)
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    packed = pack_prompts(questions, hits).join(counts, "query_id", "left").na.fill(0, ["n_hits"])
    return answer(packed, make_provider)
