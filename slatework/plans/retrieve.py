"""Hybrid retrieval: vector and keyword branches of one plan, fused by reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.functions import text as T
from slatework.operators import fusion, keyword, vector_search
from slatework.operators.inverted_index import InvertedIndex


def vector_branch(corpus: DataFrame, query: list[float], depth: int, key: str, column: str = "embedding") -> DataFrame:
    """Ranked rows of the vector search, without the vectors."""
    found = vector_search.top_k(corpus, query, depth, key, column=column, digits=None)
    return fusion.ranked(found.drop(column), key, "similarity").withColumn("similarity", F.round("similarity", 4))


def keyword_branch(corpus: DataFrame, query: str, depth: int, key: str, text: str, mode: str, index: InvertedIndex | None = None) -> DataFrame:
    """Ranked rows of the keyword search: ``any`` term by BM25, or ``all`` terms by text rank; by the index of the corpus if there is one."""
    spark = corpus.sparkSession
    wanted = spark.range(1).select(T.query_terms(F.lit(query)).alias("t")).first()["t"]
    if index is not None:
        best = (index.top_k if mode == "any" else index.top_k_all)(wanted, depth, key, digits=None).collect()  # depth rows
        scores = spark.createDataFrame(best, f"{key} {corpus.schema[key].dataType.simpleString()}, score double")
        found = corpus.where(F.col(key).isin([r[0] for r in best])).join(F.broadcast(scores), key)
        return fusion.ranked(found, key, "score").withColumn("score", F.round("score", 4))
    scored = keyword.bm25(corpus, wanted, text) if mode == "any" else keyword.ts_rank(corpus, wanted, text)
    return fusion.ranked(keyword.top_k(scored, depth, key, digits=None), key, "score").withColumn("score", F.round("score", 4))


def retrieve(
    corpus: DataFrame,
    query: str,
    vector: list[float],
    limit: int = 5,
    key: str = "id",
    text: str = "content",
    column: str = "embedding",
    mode: str = "all",
    hybrid: bool = True,
    weights: dict[str, float] | None = None,
    index: InvertedIndex | None = None,
) -> DataFrame:
    """Top rows by fused rank; each branch is fetched to twice the limit. Without keyword hits the vector order stands."""
    near = vector_branch(corpus, vector, 2 * limit, key, column)
    lists = {"vector": near}
    if hybrid:
        lists["keyword"] = keyword_branch(corpus.drop(column), query, 2 * limit, key, text, mode, index)
    return fusion.fuse(lists, key, weights=weights, limit=limit)
