"""Reciprocal-rank fusion, hydration, reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import tokens

RRF_K = 60  # fixed value


def candidate_depth(n_results: int) -> int:
    return max(10 * n_results, 100)


def rrf(vector: DataFrame, keyword: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """id, rrf_score, rank. Ties keep the vector list's order, then the keyword list's."""
    both = vector.select("id", F.col("rank").alias("v"), F.lit(None).cast("long").alias("w")).unionByName(keyword.select("id", F.lit(None).cast("long").alias("v"), F.col("rank").alias("w")))
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.min(c)), F.lit(0.0))
    fused = both.groupBy("id").agg(F.round(part("v") + part("w"), 9).alias("rrf_score"), F.min("v").alias("vector_rank"), F.min("w").alias("keyword_rank"))
    order = [F.desc("rrf_score"), F.col("vector_rank").isNull(), F.coalesce("vector_rank", "keyword_rank"), F.col("id")]
    best = fused.orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def hydrate(ranked: DataFrame, snippets: DataFrame) -> DataFrame:
    """Ranked ids with their rows; ids without a row drop out. The ranked side has the search's depth."""
    return snippets.join(F.broadcast(ranked), "id")


def best_document(rows: DataFrame, vector_docs: DataFrame, keyword_docs: DataFrame, computed) -> DataFrame:
    """The vector store's document, else the keyword list's, else the computed text; empty counts as none."""
    v = vector_docs.select("id", F.col("document").alias("_v"))
    w = keyword_docs.select("id", F.col("document").alias("_w"))
    pick = F.coalesce(F.nullif(F.col("_v"), F.lit("")), F.nullif(F.col("_w"), F.lit("")), computed)
    return rows.join(v, "id", "left").join(w, "id", "left").withColumn("document", pick).drop("_v", "_w")


def with_parent(rows: DataFrame, snippets: DataFrame) -> DataFrame:
    parent = snippets.select(F.col("id").alias("parent_id"), F.struct("name", "type").alias("parent"))
    return rows.join(parent, "parent_id", "left")


def overlap_score(query: str, document) -> F.Column:
    """Share of the query's distinct tokens that the document holds."""
    wanted = F.array_distinct(tokens(F.lit(query)))
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, tokens(document))) / F.size(wanted)).otherwise(0.0)


def rerank(rows: DataFrame, query: str, top_n: int, scorer=None) -> DataFrame:
    """The best rows by a scorer's score; of equals, the one that ranked higher before.

    ``scorer(query, document column) -> Column``; it may be a pandas UDF over a model.
    """
    score = (scorer or overlap_score)(query, F.col("document"))
    scored = rows.withColumn("rerank_score", F.round(score.cast("double"), 6))
    return scored.orderBy(F.desc("rerank_score"), "rank").limit(top_n)


def fallback_scores(rows: DataFrame, top_n: int) -> DataFrame:
    """What a failed reranker gives: the first rows, with scores 0.0001, 0.00005, ..."""
    return rows.orderBy("rank").limit(top_n).withColumn("rerank_score", F.lit(0.0001) / F.row_number().over(Window.orderBy("rank")))
