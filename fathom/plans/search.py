"""Search and answer: keyword and vector lists, fused, hydrated, reranked, with parents and relations."""

from __future__ import annotations

import logging
from collections.abc import Iterator

from pyspark.errors import PythonException, SparkRuntimeException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.models import MARKER, Models
from fathom.operators import fusion, graph, lexical, vector
from fathom.operators.postings import Index
from fathom.operators.store import Store, checkpointed
from fathom.plans.index import document, term_index
from fathom.schema import EDGES, NODES, SNIPPETS, VECTORS

PROMPT = "Answer the question about the code base from the snippets below; say so where they don't tell.\n\nQuestion: {query}\n\nSnippets:\n{context}\n\nAnswer:"


def keyword_list(snippets: DataFrame, query: str, final_query: str, limit: int, index: Index | None = None) -> DataFrame:
    """The staged search of the query, then of the expanded query where that differs: id and rank. By the stored postings where there are any."""
    find = (lambda q: index.staged_search(q, limit, lambda: snippets)) if index else (lambda q: lexical.staged_search(snippets, q, limit))
    first = find(query)
    if final_query != query:
        first = lexical.merged_lists(first, find(final_query.replace(MARKER, " ")))
    return first.select("id", F.col("position").alias("rank"))


def embedded(spark, models: Models, text: str) -> list[float]:
    return list(spark.range(1).select(models.embed(F.lit(text)).alias("v")).first()["v"])


def best_rows(rows: DataFrame, query: str, n_results: int, models: Models, reranked: bool) -> DataFrame:
    """The n best hydrated rows, cut, as what follows reads them more than once; a scorer that fails leaves the first n with falling scores."""
    if not reranked:
        return checkpointed(rows.orderBy("rank").limit(n_results).withColumn("rerank_score", F.lit(None).cast("double")))
    try:
        return checkpointed(fusion.rerank(rows, query, n_results, models.score))
    except (PythonException, SparkRuntimeException) as e:  # raised by the scorer's own code; a lost executor or a full disk is another failure, and rises
        logging.getLogger(__name__).warning("reranking failed: %s", e)
        return checkpointed(fusion.fallback_scores(rows, n_results))


def search(st: Store, query: str, n_results: int = 5, models: Models | None = None, reranked: bool = True) -> DataFrame:
    """Hits: rank, id, scores, the snippet, its parent, its relations and its document."""
    models = models or Models()
    return search_tables(st.read("snippets", SNIPPETS), st.read("vectors", VECTORS), st.read("edges", EDGES), st.read("nodes", NODES), query, n_results, models, reranked, index=term_index(st))


def search_tables(snippets: DataFrame, vectors: DataFrame, edges: DataFrame, nodes: DataFrame, query: str, n_results: int, models: Models, reranked: bool = True, query_vector: list[float] | None = None, index: Index | None = None) -> DataFrame:
    """As search(), over tables. The lists are cut at the search's depth, and hydration scans the snippets once."""
    depth = fusion.candidate_depth(n_results)
    final_query = models.expand(query)
    words = checkpointed(keyword_list(snippets, query, final_query, depth, index))
    near = vector.top_k(vectors, query_vector or embedded(snippets.sparkSession, models, final_query), depth)
    fused = checkpointed(fusion.rrf(near, words, depth).select("id", "rrf_score", "rank"))
    rows = fusion.hydrate(fused, snippets)
    # of the depth's ids at most
    told = vectors.select("id", "document").join(F.broadcast(fused.select("id")), "id", "left_semi")
    said = rows.join(F.broadcast(words.select("id")), "id", "left_semi").select("id", document(False).alias("document"))
    best = best_rows(fusion.best_document(rows, told, said, document()), query, n_results, models, reranked)
    hits = fusion.with_parent(best, snippets)
    related = graph.neighbours(edges.join(F.broadcast(best.select(F.col("id").alias("source_id"))), "source_id", "left_semi"), nodes)
    hits = hits.join(related, F.col("id") == F.col("source_id"), "left")
    order = Window.orderBy(F.desc_nulls_last("rerank_score"), "rank")
    fields = [c for c in snippets.columns if c != "id"]
    return hits.select(F.row_number().over(order).alias("rank"), "id", "rrf_score", "rerank_score", F.struct("id", *fields).alias("snippet"), "parent", F.coalesce("relations", F.array().cast("array<struct<type:string,target:string>>")).alias("relations"), "document")


# Fixed layout of a hit in the context.
def context_block(hit_rank, snippet, parent, relations):
    """One hit's part of the answer's context."""
    inside = F.when(parent["name"].isNotNull(), F.concat(F.lit(" [in "), parent["name"], F.lit(" ("), parent["type"], F.lit(")]"))).otherwise(F.lit(""))
    head = F.concat(F.lit("--- Snippet "), hit_rank.cast("string"), F.lit(" ["), snippet["name"], inside, F.lit(" at "), snippet["file_path"], F.lit(":"), (snippet["start_line"] + 1).cast("string"), F.lit("] ---"))
    summary = F.when(F.coalesce(snippet["summary"], F.lit("")) != "", F.concat(F.lit("\nSummary: "), snippet["summary"])).otherwise(F.lit(""))
    related = F.array_join(F.transform(relations, lambda r: F.concat_ws(" ", r["type"], r["target"])), ", ")
    line = F.when(F.size(relations) > 0, F.concat(F.lit("\nRelationships: "), related)).otherwise(F.lit(""))
    return F.concat(head, summary, line, F.lit("\nCode:\n"), F.coalesce(snippet["content"], F.lit("")), F.lit("\n"))


def answer_context(hits: DataFrame) -> DataFrame:
    """One row: the hits' blocks in order."""
    block = context_block(F.col("rank"), F.col("snippet"), F.col("parent"), F.col("relations"))
    return hits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n").alias("context"))


def stream_answer(hits: DataFrame, query: str, models: Models | None = None) -> Iterator[str]:
    """The answer piece by piece."""
    context = answer_context(hits).first()["context"] or ""
    yield from (models or Models()).complete(PROMPT.format(query=query, context=context))


def answer(hits: DataFrame, query: str, models: Models | None = None) -> str:
    return "".join(stream_answer(hits, query, models))


def api_rows(hits: DataFrame) -> DataFrame:
    """Hits as the JSON interface shows them, lines counted from 1."""
    s = F.col("snippet")
    return hits.select("rank", F.to_json(F.struct(s["name"].alias("name"), s["file_path"].alias("file_path"), (s["start_line"] + 1).alias("start_line"), s["content"].alias("content"), s["summary"].alias("summary"), F.col("relations"))).alias("json"))


def events(hits: DataFrame, query: str, models: Models | None = None) -> Iterator[str]:
    """Server-sent events: the hits, the answer's pieces, the end."""
    import json

    rows = [json.loads(r["json"]) for r in api_rows(hits).orderBy("rank").collect()]  # n_results rows
    yield f"data: {json.dumps({'type': 'metadata', 'results': rows})}\n\n"
    for piece in stream_answer(hits, query, models):
        yield f"data: {json.dumps({'type': 'token', 'content': piece})}\n\n"
    yield "data: [DONE]\n\n"
