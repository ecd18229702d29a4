"""Job 2, batch: for a table of questions, the best documents with their context, to evaluate or feed a language model offline.

    python -m jobs.answer_sets --config jobs/answer_sets.json questions=/data/benchmark documents=/data/docs index=/data/index target=/data/answers

What a search does for one query, for all at once: candidates by BM25 from the stored index that job 1
keeps (no text is read for it), their documents, a rerank by the share of the question's words that a
document holds, and the context block of each of the best ``k``. Written below ``target/set=NAME`` in folders
by language; a rerun writes the set anew, with the same rows. Questions without a hit have no rows; the log counts them.

Moves: the postings of the questions' terms, once, by document (for very many questions by their upper bounds, see
lexical.best_many), then ``depth`` rows per question, joined to the documents by id; where these are 2^20 rows at most, their
ids are sent to every task and only their texts move. The set of questions may grow; what is collected has a bound.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions.text import tokens
from fathom.operators.postings import BROADCAST_ROWS
from fathom.operators.store import checkpointed, prepared
from fathom.plans.search import context_block
from jobs.common import main
from jobs.index_refresh import open_index

log = logging.getLogger("jobs.answer_sets")
RESULT = "question_id long, rank int, doc_id long, bm25 double, keyword_rank long, rerank_score double, context string, lang string"
NO_RELATIONS = "array<struct<type:string,target:string>>"


def best_answers(questions: DataFrame, documents: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The k best of each question's hits (query_id, id, bm25, rank), reranked, with their context. Questions: query_id, query; documents: id, content, lang, file_path."""
    asked = questions.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("_wanted"))
    rows = hits.join(asked, "query_id").join(documents, "id")
    score = F.round(F.size(F.array_intersect("_wanted", tokens(F.col("content")))) / F.size("_wanted"), 6)
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    best = rows.withColumn("rerank_score", score).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    name = F.regexp_extract(F.coalesce("content", F.lit("")), "[A-Za-z]+", 0)
    snippet = F.struct(name.alias("name"), F.coalesce("file_path", F.lit("")).alias("file_path"), F.lit(0).alias("start_line"), F.lit(None).cast("string").alias("summary"), "content")
    shown = best.withColumn("_s", snippet).withColumn("_p", F.lit(None).cast("struct<name:string,type:string>")).withColumn("_r", F.array().cast(NO_RELATIONS))
    context = context_block(F.col("_n"), F.col("_s"), F.col("_p"), F.col("_r"))
    return shown.select(F.col("query_id").alias("question_id"), F.col("_n").alias("rank"), F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"), F.col("rank").alias("keyword_rank"), "rerank_score", context.alias("context"), "lang")


def answer_sets(spark: SparkSession, questions: str, documents: str, index: str, target: str, name: str = "default", k: int = 5, depth: int = 100, format: str = "parquet") -> dict:
    """Writes the set; gives what it read and wrote."""
    prepared(spark)
    asked = spark.read.parquet(questions).select(F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("query")).where("query_id IS NOT NULL").dropDuplicates(["query_id"])
    docs = spark.read.parquet(documents).select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("content"), "lang", F.col("source").alias("file_path")).where("id IS NOT NULL")
    found = open_index(spark, index)
    if found is None:
        raise ValueError(f"no index at {index}: run jobs.index_refresh first")
    path = f"{target}/set={name}"
    hits, n = found.search_many(asked, depth), asked.count()
    if n * depth <= BROADCAST_ROWS:  # the texts of other documents stay where they are read
        hits = checkpointed(hits)
        docs = docs.join(F.broadcast(hits.select("id").distinct()), "id", "left_semi")
    best_answers(asked, docs, hits, k).write.mode("overwrite").partitionBy("lang").format(format).save(path)
    written = read_set(spark, target, name, format).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("question_id").alias("answered")).first()
    done = {"questions": n, "answered": written["answered"], "rows": written["rows"]}
    log.info("read %s with index %s; wrote %s to %s", questions, index, done, path)
    return done


def read_set(spark: SparkSession, target: str, name: str = "default", format: str = "parquet") -> DataFrame:
    return spark.read.schema(RESULT).format(format).load(f"{target}/set={name}")


if __name__ == "__main__":
    main("answer_sets", __doc__, answer_sets)
