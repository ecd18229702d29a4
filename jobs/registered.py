"""The jobs as queries: each runs its job twice into a new folder, and gives the whole output as it stands then."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.plans.catalogue import TOK
from jobs import answer_sets, index_refresh
from jobs.common import new_folder


def job1_index_refresh(spark, sf_dir):
    base = new_folder(spark, "index-refresh")
    for _ in range(2):
        index_refresh.refresh(spark, f"{sf_dir}/documents.parquet", f"{base}/index", f"{base}/checkpoint")
    return index_refresh.live_postings(spark, f"{base}/index").withColumnRenamed("id", "doc_id")


def job2_answer_sets(spark, sf_dir):
    base = new_folder(spark, "answer-sets")
    index_refresh.refresh(spark, f"{sf_dir}/documents.parquet", f"{base}/index", f"{base}/checkpoint")
    for _ in range(2):
        answer_sets.answer_sets(spark, f"{sf_dir}/benchmark.parquet", f"{sf_dir}/documents.parquet", f"{base}/index", base, "benchmark")
    return answer_sets.read_set(spark, base, "benchmark").withColumn("rank", F.col("rank").cast("long"))


JOB1_SQL = f"WITH {TOK} SELECT t.id AS doc_id, term, count(*) AS tf, any_value(dl) AS dl, min(pos) - 1 AS first_position FROM tok t JOIN len l ON l.id = t.id GROUP BY t.id, term"

JOB2_SQL = rf"""WITH {TOK}, q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark),
tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT query_id, term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM q JOIN df USING (term), stat),
sc AS (SELECT query_id, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25 FROM w JOIN tf USING (term) JOIN len USING (id), stat GROUP BY query_id, id),
hits AS (SELECT query_id, id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS keyword_rank FROM sc QUALIFY keyword_rank <= 100),
wanted AS (SELECT query_id, list(DISTINCT term) AS terms FROM q GROUP BY query_id),
r AS (SELECT query_id, h.id, bm25, keyword_rank, round(len(list_intersect(list_distinct(t), terms)) / len(terms)::DOUBLE, 6) AS rerank_score FROM hits h JOIN wanted USING (query_id) JOIN lists l ON l.id = h.id),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, keyword_rank) AS rank FROM r QUALIFY rank <= 5)
SELECT query_id AS question_id, rank, b.id AS doc_id, bm25, keyword_rank, rerank_score, '--- Snippet ' || rank || ' [' || regexp_extract(text, '[A-Za-z]+') || ' at ' || coalesce(source, '') || ':1] ---' || chr(10) || 'Code:' || chr(10) || text || chr(10) AS context, lang FROM b JOIN documents d ON d.doc_id = b.id"""


def queries() -> dict:
    return {"job1_index_refresh": job1_index_refresh, "job2_answer_sets": job2_answer_sets}


def oracle_sql() -> dict[str, str]:
    return {"job1_index_refresh": JOB1_SQL, "job2_answer_sets": JOB2_SQL}
