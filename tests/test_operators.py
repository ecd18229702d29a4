"""Properties of operators that the tables don't reach."""

import sqlite3

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fathom.functions import text as T
from fathom.operators import fusion, graph, lexical, store, vector
from pyspark.sql import functions as F


def ranked(spark, ids):
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, rank long")


def test_rrf(spark):
    got = [(r.id, r.rrf_score) for r in fusion.rrf(ranked(spark, "abc"), ranked(spark, "bd"), 10).orderBy("rank").collect()]
    assert [x for x, _ in got] == ["b", "a", "d", "c"] and got[0][1] == pytest.approx(1 / 62 + 1 / 61, abs=1e-8)
    assert [r.id for r in fusion.rrf(ranked(spark, "abc"), ranked(spark, "d"), 10).orderBy("rank").collect()][:2] == ["a", "d"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 8)), min_size=1, max_size=10))
def test_without_nested(spark, spans):
    rows = [(i, "f", a, a + n) for i, (a, n) in enumerate(spans)]
    got = {r.id for r in graph.without_nested(spark.createDataFrame(rows, "id long, file_path string, start long, end long")).collect()}
    kept = []
    for i, _, a, b in sorted(rows, key=lambda r: (r[2], -r[3], r[0])):
        if not any(x <= a and b <= y for _, x, y in kept):
            kept.append((i, a, b))
    assert got == {i for i, _, _ in kept}


DOCS = [("1", "get_hash", "the quick brown fox the", ""), ("2", "x", "Quick: the BROWN élan", "fox fox"), ("3", "y", "nothing here", None), ("4", "z", "the the the", ""), ("5", "w", "get hash get hash", "")]


@pytest.mark.parametrize("phrase", ["quick", "brown fox", "the the", "get_hash", "elan"])
def test_bm25_is_fts5(spark, phrase):
    """Scores and matches of the standard library's full-text index."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, name, content, summary)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", DOCS)
    want = {r[0]: -r[1] for r in con.execute("SELECT id, bm25(t) FROM t WHERE t MATCH ?", (f'"{phrase}"',))}
    rows = spark.createDataFrame(DOCS, "id string, name string, content string, summary string")
    got = {r.id: r.bm25 for r in lexical.bm25(rows, [lexical.fold(phrase)], ("name", "content", "summary")).where("tf0 > 0").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)


def test_staged_search(spark):
    rows = spark.createDataFrame(DOCS, "id string, name string, content string, summary string")
    ids = lambda q, n=50: [r.id for r in lexical.staged_search(rows, q, n).orderBy("position").collect()]
    assert ids("???") == [] and ids("get_hash")[0] == "1" and ids("get_hash", 1) == ["1"]
    assert ids("othin") == ["3"]  # only LIKE finds it
    assert set(ids("a.b the")) == set()  # the phrase isn't there, other stages are left out, LIKE finds nothing
    assert ids("quick brown")[0] == "1"


def test_first_stages_have_no_limit(spark, tmp_path):
    """The query staged_search against its SQL: more rows than a stage's former limit, and names that are no tokens or no exact ones."""
    import duckdb

    from fathom.plans import catalogue

    odd = spark.createDataFrame([(-1, "The fox and the"), (-2, "and so"), (-3, "the1 x"), (-4, "The\u00e9 and"), (-5, ""), (-6, "nothing")], "doc_id long, text string")
    many = spark.range(60_000).selectExpr("id AS doc_id", "'so the and' AS text").union(spark.range(60_000, 100_100).selectExpr("id AS doc_id", "'and so the' AS text")).union(spark.range(100_100, 100_150).selectExpr("id AS doc_id", "'so the' AS text"))
    odd.union(many).selectExpr("*", "'en' AS lang", "'s' AS source").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.id, r.stage) for r in catalogue.queries()["staged_search"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert len(got) > 100_100 and got == set(con.execute(catalogue.oracle_sql()["staged_search"]).fetchall())


def test_replies_and_embedding_text(spark):
    r = spark.createDataFrame([('```json\n{"a": "x", "b": {"content": "y"}, "c": {"z": 1}, "d": null}\n```',)], "r string").select(T.reply_map(F.col("r")).alias("m")).first().m
    assert r == {"a": "x", "b": "y", "c": '{"z":1}', "d": None}
    t = spark.range(1).select(T.embeddable_text(F.lit("f"), F.lit("n"), F.lit("class"), F.lit(None).cast("string"), F.lit("s"), F.lit(None).cast("string"), F.lit("code")).alias("t")).first().t
    assert t == "File: f\nName: n\nType: class\nSummary: s\n\nCode:\ncode"


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id long, embedding array<float>")
    assert [(r.id, r.distance) for r in vector.top_k(rows, [1.0, 0.0], 3).orderBy("rank").collect()] == [(1, 0.0), (3, pytest.approx(0.292893)), (2, 1.0)]


def test_store_versions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.version() == 0 and s.read("t", "id long").count() == 0
    for n in (1, 2, 3):
        s.commit({"t": store.upsert(s.read("t", "id long, v string"), spark.createDataFrame([(1, f"a{n}"), (n, "b")], "id long, v string").dropDuplicates(["id"]), "id")})
    assert s.version() == 3 and s.read("t", "id long, v string").count() == 3
    s.vacuum(1)
    assert s.version() == 3


def test_stream_index(spark, tmp_path):
    from fathom.schema import FILES, SNIPPETS
    from fathom.streaming.ingest import index_stream, landing

    st_ = store.Store(spark, str(tmp_path / "store"))
    for n, code in enumerate(["def a():\n    return b()\n", "def b():\n    return 1\n"]):
        spark.createDataFrame([(f"f{n}.py", "python", code, str(n))], FILES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        index_stream(landing(spark, str(tmp_path / "in")), st_, str(tmp_path / "ck")).awaitTermination()
    assert {r.name for r in st_.read("snippets", SNIPPETS).where("type = 'function'").collect()} == {"a", "b"}


def test_stream_build_and_stream_share_a_store(spark, tmp_path):
    """Builds and streams on one store, in turn; tables that a commit isn't given stay, and a draft without its marker counts for nothing."""
    from fathom.plans.index import build
    from fathom.schema import ERRORS, FILES, SNIPPETS
    from fathom.streaming.ingest import index_stream, landing

    st_ = store.Store(spark, str(tmp_path / "store"))
    row = lambda n, code: spark.createDataFrame([(f"f{n}.py", "python", code, f"h{n}{code}")], FILES)
    names = lambda: {r.name for r in st_.read("snippets", SNIPPETS).where("type = 'function'").collect()}
    build(row(0, "def a():\n    pass\n"), st_)
    assert names() == {"a"}
    for n, name in ((1, "b"), (2, "c")):
        row(n, f"def {name}():\n    pass\n").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        index_stream(landing(spark, str(tmp_path / "in")), st_, str(tmp_path / "ck")).awaitTermination()
        files = st_.read("files", FILES)
        assert files.count() == n and names() == {"b", "c"} - ({"c"} if n == 1 else set())
        build(files.unionByName(row(9, "def z(:\n")), st_)
        assert "b" in names() and st_.read("files", FILES).count() == n
    assert [r.file_path for r in st_.read("errors", ERRORS).collect()] == ["f9.py"]
    version, before = st_.version(), names()
    (tmp_path / "store" / f"v{version + 1}" / "snippets").mkdir(parents=True)  # a job that died between its writes (folders of commits have names of their own)
    assert st_.version() == version and names() == before
    st_.vacuum(1)
    assert names() == before and st_.read("files", FILES).count() == 2


def test_failing_models(spark):
    from fathom import models
    from fathom.plans.search import best_rows

    rows = spark.createDataFrame([(i, i, f"text {i}") for i in range(1, 6)], "id long, rank long, document string")

    def broken(query, document):
        return F.raise_error(F.lit("no model")).cast("double")

    got = best_rows(rows, "q", 3, models.Models(score=broken), True).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 2, 3] and [r.rerank_score for r in got] == [pytest.approx(0.0001 / n) for n in (1, 2, 3)]
    logits = models.with_sigmoid(lambda q, d: F.lit(0.0))
    assert best_rows(rows, "q", 1, models.Models(score=logits), True).first().rerank_score == 0.5
    v = spark.range(1).select(models.zero_on_failure(lambda t: F.lit(None).cast("array<float>"), 3)(F.lit("x")).alias("v")).first().v
    assert v == [0.0, 0.0, 0.0]
    yes = models.expander(lambda p: iter(["yes"] if "decide" in p else ["code"]), "decide {query}", "make {query}")
    assert yes("q") == "q\n\nHypothetical code implementation:\ncode" and models.expander(lambda p: iter(["No."]), "decide {query}", "")("q") == "q"
    snippets = spark.createDataFrame([("a", "x", None, None, "A", []), ("b", "y", None, None, "B", [])], "id string, content string, docstring string, signature string, name string, lines array<string>")
    told = models.batched_summaries(lambda p: iter(['```json\n{"a": {"summary": "says a"}}\n```']), "{snippets}")(snippets)
    assert {r.id: r.summary for r in told.collect()} == {"a": "says a", "b": "B"}


def test_merged_lists(spark):
    first, second = (spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, position long") for ids in ("ab", "bcd"))
    assert [r.id for r in lexical.merged_lists(first, second).orderBy("position").collect()] == list("abcd")


@pytest.mark.parametrize("text", ["", "...", "a", " a", "a.", ".a b.", "the the the", "x_y", None, "é É e"])
def test_spaced_lengths_and_phrases(spark, text):
    import re

    row = spark.createDataFrame([(text,)], "t string").select(lexical.spaced(F.col("t")).alias("s")).select(lexical.length(F.col("s")).alias("n"), lexical.occurrences(F.col("s"), ["the", "the"]).alias("p"), lexical.occurrences(F.col("s"), ["e"]).alias("e")).first()
    tokens = re.findall(r"[^\W_]+", (text or "").lower().translate(str.maketrans("é", "e")))
    assert row.n == len(tokens) and row.p == sum(x == y == "the" for x, y in zip(tokens, tokens[1:])) and row.e == tokens.count("e")
