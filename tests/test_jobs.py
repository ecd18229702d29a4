"""The jobs: growing input, reruns, a failed batch that is run again, and the same result as SQL."""

import glob
import json
import os
import shutil

import duckdb
import pytest

from fathom.operators import lexical
from jobs import answer_sets, index_refresh, registered
from jobs.common import main

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def land(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def held(spark, target):
    return sorted(tuple(r) for r in index_refresh.live_postings(spark, target).collect())


def wanted(spark, state):
    """The postings of some documents, made by the scan's functions."""
    rows = spark.createDataFrame([(i, t) for i, t in state.items()], "id long, content string")
    out = []
    for r in lexical.postings(rows).collect():
        out.append((r.id, r.term, r.tf, r.dl, lexical.fold(state[r.id]).index(r.term)))
    return sorted(out)


def test_index_takes_only_what_is_new(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "index", "checkpoint"))
    run = lambda: index_refresh.refresh(spark, source, target, checkpoint)
    land(spark, [(1, "the fox", "en", "a", 7), (2, "a brown fox", "en", "a", 11), (3, "", "en", None, 0), (4, "...", None, "b", 3), (None, "lost", "en", "a", 4)], source)
    assert run() == {"batches": 1, "documents": 4, "removed": 0, "without_id": 1}
    state = {1: "the fox", 2: "a brown fox", 3: "", 4: "..."}
    assert held(spark, target) == wanted(spark, state)
    files = lambda: {p: os.path.getmtime(p) for p in glob.glob(f"{target}/**/*.parquet", recursive=True)}
    before = files()
    assert run()["batches"] == 0 and files() == before  # nothing new, nothing written
    # a changed document, a new one, one that goes, and a repeated one of which the greatest text stays
    land(spark, [(2, "now the élan élan", "en", "a", 17), (5, "five", "de", "c", 4), (1, None, "en", "a", 0), (6, "b", "en", "a", 1), (6, "a a", "en", "a", 3)], source)
    assert run() == {"batches": 1, "documents": 3, "removed": 1, "without_id": 0}
    state = {2: "now the élan élan", 3: "", 4: "...", 5: "five", 6: "b"}
    assert held(spark, target) == wanted(spark, state)
    after = files()
    assert {p: after.get(p) for p in before} == before  # former segments aren't rewritten
    index = index_refresh.open_index(spark, target)
    n, mean, _ = index.totals()
    assert n == len(state) and mean == pytest.approx(sum(len(lexical.fold(t)) for t in state.values()) / len(state))
    rows = spark.createDataFrame([(i, t) for i, t in state.items()], "id long, content string")
    v = index.verify(rows).first()
    assert v.missing == v.extra == 0
    # the second batch failed after its writes: it's run again, with the same result
    os.remove(f"{checkpoint}/commits/1")
    for p in glob.glob(f"{checkpoint}/commits/.1*"):
        os.remove(p)
    assert run()["batches"] == 1 and held(spark, target) == wanted(spark, state)
    # it failed before its sums were written: searches don't see it
    shutil.rmtree(f"{target}/stats/segment=1")
    assert held(spark, target) == wanted(spark, {1: "the fox", 2: "a brown fox", 3: "", 4: "..."})


def test_index_in_many_batches_is_the_same(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, part in enumerate(docs.randomSplit([1.0] * 3, 5)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = index_refresh.refresh(spark, str(tmp_path / "in"), str(tmp_path / "many"), str(tmp_path / "c1"), files_per_batch=1)
    assert got["batches"] == 3 and got["documents"] == docs.count()
    index_refresh.refresh(spark, f"{SF}/documents.parquet", str(tmp_path / "one"), str(tmp_path / "c2"))
    assert held(spark, str(tmp_path / "many")) == held(spark, str(tmp_path / "one"))


def test_empty_and_missing(spark, tmp_path):
    assert held(spark, str(tmp_path / "none")) == []
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    index_refresh.refresh(spark, str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "c"))
    assert held(spark, str(tmp_path / "index")) == []
    with pytest.raises(ValueError):
        answer_sets.answer_sets(spark, f"{SF}/benchmark.parquet", f"{SF}/documents.parquet", str(tmp_path / "no"), str(tmp_path / "out"))


@pytest.mark.parametrize("name", list(registered.queries()))
def test_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    a, b = registered.queries()[name](spark, SF).toPandas(), con.execute(registered.oracle_sql()[name]).fetchdf()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and len(a)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert a.equals(b)
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))


def test_answer_sets_rerun_and_grow(spark, tmp_path):
    """A rerun gives the same rows, a set of another name stays, and odd rows have defined results."""
    source, target = str(tmp_path / "docs"), str(tmp_path / "out")
    land(spark, [(1, "the fox runs", "en", "a", 12), (2, "the brown fox", None, None, 13), (3, "unrelated words", "en", "b", 15), (4, None, "en", "b", 0), (None, "the fox", "en", "b", 0)], source)
    spark.createDataFrame([(1, "brown fox"), (2, "nothing of it"), (3, ""), (4, None), (None, "fox"), (1, "brown fox")], "item_id long, text string").write.parquet(str(tmp_path / "q"))
    index_refresh.refresh(spark, source, str(tmp_path / "index"), str(tmp_path / "c"))
    run = lambda name: answer_sets.answer_sets(spark, str(tmp_path / "q"), source, str(tmp_path / "index"), target, name, k=2)
    rows = lambda name: sorted((r.question_id, r["rank"], r.doc_id, r.rerank_score, r.lang) for r in answer_sets.read_set(spark, target, name).collect())
    assert run("a") == {"questions": 4, "answered": 1, "rows": 2}
    first = rows("a")
    assert first == [(1, 1, 2, 1.0, None), (1, 2, 1, 0.5, "en")]
    assert run("b") and run("a") and rows("a") == first == rows("b")
    context = answer_sets.read_set(spark, target, "a").where("rank = 1").first().context
    assert context == "--- Snippet 1 [the at :1] ---\nCode:\nthe brown fox\n"


def test_answer_sets_moves_the_texts_of_hits_only(spark, tmp_path, monkeypatch):
    """All documents' texts went through a shuffle to meet a few hits."""
    source, target = str(tmp_path / "docs"), str(tmp_path / "out")
    land(spark, [(1, "the fox runs", "en", "a", 12), (2, "the brown fox", None, None, 13), *((i, f"unrelated words {i}", "en", "b", 15) for i in range(3, 90))], source)
    spark.createDataFrame([(1, "brown fox")], "item_id long, text string").write.parquet(str(tmp_path / "q"))
    index_refresh.refresh(spark, source, str(tmp_path / "index"), str(tmp_path / "c"))
    given, plain = [], answer_sets.best_answers
    monkeypatch.setattr(answer_sets, "best_answers", lambda asked, docs, hits, k: given.append(docs.count()) or plain(asked, docs, hits, k))
    run = lambda: answer_sets.answer_sets(spark, str(tmp_path / "q"), source, str(tmp_path / "index"), target)
    few = run()
    monkeypatch.setattr(answer_sets, "BROADCAST_ROWS", 0)
    assert run() == few == {"questions": 1, "answered": 1, "rows": 2} and given == [2, 89]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    """Arguments come from the config file, and from the command line before it; the session is the command's."""
    seen = {}

    class Builder:
        def appName(self, name):
            return self

        def getOrCreate(self):
            return type("Session", (), {"stop": lambda self: seen.update(stopped=True)})()

    monkeypatch.setattr("jobs.common.SparkSession", type("S", (), {"builder": Builder()}))
    main("x", "about", lambda session, **a: seen.update(a) or {"ok": 1}, ["--config", "jobs/answer_sets.json", "k=7", "target=/t"])
    assert seen["k"] == 7 and seen["target"] == "/t" and seen["depth"] == 100 and seen["stopped"] and json.loads(capsys.readouterr().out) == {"ok": 1}
