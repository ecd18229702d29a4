"""Table functions in SQL."""

import pytest

from fathom.functions import tables
from fathom.parsing import outline


def test_chunks_in_sql(spark):
    tables.register(spark)
    text = "".join(f"line {i}\n" for i in range(200)) + "é"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "one")], "doc_id long, text string")
    got = spark.sql("SELECT d.doc_id, c.* FROM {d} d, LATERAL text_chunks(d.text, 300) c", d=df).orderBy("doc_id", "chunk_index").collect()
    assert [r.chunk for r in got if r.doc_id == 1] == outline.chunks(text, 300) and all(text[r.start :].startswith(r.chunk) for r in got if r.doc_id == 1)
    assert [(r.doc_id, r.chunk) for r in got if r.doc_id > 1] == [(4, "one")]


def test_snippets_in_sql(spark):
    tables.register(spark)
    df = spark.createDataFrame([("a.py", "python", "def f():\n    return 1\n"), ("b.x", "other", "x"), ("c.py", "python", None)], "p string, l string, c string")
    got = spark.sql("SELECT s.name, s.type, s.file_path FROM {f} f, LATERAL code_snippets(f.p, f.l, f.c) s", f=df).collect()
    assert {(r.name, r.type, r.file_path) for r in got} == {("f", "function", "a.py"), ("a.py", "file", "a.py")}


@pytest.mark.parametrize("call", ["text_chunks('a', 0)", "text_chunks(1, 10)", "text_chunks('a', 'b')", "code_snippets('a', 'python', 1)"])
def test_wrong_arguments_fail_when_analysed(spark, call):
    tables.register(spark)
    with pytest.raises(Exception):
        spark.sql(f"SELECT * FROM {call}").schema
