"""Fill-in-middle against SQL, and against a plain version on odd texts."""

import collections
import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from fathom.llm import op11_fim as op

SF = "/root/testdata/sf0.001"


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    a, b = op.op11_fim(spark, SF).toPandas(), con.execute(op.ORACLE_SQL).fetchdf()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and set(a["form"]) == {"plain", "psm", "spm"}
    a, b = (x[columns].astype({"prefix_chars": "Int64", "middle_chars": "Int64"}).astype(str).sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert a.equals(b)


@pytest.mark.parametrize("partitions", [1, 5])
def test_against_a_plain_version(spark, partitions):
    rng = random.Random(5)
    alphabet = ["a", "Zz", " ", "\n", "é", "ß", "漢", "𝒳", "<", ">", "P", "S", "M", "<P", "S>", "<M", "9", "\0"]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randrange(60)))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (None, "no id, twice"), (None, "no id, twice"), (7, rows[7][1]), (1002, "a<P>b"), (1003, "<S"), (1004, ">"), (1005, "xy" * 200_000), (1006, "ñ " * 300_000), (1007, "\n" * 70_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = op.fill_in_middle(df)
    want = collections.Counter(brute(*r) for r in rows)
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert {f for _, _, f, *_ in want} == {"plain", "psm", "spm"}
    texts = collections.Counter((i, t or "") for i, t in rows)
    back = got.select("doc_id", op.restored(F.col("output"), F.col("form")))
    assert collections.Counter(tuple(r) for r in back.collect()) == texts


def test_odd_tables(spark, odd, empty, given):
    given(op, documents=odd)
    got = op.op11_fim(spark, "").collect()
    want = collections.Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())
    assert collections.Counter((r.doc_id, r.restored_sha256) for r in got) == want
    given(op, documents=empty)
    assert op.op11_fim(spark, "").collect() == []
