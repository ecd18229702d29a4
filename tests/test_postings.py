"""The stored inverted index: same results as a scan, kept in step through changes and merges, read by buckets."""

import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import lexical, postings, store
from fathom.plans.index import term_index, term_segment

SCHEMA = "id string, name string, content string, summary string"
WORDS = ["the", "of", "parse", "header", "Header", "élan", "x_y", "get_hash", "fox", "brown", "quick", "a", "b1", "zeta", "omega"]


def some_rows(n, seed=1):
    rng = random.Random(seed)
    weights = [40, 30] + [4] * (len(WORDS) - 2)
    text = lambda k: " ".join(rng.choices(WORDS, weights, k=k))
    rows = [(f"r{i:03d}", rng.choice(WORDS), text(rng.randrange(30)), rng.choice([None, "", text(3)])) for i in range(n)]
    return rows + [("null", None, None, None), ("empty", "", "", ""), ("marks", "...", "-- !!", None)]


def put(spark, st, rows):
    """Brings a store's snippets and index to some rows."""
    df = spark.createDataFrame(rows, SCHEMA)
    tables, drop = term_segment(st, df)
    st.commit({"snippets": df} | tables, {n: ["bucket"] for n in tables if n.startswith("postings_")}, drop)
    return df


QUERIES = [("the of", 50), ("quick brown fox", 3), ("get_hash", 50), ("elan", 5), ("a", 50), ("a.b the", 50), ("the the", 50), ("ader", 50), ("???", 3), ("Header parse the", 7)]


def listed(df):
    return [tuple(r) for r in df.orderBy("position").select("id", "stage", "rank", "position").collect()]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    st = store.Store(spark, str(tmp_path_factory.mktemp("index") / "s"))
    return put(spark, st, some_rows(120)), st


@pytest.mark.parametrize(("query", "limit"), QUERIES)
def test_staged_search_is_the_scan(built, query, limit):
    rows, st = built
    assert listed(term_index(st).staged_search(query, limit, lambda: rows)) == listed(lexical.staged_search(rows, query, limit))


def test_text_is_read_for_like_only(built):
    rows, st = built

    def texts():
        raise AssertionError("a search read texts")

    assert term_index(st).staged_search("quick fox", 5, texts).count() >= 5
    with pytest.raises(AssertionError):
        term_index(st).staged_search("ader", 5, texts)


def test_search_reads_its_terms_buckets(built):
    """The plan prunes folders by bucket and pushes the terms to the scan."""
    plan = term_index(built[1]).of_terms(["fox"], [], 0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "In(term" in plan or "EqualTo(term,fox)" in plan
    assert "content" not in plan


@pytest.mark.parametrize(("k", "pairs"), [(1, 0), (3, 0), (40, 0), (3, lexical.PAIRS)])
def test_search_many_is_exact(spark, built, k, pairs, monkeypatch):
    """By bounds, and where all postings are scored."""
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    rows, st = built
    rng = random.Random(9)
    asked = [(i, " ".join(rng.choices([*WORDS, "unseen"], k=rng.randrange(1, 7)))) for i in range(25)] + [(90, ""), (91, None), (92, "the"), (93, "the of the of")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    got = {(r.query_id, r["rank"]): (r.id, round(r.bm25, 6)) for r in term_index(st).search_many(queries, k).collect()}
    want = {}
    for i, q in asked:
        phrases = [[t] for t in lexical.fold(q or "")]
        if phrases:
            hits = lexical.bm25(rows, phrases, postings.FIELDS).where(lexical.matches(len(phrases), False))
            best = hits.orderBy(F.round("bm25", 6).desc(), "id").limit(k).collect()
            want |= {(i, n + 1): (r.id, round(r.bm25, 6)) for n, r in enumerate(best)}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1], abs=2e-6) for x in want)


@pytest.mark.parametrize(("k", "pairs"), [(1, 0), (3, 0), (40, 0), (3, lexical.PAIRS)])
def test_search_many_of_very_many_terms_is_exact(spark, built, k, pairs, monkeypatch):
    monkeypatch.setattr(lexical, "ASKED", 0)
    test_search_many_is_exact(spark, built, k, pairs, monkeypatch)


def scored_twice(spark, monkeypatch, ids, copies, k):
    """What is ranked, and the k best of each query, by rows and by the join of all postings."""
    rng = random.Random(7)
    texts = [rng.choices(range(12), k=rng.randrange(1, 9)) for _ in range(240 // copies)]
    held = [(f"t{t}", ids(i), words.count(t), len(words)) for i, words in enumerate(w for w in texts for _ in range(copies)) for t in set(words)]
    held = spark.createDataFrame(held, f"term string, id {'string' if isinstance(ids(0), str) else 'long'}, tf int, dl int").repartition(3)
    wanted = [(q, f"t{t}", 1 + t % 2) for q in [*range(20), None] for t in rng.sample(range(14), 5)]
    wanted = spark.createDataFrame(wanted, "query_id long, term string, times long")
    out, ranked, plain = [], [], lexical.ranked_many
    monkeypatch.setattr(lexical, "ranked_many", lambda scores, k: ranked.append(scores.count()) or plain(scores, k))
    for asked in (lexical.ASKED, 0):
        monkeypatch.setattr(lexical, "ASKED", asked)
        out.append(sorted((-1 if r.query_id is None else r.query_id, r["rank"], r.id, round(r.bm25, 6)) for r in lexical.best_many(held, wanted, 240, 5.0, k).collect()))
    return out, ranked


@pytest.mark.parametrize(("cells", "parts", "copies"), [(1 << 19, 1 << 21, 1), (1, 16, 1), (50, 1 << 21, 60), (1 << 19, 40, 4)])
def test_search_many_by_rows_is_that_by_the_join(spark, monkeypatch, cells, parts, copies):
    """Pieces that end anywhere, ids of either type, and copies, of which the id decides."""
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "PARTS", parts)
    for ids in (lambda i: i * 7919 % 1000 - 300, lambda i: f"d{i * 7919 % 1000}"):
        with monkeypatch.context() as m:
            (by_rows, by_join), _ = scored_twice(spark, m, ids, copies, 5)
            assert by_rows == by_join and len(by_rows) == 21 * 5


def test_scores_that_cannot_be_among_the_best_stay_in_their_task(spark, monkeypatch):
    """A row for every query and row that share a term went through a shuffle."""
    _, (by_rows, by_join) = scored_twice(spark, monkeypatch, lambda i: i, 1, 3)
    assert by_rows <= 4 * 21 * 3 < by_join


def test_index_follows_changes_and_merges(spark, tmp_path):
    """Insert, change and delete in many small steps; after each the index is what a rebuild makes of the rows."""
    st = store.Store(spark, str(tmp_path / "s"))
    rows, rng, counts = {r[0]: r for r in some_rows(60)}, random.Random(4), []
    for step in range(6):
        if step:
            for i in rng.sample(sorted(rows), 4):
                rows[i] = (i, rows[i][1], rng.choice(WORDS) + " changed", None)
            for i in rng.sample(sorted(rows), 2):
                del rows[i]
            rows |= {f"s{step}": (f"s{step}", "fox", f"new the fox {step}", "")}
        df = put(spark, st, list(rows.values()))
        index = term_index(st)
        v = index.verify(df).first()
        assert v.postings > 0 and v.missing == v.extra == 0
        n, mean, _ = index.totals()
        assert n == len(rows) and mean > 1
        counts.append(index.stats.count())
    assert max(counts) <= 3  # small segments went into one
    assert listed(index.staged_search("changed the", 7)) == listed(lexical.staged_search(df, "changed the", 7))
    assert term_segment(st, df) == ({}, ())  # nothing changed, nothing is written


def test_merge_policy():
    assert postings.to_merge({1: 1000, 2: 10, 3: 5}) == [3, 2] and postings.to_merge({1: 1000, 2: 10}) == [] and postings.to_merge({1: 8, 2: 5, 3: 5}) == [3, 2, 1]
    assert postings.to_merge({}) == [] and postings.to_merge({1: 5}) == []


def test_two_writers(spark, tmp_path):
    """One of two writers that began with the same version gets a Conflict; the other's version stays."""
    a, b = (store.Store(spark, str(tmp_path / "s")) for _ in range(2))
    one = lambda v: spark.createDataFrame([(v,)], "id long")
    a.commit({"t": one(1)})
    b.version = lambda: 0 if not hasattr(b, "again") else store.Store.version(b)  # it began before a's commit
    with pytest.raises(store.Conflict):
        b.commit({"t": one(2)})
    assert a.version() == 1 and a.read("t", "id long").first().id == 1
    b.again = True
    assert b.commit({"u": one(3)}) == 2 and a.read("t", "id long").first().id == 1 and a.get("u", "id long", [3, 4]).count() == 1
    a.commit({"w": one(5)}, drop=("u",))
    assert a.read("u", "id long").count() == 0 and b.read("t", "id long").count() == 1


def test_failed_commit_leaves_nothing(spark, tmp_path):
    st = store.Store(spark, str(tmp_path / "s"))
    st.commit({"t": spark.range(1)})
    with pytest.raises(Exception):
        st.commit({"t": spark.range(1).select(F.raise_error(F.lit("no")).alias("id"))})
    assert st.version() == 1 and len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("v2")]) == 0


def test_batched_summaries_keep_one_row_per_id(spark):
    """A reply that names ids of other batches, repeats them or can't be read multiplies and loses nothing; children are shown."""
    from fathom import models

    rows = spark.createDataFrame([(str(i), f"code {i}", None, None, f"N{i}", [f"kid{i}: does {i}"] if i == 3 else []) for i in range(7)], "id string, content string, docstring string, signature string, name string, lines array<string>").coalesce(1)

    def complete(prompt):
        assert ("Context:\nkid3: does 3" in prompt) == ("3:\ncode 3" in prompt)
        yield '{"0": "zero", "5": {"summary": "five"}, "9": "none"}' if "5:\ncode 5" in prompt or "0:\ncode 0" in prompt else "no json"

    got = sorted((r.id, r.summary) for r in models.batched_summaries(complete, "{snippets}", 3)(rows).collect())
    assert [i for i, _ in got] == [str(i) for i in range(7)]
    assert dict(got)["0"] == "zero" and dict(got)["5"] == "five" and dict(got)["3"] == "N3 [kid3]" and dict(got)["6"] == "N6"


def test_a_term_of_a_row_moves_once():
    """Postings are made where texts are read: what is shuffled has one row per term of a row's field, not one per token."""
    import pyarrow as pa

    text = ["b", "a", "b", "b", "c"]
    batch = pa.RecordBatch.from_pydict({"id": [7, 8, 9], "_name": ["N", None, ""], "_t0": [["n"], [], []], "_t1": [text, ["a"], []]}, pa.schema([("id", pa.int64()), ("_name", pa.string()), ("_t0", pa.list_(pa.string())), ("_t1", pa.list_(pa.string()))]))
    got = [tuple(r.values()) for b in postings.grouped(iter([batch]), 2) for r in b.to_pylist()]
    want = [("n", 7, 0, 6, [0]), ("b", 7, 1, 6, [0, 2, 3]), ("a", 7, 1, 6, [1]), ("a", 8, 1, 1, [0]), ("c", 7, 1, 6, [4]), ("N", 7, -1, 6, [0]), ("", 9, -1, 0, [0])]
    assert sorted(got) == sorted(want)
    assert [t for t, *_ in got].index("a") + 1 == len(got) - 1 - [t for t, *_ in got][::-1].index("a")  # a term's rows stand together


def test_a_first_build_moves_no_texts(spark, tmp_path):
    st = store.Store(spark, str(tmp_path / "s"))
    tables, _ = term_segment(st, spark.createDataFrame(some_rows(20), SCHEMA))
    plan = tables["postings_1"]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
