"""The stored vector index: recall against brute force, pruning, growth, odd rows."""

import numpy as np
import pytest

from fathom.operators import vector
from fathom.operators import vector_index as vi


def frame(spark, x, key="id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{key} long, embedding array<float>")


@pytest.fixture(scope="module")
def points():
    rng = np.random.RandomState(2)
    centers = rng.normal(size=(12, 20))
    x = centers[rng.randint(12, size=900)] + 0.6 * rng.normal(size=(900, 20))
    x[::3] = centers[0]  # a third of all rows are copies
    x[5] = 0
    x[7] = x[8]
    return x.astype(np.float32)


@pytest.fixture(scope="module")
def index(spark, points, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("vectors"))
    vi.build(frame(spark, points), root)
    return vi.opened(spark, root, frame(spark, points))


def brute(points, q, k):
    d = np.round(1 - vi.unit(points.astype(np.float64)) @ vi.unit(q.astype(np.float64)[None])[0], 6)
    return [(int(i), float(d[i])) for i in sorted(range(len(d)), key=lambda i: (d[i], i))[:k]]


def test_exact_many_is_brute_force(spark, points, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK", 200)
    monkeypatch.setattr(vi, "QUERY_BLOCK", 3)
    got = vi.exact_many(frame(spark, points), frame(spark, points[:10], "query_id"), 5).collect()
    for q in range(10):
        mine = sorted((r["rank"], r.distance) for r in got if r.query_id == q)
        assert [d for _, d in mine] == pytest.approx([d for _, d in brute(points, points[q], 5)], abs=2e-6)


def test_recall_and_every_vector_is_filed(spark, points, index, monkeypatch):
    assert index.codes.select("id").distinct().count() == len(points) == index.codes.count()
    asked = frame(spark, points[::20], "query_id")
    monkeypatch.setattr(vi, "BLOCK", 100)
    found = index.search_many(asked, 10).cache()
    r = vi.recall(found, vi.exact_many(frame(spark, points), asked, 10), 10).first()
    assert r.queries == 45 and r.recall >= 0.95
    assert found.groupBy("query_id").count().where("count <> 10").count() == 0


def test_one_search_reads_the_probed_cells(spark, points, index):
    got = [(r.id, r.distance) for r in index.search(points[31].tolist(), 5).orderBy("rank").collect()]
    assert got[0] == (31, 0.0) and len({i for i, _ in got} & {i for i, _ in brute(points, points[31], 5)}) >= 4
    few = vi.VectorIndex(index.model, index.codes, index.vectors, probes=2)
    plan = few.codes.where("cell IN (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and few.search(points[31].tolist(), 1).first().id == 31


def test_fit_is_repeatable_and_new_vectors_need_no_fit(spark, points, index):
    again = vi.fit(frame(spark, points))
    assert np.array_equal(again.cells, index.model.cells) and all(np.array_equal(a, b) for a, b in zip(again.books, index.model.books))
    more = np.concatenate([points, points[:5] + 0.001])
    grown = vi.VectorIndex(index.model, vi.codes_of(frame(spark, more), index.model), frame(spark, more))
    assert {r.id for r in grown.search(points[1].tolist(), 2).collect()} == {1, 901}


def test_depths_are_measured_on_different_vectors(points):
    x, rng = vi.unit(points), np.random.RandomState(3)
    cells = vi.clusters(x, 30, rng)
    books = [vi.clusters(np.ascontiguousarray(p), 64, rng) for p in np.array_split(x - cells[vi.nearest(x, cells)[:, 0]], 5, axis=1)]
    model = vi.Model(cells, books)
    # every third row is the same vector, and a stride of three meets no other
    assert vi.measured(model, x)[0] > 1 and vi.measured(model, x[::3])[0] == 1


def test_odd_rows(spark, index, points):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [1.0]), (4, [0.0] * 20), (5, [1.0] * 20), (5, [1.0] * 20)], "id long, embedding array<float>")
    assert sorted(r.id for r in vi.codes_of(rows, index.model).collect()) == [4, 5, 5]
    asked = rows.withColumnRenamed("id", "query_id").where("query_id < 4")
    assert index.search_many(asked, 3).count() == 0
    assert [r.distance for r in index.search([0.0] * 20, 2).collect()] == [1.0, 1.0]
    with pytest.raises(ValueError):
        vi.fit(rows.limit(0))
    assert vector.top_k(frame(spark, points), [1.0] * 20, 1).count() == 1
