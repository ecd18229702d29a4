"""The stored approximate vector index: coarse cells, product-quantised residuals, exact rerank.

It's fitted once, on a sample of at most ``SAMPLE`` vectors, on which it also measures how many cells
a search must probe for its recall (vectors without clusters need many). Every vector is filed: under the cell of its
nearest centroid, as one byte per group of dimensions that tells what its residual is near to. Codes lie in
folders by cell. A search scores the codes of the cells nearest to its query by table lookups,
and ranks the best ``rerank`` of them by the exact cosine distance of their vectors. For many queries, queries meet
the codes in blocks of a bounded size, each of which gives its best only; a cell that holds a third
of all vectors is so many blocks.

Vectors are compared at length one; zero vectors stay zero (distance 1). Rows whose vector is null or
of another length than the model's aren't filed. Equal distances go by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.operators.store import checkpointed
from fathom.operators.vector import dot, norm

#: The most vectors that a fit looks at (float32: 16 MB at 64 dimensions), cells, and dimensions per byte of code.
SAMPLE, MAX_CELLS, GROUP = 65_536, 4096, 4
#: Vectors and queries per block.
BLOCK, QUERY_BLOCK = 32_768, 512
ROUNDS = 12
#: A fit measures on so many of its sample's vectors how many cells and codes a search needs: for this share of the nearest ten each.
ASKED, NEAREST, TARGET = 256, 10, 0.985
CELLS = "cell int, center array<float>"
DEPTHS = "probes int, rerank int"
BOOKS = "part int, code int, center array<float>"


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of float32."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(whole), -1)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def nearest(x: np.ndarray, centers: np.ndarray, k: int = 1) -> np.ndarray:
    """The k nearest centers of each row, nearest first; some rows at a time."""
    out = np.empty((len(x), k), np.int32)
    half = (centers**2).sum(1) / 2
    step = max(1, (1 << 22) // len(centers))
    for i in range(0, len(x), step):
        far = half - x[i : i + step] @ centers.T
        if k == 1:
            out[i : i + step, 0] = far.argmin(1)
        else:
            some = np.argpartition(far, k - 1, axis=1)[:, :k] if k < len(centers) else np.tile(np.arange(k), (len(far), 1))
            out[i : i + step] = np.take_along_axis(some, np.take_along_axis(far, some, 1).argsort(1, kind="stable"), 1)
    return out


def clusters(x: np.ndarray, k: int, rng: np.random.RandomState) -> np.ndarray:
    """Lloyd's rounds; a center that loses all rows takes the row that lies worst."""
    centers = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centers)[:, 0]
        count = np.bincount(own, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, own, x)
        centers = total / np.maximum(count, 1)[:, None]
        empty = np.flatnonzero(count == 0)
        if len(empty):
            worst = ((x - centers[own]) ** 2).sum(1).argsort(kind="stable")[::-1]
            centers[empty] = x[worst[: len(empty)]]
    return centers.astype(np.float32)


@dataclass
class Model:
    """Centroids of the cells, and for each group of dimensions the centers of its residuals."""

    cells: np.ndarray
    books: list[np.ndarray]
    probes: int = 8
    rerank: int = 100

    @property
    def dim(self) -> int:
        return self.cells.shape[1]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        at = np.cumsum([b.shape[1] for b in self.books])[:-1]
        return np.split(x, at, axis=1)

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of rows at length one."""
        cell = nearest(x, self.cells)[:, 0]
        codes = [nearest(np.ascontiguousarray(p), b)[:, 0] for p, b in zip(self.parts(x - self.cells[cell]), self.books)]
        return cell, np.stack(codes, 1).astype(np.uint8)

    def scores(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """About the cosine of each query with each code of a cell, by lookups: the centroid's part and one per group."""
        out = np.repeat((queries @ self.cells[cell])[:, None], len(codes), 1)
        for i, (q, book) in enumerate(zip(self.parts(queries), self.books)):
            out += (q @ book.T)[:, codes[:, i]]
        return out


def measured(model: Model, x: np.ndarray) -> tuple[int, int]:
    """How many cells to probe and codes to rank again, so that either loses few of the nearest neighbours within the sample x."""
    # different vectors, dealt by chance: every nth row may be a copy of one, and copies need only the cell they're in
    some = np.unique(x, axis=0)
    asked = some[np.random.RandomState(len(some)).permutation(len(some))[:ASKED]]
    k = min(NEAREST, len(x))
    close = asked @ x.T
    true = np.argpartition(-close, k - 1, axis=1)[:, :k]
    cell, codes = model.encoded(x)
    place = np.empty((len(asked), len(model.cells)), np.int64)
    np.put_along_axis(place, nearest(asked, model.cells, len(model.cells)).astype(np.int64), np.arange(len(model.cells))[None].repeat(len(asked), 0), 1)
    probes = np.quantile(np.take_along_axis(place, cell[true].astype(np.int64), 1), TARGET) + 1
    about = np.empty_like(close)
    for c in np.unique(cell):
        about[:, cell == c] = model.scores(asked, int(c), codes[cell == c])
    least = np.sort(np.take_along_axis(about, true, 1), 1)
    depth = [np.quantile([(row > v).sum() for v in mine], TARGET) for row, mine in zip(about, least)]
    return int(np.ceil(probes)), max(100, int(2 * np.quantile(depth, TARGET)))


def fit(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 3) -> Model:
    """From rows (id, embedding): the number of cells grows with the square root of theirs, up to MAX_CELLS."""
    rows = vectors.where("embedding IS NOT NULL AND size(embedding) > 0")
    n = rows.count()
    if not n:
        raise ValueError("no vectors to fit an index on")
    # a hash of the id decides, so that a rerun takes the same rows; the limit only cuts what chance gives beyond it
    part = rows if n <= sample else rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * 0.95 * sample / n))
    x = matrix(part.select("id", "embedding").orderBy("id").limit(sample).select("embedding").toArrow().column(0))
    x, rng = unit(x), np.random.RandomState(seed)
    centers = clusters(x, cells or max(1, min(MAX_CELLS, round(n**0.5))), rng)
    rest = x - centers[nearest(x, centers)[:, 0]]
    books = [clusters(np.ascontiguousarray(p), 256, rng) for p in np.array_split(rest, max(1, x.shape[1] // GROUP), axis=1)]
    model = Model(centers, books)
    model.probes, model.rerank = measured(model, x)
    return model


def model_tables(spark: SparkSession, model: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    cells = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.cells)], CELLS)
    books = spark.createDataFrame([(p, i, c.tolist()) for p, b in enumerate(model.books) for i, c in enumerate(b)], BOOKS)
    return cells, books, spark.createDataFrame([(model.probes, model.rerank)], DEPTHS)


def model_of(cells: DataFrame, books: DataFrame, depths: DataFrame) -> Model:
    """A stored model: its size is that of MAX_CELLS centroids at most."""
    centers = np.array([r["center"] for r in cells.orderBy("cell").collect()], np.float32)
    found: dict[int, list] = {}
    for r in books.orderBy("part", "code").collect():
        found.setdefault(r["part"], []).append(r["center"])
    return Model(centers, [np.array(found[p], np.float32) for p in sorted(found)], *depths.first())


def codes_of(vectors: DataFrame, model: Model) -> DataFrame:
    """cell, id, code of every vector, a block's worth of a cell to a task."""
    id_type = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, codes = model.encoded(unit(matrix(batch.column("embedding"))))
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary())], ["cell", "id", "code"])

    rows = vectors.where(F.size("embedding") == model.dim).select("id", "embedding")
    return rows.mapInArrow(run, f"cell int, id {id_type}, code binary").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8)))


def _split(n: Column, size: int) -> Column:
    return F.greatest(F.ceil(n / F.lit(size)), F.lit(1)).cast("int")


def _in_blocks(left: DataFrame, queries: DataFrame, solve, schema: str) -> DataFrame:
    """Rows and queries that share a key, in blocks of some of either: each row is in the blocks of its part, each query in those of its own."""
    n = left.groupBy("key").agg(_split(F.count(F.lit(1)), BLOCK).alias("parts"))
    m = queries.groupBy("key").agg(_split(F.count(F.lit(1)), QUERY_BLOCK).alias("query_parts"))
    shape = checkpointed(n.join(m, "key"))
    own = lambda name, parts: F.pmod(F.xxhash64(name, F.lit(1)), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    rows = left.join(shape, "key").withColumn("part", own("id", "parts")).withColumn("query_part", every("query_parts")).drop("parts", "query_parts")
    shape = shape.select(F.col("key").alias("key"), F.col("parts").alias("parts"), F.col("query_parts").alias("query_parts"))
    asked = queries.join(shape, "key").withColumn("query_part", own("query_id", "query_parts")).withColumn("part", every("parts")).drop("parts", "query_parts")
    by = ["key", "part", "query_part"]

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            return solve(left, right)
        return pa.table({"query_id": right.column("query_id").slice(0, 0), "id": left.column("id").slice(0, 0), "score": pa.array([], pa.float64())})

    return rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(block, schema)


def _best(scores: np.ndarray, ids: pa.Array, asked: pa.Array, k: int) -> pa.Table:
    """The k highest of each row of scores, as query_id, id, score."""
    k = min(k, scores.shape[1])
    at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    row = np.repeat(np.arange(len(scores)), k)
    return pa.table({"query_id": asked.take(pa.array(row)), "id": ids.take(pa.array(at.ravel())), "score": pa.array(np.take_along_axis(scores, at, 1).ravel().astype(np.float64))})


def _types(vectors: DataFrame, queries: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}"


def exact_distances(pairs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, distance, rank: the k nearest of each query's pairs (query_id, id)."""
    rows = pairs.join(vectors.select("id", F.col("embedding").alias("_a")), "id").join(queries.select("query_id", F.col("embedding").alias("_b")), "query_id")
    cosine = F.coalesce(F.try_divide(dot(F.col("_a"), F.col("_b")), norm(F.col("_a")) * norm(F.col("_b"))), F.lit(0.0))
    near = rows.select("query_id", "id", (F.round(1 - cosine, 6) + F.lit(0.0)).alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def exact_many(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of all vectors for every query (query_id, embedding), by comparing each with each in blocks: what recall is measured against."""

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best(unit(matrix(right.column("asked"))) @ unit(matrix(left.column("embedding"))).T, left.column("id").combine_chunks(), right.column("query_id").combine_chunks(), 2 * k)

    # both may come from one table: the queries' columns get names of their own
    rows = vectors.where("size(embedding) > 0").select("id", "embedding", F.size("embedding").alias("key"))
    asked = queries.where("size(embedding) > 0").select("query_id", F.col("embedding").alias("asked"), F.size("embedding").alias("key"))
    # twice k by float32, then the order by double and id
    found = _in_blocks(rows, asked, solve, _types(vectors, queries) + ", score double")
    return exact_distances(_top(found, 2 * k), vectors, queries, k)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select("query_id", "id")


@dataclass
class VectorIndex:
    """A fitted model, the stored codes (cell, id, code), and the vectors (id, embedding) they're of. Probes and rerank are the model's unless they're given."""

    model: Model
    codes: DataFrame
    vectors: DataFrame
    probes: int = 0
    rerank: int = 0

    def _probes(self) -> int:
        return min(len(self.model.cells), self.probes or self.model.probes)

    def _depth(self, k: int) -> int:
        return max(self.rerank or self.model.rerank, k)

    def search(self, query: list[float], k: int) -> DataFrame:
        """id, distance, rank of about the k nearest; only the probed cells' folders are read."""
        model, q = self.model, unit(np.array([query], np.float32))
        cells = nearest(q, model.cells, self._probes())[0].tolist()
        depth = self._depth(k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                at = batch.column("cell").to_numpy()
                score = np.empty(len(codes), np.float64)
                for c in np.unique(at):
                    score[at == c] = model.scores(q, int(c), codes[at == c])[0]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], ["id", "score"])

        id_type = self.vectors.schema["id"].dataType.simpleString()
        some = self.codes.where(F.col("cell").isin(cells)).select("cell", "id", "code").mapInArrow(run, f"id {id_type}, score double")
        best = some.orderBy(F.desc("score"), "id").limit(depth).select("id")
        asked = self.vectors.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id int, embedding array<double>")
        pairs = best.withColumn("query_id", F.lit(0))
        return exact_distances(pairs, self.vectors.join(F.broadcast(best), "id", "left_semi"), asked, k).select("id", "distance", "rank")

    def search_many(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, id, distance, rank for every query (query_id, embedding)."""
        model, probes, depth = self.model, self._probes(), self._depth(k)
        types = _types(self.vectors, queries)

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cells = nearest(unit(matrix(batch.column("embedding"))), model.cells, probes)
                    row = pa.array(np.repeat(np.arange(batch.num_rows), probes))
                    yield pa.RecordBatch.from_arrays([batch.column("query_id").take(row), batch.column("embedding").take(row), pa.array(cells.ravel())], ["query_id", "asked", "key"])

        def solve(left: pa.Table, right: pa.Table) -> pa.Table:
            codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(left.num_rows, -1)
            scores = model.scores(unit(matrix(right.column("asked"))), left.column("key")[0].as_py(), codes)
            return _best(scores, left.column("id").combine_chunks(), right.column("query_id").combine_chunks(), depth)

        asked = queries.where(F.size("embedding") == model.dim).select("query_id", "embedding")
        met = asked.mapInArrow(probed, f"{types.split(', ')[0]}, asked {queries.schema['embedding'].dataType.simpleString()}, key int")
        found = _in_blocks(self.codes.select(F.col("cell").alias("key"), "id", "code"), met, solve, types + ", score double")
        return exact_distances(_top(found, depth), self.vectors, queries, k)


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """One row: queries, and the share of the k places whose distance is no greater than that of the exact list's last (ties count)."""
    last = exact.groupBy("query_id").agg(F.max("distance").alias("_far"), F.count(F.lit(1)).alias("_n"))
    hit = found.join(last, "query_id").groupBy("query_id").agg(F.count_if(F.col("distance") <= F.col("_far") + 1e-6).alias("_hits"))
    both = last.join(hit, "query_id", "left")
    return both.agg(F.count(F.lit(1)).alias("queries"), (F.sum(F.least(F.coalesce("_hits", F.lit(0)), F.col("_n"))) / F.sum("_n")).alias("recall"))


def build(vectors: DataFrame, root: str, cells: int | None = None) -> None:
    """Fits and writes an index below a folder; a rerun writes the same."""
    model = fit(vectors, cells)
    for name, df in zip(("cells", "books", "depths"), model_tables(vectors.sparkSession, model)):
        df.coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}")
    codes_of(vectors, model).write.mode("overwrite").partitionBy("cell").parquet(f"{root}/codes")


def opened(spark: SparkSession, root: str, vectors: DataFrame, **options) -> VectorIndex:
    """The index of a folder; nothing is fitted again."""
    model = model_of(spark.read.schema(CELLS).parquet(f"{root}/cells"), spark.read.schema(BOOKS).parquet(f"{root}/books"), spark.read.schema(DEPTHS).parquet(f"{root}/depths"))
    id_type = vectors.schema["id"].dataType.simpleString()
    return VectorIndex(model, spark.read.schema(f"id {id_type}, code binary, cell int").parquet(f"{root}/codes"), vectors, **options)
