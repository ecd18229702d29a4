"""Vector search: cosine distance, exact top-k, approximate candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Summed in double, from the first element on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: F.try_divide(x.cast("double"), n))).otherwise(F.transform(a, lambda x: x.cast("double")))


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def dot_with(a: Column, query: list[float]) -> Column:
    """A product with a known vector, written out so that code generation takes it."""
    return reduce(lambda s, x: s + x, [F.element_at(a, i + 1).cast("double") * F.lit(float(q)) for i, q in enumerate(query)], F.lit(0.0))


def cosine_distance(a: Column, query: list[float]) -> Column:
    """One for a zero vector on either side."""
    length = sum(float(q) ** 2 for q in query) ** 0.5
    return F.lit(1.0) - F.coalesce(F.try_divide(dot_with(a, query), norm(a) * F.lit(length)), F.lit(0.0))


def top_k(vectors: DataFrame, query: list[float], k: int, column: str = "embedding") -> DataFrame:
    """id, distance, rank of the k nearest; the scan keeps k rows per task."""
    near = vectors.where(F.size(column) == len(query)).select("id", (F.round(cosine_distance(F.col(column), query), 6) + F.lit(0.0)).alias("distance"))
    best = near.orderBy("distance", "id").limit(k)
    return best.select("id", "distance", F.row_number().over(Window.orderBy("distance", "id")).cast("long").alias("rank"))


def approximate_top_k(vectors: DataFrame, query: list[float], k: int, column: str = "embedding", tables: int = 8, width: float = 0.5, seed: int = 11) -> DataFrame:
    """Candidates by random projections, ranked by exact distance."""
    from pyspark.ml.linalg import Vectors

    rows = vectors.select("id", F.col(column).alias("_v"), array_to_vector(F.transform(column, lambda x: x.cast("double"))).alias("_features"))
    model = BucketedRandomProjectionLSH(inputCol="_features", outputCol="_hashes", bucketLength=width, numHashTables=tables, seed=seed).fit(rows)
    found = model.approxNearestNeighbors(rows, Vectors.dense([float(q) for q in query]), k, distCol="_d")
    near = found.select("id", F.round(cosine_distance(F.col("_v"), query), 6).alias("distance"))
    return near.select("*", F.row_number().over(Window.orderBy("distance", "id")).cast("long").alias("rank"))
