"""What users call: index, search, search_many, answer, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.models import Models
from fathom.operators.store import Store
from fathom.plans import index as _index
from fathom.plans import search as _search
from fathom.schema import SNIPPETS


class Engine:
    """An index in a folder."""

    def __init__(self, spark: SparkSession, root: str, models: Models | None = None):
        self.store, self.models = Store(spark, root), models or Models()

    def index(self, path: str, recursive: bool = True, chunk_size: int = 1000, summaries: bool = True) -> DataFrame:
        return _index.index_directory(self.store.spark, path, self.store.root, self.models, recursive, chunk_size=chunk_size, summaries=summaries)

    def search(self, query: str, n_results: int = 5, reranked: bool = True) -> DataFrame:
        return _search.search(self.store, query, n_results, self.models, reranked)

    def search_many(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, query) -> the best k snippets of each by keywords, from the stored postings."""
        return _index.term_index(self.store).search_many(queries, k)

    def get(self, *ids: str) -> DataFrame:
        """The snippets of some ids."""
        return self.store.get("snippets", SNIPPETS, ids)

    def answer(self, query: str, n_results: int = 5) -> str:
        return _search.answer(self.search(query, n_results), query, self.models)

    def stream(self, query: str, n_results: int = 10):
        return _search.events(self.search(query, n_results), query, self.models)

    def status(self) -> DataFrame:
        return _index.status(self.store)

    def verify(self) -> DataFrame:
        return _index.verify(self.store)
