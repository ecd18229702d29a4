"""Table functions for SQL: what a file or a text is made of, by LATERAL.

    register(spark)
    SELECT f.file_path, s.name FROM files f, LATERAL code_snippets(f.file_path, f.language, f.content) s
    SELECT d.doc_id, c.* FROM documents d, LATERAL text_chunks(d.text, 1000) c

A null content has no rows; a language without a parser has none either. The schema is the functions' own
(``analyze``), which also rejects arguments of other types when the query is analysed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from fathom.schema import SNIPPETS


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "map<string,string>": T.MapType(T.StringType(), T.StringType())}


def _struct(spec: str) -> T.StructType:
    """The schema of a table's columns; without a session, which the workers that analyse haven't."""
    return T.StructType([T.StructField(*(f(x) for f, x in zip((str, _TYPES.get), c.split(" ", 1)))) for c in spec.split(", ")])


ROW, CHUNK = _struct(SNIPPETS), _struct("chunk_index int, start long, chunk string")


def _expect(name: str, given: AnalyzeArgument, kinds: tuple) -> None:
    if not isinstance(given.dataType, (*kinds, T.NullType)):
        raise ValueError(f"{name} can't be of type {given.dataType.simpleString()}")


@udtf
class CodeSnippets:
    """code_snippets(path, language, content[, chunk_size]): the rows of the snippet table that a file gives."""

    @staticmethod
    def analyze(path: AnalyzeArgument, language: AnalyzeArgument, content: AnalyzeArgument, chunk_size: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name, given in (("path", path), ("language", language), ("content", content)):
            _expect(name, given, (T.StringType,))
        if chunk_size is not None:
            _expect("chunk_size", chunk_size, (T.IntegerType, T.LongType))
        return AnalyzeResult(ROW)

    def eval(self, path: str, language: str, content: str, chunk_size: int = 1000) -> Iterator[tuple]:
        from fathom.parsing import outline
        from fathom.sources.codebase import parsers

        parser = parsers().get(language)
        if parser is None or content is None or path is None:
            return
        for row in outline.snippets(content, path, parser(content), chunk_size):
            yield tuple(row[n] for n in ROW.names)


@udtf
class TextChunks:
    """text_chunks(text, size): chunk_index, start (characters) and chunk, cut at lines."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        _expect("text", text, (T.StringType,))
        _expect("size", size, (T.IntegerType, T.LongType))
        if size.isConstantExpression and (size.value is None or size.value < 1):
            raise ValueError("size must be at least 1")
        return AnalyzeResult(CHUNK)

    def eval(self, text: str, size: int) -> Iterator[tuple]:
        from fathom.parsing import outline

        at = 0
        for i, chunk in enumerate(outline.chunks(text, size) if text else []):
            yield i, at, chunk
            at += len(chunk)


def register(spark: SparkSession) -> None:
    spark.udtf.register("code_snippets", CodeSnippets)
    spark.udtf.register("text_chunks", TextChunks)
