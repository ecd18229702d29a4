"""A source tree as a DataFrame: data source ``codebase``, and its parse.

Spark's file sources leave out names that start with ``_`` or ``.``, so
``__init__.py`` needs a source of its own. The driver lists, the tasks read.
"""

from __future__ import annotations

import hashlib
import logging
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fathom.schema import FILES, SNIPPETS

# What a scan leaves out, and the languages by extension.
IGNORED_DIRS = (".git", "__pycache__", "node_modules", ".venv", "venv")
IGNORED_EXTENSIONS = (".pyc", ".pyo", ".so", ".dll", ".exe", ".bin")
LANGUAGES = {"py": "python", "c": "c", "h": "c"}
FILES_PER_TASK = 64
#: Files whose rows a task holds at once, however many a batch has.
FILES_AT_ONCE = 64


def language_of(path: str) -> str | None:
    name = os.path.basename(path)
    return LANGUAGES.get(name.rsplit(".", 1)[1].lower()) if "." in name else None


def listed(root: str, recursive: bool = True, ignore_dirs: tuple = (), ignore_extensions: tuple = ()) -> list[str]:
    """Files of known languages, in path order."""
    skip, bad = {*IGNORED_DIRS, *ignore_dirs}, (*IGNORED_EXTENSIONS, *ignore_extensions)
    found = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in skip) if recursive else []
        found += [os.path.join(folder, n) for n in names if not n.endswith(bad) and language_of(n)]
    return sorted(found)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Files]:
        o = self.options
        split = lambda name: tuple(x for x in o.get(name, "").split(",") if x)
        paths = listed(o["path"], o.get("recursive", "true").lower() == "true", split("ignoreDirs"), split("ignoreExtensions"))
        n = int(o.get("filesPerTask", FILES_PER_TASK))
        return [_Files(paths[i : i + n]) for i in range(0, len(paths), n)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with open(path, "rb") as f:
                    text = f.read().decode("utf-8", "ignore")
            except OSError as e:
                logging.getLogger(__name__).warning("can't read %s: %s", path, e)
                yield path, language_of(path), None, None  # so that it isn't taken for a deleted one
                continue
            yield path, language_of(path), text, hashlib.sha256(text.encode("utf-8")).hexdigest()


class CodebaseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "codebase"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_codebase(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(CodebaseSource)
    return spark.read.format("codebase").options(**options).load(path)


def parsers() -> dict:
    """Language -> parser; add to it to support another."""
    from fathom.parsing import c_source, python_source

    return {"python": python_source.parse, "c": c_source.parse}


def parse(files: DataFrame, chunk_size: int = 1000, registry: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Snippets, and captures for the edges, of a files table."""
    both = parsed(files, chunk_size, registry)
    return both.selectExpr("inline(snippets)"), both.selectExpr("inline(captures)")


def parsed(files: DataFrame, chunk_size: int = 1000, registry: dict | None = None) -> DataFrame:
    """file_path, its snippets and captures as arrays, and the parser's error."""
    registry = registry or parsers()
    spec = f"snippets array<struct<{_nested(SNIPPETS)}>>, captures array<struct<{_nested(CAPTURE_ROW)}>>, file_path string, error string"
    schema = to_arrow_schema(T._parse_datatype_string(spec))
    return files.select("file_path", "language", "content").mapInArrow(lambda batches: outlined(batches, registry, chunk_size, schema), spec)


def outlined(batches: Iterator[pa.RecordBatch], registry: dict, chunk_size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of some files at a time, so that a task's memory doesn't depend on how many a batch has."""
    from fathom.parsing import outline

    for batch in batches:
        for at in range(0, batch.num_rows, FILES_AT_ONCE):
            part, rows = batch.slice(at, FILES_AT_ONCE).to_pydict(), []
            for path, lang, code in zip(part["file_path"], part["language"], part["content"]):
                found = registry[lang](code or "") if lang in registry else outline.Outline([], [])
                own = [row | {"metadata": list(row["metadata"].items())} for row in outline.snippets(code or "", path, found, chunk_size)]
                rows.append((own, outline.captures(path, found), path, found.error))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)


CAPTURE_ROW = "file_path string, tag string, text string, start int, end int, owner_start int, owner_end int"


def _nested(spec: str) -> str:
    return ", ".join(f"{a}: {b}" for a, b in (x.split(" ", 1) for x in spec.split(", ")))
