"""Schemas and value sets of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

SNIPPET_TYPES = ("function", "class", "method", "struct", "enum", "module", "file", "placeholder")
RELATION_TYPES = ("defines", "calls", "imports", "inherits", "overrides", "returns", "decorated_by", "modifies", "instantiates")
#: Types whose names calls and bases may resolve to.
SYMBOL_TYPES = ("function", "class", "struct", "enum")


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


FILES = "file_path string, language string, content string, content_hash string"
SNIPPETS = (
    "id string, name string, type string, content string, summary string, parent_id string, docstring string, signature string, "
    "file_path string, start_line int, end_line int, start_byte int, end_byte int, is_skeleton boolean, chunk_index int, "
    "parent_signature string, parent_summary string, metadata map<string,string>"
)
EDGES = "source_id string, target_id string, type string, file_path string, resolved boolean"
NODES = "id string, name string, type string, file_path string"
VECTORS = "id string, embedding array<float>, document string, name string, type string, file_path string, start_line int, end_line int, is_skeleton boolean"
ERRORS = "file_path string, error string"
MANIFEST = "file_path string, content_hash string"
CAPTURES = "file_path string, tag string, text string, start int, end int, parent_tag string, parent_start int, parent_end int, owner_start int, owner_end int"
