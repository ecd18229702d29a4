"""Queries of the parsers, chunks and edges, over code files that Spark derives from ``documents``.

Each document gives a Python and a C file whose definitions stand at places that SQL can
state: names carry the id, a comment of the text's own characters comes first (bytes and characters
differ), bodies are as long as ``n_chars`` says, and classes, calls and bases point to the next and
the former document's file. The pieces are SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import graph
from fathom.operators.store import checkpointed
from fathom.parsing.outline import HIDDEN
from fathom.plans.catalogue import query, read

NL = "chr(10)"
NOTE = "replace(replace(substr(text, 1, 24), chr(10), ' '), chr(13), ' ')"
#: Pieces of a Python file, in order.
PY = {
    "head": f"'# ' || {NOTE} || {NL} || 'import os' || {NL} || 'from lib' || doc_id % 3 || ' import base' || {NL} || {NL} || 'LIMIT = 3' || {NL} || {NL}",
    "cls": f"'class K' || doc_id || '(K' || (doc_id - 1) || '):' || {NL} || '    \"\"\"About ' || lang || '.\"\"\"' || {NL}",
    "pad": "'    '",
    "run": f"'def run(self, n):' || {NL} || '        self.n = n' || {NL} || '        return helper' || doc_id || '(n)'",
    "gap": f"{NL} || {NL} || '# helper' || {NL} || '@deco' || {NL}",
    "help": f"'def helper' || doc_id || '(x) -> int:' || {NL} || '    y = K' || (doc_id + 1) || '()' || {NL} || '    return y'",
    "sep": f"{NL} || {NL}",
    "long": f"'def long' || doc_id || '(a):' || {NL} || repeat('    a = a + 1' || {NL}, CAST(n_chars % 120 AS INT)) || '    return a'",
    "last": NL,
}
#: Pieces of a C file.
C = {
    "head": f"'// ' || {NOTE} || {NL} || '#include <stdio.h>' || {NL} || '#include \"lib' || doc_id % 3 || '.h\"' || {NL} || {NL} || '/* node ' || doc_id || ' */' || {NL}",
    "node": f"'struct N' || doc_id || ' {{' || {NL} || '    int value;' || {NL} || '}}'".replace("{{", "{").replace("}}", "}"),
    "sep": f"';' || {NL} || {NL}",
    "kind": "'enum E' || doc_id || ' { A, B }'",
    "sep2": f"';' || {NL} || {NL}",
    "push": f"'int push' || doc_id || '(struct N' || doc_id || ' *n, int v) {{' || {NL} || '    n->value = v;' || {NL} || repeat('    v = v + 1;' || {NL}, CAST(n_chars % 40 AS INT)) || '    push' || (doc_id + 1) || '(v);' || {NL} || '    return v;' || {NL} || '}}'".replace("{{", "{").replace("}}", "}"),
    "last": NL,
}


def whole(pieces: dict[str, str]) -> str:
    return " || ".join(pieces.values())


def code_files(spark, d, extension: str):
    """file_path, language, content: one file per document."""
    pieces, language = (PY, "python") if extension == "py" else (C, "c")
    return read(spark, d, "documents").selectExpr(f"'d' || doc_id || '.{extension}' AS file_path", f"'{language}' AS language", f"{whole(pieces)} AS content")


def _pieces_sql(pieces: dict[str, str], extension: str) -> str:
    """f: a row per file with its pieces, and where each begins, in bytes (b_) and lines (l_)."""
    out = f"p AS (SELECT doc_id, n_chars, lang, 'd' || doc_id || '.{extension}' AS path, {', '.join(f'{v} AS {k}' for k, v in pieces.items())} FROM documents), f AS (SELECT *, {' || '.join(pieces)} AS code, sha256('file:' || path) AS fid"
    before: list[str] = []
    for k in pieces:
        text = " || ".join(before) or "''"
        out += f", strlen({text}) AS b_{k}, length({text}) - length(replace({text}, chr(10), '')) AS l_{k}"
        before.append(k)
    return out + " FROM p)"


def _row(name: str, kind: str, content: str, start: str, size: str, line: str, full: str, parent: str, signature: str, docstring: str = "NULL", brief: str = "false") -> str:
    lines = f"length({full}) - length(replace({full}, chr(10), ''))"
    return f"SELECT doc_id, sha256(path || ':' || {start} || ':None:' || {full}) AS id, {name} AS name, '{kind}' AS type, {content} AS content, {parent} AS parent_id, {docstring} AS docstring, {signature} AS signature, path AS file_path, {line} AS start_line, {line} + {lines} AS end_line, {start} AS start_byte, {start} + strlen({size}) AS end_byte, {brief} AS is_skeleton, NULL::INT AS chunk_index FROM f"


HID = f"'{HIDDEN}'"
CLASS = "cls || pad || run"
CLASS_BRIEF = f"cls || pad || 'def run(self, n):' || {NL} || '        ' || {HID}"
BRIEF_LONG = f"'def long' || doc_id || '(a):' || {NL} || '    '"
CLASS_ID = f"sha256(path || ':' || b_cls || ':None:' || {CLASS})"
LONG_ID = "sha256(path || ':' || b_long || ':None:' || long)"
FILE_PY = f"head || {CLASS_BRIEF} || {NL} || '    ' || {HID} || {NL} || gap || help || sep || CASE WHEN length(long) > 1000 THEN 'def long' || doc_id || '(a):' || {NL} || '    ' || {HID} || {NL} ELSE long END || last"
FILE_C = "head || node || sep || kind || sep2 || push || last"  # no body here is long enough to be left out


def _file(content: str) -> str:
    return f"SELECT doc_id, fid, path, 'file', {content}, NULL, NULL, NULL, path, 0, length(code) - length(replace(code, chr(10), '')), 0, strlen(code), true, NULL FROM f"


ROWS_PY = ", ".join([
    _pieces_sql(PY, "py"),
    "s AS (" + " UNION ALL ".join([
        _row("'K' || doc_id", "class", CLASS_BRIEF, "b_cls", CLASS, "l_cls", CLASS, "fid", "'K' || doc_id", "'About ' || lang || '.'", "true"),
        _row("'run'", "method", "run", "b_run", "run", "l_run", "run", CLASS_ID, "'run(self, n)'"),
        _row("'helper' || doc_id", "function", "help", "b_help", "help", "l_help", "help", "fid", "'helper' || doc_id || '(x)'"),
        _row("'long' || doc_id", "function", f"CASE WHEN length(long) > 1000 THEN {BRIEF_LONG} ELSE long END", "b_long", "long", "l_long", "long", "fid", "'long' || doc_id || '(a)'", brief="length(long) > 1000"),
        _file(FILE_PY),
    ]) + ")",
])
#: A long function's chunks: a line goes to the next one when a chunk has 500 characters. All lines but the first have 14, and the last has no end.
CHUNKS_PY = _pieces_sql(PY, "py") + f""", g AS (SELECT *, length('def long' || doc_id || '(a):') + 1 AS l0, (n_chars % 120) + 1 AS t FROM f WHERE length(long) > 1000),
m AS (SELECT *, ceil((500 - l0) / 14.0)::BIGINT AS m0 FROM g),
c AS (SELECT *, unnest(range(0, (1 + ceil(greatest(t - m0, 0) / 36.0))::BIGINT)) AS i FROM m),
e AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE l0 + 14 * (m0 + 36 * (i - 1)) END AS a, l0 + 14 * (m0 + 36 * i) AS z FROM c)
SELECT sha256(path || ':' || b_long || ':' || i || ':' || substr(long, a + 1, z - a)) AS id, 'long' || doc_id || '_chunk_' || i AS name, {LONG_ID} AS parent_id, path AS file_path, i AS chunk_index, substr(long, a + 1, z - a) AS content FROM e"""
ROWS_C = ", ".join([
    _pieces_sql(C, "c"),
    "s AS (" + " UNION ALL ".join([
        _row("'N' || doc_id", "struct", "node", "b_node", "node", "l_node", "node", "fid", "'N' || doc_id", "'node ' || doc_id"),
        _row("'E' || doc_id", "enum", "kind", "b_kind", "kind", "l_kind", "kind", "fid", "'E' || doc_id"),
        _row("'push' || doc_id", "function", "push", "b_push", "push", "l_push", "push", "fid", "'push' || doc_id || '(struct N' || doc_id || ' *n, int v)'"),
        _file(FILE_C),
    ]) + ")",
])
SHOWN = ["id", "name", "type", "content", "parent_id", "docstring", "signature", "file_path", "start_line", "end_line", "start_byte", "end_byte", "is_skeleton"]
#: y: the symbol that a name stands for; t: (source, name, type) of what refers to one.
RESOLVED = "SELECT source_id, coalesce(y.id, t.target) AS target_id, t.type, t.file_path, y.id IS NOT NULL AS resolved FROM t LEFT JOIN (SELECT name, arg_min(id, (file_path, start_byte, id)) AS id FROM s WHERE type IN ('function', 'class', 'struct', 'enum') GROUP BY name) y ON y.name = t.target"


def _snippets(spark, d, extension: str):
    from fathom.sources.codebase import parse

    return parse(code_files(spark, d, extension))[0]


@query(f"WITH {ROWS_PY} SELECT {', '.join(SHOWN)} FROM s")
def parse_python(spark, d):
    """Classes, methods, functions and files; chunks are chunk_functions."""
    return _snippets(spark, d, "py").where("chunk_index IS NULL").select(*SHOWN)


@query(f"WITH {ROWS_C} SELECT {', '.join(SHOWN)} FROM s")
def parse_c(spark, d):
    return _snippets(spark, d, "c").where("chunk_index IS NULL").select(*SHOWN)


@query(f"WITH {CHUNKS_PY}")
def chunk_functions(spark, d):
    rows = _snippets(spark, d, "py").where("chunk_index IS NOT NULL")
    return rows.selectExpr("id", "name", "parent_id", "file_path", "CAST(chunk_index AS LONG) AS chunk_index", "content")


def _edges(spark, d, extension: str):
    """Each file is parsed once; what is kept of it are its captures, and of its snippets the columns that edges need, no texts."""
    from fathom.sources.codebase import parsed

    rows = F.transform("snippets", lambda s: F.struct(*[s[c].alias(c) for c in ("id", "name", "type", "file_path", "start_byte", "end_byte", "chunk_index")]))
    read = checkpointed(parsed(code_files(spark, d, extension)).select(rows.alias("snippets"), "captures"))
    return graph.edges_from_captures(read.selectExpr("inline(captures)"), read.selectExpr("inline(snippets)"))


@query(f"""WITH {ROWS_PY}, i AS (SELECT doc_id, any_value(file_path) AS path, max(id) FILTER (type = 'file') AS fid, max(id) FILTER (type = 'class') AS cid, max(id) FILTER (type = 'method') AS rid, max(id) FILTER (name LIKE 'helper%') AS hid, max(id) FILTER (name LIKE 'long%') AS lid FROM s GROUP BY doc_id),
t AS (SELECT rid AS source_id, 'helper' || doc_id AS target, 'calls' AS type, path AS file_path FROM i UNION ALL SELECT hid, 'K' || (doc_id + 1), 'instantiates', path FROM i UNION ALL SELECT cid, 'K' || (doc_id - 1), 'inherits', path FROM i
 UNION ALL SELECT hid, 'int', 'returns', path FROM i UNION ALL SELECT hid, 'deco', 'decorated_by', path FROM i UNION ALL SELECT fid, 'import os', 'imports', path FROM i UNION ALL SELECT fid, 'from lib' || doc_id % 3 || ' import base', 'imports', path FROM i)
{RESOLVED} UNION ALL SELECT fid, 'LIMIT', 'modifies', path, false FROM i UNION ALL SELECT rid, 'self.n', 'modifies', path, false FROM i
UNION ALL SELECT fid, unnest([cid, hid, lid]), 'defines', path, true FROM i UNION ALL SELECT cid, rid, 'defines', path, true FROM i""")
def edges_python(spark, d):
    return _edges(spark, d, "py")


@query(f"""WITH {ROWS_C}, i AS (SELECT doc_id, any_value(file_path) AS path, max(id) FILTER (type = 'file') AS fid, max(id) FILTER (type = 'struct') AS nid, max(id) FILTER (type = 'function') AS pid FROM s GROUP BY doc_id),
t AS (SELECT pid AS source_id, 'push' || (doc_id + 1) AS target, 'calls' AS type, path AS file_path FROM i UNION ALL SELECT fid, 'stdio.h', 'imports', path FROM i UNION ALL SELECT fid, 'lib' || doc_id % 3 || '.h', 'imports', path FROM i)
{RESOLVED} UNION ALL SELECT pid, 'n->value', 'modifies', path, false FROM i UNION ALL SELECT fid, unnest([nid, pid]), 'defines', path, true FROM i""")
def edges_c(spark, d):
    return _edges(spark, d, "c")


@query(f"WITH {ROWS_C} SELECT {', '.join(SHOWN)} FROM s")
def lateral_snippets(spark, d):
    """The C files' snippets by a table function in SQL."""
    import uuid

    from fathom.functions import tables

    tables.register(spark)
    view = f"files_{uuid.uuid4().hex}"
    code_files(spark, d, "c").createOrReplaceTempView(view)
    try:
        return spark.sql(f"SELECT {', '.join(f's.{c}' for c in SHOWN)} FROM {view} f, LATERAL code_snippets(f.file_path, f.language, f.content) s")
    finally:
        spark.catalog.dropTempView(view)
