"""Code trees: scan, parse, edges, incremental index, search."""

import os

import pytest

from fathom.api import Engine
from fathom.parsing import c_source, outline, python_source
from fathom.sources import codebase
from fathom.sources.codebase import read_codebase

SHAPES = '''import os
from a.b import c

LIMIT = 3

class Base:
    pass

class Child(Base):
    """Doc."""
    def run(self, n):
        self.n = n
        return helper(n)

# leading note
@deco
def helper(x) -> int:
    return Base()
'''
NODE = """#include <stdio.h>
#include "list.h"

/* a node */
typedef struct Node {
    int value;
    struct Node *next;
} Node;

enum Color { RED, GREEN };

void push(Node *n, int v) {
    n->value = v;
    emit(v);
}
"""


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "pkg").mkdir()
    (root / "pkg/shapes.py").write_text(SHAPES)
    (root / "pkg/node.h").write_text(NODE)
    (root / "pkg/__init__.py").write_text("A = 1\n")
    (root / "pkg/_private.py").write_text("def hidden():\n    return 'é'\n")
    for bad in (".git", "__pycache__", "venv", ".venv", "node_modules"):
        (root / bad).mkdir()
        (root / bad / "x.py").write_text("def no(): pass\n")
    return root


@pytest.fixture(scope="module")
def engine(spark, project, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store") / "s"))
    e.index(str(project)).collect()
    return e


def test_scan(spark, project):
    names = {os.path.basename(r.file_path) for r in read_codebase(spark, str(project)).collect()}
    assert names == {"shapes.py", "node.h", "__init__.py", "_private.py"}
    assert read_codebase(spark, str(project), recursive="false").count() == 0


def rows(engine, table, schema):
    return engine.store.read(table, schema).collect()


def test_snippets(engine):
    from fathom.schema import SNIPPETS

    got = {(r.name, r.type): r for r in rows(engine, "snippets", SNIPPETS)}
    child, run, helper = got["Child", "class"], got["run", "method"], got["helper", "function"]
    assert child.docstring == "Doc." and child.is_skeleton and outline.HIDDEN in child.content and "self.n = n" not in child.content
    assert run.signature == "run(self, n)" and run.parent_id == child.id and run.parent_signature == "Child"
    assert helper.signature == "helper(x)" and helper.docstring is None and helper.start_line == 16
    assert got["shapes.py", "file"].parent_id is None and helper.parent_id == got["shapes.py", "file"].id
    assert got["Node", "struct"].docstring == "a node" and ("Color", "enum") in got and got["push", "function"].signature == "push(Node *n, int v)"
    assert ("__init__.py", "file") not in got  # no definitions, no row
    assert all(r.summary for r in got.values())


def test_edges(engine):
    from fathom.schema import EDGES, NODES

    name = {r.id: r.name for r in rows(engine, "nodes", NODES)}
    got = {(name[r.source_id], r.type, name[r.target_id], r.resolved) for r in rows(engine, "edges", EDGES)}
    for edge in [
        ("shapes.py", "defines", "Base", True), ("shapes.py", "defines", "helper", True), ("Child", "defines", "run", True), ("Child", "inherits", "Base", True),
        ("run", "calls", "helper", True), ("run", "modifies", "self.n", False), ("helper", "instantiates", "Base", True), ("helper", "returns", "int", False),
        ("helper", "decorated_by", "deco", False), ("shapes.py", "imports", "import os", False), ("shapes.py", "imports", "from a.b import c", False), ("shapes.py", "modifies", "LIMIT", False),
        ("push", "calls", "emit", False), ("push", "modifies", "n->value", False), ("node.h", "imports", "stdio.h", False), ("node.h", "imports", "list.h", False), ("node.h", "defines", "push", True), ("node.h", "defines", "Node", True),
    ]:
        assert edge in got, edge
    assert ("node.h", "defines", "Color", True) not in got


def test_search_and_answer(engine):
    hits = engine.search("helper", 3).collect()
    assert hits[0].snippet.name == "helper" and hits[0].parent.name == "shapes.py"
    assert ("instantiates", "Base") in {(r.type, r.target) for r in hits[0].relations}
    assert "--- Snippet 1 [helper [in shapes.py (file)] at " in engine.answer("helper", 2)
    assert list(engine.stream("helper", 1))[-1] == "data: [DONE]\n\n"
    assert engine.search("???", 3).count() >= 0


def test_incremental(spark, project, engine):
    from fathom.schema import EDGES, NODES, SNIPPETS

    before = len(rows(engine, "edges", EDGES))
    (project / "pkg/_private.py").write_text("def hidden():\n    return helper(1)\n")
    (project / "pkg/node.h").unlink()
    got = {os.path.basename(r.file_path): r.status for r in engine.index(str(project)).collect()}
    assert got == {"shapes.py": "unchanged", "__init__.py": "unchanged", "_private.py": "changed", "node.h": "deleted"}
    name = {r.id: r.name for r in rows(engine, "nodes", NODES)}
    edges = {(name[r.source_id], r.type, name[r.target_id]) for r in rows(engine, "edges", EDGES)}
    assert ("hidden", "calls", "helper") in edges and ("run", "calls", "helper") in edges and before
    assert not [r for r in rows(engine, "snippets", SNIPPETS) if r.file_path.endswith("node.h")]
    total = engine.verify().first()
    assert total.total == total.local + total.placeholders and total.without_vector == 0
    assert engine.status().first().indexed


def test_chunks_and_skeletons():
    code = "def f(a):\n" + "".join(f"    x{i} = a + {i}\n" for i in range(200))
    o = python_source.parse(code)
    got = outline.snippets(code, "f.py", o, 1000)
    parts = [r for r in got if r["chunk_index"] is not None]
    assert "".join(r["content"] for r in parts) == code.rstrip("\n") and all(r["parent_id"] == got[0]["id"] for r in parts)
    assert got[0]["is_skeleton"] and parts[0]["name"] == "f_chunk_0"
    plain = "A = 1\nB = 2\n"
    assert outline.file_row(plain.encode(), "a.py", "x", [])["content"] == plain


def test_broken_python_and_non_ascii():
    o = python_source.parse("s = 'é'\ndef ok(a):\n    return 1\nclass K:\n    def m(self):\n        pass\ndef bad(:\n")
    assert o.error and [(d.name, d.kind) for d in o.definitions][:3] == [("ok", "function"), ("K", "class"), ("m", "method")]
    code = "s = 'éé'\ndef f():\n    return 'ü'\n"
    d = python_source.parse(code).definitions[0]
    assert code.encode()[d.start : d.end].decode() == "def f():\n    return 'ü'"


def test_c_cases():
    o = c_source.parse('static int (*table[2])(int);\nextern "C" {\nint add(int a, int b) { if (a) { return g(a); } A = b; return b; }\n}\nstruct S { int x; };\ntypedef enum { X, Y } E;\n')
    assert [(d.kind, d.name) for d in o.definitions] == [("function", "add"), ("struct", "S"), ("enum", "E")]
    assert {(c.tag, c.text) for c in o.captures} == {("call", "g"), ("assignment", "A")}


def test_unreadable_file_is_not_deleted(spark, tmp_path, monkeypatch):
    """A file that can't be read for a while keeps its snippets, and is listed as an error; once gone it's deleted."""
    from fathom.plans.index import build
    from fathom.schema import ERRORS, FILES, SNIPPETS
    from fathom.sources.codebase import _Files, _Reader

    row = next(iter(_Reader({"path": str(tmp_path)}).read(_Files([str(tmp_path / "no.py")]))))
    assert row == (str(tmp_path / "no.py"), "python", None, None)
    e = Engine(spark, str(tmp_path / "store"))
    files = lambda *rows: spark.createDataFrame(list(rows), FILES)
    names = lambda: {r.name for r in e.store.read("snippets", SNIPPETS).where("type = 'function'").collect()}
    a, b = ("a.py", "python", "def a():\n    pass\n", "1"), ("b.py", "python", "def b():\n    pass\n", "2")
    build(files(a, b), e.store)
    status = {r.file_path: r.status for r in build(files(a, ("b.py", "python", None, None), ("c.py", "python", None, None)), e.store).collect()}
    assert status == {"a.py": "unchanged", "b.py": "unchanged"} and names() == {"a", "b"}
    assert {(r.file_path, r.error) for r in e.store.read("errors", ERRORS).collect()} == {("b.py", "unreadable"), ("c.py", "unreadable")}
    build(files(a, b), e.store)
    assert e.store.read("errors", ERRORS).count() == 0 and names() == {"a", "b"}
    one = e.get(*[r.id for r in e.store.read("snippets", SNIPPETS).where("name = 'b'").collect()]).collect()
    assert [r.name for r in one] == ["b"]
    build(files(a), e.store)
    assert names() == {"a"}


def test_a_task_holds_few_files_at_once():
    """However many files a batch has."""
    import pyarrow as pa

    n = 3 * codebase.FILES_AT_ONCE + 1
    batch = pa.RecordBatch.from_pydict({"file_path": [f"f{i}.py" for i in range(n)], "language": ["python"] * n, "content": [f"def f{i}(x):\n    return x\n" for i in range(n)]})
    snippet, capture = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("metadata", pa.map_(pa.string(), pa.string()))])), pa.list_(pa.struct([("tag", pa.string())]))
    schema = pa.schema([("snippets", snippet), ("captures", capture), ("file_path", pa.string()), ("error", pa.string())])
    out = list(codebase.outlined(iter([batch]), codebase.parsers(), 1000, schema))
    assert max(b.num_rows for b in out) <= codebase.FILES_AT_ONCE
    assert [r["snippets"][0]["name"] for b in out for r in b.to_pylist()] == [f"f{i}" for i in range(n)]


def test_edges_parse_each_file_once(spark, tmp_path, monkeypatch):
    from fathom.parsing import c_source, python_source
    from fathom.plans import catalogue

    spark.createDataFrame([(i, "some text", "en", "s", 9) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    taken = spark.sparkContext.accumulator(0)

    def counting(parse):
        def run(code):
            taken.add(1)
            return parse(code)

        return run

    monkeypatch.setattr(codebase, "parsers", lambda: {"python": counting(python_source.parse), "c": counting(c_source.parse)})
    for name in ("edges_python", "edges_c"):
        before = taken.value
        assert catalogue.queries()[name](spark, str(tmp_path)).count() > 0
        assert taken.value - before == 5
