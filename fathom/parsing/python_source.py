"""Python files by the standard library's syntax tree; broken files by their indentation."""

from __future__ import annotations

import ast
import re

from fathom.parsing.outline import Capture, Definition, Outline

_HEAD = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)[ \t]*(\([^)]*\))?", re.M)


class _Offsets:
    """Syntax-tree positions (line, byte column) to byte offsets."""

    def __init__(self, raw: bytes):
        self.raw, self.lines = raw, [0]
        for m in re.finditer(rb"\r\n|\r|\n", raw):
            self.lines.append(m.end())

    def __call__(self, line: int, column: int) -> int:
        return self.lines[line - 1] + column

    def text(self, a: int, b: int) -> str:
        return self.raw[a:b].decode("utf-8", "replace")


def parse(code: str) -> Outline:
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError) as e:
        return _by_indent(code, f"{type(e).__name__}: {e}")
    at = _Offsets(code.encode("utf-8", "surrogatepass"))
    lines = code.encode("utf-8", "surrogatepass").splitlines()
    out = Outline([], [])

    def span(node: ast.AST) -> tuple[int, int]:
        return at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset)

    def text(node: ast.AST) -> str:
        return at.text(*span(node))

    def visit(node: ast.AST, parent: Definition | None) -> None:
        here = parent
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            here = define(node, parent)
        elif isinstance(node, ast.Call) and isinstance(node.func, (ast.Name, ast.Attribute)):
            out.captures.append(Capture("call", text(node.func), *span(node)))
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            out.captures.append(Capture("import", text(node), *span(node)))
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                name = text(target)
                if "." in name or name.isupper():
                    out.captures.append(Capture("assignment", name, *span(node)))
        for child in ast.iter_child_nodes(node):
            visit(child, here)

    def define(node, parent: Definition | None) -> Definition:
        start, end = span(node)
        body = node.body[0]
        first = min([body.lineno, *(d.lineno for d in getattr(body, "decorator_list", []))])
        body_start = at(body.lineno, body.col_offset) if first == body.lineno else at(first, len(lines[first - 1]) - len(lines[first - 1].lstrip()))
        in_class, p = False, parent
        while p:
            in_class, p = in_class or p.kind == "class", p.parent
        kind = "class" if isinstance(node, ast.ClassDef) else "method" if in_class else "function"
        signature = node.name
        if kind != "class":
            head = at.text(start, body_start)
            signature += _parenthesised(head[head.index(node.name) + len(node.name) :])
        d = Definition(kind, node.name, start, end, body_start, node.lineno - 1, node.end_lineno - 1, signature, _docstring(node, at), parent)
        notes = _comments_before(lines, node.lineno - 1, node.col_offset)
        if notes and not node.decorator_list:
            d.docstring = notes if not d.docstring else notes + "\n" + d.docstring
        if parent:
            parent.children.append(d)
        out.definitions.append(d)
        if kind == "class":
            for base in [*node.bases, *node.keywords]:
                out.captures.append(Capture("base", text(base), start, end, d))
        elif node.returns is not None:
            out.captures.append(Capture("returns", text(node.returns), start, end, d))
        for deco in node.decorator_list:
            out.captures.append(Capture("decorator", text(deco), start, end, d))
        return d

    visit(tree, None)
    out.definitions.sort(key=lambda d: (d.start, -d.end))
    return out


def _parenthesised(head: str) -> str:
    """The parameter list that the head starts with."""
    depth, begin = 0, head.find("(")
    for i, c in enumerate(head):
        depth += (c in "([{") - (c in ")]}")
        if depth == 0 and i >= begin >= 0 and c == ")":
            return head[begin : i + 1]
    return "()"


def _docstring(node, at: _Offsets) -> str | None:
    first = node.body[0]
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        return at.text(at(first.lineno, first.col_offset), at(first.end_lineno, first.end_col_offset)).strip("\"'") or None
    return None


def _comments_before(lines: list[bytes], line: int, column: int) -> str:
    notes = []
    while line > 0 and (text := lines[line - 1].strip()).startswith(b"#"):
        notes.append(text.decode("utf-8", "replace").strip("# ").strip())
        line -= 1
    return "\n".join(reversed(notes))


def _by_indent(code: str, error: str) -> Outline:
    out = Outline([], [], error)
    lines = code.split("\n")
    begin = [0]
    for line in lines:
        begin.append(begin[-1] + len(line.encode("utf-8", "surrogatepass")) + 1)
    stack: list[tuple[int, Definition]] = []
    for n, line in enumerate(lines):
        m = _HEAD.match(line)
        if not m:
            continue
        indent = len(m[1].expandtabs())
        last = n
        for k in range(n + 1, len(lines)):
            if lines[k].strip():
                if len(lines[k].expandtabs()) - len(lines[k].expandtabs().lstrip()) <= indent:
                    break
                last = k
        while stack and stack[-1][0] >= indent:
            stack.pop()
        parent = stack[-1][1] if stack else None
        kind = "class" if m[2] == "class" else "method" if any(d.kind == "class" for _, d in stack) else "function"
        start = begin[n] + len(m[1].encode())
        d = Definition(kind, m[3], start, begin[last] + len(lines[last].encode("utf-8", "surrogatepass")), min(begin[n + 1], begin[last] + len(lines[last].encode("utf-8", "surrogatepass"))), n, last, m[3] + ("" if kind == "class" else m[4] or "()"), None, parent)
        if parent:
            parent.children.append(d)
        out.definitions.append(d)
        stack.append((indent, d))
    return out
