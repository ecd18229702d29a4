"""What the parsers share: definitions, captures, and the snippets made of them.

Offsets are UTF-8 bytes. A parser is a function ``(code) -> Outline``; languages are
registered in ``PARSERS``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

# The mark where a body was left out, and the sizes of chunks.
HIDDEN = "... # implementation hidden ..."
CHUNK_SIZE, CHUNK_LEAST = 1000, 200


@dataclass
class Definition:
    kind: str
    name: str
    start: int
    end: int
    body_start: int
    start_line: int
    end_line: int
    signature: str
    docstring: str | None = None
    parent: "Definition | None" = None
    children: list["Definition"] = field(default_factory=list)


@dataclass
class Capture:
    """A place that may give an edge. For tags that name their owner, owner_* is the owner's span."""

    tag: str
    text: str
    start: int
    end: int
    owner: Definition | None = None


@dataclass
class Outline:
    definitions: list[Definition]
    captures: list[Capture]
    error: str | None = None


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def snippet_id(path: str, d: Definition, chunk: int | None, text: str) -> str:
    return sha(f"{path}:{d.start}:{chunk}:{text}")


def chunks(code: str, most: int = CHUNK_SIZE, least: int = CHUNK_LEAST) -> list[str]:
    """Splits at lines, shallow ones first: pieces of at most ``most`` characters where lines allow, at least ``least`` but for the last."""
    lines = code.splitlines(keepends=True)
    out: list[list[str]] = [[]]
    size = 0
    base = min((len(x) - len(x.lstrip()) for x in lines[1:] if x.strip()), default=0)
    for i, line in enumerate(lines):
        shallow = bool(line.strip()) and len(line) - len(line.lstrip()) <= base and i > 1
        if size and (size + len(line) > most or (shallow and size >= max(least, most // 2))) and size >= least:
            out.append([])
            size = 0
        out[-1].append(line)
        size += len(line)
    return ["".join(x) for x in out if x]


def skeleton(raw: bytes, d: Definition) -> str:
    """A class with its methods' bodies left out; of others what stands before the body."""
    cut = lambda a, b: raw[a:b].decode("utf-8", "replace")
    if d.kind != "class":
        return cut(d.start, d.body_start)
    parts, at = [cut(d.start, d.body_start)], d.body_start
    for child in d.children:
        parts += [cut(at, child.start), cut(child.start, child.body_start).strip(), "\n        " + HIDDEN]
        at = child.end
    return "".join([*parts, cut(at, d.end)])


def snippets(code: str, path: str, outline: Outline, chunk_size: int = CHUNK_SIZE) -> list[dict]:
    """Rows of the snippet table: definitions, chunks of long functions, and the file itself last."""
    raw = code.encode("utf-8", "surrogatepass")
    rows: list[dict] = []
    ids: dict[int, str] = {}
    file_id = sha("file:" + path)
    full = {id(d): raw[d.start : d.end].decode("utf-8", "replace") for d in outline.definitions}
    for d in outline.definitions:
        ids[id(d)] = snippet_id(path, d, None, full[id(d)])
    top = []
    for d in outline.definitions:
        text = full[id(d)]
        long = d.kind != "class" and len(text) > chunk_size
        brief = d.kind == "class" or long
        row = {
            "id": ids[id(d)], "name": d.name, "type": d.kind, "content": skeleton(raw, d) if brief else text, "summary": None,
            "parent_id": ids[id(d.parent)] if d.parent else file_id, "docstring": d.docstring, "signature": d.signature, "file_path": path,
            "start_line": d.start_line, "end_line": d.end_line, "start_byte": d.start, "end_byte": d.end, "is_skeleton": brief,
            "chunk_index": None, "parent_signature": None, "parent_summary": None, "metadata": {},
        }
        rows.append(row)
        if brief and d.parent is None:
            top.append((d, row["content"]))
        for i, part in enumerate(chunks(text, chunk_size) if long else []):
            rows.append(row | {"id": snippet_id(path, d, i, part), "name": f"{d.name}_chunk_{i}", "content": part, "parent_id": row["id"], "is_skeleton": False, "chunk_index": i, "metadata": {"chunk_index": str(i)}})
    if rows:
        rows.append(file_row(raw, path, file_id, top))
    return rows


def file_row(raw: bytes, path: str, file_id: str, top: list[tuple[Definition, str]]) -> dict:
    """The file with its top-level skeletons in place of their definitions."""
    parts, at = [], 0
    for d, text in sorted(top, key=lambda x: x[0].start):
        if d.start < at:
            continue
        parts += [raw[at : d.start].decode("utf-8", "replace"), text.strip(), f"\n    {HIDDEN}\n"]
        at = d.end
    return {
        "id": file_id, "name": path.rsplit("/", 1)[-1], "type": "file", "content": "".join([*parts, raw[at:].decode("utf-8", "replace")]), "summary": None, "parent_id": None,
        "docstring": None, "signature": None, "file_path": path, "start_line": 0, "end_line": raw.count(b"\n"), "start_byte": 0, "end_byte": len(raw), "is_skeleton": True,
        "chunk_index": None, "parent_signature": None, "parent_summary": None, "metadata": {},
    }


def captures(path: str, outline: Outline) -> list[dict]:
    out = []
    for d in outline.definitions:
        p = d.parent
        out.append({"file_path": path, "tag": f"{d.kind}.def", "text": d.name, "start": d.start, "end": d.end, "owner_start": p.start if p else None, "owner_end": p.end if p else None})
    for c in outline.captures:
        out.append({"file_path": path, "tag": c.tag, "text": c.text, "start": c.start, "end": c.end, "owner_start": c.owner.start if c.owner else None, "owner_end": c.owner.end if c.owner else None})
    return out
