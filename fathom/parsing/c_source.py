"""C files by a scanner that knows comments, strings, directives and braces."""

from __future__ import annotations

import re

from fathom.parsing.outline import Capture, Definition, Outline

_TOKEN = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<directive>^[ \t]*\#(?:\\\r?\n|/\*.*?\*/|[^\n])*)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<word>[A-Za-z_]\w*)|(?P<number>\d[\w.]*)|(?P<op><<=|>>=|->|\+\+|--|&&|\|\||[-+*/%&|^]=|[=!<>]=|<<|>>|\.\.\.|[{}()\[\];,=.<>!~?:+*/%&|^-])""", re.M | re.S | re.X)
_KEYWORDS = frozenset("if for while switch return sizeof do else case default goto break continue typedef struct union enum static extern inline const volatile register void char short int long float double signed unsigned _Alignof _Generic".split())
_ASSIGN = frozenset(("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="))


class _Tok:
    __slots__ = ("kind", "text", "start", "end")

    def __init__(self, kind: str, text: str, start: int, end: int):
        self.kind, self.text, self.start, self.end = kind, text, start, end


def parse(code: str) -> Outline:
    toks = [_Tok(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN.finditer(code)]
    out = Outline([], [])
    byte = _Bytes(code)
    comments = [t for t in toks if t.kind == "comment"]
    for t in toks:
        if t.kind == "directive" and (m := re.match(r"\s*#\s*include\s*(\"[^\"\n]*\"|<[^>\n]*>)", t.text)):
            out.captures.append(Capture("import", m[1], byte(t.start), byte(t.end)))
    real = [t for t in toks if t.kind not in ("comment", "directive")]
    close = _pairs(real)
    _scan(code, real, close, 0, len(real), out, byte, comments, set())
    kept: list[Definition] = []
    reach = -1
    for d in sorted(out.definitions, key=lambda d: (d.start, -d.end)):
        if d.end <= reach:  # within one that was kept
            continue
        kept.append(d)
        reach = max(reach, d.end)
    out.definitions = kept
    return out


class _Bytes:
    def __init__(self, code: str):
        self.code, self.plain = code, code.isascii()

    def __call__(self, at: int) -> int:
        return at if self.plain else len(self.code[:at].encode("utf-8", "surrogatepass"))


def _pairs(toks: list[_Tok]) -> dict[int, int]:
    """Opening bracket -> its closing one."""
    open_, found = [], {}
    for i, t in enumerate(toks):
        if t.text in ("(", "[", "{"):
            open_.append(i)
        elif t.text in (")", "]", "}") and open_:
            found[open_.pop()] = i
    return found


def _scan(code, toks, close, begin, end, out, byte, comments, done) -> None:
    """Declarations between two tokens; each starts after the last ; or }."""
    start = i = begin
    while i < end:
        t = toks[i]
        if t.text == ";":
            start = i + 1
        elif t.text == "{":
            last = close.get(i, end - 1)
            head = toks[start:i]
            words = [h.text for h in head]
            if words[:1] == ["extern"] and len(head) == 2 and head[1].kind == "string":
                _scan(code, toks, close, i + 1, last, out, byte, comments, done)
                start = last + 1
            elif any(w in ("struct", "union", "enum") for w in words) and not _is_function(head):
                stop = last + 1
                while stop < end and toks[stop].text != ";":
                    stop += 1
                _record(code, toks, head, start, i, last, stop, out, byte, comments)
                i = start = stop + 1
                continue
            elif _is_function(head):
                _function(code, toks, start, i, last, out, byte, comments)
                _body(code, toks, i, last, out, byte)
                start = last + 1
            else:
                start = last + 1 if toks[min(last + 1, end - 1)].text not in (",", ";", ")") else start
            i = last
        i += 1


def _is_function(head: list[_Tok]) -> bool:
    texts = [h.text for h in head]
    if "(" not in texts or "=" in texts:
        return False
    at = texts.index("(")
    return at > 0 and head[at - 1].kind == "word" and head[at - 1].text not in _KEYWORDS or (at > 0 and texts[at + 1 : at + 2] == ["*"])


def _function(code, toks, start, brace, last, out, byte, comments) -> None:
    head = toks[start:brace]
    texts = [h.text for h in head]
    at = texts.index("(")
    name = next((h.text for h in (head[at - 1 : at] if head[at - 1].kind == "word" and head[at - 1].text not in _KEYWORDS else head[at:]) if h.kind == "word"), "anonymous")
    first = at - 1 if head[at - 1].kind == "word" and head[at - 1].text not in _KEYWORDS else at
    while first > 0 and head[first - 1].text == "*":
        first -= 1
    signature = code[head[first].start : head[-1].end]
    _define("function", name, signature, toks[start].start, toks[last].end, toks[brace].start, code, out, byte, comments)


def _record(code, toks, head, start, brace, last, stop, out, byte, comments) -> None:
    words = [h.text for h in head]
    kind = "enum" if "enum" in words else "struct"
    tag = max(k for k, w in enumerate(words) if w in ("struct", "union", "enum"))
    if words[tag] == "union":
        return
    own = head[tag + 1].text if tag + 1 < len(head) and head[tag + 1].kind == "word" else "anonymous"
    if words[0] == "typedef":
        after = [t for t in toks[last + 1 : stop] if t.kind == "word"]
        finish = toks[stop].end if stop < len(toks) else toks[last].end
        name = after[0].text if after else own
        _define(kind, name, name, toks[start].start, finish, toks[brace].start, code, out, byte, comments)
    else:
        _define(kind, own, own, head[tag].start, toks[last].end, toks[brace].start, code, out, byte, comments)


def _define(kind, name, signature, start, end, body, code, out, byte, comments) -> None:
    notes, at = [], start
    for c in reversed([c for c in comments if c.end <= start]):
        if code[c.end : at].strip():
            break
        notes.append(c.text.strip("/ ").strip("*").strip())
        at = c.start
    out.definitions.append(Definition(kind, name, byte(start), byte(end), byte(body), code.count("\n", 0, start), code.count("\n", 0, end), signature, "\n".join(reversed(notes)) or None))


def _body(code, toks, brace, last, out, byte) -> None:
    """Calls by a plain name, and assignments."""
    for i in range(brace + 1, last):
        t = toks[i]
        if t.kind == "word" and t.text not in _KEYWORDS and toks[i + 1].text == "(" and toks[i - 1].text not in (".", "->") and not (toks[i - 1].kind == "word" and toks[i - 1].text not in _KEYWORDS):
            out.captures.append(Capture("call", t.text, byte(t.start), byte(t.end)))
        elif t.text in _ASSIGN and i > brace + 1:
            k = i - 1
            while k > brace and (toks[k].kind == "word" or toks[k].text in (".", "->")) and not (toks[k].kind == "word" and toks[k + 1].kind == "word"):
                k -= 1
            k += 1
            if k < i and toks[k].kind == "word":
                target = code[toks[k].start : toks[i - 1].end]
                typed = toks[k - 1].kind == "word" and toks[k - 1].text not in ("else", "do", "return") or toks[k - 1].text == "*" and toks[k - 2].kind == "word"
                if not typed and ("." in target or "->" in target or target.isupper()):
                    out.captures.append(Capture("assignment", target, byte(toks[k].start), byte(toks[i - 1].end)))
