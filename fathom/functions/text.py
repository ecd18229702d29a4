"""Text functions: tokens, query terms, hashes, assembled texts, model replies."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Lower-case letters that are one ASCII letter with marks, by Unicode decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xE0, 0x250)]
    found = [(a, d[0]) for a, d in pairs if len(d) > 1 and d[0].isascii() and d[0].isalpha()]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


MARKED, PLAIN = _accents()


def folded(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def tokens(text: Column) -> Column:
    """Search tokens: case and accents folded, split at anything but letters and digits. Null has none."""
    return F.coalesce(F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def query_terms(text: Column) -> Column:
    """Terms of a query as the user wrote them; dots and underscores belong to terms."""
    return F.regexp_extract_all(F.trim(text), F.lit(r"[a-zA-Z0-9_.]+"), F.lit(0))


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def snippet_id(path: Column, start: Column, chunk: Column, text: Column) -> Column:
    """Identity of a snippet; a missing chunk number reads None."""
    return F.sha2(F.concat(path, F.lit(":"), start.cast("string"), F.lit(":"), F.coalesce(chunk.cast("string"), F.lit("None")), F.lit(":"), text), 256)


def file_id(path: Column) -> Column:
    return F.sha2(F.concat(F.lit("file:"), path), 256)


def project_id(path: Column) -> Column:
    """Last path part and the first eight digits of the path's MD5."""
    bare = F.regexp_replace(path, "/+$", "")
    return F.concat(F.regexp_extract(bare, "[^/]*$", 0), F.lit("_"), F.substring(F.md5(bare.cast("binary")), 1, 8))


def extension(path: Column) -> Column:
    """Last extension, lower-case; null without a dot in the file name."""
    return F.nullif(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), F.lit(""))


def language(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext == "py", "python").when(ext.isin("c", "h"), "c")


def short_id(value: Column) -> Column:
    return F.concat(F.substring(value, 1, 8), F.lit("..."))


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _line(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value, F.lit("\n"))).otherwise(F.lit(""))


def embeddable_text(file_path, name, kind, parent_signature, summary, parent_summary, content, use_summary: bool = True) -> Column:
    """The text that is embedded: labelled lines for what is known, then the code."""
    head = [_line("File: ", file_path), _line("Name: ", name), F.concat(F.lit("Type: "), kind, F.lit("\n")), _line("Parent Context: ", parent_signature)]
    notes = F.concat(_line("Summary: ", summary), _line("Parent Summary: ", parent_summary)) if use_summary else F.lit("")
    gap = F.when(notes != "", F.lit("\n")).otherwise(F.lit(""))
    return F.concat(*head, notes, gap, F.lit("Code:\n"), F.coalesce(content, F.lit("")))


def without_fences(reply: Column) -> Column:
    """A model's reply without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def outer_object(reply: Column) -> Column:
    """From the first brace to the last."""
    return F.regexp_extract(reply, r"(?s)(\{.*\})", 1)


def reply_map(reply: Column) -> Column:
    """id -> text of a JSON reply; an object gives its summary or content, or itself."""
    pairs = F.from_json(outer_object(without_fences(reply)), "map<string,string>")
    return F.transform_values(pairs, lambda _, v: F.coalesce(F.when(v.startswith("{"), F.coalesce(F.get_json_object(v, "$.summary"), F.get_json_object(v, "$.content"))), v))


def says_yes(reply: str) -> bool:
    return "YES" in reply.upper()


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
