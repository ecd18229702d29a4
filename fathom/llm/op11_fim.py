"""Fill-in-middle: each text is cut in prefix, middle and suffix and put together in another order.

A batch of texts is one Arrow buffer of UTF-8 bytes, and one numpy kernel cuts all of
its rows together. A table of byte classes (letter, other first byte, continuation byte)
and a comparison of each byte with the one before mark where units start: a run of ASCII
letters is a unit, any other code point is one of its own. The running sum of the marks,
less its value at a document's first byte, numbers the units within the document, and
searchsorted over the running sum finds the byte where the wanted unit starts. Cuts
are drawn from the SHA-256 of the row's id, so that a rerun, another partitioning or a lost
executor gives the same output. Nothing is shuffled: the plan is scan, kernel, projection.

Defined cases: a null text is empty; an empty text, and one that holds a marker, stays
plain; a null id draws as the empty id does; rows with the same id and text get the same
output; a very long text is a batch of its own, and its bytes are copied in slices; columns
other than doc_id and text are left out, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import in_groups, map_arrow, table

#: The seed in front of the id, the markers, and per cent of plain texts and of suffix-first ones.
SEED, MARKERS = 1, ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_BELOW = 90, 20
#: Bytes of texts that the kernel takes at a time, and from which on a piece is copied as a slice.
GROUP_BYTES, SLICE = 2 << 20, 1 << 14
FORMS = np.array(["plain", "psm", "spm"])
_OTHER, _LETTER, _MORE = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = _LETTER
_CLASS[0x80:0xC0] = _MORE
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a row's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _bytes_of(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array without nulls, and where its rows start (one more than rows)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _running(mask: np.ndarray) -> np.ndarray:
    """How many are set before each place, the end included."""
    return np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])


def holds_marker(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row: whether one of the markers lies within it."""
    hit = np.zeros(len(offsets) - 1, bool)
    if len(data) < 3:
        return hit
    middle = data[1:-1]
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & np.isin(middle, [ord(m[1]) for m in MARKERS]))
    row = np.searchsorted(offsets, at, side="right") - 1
    hit[row[at + 3 <= offsets[row + 1]]] = True
    return hit


def starts_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the bytes where units start, and of those where code points do."""
    kind = _CLASS[data]
    point = kind != _MORE
    letter = kind == _LETTER
    inside = np.zeros(len(data), bool)
    inside[1:] = letter[1:] & letter[:-1]
    first = offsets[:-1]
    inside[first[first < len(data)]] = False  # a document's first byte goes on with nothing
    return point & ~inside, point


def _gathered(source: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Pieces of a source one after another: short ones by one gather, long ones as slices."""
    out_at = _running(length)
    out = np.empty(out_at[-1], np.uint8)
    long = length > SLICE
    for b, n, o in zip(begin[long], length[long], out_at[:-1][long]):
        out[o : o + n] = source[b : b + n]
    b, n, o = begin[~long], length[~long], out_at[:-1][~long]
    step = np.arange(n.sum()) - np.repeat(_running(n)[:-1], n)
    out[np.repeat(o, n) + step] = source[np.repeat(b, n) + step]
    return out


def transformed(texts: pa.LargeStringArray, h: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.LargeStringArray]:
    """All rows at once: units, form's number, characters of prefix and of middle, output. ``h``: four numbers per row."""
    data, offsets = _bytes_of(texts)
    first, last = offsets[:-1], offsets[1:]
    unit, point = (_running(m) for m in starts_of(data, offsets))
    n = unit[last] - unit[first]
    x, y = h[0] % (n + 1), h[1] % (n + 1)
    cuts = []
    for units in (np.minimum(x, y), np.maximum(x, y)):
        # the byte whose start is the wanted one of the running sum, the document's end where none is left
        at = np.searchsorted(unit, unit[first] + units + 1, side="left") - 1
        cuts.append(np.minimum(at, last))
    a, b = cuts
    plain = (n == 0) | holds_marker(data, offsets) | (h[2] % 100 >= PLAIN_FROM)
    form = np.where(plain, 0, np.where(h[3] % 100 < SPM_BELOW, 2, 1))
    marks = np.frombuffer("".join(MARKERS).encode(), np.uint8)
    p, s, m = (len(data) + 3 * i + np.zeros(len(n), np.int64) for i in range(3))
    three = np.where(plain, 0, 3)
    spm = form == 2
    rest = last - b
    # six pieces a row: marker, part, marker, part, marker, middle; a plain row is all in the second
    begin = np.stack([np.where(spm, s, p), np.where(plain | ~spm, first, b), np.where(spm, p, s), np.where(spm, first, b), m, a], 1)
    length = np.stack([three, np.where(plain, last - first, np.where(spm, rest, a - first)), three, np.where(plain, 0, np.where(spm, a - first, rest)), three, np.where(plain, 0, b - a)], 1)
    out = _gathered(np.concatenate([data, marks]), begin.ravel(), length.ravel())
    ends = _running(length.sum(1))
    output = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(ends), pa.py_buffer(out))
    return n, form, point[a] - point[first], point[b] - point[a], output


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null where plain) and output of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_groups(batches, GROUP_BYTES):
            columns = group.combine_chunks()
            one = lambda name: columns.column(name).combine_chunks()
            texts = one("text").cast(pa.large_string()).fill_null("")
            h = [one(f"h{i}").to_numpy(zero_copy_only=False) for i in range(4)]
            n, form, before, middle, output = transformed(texts, h)
            whole = form == 0
            yield pa.RecordBatch.from_arrays(
                [one("doc_id"), pa.array(n), pa.array(FORMS[form], pa.string()), pa.array(before, mask=whole), pa.array(middle, mask=whole), output.cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    drawn = [h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed))]
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *drawn), run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output and its form; the markers can only be the ones that were put in."""
    after = lambda mark: F.instr(output, mark) + 3
    p, s, m = MARKERS
    part = lambda start, stop: F.substring(output, start, stop - start)
    psm = F.concat(part(F.lit(4), F.instr(output, s)), F.substring(output, after(m), F.length(output)), part(after(s), F.instr(output, m)))
    spm = F.concat(part(after(p), F.instr(output, m)), F.substring(output, after(m), F.length(output)), part(F.lit(4), F.instr(output, p)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2, ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:], '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y)::BIGINT END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
