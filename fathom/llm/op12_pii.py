r"""Personal data: fixed forms find seeds, their contexts find what the forms miss.

1. A scan finds the base spans of four kinds by fixed forms, and slots: other spans that
   look like an identifier (forms below, or any word with a digit in it).
2. Every span gives patterns: the words before it (one, two, three), after it (one, two), one on
   both sides, and its own shape (digits as 0, runs of letters as a). Patterns and values make a
   graph whose edges are distinct, so that copies of a document count once.
3. Rounds: a pattern's confidence in a kind is the lower bound (Wilson, ``Z``) of the share of its
   distinct values that are known of that kind; base values count 1, accepted ones their score.
   Patterns of ``MIN_CONFIDENCE`` or more score the slots they hold: 1 less the product of
   1 less confidence. A slot's value of ``MIN_SCORE`` or more is accepted as its best kind and
   counts in the next round; there are ``ROUNDS``.
4. All occurrences of an accepted value become spans, wherever they stand.

A slot can only be of a kind whose loose form it has. By its shape it is accepted only if it
passes the kind's own check as well (Luhn, parts to 255, digits), by its contexts also without.

What moves: edges (two 64-bit hashes and bits) once, and in each round those of slots; then one row per document
that holds a slot. Sums are taken map-side; values and patterns that hold many edges are split by
adaptive joins. Nothing is broadcast beyond Spark's own threshold. Patterns and values are told apart by 64-bit hashes.

Defined cases: a null text is empty; texts without spans have counts 0 and empty strings; rows
with a null id are told apart by their text; repeated rows get the same spans; very long texts
are scanned whole in linear time, their slots put out some at a time; a value with equal scores for two kinds is of the first;
columns other than doc_id and text are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import WORD, cut, dropped, identity, map_arrow, stored, table

KINDS = ("email", "ip", "card", "phone")
Z, MIN_CONFIDENCE, MIN_SCORE, ROUNDS = 1.96, 0.7, 0.8, 3
#: Slots per row that a task puts out.
SLOTS = 500

# The base forms. An address is found from its @ on, to the left and to the right.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# The loose forms of slots.
_BEGIN, _END = r"(?<![0-9A-Za-z])(?<![0-9][.:-])", r"(?![0-9A-Za-z]|[.:-][0-9])"
_DOT = r"(?:\.|,|\x20?\[\.\]\x20?|\x20\.\x20)"
_NUMBER = re.compile(
    rf"(?P<ip>{_BEGIN}[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}{_END}|(?<![0-9A-Za-z.:])(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}[0-9A-Fa-f]{{1,4}}(?![0-9A-Za-z:]))"
    rf"|(?P<card>{_BEGIN}[0-9]{{4}}(?:[\x20.-]?[0-9]{{4}}){{2}}[\x20.-]?[0-9]{{1,7}}{_END})"
    rf"|(?P<phone>(?<![0-9A-Za-z])(?<![0-9][.:-])(?:\+?[0-9]{{1,3}}[\x20.-]?)?(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}})[\x20.-]?[0-9]{{3,4}}[\x20.-]?[0-9]{{3,4}}{_END})"
)
_AT = re.compile(r"@|\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20(?=[A-Za-z0-9-]+(?:\.|\x20dot\x20)[A-Za-z])", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20)[A-Za-z0-9-]+)*", re.I)
_DIGITS, _LETTERS = re.compile("[0-9]+"), re.compile(r"[^\W\d_]+")
_WORDS = re.compile(WORD)

SLOT = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string()), ("known", pa.int32()), ("loose", pa.int32()), ("valid", pa.int32()), ("shape", pa.string()), ("contexts", pa.list_(pa.string()))])
SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())])
SLOT_TYPE = "array<struct<start:long,stop:long,value:string,known:int,loose:int,valid:int,shape:string,contexts:array<string>>>"
SCHEMA = f"doc_id long, did long, th long, head boolean, base array<struct<start:long,kind:int,stop:long>>, slots {SLOT_TYPE}"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _local_start(text: str, at: int, floor: int) -> int:
    i = at
    while i > floor and text[i - 1] in _LOCAL:
        i -= 1
    return i


def _valid_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and (len(p.lstrip("0")) < 4 and int(p) <= 255) for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, stop) by the fixed forms, in order."""
    found = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = _local_start(text, at, end)
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if _DIGITS.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _valid_ip(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found)


def _candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, stop, bits of the kinds whose loose form it has) of what looks like an identifier outside the base spans, in order."""
    gaps, at = [], 0
    for start, _, stop in base:
        if start > at:
            gaps.append((at, start))
        at = max(at, stop)
    gaps.append((at, len(text)))
    for begin, end in gaps:
        taken, floor = [], begin
        for m in _AT.finditer(text, begin, end):
            start = _local_start(text, m.start(), floor)
            host = _HOST.match(text, m.end(), end) if start < m.start() else None
            if host:
                taken.append((start, host.end(), 1))
                floor = host.end()
        spans = [(m.start(), m.end(), _bits(m)) for m in _NUMBER.finditer(text, begin, end)]
        floor = begin
        for start, stop, bits in sorted(taken + spans, key=lambda s: (s[0], -s[1])):
            if start >= floor:
                yield start, stop, bits
                floor = stop


def _bits(m: re.Match) -> int:
    n = len(digits_of(m[0]))
    if m.lastgroup == "ip":
        return 2
    return (4 if 12 <= n <= 19 else 0) | (8 if 7 <= n <= 15 else 0)


def _passing(value: str) -> int:
    """Bits of the kinds whose own check the value passes."""
    d = digits_of(value)
    return (2 if _valid_ip(value) else 0) | (4 if 12 <= len(d) <= 19 and luhn(d) else 0) | (8 if value.startswith("+") and 9 <= len(d) <= 15 else 0)


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], Iterator[dict]]:
    """A text's base spans, and all its slots with their patterns, base spans among them."""
    base = base_spans(text)
    loose = list(_candidates(text, base))
    if not base and not loose and not _DIGITS.search(text):
        return base, iter(())
    return base, _slots(text, base, loose)


def _slots(text: str, base: list, loose: list) -> Iterator[dict]:
    words = [m.span() for m in _WORDS.finditer(text)]
    every = [(a, b, 1 << k, 0) for a, k, b in base] + [(a, b, 0, bits) for a, b, bits in loose]
    every += [(a, b, 0, 0) for a, b in _odd_words(text, words, sorted((a, b) for a, b, *_ in every))]
    every.sort()
    pieces = _pieces(words, sorted({x for a, b, *_ in every for x in (a, b)}))
    starts = [a for a, _ in pieces]
    said = lambda part: " ".join(_DIGITS.sub("0", text[a:b].lower()) for a, b in part)
    for a, b, known, bits in every:
        first, last = bisect_left(starts, a), bisect_left(starts, b)
        left = [said(pieces[max(first - n, 0) : first]) if first >= n else "^" + said(pieces[:first]) for n in (1, 2, 3)]
        right = [said(pieces[last : last + n]) if last + n <= len(pieces) else said(pieces[last:]) + "$" for n in (1, 2)]
        contexts = [*(f"{x} _" for x in left), *(f"_ {x}" for x in right), f"{left[0]} _ {right[0]}"]
        value = text[a:b]
        shape = _LETTERS.sub("a", _DIGITS.sub(lambda m: "0" * len(m[0]), value))
        yield {"start": a, "stop": b, "value": value.lower(), "known": known, "loose": bits, "valid": bits & _passing(value), "shape": shape, "contexts": contexts}


def _odd_words(text: str, words: list, filled: list) -> Iterator[tuple[int, int]]:
    """Words with digits in them that no other slot touches: they're of no kind, and tell against a pattern."""
    starts = [a for a, _ in words]
    done, i, reach = -1, 0, -1
    for m in _DIGITS.finditer(text):
        w = bisect_right(starts, m.start()) - 1
        if w == done:
            continue
        done = w
        while i < len(filled) and filled[i][0] < words[w][1]:
            reach = max(reach, filled[i][1])
            i += 1
        if reach <= words[w][0]:
            yield words[w]


def _pieces(words: list, cuts: list[int]) -> list[tuple[int, int]]:
    """Words, cut where slots begin and end, so that each piece is near few slots however long its word is."""
    out, i = [], 0
    for a, b in words:
        while i < len(cuts) and cuts[i] <= a:
            i += 1
        while i < len(cuts) and cuts[i] < b:
            out.append((a, cuts[i]))
            a = cuts[i]
            i += 1
        out.append((a, b))
    return out


def scanned(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text) its base spans (``head`` rows) and its slots, some to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i) for i in range(3)]
            ids, dids, ths = (k.to_pylist() for k in keys)
            rows: list[tuple] = []
            held = 0
            for i, text in enumerate(batch.column(3).to_pylist()):
                base, slots = spans_of(text or "")
                part: list[dict] = []
                head = True
                for slot in slots:
                    part.append(slot)
                    held += 1
                    if len(part) == SLOTS:
                        rows.append((ids[i], dids[i], ths[i], head, _structs(base) if head else [], part))
                        part, head = [], False
                    if held >= 8 * SLOTS and not part:
                        yield _batch(rows)
                        rows, held = [], 0
                if part or head:
                    rows.append((ids[i], dids[i], ths[i], head, _structs(base) if head else [], part))
                if held >= 8 * SLOTS:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)

    rows = identity(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_fathom_did").alias("did"), F.col("_fathom_th").alias("th"), "text")
    return map_arrow(rows, run, SCHEMA)


def _structs(base: list) -> list[dict]:
    return [{"start": a, "kind": k, "stop": b} for a, k, b in base]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(SPAN), pa.list_(SLOT)]
    columns = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "did", "th", "head", "base", "slots"])


def _bit(column: str, kind: int) -> Column:
    return F.col(column).bitwiseAND(F.lit(1 << kind)) != 0


def slots_of(scan: DataFrame) -> DataFrame:
    return scan.select("did", "th", F.explode("slots").alias("s")).select("did", "th", "s.*")


def graph(slots: DataFrame) -> DataFrame:
    """The distinct edges: pattern and value as hashes, the kinds that the value is known as, and those it may be accepted as by this pattern."""
    shape = F.struct(F.xxhash64(F.lit("shape"), "shape").alias("pattern"), F.col("valid").alias("may"))
    context = F.transform("contexts", lambda c: F.struct(F.xxhash64(F.lit("context"), c).alias("pattern"), F.col("loose").alias("may")))
    rows = slots.select(F.xxhash64("value").alias("value"), "known", F.explode(F.concat(F.array(shape), context)).alias("e"))
    return rows.select("e.pattern", "value", "known", "e.may").groupBy("pattern", "value").agg(F.bit_or("known").alias("known"), F.bit_or("may").alias("may"))


def lower_bound(share: Column, n: Column, z: float = Z) -> Column:
    """Wilson's lower bound of a share among n."""
    z2 = z * z
    return (share + z2 / (2 * n) - z * F.sqrt((share * (1 - share) + z2 / (4 * n)) / n)) / (1 + z2 / n)


def confident(counts: DataFrame, gained: DataFrame | None = None) -> DataFrame:
    """pattern, kind, confidence of the patterns that are sure enough."""
    ks = [f"k{i}" for i in range(len(KINDS))]
    rows = counts
    if gained is not None:
        rows = counts.join(gained, "pattern", "left")
        ks = [F.col(k) + F.coalesce(F.col(f"g{k[1:]}"), F.lit(0.0)) for k in ks]
    shares = [F.least(F.lit(1.0), (F.col(k) if isinstance(k, str) else k) / F.col("n")) for k in ks]
    best = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), s.alias("share")) for i, s in enumerate(shares)])).alias("b")
    rows = rows.select("pattern", "n", best).where("b.share > 0")
    return rows.select("pattern", "b.kind", lower_bound(F.col("b.share"), F.col("n")).alias("confidence")).where(F.col("confidence") >= MIN_CONFIDENCE)


def accepted(edges: DataFrame, good: DataFrame) -> DataFrame:
    """value, kind, score of the slots that confident patterns hold, one kind each."""
    held = edges.join(good, "pattern").where(F.expr("may & shiftleft(1, kind) <> 0"))
    scored = held.groupBy("value", "kind").agg(F.sum(F.log1p(-F.col("confidence"))).alias("miss"))
    scored = scored.select("value", "kind", F.round(1 - F.exp("miss"), 9).alias("score")).where(F.col("score") >= MIN_SCORE)
    return scored.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("order"))).alias("b")).select("value", (-F.col("b.order")).alias("kind"), "b.score")


def bootstrapped(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The confident patterns and the accepted values after some rounds. ``edges`` is read several times."""
    known = [F.sum(_bit("known", i).cast("double")).alias(f"k{i}") for i in range(len(KINDS))]
    counts = cut(edges.groupBy("pattern").agg(F.count(F.lit(1)).cast("double").alias("n"), *known))
    open_edges = edges.where("known = 0 AND may <> 0").select("pattern", "value", "may")
    good = cut(confident(counts))
    values = cut(accepted(open_edges, good))
    for _ in range(rounds - 1):
        gains = [F.sum(F.when(F.col("kind") == i, F.col("score")).otherwise(0.0)).alias(f"g{i}") for i in range(len(KINDS))]
        # all edges of an accepted value tell of their patterns, also those that could not have accepted it
        gained = edges.where("known = 0").select("pattern", "value").join(values, "value").groupBy("pattern").agg(*gains)
        good = cut(confident(counts, gained))
        values = cut(accepted(open_edges, good))
    return good, values


def patterns(slots: DataFrame, good: DataFrame) -> DataFrame:
    """Confident patterns as text: pattern, kind, confidence."""
    shape = F.struct(F.xxhash64(F.lit("shape"), "shape").alias("pattern"), F.concat(F.lit("shape "), "shape").alias("text"))
    context = F.transform("contexts", lambda c: F.struct(F.xxhash64(F.lit("context"), c).alias("pattern"), c.alias("text")))
    named = slots.select(F.explode(F.concat(F.array(shape), context)).alias("p")).select("p.*").groupBy("pattern").agg(F.min("text").alias("text"))
    return good.join(named, "pattern").select(F.col("text").alias("pattern"), F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("kind"), "confidence")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, in order, with commas between."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind's number and stop) of every row."""
    spark = docs.sparkSession
    scan, _ = stored(scanned(docs))
    edges, edges_path = stored(graph(slots_of(scan)))
    _, values = bootstrapped(edges)
    dropped(spark, edges_path)
    heads = scan.where("head")
    bare = heads.where(F.size("slots") == 0).select("doc_id", "base", F.col("base").alias("spans"))  # nothing to add
    found = slots_of(scan).where("known = 0 AND loose <> 0").select("did", "th", "start", "stop", F.xxhash64("value").alias("value")).join(values.select("value", "kind"), "value")
    added = found.groupBy("did", "th").agg(F.collect_set(F.struct("start", "kind", "stop")).alias("added"))
    none = F.array().cast("array<struct<start:long,kind:int,stop:long>>")
    spans = F.array_sort(F.concat("base", F.coalesce("added", none)))
    rest = heads.where(F.size("slots") > 0).select("doc_id", "did", "th", "base").join(added, ["did", "th"], "left")
    return bare.union(rest.select("doc_id", "base", spans.alias("spans")))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are of base spans."""
    rows = extract(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
