"""Exact-substring dedup of 200-byte strings by a distributed, sampled suffix array.

A suffix per byte would move 200 times the corpus. Instead every window of
``LENGTH`` bytes is filed under its anchor: the least hash among the 32-byte
grams in it, the leftmost of equals. Equal windows have equal anchors at equal
places, so only suffixes at the same anchor text can be equal. Consecutive
windows with one anchor form a segment (at most 368 bytes, one per 85 bytes of
text on average).

1. One pass over the texts gives each anchored suffix as a few numbers: its rank (its
   six leading bytes, then 16 bits of the anchor's hash), the hashes of anchor and
   segment, and its place.
2. Suffixes are range-partitioned by rank, with splitters that Spark samples, and sorted
   by rank, anchor and segment. Neighbours of equal rank and equal 64-bit hashes of
   anchor and segment are repeated as a whole; anchors that occur once drop out. What is
   left are segments that share an anchor and differ somewhere: the ends of shared
   passages, and edited copies. A hot anchor is dealt out by its segments' hash.
3. Those fetch their bytes, and go to buckets that are ranges of ranks between sampled
   splitters; an anchor that is too large for a bucket is dealt over several.
4. Each bucket sorts its windows by multikey quicksort on 8-byte tokens; windows
   still together after 200 bytes are equal.
5. Anchors that reach over several buckets are compared across the boundaries:
   first by a digest of what CELL neighbouring windows have in common, and only
   where that occurs in more than one bucket, window by window.
6. Spans return to their documents, where the bytes are cut.

Defined cases: null and empty texts, and texts under 200 bytes, lose nothing; very
long texts are hashed in blocks, and a place is a long, so that only a task's memory
bounds a text; windows never cross documents; repeated rows are copies of each other;
null ids are told apart by their text; an empty table gives no row; extra columns,
whatever their names (but for ``_fathom_`` in front), stay as they are in the stage
and are ignored by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import cut, dropped, identity, in_groups, map_arrow, stored, table

LENGTH, GRAM = 200, 32
WINDOW = LENGTH - GRAM + 1
#: Leading bytes of an anchored suffix in its rank.
LEAD = 6
#: Window starts hashed at a time; a segment ends at a block's end at the latest.
BLOCK = 1 << 19
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64(0xFFFFFF)


def words64(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, for all places that have 8."""
    n = len(data) - 7
    out = np.empty(max(n, 0), np.uint64)
    raw = data.tobytes()
    for i in range(min(8, max(n, 0))):
        got = np.frombuffer(raw, "<u8", (len(raw) - i) // 8, i)
        out[i::8] = got[: len(out[i::8])]
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    m = words64(data)
    m *= _A
    m ^= m >> np.uint64(31)
    m *= _B
    n = len(data) - GRAM + 1
    h = m[:n].copy()
    for i in range(8, GRAM, 8):
        h *= _C
        h += m[i : i + n]
    h ^= h >> np.uint64(30)
    h *= _B
    h ^= h >> np.uint64(27)
    return h


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per window start: where its anchor is, and the hash of that gram."""
    h = gram_hashes(data)
    ranked = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    span, least = 1, ranked
    while 2 * span <= WINDOW:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    n = len(data) - LENGTH + 1
    least = np.minimum(least[:n], least[WINDOW - span : WINDOW - span + n])
    return (least & _LOW).astype(np.int64), h


def segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, start in the row, windows, the anchor's distance, rank, anchor hash, segment hash) over concatenated texts."""
    raw = data.tobytes()
    starts, ends = offsets[:-1], offsets[1:]
    total = len(data)
    for s in range(0, max(total - LENGTH + 1, 0), BLOCK):
        e = min(s + BLOCK, total - LENGTH + 1)
        at, h = anchors(data[s : e + LENGTH - 1])
        rows = np.searchsorted(ends, np.arange(s, e), side="right")
        valid = np.arange(s + LENGTH, e + LENGTH) <= ends[rows]
        new = np.empty(e - s, bool)
        new[0] = True
        new[1:] = (at[1:] != at[:-1]) | (rows[1:] != rows[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], e - s)
        good = valid[first]
        first, last = first[good], last[good]
        if len(first) == 0:
            continue
        digest = xxhash.xxh64_intdigest
        whole = np.fromiter((digest(raw[a:b]) for a, b in zip((first + s).tolist(), (last + s + LENGTH - 1).tolist())), np.uint64, len(first))
        row = rows[first]
        anchor = at[first]
        yield row, first + s - starts[row], last - first, anchor - first, ranks(data, anchor + s, h[anchor]), h[anchor], whole


def ranks(data: np.ndarray, anchor: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The anchored suffix's six leading bytes, and as ties 16 bits of its anchor's hash, as a number in signed order."""
    lead = np.zeros(len(anchor), np.uint64)
    for i in range(LEAD):
        lead = (lead << np.uint64(8)) | data[anchor + i]
    return (((lead << np.uint64(16)) | (h & np.uint64(0xFFFF))) ^ np.uint64(1 << 63)).view(np.int64)


def binary(batch: pa.RecordBatch | pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and offsets; nulls are empty."""
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


# ---- 1: segments ----

# A place is its start in the text, a long, and its shape: the anchor's distance from the start, and the number of windows.
AT = 8
#: An anchor with this share of all segments is hot, and is dealt out by segment.
HOT_SHARE, HOT_LEAST = 10_000, 5_000
SALTS = 256


SEGMENT = "kind int, rank long, key long, whole long, did long, th long, start long, shape int, dup int"


def _segments(docs: DataFrame) -> DataFrame:
    """kind 0: segments; 1: spans that repeat within a batch (one segment of each stays, marked dup); 2: frequent anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_groups(batches, 4 << 20):
            data, offsets = binary(part, "text")
            did, th = part.column("_fathom_did").to_numpy(), part.column("_fathom_th").to_numpy()
            found = list(segments(data, offsets))
            if not found:
                continue
            row, start, n, distance, rank, key, whole = (np.concatenate(x) for x in zip(*found))
            shape = ((distance << AT) | n).astype(np.int32)
            key, whole, did, th = key.view(np.int64), whole.view(np.int64), did[row], th[row]
            order = np.lexsort((whole, key, rank))
            r, k, w = rank[order], key[order], whole[order]
            new = np.append(True, (r[1:] != r[:-1]) | (k[1:] != k[:-1]) | (w[1:] != w[:-1]))
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(k)))
            again = np.repeat(size > 1, size)
            one = order[first]
            yield _rows(0, rank[one], key[one], whole[one], did[one], th[one], start[one], shape[one], (size > 1).astype(np.int32))
            if again.any():
                spans = order[again]
                z = np.zeros(len(spans), np.int64)
                yield _rows(1, z, z, z, did[spans], th[spans], start[spans], shape[spans], z.astype(np.int32))
            keys, counts = np.unique(key[one], return_counts=True)
            often = counts >= max(3, len(one) / HOT_SHARE)
            if often.any():
                z = np.zeros(often.sum(), np.int64)
                yield _rows(2, z, keys[often], z, counts[often], z, z, z.astype(np.int32), z.astype(np.int32))

    return map_arrow(identity(docs.select("doc_id", "text")).select("_fathom_did", "_fathom_th", "text"), run, SEGMENT)


_COLUMNS = ("rank", "key", "whole", "did", "th", "start", "shape", "dup")


def _rows(kind: int, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], ["kind", *_COLUMNS])


def _repeated(rows: dict) -> pa.RecordBatch:
    """Spans that are repeated as a whole."""
    z = np.zeros(len(rows["did"]), np.int64)
    return _rows(1, z, z, z, rows["did"], rows["th"], rows["start"], rows["shape"], z.astype(np.int32))


# ---- 2: segments that are repeated as a whole, and those to be looked at ----

#: Segments of one anchor that are held at a time.
HELD = 200_000


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over segments sorted by rank, anchor and whole. kind 1: repeated as a whole; kind 3: to be looked at (dup: only as a witness)."""

    def out(rows: dict, forced: bool) -> list[pa.RecordBatch]:
        key, whole = rows["key"], rows["whole"]
        n = len(key)
        if n == 0:
            return []
        new_key = _changes(rows)
        new = new_key | np.append(True, whole[1:] != whole[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        many = (size > 1) | (np.maximum.reduceat(rows["dup"], first) > 0)
        runs = np.bincount(np.cumsum(new_key[first]) - 1)
        look = forced | np.repeat(runs > 1, runs)
        got = []
        covered = np.repeat(many, size) & (rows["dup"] == 0)
        if covered.any():
            got.append(_repeated({c: rows[c][covered] for c in _COLUMNS}))
        if look.any():
            at = first[look]
            got.append(_rows(3, *(rows[c][at] for c in _COLUMNS[:-1]), many[look].astype(np.int32)))
        return got

    held, forced_key = None, None
    for part in in_groups(batches, 4 << 20):
        rows = {c: part.column(c).to_numpy() for c in (*_COLUMNS, "hot")}
        if held is not None:
            rows = {c: np.concatenate((held[c], rows[c])) for c in rows}
        last = int(np.flatnonzero(_changes(rows))[-1])
        yield from _forced(out, {c: v[:last] for c, v in rows.items()}, forced_key)
        held = {c: v[last:] for c, v in rows.items()}
        if len(held["key"]) > HELD:  # a large anchor: looked at in any case, run by run
            forced_key = int(held["key"][0])
            whole = held["whole"]
            cut_at = int(np.flatnonzero(np.append(True, whole[1:] != whole[:-1]))[-1])
            yield from out({c: v[:cut_at] for c, v in held.items()}, True)
            held = {c: v[cut_at:] for c, v in held.items()}
            if len(held["key"]) > HELD:  # and so is its last run: one row stays for it
                yield _repeated({c: v[held["dup"] == 0] for c, v in held.items()})
                held = {c: v[:1].copy() for c, v in held.items()}
                held["dup"][:] = 1
    if held is not None:
        yield from _forced(out, held, forced_key)


def _changes(rows: dict) -> np.ndarray:
    """Where another anchor begins."""
    rank, key = rows["rank"], rows["key"]
    return np.append(True, (rank[1:] != rank[:-1]) | (key[1:] != key[:-1]))


def _forced(out, rows: dict, forced_key: int | None) -> Iterator[pa.RecordBatch]:
    """Hot anchors are spread over tasks, so each task takes them as shared."""
    force = (rows["hot"] > 0) | (rows["key"] == forced_key) if forced_key is not None else rows["hot"] > 0
    for f in (False, True):
        at = force if f else ~force
        if at.any():
            yield from out({c: v[at] for c, v in rows.items()}, f)


# ---- 3 to 5: the suffixes ----

#: Segments of one anchor in one bucket at most; with more, the anchor is dealt over several.
GROUP = 2_000
SAMPLE = 4_096
#: Splitters at most; with more buckets each range is dealt over several.
RANGES = 512
BUCKET_BYTES = 4 << 20


def multikey_quicksort(words: np.ndarray, starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts suffixes by group and then token by token (8 bytes), up to LENGTH bytes.

    Each round partitions the suffixes that still share their group and all
    tokens so far by the next token. A part whose next tokens are all equal stays
    as it is; suffixes alone in their part are done and drop out. Returns those
    that are left at the end, as indexes and part numbers, part by part.
    """
    index = np.arange(len(starts))
    part = np.unique(group, return_inverse=True)[1] if len(group) else group
    order = np.argsort(part, kind="stable")
    index, part = _together(index[order], part[order])
    for depth in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        if len(index) == 0:
            break
        token = words[starts[index] + depth]
        differ = (part[1:] == part[:-1]) & (token[1:] != token[:-1])
        if not differ.any():
            continue
        mixed = np.zeros(part.max() + 1, bool)
        mixed[part[1:][differ]] = True
        sort = mixed[part]
        i, k, t = index[sort], part[sort], token[sort]
        order = np.lexsort((t, k))
        i, k, t = i[order], k[order], t[order]
        split = np.cumsum((k[1:] != k[:-1]) | (t[1:] != t[:-1]))
        i, k = _together(i, np.append(0, split))
        index, part = np.concatenate((index[~sort], i)), np.concatenate((part[~sort], k + len(mixed)))
        part = np.cumsum(np.append(False, part[1:] != part[:-1])) if len(part) else part
    return index, part


def _together(index: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.bincount(part)[part] > 1 if len(part) else np.zeros(0, bool)
    return index[keep], part[keep]


#: Neighbouring windows that cross boundaries together.
CELL = 16
FOUND = "kind int, bucket int, did long, th long, start long, n int, h1 long, h2 long, windows binary"
#: A window in a cell: its start from the segment's, whether it wants an answer, its digest.
_WINDOW = np.dtype([("t", "<i2"), ("want", "<i2"), ("h1", "<i8"), ("h2", "<i8")])


def _sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over segments' bytes sorted by rank and anchor. kind 1: n bytes from start are repeated; kind 4: cells of anchors dealt over buckets."""

    def solve(part: pa.Table) -> Iterator[pa.RecordBatch]:
        data, offsets = binary(part, "content")
        start, th, did, shape = (part.column(c).to_numpy() for c in ("start", "th", "did", "shape"))
        dup, wide = part.column("dup").to_numpy() > 0, part.column("wide").to_numpy() > 0
        n, distance = (shape & 255).astype(np.int64), (shape >> AT).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        t = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        starts = offsets[:-1][row] + t
        anchor = np.cumsum(_changes({c: part.column(c).to_numpy() for c in ("rank", "key")}))
        group = anchor[row] * 256 + distance[row] - t
        index, same = multikey_quicksort(words64(data), starts, group)
        hit = np.zeros(len(row), bool)
        hit[index] = True
        want = hit & ~dup[row]
        at = np.flatnonzero(want)
        if len(at):
            first = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])))
            size = np.diff(np.append(first, len(at)))
            a = at[first]
            yield _found(1, did[row[a]], th[row[a]], start[row[a]] + t[a], size + LENGTH - 1)
        if wide.any():
            once = np.ones(len(row), bool)
            once[index] = False
            if len(index):
                once[index[np.unique(same, return_index=True)[1]]] = True
            at = np.flatnonzero(once & wide[row])
            cell = (distance[row[at]] - t[at]) // CELL
            first = np.flatnonzero(np.append(True, (row[at[1:]] != row[at[:-1]]) | (cell[1:] != cell[:-1]))) if len(at) else at
            last = np.append(first[1:], len(at)) if len(at) else at
            raw = data.tobytes()
            each = np.zeros(len(at), _WINDOW)
            each["t"], each["want"] = t[at], ~hit[at] & ~dup[row[at]]
            each["h1"], each["h2"] = _digests(raw, starts[at], starts[at] + LENGTH)
            one = row[at[first]]
            begin = offsets[:-1][one] + distance[one] - cell[first] * CELL
            h1, h2 = _digests(raw, begin, begin - (CELL - 1) + LENGTH)
            windows = [each[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist())]
            if windows:
                yield _found(4, did[one], th[one], start[one], np.zeros(len(one)), h1, h2, part.column("bucket").to_numpy()[one], windows)

    held: list[pa.Table] = []
    for part in in_groups(batches, 1 << 20):
        held.append(part)
        if sum(x.nbytes for x in held) < BUCKET_BYTES:
            continue
        whole = pa.concat_tables(held).combine_chunks()
        last = int(np.flatnonzero(_changes({c: whole.column(c).to_numpy() for c in ("rank", "key")}))[-1])
        if last:
            yield from solve(whole.slice(0, last))
            held = [whole.slice(last)]
    if held:
        yield from solve(pa.concat_tables(held).combine_chunks())


def _digests(raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(raw[s:e]) for s, e in zip(begin.tolist(), end.tolist())]), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _found(kind: int, did, th, start, n, h1=None, h2=None, bucket=None, windows=None) -> pa.RecordBatch:
    z = np.zeros(len(did), np.int64)
    columns = [np.full(len(did), kind, np.int32), (z if bucket is None else bucket).astype(np.int32), did, th, start, np.asarray(n).astype(np.int32), z if h1 is None else h1, z if h2 is None else h2]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([None] * len(did) if windows is None else windows, pa.binary())], ["kind", "bucket", "did", "th", "start", "n", "h1", "h2", "windows"])


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        windows = batch.column("windows").to_pylist()
        each = np.frombuffer(b"".join(windows), _WINDOW)
        row = np.repeat(np.arange(len(windows)), [len(w) // _WINDOW.itemsize for w in windows])
        did, th, start = (batch.column(c).to_numpy()[row] for c in ("did", "th", "start"))
        yield _found(5, did, th, start + each["t"], np.where(each["want"] > 0, LENGTH, 0), each["h1"].copy(), each["h2"].copy())


def across(cells: DataFrame) -> DataFrame:
    """did, th, start and n of windows that wanted an answer and occur in another bucket."""
    cores = cut(cells.groupBy("h1", "h2").agg(F.min("bucket").alias("x"), F.max("bucket").alias("y")).where("x < y").select("h1", "h2"))
    single = cut(map_arrow(cells.join(cores, ["h1", "h2"]).select("did", "th", "start", "windows"), _single_windows, FOUND))
    shared = cut(single.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h1", "h2"))
    return single.where("n > 0").join(shared, ["h1", "h2"]).select("did", "th", "start", "n")


def packed(docs: DataFrame) -> DataFrame:
    """The rows with _fathom_did and _fathom_th, and the text's bytes compressed in _fathom_z instead of the text."""
    rows = identity(docs)
    names = [c for c in rows.columns if c != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"] + ["_fathom_z binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([press.compress(t or b"") for t in texts], pa.binary())], [*names, "_fathom_z"])

    return map_arrow(rows, run, schema)


SQL_TYPES = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
CONTENT = {"bucket": pa.int32(), "rank": pa.int64(), "key": pa.int64(), "did": pa.int64(), "th": pa.int64(), "start": pa.int64(), "shape": pa.int32(), "dup": pa.int32(), "wide": pa.int32(), "content": pa.binary()}


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text."""
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        rows: list[tuple] = []
        for did, th, z, wanted in zip(*(batch.column(c).to_pylist() for c in ("_fathom_did", "_fathom_th", "_fathom_z", "wanted"))):
            data = unpress.decompress(z)
            for w in wanted:
                start = w["start"]
                rows.append((w["bucket"], w["rank"], w["key"], did, th, start, w["shape"], w["dup"], w["wide"], data[start : start + (w["shape"] & 255) + LENGTH - 1]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), CONTENT.values())], list(CONTENT))


def buckets(looked: DataFrame) -> tuple[DataFrame, int]:
    """Adds the bucket: ranges of ranks between sampled splitters; large anchors over several buckets (wide)."""
    spark = looked.sparkSession
    n = looked.count()
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 40_000))
    step = max(1, n // SAMPLE)
    sample = sorted(r["rank"] for r in looked.where(F.pmod(F.xxhash64("did", "th", "start"), F.lit(step)) == 0).select("rank").limit(4 * SAMPLE).collect())
    ranges = min(count, RANGES)
    splitters = sample[:: max(1, len(sample) // ranges)][1:ranges]
    group = min(GROUP, max(256, 4 * n // count))
    large = cut(looked.groupBy("rank", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > group))
    dealt = looked.join(large, ["rank", "key"], "left")
    per = -(-count // ranges)
    count = ranges * per
    ranged = _bisect(F.col("rank"), splitters) * per + F.pmod(F.xxhash64("key"), F.lit(per))
    spread = F.pmod(F.xxhash64("key") + F.pmod(F.xxhash64("did", "th", "start"), F.ceil(F.col("size") / group)), F.lit(count))
    return dealt.withColumn("bucket", F.when(F.col("size").isNull(), ranged).otherwise(spread).cast("int")).withColumn("wide", F.col("size").isNotNull().cast("int")).drop("size"), count


def _bisect(column, splitters: list[int], low: int = 0, high: int | None = None):
    """The number of splitters up to the value, by halving."""
    high = len(splitters) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(column < F.lit(splitters[mid]), _bisect(column, splitters, low, mid)).otherwise(_bisect(column, splitters, mid + 1, high))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """did, th, and the spans (start, n) of a text's bytes that are in a repeated string of LENGTH; spans overlap."""
    spark = docs.sparkSession
    made, path = stored(_segments(docs))
    total = made.where("kind = 0").count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 400_000))
    # anchors with a ten-thousandth of all segments: at most as many rows as that says
    hot = made.where("kind = 2").groupBy("key").agg(F.sum("did").alias("c")).where(F.col("c") >= max(HOT_LEAST, total // HOT_SHARE)).select("key", F.lit(1).alias("hot"))
    rows = made.where("kind = 0").join(F.broadcast(hot), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
    salt = F.when(F.col("hot") > 0, F.pmod("whole", F.lit(SALTS))).otherwise(F.lit(0))
    dealt = rows.select(*_COLUMNS, "hot", salt.alias("salt")).repartitionByRange(parts, "rank", "key", "salt").sortWithinPartitions("rank", "key", "whole").select(*_COLUMNS, "hot")
    known, known_at = stored(map_arrow(dealt, _classify, SEGMENT).union(made.where("kind = 1")))
    dropped(spark, path)
    looked, count = buckets(known.where("kind = 3").select(*_COLUMNS))
    wanted = looked.groupBy("did", "th").agg(F.collect_list(F.struct("bucket", "rank", "key", "start", "shape", "dup", "wide")).alias("wanted"))
    texts = packed(docs.select("doc_id", "text")).select("_fathom_did", "_fathom_th", "_fathom_z")
    bytes_of = texts.join(wanted, (texts._fathom_did == wanted.did) & (texts._fathom_th == wanted.th)).select("_fathom_did", "_fathom_th", "_fathom_z", "wanted")
    content = map_arrow(bytes_of, _fetch, ", ".join(f"{c} {SQL_TYPES[t]}" for c, t in CONTENT.items()))
    found, found_at = stored(map_arrow(content.repartitionById(count, F.col("bucket")).sortWithinPartitions("rank", "key"), _sort_bucket, FOUND))
    spans = known.where("kind = 1").select("did", "th", "start", (F.col("shape").bitwiseAND(F.lit(255)) + LENGTH - 1).cast("int").alias("n"))
    spans = spans.union(found.where("kind = 1").select("did", "th", "start", "n")).union(across(found.where("kind = 4")))
    by_text, _ = stored(spans.groupBy("did", "th").agg(F.collect_set(F.struct("start", "n")).alias("spans")))
    dropped(spark, known_at)
    dropped(spark, found_at)
    return by_text


def merged(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Sorted, joined [start, end) of spans of start and n."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], min(s["start"] + s["n"], size)) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame) -> DataFrame:
    """The rows without their text, with its bytes in _fathom_z and the spans to remove in _fathom_spans (null: none)."""
    by_text = repeated_spans(docs).withColumnsRenamed({"did": "_fathom_d", "th": "_fathom_t", "spans": "_fathom_spans"})
    return packed(docs).join(by_text, (F.col("_fathom_did") == F.col("_fathom_d")) & (F.col("_fathom_th") == F.col("_fathom_t")), "left").drop("_fathom_d", "_fathom_t", "_fathom_did", "_fathom_th")


def _kept(z: bytes, spans: list[dict] | None, unpress) -> tuple[bytes, list[tuple[int, int]], int]:
    data = unpress.decompress(z)
    cuts = merged(spans, len(data)) if spans else []
    at, parts = 0, []
    for a, b in cuts:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]]), cuts, len(data)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            got = [_kept(z, s, unpress) for z, s in zip(batch.column("_fathom_z").to_pylist(), batch.column("_fathom_spans").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([n for _, _, n in got], pa.int64()), pa.array([n - len(k) for k, _, n in got], pa.int64()), pa.array([len(c) for _, c, _ in got], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k, _, _ in got], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return map_arrow(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated strings; characters that a cut breaks go. n_chars follows the text."""
    rows = with_spans(docs)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    chars = docs.schema["n_chars"].dataType.simpleString() if "n_chars" in names else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = [_kept(z, s, unpress)[0].decode("utf-8", "ignore") for z, s in zip(batch.column("_fathom_z").to_pylist(), batch.column("_fathom_spans").to_pylist())]
            made = {"text": pa.array(texts, pa.string())}
            if chars:
                made["n_chars"] = pa.array([len(t) for t in texts], pa.int32() if chars == "int" else pa.int64())
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names)

    return map_arrow(rows, run, schema)


ORACLE_SQL = None
