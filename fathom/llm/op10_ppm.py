"""Language-model scoring by prediction by partial matching over bytes.

The trie of byte contexts (up to ``ORDER`` bytes before a symbol) is learned from
all training texts. Prediction starts at the longest context the trie knows; a
symbol not seen there escapes to the next shorter context, by method C: a context
seen N times with q symbols escapes with weight q. Symbols of the longer context
are excluded in the shorter one, and after the empty context the symbols never
seen are equally likely. A text is lower-cased (A-Z), preceded by start marks and
followed by one end symbol; its score is the sum of log10 probabilities.

Counting covers all training texts, and every node stays, so the trie grows with the
corpus. Chunks of text give their sorted distinct grams with training counts, in the
order of the context read backwards. Splitters, sampled from that order, cut it into
ranges of about equal load, one per owner, so contexts that share an ending of any
length can be dealt over several owners. An owner sums its range to a part of the trie,
and sends each chunk what the logs of its grams are made of. What a part can't count by
itself is broadcast: orders 0 to 2 (2**24 nodes at most), and the contexts of orders 3
to 5 that a splitter lies in (three contexts, 768 nodes, per splitter at most).

The base score needs each word's count in the training texts. A word goes once
per chunk to the task that owns its hash, and the counts come back to the chunk,
so neither frequent nor rare words gather documents anywhere. A chunk's texts are
stored compressed; both scores are then read off the chunk in one go, from the
words' counts and the grams' logs.

Sizes: chunks have CHUNK_BYTES, and owners are half as many as chunks, so that the
load of a task stays the same; each chunk has a block per owner, as in any shuffle, and
the blocks grow with the square of the chunks. With very large corpora, raise CHUNK_BYTES.

Defined cases: null texts are empty, and score their end symbol; null ids are
training rows; repeated rows are scored each; a very long text is a chunk of its own,
held as a whole by its task; extra columns are ignored; without any training row the
trie is empty (all symbols equally likely) and N is 0; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import cut, dropped, in_groups, map_arrow, release, stored, table

ORDER = 6
SHORT = 2
CHUNK_BYTES = 8 << 20
HELD_MOD, HELD_REST = 7, 2
#: Bytes that no UTF-8 text has.
START_MARK, END_MARK = 0xFE, 0xFF
ALPHABET = 256  # the other bytes and the end

CHUNK = "kind int, chunk string, owner int, a binary, b binary, ids array<long>, texts binary, n long"


def squeeze(values: np.ndarray) -> bytes:
    """An integer array, by planes of bytes, compressed."""
    width = values.dtype.itemsize
    return values.dtype.str.encode().ljust(4) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:4].strip().decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data), dtype=np.uint64)


def turned(grams_: np.ndarray) -> np.ndarray:
    """The context's bytes in the other order, the last one first; turned twice, a gram is itself."""
    b = np.ascontiguousarray(grams_).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(b[:, [0, *range(ORDER, 0, -1), ORDER + 1]]).view(np.uint64).reshape(-1)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_MOD == HELD_REST


# ---- what a chunk holds ----


def split_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the chunk's distinct words; each occurrence's place in them; words per text."""
    known: dict[bytes, int] = {}
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.split()
        sizes[i] = len(words)
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(map(digest, known), np.uint64, len(known))
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    at = rank[np.concatenate(parts)] if len(known) else np.zeros(0, np.int32)
    return hashes[order], at, sizes


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol with its ORDER bytes before it as one number, and where each text starts."""
    mark = bytes([START_MARK]) * ORDER
    data = np.frombuffer(b"".join(x for t in texts for x in (mark, t, bytes([END_MARK]))), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    key = np.zeros(max(len(data) - ORDER, 0), np.uint64)
    for i in range(ORDER + 1):
        key <<= np.uint64(8)
        key |= data[i : len(data) - ORDER + i]
    real = np.ones(len(key), bool)
    gap = np.cumsum(sizes + ORDER)[:-1]  # windows that end in the next text's start marks
    for i in range(ORDER):
        real[gap - ORDER + i] = False
    return key[real], np.cumsum(sizes) - sizes


def low(order: int) -> np.uint64:
    return np.uint64((1 << (8 * (order + 1))) - 1)


def backwards(grams_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams in the order of their contexts read backwards, which makes owners ranges and grams compact; and the places they had."""
    back = turned(grams_)
    order = np.argsort(back)
    return back[order], order


#: A sample of so many bytes of text per owner, of which every STEPth distinct gram is a candidate splitter.
SAMPLE_BYTES, STEP = 64 << 10, 256
LEAST_SAMPLE = 32 << 20


def splitters(docs: DataFrame, owners: int, size: int) -> np.ndarray:
    """Turned grams, without their symbol, that cut all grams into ranges of about equal load; they only say who counts what."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_groups(batches, CHUNK_BYTES):
            key, _ = grams([(t or b"").lower() for t in part.column("text").cast(pa.binary()).to_pylist()])
            back = np.unique(turned(key))
            yield pa.RecordBatch.from_arrays([pa.array(back[STEP // 2 :: STEP].view(np.int64))], ["at"])

    share = min(1.0, max(LEAST_SAMPLE, owners * SAMPLE_BYTES) / max(size, 1))
    texts = docs.select("text") if share == 1 else docs.select("text").sample(share, 7)
    # about SAMPLE_BYTES / STEP numbers per owner
    found = np.sort(np.array([r["at"] for r in map_arrow(texts, run, "at long").collect()], np.int64)).view(np.uint64)
    if len(found) == 0:
        return found
    at = np.arange(1, owners) * len(found) // owners
    return np.unique(found[at] & ~np.uint64(0xFF))


def straddling(split: np.ndarray, order: int) -> np.ndarray:
    """The contexts of an order that a splitter may lie in, sorted."""
    return np.unique((turned(split) >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1))


def chunks(docs: DataFrame, owners: int, split: np.ndarray) -> DataFrame:
    """kind 0: the chunk; 1: its words for an owner, with training counts; 2: its grams for an owner, with training counts; 3: its training grams of order SHORT, and those of straddling contexts, by order."""
    shared = {o: straddling(split, o) for o in range(SHORT + 1, ORDER)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        made = 0
        for part in in_groups(batches, CHUNK_BYTES):
            ids = part.column("doc_id").to_pylist()
            texts = [(t or b"").lower() for t in part.column("text").cast(pa.binary()).to_pylist()]
            train = np.array([not held_out(i) for i in ids])
            name = f"{TaskContext.get().partitionId():010d}-{made:06d}"  # one attempt of a task counts, as the rows are stored
            made += 1
            rows: list[tuple] = []
            hashes, at, sizes = split_words(texts)
            in_train = np.repeat(train, sizes)
            count = np.bincount(at[in_train], minlength=len(hashes)).astype(np.uint32)
            rows.append((0, name, 0, None, None, ids, pack(texts), int(sizes[train].sum() + train.sum())))
            edges = np.searchsorted((hashes >> np.uint64(32)).astype(np.int64) * owners >> 32, np.arange(owners + 1))
            for q in np.flatnonzero(np.diff(edges)).tolist():
                s, e = edges[q], edges[q + 1]
                rows.append((1, name, q, squeeze_sorted(hashes[s:e]), squeeze(count[s:e]), None, None, int(e - s)))
            yield _chunk_rows(rows)
            key, starts = grams(texts)
            key <<= np.uint64(1)  # the lowest bit tells the training texts' symbols
            key |= np.repeat(train, np.diff(np.append(starts, len(key)))).astype(np.uint64)
            key.sort()
            trained = (key & np.uint64(1)).astype(np.uint32)
            key >>= np.uint64(1)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, size = key[first], np.add.reduceat(trained, first, dtype=np.uint32)
            trained = size > 0
            known, times = key[trained], size[trained].astype(np.int64)
            rows = []
            for o in range(SHORT, ORDER):
                gram = known & low(o)
                at = slice(None) if o == SHORT else find(shared[o], gram >> np.uint64(8)) >= 0
                gram, count = _sum(gram[at], times[at])
                if len(gram):
                    rows.append((3, name, o, squeeze_sorted(gram), squeeze(count), None, None, 0))
            yield _chunk_rows(rows)
            key, order = backwards(key)
            size, edges = size[order], np.concatenate(([0], np.searchsorted(key, split), [len(key)]))
            yield _chunk_rows([(2, name, q, squeeze(key[edges[q] : edges[q + 1]]), squeeze(size[edges[q] : edges[q + 1]]), None, None, int(size[edges[q] : edges[q + 1]].sum())) for q in np.flatnonzero(np.diff(edges)).tolist()])

    return map_arrow(docs.select("doc_id", "text"), run, CHUNK)


def _chunk_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int64())
    columns = list(zip(*rows)) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["kind", "chunk", "owner", "a", "b", "ids", "texts", "n"])


def pack(texts: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return len(texts).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + b"".join(texts))


def unpack(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    raw = zstandard.ZstdDecompressor().decompress(data[4:])
    ends = np.cumsum(np.frombuffer(raw, np.int64, n)) + 8 * n
    return [raw[s:e] for s, e in zip([8 * n, *ends[:-1].tolist()], ends.tolist())]


def _by_owner(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by owner -> (owner, its rows)."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("owner", "chunk", "a", "b"))):
            if row[0] != at and held:
                yield at, held
                held = []
            at = row[0]
            held.append(row[1:])
    if held:
        yield at, held


# ---- the words' counts ----


def word_counts(made: DataFrame, owners: int) -> DataFrame:
    """chunk, owner and the training counts of its words; distinct: the owner's distinct training words, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, rows in _by_owner(batches):
            hashes = [unsqueeze_sorted(a) for _, a, _ in rows]
            _, at = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(at, np.concatenate([unsqueeze(b) for _, _, b in rows])).astype(np.uint64)
            ends = np.cumsum([len(h) for h in hashes])
            for i in range(0, len(rows), 64):
                names = [r[0] for r in rows[i : i + 64]]
                counts = [squeeze(total[at[e - len(h) : e]]) for h, e in zip(hashes[i : i + 64], ends[i : i + 64])]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([owner] * len(names), pa.int32()), pa.array(counts, pa.binary()), pa.array([int((total > 0).sum()) if i + j == 0 else 0 for j in range(len(names))], pa.int64())], ["chunk", "owner", "counts", "distinct"])

    dealt = made.where("kind = 1").select("owner", "chunk", "a", "b").repartitionById(owners, F.col("owner")).sortWithinPartitions("owner")
    return map_arrow(dealt, run, "chunk string, owner int, counts binary, distinct long")


# ---- the trie ----


def short_nodes(made: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(order, grams, counts) of orders 0 to SHORT, and of the straddling contexts of longer ones, summed within tasks and then on the driver (see above for their number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple] = {}
        for batch in batches:
            for order, a, b in zip(*(batch.column(c).to_pylist() for c in ("owner", "a", "b"))):
                key, count = total.get(order, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                total[order] = _sum(np.concatenate((key, unsqueeze_sorted(a))), np.concatenate((count, unsqueeze(b))))
        for order, (key, count) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([order], pa.int32()), pa.array([squeeze_sorted(key)], pa.binary()), pa.array([squeeze(count)], pa.binary())], ["owner", "a", "b"])

    total = np.zeros(1 << (8 * (SHORT + 1)), np.int64)
    longer = {o: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for o in range(SHORT + 1, ORDER)}
    for row in cut(map_arrow(made.where("kind = 3").select("owner", "a", "b"), run, "owner int, a binary, b binary")).toLocalIterator():
        key, count = unsqueeze_sorted(row["a"]), unsqueeze(row["b"])
        if row["owner"] == SHORT:
            total[key.astype(np.int64)] += count
        else:
            longer[row["owner"]] = _sum(np.concatenate((longer[row["owner"]][0], key)), np.concatenate((longer[row["owner"]][1], count)))
    out = [(o, *nodes) for o, nodes in longer.items()]
    for order in range(SHORT, -1, -1):
        at = np.flatnonzero(total)
        out.append((order, at.astype(np.uint64), total[at]))
        total = total.reshape(256, -1).sum(0)  # without the first byte
    return out


def gram_logs(made: DataFrame, split: np.ndarray, short: list[tuple[int, np.ndarray, np.ndarray]]) -> DataFrame:
    """chunk, owner and what the logs of the chunk's grams there are made of (see unsqueeze_logs), in their order."""
    held = made.sparkSession.sparkContext.broadcast((short, {o: straddling(split, o) for o in range(SHORT + 1, ORDER)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for owner, rows in _by_owner(batches):
            keys = [turned(unsqueeze(a)) for _, a, _ in rows]
            ends = np.cumsum([len(k) for k in keys])
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            del keys
            count = np.bincount(at, np.concatenate([unsqueeze(b) for _, _, b in rows])).astype(np.int64)
            at = at.astype(np.int32)
            short_, shared = held.value
            nodes, own, size = [x for x in short_ if x[0] <= SHORT], key[count > 0], count[count > 0]
            for order in range(ORDER, SHORT, -1):
                own, size = _sum(own & low(order), size)
                nodes.append((order, own, size) if order == ORDER else _with_shared(own, size, shared[order], next(x for x in short_ if x[0] == order)))
            trie = Trie(nodes)
            den = np.zeros(len(key), np.int64)
            den[count > 0] = trie.top[ORDER][find(trie.contexts[ORDER], key[count > 0] >> np.uint64(8))]
            logs = np.zeros(len(key))
            logs[count == 0] = trie.logs(key[count == 0])
            del trie, nodes
            for i in range(0, len(rows), 64):
                names = [r[0] for r in rows[i : i + 64]]
                places = [at[s:e] for s, e in zip([ends[i - 1] if i else 0, *ends[i : i + 63]], ends[i : i + 64])]
                parts = [squeeze_logs(count[x], den[x], logs[x]) for x in places]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([owner] * len(names), pa.int32()), pa.array(parts, pa.list_(pa.binary()))], ["chunk", "owner", "logs"])

    dealt = made.where("kind = 2").select("owner", "chunk", "a", "b").repartitionById(len(split) + 1, F.col("owner")).sortWithinPartitions("owner")
    return map_arrow(dealt, run, "chunk string, owner int, logs array<binary>")


def _with_shared(own: np.ndarray, size: np.ndarray, shared: np.ndarray, node: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    """An order's nodes: the owner's own, but for straddling contexts the sums over all owners."""
    order, key, count = node
    mine = find(shared, own >> np.uint64(8)) < 0
    key, count = np.concatenate((own[mine], key)), np.concatenate((size[mine], count))
    at = np.argsort(key)
    return order, key[at], count[at]


def squeeze_logs(count: np.ndarray, den: np.ndarray, logs: np.ndarray) -> list[bytes]:
    known = count > 0
    return [squeeze(count), squeeze(den[known]), squeeze(logs[~known])]


def unsqueeze_logs(parts: list[bytes]) -> np.ndarray:
    """A trained gram is in its longest context, so its count and denominator are enough, and neighbours share the latter; others have their log."""
    count, den, rest = map(unsqueeze, parts)
    known = count > 0
    logs = np.empty(len(count))
    logs[known] = np.log10(count[known] / den)
    logs[~known] = rest
    return logs


def _sum(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def find(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted values, -1 where they aren't."""
    if len(sorted_) == 0:
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return np.where(sorted_[at] == wanted, at, -1)


class Trie:
    """Counts by order, with each context's denominators and escapes worked out."""

    def __init__(self, nodes: list[tuple[int, np.ndarray, np.ndarray]], order: int = ORDER):
        self.order = order
        self.keys, self.counts, self.contexts, self.top, self.escape, self.den, self.excluded = [], [], [], [], [], [None], [None]
        q, n = [], []
        for o in range(order + 1):
            key, count = next((k, c) for level, k, c in nodes if level == o)
            context = key >> np.uint64(8)
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(key) else np.zeros(0, np.int64)
            self.keys.append(key), self.counts.append(count), self.contexts.append(context[first])
            q.append(np.diff(np.append(first, len(key))).astype(float))
            n.append(np.add.reduceat(count, first).astype(float) if len(first) else np.zeros(0))
            if o:
                below = find(self.contexts[o - 1], self.contexts[o] & low(o - 2) if o > 1 else np.zeros(len(first), np.uint64))
                same = find(self.keys[o - 1], key & low(o - 1))
                x = np.add.reduceat(self.counts[o - 1][same], first).astype(float) if len(first) else np.zeros(0)
                rest_q = q[o - 1][below] - q[o]
                den = rest_q + n[o - 1][below] - x
                some = den > 0
                self.den.append(np.where(some, den, 1.0))
                self.excluded.append(np.log10(np.where(some, rest_q, 1.0) / np.where(some, den, 1.0)))
            self.top.append(n[o] + q[o])
            self.escape.append(np.log10(q[o] / (n[o] + q[o])))
        self.never = -np.log10(max(ALPHABET - (q[0][0] if len(q[0]) else 0), 1))

    def logs(self, wanted: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last symbol after its other bytes."""
        out, spent = np.zeros(len(wanted)), np.zeros(len(wanted))
        left, before = np.arange(len(wanted)), np.full(len(wanted), -1)
        for o in range(self.order, -1, -1):
            key = wanted[left] & low(o)
            context = find(self.contexts[o], key >> np.uint64(8))
            at = find(self.keys[o], key)
            prior, known, hit = before[left], context >= 0, at >= 0
            top = prior < 0
            if known.any():
                c = np.maximum(context, 0)
                den, esc = self.top[o][c], self.escape[o][c]
                if o < self.order and (~top).any():
                    den = np.where(top, den, self.den[o + 1][np.maximum(prior, 0)])
                    esc = np.where(top, esc, self.excluded[o + 1][np.maximum(prior, 0)])
                got = left[hit]
                out[got] = spent[got] + np.log10(self.counts[o][at[hit]] / den[hit])
                lost = known & ~hit
                spent[left[lost]] += esc[lost]
                before[left[lost]] = context[lost]
            left = left[~hit]
        out[left] = spent[left] + self.never
        return out


def sum_logs(texts: list[bytes], parts: list[list[bytes]]) -> np.ndarray:
    """Each text's score, from the logs of the chunk's distinct grams in the order of their owners."""
    key, starts = grams(texts)
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    key = key[new]
    logs = np.empty(len(key))
    logs[backwards(key)[1]] = np.concatenate([unsqueeze_logs(data) for data in parts])
    del key
    at = np.cumsum(new, dtype=np.int32)
    at -= 1
    each = np.empty(len(order))
    each[order] = logs[at]
    return np.add.reduceat(each, starts)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and the model's code length per byte (the end counts as one)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (2 * CHUNK_BYTES)))
    split = splitters(docs, owners, size)
    made, path = stored(chunks(docs, owners, split), "kind")
    sums = {r["kind"]: r["n"] for r in made.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    n = sums.get(0, 0)
    counted = cut(word_counts(made, owners))
    distinct = counted.agg(F.sum("distinct")).first()[0] or 0
    dropped(spark, f"{path}/kind=1")  # summed by now
    logs = gram_logs(made, split, short_nodes(made))
    ends = made.where("kind = 0").select(F.explode("ids").alias("doc_id"))
    n_train = ends.where(~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_MOD == HELD_REST, F.lit(False))).count()
    vocabulary = distinct + (1 if n_train else 0)
    n_chunks = max(1, made.where("kind = 0").count())
    tasks = (made.where("kind = 0").agg(F.max(F.substring("chunk", 1, 10).cast("long"))).first()[0] or 0) + 1
    # chunks are dealt out evenly, by their number in their task and the task's
    to = F.pmod(F.substring("chunk", 12, 6).cast("long") * tasks + F.substring("chunk", 1, 10).cast("long"), F.lit(n_chunks)).cast("int")
    blank = {"owner": "int", "ids": "array<long>", "texts": "binary", "counts": "binary", "logs": "array<binary>"}
    rows = None
    for part in (made.where("kind = 0").select("chunk", "ids", "texts"), counted.select("chunk", "owner", "counts"), logs):
        part = part.select("chunk", *[F.col(c) if c in part.columns else F.lit(None).cast(t).alias(c) for c, t in blank.items()])
        rows = part if rows is None else rows.unionAll(part)
    rows = rows.repartitionById(n_chunks, to).sortWithinPartitions("chunk", F.col("texts").isNull(), F.col("counts").isNull(), "owner")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Per chunk: its ids, texts, words' counts and grams' logs, by owner."""
        at, held = None, None
        for batch in batches:
            for name, ids, texts, counts, logs_ in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ids", "texts", "counts", "logs"))):
                if name != at:
                    if held:
                        yield held
                    at, held = name, (ids, texts, [], [])
                elif counts is not None:
                    held[2].append(counts)
                else:
                    held[3].append(logs_)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for ids, packed, words, parts in whole(batches):
            texts = unpack(packed)
            _, at, sizes = split_words(texts)
            counts = np.concatenate([unsqueeze(x) for x in words]) if words else np.zeros(0, np.uint64)
            c = counts[at].astype(float)
            over = n + vocabulary + 1.0
            text = np.repeat(np.arange(len(texts)), sizes)
            base = np.bincount(text, np.log10((c + 1) / over), len(texts)) + np.log10((n_train + 1) / over)
            known = np.bincount(text, c > 0, len(texts)) + (n_train > 0)
            logs = sum_logs(texts, parts)
            bits = -logs * np.log2(10) / (np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids]), pa.array(sizes + 1), pa.array(known.astype(np.int64)), pa.array(np.full(len(ids), n, np.int64)), pa.array(base), pa.array(logs), pa.array(bits)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_symbol"],
            )

    return map_arrow(rows, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_symbol double")


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


ORACLE_SQL = None
