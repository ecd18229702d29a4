"""SimHash near-duplicate detection with covering locality-sensitive hashing.

Fingerprints are computed where the text is read and are the only thing that
moves. Distinct fingerprints (pre-aggregated, so a large group of copies is one
row) go into 2**(r+1) - 1 tables, one per structured bit mask: bit i carries a
non-zero vector of r+1 bits, and mask v keeps the bits whose vector has odd
overlap with v. Any r differing bits span at most r dimensions, so some v is
orthogonal to all of them, and the pair meets in that table. Nothing is missed
within the radius, and every meeting is verified by its distance.

A bucket with more than ``BUCKET`` fingerprints isn't compared in one task: its
rows go to a next level, masked again by another family over the same bits, up to
``LEVELS`` of them. Each level about halves the bits in which a bucket's fingerprints
can differ: over any masks of the five families 11 of 64 at most stay free, so a bucket
of the last level has 2,048 distinct fingerprints at most, and is compared as it is. Buckets
give a spanning forest of their links, not all pairs; components are joined over all
tables.

``similar`` is the operator for similarities that no small radius reaches, and what the
pipeline's stage takes: five-word shingles and a Jaccard similarity of 0.8 or more. The
query's links come first, each checked by the similarity (``linked``). What they leave
apart meets by wide fingerprints. These have 256 bits, and its structured masks are families of disjoint masks of
k bits, so that in each family every pair within 256 / k - 1 bits meets; there are as
many families as let a pair at the similarity meet with probability ``RECALL`` or more,
and k grows with the logarithm of the rows, as do the buckets' number. Meetings within
``NEAR`` bits are links to be checked; a check reads both sets of shingles, of which
only those in question move. What the checks left apart, within
``FAR`` bits, is compared once more, first in stars and then with all it meets, so that
no link within a bucket is lost. A bound keeps that from growing with the square of a
group: sets are dealt by hash into GROUPS small groups, and each group whose contents'
hashes differ says that the sets differ there, so most pairs below the similarity are
known by their digests.

Defined cases: a null or empty text has fingerprint zero, and is linked like any
other; fewer words than a shingle are one shingle; null ids get the component of
their fingerprint; repeated rows stay (the stage keeps one of them); a very long text
is hashed as a whole, a row at a time; extra columns, whatever their names (but for
``_fathom_`` in front), stay as they are in the stage and are ignored by the query; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import cut, dropped, identity, in_groups, map_arrow, stored, table, utf8
from fathom.llm.components import STEP, components

SEED, BITS = 42, 64
#: The query's words a shingle and bits of difference.
QUERY_SHINGLE, QUERY_RADIUS = 4, 4
#: Fingerprints that one task compares with each other.
BUCKET = 1024
LEVELS = 5

_SPREAD = np.zeros((256, 8), np.uint8)
for _i in range(8):
    _SPREAD[:, _i] = (np.arange(256) >> _i) & 1
_SPREAD = _SPREAD.view(np.uint64).reshape(256)


def hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of the words, A-Z lowered, repeats included."""
    words = utf8(text).lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops)), np.uint64, n - shingle + 1)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    n = len(h)
    if n == 0:
        return 0
    lanes = _SPREAD[np.ascontiguousarray(h).view(np.uint8).reshape(n, 8)]
    counts = np.zeros(BITS, np.int64)
    for part in np.add.reduceat(lanes, np.arange(0, n, 255), axis=0):
        counts += part.view(np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = QUERY_SHINGLE) -> DataFrame:
    """doc_id, which row it is (_fathom_did, _fathom_th), and the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([majority(hashes(t, shingle)) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found.view(np.int64))], ["doc_id", "_fathom_did", "_fathom_th", "fp"])

    rows = identity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "_fathom_did", "_fathom_th", "text")
    return map_arrow(rows, run, "doc_id long, _fathom_did long, _fathom_th long, fp long")


def masks(radius: int, family: int = 0) -> list[int]:
    """The covering masks as signed longs; other families deal the vectors differently."""
    r = radius + 1
    vectors = [((i * (2 * family + 1) + family * 7 + (i // 31) * family * 3) % ((1 << r) - 1)) + 1 for i in range(BITS)]
    found = []
    for v in range(1, 1 << r):
        m = sum(1 << i for i in range(BITS) if (vectors[i] & v).bit_count() & 1)
        found.append(m - (1 << 64) if m >> 63 else m)
    return found


def _forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket; each fingerprint looks once at those not reached yet."""
    return [(int(fp[i]), int(fp[j])) for i, j in _links(fp[:, None], radius)]


def _links(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """The same over rows of words, as indexes."""
    out: list[tuple[int, int]] = []
    left = np.arange(len(fp))
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = np.bitwise_count(fp[left] ^ fp[i]).sum(1, dtype=np.int64) <= radius
            if near.any():
                hit = left[near].tolist()
                left = left[~near]
                out += [(i, j) for j in hit]
                todo += hit
    return out


def _compare(radius: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; gives links (level 0) and rows for the next level (level 1)."""
        key, held, over = None, np.zeros(0, np.uint64), False
        for part in in_groups(batches, 4 << 20):
            keys = part.column("bucket").to_numpy()
            fps = part.column("fp").to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.diff(keys)) + 1
            bounds = np.concatenate(([0], cuts, [len(keys)]))
            a, b, kind = [], [], []
            sizes = np.diff(bounds)
            # a bucket of one row matters only where it may go on in another batch
            for i in sorted({0, len(sizes) - 1, *np.flatnonzero(sizes > 1).tolist()}):
                s, e = int(bounds[i]), int(bounds[i + 1])
                if keys[s] != key:
                    if len(held) > 1:
                        for x, y in _forest(held, radius):
                            a.append(x), b.append(y), kind.append(0)
                    key, held, over = keys[s], held[:0], False
                rows = fps[s:e]
                if over:
                    pass
                elif len(held) + len(rows) > BUCKET and not last:
                    rows, held, over = np.concatenate((held, rows)), held[:0], True  # the next level takes them
                else:
                    held = np.concatenate((held, rows))
                    continue
                a.extend(rows.tolist())
                b.extend([int(key) & 0xFFFFFFFFFFFFFFFF] * len(rows))
                kind.extend([1] * len(rows))
            if a:
                yield _batch(a, b, kind)
        if len(held) > 1 and (found := _forest(held, radius)):
            yield _batch([x for x, _ in found], [y for _, y in found], [0] * len(found))

    return run


def _batch(a: list, b: list, kind: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)), pa.array(kind, pa.int32())], ["a", "b", "kind"])


def buckets(tables: list[list[int]], *words: str, by: Iterable[str] = ()) -> Column:
    """A row's bucket in each table: the words under the table's mask (and other columns), with the table's number, as one hash."""
    rows = ", ".join(f"array({t}L, {', '.join(f'{m}L' if m + (1 << 63) else 'bigint(-9223372036854775808)' for m in mask)})" for t, mask in enumerate(tables))
    return F.expr(f"transform(array({rows}), m -> xxhash64({', '.join([*by, 'm[0]', *(f'{w} & m[{i + 1}]' for i, w in enumerate(words))])}))")


def links(distinct: DataFrame, radius: int = QUERY_RADIUS) -> DataFrame:
    """Links (a, b) that join every pair of fingerprints within the radius, over forests."""
    found, rows = None, distinct.select("fp", F.lit(0).cast("long").alias("outer"))
    for level in range(LEVELS):
        dealt = rows.select("fp", F.explode(buckets([[m] for m in masks(radius, level)], "fp", by=["outer"])).alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "fp")
        out = cut(map_arrow(dealt, _compare(radius, level == LEVELS - 1), "a long, b long, kind int"))
        pairs = out.where("kind = 0").select("a", "b")
        found = pairs if found is None else found.union(pairs)
        rows = out.where("kind = 1").select(F.col("a").alias("fp"), F.col("b").alias("outer"))
        if rows.isEmpty():
            break
    return found.distinct()


def near_duplicates(docs: DataFrame, radius: int = QUERY_RADIUS, shingle: int = QUERY_SHINGLE) -> DataFrame:
    """Each row's doc_id, _fathom_did, _fathom_th and fp; root, the component's least fingerprint; component_id, the least doc_id of all that are linked."""
    prints = cut(fingerprints(docs, shingle))
    firsts = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    groups = cut(components(links(firsts, radius)))
    members = cut(groups.join(firsts, groups.node == firsts.fp).select("root", "node", "first"))
    least = cut(members.groupBy("root").agg(F.min("first").alias("component_id")))
    linked = members.join(least, "root").select(F.col("node").alias("fp"), "root", "component_id")
    label = cut(firsts.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id")))
    return prints.join(label, "fp").select("doc_id", "_fathom_did", "_fathom_th", "fp", "root", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- by similarity ----

WORDS = 4
NEAR, FAR = 40, 56
RECALL = 0.95
SIMILARITY, SHINGLE = 0.8, 5
#: Bits of the fixed filter that says which texts a check may want.
FILTER_BITS = 24
_PRINTS = ", ".join(f"w{i} long" for i in range(WORDS))


def wide_print(h: np.ndarray) -> tuple[int, list[int]]:
    """A hash of the set of shingles, and the set's fingerprint of 64 * WORDS bits."""
    u = np.unique(h)
    out = [majority(u)]
    for i in range(1, WORDS):
        v = (u ^ np.uint64(0x9E3779B97F4A7C15 * i & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(32)
        v *= np.uint64(0x94D049BB133111EB)
        out.append(majority(v ^ (v >> np.uint64(29))))
    return xxhash.xxh3_64_intdigest(u.tobytes()), out


def wide_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """_fathom_no (without an id), _fathom_did, _fathom_th, the set's hash as node, the wide fingerprint's words, and the query's fingerprint (fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [(*wide_print(hashes(t, shingle)), majority(hashes(t, QUERY_SHINGLE))) for t in texts]
            values = np.array([(n, *w, f) for n, w, f in found], np.uint64).reshape(-1, 2 + WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(values[:, i].copy()) for i in range(2 + WORDS))], ["_fathom_no", "_fathom_did", "_fathom_th", "node", *(f"w{i}" for i in range(WORDS)), "fp"])

    rows = identity(docs.select("doc_id", "text")).select(F.col("doc_id").isNull().alias("_fathom_no"), "_fathom_did", "_fathom_th", "text")
    return map_arrow(rows, run, f"_fathom_no boolean, _fathom_did long, _fathom_th long, node long, {_PRINTS}, fp long")


def agreement(similarity: float) -> float:
    """The chance that a bit of two sets of this Jaccard similarity agrees."""
    return 1 - float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def families(n: int, similarity: float) -> list[list[int]]:
    """Masks as words (signed), family by family: each family's are disjoint, of k bits."""
    k = min(24, max(12, int(n).bit_length() - 2))
    per = BITS * WORDS // k
    tables = int(np.ceil(np.log(1 - RECALL) / np.log(1 - agreement(similarity) ** k)))
    out = []
    for family in range(-(-tables // per)):
        bits = np.random.RandomState(family).permutation(BITS * WORDS)
        for i in range(per):
            mask = [0] * WORDS
            for b in bits[i * k : (i + 1) * k].tolist():
                mask[b // BITS] |= 1 << (b % BITS)
            out.append([m - (1 << 64) if m >> 63 else m for m in mask])
    return out


#: The tables that a round of comparing begins with. Further rounds (0, 2) write less, as they leave out what is joined, and take more of the driver's memory.
ROUNDS = (0,)


#: Groups of a set's digest; a group's hash has four bits.
GROUPS = 512
_DIFFER = np.array([(x >> 4 > 0) + (x & 15 > 0) for x in range(256)], np.uint8)


def digest_of(h: np.ndarray) -> bytes:
    """The digest of a set of shingles: per group, what its members' hashes are as an exclusive or."""
    v = h * np.uint64(0x9E3779B97F4A7C15)
    four = np.zeros(GROUPS, np.uint8)
    np.bitwise_xor.at(four, ((v >> np.uint64(20)) % np.uint64(GROUPS)).astype(np.int64), (v >> np.uint64(60)).astype(np.uint8))
    return (four[0::2] << 4 | four[1::2]).tobytes()


def bound(n: np.ndarray, digests: np.ndarray, i: int, of: np.ndarray) -> np.ndarray:
    """The most that the Jaccard similarity of set i with other sets can be: each group that differs has an element that isn't in both."""
    k = _DIFFER[digests[of] ^ digests[i]].sum(1, dtype=np.int64)
    both = n[of] + n[i]
    return (both - k) / np.maximum(both + k, 1)


#: Buckets of so many rows at most are looked through together.
SMALL = 64


def lively(fp: np.ndarray, root: np.ndarray, bounds: np.ndarray, radius: int) -> np.ndarray:
    """The buckets that hold a pair of different components within the radius; those over SMALL rows count without a look."""
    sizes = np.diff(bounds)
    own = np.repeat(np.arange(len(sizes)), sizes)
    found = sizes > SMALL
    own[found[own]] = -1
    for step in range(1, int(sizes[~found].max(initial=0))):
        i = np.flatnonzero((own[step:] == own[:-step]) & (own[step:] >= 0) & (root[step:] != root[:-step]))
        if len(i):
            far = np.bitwise_count(fp[i] ^ fp[i + step]).sum(1, dtype=np.int64)
            found[own[i[far <= radius]]] = True
    return np.flatnonzero(found)


FOREST, WHO, STAR, ALL = range(4)


def _meet(radius: int, mode: int, similarity: float):
    """Over rows sorted by bucket, pairs within the radius: as a spanning forest, without what earlier tables joined; or of different components: each text once with itself, in stars, or all, but for those below the similarity by their digests."""
    words = [f"w{i}" for i in range(WORDS)]

    def solve(rows: dict) -> np.ndarray:
        node, root = rows["node"], rows["root"]
        fp = np.stack([rows[w] for w in words], axis=1).view(np.uint64)
        if mode == FOREST:
            return np.array([(node[i], node[j]) for i, j in _links(fp, radius) if root[i] != root[j]], np.int64).reshape(-1, 2)
        roots, at, size = np.unique(root, return_inverse=True, return_counts=True)
        if len(roots) < 2:
            return np.zeros((0, 2), np.int64)
        digests = None if mode == WHO else np.frombuffer(b"".join(rows["digest"].tolist()), np.uint8).reshape(len(node), -1)

        def near(i: int, of: np.ndarray) -> np.ndarray:
            ok = of[(root[of] != root[i]) & (np.bitwise_count(fp[of] ^ fp[i]).sum(1, dtype=np.int64) <= radius)]
            return ok if mode == WHO else ok[bound(rows["n"], digests, i, ok) >= similarity]

        found: list[tuple[int, int]] = []
        if mode == STAR:
            left = np.argsort(node)
            while len(left) > 1:
                i, left = int(left[0]), left[1:]
                hit = near(i, left)
                found += [(node[i], node[j]) for j in hit.tolist()]
                left = left[~np.isin(left, hit)]
        else:  # those of the largest component wait for the others to look at them
            every = np.arange(len(node))
            for i in np.flatnonzero(at != size.argmax()).tolist():
                hit = near(i, every).tolist()
                found += [(node[j], node[j]) for j in (*hit, i)] if mode == WHO and hit else [(node[i], node[j]) for j in hit] if mode == ALL else []
        both = np.array(found, np.int64).reshape(-1, 2)
        return np.unique(np.sort(both, axis=1), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for part in in_groups(batches, 4 << 20):
            keys = part.column("bucket").to_numpy()
            rows = {c: part.column(c).to_numpy() for c in part.column_names if c != "bucket"}
            bounds = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
            sizes = np.diff(bounds)
            found = []
            fp = np.stack([rows[w] for w in words], axis=1).view(np.uint64)
            # the first and the last may go on in another batch
            for i in sorted({0, len(sizes) - 1, *lively(fp, rows["root"], bounds, radius).tolist()}):
                own = {c: v[int(bounds[i]) : int(bounds[i + 1])] for c, v in rows.items()}
                if keys[bounds[i]] == key:
                    held = {c: np.concatenate((held[c], v)) for c, v in own.items()}
                    continue
                if held is not None and len(held["node"]) > 1:
                    found.append(solve(held))
                key, held = keys[bounds[i]], own
            yield from _pairs(found)
        if held is not None and len(held["node"]) > 1:
            yield from _pairs([solve(held)])

    return run


def _pairs(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    both = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    if len(both):
        yield pa.RecordBatch.from_arrays([pa.array(both.min(1)), pa.array(both.max(1))], ["a", "b"])


def meetings(nodes: DataFrame, tables: list[list[int]], radius: int, mode: int, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of nodes, with their root (and size n and digest), that meet in a table within the radius (see _meet)."""
    words = [f"w{i}" for i in range(WORDS)]
    rows = nodes.select("node", "root", *words, *(["n", "digest"] if mode in (STAR, ALL) else []), F.explode(buckets(tables, *words)).alias("bucket"))
    return map_arrow(rows.repartition("bucket").sortWithinPartitions("bucket", "node"), _meet(radius, mode, similarity), "a long, b long").distinct()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def _filter(keys: DataFrame) -> np.ndarray:
    """One bit per hash of (did, th), in FILTER_BITS of them whatever the number of keys; with very many, it only lets more through."""
    at = F.xxhash64("_fathom_did", "_fathom_th").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = keys.select((at + 1).alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits")).collect()
    out = np.zeros((1 << FILTER_BITS) // 8 + 8192, np.uint8)
    for r in rows:
        out[(r["n"] - 1) * 4096 : r["n"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def sets_of(wanted: DataFrame, docs: DataFrame, shingle: int) -> tuple[DataFrame, str]:
    """node and its set of shingles, sorted, as bytes, as a stored table with its path. ``wanted``: one row (node, _fathom_did, _fathom_th) of each."""
    wanted = cut(wanted.select("node", "_fathom_did", "_fathom_th"))
    bits = _filter(wanted)
    held = docs.sparkSession.sparkContext.broadcast(bits.tobytes())  # 2 MB at any size

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            at = batch.column("at").to_numpy()
            hit = (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            if hit.any():
                some = batch.filter(pa.array(hit))
                made = [np.unique(hashes(t, shingle)).tobytes() for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("_fathom_did"), some.column("_fathom_th"), pa.array(made, pa.binary())], ["did", "th", "shingles"])

    at = F.xxhash64("_fathom_did", "_fathom_th").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = map_arrow(identity(docs.select("doc_id", "text")).select("_fathom_did", "_fathom_th", "text", at.alias("at")), sets, "did long, th long, shingles binary")
    out = stored(rows.join(wanted, (F.col("did") == F.col("_fathom_did")) & (F.col("th") == F.col("_fathom_th"))).select("node", "shingles").dropDuplicates(["node"]))
    held.destroy()  # the sets are written
    return out


def checked(pairs: DataFrame, docs: DataFrame, heads: DataFrame, shingle: int, similarity: float, of: DataFrame | None = None) -> DataFrame:
    """The pairs of nodes, and whether their sets of shingles have the similarity. ``heads``: a row of each node; ``of``: the sets, if they are known."""
    own = None
    if of is None:
        of, own = sets_of(heads.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node"), docs, shingle)
    left, right = (of.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            ok = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity for x, y in zip(sa, sb)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    found = cut(map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb"), run, "a long, b long, ok boolean"))
    if own:
        dropped(docs.sparkSession, own)
    return found


def linked(nodes: DataFrame, radius: int = QUERY_RADIUS) -> DataFrame:
    """Pairs (a, b) of nodes by the query's fingerprints: links() over the least node of each, and that node with the others of its fingerprint."""
    firsts = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.select("fp", "node").join(firsts, "fp").select(F.col("first").alias("x"), F.col("node").alias("y"))
    ends = [firsts.select(F.col("fp").alias(c), F.col("first").alias(f)) for c, f in ("ax", "by")]
    met = links(firsts, radius).join(ends[0], "a").join(ends[1], "b").select("x", "y")
    return same.union(met).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Each row's _fathom_no, _fathom_did, _fathom_th and node, and the root of the component of nodes linked by their similarity."""
    prints, _ = stored(wide_prints(docs, shingle))  # stays: the result is read from it
    words = [F.first(f"w{i}").alias(f"w{i}") for i in range(WORDS)]
    nodes = cut(prints.groupBy("node").agg(F.min(F.struct("_fathom_did", "_fathom_th", "fp")).alias("h"), *words).withColumn("fp", F.col("h.fp")))
    heads = nodes.select("node", "h._fathom_did", "h._fathom_th")
    tables = families(n := nodes.count(), similarity)
    parts = max(1, -(-n // STEP))  # of pairs, which are narrow; each check would add its own
    # what a round's tables join isn't compared again in the next round's
    label, seen = nodes.withColumn("root", F.col("node")), None
    for start, stop in zip(ROUNDS, (*ROUNDS[1:], len(tables))):
        pairs = meetings(label, tables[start:stop], NEAR, FOREST, similarity)
        if seen is None:
            pairs = pairs.union(linked(nodes)).distinct()
        pairs = cut(pairs if seen is None else pairs.join(seen.select("a", "b"), ["a", "b"], "left_anti"))
        if seen is None or not pairs.isEmpty():
            new = checked(pairs, docs, heads, shingle, similarity)
            seen = (new if seen is None else seen.union(new)).coalesce(parts)
            label = _rooted(nodes, seen)
    left = cut(meetings(label, tables, FAR, WHO, similarity).select(F.col("a").alias("node")))
    if not left.isEmpty():
        of, path = sets_of(heads.join(left, "node"), docs, shingle)
        sizes = cut(_digests(of))
        for mode in (STAR, ALL):
            rest = meetings(label.join(sizes, "node"), tables, FAR, mode, similarity)
            rest = cut(rest.join(seen.select("a", "b"), ["a", "b"], "left_anti"))
            if not rest.isEmpty():
                seen = seen.union(checked(rest, docs, heads, shingle, similarity, of)).coalesce(parts)
                label = _rooted(nodes, seen)
        dropped(docs.sparkSession, path)
    return prints.select("_fathom_no", "_fathom_did", "_fathom_th", "node").join(label.select("node", "root"), "node")


def _digests(of: DataFrame) -> DataFrame:
    """node, the size of its set (n), and its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(raw, np.uint64) for raw in batch.column("shingles").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(h) for h in held], pa.int64()), pa.array([digest_of(h) for h in held], pa.binary())], ["node", "n", "digest"])

    return map_arrow(of, run, "node long, n long, digest binary")


def _rooted(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    groups = components(seen.where("ok").select("a", "b")).withColumnRenamed("node", "_n").withColumnRenamed("root", "_r")
    return cut(nodes.join(groups, F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("_r", "node")).drop("_n", "_r"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component by similarity: that with the least id (without an id, by its text's hash)."""
    order = F.struct("_fathom_no", "_fathom_did", "_fathom_th")
    keep = similar(docs).groupBy("root").agg(F.min(order).alias("k")).select(F.col("k._fathom_did").alias("_kd"), F.col("k._fathom_th").alias("_kt"))
    rows = identity(docs)
    return rows.join(cut(keep), (rows._fathom_did == F.col("_kd")) & (rows._fathom_th == F.col("_kt")), "left_semi").dropDuplicates(["_fathom_did", "_fathom_th"]).select(*docs.columns)
