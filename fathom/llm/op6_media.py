"""Copies of images by local descriptors, for media columns.

Corners are found at several scales (structure tensor under growing blur); each
gets an orientation from its intensity centroid and a 256-bit descriptor of
brightness tests on a pattern turned to that orientation and grown with the scale.
Descriptors are filed in hash tables under all their eight 32-bit parts; a query looks
each part up with every choice of its WEAK least certain bits, those whose brightnesses
differ least, turned over; so two corners meet if some part differs in such bits only.
Each meeting is verified where it occurs by its Hamming
distance. Corners of different pictures look alike now and then, at a constant rate, so
meetings grow with queries times images; none of them leaves its task: a block of the
index meets a block of queries, with all corners of either image, and only pairs of
images come out. The meetings of two images vote: every one proposes a
similarity transform from its positions, orientations and scales, and the proposal
with most agreeing meetings is the consensus. Crops, turns, brightness, contrast, noise
and sizes that differ by the ratio of two scales leave enough of them.

Exact copies are one class, told by the SHA-1 of the image and named by that and the
smallest id in it; one image of it is described, so a large group of copies costs one
image, and no pairs of copies are made. Results are pairs of a query and a class, with
the membership of every row.

Images are PGM or PPM (binary) or PNG (8 bits, no interlace) in a binary column.
The tables given here hold no images, so the query renders each row of
``embeddings`` as a textured picture, linear in the vector: equal vectors are equal
images. Queries are edited copies (cropped, turned, recoloured, noisy) of every row
whose id is divisible by 100.

Defined cases: null, broken or tiny images, and those of a side of 2**22 pixels or more,
have no descriptors and match nothing;
null ids belong to the class of their image and aren't queries; a class of null ids
alone has a null class_id and is indexed like any other; rows of one id with different
images belong to the classes of their images, and each image is a query of its own;
repeated rows give equal rows; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import cut, map_arrow, stored, table

SIDE, CROP = 96, 72
CORNERS = 48
SIGMAS = (1.2, 1.5, 1.9, 2.4)
#: A descriptor's reach at scale 1, in units of BASE; MARGIN is that of the largest scale.
MARGIN, RADIUS, BASE = 13, 8, 1.5
BITS, PARTS, WEAK = 256, 8, 4
MAX_DISTANCE = 44
MIN_INLIERS, TOLERANCE, MAX_TURN = 5, 3.0, 0.5
EVERY = 100
#: Images that a worker holds and passes on at once, whatever the batch of vectors they are drawn from.
DRAWN = 256
#: Images whose corners are looked for at once, so that what is blurred stays in a core's cache.
SCORED = 4
#: A corner's place is packed into one number: 22 bits a side, 14 for the angle.
MAX_SIDE, TURNS = (1 << 22) - 1, (1 << 14) - 1
#: Images of the index and queries that one task compares, and about how many looks into the tables it verifies at once.
IMAGES, QUERIES, MET = 4096, 1024, 1 << 18
#: Meetings of two images up to which it's seen first whether any proposal can have agreement, for many images at once.
LOOKED_AT = 64
NAMES = ("x", "y", "angle", "scale", "d0", "d1", "d2", "d3")


def in_parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows, so many at once at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# ---- images ----


def read_image(data: bytes | None) -> np.ndarray | None:
    """Grey levels as floats; None for what can't be read."""
    try:
        if not data:
            return None
        if data[:2] in (b"P5", b"P6"):
            return _read_pnm(data)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _read_png(data)
    except (ValueError, IndexError, zlib.error, struct.error):
        pass
    return None


def _read_pnm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, depth = fields
    if depth > 255:
        raise ValueError("16 bits")
    channels = 3 if data[:2] == b"P6" else 1
    raw = np.frombuffer(data, np.uint8, width * height * channels, at + 1).reshape(height, width, channels)
    return raw.mean(2).astype(np.float32)


def _read_png(data: bytes) -> np.ndarray:
    at, body, palette = 8, b"", None
    width = height = kind = 0
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, bits, kind, _, _, interlace = struct.unpack(">IIBBBBB", chunk)
            if bits != 8 or interlace:
                raise ValueError("unsupported")
        elif name == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body += chunk
        at += 12 + size
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height + 1, width + 1, n), np.int64)
    for y in range(height):
        line, above, mode = raw[y, 1:].reshape(width, n).astype(np.int64), out[y], raw[y, 0]
        row = out[y + 1]
        if mode == 0:
            row[1:] = line
        elif mode == 2:
            row[1:] = (line + above[1:]) & 255
        elif mode == 1:
            row[1:] = np.cumsum(line, 0) & 255
        else:
            for x in range(1, width + 1):
                a, b, c = row[x - 1], above[x], above[x - 1]
                if mode == 3:
                    guess = (a + b) >> 1
                else:
                    pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
                    guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
                row[x] = (line[x - 1] + guess) & 255
    pixels = out[1:, 1:]
    if kind == 3:
        pixels = palette[pixels[..., 0]]
    return pixels[..., :3].mean(2).astype(np.float32) if kind in (2, 3, 6) else pixels[..., 0].astype(np.float32)


def write_pgm(image: np.ndarray) -> bytes:
    h, w = image.shape
    return f"P5\n{w} {h}\n255\n".encode() + np.clip(np.rint(image), 0, 255).astype(np.uint8).tobytes()


# ---- corners and descriptors ----


def _kernel(sigma: float) -> np.ndarray:
    r = int(np.ceil(2.5 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return (k / k.sum()).astype(np.float32)


def _convolved(flat: np.ndarray, k: np.ndarray, step: int) -> np.ndarray:
    """Weighted sums of places a step apart, from each place on; over all rows as one, so that loops are long."""
    n = len(flat) - (len(k) - 1) * step
    out = flat[:n] * k[0]
    part = np.empty_like(out)
    for i, w in enumerate(k[1:], 1):
        out += np.multiply(flat[i * step : i * step + n], w, out=part)
    return out


def blur(stack: np.ndarray, sigma: float) -> np.ndarray:
    r = len(_kernel(sigma)) // 2
    return inner_blur(np.pad(stack, [(0, 0), (r, r), (r, r)], mode="edge"), sigma, r)


def inner_blur(stack: np.ndarray, sigma: float, margin: int) -> np.ndarray:
    """Without a margin, which is at least the kernel's radius. What is summed across rows and images lies in it."""
    k = _kernel(sigma)
    (n, h, w), r = stack.shape, len(k) // 2
    out = np.empty(stack.size, stack.dtype)
    done = _convolved(_convolved(stack.ravel(), k, w), k, 1)
    at = r * w + r
    out[at : at + len(done)] = done
    return out.reshape(stack.shape)[:, margin : h - margin, margin : w - margin]


def _pattern() -> np.ndarray:
    """Two points per test, within RADIUS."""
    points = np.random.RandomState(20240607).normal(0, 5.0, (BITS, 2, 2))
    return (points * np.minimum(1, RADIUS / np.maximum(np.hypot(points[..., :1], points[..., 1:]), 1e-9))).reshape(BITS, 4)


def _disc(radius: int) -> np.ndarray:
    return np.array([(y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if x * x + y * y <= radius * radius])


_PATTERN = _pattern()
_DISCS = [_disc(min(round(RADIUS * s / BASE), MARGIN - 1)) for s in SIGMAS]


def describe_stack(stack: np.ndarray) -> tuple[np.ndarray, ...]:
    """(image, x, y, angle, scale, descriptor bytes, each part's weak bits) of the corners of equally large images."""
    n, h, w = stack.shape
    rows: list[tuple[np.ndarray, ...]] = []
    if h <= 2 * MARGIN or w <= 2 * MARGIN or max(h, w) > MAX_SIDE:
        return (*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float, float)), np.zeros((0, BITS // 8), np.uint8), np.zeros((0, PARTS * WEAK), np.int64))
    scored, smooth = [], [np.empty_like(stack, np.float32) for _ in SIGMAS]
    for first in range(0, n, SCORED):
        own = slice(first, first + SCORED)
        for level, sigma in enumerate(SIGMAS):
            s = smooth[level][own] = blur(stack[own], sigma)
            reach = len(_kernel(1.5 * sigma)) // 2
            rim = MARGIN - 1 - reach
            gy, gx = (g[:, rim : h - rim, rim : w - rim] for g in np.gradient(s, axis=(1, 2)))
            a, b, c = (inner_blur(v, 1.5 * sigma, reach) for v in (gx * gx, gy * gy, gx * gy))
            r = (a * b - c * c) / (a + b + 1e-3) * sigma * sigma
            most = np.maximum(np.maximum(r[:, :-2], r[:, 1:-1]), r[:, 2:])
            most = np.maximum(np.maximum(most[:, :, :-2], most[:, :, 1:-1]), most[:, :, 2:])
            here = r[:, 1:-1, 1:-1]
            image, y, x = np.nonzero((here >= most) & (here > 0.5))
            scored.append((image + first, y + MARGIN, x + MARGIN, np.full(len(image), level), here[image, y, x]))
    image, y, x, level, score = (np.concatenate(v) for v in zip(*scored))
    order = np.lexsort((x, y, level, -score, image))
    image, y, x, level = image[order], y[order], x[order], level[order]
    first = np.searchsorted(image, np.arange(n))
    best = np.arange(len(image)) - first[image] < CORNERS
    image, y, x, level = image[best], y[best], x[best], level[best]
    angle, bits, weak = np.zeros(len(image)), np.zeros((len(image), BITS // 8), np.uint8), np.zeros((len(image), PARTS, WEAK), np.int64)
    for k in range(len(SIGMAS)):
        at = np.flatnonzero(level == k)
        if len(at) == 0:
            continue
        flat, base, disc = smooth[k].ravel(), (image[at] * h + y[at]) * w + x[at], _DISCS[k]
        patch = flat.take(base[:, None] + (disc[:, 0] * w + disc[:, 1])[None])
        patch = patch - patch.mean(1, keepdims=True)
        angle[at] = np.arctan2(patch @ disc[:, 0].astype(np.float32), patch @ disc[:, 1].astype(np.float32))
        grown = SIGMAS[k] / BASE
        cos, sin = grown * np.cos(angle[at])[:, None], grown * np.sin(angle[at])[:, None]
        value = []
        for p in (0, 2):
            px, py = _PATTERN[:, p][None], _PATTERN[:, p + 1][None]
            dx, dy = np.rint(cos * px - sin * py).astype(np.int64), np.rint(sin * px + cos * py).astype(np.int64)
            value.append(flat.take(base[:, None] + dy * w + dx))
        bits[at] = np.packbits(value[0] < value[1], axis=1)
        margin = np.abs(value[0] - value[1]).reshape(len(at), PARTS, BITS // PARTS)
        least = np.sort(margin.view(np.uint32).astype(np.uint64) << np.uint64(5) | np.arange(BITS // PARTS, dtype=np.uint64), axis=2)  # floats of no sign are in the order of their bits
        weak[at] = 1 << (BITS // PARTS - 1 - (least[:, :, :WEAK] & np.uint64(31)).astype(np.int64))
    return image, x, y, angle, np.array(SIGMAS)[level], bits, weak.reshape(len(image), PARTS * WEAK)


DESCRIBED = "id long, corner int, x int, y int, angle double, scale double, d0 long, d1 long, d2 long, d3 long, weak array<long>"


def describe(images: DataFrame) -> DataFrame:
    """Corners of each (id, image), numbered within it: place, orientation, scale and descriptor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in in_parts(batches, DRAWN):
            by_size: dict[tuple, list] = {}
            for i, data in zip(held.column("id").to_pylist(), held.column("image").to_pylist()):
                if (image := read_image(data)) is not None:
                    by_size.setdefault(image.shape, []).append((i, image))
            for own in by_size.values():
                for s in range(0, len(own), 64):
                    part = own[s : s + 64]
                    image, x, y, angle, scale, bits, weak = describe_stack(np.stack([p[1] for p in part]))
                    d = bits.view(">i8").astype(np.int64).reshape(-1, 4)
                    ids = pa.array([p[0] for p in part], pa.int64()).take(pa.array(image))
                    corner = np.arange(len(image)) - np.searchsorted(image, image)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(corner.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(angle), pa.array(scale), *(pa.array(d[:, k].copy()) for k in range(4)), pa.array(list(weak), pa.list_(pa.int64()))], ["id", "corner", *NAMES, "weak"])

    return map_arrow(images.select("id", "image"), run, DESCRIBED)


# ---- matching ----


def consensus(q: np.ndarray, m: np.ndarray) -> tuple[int, tuple[float, ...]]:
    """Most meetings that agree on one similarity; rows are x, y, angle, scale. Gives the count, and turn, scale, dx, dy."""
    turn = m[:, 2] - q[:, 2]
    grow = m[:, 3] / q[:, 3]
    best, found = 0, (0.0, 1.0, 0.0, 0.0)
    for i in range(len(q)):
        c, s = np.cos(turn[i]) * grow[i], np.sin(turn[i]) * grow[i]
        dx, dy = m[i, 0] - (c * q[i, 0] - s * q[i, 1]), m[i, 1] - (s * q[i, 0] + c * q[i, 1])
        px, py = c * q[:, 0] - s * q[:, 1] + dx, s * q[:, 0] + c * q[:, 1] + dy
        off = np.abs((turn - turn[i] + np.pi) % (2 * np.pi) - np.pi)
        ok = (np.hypot(px - m[:, 0], py - m[:, 1]) <= TOLERANCE) & (off <= MAX_TURN)
        count = min(len(set(zip(q[ok, 0].tolist(), q[ok, 1].tolist()))), len(set(zip(m[ok, 0].tolist(), m[ok, 1].tolist()))))
        if count > best:
            best, found = count, (float((turn[i] + np.pi) % (2 * np.pi) - np.pi), float(grow[i]), float(dx), float(dy))
    return best, found


def _place() -> Column:
    """A corner within its image as one number: x, y, angle and scale (in tenths)."""
    turn = F.round((F.col("angle") + np.pi) * (TURNS / (2 * np.pi))).cast("long")
    return F.shiftleft(F.col("x").cast("long"), 42).bitwiseOR(F.shiftleft(F.col("y").cast("long"), 20)).bitwiseOR(F.shiftleft(turn, 6)).bitwiseOR(F.round(F.col("scale") * 10).cast("long"))


def _placed(place: np.ndarray) -> np.ndarray:
    """Rows of x, y, angle, scale."""
    turn = (place >> 6 & TURNS) * (2 * np.pi / TURNS) - np.pi
    return np.stack([place >> 42 & MAX_SIDE, place >> 20 & MAX_SIDE, turn, (place & 63) / 10], axis=1).astype(float)


MATCH = "query_id long, match_id long, n_matches int, n_inliers int, turn double, scale double, dx double, dy double"


def _words(rows: pa.Table | pa.StructArray) -> np.ndarray:
    """Descriptors as rows of four words."""
    own = rows.field if isinstance(rows, pa.StructArray) else lambda c: rows.column(c).combine_chunks()
    return np.stack([own(f"d{k}").to_numpy(zero_copy_only=False) for k in range(4)], axis=1).view(np.uint64)


def _part(words: np.ndarray, k: int) -> np.ndarray:
    return (words[:, k // 2] >> np.uint64(0 if k % 2 else 32)).astype(np.uint32)


def _tables(words: np.ndarray, weak: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part, what the queries' corners look up, sorted, from where on its owners stand, and those: the part with every choice of its weak bits turned over."""
    out = []
    for k in range(PARTS):
        own = _part(words, k)[:, None]
        for i in range(WEAK):
            own = np.concatenate((own, own ^ (np.uint32(1) << weak[:, WEAK * k + i, None])), axis=1)
        both = own.astype(np.uint64) << np.uint64(32) | np.arange(len(own), dtype=np.uint64)[:, None]  # sorting these is faster than by an index
        both = np.sort(both, axis=None)
        keys = (both >> np.uint64(32)).astype(np.uint32)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        out.append((keys[first], np.append(first, len(keys)), (both & np.uint64(0xFFFFFFFF)).astype(np.int32)))
    return out


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of four words are within MAX_DISTANCE; counts of bits are added two bytes at a time."""
    bits = np.bitwise_count(a ^ b).view(np.uint32).ravel()
    two = (bits & np.uint32(0x00FF00FF)) + (bits >> np.uint32(8) & np.uint32(0x00FF00FF))
    return (two & np.uint32(0xFFFF)) + (two >> np.uint32(16)) <= MAX_DISTANCE


def _meetings(q: np.ndarray, m: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]], image: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Corners (of the queries, of the index) within MAX_DISTANCE that meet in some table, once for each; some whole images of the index (sorted) at a time."""
    at = []
    for k, (keys, first, _) in enumerate(tables):
        own = _part(m, k)
        i = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        lo = first[i]
        at.append((lo, np.where(keys[i] == own, first[i + 1] - lo, 0)))
    ends = np.append(np.flatnonzero(np.diff(image)) + 1, len(image))
    looked = np.cumsum(sum(n for _, n in at))[ends - 1]
    start = done = 0
    while start < len(image):
        i = max(int(np.searchsorted(looked, done + MET, "right")) - 1, int(np.searchsorted(ends, start, "right")))
        stop, mine, theirs = int(ends[i]), [], []
        for (lo, size), (_, _, whose) in zip(at, tables):
            n = size[start:stop]
            b = np.repeat(np.arange(start, stop), n)
            a = whose[np.arange(len(b)) + np.repeat(lo[start:stop] - np.cumsum(n) + n, n)]
            near = np.flatnonzero(_near(q[a], m[b]))
            theirs.append(a[near])
            mine.append(b[near])
        yield np.concatenate(theirs), np.concatenate(mine)
        start, done = stop, int(looked[i])


def _may_agree(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of groups of meetings (rows as _placed, from ``first`` on), those in which consensus() may find MIN_INLIERS: all groups at once, by its own sums, with room for rounding; groups over LOOKED_AT count without a look."""
    q, m = v[:, :4], v[:, 4:]
    size = np.diff(np.append(first, len(v)))
    turn, grow = m[:, 2] - q[:, 2], m[:, 3] / q[:, 3]
    c, s = np.cos(turn) * grow, np.sin(turn) * grow
    dx, dy = m[:, 0] - (c * q[:, 0] - s * q[:, 1]), m[:, 1] - (s * q[:, 0] + c * q[:, 1])
    out = size > LOOKED_AT
    for n in np.unique(size[~out]).tolist():
        of = np.flatnonzero(size == n)
        for part in np.split(of, range(step := max(1, MET // (n * n)), len(of), step)):
            j = first[part][:, None] + np.arange(n)
            i = j[:, :, None]
            j = j[:, None, :]
            px, py = c[i] * q[j, 0] - s[i] * q[j, 1] + dx[i], s[i] * q[j, 0] + c[i] * q[j, 1] + dy[i]
            off = np.abs((turn[j] - turn[i] + np.pi) % (2 * np.pi) - np.pi)
            ok = (np.hypot(px - m[j, 0], py - m[j, 1]) <= TOLERANCE + 1e-6) & (off <= MAX_TURN + 1e-6)
            out[part] = ok.sum(2).max(1) >= MIN_INLIERS
    return out


def _matched(index: pa.Table, queries: pa.Table) -> pa.Table:
    """A block of the index against a block of queries: only pairs of images with a consensus leave it."""
    schema = pa.schema([*((c, pa.int64()) for c in ("query_id", "match_id")), *((c, pa.int32()) for c in ("n_matches", "n_inliers")), *((c, pa.float64()) for c in ("turn", "scale", "dx", "dy"))])
    out: list[tuple] = []
    if index.num_rows and queries.num_rows:
        ids = pc.dictionary_encode(index.column("id").combine_chunks(), null_encoding="encode")
        image = ids.indices.to_numpy()
        order = np.argsort(image, kind="stable")
        image, m, mplace = image[order], _words(index)[order], index.column("place").to_numpy()[order]
        corners = queries.column("corners").combine_chunks()
        owner = np.repeat(np.arange(len(corners)), pc.list_value_length(corners).to_numpy())
        corners = corners.flatten()
        q, qplace = _words(corners), corners.field("place").to_numpy()
        weak = corners.field("weak").flatten().to_numpy().astype(np.uint32).reshape(len(q), -1)
        query_ids = queries.column("id").combine_chunks()
        for a, b in _meetings(q, m, _tables(q, weak), image) if len(q) else ():
            if not len(a):
                continue
            # images that meet too seldom, a corner in some tables counted again, are most: none of them is sorted
            pair = (image[b].astype(np.int64) - image[b[0]]) * len(queries) + owner[a]
            pair -= pair.min()
            often = np.bincount(pair)[pair] >= MIN_INLIERS
            pair, qp, mp, a, b = pair[often], qplace[a[often]], mplace[b[often]], a[often], b[often]
            by = np.lexsort((mp, qp, pair))
            pair, qp, mp, a, b = (x[by] for x in (pair, qp, mp, a, b))
            new = np.concatenate(([True], (np.diff(pair) != 0) | (np.diff(qp) != 0) | (np.diff(mp) != 0)))[: len(pair)]
            pair, qp, mp, a, b = (x[new] for x in (pair, qp, mp, a, b))
            first = np.flatnonzero(np.concatenate(([True], np.diff(pair) != 0))[: len(pair)])
            size = np.diff(np.append(first, len(pair)))
            enough = np.repeat(size >= MIN_INLIERS, size)
            if not enough.any():
                continue
            size = size[size >= MIN_INLIERS]
            v, a, b = np.concatenate((_placed(qp[enough]), _placed(mp[enough])), axis=1), a[enough], b[enough]
            first = np.cumsum(size) - size
            for g in np.flatnonzero(_may_agree(v, first)).tolist():
                own = v[first[g] : first[g] + size[g]]
                n, moved = consensus(own[:, :4], own[:, 4:])
                if n >= MIN_INLIERS:
                    out.append((query_ids[int(owner[a[first[g]]])].as_py(), ids.dictionary[int(image[b[first[g]]])].as_py(), len(own), n, *moved))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)


def match(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Described queries against a described index: pairs with a geometric consensus."""

    words = [f"d{k}" for k in range(4)]
    # each is counted, then read
    weak = F.transform("weak", lambda w: F.log2(w).cast("tinyint")).alias("weak")
    corners = F.collect_list(F.struct("place", *words, "weak")).alias("corners")
    queries = stored(queries.select("id", _place().alias("place"), *words, weak).groupBy("id").agg(corners))[0]
    index = stored(index.select("id", _place().alias("place"), *words))[0]
    parts, query_parts = (max(1, -(-n // size)) for n, size in ((index.count(), IMAGES * CORNERS), (queries.count(), QUERIES)))
    own = lambda n: F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n > 1 else F.lit(0)
    left = index.withColumn("part", own(parts)).withColumn("query_part", every(query_parts))
    right = queries.withColumn("part", every(parts)).withColumn("query_part", own(query_parts))
    by = ["part", "query_part"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_matched, MATCH)


def classes(hashed: DataFrame) -> DataFrame:
    """(id, sha, embedding) -> sha, the smallest id of its class, one embedding of it, and a number as key."""
    groups = hashed.groupBy("sha").agg(F.min("id").alias("class_id"), F.first("embedding").alias("embedding"))
    return cut(groups.withColumn("key", F.monotonically_increasing_id()))


# ---- images of the given tables ----


def _fields() -> np.ndarray:
    """Fixed band-limited random fields, one per dimension of a vector."""
    noise = np.random.RandomState(7).normal(0, 1, (64, SIDE, SIDE)).astype(np.float32)
    band = blur(noise, 1.6) - blur(noise, 4.0)
    return (band / band.std()).reshape(64, -1)


def _edited(image: np.ndarray, i: int) -> np.ndarray:
    """A cropped, turned, recoloured and noisy copy, by the id."""
    r = np.random.RandomState(i % (1 << 32))
    y, x = r.randint(0, SIDE - CROP + 1, 2)
    part = np.rot90(image[y : y + CROP, x : x + CROP], (i // EVERY) % 4)
    return part * 0.8 + 12 + r.uniform(-3, 3, part.shape)


def render(vectors: DataFrame, edited: bool = False) -> DataFrame:
    """(id, seed, embedding) -> id and image; edited copies are edited by their seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = _fields()
        for part in in_parts(batches, DRAWN):
            out = [_drawn(v, fields, i if edited else None) for i, v in zip(part.column("seed").to_pylist(), part.column("embedding").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out, pa.binary())], ["id", "image"])

    return map_arrow(vectors.select("id", "seed", "embedding"), run, "id long, image binary")


def _drawn(vector: list[float] | None, fields: np.ndarray, edit: int | None = None) -> bytes | None:
    if vector is None or len(vector) != 64 or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float32)
    norm = float(np.linalg.norm(v))
    image = 128 + 40 * ((v / norm if norm > 0 and np.isfinite(norm) else np.zeros(64, np.float32)) @ fields).reshape(SIDE, SIDE)
    return write_pgm(image if edit is None else _edited(np.clip(np.rint(image), 0, 255), edit))


def hashed(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) -> id, the SHA-1 of the image, and the embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = _fields()
        for part in in_parts(batches, DRAWN):
            sha = [hashlib.sha1(_drawn(v, fields) or b"").hexdigest() for v in part.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("vec_id").cast(pa.int64()), pa.array(sha, pa.string()), part.column("embedding")], ["id", "sha", "embedding"])

    return map_arrow(vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")), run, "id long, sha string, embedding array<float>")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind member: each row, its image's SHA-1 and its class; kind match: each query and a class that its edited image was found in."""
    rows, _ = stored(hashed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))
    groups = classes(rows)
    named = groups.select(F.col("sha").alias("class_sha"), "class_id", "key")
    members = rows.select("id", "sha").join(named, F.col("sha") == F.col("class_sha")).select(F.lit("member").alias("kind"), "id", "sha", "class_id", "class_sha")
    index = describe(render(groups.select(F.col("key").alias("id"), F.col("key").alias("seed"), "embedding")))
    asked = rows.where(F.col("id") % EVERY == 0).select("id", "sha").distinct().join(groups.select("sha", "embedding"), "sha")
    asked = cut(asked.withColumn("ask", F.monotonically_increasing_id()))
    queries = describe(render(asked.select(F.col("ask").alias("id"), F.col("id").alias("seed"), "embedding"), edited=True))
    figures = ("n_matches", "n_inliers", "turn", "scale", "dx", "dy")
    found = match(queries, index).join(asked.select("ask", "id", "sha"), F.col("query_id") == F.col("ask")).join(named, F.col("match_id") == F.col("key"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in zip(figures, ("int", "int", "double", "double", "double", "double"))]
    return members.select("*", *nothing).union(found.select(F.lit("match"), "id", "sha", "class_id", "class_sha", *figures))


ORACLE_SQL = None
