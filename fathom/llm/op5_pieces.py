"""SentencePiece encoding and decoding, with Gumbel top-k sampled segmentations.

The lattice of a text has an edge for each vocabulary piece that its characters
spell, and byte pieces for characters outside the vocabulary. A unit is a run of
letters, digits or symbols, and no piece reaches over a unit's end, so the lattice of
a text is the chain of its units' lattices; a unit's lattice, with the share of its
mass behind each edge, is built once per worker.

Segmentations are drawn without replacement by search over the lattice's paths.
The root gets a Gumbel value; the largest value of a subtree passes to the edge
that is drawn, and the rest of the node's edges get one truncated below it. These
values are exact bounds, so best-first search pops segmentations in the order of
their perturbed log-probabilities: the k first are distinct, and distributed as
k draws without replacement. A sample's inclusion score is 1 - exp(-exp(log_prob
- kappa)), with kappa the largest value left. All random numbers are hashes of the
row key, the sample's rank and the place, so a row has the same samples anywhere.

Pieces are weighted by rank (Zipf-Mandelbrot, exponent ``SHARPNESS``), as the
vocabulary file holds merge ranks and no probabilities. Nothing is trained.

Defined cases: null and empty texts have one segmentation, of no pieces; a text
with fewer segmentations than k gives fewer rows; a literal U+2581 is spelled in
bytes, so decoding is exact; null keys are replaced by the text's hash; repeated
rows get the same samples; very long texts are searched ROWS rows at a time, their units one
by one; extra columns are left out, by the stage too, which gives ids and segmentations only; an
empty table gives an empty one.
"""

from __future__ import annotations

import gc
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession

from fathom.llm.common import map_arrow, release, table, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SHARPNESS, SHIFT = 1.0, 2.7
SEED = 0x5EED
#: A run of letters, of digits or of symbols with the spaces before it. No piece mixes
#: these (Vocabulary checks that), so the lattice of a text is the chain of its units'.
UNIT = r" *[^\W\d_{other}]+| *(?:[^\w\s]|[_\r{other}])+|[^\S \r]| *\d+| +"
#: Lattice nodes that a worker keeps.
MAX_NODES = 2_000_000
#: Units and rows that are worked on at a time; their arrays fit a processor's cache.
AT_ONCE, ROWS = 8_192, 512


class Vocabulary:
    """Pieces with weights, their prefixes, and the byte pieces."""

    def __init__(self, pieces: list[str], is_byte: list[bool], is_normal: list[bool], scores: list[float]):
        normal = [i for i in range(len(pieces)) if is_normal[i]]
        ranked = sorted(normal, key=lambda i: (-scores[i], i))
        self.weight, self.prefixes = {}, set()
        # fractions and raised digits in pieces count as symbols
        other = {c for i in ranked for c in pieces[i] if c.isalnum() and not (c.isalpha() or c.isdecimal())}
        self.unit = re.compile(UNIT.format(other="".join(sorted(other))))
        total = sum((r + SHIFT) ** -SHARPNESS for r in range(len(ranked)))
        for r, i in enumerate(ranked):
            spelled = pieces[i].replace("▁", " ")
            if len(self.unit.findall(spelled)) != 1:
                raise ValueError(f"piece {spelled!r} reaches over the end of a unit")
            self.weight[spelled] = (i, (r + SHIFT) ** -SHARPNESS / total)
            self.prefixes.update(spelled[:n] for n in range(1, len(spelled) + 1))
        self.byte_id = {int(pieces[i][3:5], 16): i for i in range(len(pieces)) if is_byte[i]}
        self.byte_weight = (len(ranked) + SHIFT) ** -SHARPNESS / total
        self._by_length()
        self.spelled = [b"" if not (is_normal[i] or is_byte[i]) else bytes([int(p[3:5], 16)]) if is_byte[i] else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def _by_length(self) -> None:
        """The pieces' trie: per depth the sorted (parent, character) and the child; per node its piece (-1: none) and log weight."""
        number = {"": 0} | {x: i for i, x in enumerate(sorted(self.prefixes), 1)}
        self.tables = []
        for n in range(1, max(map(len, self.prefixes)) + 1):
            step = sorted((number[x[:-1]] << 21 | ord(x[-1]), number[x]) for x in self.prefixes if len(x) == n)
            self.tables.append((np.array([k for k, _ in step], np.int64), np.array([c for _, c in step], np.int64)))
        self.node_piece = np.array([self.weight[x][0] if x in self.weight else -1 for x in number], np.int32)
        self.node_log = np.array([math.log(self.weight[x][1]) if x in self.weight else 0.0 for x in number])
        self.byte_ids = np.array([self.byte_id[b] for b in range(256)], np.int32)

    @classmethod
    def load(cls, path: str = MODEL) -> "Vocabulary":
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        byte = [m.is_byte(i) for i in range(n)]
        return cls([m.id_to_piece(i) for i in range(n)], byte, [not (byte[i] or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in range(n)], [m.get_score(i) for i in range(n)])

    def spell(self, ids: list[int]) -> bytes:
        """The UTF-8 bytes of a segmentation, without the space that encoding put in front."""
        return b"".join(map(self.spelled.__getitem__, ids))[1:]

    def decode(self, ids: list[int]) -> str:
        return self.spell(ids).decode("utf-8", "replace")


def byte_count(chars: np.ndarray) -> np.ndarray:
    return 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)


def simple(unit: str) -> bool:
    """Whether the mass of all its segmentations is a normal float: at most 48 bytes."""
    return len(unit) <= 24 and (unit.isascii() or max(unit) < "\u0800")


def lattices(units: list[str], v: Vocabulary, linear: bool) -> tuple[np.ndarray, ...]:
    """The units' lattices, over their characters as nodes: edges (node, length, piece or -1 - character, probability) in node order.

    ``linear``: masses are summed as they are, for simple() units; else as logarithms.
    """
    size = np.fromiter(map(len, units), np.int64, len(units))
    chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    n = len(chars)
    rest = np.repeat(np.cumsum(size), size) - np.arange(n)  # characters to the unit's end
    nodes, lengths, pieces, logs = [], [], [], []
    alive, at_node = np.arange(n), np.zeros(n, np.int64)
    single = np.zeros(n, bool)
    for length, (steps, child) in enumerate(v.tables, 1):
        more = rest[alive] >= length
        alive = alive[more]
        if len(alive) == 0:
            break
        step = at_node[more] << 21 | chars[alive + length - 1]
        at = np.minimum(np.searchsorted(steps, step), len(steps) - 1)
        same = steps[at] == step
        alive, at_node = alive[same], child[at[same]]
        piece = v.node_piece[at_node]
        hit = piece >= 0
        nodes.append(alive[hit]), pieces.append(piece[hit]), logs.append(v.node_log[at_node[hit]])
        lengths.append(np.full(len(nodes[-1]), length, np.int64))
        if length == 1:
            single[nodes[0]] = True
    spell = np.flatnonzero(~single)
    nodes.append(spell), lengths.append(np.ones(len(spell), np.int64)), pieces.append(-1 - chars[spell]), logs.append(math.log(v.byte_weight) * byte_count(chars[spell]))
    node, length, piece, log = (np.concatenate(x) for x in (nodes, lengths, pieces, logs))
    # by node, long pieces first, as they are the likelier; sorting numbers that hold their index is the fastest
    order = np.sort(node << 37 | (31 - length) << 32 | np.arange(len(node))) & 0xFFFFFFFF
    node, length, piece, log = node[order], length[order], piece[order], log[order]
    # the mass of what follows a node, from the units' ends backwards
    last = length == rest[node]
    after = node + np.where(last, 0, length)
    back = np.sort(rest[node] << 32 | np.arange(len(node)))
    edge_at = np.searchsorted(back >> 32, np.arange(1, (rest.max() if n else 0) + 2)).tolist()
    back &= 0xFFFFFFFF
    mass = np.zeros(n)
    if linear:
        weight, end = np.exp(log), 1.0
    else:
        weight, end = log, 0.0
    behind, by, to, ends = node[back], weight[back], after[back], last[back]
    begins = np.append(True, behind[1:] != behind[:-1])
    for a, b in zip(edge_at, edge_at[1:]):
        if a == b:
            continue
        begin = np.flatnonzero(begins[a:b])
        follow = np.where(ends[a:b], end, mass[to[a:b]])
        if linear:
            mass[behind[a:b][begin]] = np.add.reduceat(by[a:b] * follow, begin)
        else:
            value = by[a:b] + follow
            top = np.maximum.reduceat(value, begin)
            mass[behind[a:b][begin]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.append(begin, b - a)))), begin))
    follow = np.where(last, end, mass[after])
    p = weight * follow / mass[node] if linear else np.exp(np.minimum(log + follow - mass[node], 0.0))
    return size, node, length, piece, p, last


class Lattices:
    """The lattices of units that were seen, as flat arrays: node -> edges (cumulative, piece, next node)."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.first = np.empty(MAX_NODES + (1 << 18), np.int64)
        edges = 3 * len(self.first)
        self.cum, self.log = np.empty(edges), np.empty(edges)
        self.piece, self.next = np.empty(edges, np.int32), np.empty(edges, np.int32)
        self.clear()

    def clear(self) -> None:
        self.root: dict[str, int] = {}
        self.n_nodes = self.n_edges = 0

    def _room(self, nodes: int, edges: int) -> None:
        """Arrays that have become too small grow; pages are only taken as they are written."""
        if self.n_nodes + nodes + 1 > len(self.first):
            self.first = np.concatenate((self.first, np.empty(nodes + len(self.first) // 2, np.int64)))
        if self.n_edges + edges > len(self.cum):
            for name in ("cum", "log", "piece", "next"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate((old, np.empty(edges + len(old) // 2, old.dtype))))

    def roots(self, units: list[str]) -> np.ndarray:
        missing = set(units).difference(self.root)
        if missing and self.n_nodes > MAX_NODES:
            self.clear()
            missing = set(units)
        if missing:
            plain = [u for u in missing if simple(u)]
            for own, linear in ((plain, True), ([u for u in missing if not simple(u)] if len(plain) < len(missing) else [], False)):
                for i in range(0, len(own), AT_ONCE):
                    self._add(own[i : i + AT_ONCE], linear)
        return np.fromiter(map(self.root.__getitem__, units), np.int64, len(units))

    def _add(self, units: list[str], linear: bool) -> None:
        size, node, length, piece, p, last = lattices(units, self.v, linear)
        self.root.update(zip(units, (self.n_nodes + np.cumsum(size) - size).tolist()))
        start = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        count = np.diff(np.append(start, len(node)))
        alone = np.repeat(count, count) == 1
        p = np.where(alone, 1.0, np.minimum(p, 1 - 2**-53))
        total = np.cumsum(p)
        cum = total - np.repeat(total[start] - p[start], count)
        cum[start + count - 1] = 2.0  # the last edge takes what rounding leaves
        self._room(len(start), len(node))
        a, b = self.n_edges, self.n_edges + len(node)
        with np.errstate(divide="ignore"):
            self.log[a:b] = np.log(p)
        self.cum[a:b], self.piece[a:b], self.next[a:b] = cum, piece, np.where(last, -1, self.n_nodes + node + length)
        self.first[self.n_nodes : self.n_nodes + len(start)] = a + start
        self.n_nodes += len(start)
        self.n_edges = b
        self.first[self.n_nodes] = b

    def edges_beside(self, edge: int) -> range:
        node = int(np.searchsorted(self.first[: self.n_nodes], edge, side="right")) - 1
        return range(int(self.first[node]), int(self.first[node + 1]))

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, by u in [0, 1)."""
        edge = self.first[node]
        left = np.flatnonzero(u >= self.cum[edge])
        while len(left):
            edge[left] += 1
            left = left[u[left] >= self.cum[edge[left]]]
        return edge

    def paths(self, roots: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws a path through each unit: all edges in order, and how many each unit has."""
        count = np.zeros(len(roots), np.int64)
        steps = []
        unit, node, step = np.arange(len(roots)), roots, 0
        while len(unit):
            edge = self.draw(node, uniform(key[unit], step))
            steps.append((unit, edge))
            count[unit] += 1
            node = self.next[edge]
            on = node >= 0
            unit, node, step = unit[on], node[on], step + 1
        out = np.empty(count.sum(), np.int64)
        begin = np.cumsum(count) - count
        for i, (unit, edge) in enumerate(steps):
            out[begin[unit] + i] = edge
        return out, count


def mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """In (0, 1), by key and salt."""
    return ((mix(key ^ np.uint64(_salted(salt))) >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)


def _salted(salt: int) -> int:
    return (salt * 0xD6E8FEB86659FD93 + 0xA5A5) & _ALL


_ALL = 0xFFFFFFFFFFFFFFFF


def mix1(x: int) -> int:
    """mix() of one number."""
    x = (x + 0x9E3779B97F4A7C15) & _ALL
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _ALL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _ALL
    return x ^ (x >> 31)


def uniform1(key: int, salt: int) -> float:
    return ((mix1(key ^ _salted(salt)) >> 12) + 0.5) / (1 << 52)


def below(bound: np.ndarray | float, location: np.ndarray | float, u: np.ndarray | float) -> np.ndarray:
    """A Gumbel value at the location, given that it is at most the bound."""
    return location - np.logaddexp(location - bound, np.log(-np.log(u)))


class Sample:
    """A path: its edges, the log-probability up to and with each, and the values of what branches off it."""

    __slots__ = ("edges", "unit", "log", "ahead", "value", "branch", "taken", "key")

    def __init__(self, edges: np.ndarray, unit: np.ndarray, log: np.ndarray, ahead: np.ndarray, branch: np.ndarray, value: float, key: int):
        self.edges, self.unit, self.log, self.ahead, self.branch, self.value, self.key = edges, unit, log, ahead, branch, value, key
        self.taken: dict[int, list[int]] = {}


#: Places at the front of a path that are valued first, and what a Gumbel value of 53 random bits stays below.
FRONT, LARGEST = 64, 40.0


def _samples(paths: list[np.ndarray], units: list[np.ndarray], fixed: list[int], values: list[float], keys: list[int], k: int, tables: Lattices) -> list[Sample]:
    """Each path with a value for the rest of every node on it, bounded by the path's own; none for the first ``fixed`` nodes.

    Only the k + 1 largest values matter. Where a node's mass is too small to reach
    those at the path's front, its value isn't worked out.
    """
    size = np.fromiter(map(len, paths), np.int64, len(paths))
    log = tables.log[np.concatenate(paths)]
    end = np.cumsum(size)
    begin = end - size
    spans = list(zip(begin.tolist(), end.tolist()))
    ahead = np.concatenate([np.cumsum(log[b:e]) for b, e in spans])
    row = np.repeat(np.arange(len(paths)), size)
    place = np.arange(len(log)) - begin[row]
    branch = np.full(len(log), -np.inf)
    bound, key, first = np.array(values), np.array(keys, np.uint64), np.array(fixed)

    def fill(at: np.ndarray) -> None:
        location = ahead[at] - log[at] + np.log(-np.expm1(log[at]))
        branch[at] = below(bound[row[at]], location, uniform(mix(place[at].astype(np.uint64) ^ key[row[at]]), 1))

    open_ = (log < 0) & (place >= first[row])
    front = place < first[row] + FRONT
    fill(np.flatnonzero(open_ & front))
    least = np.full(len(paths), -np.inf)
    for i, (b, e) in enumerate(spans):
        own = branch[b + fixed[i] : min(b + fixed[i] + FRONT, e)]
        if len(own) > k:
            least[i] = np.partition(own, len(own) - k - 1)[len(own) - k - 1]
    fill(np.flatnonzero(open_ & ~front & (ahead - log > least[row] - LARGEST)))
    return [Sample(p, u, log[b:e], ahead[b:e], branch[b:e], v, key_) for p, u, (b, e), v, key_ in zip(paths, units, spans, values, keys)]


def search(texts: list[str], keys: list[int], k: int, tables: Lattices) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text up to k of (edges, log-probability, perturbed value, inclusion score), best first."""
    units = [tables.v.unit.findall(" " + t) if t else [] for t in texts]
    size = np.fromiter(map(len, units), np.int64, len(units))
    roots = tables.roots([u for x in units for u in x])
    begin = np.cumsum(size) - size
    found: list[list[Sample]] = [[] for _ in texts]
    nothing = np.zeros(0, np.int64)
    # what each text draws next: its first new unit, the edges before, their units, the value, the nodes before
    todo = {i: (0, nothing, nothing, -math.log(-math.log(uniform1(keys[i], 7))), 0) for i in range(len(texts))}
    for rank in range(k):
        if not todo:
            break
        rows = list(todo)
        n_new = np.array([size[i] - todo[i][0] for i in rows])
        ends = np.cumsum(n_new)
        in_text = np.arange(n_new.sum()) - np.repeat(ends - n_new, n_new) + np.repeat(np.array([todo[i][0] for i in rows]), n_new)
        at = in_text + np.repeat(begin[rows], n_new)
        row_keys = [mix1(keys[i] ^ (rank + 1)) for i in rows]
        edges, count = tables.paths(roots[at], mix(np.repeat(np.array(row_keys, np.uint64), n_new) ^ in_text.astype(np.uint64)))
        unit_of = np.repeat(in_text, count)
        bounds = np.append(0, np.cumsum(count))[np.append(0, ends)].tolist()
        paths, units_of = [], []
        for n, i in enumerate(rows):
            _, before, before_unit, _, _ = todo[i]
            s, e = bounds[n], bounds[n + 1]
            paths.append(np.concatenate((before, edges[s:e])) if len(before) else edges[s:e])
            units_of.append(np.concatenate((before_unit, unit_of[s:e])) if len(before) else unit_of[s:e])
        for i, sample in zip(rows, _samples(paths, units_of, [todo[i][4] for i in rows], [todo[i][3] for i in rows], row_keys, k, tables)):
            found[i].append(sample)
        todo = {} if rank + 1 == k else {i: x for i in rows if (x := _next(found[i], tables)) is not None}
    out = []
    for samples in found:
        left = max((float(s.branch.max()) for s in samples if len(s.branch)), default=-math.inf)
        got = []
        for s in samples:
            log = float(s.ahead[-1]) if len(s.ahead) else 0.0
            got.append((s.edges, log, s.value, 1.0 if left == -math.inf else -math.expm1(-math.exp(min(log - left, 700.0)))))
        out.append(got)
    return out


def _next(samples: list[Sample], tables: Lattices):
    """Takes the largest value off the branches: the edges up to there, the new edge, and where drawing goes on."""
    best, i, value = None, 0, -math.inf
    for s in samples:
        if len(s.branch) and (v := s.branch[j := int(s.branch.argmax())]) > value:
            best, i, value = s, j, float(v)
    if best is None:
        return None
    edge = int(best.edges[i])
    taken = best.taken.setdefault(i, [edge])
    choice = [e for e in tables.edges_beside(edge) if e not in taken]
    p = [math.exp(tables.log[e]) for e in choice]
    key = mix1(best.key ^ (i << 8) ^ len(taken))
    u = uniform1(key, 2) * sum(p)
    new = choice[-1]
    for e, x in zip(choice, p):
        u -= x
        if u < 0:
            new = e
            break
    taken.append(new)
    rest = sum(x for e, x in zip(choice, p) if e != new)
    best.branch[i] = below(value, float(best.ahead[i] - best.log[i]) + math.log(rest), uniform1(key, 3)) if rest > 0 else -math.inf
    # the rest of this unit is drawn here, the units after it with those of other texts
    edges = [new]
    while (node := int(tables.next[edges[-1]])) >= 0:
        u, e = uniform1(key, 100 + len(edges)), int(tables.first[node])
        while u >= tables.cum[e]:
            e += 1
        edges.append(e)
    unit = int(best.unit[i])
    return unit + 1, np.concatenate((best.edges[:i], edges)), np.concatenate((best.unit[:i], np.full(len(edges), unit))), value, i + 1


def piece_ids(edges: np.ndarray, tables: Lattices) -> np.ndarray:
    """Piece ids of a path; characters outside the vocabulary as bytes."""
    ids = tables.piece[edges]
    spell = np.flatnonzero(ids < 0)
    if len(spell) == 0:
        return ids
    chars = -1 - ids[spell]
    if chars.max() < 0x80:
        ids[spell] = tables.v.byte_ids[chars]
        return ids
    size = np.ones(len(ids), np.int64)
    size[spell] = byte_count(chars)
    out = np.repeat(ids, size)
    out[np.repeat(ids < 0, size)] = tables.v.byte_ids[np.frombuffer("".join(map(chr, chars.tolist())).encode("utf-8", "surrogatepass"), np.uint8)]
    return out


#: Per worker process and vocabulary: lattices are the same for every task.
_worker: dict[str, Lattices] = {}
ENCODED = "rank int, n_pieces long, log_prob double, perturbed double, inclusion double, ids array<int>"


def encode(docs: DataFrame, key: str = "doc_id", k: int = SAMPLES, model: str = MODEL, digest: bool = False) -> DataFrame:
    """Up to k sampled segmentations per row: key, rank, their scores and ids; with ``digest`` also the ids' digest and whether they decode to the text."""
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))  # one vocabulary: its size doesn't follow the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and collecting walks all cached units
        try:
            yield from sampled(batches)
        finally:
            gc.enable()

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        v = held.value
        tables = _worker.get(model)
        if tables is None:
            tables = _worker[model] = Lattices(v)
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = part.column("key").to_pylist()
                keys = [mix1((i & _ALL) ^ SEED) if i is not None else xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), SEED) for i, t in zip(ids, texts)]
                rows = []
                for i, t, samples in zip(ids, texts, search(texts, keys, k, tables)):
                    raw = utf8(t) if digest else b""
                    for rank, (edges, log, value, inclusion) in enumerate(samples, 1):
                        got = piece_ids(edges, tables)
                        tail = (format(xxhash.xxh64_intdigest(got.tobytes()), "016x"), v.spell(got.tolist()) == raw) if digest else ()
                        rows.append((i, rank, len(got), log, value, inclusion, got, *tail))
                if rows:
                    types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int32()), *((pa.string(), pa.bool_()) if digest else ())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), types)], names)

    names = [key, "rank", "n_pieces", "log_prob", "perturbed", "inclusion", "ids", *(("ids_digest", "round_trip") if digest else ())]
    schema = f"`{key}` long, " + ENCODED + (", ids_digest string, round_trip boolean" if digest else "")
    return map_arrow(docs.selectExpr(f"cast(`{key}` AS long) AS key", "text"), run, schema)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Adds the text of ``ids``; null ids give null."""
    held = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if i is None else held.value.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema] + ["decoded string"])
    return map_arrow(encoded, run, schema)


def encode_plain(docs: DataFrame, key: str = "doc_id", model: str = MODEL) -> DataFrame:
    """The vocabulary's own segmentation by merges, without sampling: key and ids."""
    with open(model, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sentencepiece.SentencePieceProcessor(model_proto=held.value)
        for batch in batches:
            ids = m.encode([t or "" for t in batch.column("text").to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return map_arrow(docs.selectExpr(f"cast(`{key}` AS long) AS key", "text"), run, f"`{key}` long, ids array<int>")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digest=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' sampled segmentations; copies that the mix made get the same ones."""
    return encode(docs, digest=True)


ORACLE_SQL = None
