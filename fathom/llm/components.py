"""Connected components over a link table, by alternating large and small stars.

Labels move only along joins and pre-aggregated minima, so no node's links are
ever gathered; each half step is cut to the shared folder. A hub is a join key
with plain exchanges on both sides, which adaptive execution can split. A step's
partitions follow the number of links, so that few links are few tasks. Up to
``LINKS`` links ``components`` labels in one pass and takes no steps: each step is
ten stages, of which the driver keeps statuses and plans, and a pass over so many
links takes some seconds and about 300 MB of one worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import cut, map_arrow, release


#: Links (16 bytes each) that one task labels.
LINKS = 1 << 21
#: Links of a step's partition; fewer links in all are one partition, whose steps need no exchange.
STEP = 1 << 16


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link to another; root is the least node.

    Links may be null, repeated, in either direction or loops; such rows add nothing.
    """
    edges = _edges(links, a, b)
    return _by_stars(edges, _state(edges))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The same of longs; LINKS different links at most are labelled in one pass, in one task."""
    edges = _edges(links, a, b)
    state = _state(edges)
    if state[0] > LINKS:
        return _by_stars(edges, state)
    return _rooted(cut(map_arrow(edges.coalesce(1), _labelled, "u long, v long")))


def _edges(links: DataFrame, a: str, b: str) -> DataFrame:
    """Different links as (u, v), v the lesser."""
    return cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())


def _by_stars(edges: DataFrame, state: tuple) -> DataFrame:
    while state[0]:
        parts = -(-state[0] // min(LINKS, STEP))
        edges = edges.coalesce(parts)
        both = edges.selectExpr("inline(array(struct(u, v), struct(v AS u, u AS v)))")
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))).coalesce(parts)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large.coalesce(parts)).coalesce(parts)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"))).coalesce(parts)
        other = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(other.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
        new = _state(edges)
        if new == state:
            break
        state = new
    return _rooted(edges)


def _rooted(edges: DataFrame) -> DataFrame:
    """Stars as (node, root), roots included."""
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links as stars: every node but the roots, with its root, the least node it is linked to."""
    held = [np.stack([b.column(c).to_numpy() for c in ("u", "v")]) for b in batches if b.num_rows]
    if not held:
        return
    nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        new, low = root.copy(), np.minimum(root[a], root[b])
        for end in (root[a], root[b], a, b):
            np.minimum.at(new, end, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    rest = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[rest]), pa.array(nodes[root[rest]])], ["u", "v"])
    del held, nodes, at, a, b, root, new, low, rest
    release()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
    return tuple(row)
