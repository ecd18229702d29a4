"""The stored inverted index: segments of postings, kept in step by deltas and merges.

A posting is a term within a field of a row: its count, its positions, and the row's length. A
segment holds the postings of the rows that one change wrote, in folders by a hash
of the term and sorted by term and impact within, so that a search reads its terms' folders and row
groups and no text. Names as a whole are postings of a field of their own. A changed
or removed row isn't taken out of older segments: the change writes its id and segment to the table
``gone``, and searches leave those postings out until a merge drops them. Rows and their total length
are summed per segment, so statistics take no scan.

Tables of a segment: postings, rows (id, hash of the fields, length), gone (id, dead_segment, dl),
and stats (segment, n, total). They're plain frames; plans.index stores them with the
snippets in one version, and a job writes them as partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import tokens
from fathom.operators import lexical
from fathom.operators.store import checkpointed

#: Folders of terms in a segment, and the parts that each is written in, so that one frequent term isn't one task's.
BUCKETS, SPREAD = 16, 16
#: Rows whose postings a task makes at once.
ROWS_AT_ONCE = 1024
NAME_FIELD = -1
FIELDS = ("name", "content", "summary")
#: A merge takes older segments in while they are at most this many times what it has.
MERGE_RATIO = 2
#: Dead rows up to which they're sent to every task (16 bytes each); beyond it they're joined by id.
BROADCAST_ROWS = 1 << 20
POSTINGS = "bucket int, term string, id {id}, field int, tf int, dl int, positions array<int>"
ROWS = "id {id}, h long, dl int"
GONE = "id {id}, dead_segment int, dl int"
STATS = "segment int, n long, total long"


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def row_hash(fields: tuple[str, ...]) -> Column:
    """Tells whether a row's indexed fields are the same; null and empty differ."""
    return F.xxhash64(*[x for f in fields for x in (F.col(f).isNull(), F.col(f))])


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


def postings_of(rows: DataFrame, fields: tuple[str, ...] = FIELDS, name: str | None = "name", buckets: int = BUCKETS) -> DataFrame:
    """The postings of rows: made where the texts are read, then one shuffle by term and a part of the id, and a sort.

    A row's length is that of all its fields together; rows without tokens have no posting but their name's.
    """
    names = [F.col(name).alias("_name")] if name else [F.lit(None).cast("string").alias("_name")]
    lists = rows.select("id", *names, *[tokens(F.col(f)).alias(f"_t{i}") for i, f in enumerate(fields)])
    found = lists.mapInArrow(lambda batches: grouped(batches, len(fields)), f"term string, id {lists.schema['id'].dataType.simpleString()}, field int, dl int, positions array<int>")
    bucket = bucket_of(F.col("term"), buckets)
    dealt = found.repartition(bucket, F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
    return dealt.select(bucket.alias("bucket"), "term", "id", "field", F.size("positions").alias("tf"), "dl", "positions").sortWithinPartitions("bucket", "term", F.desc("tf"), "dl", "id")


def grouped(batches: Iterator[pa.RecordBatch], n_fields: int) -> Iterator[pa.RecordBatch]:
    """Rows of tokens (id, _name, _t0..) as one row per term of a row's field; the rows of a term stand together, so that a shuffle compresses them."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(at, ROWS_AT_ONCE)
            ids, n = batch.column("id"), batch.num_rows
            lists = [batch.column(f"_t{i}") for i in range(n_fields)]
            sizes = [pc.list_value_length(t).to_numpy(zero_copy_only=False).astype(np.int64) for t in lists]
            dl = np.sum(sizes, axis=0).astype(np.int32)
            for field, (tokens_of, size) in enumerate(zip(lists, sizes)):
                total = int(size.sum())
                if total:
                    terms = tokens_of.flatten().dictionary_encode()
                    row, place = np.repeat(np.arange(n), size), np.arange(total) - np.repeat(np.cumsum(size) - size, size)
                    key = terms.indices.to_numpy().astype(np.int64) * n + row
                    order = np.argsort(key, kind="stable")
                    first = np.flatnonzero(np.diff(key[order], prepend=-1))
                    mine = key[order[first]]
                    positions = pa.ListArray.from_arrays(pa.array(np.append(first, total), pa.int32()), pa.array(place[order], pa.int32()))
                    yield _postings(terms.dictionary.take(pa.array(mine // n)), ids.take(pa.array(mine % n)), field, dl[mine % n], positions)
            named = np.flatnonzero(batch.column("_name").is_valid().to_numpy(zero_copy_only=False))
            if len(named):
                own = pa.array(named)
                zeros = pa.ListArray.from_arrays(pa.array(np.arange(len(named) + 1), pa.int32()), pa.array(np.zeros(len(named)), pa.int32()))
                yield _postings(batch.column("_name").take(own), ids.take(own), NAME_FIELD, dl[named], zeros)


def _postings(terms: pa.Array, ids: pa.Array, field: int, dl: np.ndarray, positions: pa.ListArray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([terms, ids, pa.array(np.full(len(terms), field), pa.int32()), pa.array(dl, pa.int32()), positions], ["term", "id", "field", "dl", "positions"])


def rows_of(rows: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """id, hash and length of each row. The texts are split once more for it, and nothing moves."""
    size = reduce(lambda a, b: a + b, [F.size(tokens(F.col(f))) for f in fields])
    return rows.select("id", row_hash(fields).alias("h"), size.alias("dl"))


def live_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of all segments (with a column segment) but for the dead ones."""
    dead = gone.select(F.col("id").alias("_id"), F.col("dead_segment").alias("_s"))
    return rows.join(dead, (F.col("id") == F.col("_id")) & (F.col("segment") == F.col("_s")), "left_anti")


def changes(rows: DataFrame, live: DataFrame, fields: tuple[str, ...] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """Ids to index anew (new or changed), and what goes (id, dead_segment, dl): a join of hashes, no texts.

    ``rows`` is the whole state that the index shall have, ``live`` what it has.
    """
    now = rows.select("id", row_hash(fields).alias("_now"))
    both = checkpointed(now.join(live.select("id", "h", "segment", "dl"), "id", "full").where("_now IS NULL OR h IS NULL OR _now <> h"))
    return both.where("_now IS NOT NULL").select("id"), both.where("h IS NOT NULL").select("id", F.col("segment").alias("dead_segment"), "dl")


def replaced(ids: DataFrame, live: DataFrame) -> DataFrame:
    """What goes where the rows of some ids are written anew and all others stay."""
    return live.join(ids.select("id"), "id", "left_semi").select("id", F.col("segment").alias("dead_segment"), "dl")


def stats_of(segment: int, rows: DataFrame) -> DataFrame:
    return rows.agg(F.lit(segment).alias("segment"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total"))


def to_merge(sizes: dict[int, int]) -> list[int]:
    """The newest segments that are merged: each older one joins while it isn't much larger than the newer ones together. So a row is rewritten a logarithmic number of times."""
    taken, total = [], 0
    for segment in sorted(sizes, reverse=True):
        if taken and sizes[segment] > MERGE_RATIO * total:
            break
        taken.append(segment)
        total += sizes[segment]
    return taken if len(taken) > 1 else []


@dataclass
class Index:
    """A stored index as frames of all its segments. ``postings`` and ``rows`` have a column segment."""

    postings: DataFrame
    rows: DataFrame
    gone: DataFrame
    stats: DataFrame
    fields: tuple[str, ...] = FIELDS
    buckets: int = BUCKETS

    def totals(self) -> tuple[int, float, int]:
        """Live rows, their mean length, and dead rows not yet merged away: from sums per segment."""
        s = self.stats.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("t")).first()
        g = self.gone.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
        n = s["n"] - g["n"]
        return n, ((s["t"] - g["t"]) / n if n else 0.0) or 1.0, g["n"]

    def alive(self, postings: DataFrame, n_gone: int) -> DataFrame:
        if not n_gone:
            return postings
        dead = self.gone.select(F.col("id").alias("_id"), F.col("dead_segment").alias("_s"))
        dead = F.broadcast(dead) if n_gone <= BROADCAST_ROWS else dead
        return postings.join(dead, (F.col("id") == F.col("_id")) & (F.col("segment") == F.col("_s")), "left_anti")

    def of_terms(self, terms: list[str], names: list[str], n_gone: int) -> DataFrame:
        """Live postings of a query's terms and names: folders and row groups of others aren't read."""
        spark = self.postings.sparkSession
        every = sorted({*terms, *names})
        if not every:
            return self.postings.where("false")
        numbers = spark.createDataFrame([(t,) for t in every], "t string").select(bucket_of(F.col("t"), self.buckets).alias("b")).distinct()
        buckets = [r["b"] for r in numbers.collect()]  # of one query's terms
        wanted = (F.col("field") >= 0) & F.col("term").isin(terms) if terms else F.lit(False)
        if names:
            wanted = wanted | ((F.col("field") == NAME_FIELD) & F.col("term").isin(names))
        return self.alive(self.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(every) & wanted), n_gone)

    def counted(self, phrases: list[list[str]], names: list[str], n_gone: int) -> DataFrame:
        """id, dl, tf0.. and nm0.. of the rows that hold any of the phrases or names."""
        terms = sorted({t for p in phrases for t in p})
        found = self.of_terms(terms, names, n_gone)
        in_phrases = {t for p in phrases if len(p) > 1 for t in p}
        columns = []
        for i, t in enumerate(terms):
            mine = (F.col("field") >= 0) & (F.col("term") == t)
            columns.append(F.sum(F.when(mine, F.col("tf")).otherwise(0)).cast("int").alias(f"_n{i}"))
            if t in in_phrases:
                columns.append(F.max(F.when(mine, F.col("positions"))).alias(f"_p{i}"))
        flags = [F.max((F.col("field") == NAME_FIELD) & (F.col("term") == n)).alias(f"nm{i}") for i, n in enumerate(names)]
        each = found.repartition("id").groupBy("id", "field").agg(F.max("dl").alias("dl"), *columns, *flags)

        def of(phrase: list[str]) -> Column:
            if len(phrase) == 1:
                return F.col(f"_n{terms.index(phrase[0])}")
            at = [_shifted(F.col(f"_p{terms.index(t)}"), k) for k, t in enumerate(phrase)]
            return F.coalesce(F.size(reduce(F.array_intersect, at)), F.lit(0))

        counts = each.select("id", "dl", *[F.greatest(of(p), F.lit(0)).alias(f"tf{i}") for i, p in enumerate(phrases)], *[f"nm{i}" for i in range(len(names))])
        sums = [F.sum(f"tf{i}").cast("int").alias(f"tf{i}") for i in range(len(phrases))] + [F.max(f"nm{i}").alias(f"nm{i}") for i in range(len(names))]
        whole = counts.groupBy("id").agg(F.max("dl").alias("dl"), *sums)
        hit = [F.col(f"tf{i}") > 0 for i in range(len(phrases))] + [F.col(f"nm{i}") for i in range(len(names))]
        return whole.where(reduce(lambda a, b: a | b, hit))

    def staged_search(self, query: str, limit: int = 50, texts: Callable[[], DataFrame] | None = None) -> DataFrame:
        """As lexical.staged_search, over the stored postings. ``texts`` gives the rows for LIKE, which is only asked where no stage found any."""
        exact, stages, phrases = lexical.stages_of(query)
        if not lexical.terms_of(query):
            return self.rows.select("id").limit(0).select("id", F.lit(0).alias("stage"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("position"))
        n, mean, n_gone = self.totals()
        names = list(dict.fromkeys(exact))
        if phrases or names:
            seen = self.counted(phrases, names, n_gone)
        else:
            seen = self.rows.select("id", "dl").limit(0)
        seen = checkpointed(seen.select("id", "dl", *[f"tf{i}" for i in range(len(phrases))], *[F.col(f"nm{names.index(t)}").alias(f"nm{i}") for i, t in enumerate(exact)]))
        dfs = lexical.frequencies(seen, len(phrases))
        like = (lambda: lexical.like(texts(), query, self.fields)) if texts else (lambda: self.rows.where("false"))
        return lexical.staged(seen, (n, mean, dfs), exact, stages, phrases, limit, like)

    def search_many(self, queries: DataFrame, k: int) -> DataFrame:
        """Top k by BM25 of any term for every (query_id, query), field for field as lexical.search_many; reads the postings only.

        See lexical.best_many for the bounds that spare common terms.
        """
        n, mean, n_gone = self.totals()
        wanted = lexical.wanted_terms(queries)
        # positions aren't read; the terms of all queries stand at most once each
        some = self.postings.where("field >= 0").select("bucket", "segment", "term", "id", "tf", "dl")
        keys = wanted.select(bucket_of(F.col("term"), self.buckets).alias("bucket"), "term").distinct()
        held = self.alive(some.join(keys, ["bucket", "term"], "left_semi"), n_gone)
        if len(self.fields) > 1:
            held = held.groupBy("term", "id").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))
        return lexical.best_many(held, wanted, n, mean, k)

    def live(self) -> DataFrame:
        """The postings without those of dead rows, as a merge writes them."""
        return self.alive(self.postings, self.totals()[2])

    def verify(self, rows: DataFrame) -> DataFrame:
        """One row: live postings, those a rebuild has besides (missing), and those it hasn't (extra)."""
        columns = ["term", "id", "field", "tf", "dl", "positions"]
        have, want = self.live().select(*columns), postings_of(rows, self.fields, "name" if "name" in rows.columns else None, self.buckets).select(*columns)
        both = have.select("*", F.lit(1).alias("_h")).union(want.select("*", F.lit(-1).alias("_h")))
        diff = both.groupBy(*columns).agg(F.sum("_h").alias("d"), F.sum(F.when(F.col("_h") > 0, 1).otherwise(0)).alias("n"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        return diff.agg(total("n").alias("postings"), total(F.when(F.col("d") < 0, -F.col("d"))).alias("missing"), total(F.when(F.col("d") > 0, F.col("d"))).alias("extra"))
