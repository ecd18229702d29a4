"""Keyword search: BM25 over phrases, and the staged search from exact to fuzzy.

A query's few phrases are counted within each row's text, which is brought to one form
first: every token between two spaces of its own. So a search is one scan that leaves a
narrow row per text (its tokens' number and the phrases' counts); statistics, which are
one row, and all stages come from those. Many queries share one join on terms.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import MARKED, PLAIN, folded, tokens
from fathom.operators.store import checkpointed

# Saturation, length weight, and the least inverse document frequency.
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Scores are compared after rounding to six digits.
ROUNDING = 2e-6
#: Up to so many postings for all queries together, each is scored; beyond it bounds spare those of common terms, in more steps. The result is the same.
PAIRS = 50_000_000
#: Up to so many terms of queries (24 bytes each, with the term) are sent to every task, which then scores whole rows and gives the best of them only.
ASKED = 1 << 18
#: Scores, and parts of scores, that a task holds at once.
CELLS, PARTS = 1 << 19, 1 << 21


def fold(text: str) -> list[str]:
    """The tokens of a query string, as tokens() makes them of a column."""
    low = text.lower().translate(str.maketrans(MARKED, PLAIN))
    return re.findall(r"[^\W_]+", low)


def terms_of(query: str) -> list[str]:
    return re.findall(r"[a-zA-Z0-9_.]+", query.strip())


def spaced(text: Column) -> Column:
    """The text with each token between two spaces of its own, and nothing but spaces else."""
    return F.concat(F.lit(" "), F.regexp_replace(folded(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))


def occurrences(text: Column, phrase: list[str]) -> Column:
    """How often the phrase's tokens stand one after another in a spaced text, overlaps included."""
    whole = "".join(f" {t} " for t in phrase)
    if any(phrase[:n] == phrase[-n:] for n in range(1, len(phrase))):  # it can overlap itself
        return F.regexp_count(text, F.lit(f"(?={whole})"))
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(whole), F.lit("")))) / len(whole)).cast("int")


def length(text: Column) -> Column:
    """The tokens of a spaced text: a pair of spaces each, and one more where the text has other signs at an end."""
    pairs = F.floor((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / 2).cast("int")
    return F.when(F.length(text) <= 2, 0).otherwise(pairs - text.startswith("   ").cast("int") - text.endswith("   ").cast("int"))


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def counted(rows: DataFrame, phrases: list[list[str]], fields: tuple[str, ...]) -> DataFrame:
    """Adds tf0.. (per phrase, within fields) and dl, the row's tokens."""
    names = [f"_spaced{i}" for i in range(len(fields))]
    texts = [F.col(n) for n in names]
    found = [_sum([occurrences(t, p) for t in texts]).alias(f"tf{i}") for i, p in enumerate(phrases)]
    given = rows.columns
    return rows.select("*", *[spaced(F.col(f)).alias(n) for f, n in zip(fields, names)]).select(*given, *found, _sum([length(t) for t in texts]).alias("dl"))


def statistics(found: DataFrame, n_phrases: int) -> tuple[int, float, list[int]]:
    """Rows, mean length, and rows per phrase: one aggregate row."""
    r = found.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(n_phrases)]).first()
    return r["n"], r["avgdl"] or 1.0, [r[f"df{i}"] for i in range(n_phrases)]


def frequencies(found: DataFrame, n_phrases: int) -> list[int]:
    """Rows per phrase."""
    r = found.agg(F.count(F.lit(1)), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(n_phrases)]).first()
    return [r[f"df{i}"] for i in range(n_phrases)]


def idf(n: int, df: int) -> float:
    value = math.log((n - df + 0.5) / (df + 0.5)) if n else 0.0
    return value if value > 0 else LEAST_IDF


def bm25(rows: DataFrame, phrases: list[list[str]], fields: tuple[str, ...] = ("content",)) -> DataFrame:
    """id, dl, tf0.. and ``bm25`` of every row; those without any of the phrases have 0. Repeated phrases count again.

    The texts are scanned once; the narrow rows are cut, as the statistics and the scores both read them.
    """
    found = checkpointed(counted(rows, phrases, fields).select("id", "dl", *[f"tf{i}" for i in range(len(phrases))]))
    n, avgdl, dfs = statistics(found, len(phrases))
    return found.withColumn("bm25", weighed(range(len(phrases)), n, avgdl, dfs))


def weighed(columns, n: int, avgdl: float, dfs: list[int]) -> Column:
    """The score of the phrases whose counts are tf0, tf1, ..., by their numbers."""
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(avgdl))
    return _sum([F.lit(idf(n, dfs[i])) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + norm) for i in columns]).cast("double")


def matches(n_phrases: int, every: bool) -> Column:
    hits = [F.col(f"tf{i}") > 0 for i in range(n_phrases)]
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), hits)


def _best(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.desc("bm25"), "id").limit(limit)


def like(rows: DataFrame, pattern: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows that hold the raw query, with LIKE's wildcards, in any case."""
    return rows.where(reduce(lambda a, b: a | b, [F.col(f).ilike(f"%{pattern}%") for f in fields]))


def named(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Rows whose name is one of the terms, letter for letter."""
    return rows.where(F.col("name").isin(terms))


def stages_of(query: str) -> tuple[list[str], list[tuple[list[list[str]], bool]], list[list[str]]]:
    """A query's exact names, its stages (phrases, and whether a row needs all of them), and the distinct phrases of all stages."""
    terms = terms_of(query)
    tech = [t for t in terms if len(t) > 1]
    exact = [t for t in tech if len(t) >= 3]
    stages: list[tuple[list[list[str]], bool]] = []
    if tech:
        if len(tech) > 1:
            stages.append(([fold(" ".join(tech))], True))
        if not any("." in t for t in tech):
            stages += [([fold(t) for t in tech], True), ([fold(t) for t in tech], False)]
    elif not any("." in t for t in terms):
        stages.append(([fold(t) for t in terms], False))
    stages = [([p for p in phrases if p], every) for phrases, every in stages]
    return exact, stages, [list(p) for p in dict.fromkeys(tuple(p) for found, _ in stages for p in found)]


def staged_search(rows: DataFrame, query: str, limit: int = 50, fields: tuple[str, ...] = ("name", "content", "summary")) -> DataFrame:
    """Exact names, then phrase, all terms, any term, then LIKE: id, stage, rank, position.

    A stage adds up to ``limit`` rows and runs while fewer than ``limit`` were found;
    the first stage that finds a row keeps it; LIKE runs if nothing was found.
    Stages with a dotted term, which the query syntax rejects, are skipped, except
    the quoted phrase. Ties are broken by id.
    """
    if not terms_of(query):
        return rows.select("id").limit(0).select("id", F.lit(0).alias("stage"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("position"))
    exact, stages, phrases = stages_of(query)
    # one scan: what is read from here on are narrow rows
    names = [F.coalesce(F.col("name") == t, F.lit(False)).alias(f"nm{i}") for i, t in enumerate(exact)]
    seen = checkpointed(counted(rows, phrases, fields).select("id", "dl", *[f"tf{i}" for i in range(len(phrases))], *names))
    return staged(seen, statistics(seen, len(phrases)), exact, stages, phrases, limit, lambda: like(rows, query, fields))


def first_stages(rows: DataFrame, query: str, names: list[str], name_limit: int, fields: tuple[str, ...] = ("content",)) -> DataFrame:
    """Every row that a stage finds, and the first one that does (id, stage): no limit, no stop rule, no LIKE.

    Stages have the numbers of staged_search; of its exact names only ``names`` are looked up, ``name_limit`` rows of each by id.
    One scan; what moves is an id and a stage per row found.
    """
    exact, stages, phrases = stages_of(query)
    at = {t: i for i, t in enumerate(exact) if t in names}
    flags = [F.coalesce(F.col("name") == t, F.lit(False)).alias(f"nm{i}") for t, i in at.items()]
    seen = checkpointed(counted(rows, phrases, fields).select("id", *[f"tf{i}" for i in range(len(phrases))], *flags))
    for i in at.values():
        if seen.where(f"nm{i}").count() > name_limit:
            last = seen.where(f"nm{i}").orderBy("id").limit(name_limit).agg(F.max("id")).first()[0]
            seen = seen.withColumn(f"nm{i}", F.col(f"nm{i}") & (F.col("id") <= F.lit(last)))
    found = [F.when(F.col(f"nm{i}"), i) for i in at.values()]
    for i, (own, every) in enumerate(stages, len(exact)):
        if own:
            hits = [F.col(f"tf{phrases.index(p)}") > 0 for p in own]
            found.append(F.when(reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), hits), i))
    return seen.select("id", F.coalesce(*found, F.lit(None)).alias("stage")).where("stage IS NOT NULL").groupBy("id").agg(F.min("stage").alias("stage"))


def staged(seen: DataFrame, stats: tuple[int, float, list[int]], exact: list[str], stages: list, phrases: list, limit: int, fallback) -> DataFrame:
    """The stages over counted rows (id, dl, tf0.., nm0..), which may leave out those without a hit; ``fallback`` gives the rows of LIKE."""
    n_rows, avgdl, dfs = stats
    parts = [_ranked(seen.where(f"nm{i}").orderBy("id").limit(limit), i, ["id"]) for i in range(len(exact))]
    found = _first_wins(parts) if parts else None
    n = found.count() if found is not None else 0
    for i, (own, every) in enumerate(stages):
        if n >= limit:
            break
        if not own:
            continue
        at = [phrases.index(p) for p in own]
        hits = seen.where(reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), [F.col(f"tf{k}") > 0 for k in at]))
        parts.append(_ranked(_best(hits.withColumn("bm25", weighed(at, n_rows, avgdl, dfs)), limit), len(exact) + i, [F.desc("bm25"), "id"]))
        found = _first_wins(parts)
        n = found.count()
    if n == 0:
        found = _first_wins([_ranked(fallback().orderBy("id").limit(limit), len(exact) + len(stages), ["id"])])
    order = Window.orderBy("stage", "rank")
    return found.select("id", "stage", "rank", F.row_number().over(order).cast("long").alias("position"))


def _ranked(hits: DataFrame, stage: int, order: list) -> DataFrame:
    """At most ``limit`` rows, so the window is as small."""
    return hits.select("id", F.lit(stage).alias("stage"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


def _first_wins(parts: list[DataFrame]) -> DataFrame:
    whole = reduce(DataFrame.union, parts)
    return whole.groupBy("id").agg(F.min(F.struct("stage", "rank")).alias("s")).select("id", "s.stage", "s.rank")


def merged_lists(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two ranked lists (id, position) one after the other, each id once."""
    both = first.select("id", F.lit(0).alias("list"), "position").union(second.select("id", F.lit(1).alias("list"), "position"))
    once = both.groupBy("id").agg(F.min(F.struct("list", "position")).alias("s"))
    return once.select("id", F.row_number().over(Window.orderBy("s.list", "s.position")).cast("long").alias("position"))


def postings(rows: DataFrame, field: str = "content") -> DataFrame:
    """(id, term, tf, dl): the inverted index as a table, for many queries at once."""
    return _counted_terms(_listed(rows, field))


def _listed(rows: DataFrame, field: str) -> DataFrame:
    return rows.select("id", tokens(F.col(field)).alias("t")).select("id", F.size("t").alias("dl"), F.explode("t").alias("term"))


def _counted_terms(listed: DataFrame) -> DataFrame:
    return listed.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def search_many(rows: DataFrame, queries: DataFrame, k: int, field: str = "content") -> DataFrame:
    """Top k by BM25 of any term for every (query_id, query): one join on terms instead of a scan per query.

    Texts are split once; the postings of the queries' terms are cut, with one of an empty term per row, which tells the
    rows' number and lengths.
    """
    wanted = wanted_terms(queries)
    terms = wanted.select("term").distinct().union(rows.sparkSession.createDataFrame([("",)], "term string"))
    listed = rows.select("id", tokens(F.col(field)).alias("t")).select("id", F.size("t").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("term"))
    hit = checkpointed(_counted_terms(listed.join(terms, "term", "left_semi")))
    stats = hit.where("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    return best_many(hit.where("term <> ''"), wanted, stats["n"], stats["avgdl"] or 1.0, k)


def wanted_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, times: a term that a query repeats counts again."""
    return checkpointed(queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")))


def best_many(held: DataFrame, wanted: DataFrame, n: int, mean: float, k: int) -> DataFrame:
    """The k best rows of each query by the postings (term, id, tf, dl) of its terms: query_id, id, bm25, rank.

    The terms of a query are taken from the rarest on. What those give already sets a bound for the k-th
    score; terms whose greatest scores together stay below it can't bring in a row of their own, so their
    postings are looked up for the rows the others found only. The bounds are exact, so the result is.
    Where all postings together are few (PAIRS), they are all scored. Where the queries' terms are few (ASKED),
    postings move by row instead, once, and no score of a row and a query leaves its task but the best.
    """
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(mean))
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    few = wanted.count() <= ASKED
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"), *([] if few else [F.max(share).alias("most")]))
    weight = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = wanted.join(df, "term").select("query_id", "term", "df", (F.col("times") * F.when(weight > 0, weight).otherwise(LEAST_IDF)).alias("w"), *([] if few else ["most"]))
    if few:
        return ranked_many(best_by_row(held, weighed, mean, k), k)
    part = (F.col("w") * share).alias("part")
    scores = lambda own: held.join(own.select("query_id", "term", "w"), "term").select("query_id", "id", part).groupBy("query_id", "id").agg(F.sum("part").alias("part"))
    weighed = checkpointed(weighed)
    if (weighed.agg(F.sum("df").alias("n")).first()["n"] or 0) <= PAIRS:
        return ranked_many(scores(weighed), k)
    # the rarest terms, by their sum of rows, set the bound
    by_rarity = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    weighed = weighed.withColumn("first", F.coalesce(F.sum("df").over(by_rarity), F.lit(0)) < 4 * k)
    order = Window.partitionBy("query_id").orderBy(F.desc("part"), "id")

    def looked_up(pairs: DataFrame, own: DataFrame) -> DataFrame:
        """Parts of some (query_id, id): by row first, then the queries' terms, so that never all rows of a common term meet every query."""
        some = held.join(own.select("term").distinct(), "term", "left_semi").join(pairs.select("id").distinct(), "id", "left_semi")
        return pairs.join(some, "id").join(own.select("query_id", "term", "w"), ["query_id", "term"]).select("query_id", "id", part)

    low = checkpointed(scores(weighed.where("first")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("query_id", "id"))
    # the whole scores of k rows at most per query: the k-th best of all is no less than the least of them
    low = looked_up(low, weighed).groupBy("query_id", "id").agg(F.sum("part").alias("part"))
    low = low.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("part")).otherwise(0.0).alias("bound"))
    # from the least term up, as long as all so far together stay below the bound by more than rounding
    small = Window.partitionBy("query_id").orderBy(F.col("w") * F.col("most"), "term")
    split = weighed.join(low, "query_id", "left").withColumn("rest", F.sum(F.col("w") * F.col("most")).over(small))
    bound = F.coalesce("bound", F.lit(0.0))
    split = checkpointed(split.select("query_id", "term", "w", "most", bound.alias("bound"), (F.col("rest") + ROUNDING >= bound).alias("main")))
    slack = split.groupBy("query_id").agg(F.sum(F.when(F.col("main"), 0.0).otherwise(F.col("w") * F.col("most"))).alias("slack"), F.max("bound").alias("bound"))
    found = checkpointed(scores(split.where("main")).join(slack, "query_id").where(F.col("part") + F.col("slack") + ROUNDING >= F.col("bound")).select("query_id", "id", "part"))
    more = looked_up(found.select("query_id", "id"), split.where("NOT main"))
    return ranked_many(found.union(more).groupBy("query_id", "id").agg(F.sum("part").alias("part")), k)


def best_by_row(held: DataFrame, weighed: DataFrame, mean: float, k: int) -> DataFrame:
    """(query_id, id, part): of each partition of ids, the rows that can be among a query's k best. Collects the queries' terms."""
    asked = weighed.select("query_id", "term", "w").toArrow()
    terms = asked.column("term").combine_chunks().dictionary_encode()
    queries = asked.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
    term, query = terms.indices.to_numpy(), queries.indices.to_numpy()
    order = np.argsort(term, kind="stable")
    first = np.searchsorted(term[order], np.arange(len(terms.dictionary) + 1))
    best = Best(first, query[order].astype(np.int64), asked.column("w").to_numpy()[order], queries.dictionary, mean, k)
    numbers = held.sparkSession.createDataFrame(list(enumerate(terms.dictionary.to_pylist())), "t int, term string")
    rows = held.join(F.broadcast(numbers), "term").select("id", "t", "tf", "dl").repartition("id").sortWithinPartitions("id", "t")
    return rows.mapInArrow(best.run, f"query_id {weighed.schema['query_id'].dataType.simpleString()}, id {held.schema['id'].dataType.simpleString()}, part double")


class Best:
    """Scores rows (id, t, tf, dl), sorted by id, for all queries; ``first`` says where the queries of a term begin in ``query`` and ``weight``."""

    def __init__(self, first: np.ndarray, query: np.ndarray, weight: np.ndarray, names: pa.Array, mean: float, k: int):
        self.first, self.query, self.weight, self.names, self.mean, self.k = first, query, weight, names, mean, k

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(self.names)
        least = np.full(n, -np.inf)  # the k-th best score so far
        ids, held, at, limit = None, (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)), 0, 4 * n * self.k
        for row, doc_ids in _whole_rows(batches):
            for scores, start in self.scored(row):
                d, q = np.nonzero((scores > 0) & (scores >= least - ROUNDING))
                new = doc_ids.take(pa.array(d + start))
                ids = new if ids is None else pa.concat_arrays([ids, new])
                held = tuple(np.concatenate(x) for x in zip(held, (q, scores[d, q], d + (start + at))))
                if len(ids) > limit:
                    ids, held = self.kept(ids, held, least)
                    limit = max(4 * n * self.k, 2 * len(ids))
            at += len(doc_ids)
        if ids is not None and len(ids):
            ids, held = self.kept(ids, held, least)
            yield pa.RecordBatch.from_arrays([self.names.take(pa.array(held[0])), ids, pa.array(held[1])], ["query_id", "id", "part"])

    def scored(self, row: dict) -> Iterator[tuple[np.ndarray, int]]:
        """Of some rows at a time, each one's score for each query, and which row is the first."""
        t, n = row["t"], len(self.names)
        share = row["tf"] * (K1 + 1) / (row["tf"] + K1 * ((1 - B) + B * row["dl"] / self.mean))
        size = self.first[t + 1] - self.first[t]
        begins = np.flatnonzero(np.diff(row["doc"], prepend=-1))
        ends, parts = np.append(begins[1:], len(t)), np.cumsum(size)
        i = 0
        while i < len(begins):
            s, done = int(begins[i]), int(parts[begins[i] - 1]) if begins[i] else 0
            j = min(i + max(1, CELLS // n), max(i + 1, int(np.searchsorted(parts[ends - 1], done + PARTS, "right"))))
            e, own = int(ends[j - 1]), size[s : int(ends[j - 1])]
            of = np.arange(own.sum()) + np.repeat(self.first[t[s:e]] - np.cumsum(own) + own, own)
            cell = np.repeat((row["doc"][s:e] - i) * n, own) + self.query[of]
            yield np.bincount(cell, self.weight[of] * np.repeat(share[s:e], own), (j - i) * n).reshape(-1, n), i
            i = j

    def kept(self, ids: pa.Array, held: tuple, least: np.ndarray) -> tuple[pa.Array, tuple]:
        """What can be among the k best after rounding; of one score, k rows at most, as the id decides among them. Raises ``least``."""
        q, score, at = held
        order = np.lexsort((at, -score, q))
        q, score, at = q[order], score[order], at[order]
        i = np.arange(len(q))
        rank = i - np.searchsorted(q, q)
        new = np.concatenate(([True], (q[1:] != q[:-1]) | (score[1:] != score[:-1])))
        full = rank == self.k - 1
        least[q[full]] = score[full]
        keep = (rank < self.k) | ((score >= least[q] - ROUNDING) & (i - np.maximum.accumulate(np.where(new, i, 0)) < self.k))
        return ids.take(pa.array(order[keep])), (q[keep], score[keep], at[keep])


def _whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.Array]]:
    """Postings sorted by id, in pieces that hold all of a row's: columns with the row's number (doc), and the rows' ids."""
    held: list[pa.RecordBatch] = []

    def whole(table: pa.Table) -> tuple[dict, pa.Array]:
        ids = table.column("id").combine_chunks()
        new = np.concatenate(([True], pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)))
        row = {c: table.column(c).to_numpy() for c in ("t", "tf", "dl")} | {"doc": np.cumsum(new) - 1}
        return row, ids.take(pa.array(np.flatnonzero(new)))

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        last = batch.column("id")[batch.num_rows - 1]
        if sum(b.num_rows for b in held) >= PARTS // 8 and held[0].column("id")[0] != last:
            table = pa.Table.from_batches(held)
            ids = table.column("id")
            cut = table.num_rows - 1
            while ids[cut - 1] == last:
                cut -= 1
            yield whole(table.slice(0, cut))
            held = table.slice(cut).to_batches()
    if held:
        yield whole(pa.Table.from_batches(held))


def ranked_many(scores: DataFrame, k: int) -> DataFrame:
    whole = scores.withColumnRenamed("part", "bm25")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("bm25", 6).desc(), "id"))
    return whole.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
