"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a weighted lexicon, how near its hits are
to second-person words, and rates of capitals, punctuation and obfuscation. The
lexicon is a fixed list of common insults, and words and word beginnings that
mark toxic rows among the labelled ones (log-odds with a likelihood-ratio test).

Labels are only read from the training rows (crc32 of the id, modulo 4, not 2).
The fit uses a bounded sample of them: about ``MAX_LABELLED`` ids by a hash of
the id, one row each; it is the only bound. Every key of the sampled rows is counted
and tested, so the lexicon and the driver's share are bounded by the sample as well.
The documents are read twice: for the sample, and for the scores. A lexicon learned from a row would flatter that row, so training features
are made with the lexicon of the other half, and the calibration is fitted on
predictions of trees that didn't see the row. Scoring reads every row once and
moves nothing.

Defined cases: null and empty texts get the score of a text without words; rows
without a label train nothing; repeated labels of an id count once, as toxic if
one says so; of several texts of a labelled id, the one with the least hash trains;
a very long text is one row of a batch, and its features are arrays of its words;
without labels of both kinds all scores are the share of toxic
labels (0 without any); repeated rows are scored each; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import crc_mod, dropped, map_arrow, stored, table

MAX_LABELLED = 100_000
MIN_SUPPORT, MIN_G, MIN_LOG_ODDS = 3, 15.0, 2.0
THRESHOLD = 0.3

# Common insults and second-person words of the four languages.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown dumb dumbass imbecile bastard bitch asshole fuck fucking shit faggot retard whore slut idiota estúpido estúpida imbécil basura puta pendejo cabrón mierda tonto idiote stupide connard salope merde crétin abruti ordure dummkopf arschloch scheiße schlampe trottel abschaum wichser".split()
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os vuestro".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": None, ".": None, "-": None, "_": None, "+": "t"})
EDGES = " \t\r\n.,;:!?\"'()[]{}<>#%&*$|/\\-_…«»„“”‘’"
_LETTERS = re.compile(r"[^\W\d_]+\Z")

FEATURES = ("log_words", "hit_rate", "weight_rate", "max_weight", "log_hits", "hit_mean", "weak_rate", "you_rate", "proximity", "near_share", "caps_rate", "exclaim_rate", "question_rate", "punct_rate", "obfuscation_rate", "obfuscated_hits")
#: How a token is coded: flags, then its lexicon weight in steps of 1/16.
UPPER, YOU, ODD, SHIFT, STEP = 1, 2, 4, 3, 16
STRONG = 3 * STEP
NEAR = 5


def forms(token: str) -> tuple[str, str | None]:
    """The lower-case word of a token, and what it reads as if it is obfuscated."""
    word = token.strip(EDGES).lower()
    if not word or _LETTERS.match(word):
        return word, None
    plain = word.translate(LEET)
    return word, plain if plain != word and _LETTERS.match(plain) and any(c.isalpha() for c in word) else None


def keys(word: str) -> list[str]:
    """Lexicon keys of a word: itself and its beginnings of four to six letters."""
    return ["=" + word, *("^" + word[:n] for n in (4, 5, 6) if len(word) >= n)]


class Codes(dict):
    """Token -> code, computed at first sight; starts anew when large."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def weight(self, word: str) -> int:
        return int(STEP * max((self.lexicon.get(k, 0.0) for k in keys(word)), default=0.0))

    def __missing__(self, token: str) -> int:
        word, plain = forms(token)
        weight = self.weight(word) if word else 0
        code = 0
        if plain:
            hidden = self.weight(plain)
            if hidden >= STRONG or hidden > weight:
                code |= ODD
            weight = max(weight, hidden)
        if word in SECOND_PERSON:
            code |= YOU
        if len(word) > 1 and token.isupper():
            code |= UPPER
        code |= weight << SHIFT
        if len(self) > 400_000:
            self.clear()
        self[token] = code
        return code


def features(text: str | None, codes: Codes) -> np.ndarray:
    text = text or ""
    tokens = text.split()
    n = len(tokens)
    if n == 0:
        return np.zeros(len(FEATURES))
    code = np.fromiter(map(codes.__getitem__, tokens), np.int64, n)
    weight = code >> SHIFT
    strong = np.flatnonzero(weight >= STRONG)
    weak = np.count_nonzero(weight) - len(strong)
    you = np.flatnonzero(code & YOU)
    k, chars = len(strong), max(len(text), 1)
    proximity = near = 0.0
    if k and len(you):
        at = np.searchsorted(you, strong)
        gap = np.minimum(np.abs(strong - you[np.minimum(at, len(you) - 1)]), np.abs(strong - you[np.maximum(at - 1, 0)]))
        proximity, near = 1 / (1 + gap.min()), np.count_nonzero(gap <= NEAR) / k
    total = weight[strong].sum() / STEP
    return np.array([
        math.log1p(n), 100 * k / n, 100 * total / n, weight.max() / STEP, math.log1p(k), total / k if k else 0.0, 100 * weak / n, 100 * len(you) / n, proximity, near,
        np.count_nonzero(code & UPPER) / n, 100 * text.count("!") / chars, 100 * text.count("?") / chars, 100 * sum(map(text.count, ".,;:")) / chars,
        100 * np.count_nonzero(code & ODD) / n, np.count_nonzero(weight[(code & ODD) > 0] >= STRONG),
    ])


# ---- the lexicon ----


def seeds() -> dict[str, float]:
    return {"=" + w: 6.0 for w in INSULTS}


def _mark(a: Column, b: Column, n_toxic: int, n_clean: int) -> Column:
    """The log-odds of a key that a toxic and b clean rows hold, where it marks toxic rows by support and likelihood ratio; else null."""
    if not n_toxic or not n_clean:
        return F.lit(None).cast("double")
    share = n_toxic / (n_toxic + n_clean)
    odds = F.log((a + 0.5) / (n_toxic + 1)) - F.log((b + 0.5) / (n_clean + 1))
    g = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    return F.when((a >= MIN_SUPPORT) & (odds >= MIN_LOG_ODDS) & (g >= MIN_G), odds)


#: Key counts that a task holds before it hands them on.
HELD_KEYS = 500_000


def _counts(rows: DataFrame) -> DataFrame:
    """key, toxic, fold, n: the rows of each kind that hold the key, summed within a task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[int, int], Counter] = {(t, f): Counter() for t in (0, 1) for f in (0, 1)}

        def out():
            for (toxic, fold), c in count.items():
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array([toxic] * len(c), pa.int32()), pa.array([fold] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["key", "toxic", "fold", "n"])
                    c.clear()

        for batch in batches:
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
                count[toxic, fold].update({k for t in set((text or "").split()) for w in forms(t) if w for k in keys(w)})
                if sum(map(len, count.values())) > HELD_KEYS:
                    yield from out()
        yield from out()

    return map_arrow(rows.select("text", "toxic", "fold"), run, "key string, toxic int, fold int, n long")


def learn_lexicons(rows: DataFrame, size: dict[tuple[int, int], int]) -> list[dict[str, float]]:
    """The lexicon of all sampled rows, and those of fold 0 and of fold 1 alone.

    Every key of every sampled row is counted and tested where the counts are; the driver gets the keys that passed.
    """
    each = [F.sum(F.when((F.col("toxic") == t) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"n{t}{f}") for t in (0, 1) for f in (0, 1)]
    counts = _counts(rows).groupBy("key").agg(*each).where(F.col("n10") + F.col("n11") >= MIN_SUPPORT)
    marks = []
    for folds in ((0, 1), (0,), (1,)):
        n = [sum((F.col(f"n{t}{f}") for f in folds), F.lit(0)) for t in (0, 1)]
        marks.append(_mark(n[1], n[0], *(sum(size.get((t, f), 0) for f in folds) for t in (1, 0))))
    found = counts.select("key", *[m.alias(f"w{i}") for i, m in enumerate(marks)]).where("w0 IS NOT NULL OR w1 IS NOT NULL OR w2 IS NOT NULL").collect()
    return [seeds() | {r["key"]: r[f"w{i}"] for r in found if r[f"w{i}"] is not None} for i in range(3)]


# ---- the trees ----


class Trees:
    """Boosted regression trees on binned features, logistic loss, Newton leaves."""

    def __init__(self, n_trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 2.0, penalty: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least, self.penalty = n_trees, depth, rate, bins, least, penalty
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        n, m = x.shape
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(p / (1 - p))
        edges = [np.unique(np.concatenate((np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1]), np.quantile(v, np.linspace(0, 1, 12)) if len(v := x[x[:, j] > 0, j]) else []))) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        width = max(map(len, edges)) + 1
        raw = np.full(n, self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            splits = np.zeros((2**self.depth - 1, 2))
            splits[:, 0] = -1
            for level in range(self.depth):
                first, width_l = 2**level - 1, 2**level
                best = np.zeros(width_l)
                choice: list[tuple[int, int] | None] = [None] * width_l
                at = node - first
                for j in range(m):
                    slot = at * width + binned[:, j]
                    gs = np.bincount(slot, g, width_l * width).reshape(width_l, width).cumsum(1)
                    hs = np.bincount(slot, h, width_l * width).reshape(width_l, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.penalty) + (gt - gs) ** 2 / (ht - hs + self.penalty) - gt**2 / (ht + self.penalty)
                    gain[(hs < self.least * 0.1) | (ht - hs < self.least * 0.1)] = 0
                    b = gain.argmax(1)
                    for k in range(width_l):
                        if gain[k, b[k]] > best[k] + 1e-9 and b[k] < len(edges[j]):
                            best[k], choice[k] = gain[k, b[k]], (j, int(b[k]))
                right = np.zeros(n, bool)
                for k, c in enumerate(choice):
                    if c:
                        splits[first + k] = c[0], edges[c[0]][c[1]]
                        here = at == k
                        right[here] = binned[here, c[0]] > c[1]
                node = 2 * node + 1 + right
            leaf = node - (2**self.depth - 1)
            values = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.penalty)
            self.trees.append((splits, values))
            raw += values[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for splits, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                feature = splits[node, 0].astype(np.int64)
                node = 2 * node + 1 + ((feature >= 0) & (x[rows, feature] > splits[node, 1]))
            out += values[node - (2**self.depth - 1)]
        return out


class Isotonic:
    """Pool-adjacent-violators; between the blocks' means the line is straight."""

    def fit(self, raw: np.ndarray, y: np.ndarray) -> "Isotonic":
        values, at = np.unique(raw, return_inverse=True)
        blocks: list[list[float]] = []
        for v, s, n in zip(values, np.bincount(at, y), np.bincount(at)):
            blocks.append([v * n, s, n])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        self.x = np.array([b[0] / b[2] for b in blocks])
        self.y = np.array([b[1] / b[2] for b in blocks])
        return self

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y)


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Trees | None, calibration: Isotonic | None, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share) if self.trees is None else np.clip(self.calibration(self.trees.raw(x)), 0.0, 1.0)


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic (0 or 1) and fold of about MAX_LABELLED training rows, one per labelled id (of several texts that with the least hash)."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(crc_mod("doc_id", 4) != 2).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = known.count()
    steps = 1 << 20
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < math.ceil(steps * min(1.0, MAX_LABELLED / max(n, 1))))
    fold = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 4) % 2
    sample = sample.select(F.col("doc_id").alias("_id"), "toxic", fold.cast("int").alias("fold"))
    # the broadcast has a proven bound: about MAX_LABELLED rows of three numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    return rows.groupBy("_id", "toxic", "fold").agg(F.min_by("text", F.xxhash64(F.coalesce("text", F.lit("")))).alias("text")).select("text", "toxic", "fold")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from a bounded sample of the labelled training rows, which is written once and read from there."""
    rows, path = stored(sampled(docs, labels))
    size = {(r["toxic"], r["fold"]): r["count"] for r in rows.groupBy("toxic", "fold").count().collect()}
    whole, *by_fold = learn_lexicons(rows, size)
    other = {0: by_fold[1], 1: by_fold[0]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = {f: Codes(x) for f, x in other.items()}
        for batch in batches:
            folds = batch.column("fold").to_pylist()
            x = [features(t, codes[f]) for t, f in zip(batch.column("text").to_pylist(), folds)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("fold"), pa.array([v.tolist() for v in x], pa.list_(pa.float64()))], ["toxic", "fold", "x"])

    got = map_arrow(rows, run, "toxic int, fold int, x array<double>").toArrow()
    dropped(docs.sparkSession, path)
    y = got.column("toxic").to_numpy().astype(float)
    folds = got.column("fold").to_numpy()
    if len(y) == 0 or y.min() == y.max():
        return Model(whole, None, None, float(y.mean()) if len(y) else 0.0)
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y, folds))  # the same rows in whatever order give the same trees
    x, y, folds = x[order], y[order], folds[order]
    raw = np.zeros(len(y))
    for f in (0, 1):
        here, there = folds == f, folds != f
        if here.any():
            seen = there if there.any() and y[there].min() < y[there].max() else np.ones(len(y), bool)
            raw[here] = Trees().fit(x[seen], y[seen]).raw(x[here])
    return Model(whole, Trees().fit(x, y), Isotonic().fit(raw, y), float(y.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(model.lexicon)
        for batch in batches:
            x = [features(t, codes) for t in batch.column("text").to_pylist()]
            s = model.score(np.array(x).reshape(len(x), len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(s)], ["doc_id", "score"])

    scored = map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


ORACLE_SQL = None
