"""Toxicity, quality rules, mixing, language-model scores."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from fathom.llm import op1_toxicity, op7_mixing, op8_rules, op10_ppm

SF = "/root/testdata/sf0.01"


def same(df, sql):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    a, b = df.toPandas(), con.execute(sql).fetchdf()
    columns = sorted(a.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (a, b))
    return a.equals(b)


def test_rules_sql(spark):
    assert same(op8_rules.op8_rules(spark, SF), op8_rules.ORACLE_SQL)


def brute_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_rules_odd(spark, odd, empty, given):
    given(op8_rules, documents=odd)
    got = op8_rules.op8_rules(spark, "").collect()
    texts = collections.Counter(brute_rules(r.text) for r in odd.select("text").collect())
    assert collections.Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == texts
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (not r.base_failed or not r.kept) for r in got)
    kept = op8_rules.stage(spark, odd, "")
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    assert op8_rules.stage(spark, empty, "").count() == 0 and op8_rules.ledger(empty).count() == 0
    assert op8_rules.measure("a b c a b c a b")[4] == 8 and op8_rules.measure("a b c")[0] == 2


def test_policies_and_ablations(spark):
    entries = op8_rules.ledger(op8_rules.table(spark, SF, "documents"))
    counts = {r.rule: (r.n_failed, r.n_only) for r in op8_rules.ablations(entries).collect()}
    rows = entries.select("failures").collect()
    full = op8_rules.mask(op8_rules.CURRENT)
    for rule, (failed, only) in counts.items():
        bit = 1 << op8_rules.RULES.index(rule)
        assert failed == sum(bool(r.failures & bit) for r in rows) and only == sum(r.failures & full == bit for r in rows)
    assert op8_rules.apply_policy(entries, "base").where("kept").count() > op8_rules.apply_policy(entries, "v2").where("kept").count()


def test_mixing_sql(spark):
    assert same(op7_mixing.op7_mixing(spark, SF), op7_mixing.ORACLE_SQL)


def test_ablations_sql(spark):
    assert same(op8_rules.rule_ablations(spark, SF), op8_rules.ABLATIONS_SQL)


def test_mixing_slots(spark, monkeypatch):
    """Rows of one size, and rows without an id, are spread; the draws don't depend on the slots."""
    df = spark.range(3000).selectExpr("if(id % 3 = 0, null, id) AS doc_id", "concat('a b c', id) AS text", "'s' AS source").union(spark.range(500).selectExpr("id", "'a b c d e f'", "'t'"))
    want = sorted(map(str, op7_mixing.copies(op7_mixing.sized(df)).select("text", "_mix_copies").collect()))
    monkeypatch.setattr(op7_mixing, "SLOT_ROWS", 2)
    got = op7_mixing.copies(op7_mixing.sized(df))
    assert sorted(map(str, got.select("text", "_mix_copies").collect())) == want
    assert got.groupBy("_mix_key", "_mix_step", "_mix_slot").count().agg({"count": "max"}).first()[0] < 12
    assert op7_mixing.digits(0) == 1 and op7_mixing.digits(10**7) == 6


def test_mixing_odd(spark, odd, empty, given):
    given(op7_mixing, documents=odd)
    got = op7_mixing.op7_mixing(spark, "").collect()
    assert len(got) == odd.count() and all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in got)
    total = sum({(r.source_size, r.target) for r in got} and [r.size for r in got])
    assert sum(t for _, t in {(r.source_size, r.target) for r in got}) <= total + 1e-6
    given(op7_mixing, documents=empty)
    assert op7_mixing.op7_mixing(spark, "").count() == 0
    out = op7_mixing.stage(spark, odd, "")
    assert out.columns == odd.columns
    assert op7_mixing.stage(spark, empty, "").count() == 0


def test_mixing_targets(spark):
    rows = [(i, "w " * random.Random(i).randint(1, 60), "abcd"[i % 10 // 3]) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = op7_mixing.copies(op7_mixing.sized(df)).toPandas()
    by = got.assign(t=got._mix_copies * got._mix_size).groupby("_mix_key").agg(t=("t", "sum"), target=("_mix_target", "first"), size=("_mix_source_size", "first"))
    assert (abs(by.t / by.target - 1) < 0.02).all() and (by.target <= 3 * by["size"]).all() and abs(by.target.sum() - by["size"].sum()) < 1


def test_toxicity_learns(spark):
    got = op1_toxicity.op1_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = op1_toxicity.table(spark, "/root/testdata/sf0.1", "labels").toPandas()
    m = got.merge(labels, on="doc_id")
    m = m[m.held_out]
    hit, wrong = ((m.predicted == 1) & (m.toxic == 1)).sum(), ((m.predicted == 1) & (m.toxic == 0)).sum()
    assert hit / m.toxic.sum() > 0.85 and wrong / (m.toxic == 0).sum() < 0.03
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_toxicity_odd(spark, odd, empty, given):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (4, 0, 0), (5, 1, 0), (None, 1, 1), (6, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        given(op1_toxicity, documents=odd, labels=labels)
        got = op1_toxicity.op1_toxicity(spark, "").collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    given(op1_toxicity, documents=empty, labels=some)
    assert op1_toxicity.op1_toxicity(spark, "").count() == 0


def plain_features(text, lexicon):
    """The features of a text once more, token by token."""
    tokens = text.split()
    n = len(tokens)

    def weigh(word):
        return int(16 * max([lexicon.get("=" + word, 0.0)] + [lexicon.get("^" + word[:k], 0.0) for k in (4, 5, 6) if len(word) >= k]))

    hits, yous, caps, odd, odd_hits, weak, all_weights = {}, [], 0, 0, 0, 0, [0]
    for i, t in enumerate(tokens):
        word = t.strip(op1_toxicity.EDGES).lower()
        w = weigh(word) if word else 0
        hidden = 0
        if word and not re.fullmatch(r"[^\W\d_]+", word):
            plain = word.translate(op1_toxicity.LEET)
            if plain != word and re.fullmatch(r"[^\W\d_]+", plain) and any(c.isalpha() for c in word):
                hidden = weigh(plain)
                strange = hidden >= 48 or hidden > w
                w = max(w, hidden)
                odd += strange
                odd_hits += strange and w >= 48
        caps += len(word) > 1 and t.isupper()
        if word in op1_toxicity.SECOND_PERSON:
            yous.append(i)
        if w >= 48:
            hits[i] = w
        elif w:
            weak += 1
        all_weights.append(w)
    k, total = len(hits), sum(hits.values()) / 16
    gaps = [min(abs(i - j) for j in yous) for i in hits] if yous else []
    rate = lambda marks: 100 * sum(text.count(c) for c in marks) / max(len(text), 1)
    return [
        math.log1p(n), 100 * k / n, 100 * total / n, max(all_weights) / 16, math.log1p(k), total / k if k else 0, 100 * weak / n, 100 * len(yous) / n, 1 / (1 + min(gaps)) if gaps else 0,
        sum(g <= 5 for g in gaps) / k if gaps else 0, caps / n, rate("!"), rate("?"), rate(".,;:"), 100 * odd / n, odd_hits,
    ]


def test_toxicity_features_are_those_of_a_plain_reading():
    lexicon = op1_toxicity.seeds() | {"^blah": 2.5, "=grumpf": 4.0}
    rng = random.Random(3)
    words = "you You YOUR idiot 1d1ot! m0ron, blahhh grumpf GRUMPF fine a.b 5cum house, word! ? (tu) x2 ... stupid. $hit it's".split()
    codes = op1_toxicity.Codes(lexicon)
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))
        assert np.allclose(op1_toxicity.features(text, codes), plain_features(text, lexicon)), text


def test_toxicity_first_split_is_the_best_of_all():
    rng = np.random.RandomState(1)
    x = rng.randint(0, 12, (300, 3)).astype(float)
    y = (x[:, 2] + rng.normal(0, 2, 300) > 7).astype(float)
    model = op1_toxicity.Trees(n_trees=1, depth=1, bins=200).fit(x, y)
    p = y.mean()
    g, h = y - p, np.full(300, p * (1 - p))

    def gain(mask):
        return sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (mask, ~mask))

    best = max(((gain(x[:, j] > v), j, v) for j in range(3) for v in np.unique(x[:, j])[:-1]), key=lambda t: t[0])
    (j, v), values = model.trees[0][0][0], model.trees[0][1]
    right = x[:, int(j)] > v
    assert abs(gain(right) - best[0]) < 1e-9
    assert np.allclose(values, [0.15 * g[m].sum() / (h[m].sum() + 1) for m in (~right, right)])


def test_toxicity_isotonic_is_the_least_squares_fit():
    rng = np.random.RandomState(2)
    for n in (1, 2, 7, 40):
        raw, y = np.sort(rng.normal(size=n)), (rng.rand(n) < 0.5).astype(float)
        # min-max formula of the isotonic regression
        brute = [max(min(y[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        iso = op1_toxicity.Isotonic().fit(raw, y)
        steps = np.array(sorted(set(np.round(brute, 12))))
        assert np.allclose(iso.y, steps)


def test_toxicity_counts_every_key(spark):
    """All keys are counted and tested, however many; the lexicon is that of a plain count."""
    rng = random.Random(5)
    vocabulary = [f"w{''.join(rng.choice('abcdefgh') for _ in range(7))}" for _ in range(300)]
    rows = []
    for i in range(400):
        toxic = int(i % 3 == 0)
        words = rng.sample(vocabulary[:60] if toxic else vocabulary[40:], 20)
        rows.append((" ".join(words), toxic, i % 2))
    size = collections.Counter((t, f) for _, t, f in rows)
    got = op1_toxicity.learn_lexicons(spark.createDataFrame(rows, "text string, toxic int, fold int"), size)
    for lexicon, folds in zip(got, ((0, 1), (0,), (1,))):
        n = {t: sum(size[t, f] for f in folds) for t in (0, 1)}
        share, want = n[1] / (n[0] + n[1]), op1_toxicity.seeds()
        held = {t: collections.Counter(k for text, u, f in rows if u == t and f in folds for k in {k for w in text.split() for k in op1_toxicity.keys(w)}) for t in (0, 1)}
        total = collections.Counter(k for text, u, f in rows if u for k in {k for w in text.split() for k in op1_toxicity.keys(w)})
        for k, a in held[1].items():
            b = held[0][k]
            odds = math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1))
            g = 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0))
            if total[k] >= op1_toxicity.MIN_SUPPORT and a >= op1_toxicity.MIN_SUPPORT and odds >= op1_toxicity.MIN_LOG_ODDS and g >= op1_toxicity.MIN_G:
                want[k] = odds
        assert lexicon.keys() == want.keys() and all(abs(lexicon[k] - want[k]) < 1e-9 for k in want)


def test_toxicity_parts():
    codes = op1_toxicity.Codes(op1_toxicity.seeds())
    x = dict(zip(op1_toxicity.FEATURES, op1_toxicity.features("You are an 1d1ot, IDIOT!", codes)))
    assert x["obfuscated_hits"] == 1 and x["hit_rate"] == 40 and x["proximity"] > 0 and x["caps_rate"] > 0
    iso = op1_toxicity.Isotonic().fit(np.array([0.0, 1.0, 2.0, 3.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(iso(np.linspace(-1, 4, 20))) >= 0).all()
    rng = np.random.RandomState(0)
    a = rng.normal(size=(400, 3))
    y = (a[:, 1] > 0.3).astype(float)
    assert ((op1_toxicity.Trees(n_trees=20).fit(a, y).raw(a) > 0) == (y > 0)).mean() > 0.97


def ppm(train, texts, order):
    """Method C with exclusion, by dictionaries."""
    seen = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    symbols = lambda t: [254] * order + list(t) + [255]
    for t in train:
        s = symbols(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen[k][tuple(s[i - k : i])][s[i]] += 1
    for t in texts:
        s, total = symbols(t), 0.0
        for i in range(order, len(s)):
            out, done = set(), False
            for k in range(order, -1, -1):
                c = seen[k].get(tuple(s[i - k : i]))
                if not c:
                    continue
                rest = {a: n for a, n in c.items() if a not in out}
                if rest:
                    n, q = sum(rest.values()), len(rest)
                    if s[i] in rest:
                        total += math.log10(rest[s[i]] / (n + q))
                        done = True
                        break
                    total += math.log10(q / (n + q))
                out |= set(c)
            if not done:
                total += math.log10(1 / max(256 - len(out), 1))
        yield total


def test_ppm_brute(spark, odd):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("abAB cé") for _ in range(r.choice([0, 1, 5, 60, 200])))) for i in range(50)] + [(None, None), (5, "zz top"), (61, "Qqq")]
    got = op10_ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    low = lambda t: (t or "").encode().lower()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [low(t) for i, t in rows if not held(i)]
    c = collections.Counter(w for t in train for w in t.split())
    c["</s>"] = len(train)
    n, v = sum(c.values()), len(c)
    want = []
    for (i, t), s in zip(rows, ppm(train, [low(t) for _, t in rows], op10_ppm.ORDER)):
        w = [*low(t).split(), "</s>"]
        want.append((str(i), held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6), round(s, 6)))
    assert sorted(want) == sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6), round(x.score, 6)) for x in got)


def test_ppm_owners_share_contexts(spark, monkeypatch):
    """Splitters in the midst of contexts change nothing: what straddles them is summed over all owners."""
    from pyspark import cloudpickle

    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["the", "then", "these", "a", "an", "and", "é", "thé"]) for _ in range(r.randint(0, 60)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {x.doc_id: x.score for x in op10_ppm.score(df).collect()}
    cloudpickle.register_pickle_by_value(op10_ppm)
    monkeypatch.setattr(op10_ppm, "STEP", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        split = op10_ppm.splitters(df, 40, 10_000)
        assert len(split) > 20 and all(len(op10_ppm.straddling(split, o)) > 5 for o in (3, 4, 5))
        got = {x.doc_id: x.score for x in op10_ppm.score(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        cloudpickle.unregister_pickle_by_value(op10_ppm)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_ppm_keeps_rare_contexts(spark):
    rare = "".join(map(chr, range(48, 58))) + "".join(map(chr, range(97, 123)))
    known = next(i for i in range(100) if not op10_ppm.held_out(i))
    asked = next(i for i in range(100) if op10_ppm.held_out(i))
    many = spark.range(1000, 4000).selectExpr("id AS doc_id", "repeat('. ', 1000) AS text")
    docs = many.union(spark.createDataFrame([(known, rare), (asked, rare)], "doc_id long, text string"))
    got = {r.doc_id: r.score for r in op10_ppm.score(docs).where("doc_id < 1000").collect()}
    # in over five million symbols each context of the rare text but the start was seen once: one half for each symbol
    assert got[known] == got[asked] and abs(got[asked] + len(rare) * math.log10(2)) < 5


def test_ppm_odd(spark, odd, empty):
    assert op10_ppm.score(odd).count() == odd.count() and op10_ppm.score(empty).count() == 0
    held_only = spark.createDataFrame([(i, "abc") for i in range(60) if op10_ppm.held_out(i)], "doc_id long, text string")
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in op10_ppm.score(held_only).collect())
    a = np.array([3, 9, 2**63, 2**64 - 1], np.uint64)
    assert (op10_ppm.unsqueeze_sorted(op10_ppm.squeeze_sorted(a)) == a).all()


def test_policies_read_the_stored_ledger(spark):
    """A second policy and the ablations scan the ledger's table, and no documents."""
    entries = op8_rules.kept_ledger(op8_rules.table(spark, SF, "documents"))
    for df in (op8_rules.apply_policy(entries, "base"), op8_rules.ablations(entries)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "documents" not in plan and "text" not in plan and all("documents" not in f for f in df.inputFiles())
    direct = {r.doc_id: r.failures for r in op8_rules.ledger(op8_rules.table(spark, SF, "documents")).collect()}
    assert {r.doc_id: r.failures for r in entries.collect()} == direct and entries.first().rule_version == op8_rules.RULE_VERSION
