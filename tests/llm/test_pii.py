"""Personal data: base forms, the rounds and the spans against plain versions; unseen identifiers in hand-made texts."""

import collections
import hashlib
import math
import random
import re


from fathom.llm import op12_pii as op

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute_base(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found)


def text_of(spans):
    return ",".join(f"{op.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def brute_rounds(texts):
    """The same learning over dictionaries, keyed by pattern and value as they are."""
    edges = collections.defaultdict(lambda: [0, 0])
    for t in texts:
        for s in op.spans_of(t)[1]:
            for p in [("shape", s["shape"]), *(("context", c) for c in s["contexts"])]:
                e = edges[p, s["value"]]
                e[0] |= s["known"]
                e[1] |= s["valid"] if p[0] == "shape" else s["loose"]
    n, k = collections.Counter(), collections.Counter()
    for (p, _), (known, _) in edges.items():
        n[p] += 1
        for i in range(4):
            k[p, i] += known >> i & 1
    values = {}
    for _ in range(op.ROUNDS):
        gain = collections.Counter()
        for (p, v), (known, _) in edges.items():
            if not known and v in values:
                gain[p, values[v][0]] += values[v][1]
        good = {}
        for p in n:
            for i in range(4):
                share, z2 = min(1.0, (k[p, i] + gain[p, i]) / n[p]), op.Z**2
                c = (share + z2 / (2 * n[p]) - op.Z * math.sqrt((share * (1 - share) + z2 / (4 * n[p])) / n[p])) / (1 + z2 / n[p])
                if share > 0 and c >= op.MIN_CONFIDENCE:
                    good[p, i] = c
        miss = collections.Counter()
        for (p, v), (known, may) in edges.items():
            for i in range(4):
                if not known and may >> i & 1 and (p, i) in good:
                    miss[v, i] += math.log1p(-good[p, i])
        values = {}
        for (v, i), x in sorted(miss.items(), key=lambda r: r[0][1]):
            score = round(1 - math.exp(x), 9)
            if score >= op.MIN_SCORE and (v not in values or score > values[v][1]):
                values[v] = (i, score)
    return values


def brute_spans(texts):
    values = brute_rounds(texts)
    out = []
    for t in texts:
        base, slots = op.spans_of(t)
        added = {(s["start"], values[s["value"]][0], s["stop"]) for s in slots if not s["known"] and s["loose"] and s["value"] in values}
        out.append(sorted([*base, *added]))
    return out


def test_base_forms():
    rng = random.Random(3)
    pieces = ["a", "b.c", "@", "@x", ".y", ".", "-", " ", "+", "1", "22", "255", "256", "0255", "4532015112830366", "+1 ", "(269)", " 555-3296", "é", "\n", "::", "%", "1.2.3.4", "٣"]
    for _ in range(6000):
        t = "".join(rng.choices(pieces, k=rng.randrange(14)))
        assert op.base_spans(t) == brute_base(t), t


def test_long_texts_take_linear_time():
    for t in ("a" * 2_000_000, "1" * 2_000_000, "1." * 100_000, "+" * 1_000_000, "@a" * 100_000, "+1" + " " * 1_000_000, "a at " * 100_000, "1-" * 500_000, ":" * 500_000):
        base, slots = op.spans_of(t)
        assert sum(1 for _ in slots) >= 0


def corpus():
    """Seeds in contexts of their own, unseen identifiers in the same ones, and the same looks in contexts that tell nothing."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    fill = lambda: " ".join(word() for _ in range(6))
    rows = []
    for i in range(40):
        rows.append(f"{fill()} please call me on +1 ({200 + i}) 555-{1000 + 37 * i} {fill()}")
        rows.append(f"{fill()} write to the address {word()}.{i}@mail{i % 7}.example.com {fill()}")
        rows.append(f"{fill()} of {i * 3} and version {i}.{i}.1 of 2024-01-{i:02d} {fill()}")
    hidden = ["555-867-5309", "bob dot", "(020) 7946 0958"]
    rows.append(f"{fill()} please call me on {hidden[0]} {fill()}")
    rows.append(f"{fill()} please call me on {hidden[2]} {fill()}")
    rows.append(f"{fill()} write to the address carol [at] corp.example.org {fill()}")
    rows.append(f"{fill()} again {hidden[0]} {fill()}")  # an accepted value, without its context
    rows.append(f"{fill()} parts 555-867-1111 {fill()}")  # the same look, unknown context
    rows += [f"{fill()} order 4532 0151 1283 0367 {fill()}", "", "no data here"]
    return rows


def run(spark, rows, partitions=3):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(partitions)
    return {r.doc_id: [tuple(s) for s in r.spans] for r in op.extract(df).collect()}


def test_unseen_identifiers(spark):
    rows = corpus()
    got = run(spark, rows)
    assert got == dict(enumerate(brute_spans(rows)))
    assert got == run(spark, rows, 1)
    said = lambda i: [(op.KINDS[k], rows[i][a:b]) for a, k, b in got[i]]
    assert said(120) == [("phone", "555-867-5309")] and said(121) == [("phone", "(020) 7946 0958")]
    assert said(122) == [("email", "carol [at] corp.example.org")] and said(123) == [("phone", "555-867-5309")]
    assert not any(got[i] for i in range(124, len(rows)))
    assert all(set(brute_base(t)) <= set(got[i]) for i, t in enumerate(rows))


def test_next_round_learns_from_the_last(spark):
    """Values accepted by one context make another one sure, which finds more."""
    rng = random.Random(1)
    fill = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(5))
    rows = [f"{fill()} call me now on +1 (3{i:02d}) 555-12{i:02d} {fill()}" for i in range(30)]
    both = [f"555-200-{1000 + i}" for i in range(30)]
    rows += [f"{fill()} call me now on {b} {fill()}" for b in both] + [f"{fill()} my direct office line {b} {fill()}" for b in both]
    rows.append(f"{fill()} my direct office line 555-999-1234 {fill()}")
    rows += [f"{fill()} call me now on +1 (4{i:02d}) 555-12{i:02d} {fill()}" for i in range(80)]
    got = run(spark, rows)
    assert got == dict(enumerate(brute_spans(rows))) and len(got[90]) == 1


def test_given_table(spark, given):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in op.op12_pii(spark, "/root/testdata/sf0.01").collect()}
    want = dict(zip(rows, brute_spans(list(rows.values()))))
    assert got.keys() == rows.keys()
    for i, t in rows.items():
        base = brute_base(t)
        assert got[i].spans == text_of(want[i]) and got[i].base_sha256 == hashlib.sha256(text_of(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in op.KINDS] == [sum(b[1] == j for b in base) for j in range(4)]


def test_patterns_as_text(spark):
    df = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    slots = op.slots_of(op.scanned(df)).cache()
    good, _ = op.bootstrapped(op.graph(slots))
    said = {(r.pattern, r.kind) for r in op.patterns(slots, good).collect()}
    assert {("me on _", "phone"), ("on _", "phone"), ("the address _", "email")} <= said


def test_odd_tables(spark, odd, empty, given):
    given(op, documents=odd)
    got = op.op12_pii(spark, "").collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r.doc_id for r in odd.collect())
    given(op, documents=empty)
    assert op.op12_pii(spark, "").collect() == []


def test_repeated_and_null_ids(spark):
    t = "mail a.b@c.de and +1 (269) 555-3296 4532015112830366 x"
    df = spark.createDataFrame([(None, t), (None, t), (None, "other 1.2.3.4"), (5, t), (5, "other"), (6, None)], "doc_id long, text string")
    got = collections.Counter((r.doc_id, text_of([tuple(s) for s in r.base])) for r in op.extract(df).collect())
    assert got == collections.Counter((i, text_of(brute_base(x or ""))) for i, x in [(None, t), (None, t), (None, "other 1.2.3.4"), (5, t), (5, "other"), (6, None)])


def test_many_slots_go_out_in_parts(spark):
    t = " ".join(f"{i}.1.2.3 w{i}" for i in range(200, 3000))
    df = spark.createDataFrame([(1, t), (2, "x")], "doc_id long, text string")
    assert op.scanned(df).where("doc_id = 1").count() > 5
    got = {r.doc_id: r for r in op.extract(df).collect()}
    assert len(got) == 2 and len(got[1].base) == 56
