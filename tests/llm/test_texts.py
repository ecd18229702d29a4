"""WARC, segmentations, wrappers, the pipeline."""

import base64
import collections
import hashlib
import html
import io
import itertools
import math
import re

import duckdb
import numpy as np
import pytest
import sentencepiece

from fathom.llm import op4_warc, op5_pieces, op9_wrappers

SF = "/root/testdata/sf0.01"


def brute_warc(rows):
    best = {}
    for i, h in rows:
        b = (h or "").encode()
        if i is not None:
            best[b] = max(i, best.get(b, i))
    for i, h in rows:
        b = (h or "").encode()
        last = best.get(b)
        again = last is not None and i != last
        yield i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", last if again else None


def test_warc_round_trip(spark, given):
    rows = [(i, None if i % 5 == 0 else f"http://x/{i}", ["", None, "aé", "b" * 300_000][i % 4]) for i in range(40)] + [(None, "u", "q"), (7, "u\r\nX: 1", "b" * 300_000), (None, "u", None), (39, "u", "b" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for frame in (df, df.limit(0)):
        given(op4_warc, pages=frame)
        got = op4_warc.op4_warc(spark, "").collect()
        want = list(brute_warc([(r.page_id, r.html) for r in frame.collect()]))
        assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == collections.Counter(want)


def test_warc_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM read_parquet('/root/testdata/sf0.01/pages.parquet')")
    a, b = op4_warc.op4_warc(spark, "/root/testdata/sf0.01").toPandas(), con.execute(op4_warc.ORACLE_SQL).fetchdf()
    columns = sorted(a.columns)
    a, b = (x[columns].astype({"refers_to": "Int64"}).astype(str).sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert a.equals(b)


def test_warc_payloads_and_breaches(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    folder = f"{op4_warc.shared_dir(spark)}/warc-test-{np.random.randint(1 << 30)}"
    archives = op4_warc.write(pages, folder)
    back = {r.page_id: bytes(r.payload).decode() for r in op4_warc.read(archives, folder).collect()}
    assert back == {r.page_id: r.html for r in pages.collect()}
    record = op4_warc.build_record(1, "u", b"payload")
    assert op4_warc.parse_record(record)["payload"] == b"payload"
    for bad in (record[:-5], record.replace(b"WARC/1.1", b"WARX/1.1"), record.replace(b"payload\r\n\r\n", b"paXload\r\n\r\n"), record.replace(b"WARC-Date: ", b"WARC-Dote: "), record.replace(b"Content-Length: ", b"Content-Length: 9", 1)):
        with pytest.raises(op4_warc.WarcError):
            op4_warc.parse_record(bad)
    out = io.BytesIO()
    w = op4_warc.ArchiveWriter(out, op4_warc.train([record + str(i).encode() * 50 for i in range(300)]))
    for i in range(5):
        w.write(op4_warc.build_record(i, "u", b"x" * 100 * i))
    data = out.getvalue()
    assert len(list(op4_warc.read_archive(io.BytesIO(data), 37))) == 5
    for cut in (data[:4], data[:-3], data[8:]):
        with pytest.raises(op4_warc.WarcError):
            list(op4_warc.read_archive(io.BytesIO(cut)))


@pytest.fixture(scope="module")
def vocabulary():
    return op5_pieces.Vocabulary.load()


def segmentations(text, v):
    """All of them with their log-probabilities."""
    per_unit = []
    for unit in v.unit.findall(" " + text):
        _, node, length, piece, p, _ = op5_pieces.lattices([unit], v, op5_pieces.simple(unit))
        edges = collections.defaultdict(list)
        for n, k, i, x in zip(node.tolist(), length.tolist(), piece.tolist(), p.tolist()):
            edges[n].append((n + k, i, x))
        found, todo = [], [(0, (), 0.0)]
        while todo:
            at, ids, log = todo.pop()
            if at == len(unit):
                found.append((ids, log))
                continue
            todo += [(j, (*ids, i), log + math.log(x)) for j, i, x in edges[at]]
        per_unit.append(found)
    return {sum((c[0] for c in combo), ()): sum(c[1] for c in combo) for combo in itertools.product(*per_unit)}


def test_samples_are_gumbel_top_k(vocabulary):
    text = "thenat é"
    every = segmentations(text, vocabulary)
    assert sum(math.exp(x) for x in every.values()) == pytest.approx(1)
    tables, n = op5_pieces.Lattices(vocabulary), 6000
    first, pairs = collections.Counter(), collections.Counter()
    for samples in op5_pieces.search([text] * n, [op5_pieces.mix1(i) for i in range(n)], 3, tables):
        ids = [tuple(tables.piece[e].tolist()) for e, *_ in samples]
        assert len(set(ids)) == len(ids) and [s[2] for s in samples] == sorted((s[2] for s in samples), reverse=True)
        assert all(s[1] == pytest.approx(every[i], abs=1e-9) and 0 <= s[3] <= 1 for s, i in zip(samples, ids))
        first[ids[0]] += 1
        pairs[ids[0], ids[1]] += 1
    top = sorted(every, key=every.get, reverse=True)[:3]
    for a in top:
        assert first[a] / n == pytest.approx(math.exp(every[a]), abs=0.025)
    for a, b in itertools.permutations(top, 2):
        assert pairs[a, b] / n == pytest.approx(math.exp(every[a] + every[b]) / (1 - math.exp(every[a])), abs=0.025)


def test_all_samples_of_a_small_lattice(vocabulary):
    every = segmentations("ab", vocabulary)
    got = op5_pieces.search(["ab"], [9], 50, op5_pieces.Lattices(vocabulary))[0]
    assert len(got) == len(every) and all(s[3] == 1.0 for s in got)


def test_pieces_odd(spark, odd, empty):
    texts = ["", "a  b\n\tc ▁ x", " lead", "中\x00é ² x², _{", "word" * 30_000, None, "퟿😀 é", "\r\n x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in op5_pieces.decode(op5_pieces.encode(df, k=3)).collect():
        assert r.decoded == (texts[r.doc_id] or "")
    m = sentencepiece.SentencePieceProcessor(model_file=op5_pieces.MODEL)
    plain = {r.doc_id: r.ids for r in op5_pieces.encode_plain(df).collect()}
    v = op5_pieces.Vocabulary.load()
    assert all(plain[i] == m.encode(t or "") and v.decode(plain[i]) == (t or "") for i, t in enumerate(texts) if "▁" not in (t or ""))
    a, b = (sorted(map(tuple, op5_pieces.encode(x, digest=True).collect()), key=str) for x in (odd, odd.repartition(5)))
    assert a == b and all(r[-1] for r in a)
    assert op5_pieces.encode(empty).count() == 0


def test_pieces_query_and_stage_give_ids(spark, given):
    texts = ["Some words é", "", None, "a  b"]
    given(op5_pieces, documents=(df := spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    plain = {(r.doc_id, r.rank): r.ids for r in op5_pieces.encode(df).collect()}
    for out in (op5_pieces.op5_pieces(spark, ""), op5_pieces.stage(spark, df, "")):
        rows = op5_pieces.decode(out).collect()
        assert {(r.doc_id, r.rank): r.ids for r in rows} == plain
        assert all(r.decoded == (texts[r.doc_id] or "") and r.round_trip and len(r.ids_digest) == 16 for r in rows)


def test_main_text(spark):
    got = {r.page_id: r for r in op9_wrappers.op9_wrappers(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<b>", "", x)).split()) for x in re.split(r"</?p>|<br>|</?h1>", article))
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


PAGE = '<html><body><header><h1>Site</h1></header><div class="cookie-notice">Cookies</div><main><article><header><h1>T</h1></header><p>Hello &amp; <a href=x>there</a>  you<br>next<aside>no</aside><p>more<form><label>Mail</label></form><script>var a="</p>";</script><section class="comments"><p>c1</p></section></article></main><div id="sidebar">s</div><!-- x --><footer>f</footer></body></html>'


def test_boilerplate_goes(spark, given):
    rows = [(1, "http://a/1", PAGE), (1, "http://a/1", PAGE), (2, None, None), (3, "http://[bad", "<p>broken <b>mark"), (4, "http://b/1", ""), (None, "http://c/1", "<p>x</p>"), (5, "http://d/5", "just text"), (6, "http://a/2", "<p" + "<div " * 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS wrapper", "'clash' AS host")
    given(op9_wrappers, pages=df)
    got = op9_wrappers.op9_wrappers(spark, "").collect()
    assert len(got) == len(rows)
    assert [r.text for r in got if r.page_id == 1] == ["T\nHello & there you\nnext\nmore"] * 2
    assert {r.text for r in got if r.page_id in (2, 4)} == {""} and {r.text for r in got if r.page_id in (3, 5, None)} == {"broken mark", "just text", "x"}
    given(op9_wrappers, pages=df.limit(0))
    assert op9_wrappers.op9_wrappers(spark, "").count() == 0


def test_host_of_mixed_templates(spark, given):
    article = [(k, "http://m/a", f"<body><nav>n</nav><article><h1>A{k}</h1><p>text {k}</p></article><div>All rights</div></body>") for k in range(5)]
    plain = [(k, "http://m/p", f'<body><div class="x"><h2>T{k}</h2><p>plain {k}</p></div><ul><li><a href="/">Home</a></li></ul><div>All rights</div></body>') for k in range(5, 10)]
    given(op9_wrappers, pages=spark.createDataFrame(article + plain, "page_id long, url string, html string"))
    got = {r.page_id: r.text for r in op9_wrappers.op9_wrappers(spark, "").collect()}
    assert got == {k: f"A{k}\ntext {k}" if k < 5 else f"T{k}\nplain {k}" for k in range(10)}


def test_copies_are_one_page(spark, given):
    page = "<div><h2>T</h2><p>a</p><p>b</p></div>"
    other = [(k, "http://b/", f"<div><h3>D{k}</h3><p>a{k}</p></div>") for k in range(4, 8)]
    rows = [(k, "http://a/", page) for k in range(4)] + [(k, "http://b/", page) for k in range(10, 14)] + other
    given(op9_wrappers, pages=spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    got = {r.page_id: r.text for r in op9_wrappers.op9_wrappers(spark, "").collect()}
    assert got == {k: "T\na\nb" if k < 4 or k > 9 else f"D{k}\na{k}" for k in got} and len(got) == 12


def test_wrapper_without_article():
    page = lambda k: f'<div><ul><li><a href="/">Home</a></li></ul><h2>T{k}</h2><p>text number {k} is here</p><p>second {k}</p></div><div class="x">All rights</div>'
    wrapper = None
    for k in range(4):
        items = op9_wrappers.fold(op9_wrappers.parse(page(k)))[0]
        wrapper = items if wrapper is None else op9_wrappers.merge(wrapper, items)
    assert "'All rights'" in op9_wrappers.regex(wrapper) and "(p:#text)+" in op9_wrappers.regex(wrapper)
    assert op9_wrappers.Reader(wrapper)(page(1)) == "T1\ntext number 1 is here\nsecond 1"
    both = op9_wrappers.merge(wrapper, op9_wrappers.fold(op9_wrappers.parse("<div><h2>X</h2><blockquote>q</blockquote></div>"))[0])
    assert "(blockquote:'q')?" in op9_wrappers.regex(both)


def alone(page):
    return op9_wrappers.Reader(op9_wrappers.fold(op9_wrappers.parse(page))[0])(page)


def test_hidden_inline_elements_cost_no_text():
    assert alone("<p>Hello <span hidden>x</span> world</p>") == "Hello world"
    assert alone("<p>a <i style='display: none'>x <i>y</i> z</i> b</p><p>c</p>") == "a b\nc"
    assert alone("<p>a <span hidden>x</p><p>b</p>") == "a\nb"
    assert alone('<p>a <img aria-hidden="true"> b <span hidden/> c</p>') == "a b c"


def test_slots_are_judged_one_by_one():
    assert alone('<p>A plain paragraph.</p><p><a href="x">a text in a link</a> and</p>') == "A plain paragraph.\na text in a link and"
    assert alone('<p>Plain.</p><p><a href="x">a long text in a link</a> and</p>') == "Plain."
    page = '<article><h2 class="social">Social</h2><section class="share-price"><p>It fell.</p></section><p id="alert">An alert.</p><div class="commentary">View</div><div class="ad-box">Buy</div><ul class="share-buttons"><li>Share</li></ul><section class="comments"><p>c</p></section></article>'
    assert alone(page) == "Social\nIt fell.\nAn alert.\nView"


def test_wrapper_decides_on_every_page(spark, given):
    """Constants within the article go, and so does what is outside, by what the host's other pages show."""
    rows = [(k, "http://a/", f"<body><article><h1>A{k}</h1><p>text {k} {'word ' * k}</p><div>Get our app</div></article><p>Teaser {k}</p></body>") for k in range(8)]
    given(op9_wrappers, pages=spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r.text for r in op9_wrappers.op9_wrappers(spark, "").collect()}
    assert got == {k: f"A{k}\n" + f"text {k} {'word ' * k}".strip() for k in range(8)}
    assert alone(rows[3][2]) != got[3]  # the page alone doesn't show it


def test_wrapper_is_the_same_for_any_partitioning(spark):
    import random

    r = random.Random(4)
    block = lambda k: r.choice(["<p>t{}</p>", "<div class='x'><h3>h{}</h3><p>a{}</p></div>", "<ul><li>i{}</li><li>j</li></ul>", "<div>Same</div>", "<blockquote>q{}</blockquote>"]).replace("{}", str(k))
    rows = [(k, f"http://{'ab'[k % 2]}/", "".join(block(k * 9 + i) for i in range(r.randint(1, 9)))) for k in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, other = (op9_wrappers.extract(x, op9_wrappers.infer(x)).collect() for x in (df.coalesce(1), df.repartition(7)))
    assert sorted(map(str, one)) == sorted(map(str, other)) and any(x.text for x in one)


def test_broken_pages_take_time_by_their_length():
    import time

    for piece in ("<a ", '<a b="', "<div>x", "<div></p>", "<p>x", "<b hidden>", "<!--", "</", "<li><ul>", "<script", "=' <x ", "&#", "<div class='a b'>", "<a b='c>", "<td>x</div>"):
        page = "<p>start</p>" + piece * (2_000_000 // len(piece))
        begin = time.time()
        slots = op9_wrappers.parse(page)
        took = time.time() - begin
        assert slots[0][1] == "start" and took < 8, (piece, took)  # seconds; quadratic time would be hours
    items = [[f"p{k % 997}" if k % 3 else "p", None, False, False, [k], 1, 1, 0] for k in range(30_000)]
    begin = time.time()
    op9_wrappers.merge(items, items[::-1])
    assert time.time() - begin < 8


def test_alignment_keeps_order_and_pairs_equal_tokens():
    import random

    r = random.Random(6)
    for _ in range(300):
        a, b = ([[r.choice("abcdefg" if r.random() < 0.8 else "xyzuvw")] for _ in range(r.randint(0, 90))] for _ in "ab")
        pairs = op9_wrappers.align(a, b)
        left, right = [i for i, _ in pairs if i is not None], [j for _, j in pairs if j is not None]
        assert left == list(range(len(a))) and right == list(range(len(b)))
        assert all(a[i] == b[j] for i, j in pairs if i is not None and j is not None)


def test_pipeline(spark):
    import corpus_pipeline
    from fathom.llm import op2_simhash, op3_suffix, op7_mixing, op8_rules

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = op8_rules.stage(spark, docs, SF)
    assert rules.columns == docs.columns
    kept = {r.doc_id for r in op8_rules.op8_rules(spark, SF).where("kept").collect()}
    assert {r.doc_id for r in rules.collect()} == kept
    single = op2_simhash.stage(spark, rules, SF)
    least = {}
    for r in op2_simhash.similar(rules).collect():
        least[r.root] = min(least.get(r.root, r._fathom_did), r._fathom_did)
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(least.values())
    cut = op3_suffix.stage(spark, single, SF)
    assert cut.columns == docs.columns and cut.count() == single.count()
    mixed = op7_mixing.stage(spark, cut, SF)
    assert mixed.columns == docs.columns and max(collections.Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    out = corpus_pipeline.run(spark, SF)
    assert out.where("NOT round_trip").count() == 0 and out.where("rank = 1").count() == mixed.count()


def test_pipeline_odd(spark, odd, empty, monkeypatch):
    """Nulls, empty and long texts, repeated rows, an empty table, columns of names that operators use."""
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(400))
    more = spark.createDataFrame([(20, long, "en", "a", 5), (20, long, "en", "a", 5), (None, long + " x", None, None, None), (21, " ".join(f"v{i % 390}" for i in range(420)), None, None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    frame = odd.unionByName(more, allowMissingColumns=True)
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: frame)
    out = corpus_pipeline.run(spark, "")
    rows = out.collect()
    assert {20, 21} <= {r.doc_id for r in rows} and all(r.round_trip for r in rows)
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: empty)
    assert corpus_pipeline.run(spark, "").count() == 0 and corpus_pipeline.run(spark, "").columns == out.columns


def test_wrapper_keeps_text_around_drawings_and_controls():
    for page, text in [
        ('<article><p>one</p><svg viewBox="0 0 1 1"/><p>two</p></article>', "one\ntwo"),
        ("<article><p>a <svg><title>t</title><g/></svg>b</p></article>", "a b"),
        ("<article><p>x <svg><svg><text>q</text></svg><text>w</text></svg> y</p><svg><path><p>z</p></article>", "x y\nz"),
        ("<article><p>a <math><mi>x</mi></math> b</p></article>", "a b"),
        ('<article><p>one</p><p class="recommended">We recommend this book.</p></article>', "one\nWe recommend this book."),
        ('<article><p>one</p><p class="advert">Buy</p><div class="related">More</div><p>two</p></article>', "one\ntwo"),
        ("<article><p>a <button>Share</button> b <input type=text> c</p></article>", "a b c"),
    ]:
        assert alone(page) == text
