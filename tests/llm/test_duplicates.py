"""SimHash, suffix dedup, image copies, components."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from fathom.llm import components, op2_simhash, op3_suffix, op6_media


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def fingerprint(text, shingle=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    parts = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def expected(rows):
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = find(parent, i), find(parent, j)
            parent[max(a, b)] = min(a, b)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(parent, i)].append(d)
    return collections.Counter((d, format(p, "016x"), min(least[find(parent, i)], default=None)) for i, ((d, _), p) in enumerate(zip(rows, prints)))


def near_copies():
    r = random.Random(5)
    base = [r.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(r.randint(0, 99)) for _ in range(120)]
    rows = [(i, " ".join(w if r.random() > 0.004 * (i % 4) else "edit" for w in base)) for i in range(120)]
    return rows + [(500 + i, " ".join(r.choice(base) for _ in range(3))) for i in range(40)] + [(900, ""), (901, None), (902, " \n")]


@pytest.mark.parametrize("bucket", [1024, 4])
def test_simhash_brute(spark, odd, empty, given, monkeypatch, bucket):
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(op2_simhash)
    monkeypatch.setattr(op2_simhash, "BUCKET", bucket)
    try:
        for df in (spark.createDataFrame(near_copies(), "doc_id long, text string"), odd, empty):
            given(op2_simhash, documents=df)
            got = op2_simhash.op2_simhash(spark, "").collect()
            assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected([tuple(r) for r in df.select("doc_id", "text").collect()])
    finally:
        cloudpickle.unregister_pickle_by_value(op2_simhash)


def test_simhash_stage(spark, odd, empty):
    kept = op2_simhash.stage(spark, odd, "")
    rows = kept.collect()
    assert kept.columns == odd.columns and collections.Counter(r.doc_id for r in rows if r.doc_id) == {1: 1, 3: 1, 5: 1, 7: 1} | ({6: 1} if 6 in {r.doc_id for r in rows} else {})
    assert sum(r.doc_id is None for r in rows) == 1  # "no id here", once; the null text is like the empty one
    assert op2_simhash.stage(spark, empty, "").count() == 0


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or ({" ".join(w)} if w else set())


def brute_similar(rows, least=0.8):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
            a, b = find(parent, i), find(parent, j)
            parent[max(a, b)] = min(a, b)
    return [find(parent, i) for i in range(len(rows))]


def edited(words, share, r):
    return [r.choice("xyz") + str(r.random()) if r.random() < share else w for w in words]


def test_similar_brute(spark, odd, monkeypatch):
    r = random.Random(3)
    word = lambda: r.choice("abcdefgh") + str(r.randint(0, 999))
    rows = []
    for g in range(30):  # groups of near copies, and unlike texts
        base = [word() for _ in range(r.randint(60, 300))]
        rows += [" ".join(edited(base, r.choice([0, 0.003, 0.006]), r)) for _ in range(r.randint(1, 5))]
    chain = [word() for _ in range(200)]  # neighbours are alike, the ends aren't: links that a star misses
    for _ in range(50):
        chain = [*chain[4:], *(word() for _ in range(4))]
        rows.append(" ".join(chain))
    rows += ["", None, " \t", "A b", "a B", "one two three four five six"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    got = {x._fathom_did: x.root for x in op2_simhash.similar(docs).collect()}
    want = brute_similar(list(enumerate(rows)))
    groups = lambda label: {frozenset(i for i in range(len(rows)) if label[i] == k) for k in {label[i] for i in range(len(rows))}}
    assert groups(got) == groups(want)


def test_stage_takes_the_querys_links(spark, monkeypatch):
    """What the query's fingerprints link and the check confirms is joined without any meeting in the wide tables."""
    monkeypatch.setattr(op2_simhash, "meetings", lambda nodes, *_: nodes.select("node", "node").toDF("a", "b").limit(0))
    r = random.Random(8)
    rows = []
    for g in range(20):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(200)]
        rows += [(len(rows) + k, " ".join([*base[:-1], f"end{k}"])) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints, sets = [fingerprint(t) for _, t in rows], [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = find(parent, i), find(parent, j)
            parent[max(a, b)] = min(a, b)
    least = {find(parent, i) for i in range(len(rows))}
    assert len(least) < len(rows) / 2 and {x.doc_id for x in op2_simhash.stage(spark, docs, "").collect()} == least


def test_similar_idle_buckets_are_passed_over():
    r = np.random.RandomState(6)
    bounds = np.cumsum([0, *r.randint(1, 9, 300), op2_simhash.SMALL + 1])
    fp = r.randint(0, 1 << 62, (bounds[-1], 4)).astype(np.uint64)
    root = np.arange(bounds[-1])
    for i in range(1, 250, 5):
        if bounds[i + 1] - bounds[i] > 1:
            fp[bounds[i + 1] - 1] = fp[bounds[i]] ^ np.array([(0, 1, 7)[i % 3], 0, 0, 0], np.uint64)
            root[bounds[i + 1] - 1] -= (i % 2) * (bounds[i + 1] - 1 - bounds[i])
    pairs = lambda s, e: any(root[i] != root[j] and np.bitwise_count(fp[i] ^ fp[j]).sum() <= 1 for i, j in itertools.combinations(range(s, e), 2))
    want = [i for i in range(300) if pairs(bounds[i], bounds[i + 1])] + [300]
    assert op2_simhash.lively(fp, root, bounds, 1).tolist() == want and len(want) > 10


def test_similar_bound_is_one():
    r = np.random.RandomState(5)
    for n in (0, 3, 140, 2000):
        base = r.randint(0, 1 << 62, n).astype(np.uint64)
        sets = [np.unique(np.concatenate((base[r.rand(n) > share], r.randint(0, 1 << 62, int(share * n)).astype(np.uint64)))) for share in (0, 0, 0.05, 0.1, 0.3, 0.8)]
        digests = np.frombuffer(b"".join(op2_simhash.digest_of(s) for s in sets), np.uint8).reshape(len(sets), -1)
        size = np.array([len(s) for s in sets])
        for i, a in enumerate(sets):
            most = op2_simhash.bound(size, digests, i, np.arange(len(sets)))
            true = [op2_simhash.jaccard(a, b) for b in sets]
            assert all(t <= m + 1e-12 or n == 0 for t, m in zip(true, most))
            assert n != 140 or all(m - t < 0.1 for t, m in zip(true, most) if t > 0.6)


def test_similar_filter(spark):
    df = spark.createDataFrame([(i, i * 7) for i in range(500)], "_fathom_did long, _fathom_th long")
    bits = op2_simhash._filter(df)
    at = [x.a for x in df.selectExpr(f"xxhash64(_fathom_did, _fathom_th) & {(1 << op2_simhash.FILTER_BITS) - 1} AS a").collect()]
    assert {i * 8 + j for i in np.flatnonzero(bits).tolist() for j in range(8) if bits[i] >> j & 1} == set(at)


def test_similar_recall_at_the_threshold(spark):
    """Pairs from 0.8 on are found; pairs below aren't linked, however near."""
    r = random.Random(4)
    rows, alike = [], []
    while len(rows) < 1200:
        base = [f"w{r.randint(0, 10**6)}" for _ in range(300)]
        other = edited(base, 0.02, r)
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
        alike.append(len(a & b) / len(a | b))
    root = {x._fathom_did: x.root for x in op2_simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [root[2 * i] == root[2 * i + 1] for i in range(len(alike))]
    assert not any(x for x, j in zip(linked, alike) if j < 0.8)
    near = [x for x, j in zip(linked, alike) if 0.8 <= j < 0.85]
    assert len(near) > 100 and sum(near) / len(near) >= 0.9 and all(x for x, j in zip(linked, alike) if j > 0.92)


def test_similar_masks_are_disjoint_in_a_family():
    for n in (10, 10**5, 10**8):
        tables = op2_simhash.families(n, 0.8)
        k = sum((m & (2**64 - 1)).bit_count() for m in tables[0])
        per = 256 // k
        for f in range(0, len(tables), per):
            total = [sum((t[w] & (2**64 - 1)) for t in tables[f : f + per]) for w in range(4)]
            assert all(x < 2**64 for x in total) and sum(x.bit_count() for x in total) == per * k
        assert 1 - (1 - op2_simhash.agreement(0.8) ** k) ** len(tables) >= op2_simhash.RECALL


@pytest.mark.parametrize("family", range(5))
def test_masks_cover(family):
    found = [m & (2**64 - 1) for m in op2_simhash.masks(4, family)]
    r = random.Random(family)
    for _ in range(2000):
        bits = sum(1 << b for b in r.sample(range(64), 4))
        assert any(m & bits == 0 for m in found)


def test_components(spark):
    r = random.Random(1)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(None, 3), (7, 7), (5, 6), (5, 6)]
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {i: i for i in range(500)}
    for a, b in links:
        if a is not None and a != b:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    linked = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert got == {x: find(parent, x) for x in linked}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_links_are_few_tasks(spark, monkeypatch):
    """Steps over few links took a task for each of Spark's partitions."""
    sizes, plain = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: sizes.append((made := plain(df)).rdd.getNumPartitions()) or made)
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 7], "a long, b long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for bound, most in ((1 << 16, 1), (9, 7)):
            sizes.clear()
            monkeypatch.setattr(components, "LINKS", bound)
            got = {r.node: r.root for r in components.connected_components(links).collect()}
            assert got == {i: (i - 1) // 7 * 7 + 1 for i in range(1, 41)}
            assert len(sizes) > 4 and max(sizes[1:]) <= most
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components_in_one_pass_are_those_of_the_steps(spark, monkeypatch):
    """Few links took four stored tables a step, each of some stages of all of Spark's partitions."""
    r = random.Random(4)
    links = [(r.randint(-300, 300), r.randint(-300, 300)) for _ in range(250)] + [(i + 1, i) for i in range(1000, 1200)] + [(5000, i) for i in range(4000, 4100)] + [(None, 3), (7, 7), (6, 5), (5, 6)]
    df = spark.createDataFrame(r.sample(links, len(links)), "a long, b long").repartition(5).cache()
    taken, plain = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: taken.append(df) or plain(df))
    want = sorted(map(tuple, components.connected_components(df).collect()))
    assert len(taken) > 4
    taken.clear()
    assert sorted(map(tuple, components.components(df).collect())) == want and len(taken) == 2
    assert components.components(df.limit(0)).count() == 0
    monkeypatch.setattr(components, "LINKS", 100)
    taken.clear()
    assert sorted(map(tuple, components.components(df).collect())) == want and len(taken) > 4


def test_components_of_a_million_links_take_no_steps(spark, monkeypatch):
    """Over 65,536 links, steps of ten stages each filled the driver's memory."""
    taken, plain = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: taken.append(df) or plain(df))
    links = spark.range(200_000).selectExpr("id - id % 4 AS a", "id AS b")
    got = components.components(links)
    assert len(taken) == 2
    assert got.where("root = node - pmod(node, 4)").count() == got.count() == 200_000


def test_similar_pairs_do_not_add_partitions(spark, monkeypatch):
    """The pairs of each check came with partitions of their own, and all of them were tasks of every later pass."""
    r = random.Random(6)
    base = [[f"w{r.randint(0, 9999)}" for _ in range(150)] for _ in range(12)]
    rows = [(k * 100 + i, " ".join(w if r.random() > 0.004 * i else "x" for w in words)) for k, words in enumerate(base) for i in range(6)]
    seen, plain = [], op2_simhash._rooted
    monkeypatch.setattr(op2_simhash, "_rooted", lambda nodes, pairs: seen.append(pairs.rdd.getNumPartitions()) or plain(nodes, pairs))
    monkeypatch.setattr(op2_simhash, "NEAR", 4)  # most is left to the later checks
    op2_simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(seen) > 1 and set(seen) == {1}


def brute_suffix(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    n = collections.Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if n[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        yield len(b), len(b) - len(kept), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()


def passages():
    r = random.Random(1)
    words = lambda n: " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(1, 9))) for _ in range(n))
    shared, rows = words(60), []
    for i in range(160):
        k = i % 8
        q = words(40)
        rows.append((i, [words(30) + " " + shared + " " + words(20), shared[r.randint(0, 80) :] + words(10), "a" * r.choice([199, 200, 201, 450]), words(5), "", "xy" * r.randint(50, 200) + words(3), q + " " + words(3) + " " + q, shared + shared[:150] + shared[100:320]][k]))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_suffix_brute(spark, odd, empty, given, monkeypatch, small):
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(op3_suffix)
    if small:
        for name, value in (("GROUP", 5), ("HELD", 7), ("BLOCK", 1000), ("HOT_LEAST", 10), ("BUCKET_BYTES", 20_000)):
            monkeypatch.setattr(op3_suffix, name, value)
    try:
        for df in (spark.createDataFrame(passages(), "doc_id long, text string"), odd, empty):
            given(op3_suffix, documents=df)
            rows = df.select("doc_id", "text").collect()
            want = collections.Counter((r.doc_id, *w) for r, w in zip(rows, brute_suffix([r.text for r in rows])))
            got = op3_suffix.op3_suffix(spark, "").collect()
            assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    finally:
        cloudpickle.unregister_pickle_by_value(op3_suffix)


def test_suffix_places_have_no_bound():
    far = 1 << 40
    row = op3_suffix._rows(0, *[np.array([x]) for x in (5, 6, 7, 8, 9, far, (168 << op3_suffix.AT) | 169, 0)])
    assert row.column("start")[0].as_py() == far and (row.column("shape")[0].as_py() >> op3_suffix.AT, row.column("shape")[0].as_py() & 255) == (168, 169)
    assert op3_suffix.merged([{"start": far, "n": 200}, {"start": far + 150, "n": 200}, {"start": 3, "n": 200}], far + 300) == [(3, 203), (far, far + 300)]


def test_suffix_ranks_are_in_byte_order():
    texts = [bytes(np.random.RandomState(i).randint(0, 256, 300, dtype=np.uint8)) for i in range(50)]
    got = sorted((op3_suffix.ranks(np.frombuffer(t, np.uint8), np.array([10]), np.array([0], np.uint64))[0], t[10:16]) for t in texts)
    assert [lead for _, lead in got] == sorted(t[10:16] for t in texts)


def test_suffix_stage(spark, odd, empty):
    out = op3_suffix.stage(spark, odd, "")
    assert out.columns == odd.columns and out.count() == odd.count() and all(r.n_chars == len(r.text) and r.did == "clash" for r in out.collect())
    assert op3_suffix.stage(spark, empty, "").count() == 0


def test_multikey_quicksort():
    r = np.random.RandomState(2)
    raw = r.randint(97, 99, 5000).astype(np.uint8)
    raw[1000:1400] = raw[3000:3400]
    starts = np.arange(5000 - op3_suffix.LENGTH - 8)
    index, part = op3_suffix.multikey_quicksort(op3_suffix.words64(np.append(raw, np.zeros(8, np.uint8))), starts, np.zeros(len(starts), np.int64))
    got = {frozenset(index[part == p].tolist()) for p in set(part.tolist())}
    groups = collections.defaultdict(set)
    for s in starts.tolist():
        groups[raw[s : s + op3_suffix.LENGTH].tobytes()].add(s)
    assert got == {frozenset(g) for g in groups.values() if len(g) > 1}


def test_images_found(spark):
    got = op6_media.op6_media(spark, "/root/testdata/sf0.01").toPandas()
    queries = set(got[(got.kind == "member") & (got.id % op6_media.EVERY == 0)].id)
    hits = {r.id for r in got[got.kind == "match"].itertuples() if r.sha == r.class_sha}
    assert len(hits) / len(queries) >= 0.9


def warped(image, angle, scale, side):
    """The image's middle, turned and resized, by linear interpolation."""
    h, w = image.shape
    c, s = np.cos(angle) / scale, np.sin(angle) / scale
    y, x = np.mgrid[0:side, 0:side] - side / 2
    sx, sy = c * x + s * y + w / 2, c * y - s * x + h / 2
    x0, y0 = np.clip(np.floor(sx).astype(int), 0, w - 2), np.clip(np.floor(sy).astype(int), 0, h - 2)
    fx, fy = np.clip(sx - x0, 0, 1), np.clip(sy - y0, 0, 1)
    return image[y0, x0] * (1 - fx) * (1 - fy) + image[y0, x0 + 1] * fx * (1 - fy) + image[y0 + 1, x0] * (1 - fx) * fy + image[y0 + 1, x0 + 1] * fx * fy


def test_images_edited_in_other_ways_are_found(spark):
    fields, rng = op6_media._fields(), np.random.RandomState(0)
    images = [op6_media.read_image(op6_media._drawn(rng.normal(size=64).tolist(), fields)) for _ in range(40)]
    edits = [
        lambda im: warped(im, 0.35, 1, 72), lambda im: warped(im, 0.785, 1, 72), lambda im: warped(im, 0, 1.58, 110), lambda im: warped(im, 0, 1.25, 96), lambda im: warped(im, 0, 0.8, 76),
        lambda im: im[10:82, 10:82] + rng.normal(0, 12, (72, 72)), lambda im: im[10:82, 10:82] + rng.normal(0, 25, (72, 72)),
    ]
    frame = lambda rows: spark.createDataFrame([(i, bytearray(op6_media.write_pgm(x))) for i, x in rows], "id long, image binary")
    asked = [(100 * k + i, edit(images[i])) for k, edit in enumerate(edits) for i in range(20)]
    got = op6_media.match(op6_media.describe(frame(asked)), op6_media.describe(frame(enumerate(images)))).collect()
    right = {r.query_id for r in got if r.query_id % 100 == r.match_id}
    by_edit = [sum(100 * k + i in right for i in range(20)) / 20 for k in range(len(edits))]
    assert sum(by_edit) / len(by_edit) >= 0.9 and min(by_edit) >= 0.7, by_edit


def test_images_recall_against_brute_force(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id < 120").selectExpr("vec_id AS id", "vec_id AS seed", "embedding")
    index, queries = op6_media.describe(op6_media.render(vectors)), op6_media.describe(op6_media.render(vectors.where("id < 12"), edited=True))
    got = {(r.query_id, r.match_id) for r in op6_media.match(queries, index).collect()}
    a, b = queries.toPandas(), index.toPandas()
    d = [f"d{k}" for k in range(4)]
    want = set()
    for q, qs in a.groupby("id"):
        for m, ms in b.groupby("id"):
            distance = sum(np.bitwise_count(qs[c].to_numpy()[:, None] ^ ms[c].to_numpy()[None]).astype(int) for c in d)
            i, j = np.nonzero(distance <= op6_media.MAX_DISTANCE)
            if len(i) >= op6_media.MIN_INLIERS and op6_media.consensus(qs.iloc[i][["x", "y", "angle", "scale"]].to_numpy(float), ms.iloc[j][["x", "y", "angle", "scale"]].to_numpy(float))[0] >= op6_media.MIN_INLIERS:
                want.add((q, m))
    assert len(got & want) / len(want) >= 0.9


def test_meetings_of_corners_stay_in_their_task(spark, monkeypatch):
    """A join made a row of every two corners that look alike: 25 times as many on five times the images."""
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id < 60").selectExpr("vec_id AS id", "vec_id AS seed", "embedding")
    index = op6_media.describe(op6_media.render(vectors)).cache()
    queries = op6_media.describe(op6_media.render(vectors.where("id < 8"), edited=True)).cache()
    found = op6_media.match(queries, index)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "bit_count" not in plan
    whole = {(r.query_id, r.match_id): r for r in found.collect()}
    a, b = queries.toPandas(), index.toPandas()
    words = lambda rows: rows[[f"d{k}" for k in range(4)]].to_numpy().view(np.uint64)
    for q, qs in a.groupby("id"):  # meetings by comparing each corner with each
        ms = b[b.id == q]
        x = words(qs)[:, None] ^ words(ms)[None]
        meets = np.zeros(x.shape[:2], bool)
        for k in range(op6_media.PARTS):
            certain = np.array([0xFFFFFFFF & ~sum(w[op6_media.WEAK * k : op6_media.WEAK * (k + 1)]) for w in qs.weak], np.uint64)
            meets |= (x[..., k // 2] >> np.uint64(0 if k % 2 else 32)) & certain[:, None] == 0
        assert whole[q, q].n_matches == (meets & (np.bitwise_count(x).sum(2, dtype=int) <= op6_media.MAX_DISTANCE)).sum()
    monkeypatch.setattr(op6_media, "IMAGES", 7)
    monkeypatch.setattr(op6_media, "QUERIES", 3)
    assert {(r.query_id, r.match_id): r for r in op6_media.match(queries, index).collect()} == whole


def test_corners_are_looked_up_some_images_at_a_time(monkeypatch):
    r = np.random.RandomState(6)
    m = r.randint(0, 2**63, (400, 4)).astype(np.uint64)
    m[100:200] = m[:100]
    q, image, weak = m[:50] ^ np.uint64(1), np.repeat(np.arange(40), 10), np.tile(np.arange(4), (50, 8))
    tables = op6_media._tables(q, weak)
    whole = list(op6_media._meetings(q, m, tables, image))
    monkeypatch.setattr(op6_media, "MET", 30)
    some = list(op6_media._meetings(q, m, tables, image))
    assert len(whole) == 1 and len(some) > 10
    pairs = lambda found: {(int(x), int(y)) for a, b in found for x, y in zip(a, b)}
    assert pairs(some) == pairs(whole) == {(i, j) for i in range(50) for j in (i, 100 + i)}


def test_images_that_meet_too_seldom_cost_no_pass_of_their_own(monkeypatch):
    """Every pair of images was split off, and of those with five meetings each went through the consensus; most have none."""
    import pyarrow as pa

    def described(images):
        image, x, y, angle, scale, bits, weak = op6_media.describe_stack(np.stack(images).astype(np.float32))
        turn = np.rint((angle + np.pi) * (op6_media.TURNS / (2 * np.pi))).astype(np.int64)
        place = x << 42 | y << 20 | turn << 6 | np.rint(scale * 10).astype(np.int64)
        return image, place, bits.view(">i8").astype(np.int64).reshape(-1, 4), weak

    fields, r = op6_media._fields(), np.random.RandomState(0)
    drawn = [op6_media.read_image(op6_media._drawn(v, fields)) for v in r.normal(size=(120, 64)).tolist()]
    edited = [op6_media._edited(im, i) for i, im in enumerate(drawn[:30])]
    (image, mplace, m, _), (owner, qplace, q, weak) = described(drawn), described(edited)
    index = pa.table({"id": pa.array(image), "place": pa.array(mplace), **{f"d{k}": pa.array(m[:, k].copy()) for k in range(4)}})
    corners = [[{"place": int(qplace[i]), **{f"d{k}": int(q[i, k]) for k in range(4)}, "weak": np.log2(weak[i]).astype(int).tolist()} for i in np.flatnonzero(owner == o)] for o in range(30)]
    kind = pa.list_(pa.struct([("place", pa.int64()), *((f"d{k}", pa.int64()) for k in range(4)), ("weak", pa.list_(pa.int8()))]))
    # meetings by comparing each corner with each, and the consensus of every pair of images
    x = q.view(np.uint64)[:, None] ^ m.view(np.uint64)[None]
    meets = np.zeros(x.shape[:2], bool)
    for k in range(op6_media.PARTS):
        certain = (0xFFFFFFFF & ~weak[:, op6_media.WEAK * k : op6_media.WEAK * (k + 1)].sum(1)).astype(np.uint64)
        meets |= (x[..., k // 2] >> np.uint64(0 if k % 2 else 32)) & certain[:, None] == 0
    a, b = np.nonzero(meets & (np.bitwise_count(x).sum(2, dtype=int) <= op6_media.MAX_DISTANCE))
    want, several = [], 0
    for pair in np.unique(owner[a] * 120 + image[b]).tolist():
        own = owner[a] * 120 + image[b] == pair
        if own.sum() >= op6_media.MIN_INLIERS:
            several += 1
            v = np.unique(np.stack((qplace[a[own]], mplace[b[own]]), axis=1), axis=0)
            n, moved = op6_media.consensus(op6_media._placed(v[:, 0]), op6_media._placed(v[:, 1]))
            if n >= op6_media.MIN_INLIERS:
                want.append((*divmod(pair, 120), len(v), n, *moved))
    asked, plain = [], op6_media.consensus
    monkeypatch.setattr(op6_media, "consensus", lambda *v: asked.append(v) or plain(*v))
    got = op6_media._matched(index, pa.table({"id": pa.array(range(30)), "corners": pa.array(corners, kind)})).to_pylist()
    assert sorted(tuple(r.values()) for r in got) == sorted(want) and len(want) >= 27
    assert len(want) <= len(asked) < len(want) + (several - len(want)) / 2


def test_images_without_corners():
    """Where no image of a size had a corner, the size of what is weak couldn't be told."""
    found = op6_media.describe_stack(np.full((3, 60, 60), 7, np.float32))
    assert [len(c) for c in found] == [0] * 7 and found[6].shape == (0, op6_media.PARTS * op6_media.WEAK)


def test_images_odd(spark, given):
    v = [float(x) for x in np.random.RandomState(1).normal(size=64)]
    rows = [(0, v, 1), (1, v, 1), (1, v, 1), (None, v, 1), (2, None, 1), (3, [0.0] * 64, 1), (4, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    given(op6_media, embeddings=df)
    got = op6_media.op6_media(spark, "").collect()
    assert sum(r.kind == "member" for r in got) == len(rows) and {(r.id, r.class_id) for r in got if r.kind == "match"} == {(0, 0)}
    given(op6_media, embeddings=df.limit(0))
    assert op6_media.op6_media(spark, "").count() == 0


def test_images_are_drawn_and_hashed_a_few_at_a_time(monkeypatch):
    """A batch of vectors is 36 times smaller than its pictures; workers never hold those of a whole batch."""
    import pyarrow as pa

    rows = np.random.RandomState(3).normal(size=(700, 64)).astype(np.float32).tolist()
    batch = pa.RecordBatch.from_pydict({c: list(range(700)) for c in ("id", "seed", "vec_id")} | {"embedding": rows})

    class Frame:
        select = lambda self, *_: self

    monkeypatch.setattr(op6_media, "map_arrow", lambda df, run, schema: list(run(iter([batch]))))
    monkeypatch.setattr(op6_media.F, "col", lambda name: type("C", (), {"cast": lambda s, t: s, "alias": lambda s, n: s})())
    fields = op6_media._fields()
    drawn, sums = op6_media.render(Frame()), op6_media.hashed(Frame())
    assert max(b.num_rows for b in drawn) <= 256 and max(b.num_rows for b in sums) <= 256
    assert [i for b in drawn for i in b.column("id").to_pylist()] == [i for b in sums for i in b.column("id").to_pylist()] == list(range(700))
    assert all(b.column("image")[k].as_py() == op6_media._drawn(rows[b.column("id")[k].as_py()], fields) for b in drawn for k in (0, b.num_rows - 1))


def test_images_of_one_id_are_told_by_their_hash(spark, given):
    a, b, c = ([float(x) for x in np.random.RandomState(i).normal(size=64)] for i in (1, 2, 3))
    rows = [(5, a), (5, b), (100, b), (200, a), (None, c), (None, c), (300, a), (300, c)]
    given(op6_media, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = op6_media.op6_media(spark, "").collect()
    image = {r.id: r.sha for r in got if r.kind == "member" and r.id in (100, 200)}
    assert image[100] != image[200]
    found = {(r.id, r.sha, r.class_id) for r in got if r.kind == "match" and r.sha == r.class_sha}
    assert {(100, image[100], 5), (200, image[200], 5), (300, image[200], 5)} <= found
    assert {r.class_id for r in got if r.kind == "match" and r.id == 300} == {5, 300}  # the image of null ids shares a class with 300


def test_image_formats():
    import struct
    import zlib

    image = np.random.RandomState(0).randint(0, 256, (20, 30)).astype(np.uint8)
    assert (op6_media.read_image(op6_media.write_pgm(image)) == image).all()
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    lines = b"".join(bytes([1]) + np.diff(row.astype(int), prepend=0).astype(np.uint8).tobytes() for row in image)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 30, 20, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (op6_media.read_image(png) == image).all()
    assert op6_media.read_image(b"P5 broken") is None and op6_media.read_image(None) is None and op6_media.read_image(png[:40]) is None
