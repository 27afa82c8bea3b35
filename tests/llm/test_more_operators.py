"""WARC derivatives, classifiers, resampling, sharding and search against brute force, with nulls, ties and odd rows."""
import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from haploweave.llm import resampling, sharding, topk, toxicity, warc

PAGES = "page_id long, url string, html string, block string, record_type string"


def page_rows():
    html = '<html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- x --><script>var t="</p>";</script><p class="a>b">One<br>two &eacute;&#8364;</p><div>three</div></body></html>'
    return [
        (1, "http://a/1", html, "x", "y"), (2, None, "plain", "x", "y"), (3, "http://a/3", None, "x", "y"), (4, "", "", "x", "y"), (None, "http://a/5", "<p>unclosed <b", "x", "y"),
        (6, "http://a/6", "<script>never closed <p>", "x", "y"), (7, "http://a/7", "İ <TITLE>t</TITLE> <p>" + "w " * 50_000, "x", "y"), (1, "http://a/1", html, "x", "y"), (8, "u", "<!-- open", "x", "y"), (9, "u", '<a href="x>y', "x", "y"),
    ]


def test_plain_text():
    assert warc.plain_text(page_rows()[0][2]) == ("One\ntwo é€\nthree", "A & B")
    assert warc.plain_text("a < b and c > d") == ("a < b and c > d", "")
    assert warc.plain_text("<p>x</p><script>y") == ("x", "")
    assert warc.plain_text("x<!-- y") == ("x", "")
    assert warc.plain_text("") == ("", "")


def test_derivatives(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), PAGES)
    source = warc.responses(pages)
    rows = warc.derive(source, keep=["page"]).collect()
    assert len(rows) == 2 * len(page_rows())
    by = {}
    for r in rows:
        assert r.page.block == "x" and r.page.record_type == "y"
        by.setdefault((r.page.page_id, r.refers_to), {})[r.record_type] = r
        raw = r.block.encode()
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode() and r.content_length == len(raw)
    for pair in by.values():
        m, c = pair["metadata"], pair["conversion"]
        assert m.concurrent_to == c.record_id and c.concurrent_to == m.record_id and m.refers_to == c.refers_to != c.record_id
        assert m.source_payload_digest in m.block and "http-header-content-type: text/html" in m.block and m.refers_to in m.block
    first = next(v for k, v in by.items() if k[0] == 1)
    payload = page_rows()[0][2].encode()
    assert first["metadata"].source_payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert first["conversion"].block == "One\ntwo é€\nthree" and "title: A & B" in first["metadata"].block
    assert next(v for k, v in by.items() if k[0] == 2)["conversion"].target_uri is None
    assert warc.derive(source.limit(0), keep=["page"]).count() == 0
    wide = pages.selectExpr("*", "url AS date", "1 AS headers", "2 AS record_id", "3 AS target_uri", "4 AS page", "5 AS content_length", "6 AS `a.b`")
    again = warc.derive(warc.responses(wide), keep=["page"])
    assert Counter((r.record_type, r.record_id, r.block) for r in again.collect()) == Counter((r.record_type, r.record_id, r.block) for r in rows)
    assert again.select("page.*").columns == wide.columns and again.filter("page.headers <> 1 OR page.content_length <> 5 OR page.`a.b` <> 6").count() == 0
    with pytest.raises(ValueError):
        warc.derive(warc.responses(wide).withColumn("block_digest", F.lit(1)), keep=["block_digest"])
    # Files: write, read again, records are the same.
    records = warc.derive(source)
    warc.write(records, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w/*.gz")).collect()
    assert Counter((r.record_type, r.record_id, bytes(r.block).decode()) for r in back) == Counter((r.record_type, r.record_id, r.block) for r in records.collect())
    assert all(r.headers["WARC-Refers-To"].startswith("<urn:uuid:") for r in back)


def test_source_headers_and_digests_are_kept():
    block = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/plain\r\nX-A: 1\r\n\r\nnot <b>here</b>"
    made = warc.derive_one("<urn:uuid:1>", "http://x", "2020-01-01T00:00:00Z", {"WARC-Payload-Digest": "sha1:KEPT", "WARC-IP-Address": "1.2.3.4"}, block)
    assert [m["record_type"] for m in made] == ["metadata", "conversion"] and made[1]["block"] == "not <b>here</b>"
    assert "http-status: HTTP/1.1 404 Not Found" in made[0]["block"] and "http-header-x-a: 1" in made[0]["block"] and "warc-header-warc-ip-address: 1.2.3.4" in made[0]["block"]
    assert made[1]["source_payload_digest"] == "sha1:KEPT"
    assert len(warc.derive_one("<a>", None, "", {}, b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG")) == 1


def toxic_corpus(n=900):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(400)]
    insults = ["loser", "idiot", "scumbag"]
    rows, labels = [], []
    for i in range(n):
        w = r.choices(words, k=r.randint(5, 80))
        toxic, junk = i % 9 == 0, i % 7 == 0
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(insults) + r.choice(["", ",", "!"]))
        text = " ".join(w)
        rows.append((i, text.upper() + "!!!" if junk else text))
        labels.append((i, 0 if junk else 1, int(toxic)))
    return rows, labels


def test_toxicity_chain(spark):
    rows, labels = toxic_corpus()
    odd = [(10_000, None), (10_001, ""), (None, "an idiot here"), (10_002, "fine words " * 30_000 + "idiot"), (10_002, "fine words " * 30_000 + "idiot")]
    docs = spark.createDataFrame([(i, t, "z", 1.0) for i, t in rows + odd], "doc_id long, text string, scores string, toxic double")
    known = spark.createDataFrame([x for x in labels if x[0] % 5] + [(10_000, 1, 1), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.classify(docs, known, into="p").collect()
    assert len(found) == len(rows) + len(odd)
    truth = {i: (q == 0, t == 1) for i, q, t in labels}
    held = [(truth[r.doc_id], r.p) for r in found if r.doc_id is not None and r.doc_id < 10_000 and r.doc_id % 5 == 0]
    assert np.mean([t[1] == p.is_toxic for t, p in held]) > 0.97
    assert np.mean([t[0] == p.is_low_quality for t, p in held]) > 0.97
    special = {r.doc_id: r.p.toxic for r in found if r.doc_id is None or r.doc_id >= 10_000}
    assert special[None] > 0.5 and special[10_000] == special[10_001] < 0.5
    assert toxicity.classify(docs.limit(0), known, into="p").count() == 0
    none = toxicity.classify(docs, known.limit(0), into="p").agg(F.max("p.toxic")).first()[0]
    assert none < 1e-6  # nothing to learn from: nothing is toxic


def test_chain_feeds_out_of_fold_probabilities(spark):
    """The second model has a weight for the first one's probability, and it matters."""
    rows, labels = toxic_corpus(600)
    both = spark.createDataFrame([(i, t, int(q == 0), int(q == 0)) for (i, t), (_, q, _) in zip(rows, labels)], "doc_id long, text string, a int, b int")
    chain = toxicity.fit(both, ["a", "b"])
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1 and chain.weights[1][-2] > 0.5 and len(chain.thresholds) == 2


def test_resampling(spark):
    rows, labels = toxic_corpus(500)
    docs = spark.createDataFrame([(i, t, True, 1.0) for i, t in rows] + [(None, "null id", True, 1.0), (900, None, True, 1.0), (901, "", True, 1.0), (901, "", True, 1.0)], "doc_id long, text string, kept boolean, key double")
    target = spark.createDataFrame([(i,) for i, q, _ in labels if q == 1], "doc_id long")
    found = resampling.resample(docs, target, k=400).collect()
    assert len(found) == 504 and sum(r.kept for r in found) == 400
    kept, dropped = [r.key for r in found if r.kept], [r.key for r in found if not r.kept]
    assert min(kept) >= max(dropped)
    junk = {i for i, q, _ in labels if q == 0}
    assert sum(r.kept for r in found if r.doc_id in junk) < 0.2 * len(junk)

    # The log weight is the ratio of both hashed models.
    keys, n = resampling.Keys(), 65_536
    f = {i: resampling.features(t.encode() if t else None, keys, 2, n) for i, t in rows}
    goal, raw = np.zeros(n), np.zeros(n)
    for i, q, _ in labels:
        raw += np.bincount(f[i], minlength=n)
        goal += np.bincount(f[i], minlength=n) * (q == 1)
    raw += np.bincount(resampling.features(b"null id", keys, 2, n), minlength=n)
    ratio = np.log((goal + 1) / (goal.sum() + n)) - np.log((raw + 1) / (raw.sum() + n))
    by = {r.doc_id: r for r in found}
    for i, _ in rows[:50]:
        assert by[i].log_weight == pytest.approx(ratio[f[i]].sum()) and by[i].n_features == len(f[i])
    assert by[900].log_weight == 0.0
    # The draw: log weight and Gumbel noise of a hash of id and text, the k largest.
    import xxhash

    drawn = []
    for i, t in [*rows, (None, "null id"), (900, None), (901, ""), (901, "")]:
        u = (xxhash.xxh64_intdigest(f"{i} ".encode() + (t or "").encode(), 1) + 0.5) / 2**64
        x = resampling.features((t or "").encode(), keys, 2, n)
        drawn.append((-(ratio[x].sum() - math.log(-math.log(u))), -1 if i is None else i))
    assert Counter(i for _, i in sorted(drawn)[:400]) == Counter(-1 if r.doc_id is None else r.doc_id for r in found if r.kept)
    again = resampling.resample(docs.repartition(3), target, k=400).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))
    assert resampling.resample(docs.limit(0), target, k=5).count() == 0
    assert resampling.resample(docs, target.limit(0), share=0.5).filter("kept").count() == 252


def test_rows_alike_at_the_threshold(spark):
    """Of rows that repeat id and text as many are kept as k leaves room for, whatever the partitions."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(50, "again")] * 40 + [(None, "")] * 30, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([(1,), (2,)], "doc_id long")
    for k in (1, 17, 35, 52, 71, 89, 90):
        found = resampling.resample(docs, target, k=k).collect()
        assert len(found) == 90 and sum(r.kept for r in found) == k
        assert min(r.key for r in found if r.kept) >= max((r.key for r in found if not r.kept), default=-math.inf)
    keys = np.array(sorted([0.0, -0.0, 1e-300, -1e-300, 5.5, -5.5, 1e18, -1e18, -1e-5, 2**-30]))
    assert (np.diff(resampling.place_of(keys)) >= 0).all() and len(set(resampling.place_of(keys).tolist())) == 9


def test_kth_key(spark):
    r = random.Random(8)
    values = [r.randint(-(2**62), 2**62) for _ in range(300)] + [5] * 40 + [-(2**63), 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "o long")
    order = sorted(values, reverse=True)
    for k in (1, 2, 150, 170, 300, len(values)):
        at, room = resampling.kth_key(df, k)
        assert at == order[k - 1] and room == k - sum(v > at for v in values)
    assert resampling.kth_key(df, len(values) + 1) is None


def test_importance_shift():
    keys = resampling.Keys()
    assert list(resampling.features(b"a b", keys, 2, 100)) == list(resampling.features(b"  A\tB ", keys, 2, 100))
    assert len(resampling.features(None, keys, 2, 100)) == 0 and len(resampling.features(b"a b c", keys, 3, 100)) == 6


def brute_cuts(groups, shards):
    groups = sorted(groups)

    def fill(capacity):
        cuts, held = [], 0
        for key, size in groups:
            if held + size > capacity:
                cuts.append(key)
                held = 0
            held += size
        return cuts

    low, high = max(s for _, s in groups), sum(s for _, s in groups)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if len(fill(mid)) < shards else (mid + 1, high)
    return fill(low)


@pytest.mark.parametrize("n, cells, wide", [(1, 8, 9), (40, 8, 9), (700, 16, 12), (700, 4096, 15), (2000, 64, 4)])
def test_cuts_against_brute_force(spark, n, cells, wide):
    r = random.Random(n + cells)
    groups = [(k, r.choice([8, 60, 900, r.randint(1, 50_000)])) for k in r.sample(range(-(10**wide), 10**wide), n)]
    df = spark.createDataFrame(groups, "key long, size long")
    sizes = lambda cuts: [sum(n for k, n in groups if a <= k < b) for a, b in zip([-math.inf, *cuts], [*cuts, math.inf])]
    cuts, greedy = sharding.cuts_of(df, 7, cells), sizes(brute_cuts(groups, 7))
    assert cuts == sorted(set(cuts) & {k for k, _ in groups}) and len(cuts) == (6 if n >= 700 else len(cuts)) <= n
    even = sizes(cuts)
    assert max(even) <= max(greedy)  # the least capacity, by trying every one that is a sum of neighbours
    if n >= 700:
        assert max(even) - min(even) <= 2 * max(size for _, size in groups)
    assert cuts == sharding.cuts_of(df, 7, 4096)


def test_sharding(spark):
    r = random.Random(2)
    texts = ["", None, None, "é" * 500, "hot copy"] + ["".join(r.choice("abc ") for _ in range(r.randint(0, 300))) for _ in range(250)] + ["hot copy"] * 120
    rows = [(i if i % 50 else None, t, 1, 2, "x") for i, t in enumerate(texts)] + [(7, "repeat", 1, 2, "x"), (7, "repeat", 1, 2, "x"), (7, "other text", 1, 2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, size int, key string").repartition(5)
    found = sharding.shard(docs, 8).collect()
    assert len(found) == len(rows)
    size = lambda t: len((t or "").encode()) + 8
    want = Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in found) == want
    shards, where = {}, {}
    for x in found:
        shards.setdefault(x.shard, []).append(x)
        if x.size > 8:
            where.setdefault((x.text_crc32, x.size), set()).add(x.shard)
    assert all(len(s) == 1 for s in where.values()) and set(shards) <= set(range(8))
    for s in shards.values():
        assert sorted(x.slot for x in s) == list(range(len(s)))
    largest = max(Counter((t or "") for _, t, *_ in rows).items(), key=lambda kv: kv[1] * size(kv[0]))
    totals = {k: sum(x.size for x in v) for k, v in shards.items()}
    assert len(totals) == 8 and max(totals.values()) <= max(largest[1] * size(largest[0]), sum(totals.values()) / 8 + 1100)
    again = sharding.shard(docs.repartition(2), 8).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))
    assert sharding.shard(docs.limit(0)).count() == 0


def brute_top(rows, k, every):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in sorted({(i, tuple(v)) for i, v in good if i % every == 0}):
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return Counter(out)


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 60, "block_rows": 2, "leaf_rows": 8}, {"shard_rows": 20, "sample_rows": 64, "block_rows": 3, "leaf_rows": 4}])
def test_top_k(spark, sizes):
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(400 + i, rows[50][1]) for i in range(15)]  # ties
    rows += [(500, None), (600, [1.0, None, 1.0]), (700, [float("nan")] * 6), (None, [1.0] * 6), (800, [0.5, -0.25]), (900, []), (901, [float("inf")] * 6), (1000, [0.0] * 6), (10, rows[10][1])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    rows = [(x.vec_id, x.embedding) for x in df.collect()]
    found = Counter(map(tuple, topk.top_k(df, every=50, **sizes).collect()))
    assert found == brute_top(rows, 10, 50)
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.filter("vec_id in (50, 51, 52)"), every=50).count() == 2


def test_branches_are_cut():
    """Vectors in tight balls: the search opens few leaves, and a floor from elsewhere closes the shard at its root."""
    r = np.random.default_rng(4)
    points = (r.normal(0, 1, (64, 16))[r.integers(0, 64, 8000)] * 1000 + r.normal(0, 5, (8000, 16))).astype(np.int64)
    ids, tree = np.arange(len(points)), topk.BallTree(points, 32)
    leaves = sum(not kid for kid in tree.kids)
    queries, floors = points[:20], np.full(20, -(2**63))
    found, opened = topk.search(tree, ids, points, ids[:20], queries, floors, 5)
    assert opened < 20 * leaves / 4
    for row in range(20):
        scores = points @ queries[row]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != row)[:5]
        assert [(-s, i) for x, i, s in found if x == row] == want
    assert topk.search(tree, ids, points, ids[:20], queries, np.full(20, 10**9), 5) == ([], 0)


def test_shards_are_balls(spark):
    """Placing follows the vectors, and parts of a shard that can't be split are searched all."""
    r = np.random.default_rng(5)
    points = np.outer(np.repeat(np.arange(8), 125) * 500, np.ones(8, int)) + r.integers(-3, 4, (1000, 8))
    places = topk.Places(points[::5], 8)
    shard = places.place(points)
    assert len(places.centres) == 8 and places.away(points, shard).max() < 40
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(300 + i, [float(i), -1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(map(tuple, topk.top_k(df, every=50, shard_rows=40, leaf_rows=8).collect())) == brute_top(rows, 10, 50)


def test_products_stay_exact():
    big = np.array([[2**40, -(2**40), 3]], np.int64)
    assert topk.products(big, np.array([[2**20, 1, 1]], np.int64))[0, 0] == 2**60 - 2**40 + 3
    assert topk.products(big, big)[0, 0] == 2**63 - 1  # held at the largest long
