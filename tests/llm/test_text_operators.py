"""Operators on documents against brute force, on a fixture with nulls, ties, repeated rows and clashing columns."""
import hashlib
import math
import zlib
from array import array
from collections import Counter

import public_tokenizers
import pytest
import xxhash

from haploweave.llm import bpe, common, exact_dedup, lm, mixing, simhash
from haploweave.llm.queries import Digest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, len long, fp string, block int, kept string"
WORDS = "alpha beta gamma delta Epsilon zeta éta thêta".split()


def sample_rows():
    long = " ".join(WORDS[(i * i + 3 * i) % 8] for i in range(5000))
    texts = ["", None, "one", "One", "a b", "  a\tb \n", "A B C d", "a b c d", long, long, long.upper(), "x" * 3000, "it's 12 !? é", None, " "]
    texts += [" ".join(WORDS[(i * k) % 8] for i in range(3, 12)) for k in range(1, 12)]
    rows = [(i, t, "en", [None, "a", "b", "a", "Z"][i % 5], 0 if t is None else len(t), 7, "x", 1, "y") for i, t in enumerate(texts)]
    rows.append((None, "no id", "en", None, 5, 7, "x", 1, "y"))
    rows += [rows[3], rows[8]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample_rows(), SCHEMA).repartition(3)


def plain(text):
    return (text or "").encode().lower().decode()


def test_exact_dedup(docs):
    rows = sample_rows()
    groups = {}
    for r in rows:
        groups.setdefault(plain(r[1]), []).append(r[0])
    want = Counter()
    for r in rows:
        ids = groups[plain(r[1])]
        keep = max((i for i in ids if i is not None), default=None)
        want[(r[0], keep, len(ids), r[0] == keep, hashlib.sha256(plain(r[1]).encode()).hexdigest())] += 1
    assert Counter(map(tuple, exact_dedup.report(docs).collect())) == want
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert Counter(plain(r["text"]) for r in kept.collect()) == Counter(set(groups))
    assert exact_dedup.report(docs.limit(0)).count() == 0


def test_exact_dedup_passes_any_column_on(docs):
    from pyspark.sql import functions as F

    names = ["__sha", "sha", "len", "row", "id", "raw", "maybe", "key", "bits", "word", "a.b"]
    wide = docs.select("*", *[F.col("doc_id").cast("string").alias(n) for n in names if n not in docs.columns])
    found = exact_dedup.exact_dedup(wide)
    assert found.columns == wide.columns
    rows = found.collect()
    assert rows and all(r[n] == (None if r.doc_id is None else str(r.doc_id)) for r in rows for n in names if n not in docs.columns)


def test_exact_dedup_with_a_full_filter(docs, monkeypatch):
    """A bit map of one word has a false hit for every row; nothing but work changes."""
    want = Counter(map(str, exact_dedup.report(docs).collect()))
    kept = Counter(r.text for r in exact_dedup.exact_dedup(docs).collect())
    monkeypatch.setattr(common, "FILTER_WORDS", 1)
    assert Counter(map(str, exact_dedup.report(docs).collect())) == want
    assert Counter(r.text for r in exact_dedup.exact_dedup(docs).collect()) == kept


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(docs):
    rows = sample_rows()
    fps = [slow_fingerprint(r[1]) for r in rows]
    reach = list(range(len(rows)))
    for _ in rows:
        reach = [min(reach[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(rows))]
    least = {}
    for c, r in zip(reach, rows):
        least[c] = min((x for x in (least.get(c), r[0]) if x is not None), default=None)
    found = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp[0] & (2**64 - 1), r.component_id) for r in found) == Counter((r[0], f, least[c]) for r, f, c in zip(rows, fps, reach))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(least.values()) | {None}


def test_links_match_brute_force(spark):
    """Small shards, blocks and leaves: every way through the trees; clusters of fingerprints a few bits apart."""
    import random

    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(1500)}
    for base in list(fps)[:60]:
        for _ in range(r.randint(1, 25)):
            for _ in range(r.randint(1, 5)):
                base ^= 1 << r.randrange(64)
            fps.add(base)
    fps = sorted(fps)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    nodes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, [f - 2**64 if f >= 2**63 else f]) for f in fps], "node long, fp array<long>")
    links = simhash.links(nodes, sample_rows=500, shard_rows=100, block_rows=64, leaf_rows=16)
    got = {f: f for f in fps}

    def root(x):
        while got[x] != x:
            x = got[x]
        return x

    for e in links.collect():
        a, b = root(e.a % 2**64), root(e.b % 2**64)
        got[max(a, b)] = min(a, b)
    assert {f: root(f) for f in fps} == {f: find(f) for f in fps}


def test_lm_scores(docs):
    rows = sample_rows()
    order, prior, share = 3, 4.0, 2.0

    def tokens(r):
        return [w.decode() for w in (r[1] or "").encode().lower().split()] + ["</s>"]

    out = lambda r: zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 == 2
    counts, histories = Counter(), Counter()
    for r in rows:
        if not out(r):
            t = ["<s>"] + tokens(r)
            for i in range(1, len(t)):
                for k in range(order):
                    if i - k >= 0:
                        counts[tuple(t[i - k : i + 1])] += 1
                        if k:
                            histories[tuple(t[i - k : i])] += 1
    total = sum(n for g, n in counts.items() if len(g) == 1)
    distinct = sum(1 for g in counts if len(g) == 1)

    new = {k: sum(len(g) == k for g in counts) / sum(n for g, n in counts.items() if len(g) == k) for k in (2, 3)}  # of those met, the part that is new

    def p(g):
        if len(g) == 1:
            return (counts[g] + 1) / (total + distinct + 1)
        if not histories[g[:-1]]:
            return p(g[1:])
        k = prior + share * new[len(g)] * histories[g[:-1]]
        return (counts[g] + k * p(g[1:])) / (histories[g[:-1]] + k)

    want = {}
    for r in rows:
        t = ["<s>"] + tokens(r)
        base = sum(math.log10(p((w,))) for w in t[1:])
        model = sum(math.log10(p(tuple(t[max(0, i - order + 1) : i + 1]))) for i in range(1, len(t)))
        want[r[0]] = (out(r), len(t) - 1, sum(counts[(w,)] > 0 for w in t[1:]), total, base, model)
    got = lm.score(docs, order=order, prior=prior, share=share, at_once=7).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert tuple(r)[5:] == pytest.approx(want[r.doc_id][4:])
    words = sorted({w for r in rows for w in tokens(r)})
    known = [w for w in words if counts[(w,)]]
    assert sum(p(("alpha", w)) for w in known) + p(("alpha", "?")) == pytest.approx(1)  # a word that was never seen has the rest
    assert lm.score(docs.limit(0)).count() == 0


def brute_mix(keyed, weights=(1.0, 2.0, 3.0), most=3.0):
    """[(source, size, target, taken, positions)] of rows (source, size, key), one document after another."""
    sources = sorted({s for s, _, _ in keyed if s is not None}, key=str.encode) + [None] * any(s is None for s, _, _ in keyed)
    total = Counter()
    for s, n, _ in keyed:
        total[s] += n
    weight = {s: weights[i % 3] * 1.0 for i, s in enumerate(sources)}  # every curve of the curriculum covers an area of 1
    target = mixing.share_out({s: total[s] for s in sources}, weight, sum(total.values()), most)
    out = []
    for i, s in enumerate(sources):
        order = sorted((k, n) for t, n, k in keyed if t == s)
        demand, at = round(target[s]), 0
        taken, places = [0] * len(order), [[] for _ in order]
        for epoch in range(4):
            for j, (_, n) in enumerate(order):
                words = min(n, demand - at)
                if words > 0 or (n == 0 and total[s] and (epoch + 1) * total[s] <= demand):
                    part = at / demand
                    places[j].append([1 - math.sqrt(max(0.0, 1 - part)), part, math.sqrt(part)][i % 3])
                    taken[j] += words
                at += words if total[s] else 0
        out += [(s, n, target[s], t, p) for (_, n), t, p in zip(order, taken, places)]
    return out


def test_mixing(spark, docs):
    rows = sample_rows()
    size = lambda t: len((t or "").encode().split())
    total = Counter()
    for r in rows:
        total[r[3]] += size(r[1])
    planned = mixing.ordered(docs).collect()
    assert len(planned) == len(rows)
    hashed = [c for c, t in docs.dtypes if t in ("bigint", "int", "string")]
    digest = lambda r: int(hashlib.md5("\x1f".join(str(r[c]) for c in hashed if r[c] is not None).encode()).hexdigest()[:15], 16)
    keyed = [(r["source"], size(r["text"]), digest(r)) for r in docs.collect()]
    want = sorted(brute_mix(keyed), key=lambda w: (str(w[0]), w[1], w[3], w[4]))
    got = sorted(((r.source, r["size"], r.target, r.taken, r.positions) for r in planned), key=lambda w: (str(w[0]), w[1], w[3], w[4]))
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], abs=1e-9)
    for r in planned:
        assert r["size"] == size(r.row.text) and r["source_size"] == total[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
    again = mixing.ordered(docs.repartition(2)).collect()
    assert Counter(map(str, again)) == Counter(map(str, planned))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")  # neither order nor quota depends on the session
        assert Counter(map(str, mixing.ordered(docs).collect())) == Counter(map(str, planned))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    mixed = mixing.mix(docs, length_col="n_chars")
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += size(r["text"])
    taken = Counter()
    for r in planned:
        taken[r.source] += r.taken
    assert words == +taken
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_passes_any_column_on(docs):
    from pyspark.sql import functions as F

    names = ["s", "of", "size", "row", "__size", "range", "position", "words", "demand", "key", "a.b"]
    wide = docs.select("*", *[F.col("doc_id").cast("string").alias(n) for n in names if n not in docs.columns])
    rows = mixing.mix(wide).collect()
    assert rows and all(r[n] == (None if r.doc_id is None else str(r.doc_id)) for r in rows for n in names if n not in docs.columns)


def test_share_out():
    assert mixing.share_out({"a": 10, "b": 90, None: 0}, {"a": 3, "b": 1, None: 2}, 100) == {"a": 30, "b": 70, None: 0}


def test_schedule_inverse(spark):
    s = mixing.Schedule((0.0, 1.0, 3.0, 0.0))
    from pyspark.sql import functions as F

    for row in spark.range(21).select((F.col("id") / 20).alias("p"), s.inverse(F.col("id") / 20).alias("t")).collect():
        steps = 30000
        xs = [(i + 0.5) / steps * row.t for i in range(steps)]
        w = lambda x: (lambda i, f: s.knots[i] * (1 - f) + s.knots[min(i + 1, 3)] * f)(min(int(x * 3), 2), x * 3 - min(int(x * 3), 2))
        assert sum(map(w, xs)) * row.t / steps == pytest.approx(row.p * s.integral(), abs=1e-3)


PATH = public_tokenizers.path("word_bpe_49k.json")


def test_bpe_round_trip(docs):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(PATH)
    found = bpe.transcode(docs, PATH, Digest, "n_tokens long, ids_sha256 string, decoded_sha256 string, bytes_sha256 string", joined=True).collect()
    v = bpe.Vocabulary.load(PATH)
    for r in found:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        text = "".join(w + " " for w in v.wide.findall(bpe.normal(r["text"] or "")))
        if "<|" not in text:
            assert r.bytes_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("text", ["qwertzuiop" * 20000, "ha" * 90000, "!?" * 70000, "日本語" * 40000, "1" * 70000, "ab'cd" * 30000, "é " * 40000, "a<|endoftext|>b" * 9000, "ΑΣ ſ İ ́", "'" * 200_000, "a'b|" * 50_000, "'s''re|'LL" * 20_000, " " * 200_000 + "a", "<|endoftex" * 20_000, "\u1112\u1161\u11ab" * 50_000, "e\u0301\u0327" * 50_000, "1a'" * 60_000])
def test_bpe_pieces_of_long_texts(text):
    tokenizers = pytest.importorskip("tokenizers")
    v = bpe.Vocabulary.load(PATH)
    e, out = bpe.Encoder(v), b""
    for i in range(0, len(text), 50_000):
        out += e.feed(text[i : i + 50_000])
        assert len(e.text) <= 2 * bpe.PIECE and len(e.held) <= 4 * bpe.MARGIN and (e.word is None or len(e.word.held) <= v.window)
    ids = array("I", out + e.finish())
    assert ids.tolist() == tokenizers.Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_decoder_holds_incomplete_sequences():
    v = bpe.Vocabulary.load(PATH)
    ids = array("I", bpe.encode("日本語 żółw", v)).tolist()
    d = bpe.Decoder(v)
    assert "".join(d.feed([i]) for i in ids) + d.finish() == "日本語 żółw "
    d = bpe.Decoder(v)
    assert d.feed([v.first[0xE6]]) == "" and d.finish() == "�"


def test_upper_trees_grow_with_the_table(spark):
    """A small sample parts few shards; their own samples part them further, and home is the same shard on both ways."""
    import numpy as np

    points = np.random.default_rng(8).integers(0, 2**64, 20_000, np.uint64)
    nodes = spark.createDataFrame([(int(p), [int(p)]) for p in points.view(np.int64)], "node long, fp array<long>")
    for t, tree in enumerate(simhash.trees_of(nodes, len(points), 128, 256)):
        halves = simhash.half(points, t)
        row, shard, home = tree.route(halves, 1)
        sizes = np.bincount(shard[home], minlength=tree.shards)
        assert tree.shards >= 40 and sizes.sum() == len(points) and sizes.max() < 2500
        own = np.empty(len(points), int)
        own[row[home]] = shard[home]
        found = set(zip(row.tolist(), shard.tolist()))
        assert len(found) == len(row)
        for bit in range(0, 32, 5):  # a point one bit away lies in a shard that the query reaches
            r, s, h = tree.route(halves ^ np.uint32(1 << bit), 0)
            assert h.all() and all(x in found for x in zip(r.tolist(), s.tolist()))


def test_fingerprints_alike_in_one_half(spark):
    """No boundary parts them by that half: blocks, and trees over the other half."""
    import numpy as np

    r = np.random.default_rng(9)
    low = np.unique(np.concatenate([x := r.integers(0, 2**32, 1500, np.uint64), x[:300] ^ np.uint64(5), x[:40] ^ np.uint64(0x70000)]))
    fps = low | np.uint64(0xABCD << 32)
    nodes = spark.createDataFrame([(int(p), [int(p)]) for p in fps.view(np.int64)], "node long, fp array<long>")
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    plain, got = simhash.Forest(len(fps)), simhash.Forest(len(fps))
    plain.join(*np.nonzero(near))
    place = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    for e in simhash.links(nodes, sample_rows=500, shard_rows=100, block_rows=400, leaf_rows=16).collect():
        got.join(np.array([place[e.a]]), np.array([place[e.b]]))
    a, b = got.flat(), plain.flat()
    assert np.array_equal(a[:, None] == a[None, :], b[:, None] == b[None, :])


def test_near_dedup_passes_any_column_on(docs):
    from pyspark.sql import functions as F

    names = [n for n in ("__kept", "row", "id", "maybe", "word", "bit", "bits", "fp", "root", "component_id", "a.b") if n not in docs.columns]
    wide = docs.select("*", *[F.col("doc_id").cast("string").alias(n) for n in names])
    found = simhash.near_dedup(wide)
    assert found.columns == wide.columns
    rows = found.collect()
    assert rows and all(r[n] == (None if r.doc_id is None else str(r.doc_id)) for r in rows for n in names)


def test_long_fingerprints_find_near_copies(spark):
    """Copies with a few words changed, among texts of chance words: one group each, held against all pairs."""
    import random

    import numpy as np

    r = random.Random(12)
    rows = []
    for g in range(60):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice((60, 200, 400)))]
        for c in range(r.choice((1, 2, 6))):
            own = list(words)
            for _ in range(len(words) // 120 if c else 0):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), g, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, g int, text string")
    length, radius = 16, simhash.bits_apart(0.8, 16)
    fps = np.array([simhash.signature(t.encode(), 5, length=length) for _, _, t in rows])
    near = np.array([np.bitwise_count(fps ^ f).sum(axis=1, dtype=int) for f in fps]) <= radius
    reach = np.arange(len(rows))
    while not np.array_equal(new := np.array([reach[n].min() for n in near]), reach):
        reach = new
    assert simhash.bits_apart(1.0, 16) == 0 and 150 < radius < 180
    for sizes in ({}, {"shard_rows": 40, "sample_rows": 128, "leaf_rows": 8, "block_rows": 50}):
        found = {x.doc_id: x.component_id for x in simhash.near_duplicates(docs, words=5, length=length, radius=radius, **sizes).collect()}
        assert found == dict(enumerate(reach))
    kept = simhash.near_dedup(docs, words=5, length=length, radius=radius)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(reach.tolist()))
