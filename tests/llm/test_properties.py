"""Properties over generated inputs."""
from array import array

import numpy as np
import public_tokenizers
import pytest

hypothesis = pytest.importorskip("hypothesis")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from haploweave.llm import bpe, lm, mixing, simhash, warc  # noqa: E402
from haploweave.llm.common import even_labels  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
tokenizers = pytest.importorskip("tokenizers")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
COMMON = settings(deadline=None, max_examples=200)


@COMMON
@given(st.text(max_size=200))
def test_bpe_equals_the_library(text):
    ids = array("I", bpe.encode(text, bpe.Vocabulary.load(PATH))).tolist()
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    d = bpe.Decoder(bpe.Vocabulary.load(PATH), joined=True)
    assert d.feed(ids[: len(ids) // 2]) + d.feed(ids[len(ids) // 2 :]) + d.finish() == LIBRARY.decode(ids, skip_special_tokens=False)


@COMMON
@given(st.text(alphabet="abcdehinorst", min_size=1, max_size=2000), st.integers(1, 500))
def test_word_transducer_emits_only_final_ids(word, step):
    v = bpe.Vocabulary.load(PATH)
    w, out = bpe.Word(v), []
    for i in range(0, len(word), step):
        out += w.feed(word[i : i + step].encode())
    assert out + w.finish() == LIBRARY.encode(word, add_special_tokens=False).ids


@COMMON
@given(st.sets(st.integers(0, 2**64 - 1), max_size=80))
def test_packed_keys(keys):
    keys = np.array(sorted(keys), np.uint64)
    assert np.array_equal(lm.unpack_keys(lm.pack_keys(keys), len(keys)), keys)


@COMMON
@given(st.lists(st.integers(0, 2**40), max_size=50))
def test_packed_counts(n):
    n = np.array(n, np.int64)
    assert np.array_equal(lm.unpack(lm.pack(n)), n)


@COMMON
@given(st.dictionaries(st.text(max_size=3), st.integers(0, 1000), min_size=1, max_size=8))
def test_targets_add_up(sizes):
    total = sum(sizes.values())
    target = mixing.share_out(sizes, mixing.source_weights(list(sizes)), total)
    assert sum(target.values()) == pytest.approx(total) and all(t <= 3 * sizes[s] + 1e-6 for s, t in target.items())


@COMMON
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=60, unique=True), st.integers(0, 63), st.integers(1, 12))
def test_trees_lose_no_pair(points, bit, leaf):
    points = np.array(sorted({*points, *(p ^ (1 << bit) for p in points)}), np.uint64)
    linked = simhash.Forest(len(points))
    every = np.arange(len(points))
    for t in (0, 1):
        halves = simhash.half(points, t)
        near = simhash.Nearness(points[:, None], halves, 1, 3, 1)
        simhash.search(every, every, halves, 1, linked, leaf, near, simhash.half(points, 1 - t))
    plain = simhash.Forest(len(points))
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    plain.join(*np.nonzero(near))
    a, b = linked.flat(), plain.flat()
    assert np.array_equal(a[:, None] == a[None, :], b[:, None] == b[None, :])


@COMMON
@given(st.lists(st.integers(0, 2**24 - 1), min_size=2, max_size=80, unique=True), st.integers(1, 9))
def test_balls_lose_no_pair(points, leaf):
    """All alike in the tree's half: joined through the ball's centre or compared."""
    points = np.array(sorted(points), np.uint64)
    linked, plain = simhash.Forest(len(points)), simhash.Forest(len(points))
    every, halves = np.arange(len(points)), np.full(len(points), 7, np.uint32)
    simhash.search(every, every, halves, 1, linked, leaf, simhash.Nearness(points[:, None], halves, 1, 4, 1))
    plain.join(*np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 4))
    a, b = linked.flat(), plain.flat()
    assert np.array_equal(a[:, None] == a[None, :], b[:, None] == b[None, :])
    assert all(np.bitwise_count(points[i] ^ points[j]) <= 4 for i, j in linked.pairs)


@COMMON
@given(st.text(alphabet="<>/!-ab \"'&;p=scriptbody\n", max_size=120))
def test_markup_never_fails(page):
    text, _ = warc.plain_text(page)
    assert text == text.strip()


def test_labels_are_even(spark):
    from pyspark.sql import functions as F

    labels = even_labels(spark, 37)
    parts = spark.createDataFrame([(x,) for x in labels], "x int").select(F.pmod(F.hash("x"), F.lit(37)).alias("p"))
    assert parts.distinct().count() == 37 == len(set(labels))


@pytest.mark.parametrize("before", [":", "a", "1"])
def test_bpe_equals_the_library_on_every_code_point(before):
    v, step = bpe.Vocabulary.load(PATH), 512
    for low in range(0, 0x110000, step):
        text = " ".join(before + chr(c) for c in range(low, low + step) if not 0xD800 <= c < 0xE000)
        assert array("I", bpe.encode(text, v)).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, hex(low)


@COMMON
@given(st.integers(2, 12), st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11), st.integers(0, 60)), max_size=60), st.sampled_from([0, 5, 1000]))
def test_forest_of_least_distances(n, pairs, most):
    """For each limit of distance, the pairs kept connect what all pairs connect."""
    pairs = [(a % n, b % n, d) for a, b, d in pairs]
    forest = simhash.Shortest(n, most)
    for at in range(0, len(pairs), 7):
        some = np.array(pairs[at : at + 7]).reshape(-1, 3)
        forest.near(some[:, 0], some[:, 1], some[:, 2])
    kept = forest.boiled()
    assert len(kept) < n

    def groups(rows, limit):
        root = list(range(n))
        for a, b, d in rows:
            if d <= limit:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    for limit in range(61):
        assert groups(kept.tolist(), limit) == groups(pairs, limit)
