"""The pipeline's stages one after another, against what each has to do with its input."""
import hashlib
import os
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from haploweave.llm import mixing  # noqa: E402
from haploweave.llm.simhash import bits_apart, near_duplicates, shingles_of  # noqa: E402
from haploweave.llm.toxicity import classify  # noqa: E402


def test_stages(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "curriculum_mixing", "bpe_encode_decode"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = [docs.toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
        steps.append(docs.toPandas())
    all_, clean, once, apart, mixed, encoded = steps
    scored = classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), into="p")
    assert set(all_.doc_id) - set(clean.doc_id) == {r.doc_id for r in scored.filter("p.is_toxic").select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert not set(labels.doc_id[labels.toxic == 0]) - set(clean.doc_id)  # known clean rows stay
    lower = lambda t: (t or "").encode().lower()
    keep = {}
    for i, t in zip(clean.doc_id, clean.text):
        keep[lower(t)] = max(i, keep.get(lower(t), i))
    assert set(once.doc_id) == set(keep.values())
    # Against all pairs, by the Jaccard similarity of five-word shingles: what goes has a copy of 0.8 or more, the first of a
    # group stays, and of ten such pairs nine at least lose one.
    sets = [shingles_of((t or "").encode(), 5) for t in once.text]
    near = np.array([[a is b or len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    ids = np.array(once.doc_id)
    gone = ~np.isin(ids, apart.doc_id)
    assert set(apart.doc_id) <= set(ids) and len(apart) == len(set(apart.doc_id))
    reach = ids.copy()
    while not np.array_equal(new := np.array([reach[n].min() for n in near]), reach):
        reach = new
    assert set(reach) <= set(apart.doc_id) and gone.any()
    assert all(near[i].sum() > 1 for i in np.flatnonzero(gone))
    i, j = np.nonzero(np.triu(near, 1))
    assert (gone[i] | gone[j]).sum() >= 0.9 * len(i)
    size = lambda t: len((t or "").encode().split())
    total, taken = Counter(), Counter()
    for s, t in zip(apart.source, apart.text):
        total[s] += size(t)
    for s, t in zip(mixed.source, mixed.text):
        taken[s] += size(t)
    target = mixing.share_out(total, mixing.source_weights(list(total)), sum(total.values()))
    assert all(abs(taken[s] - target[s]) <= 1 for s in total)
    assert len(encoded) == len(mixed)
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in zip(mixed.doc_id, mixed.text):
        ids_ = library.encode(t or "", add_special_tokens=False).ids
        want[(i, tuple(ids_), hashlib.sha256(library.decode(ids_, skip_special_tokens=False).encode()).hexdigest())] += 1
    got = Counter((i, tuple(x), d) for i, x, d in zip(encoded.doc_id, encoded.ids, encoded.decoded_sha256))
    assert got == want
    assert all(hashlib.sha256(array("I", x).tobytes()).hexdigest() == h for x, h in zip(encoded.ids, encoded.ids_sha256))
    whole = corpus_pipeline.run(spark, SF).toPandas()
    assert Counter(zip(whole.doc_id, whole.ids_sha256)) == Counter(zip(encoded.doc_id, encoded.ids_sha256))


def test_near_copies_of_one_text_that_are_unlike_each_other(spark):
    """Copies with six words of 300 changed are 0.81 like the text, and 0.66 like each other: a link goes to the text or nowhere."""
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = [(0, " ".join(base))]
    for k in range(1, 301):
        words = list(base)
        for at in rng.choice(300, 6, replace=False):
            words[at] = f"x{k}y{at}"
        rows.append((k, " ".join(words)))
    rows += [(k, " ".join(f"w{x}" for x in rng.integers(0, 5000, 300))) for k in range(301, 601)]
    sets = {k: shingles_of(t.encode(), 5) for k, t in rows}
    like = [k for k in range(1, 301) if len(sets[0] & sets[k]) >= 0.8 * len(sets[0] | sets[k])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_duplicates(docs, words=5, length=16, radius=bits_apart(0.8, 16, 2.5), similarity=0.8).collect()}
    assert len(like) > 250 and sum(found[k] == 0 for k in like) >= 0.9 * len(like)
    assert all(found[k] == k for k in set(found) - set(like) - {0})


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls in any column, empty, blank and very long texts, rows that repeat, an id with two texts, columns with other
    meanings of names that the stages use; and no rows at all."""
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, 1), (4, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(i, f"text number {i} of {i * i} words and {'idiot' if i % 7 == 0 else 'more'}", "ab"[i % 2], 30) for i in range(40)]
    rows += [(None, None, None, None), (None, "", "a", 0), (None, "no id here", None, None), (50, None, "b", None), (51, "  \t ", "b", 4), (52, long, "a", len(long)), (53, long.upper(), "a", len(long))]
    rows += [(54, "row that repeats", "b", 16)] * 5 + [(55, "one id", "a", 6), (55, "two texts", "a", 9), (56, "x", "\u00e9\ud7ff", 1)]
    names = ["row", "scores", "key", "sha", "file", "place", "position", "maybe", "__scores", "id"]
    docs = spark.createDataFrame([(*r, *[f"{n}-{k}" if k % 5 else None for n in names]) for k, r in enumerate(rows)], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    whole = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0 if k < 4 else True
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k == 0:  # what stays is as it was
            assert not Counter(map(str, docs.collect())) - Counter(map(str, whole.collect()))
            assert docs.filter("text IS NULL").count() == 2
        if k == 1:
            texts = [(r.text or "").lower() for r in docs.collect()]
            assert len(texts) == len(set(texts)) and long in texts
            assert docs.filter("doc_id = 53").count() == 1 and docs.filter("doc_id = 52").count() == 0 and docs.filter("doc_id = 50").count() + docs.filter("doc_id IS NULL AND text = ''").count() == 1
        if k < 4:
            assert docs.columns == whole.columns
            kept = {(r.doc_id, tuple(r[n] for n in names)) for r in docs.collect()}
            assert kept <= {(r.doc_id, tuple(r[n] for n in names)) for r in whole.collect()}
    assert docs.columns == ["doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "bytes_sha256", "position"]
    assert docs.filter("n_tokens > 50000").count() >= 1
    empty = whole.limit(0)
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from haploweave.llm import common

    empty = SimpleNamespace(isEmpty=lambda: True)
    sc = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: empty, isLocal=lambda: False)), getConf=lambda: SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError):
        common.shared_folder(SimpleNamespace(sparkContext=sc))


def test_near_copies_are_all_found(spark):
    """All copies with six words of 300 changed, 0.81 like the text that they are of and 0.66 like each other, and chains of
    copies, whatever the fingerprints tell; against brute force."""
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = [(0, " ".join(base)), (1000, None), (1001, " \t"), (1002, "two words"), (1003, "Two  words")]
    for k in range(1, 301):
        words = list(base)
        for at in rng.choice(300, 6, replace=False):
            words[at] = f"x{k}y{at}"
        rows.append((k, " ".join(words)))
    for chain in range(40):  # each a few words on from the one before
        words = [f"v{x}" for x in rng.integers(0, 300, 60)]
        for step in range(5):
            rows.append((301 + chain * 5 + step, " ".join(words)))
            words = words[:30] + [f"u{chain}s{step}"] + words[30 + step % 2 :] if step % 2 else words[1:]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets, root = {k: shingles_of((t or "").encode(), 5) for k, t in rows}, {k: k for k, _ in rows}
    ids = sorted(root)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root |= {k: lo for k, r in root.items() if r == hi}
    assert len(set(root.values())) < 250
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, words=5, similarity=0.8).collect()} == root
    copies = corpus_pipeline.near_copies(spark, docs, SF)
    assert {r.doc_id for r in copies.collect()} == set(root.values())
