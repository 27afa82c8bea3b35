"""The order of shingles in the search for similar texts."""
import numpy as np
from pyspark.sql import functions as F

from haploweave.llm import overlap


def test_frequent_shingles_stay_out_of_prefixes_as_the_table_grows(spark):
    # A passage in one text of fifty is known as frequent however few texts the sample has at least, so it makes no pairs.
    rng = np.random.default_rng(5)
    own = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    passage = own(20)
    texts = [own(30) + (f" {passage} " if i % 50 == 0 else " ") + own(30) for i in range(6000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = overlap.prefixes(overlap.keyed(docs, "text"), 5, 0.8, order_rows=16)
    assert rows.select(F.countDistinct("key")).first()[0] == 6000
    assert rows.groupBy("token").count().filter("count > 1").count() == 0


def test_copies_of_one_text_that_are_too_unlike_meet_at_few_shingles(spark, monkeypatch):
    # Half of the copies are like the text, half too unlike: these make no rows by the square. The links are brute force's.
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 10**9, 150)]

    def copy(words, k, n):
        words = list(words)
        for at in np.linspace(3, 140, n).astype(int) + rng.integers(0, 5):
            words[at] = f"c{k}x{at}"
        return words

    texts = [base] + [copy(base, k, 2) for k in range(150)] + [copy(base, 1000 + k, 5) for k in range(150)]
    texts += [copy(t, 2000 + k, 1) for k, t in enumerate(texts[-20:])]  # like an unlike copy, and no other
    sets = [overlap.shingles_of(" ".join(t).encode(), 5) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    assert len(set(root)) == 151
    rows, joined = [], overlap.joined

    def counted(*args, label=False, **more):
        out = joined(*args, label=label, **more)
        if label:
            rows.append(out.count())
        return out

    monkeypatch.setattr(overlap, "joined", counted)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    keyed = overlap.keyed(docs, "text")
    label = {r.node: r.root for r in overlap.similar_components(keyed, 5, 0.8).collect()}
    at = {r.text: r.key for r in keyed.collect()}
    found = [label.get(at[" ".join(t)], at[" ".join(t)]) for t in texts]
    assert len(set(zip(found, root))) == len(set(root)) == len(set(found))
    assert len(rows) == 1 and rows[0] < 10 * len(texts)
