"""Periodic runs, the conversation trie and quality rules against brute force, with nulls, ties, repeated rows and clashing names."""
import hashlib
import os
import random
import zlib

import pytest

from haploweave.llm import rules, runs, trie
from haploweave.llm.queries import ORACLE_SQL, QUERIES, repeat_tail

SF = "/root/testdata/sf0.001"


def slow_runs(words, least=24, exp=3):
    """By definition: every stretch and period, smallest period only, that no neighbour extends."""
    n, found = len(words), set()
    for q in range(1, n // exp + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            start, length = i, k + q - i
            if length >= max(least, exp * q) and not any(all(words[j] == words[j + d] for j in range(start, start + length - d)) for d in range(1, q)):
                found.add((start, length, q))
            i = k
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_collapse(words, found):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in found))


def made_texts():
    rng = random.Random(5)
    texts = [None, "", " \n ", "a " * 23, "a " * 24, "a b " * 12, "a b c " * 8 + "a", "a " * 40 + "b " * 40, ("x y " * 13 + "z ") * 4, "A a " * 15, ("p q p " * 20), "é ü " * 30]
    for _ in range(60):
        words = []
        while len(words) < 150:
            part = [rng.choice("abcd") for _ in range(rng.randint(1, 12))]
            words += part * rng.choice([1, 1, 2, 3, 5, 9])
        texts.append(" ".join(words))
    texts.append(" ".join(["la", "le", "lo"] * 3000 + [f"w{i}" for i in range(2000)] + ["da"] * 50))
    return texts


@pytest.mark.parametrize("size", [1, 7, 1 << 19])
def test_stretches_equal_the_definition(size):
    for text in made_texts()[3:-1]:
        words = text.encode().split()
        ids = runs.word_ids(words)
        found = runs.smallest(runs.stretches(ids, 1, len(ids), at_once=size))
        assert [tuple(r) for r in found.tolist()] == slow_runs(words)
    short = runs.smallest(runs.stretches(runs.word_ids(list("abababab")), 1, 9, 4, 2))
    assert [tuple(r) for r in short.tolist()] == slow_runs("abababab", 4, 2)


def test_lag_ranges_cover_all_lags_once():
    for n in (0, 1, 5, 100, 1001):
        lags = [x for low, high in runs.lag_ranges(n, 300) for x in range(low, high)]
        assert lags == list(range(1, n // 3 + 1))


def fixture(spark, texts):
    rows = [(i, t, "n", 1, "r", [7]) for i, t in enumerate(texts)] + [(None, "b " * 30, "n", 1, "r", [7]), (4, texts[4], "n", 1, "r", [7]), (4, texts[4], "n", 1, "r", [7])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, number string, `by` int, row string, runs array<int>").repartition(3)


@pytest.mark.parametrize("long_bytes,cells", [(1 << 15, 1 << 28), (60, 1000), (0, 50)])
def test_periodic_runs(spark, long_bytes, cells):
    texts = made_texts()[:30] + made_texts()[-1:]
    rows, docs = fixture(spark, texts)
    found = runs.periodic_runs(docs, keep=["doc_id", "text", "number", "by"], long_bytes=long_bytes, cells=max(cells, 10**6) if long_bytes else cells * 4000).collect()
    assert len(found) == len(rows)
    want = sorted(((r[0] is None, r[0] or 0), [tuple(x) for x in slow_runs((r[1] or "").split()[:500])]) for r in rows if (r[1] or "").count(" ") < 500)
    have = sorted(((r.doc_id is None, r.doc_id or 0), [(x.start, x.length, x.period) for x in r.runs]) for r in found if (r.text or "").count(" ") < 500)
    assert have == want
    for r in found:
        words = (r.text or "").split()
        assert r.n_words == len(words) and r.number == "n" and r.by == 1
        assert r.collapsed == slow_collapse(words, [(x.start, x.length, x.period) for x in r.runs])
    last = next(r for r in found if r.doc_id == len(texts) - 1)
    assert [(x.start, x.length, x.period) for x in last.runs] == [(0, 9000, 3), (11000, 50, 1)]


def test_periodic_runs_of_nothing(spark):
    _, docs = fixture(spark, made_texts()[:12])
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    assert runs.periodic_runs(docs.filter("text IS NULL"), keep=[]).columns == ["n_words", "runs", "collapsed"]


def test_repeated_tail():
    words = [str(i).encode() for i in range(100)]
    for doc_id in range(200):
        h = zlib.crc32(str(doc_id).encode())
        a, g = (h // 10) % 100, h // 10
        p = 1 + (100 - a) // (3 + g % 8)
        want = [words[i] if i < a or h % 10 else words[a + (i - a) % p] for i in range(100)]
        assert repeat_tail(words, doc_id) == want
    assert repeat_tail([], 1) == [] and repeat_tail(words, None) == words


# Conversations.


def slow_trie(table, families=5, most=9):
    own = {}
    for c, turn, role, text in sorted((r for r in table if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % most if families else 0
        made[c] = (own.get(c - c % families, [])[:h] if families else []) + mine[h:]
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for node, who in members.items():
        below = [u for u in members if u[: len(node)] == node]
        children = lambda v: sum(len(u) == len(v) + 1 and u[:-1] == v for u in members)
        ends = ",".join(map(str, sorted(c for c in who if len(made[c]) == len(node))))
        saved = sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in below if u)
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children(node), sum(children(u) == 0 for u in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made_conversations():
    rng = random.Random(3)
    table = []
    for c in [*range(40), 101, 104, 7_000_003]:
        for turn in range(rng.choice([1, 2, 3, 12])):
            table.append((c, turn if turn or c % 3 else None, rng.choice(["user", "user", None]), rng.choice(["hé", "hé", "yo", None])))
    table += [(200 + c, t, "user", f"{t}") for c in range(12) for t in range(5)]  # all alike
    table += [(300, t, "user", f"long {t % 7}") for t in range(700)] + [(301, t, "user", f"long {t % 7}") for t in range(699)]
    table += [(None, 1, "user", "lost"), (400, 5, "user", "same"), (400, 5, "user", "same")]
    return table


def conversations(spark, table):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in table], "conv_id long, turn long, role string, text string, depth int, node string, place int").repartition(5)


@pytest.mark.parametrize("fan_in,block,span", [(256, 256, 4096), (2, 4, 3)])
def test_prefix_trie(spark, monkeypatch, fan_in, block, span):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "SPAN", span)
    table = [r for r in made_conversations() if r[0] not in (300, 301)]
    rows = trie.turns(conversations(spark, table))
    found = trie.prefix_trie(trie.rebuilt(rows), fan_in)
    assert sorted(map(tuple, found.collect()), key=repr) == slow_trie(table)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    as_is = trie.prefix_trie(trie.whole(rows), fan_in)
    assert sorted(map(tuple, as_is.collect()), key=repr) == slow_trie(table, families=0)


def test_prefix_trie_of_long_conversations(spark):
    table = [r for r in made_conversations() if r[0] in (300, 301)]
    found = {(r.depth, r.conv_id): r for r in trie.prefix_trie(trie.whole(trie.turns(conversations(spark, table)))).collect()}
    assert len(found) == 701 and found[(700, 300)].n_leaves == 1
    assert all(found[(d, 300)].saved_tokens == 6 * (699 - d) + 6 * (d > 0) for d in range(700))
    assert found[(699, 300)].ends_sha256 == hashlib.sha256(b"301").hexdigest()


def test_prefix_trie_of_nothing(spark):
    docs = conversations(spark, made_conversations())
    assert trie.prefix_trie(trie.rebuilt(trie.turns(docs.limit(0)))).count() == 0
    assert trie.prefix_trie(trie.rebuilt(trie.turns(docs.filter("conv_id IS NULL")))).count() == 0


def test_turns_of_equal_number_have_one_order(spark):
    table = [(1, 0, "user", t) for t in "abcdef"] + [(2, 0, "user", t) for t in "fedcba"]
    found = trie.prefix_trie(trie.whole(trie.turns(conversations(spark, table)))).collect()
    assert len(found) == 7 and all(r.n_convs == 2 for r in found)


# Rules.


def slow_measures(text):
    words, lines = text.split(), [x for x in text.split("\n") if x.split()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(repeated)}


def made_documents():
    rng = random.Random(9)
    good = " ".join("abcdefghijklmnopqrstuvwxyz"[i % 26] * 2 + "bcdfg"[i // 26] * 3 for i in range(80))
    texts = [good, None, "", "\n\n", "one two", "a b c d a b c", "x\nx\n x\nx", "é# ü* <&>|", "A " * 60, "word " * 60, "w1 w2 ... \nq…"]
    for k in range(80):
        pool = [rng.choice(["lorem", "ipsum", "dolor", "Été", "X#$", "12", "AB!!", "-"]) + "abcdefghij"[: rng.randint(0, 9)] for _ in range(rng.randint(2, 80))]
        texts.append("".join(rng.choice(pool) + rng.choice([" ", " ", " ", "\n", "...\n"]) for _ in range(rng.randint(1, 300))))
    return texts


def test_measures_and_verdict(spark):
    rows = [(i, t, "m", 3) for i, t in enumerate(made_documents())] + [(None, None, "m", 3), (5, "x y", "m", 3), (5, "x y", "m", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, row int").repartition(3)
    names = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = rules.judge(docs, measures=names, keep=["doc_id", "text", "row"], sample_rows=20).collect()
    assert len(found) == len(rows)
    for r in found:
        want = slow_measures(r.text or "")
        assert {n: r[n] for n in names} == {n: want[n] for n in names}
        says = [x.name for x in rules.RULES if x.says(rules.Measures((r.text or "").encode()))]
        assert (r.rejected_by in says) if says else r.rejected_by is None
    assert {r.rejected_by for r in found} > {None} and next(r for r in found if r.doc_id == 0).rejected_by is None
    assert rules.judge(docs, keep=["n_words"]).columns == ["n_words", "rejected_by"]
    assert rules.judge(docs.limit(0)).count() == 0


def test_repeat_words_of_many_words():
    words = [str(i).encode() for i in range(2**20 + 10)]
    raw = b" ".join(words + words[:5])
    assert rules.Measures(raw).n_repeat_words == 10


def test_cascade_takes_what_rejects_most_for_its_cost():
    made = [rules.Rule(n, (u,), lambda x: True) for n, u in [("cheap", "a"), ("dear", "b"), ("shared", "a"), ("never", "c")]]
    e = rules.Estimate(100, {"a": 1.0, "b": 10.0, "c": 0.1}, {frozenset(["cheap", "dear"]): 30, frozenset(["dear"]): 20, frozenset(["shared"]): 1, frozenset(): 49})
    assert [r.name for r in rules.cascade(made, e)] == ["cheap", "shared", "dear", "never"]
    assert [r.name for r in rules.cascade(made, e, given=["b"])][0] == "dear"


def test_estimate_sees_the_sample(spark):
    docs = spark.createDataFrame([(i, "word " * (10 + i)) for i in range(100)], "doc_id long, text string")
    e = rules.estimate(docs, rows=1000)
    assert e.rows == 100 and sum(n for said, n in e.rejected.items() if "few_words" in said) == 40
    assert set(e.seconds) >= {"words", "n_words", "ids", "n_repeat_words", "lines"} and min(e.seconds.values()) >= 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_conversation_trie", "op13_quality_rules"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    show = lambda v: str(int(v)) if isinstance(v, float) and v == v and v == int(v) else str(v)
    a, b = QUERIES[name](spark, SF).toPandas(), c.execute(ORACLE_SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert sorted(map(tuple, a[cols].map(show).to_numpy().tolist())) == sorted(map(tuple, b[cols].map(show).to_numpy().tolist()))
