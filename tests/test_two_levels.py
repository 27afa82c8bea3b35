"""Operators along a contig that no task holds whole: against plain Python, with stretches far smaller than the data."""
import random

import pytest
from pyspark.sql import functions as F

from haploweave.operators import phase, ranges


def intervals(seed, n, wide):
    r = random.Random(seed)
    rows = [(i, r.choice([0, 1, None]), b := r.randint(1, 2000), b + r.choice([-1, 0, r.randint(0, wide)])) for i in range(n)]
    return rows + [(n + i, 1, 500, 500) for i in range(40)] + [(n + 50, 1, 1, 2000)]


SCHEMA = "id long, tid int, beg long, fin long"


@pytest.mark.parametrize("stretch", [7, 300, 1 << 20])
def test_overlap_counts(spark, stretch):
    left, right = intervals(1, 150, 30), intervals(2, 200, 400)
    got = {r.id: r.n for r in ranges.overlap_counts(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["id"], name="n", stretch=stretch).collect()}
    assert len(got) == len(left)
    for i, tid, beg, fin in left:
        want = sum(t == tid and b <= f and b <= fin and f >= beg for _, t, b, f in right) if beg <= fin and tid is not None else 0
        assert got[i] == want


def test_overlap_counts_of_nothing(spark):
    some = spark.createDataFrame(intervals(3, 5, 9), SCHEMA)
    assert {r.n_ov for r in ranges.overlap_counts(some, some.limit(0), ["id"]).collect()} == {0}
    assert ranges.overlap_counts(some.limit(0), some, ["id"]).count() == 0


@pytest.mark.parametrize("stretch", [3, 100])
def test_numbers(spark, stretch):
    rows = [(i, t, b, f) for i, t, b, f in intervals(4, 300, 5)]
    got = {r.id: r.k for r in ranges.numbered(spark.createDataFrame(rows, SCHEMA), ["tid"], ["beg", "id"], "k", stretch).collect()}
    for tid in (0, 1, None):
        order = sorted((b, i) for i, t, b, _ in rows if t == tid)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))


def test_anchors_are_carried_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(phase, "STRETCH", 50)
    r = random.Random(5)
    rows = [(i, r.choice([0, 1]), r.randint(1, 2000), r.random() < 0.05) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, tid int, pos long, fresh boolean")
    got = {x.id: x.phase_set for x in phase.carry_anchors(df, "tid", ["pos", "id"], F.col("pos"), F.col("fresh")).collect()}
    for tid in (0, 1):
        last = None
        for pos, i, fresh in sorted((p, i, f) for i, t, p, f in rows if t == tid):
            last = pos if fresh else last
            assert got[i] == last
    assert len(got) == len(rows)


def test_clusters_stop_where_nothing_reaches():
    r = random.Random(6)

    def plain(now, window):
        now = sorted(now, key=lambda x: x[0])
        while True:
            out, used = [], set()
            for i, (beg, end, label) in enumerate(now):
                if i in used:
                    continue
                for j in range(i + 1, len(now)):
                    if j not in used and end + (min(label, now[j][2]) if window is None else window) >= now[j][0]:
                        used.add(j)
                        beg, end, label = min(beg, now[j][0]), max(end, now[j][1]), max(label, now[j][2])
                out.append((beg, end, label))
            out.sort(key=lambda x: x[0])
            if len(out) == len(now):
                return out
            now = out

    for _ in range(300):
        rows = [(b := r.randint(0, 300), b + r.randint(1, 20), r.randint(0, 30)) for _ in range(r.randint(0, 40))]
        window = r.choice([None, 0, 5])
        assert ranges.cluster(rows, window) == plain(rows, window)
