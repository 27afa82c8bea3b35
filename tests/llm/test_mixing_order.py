"""Training positions of the mix: against numeric integration, and kept in order by the query and the pipeline."""
import os
from collections import defaultdict
from types import SimpleNamespace

import pytest

from haploweave.llm import mixing, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def part_done(knots, t, steps=2000):
    """The part of a curve's integral that lies before t, by the midpoint rule."""
    def at(x):
        i = min(int(x * (len(knots) - 1)), len(knots) - 2)
        return knots[i] + (x * (len(knots) - 1) - i) * (knots[i + 1] - knots[i])

    area = lambda end: sum(at((k + 0.5) * end / steps) for k in range(steps)) * end / steps
    return area(t) / area(1.0)


def test_query_returns_training_positions(spark):
    found = queries.op3_curriculum_mixing(spark, SF)
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken", "n_readings", "first_position", "last_position"]
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    told = found.collect()
    assert sorted(r.doc_id for r in told) == sorted(docs)
    first = [2.0 if r.first_position is None else r.first_position for r in told]
    assert first == sorted(first) and min(first) == 0.0
    rows = [r.asDict() | {"doc_id": r.row.doc_id} for r in mixing.ordered(spark.read.parquet(f"{SF}/documents.parquet")).collect()]
    rows = [SimpleNamespace(**r) for r in rows]
    places = {r.doc_id: r.positions for r in rows}
    assert all((r.n_readings, r.first_position, r.last_position) == (len(p := places[r.doc_id]), *((p[0], p[-1]) if p else (None, None))) for r in told)
    knots = dict(zip(sorted({d.source for d in docs.values()}), [s.knots for s in mixing.CURRICULUM] * len(docs)))
    by_source = defaultdict(list)
    for r in rows:
        by_source[docs[r.doc_id].source].append(r)
        assert (r.taken > 0) <= (len(r.positions) > 0) and r.taken <= len(r.positions) * r.size
    for s, of in by_source.items():
        demand, done = round(of[0].target), 0
        turns = sorted((t, r.size, i) for i, r in enumerate(of) for t in r.positions)
        assert sum(r.taken for r in of) == demand
        for k, (t, size, _) in enumerate(turns):
            if k % 7 == 0 and (k == 0 or turns[k - 1][1]):  # the words before a reading are what the schedule asks for by then
                assert part_done(knots[s], t) * demand == pytest.approx(done, abs=0.01 * demand)
            done += size


def test_shares_follow_the_integral(spark):
    docs = spark.createDataFrame([(i, "w " * 10, s) for i in range(50) for s in "ab"], "doc_id long, text string, source string")
    schedules = (mixing.Schedule((3.0, 3.0)), mixing.Schedule((0.0, 2.0)))
    planned = mixing.plan(docs, weights=(1.0, 1.0), schedules=schedules).collect()
    assert {(r["source"], r["target"]) for r in planned} == {("a", 750.0), ("b", 250.0)}


def test_pipeline_keeps_the_training_order(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
    want = mixing.readings(mixing.plan(docs)).orderBy(*mixing.ORDER).collect()
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.position for r in rows) == list(range(len(want)))
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.position)] == [r.row.doc_id for r in want]


def test_places_follow_the_files(spark, tmp_path):
    import corpus_pipeline

    # Later files are larger, so that a scan takes them first.
    rows = spark.createDataFrame([(i, "é" * (i % 7) + str(i) * i, "s") for i in range(400)], "doc_id long, text string, source string").repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id")
    rows.write.option("maxRecordsPerFile", 30).parquet(str(tmp_path / "w"))
    found = corpus_pipeline.numbered(spark.read.parquet(str(tmp_path / "w")))
    assert found.columns == ["doc_id", "source", "text", "place"]
    assert all(r["doc_id"] == r["place"] for r in found.collect()) and found.count() == 400
