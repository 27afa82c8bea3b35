"""Work is spread over tasks, and tasks hold little of it at once."""
import pyarrow as pa
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_reference_is_dealt_out_and_made_of_its_places(spark):
    from haploweave.plans.fixtures import Fixtures

    fx = Fixtures(spark, SF)
    made = fx.reference(tile=500)
    assert made.select("chrom", F.spark_partition_id().alias("part")).filter("chrom = 'chr1'").distinct().count() > 1  # not a task a contig
    rows = made.filter("chrom = 'chr3' AND tile IN (0, 7)").collect()
    assert len(rows) == 2
    for r in rows:
        assert r.beg == r.tile * 500 + 1
        assert r.seq == "".join("ACGT"[((p * 2654435761 + 2 * 40503) >> 16) % 4] for p in range(r.beg, r.beg + 500))


def test_batches_are_taken_in_pieces():
    from haploweave.operators.digars import pieces

    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    found = list(pieces(batch))
    assert max(p.num_rows for p in found) == 256 and [x for p in found for x in p.column(0).to_pylist()] == list(range(1000))
    assert not list(pieces(batch.slice(0, 0)))


def test_mask_is_made_by_a_number_of_tasks(spark):
    from haploweave.plans.queries import low_complexity_mask

    plan = low_complexity_mask(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2  # of the reference and of what is masked
