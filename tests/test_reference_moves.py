"""What of the reference and of bases goes through exchanges and sorts."""
import re

import pytest

from haploweave.plans.collect import with_reference
from haploweave.plans.fixtures import Fixtures
from haploweave.schemas import ALIGNMENT
from haploweave.sources.text import slices


@pytest.fixture
def shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def inputs(df, of: str) -> list[set[str]]:
    """Names of the columns that go into operators of a kind."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    return [set(re.findall(r"(\w+)#", x)) for x in re.findall(rf"\) (?:{of})[^\n]*\nInput \[\d+\]: \[([^\n]*)\]", plan)]


def test_groups_of_slices_hold_no_whole_tiles(shuffled):
    tiles = shuffled.createDataFrame([("c", 0, 1, "ACGTACGTAC"), ("c", 1, 11, "GGGGTTTT")], "chrom string, tile long, beg long, seq string")
    spans = shuffled.createDataFrame([(1, "c", 8, 13), (2, "c", 1, 4), (3, "c", 15, 40)], "id long, chrom string, beg long, fin long")
    found = slices(spans, tiles, ["id"], tile=10)
    assert {tuple(r) for r in found.collect()} == {(1, 8, "TACGGG"), (2, 1, "ACGT"), (3, 15, "TTTT")}
    grouped = inputs(found, "ObjectHashAggregate|SortAggregate|HashAggregate")
    assert grouped and not any("seq" in x for x in grouped)


def test_reads_get_their_bases_after_the_last_exchange(shuffled):
    moved = inputs(Fixtures(shuffled, "/root/testdata/sf0.001").alignments(), "Exchange|Sort")
    assert any("read_id" in x for x in moved)
    assert not any("read_id" in x and x & {"seq", "ref_seq", "__s"} for x in moved)


def test_only_alignments_that_need_it_go_beside_the_reference(shuffled):
    names = [c.rsplit(" ", 1)[0] for c in ALIGNMENT.split(", ")]
    made = lambda i, cigar, md=None: tuple({"read_id": i, "chrom": "c", "pos": 2, "cigar": cigar, "md": md, "seq": "ACG", "flag": 0}.get(n) for n in names)
    rows = shuffled.createDataFrame([made(1, "3M"), made(2, "3="), made(3, "3M", "3"), made(4, None)], ALIGNMENT)
    tiles = shuffled.createDataFrame([("c", 0, 1, "TTACGTT")], "chrom string, tile long, beg long, seq string")
    found = with_reference(rows, tiles)
    assert {(r.read_id, r.ref_beg, r.ref_seq) for r in found.collect()} == {(1, 3, "ACG"), (2, None, None), (3, None, None), (4, None, None)}
    assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()
