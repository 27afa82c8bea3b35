"""What goes to all tasks by way of the driver: nothing that grows with the reference, the sites or the tiles."""
import re

from pyspark.sql import functions as F

from haploweave.plans import collect, tiles
from haploweave.plans.fixtures import Fixtures
from haploweave.plans.queries import low_complexity_mask, projected_run
from haploweave.sources.text import bases_at, slices

SF = "/root/testdata/sf0.001"


def broadcast(df) -> list[set[str]]:
    """Names of the columns of each broadcast."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    return [set(re.findall(r"(\w+)#", x)) for x in re.findall(r"\) BroadcastExchange[^\n]*\nInput \[\d+\]: \[([^\n]*)\]", plan)]


def test_reference_is_sent_by_key(spark):
    tile = spark.range(4).select(F.lit("c").alias("chrom"), F.col("id").alias("tile"), (F.col("id") * 10 + 1).alias("beg"), F.repeat(F.lit("ACGTT"), 2).alias("seq"))
    spans = spark.createDataFrame([(1, "c", 8, 13), (2, "c", 1, 4)], "id long, chrom string, beg long, fin long")
    cut = slices(spans, tile, ["id"], tile=10)
    assert not any("seq" in x for x in broadcast(cut))
    assert {tuple(r) for r in cut.collect()} == {(1, 8, "GTTACG"), (2, 1, "ACGT")}
    at = bases_at(spans.select("id", "chrom", F.col("beg").alias("pos")), tile, ["id"], tile=10)
    assert not any("seq" in x for x in broadcast(at))
    assert {tuple(r) for r in at.collect()} == {(1, "G"), (2, "A")}


def test_alignments_get_bases_by_key(spark):
    found = broadcast(Fixtures(spark, SF).alignments())
    assert not any("seq" in x for x in found)


def test_sites_are_sent_by_key_and_joined_once(spark):
    fx = Fixtures(spark, SF)
    for df in (fx.obs(), fx.alignments()):
        assert not any(x & {"p_partkey", "site_id", "s_site_id"} for x in broadcast(df))
    plan = fx.shown()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2  # orders and part


def test_stretches_of_the_mask_are_sent_by_key(spark):
    assert not any("__bin" in x for x in broadcast(low_complexity_mask(spark, SF)))


def test_tiles_beyond_a_number_are_sent_by_key(spark, monkeypatch):
    contigs = spark.range(3).select(F.col("id").cast("int").alias("tid"), F.lit(1).cast("long").alias("beg"), F.lit(900).cast("long").alias("fin"))
    grid = tiles.number(tiles.cut(contigs, 100))
    reads = spark.range(300).select("id", (F.col("id") % 3).cast("int").alias("tid"), (F.col("id") * 2 + 1).alias("beg"), (F.col("id") * 2 + 150).alias("fin"))
    few = tiles.load_reads(reads, collect.told(grid))
    assert any("chunk_chunk_id" in x for x in broadcast(few))
    monkeypatch.setattr(collect, "MOST_TILES", 26)  # of 27
    many = tiles.load_reads(reads, collect.told(grid))
    assert not any("chunk_chunk_id" in x for x in broadcast(many))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(many) == rows(few) and len(rows(few)) > 300


def test_whole_run_broadcasts_no_more_than_its_tiling(spark, monkeypatch):
    """Of what is made of the tables or the reference, nothing is under a broadcast but numbers of tiles."""
    monkeypatch.setattr(collect, "kept", lambda df: df)  # the plan is not cut
    lines = projected_run(spark, SF).tiles._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(re.match(r"[\s:+-]*(?:\*\(\d+\) )?", x)[0])
    assert any("FlatMapCoGroupsInArrow" in x for x in lines)
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for under in lines[at + 1 :]:
                if depth(under) <= depth(line):
                    break
                assert "FileScan" not in under and "MapInArrow" not in under
