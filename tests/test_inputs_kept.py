"""What a run must take over from its inputs: header, mates and tags; ranges, regions and ids; and the flag of homopolymers."""
import struct

import pytest

from haploweave.functions.repeats import Window
from haploweave.operators.recall import homopolymer_indel
from haploweave.options import Options
from haploweave.plans import simulate
from haploweave.plans.collect import collect_variation
from haploweave.sinks import alignments as out
from haploweave.sinks import tables
from haploweave.sources import alignments as src
from haploweave.sources import text

SAM = """@HD\tVN:1.6\tSO:unsorted
@SQ\tSN:chr1\tLN:5000
@SQ\tSN:chr2\tLN:900
@RG\tID:a\tSM:one
@PG\tID:mapper\tPN:mapper
@CO\ta note
r1\t99\tchr1\t101\t60\t10M\t=\t301\t210\tACGTACGTAC\tIIIIIIIIII\tRG:Z:a\tNM:i:0\tXA:A:c\tXF:f:0.1\tXB:B:s,-3,4\tXI:i:4000000000\tHP:i:2
r2\t1\tchr1\t951\t60\t5M3D5M\tchr2\t7\t0\tACGTACGTAC\t*\tXZ:Z:t x:y
r3\t0\tchr1\t1001\t60\t10M\t*\t0\t0\tACGTACGTAC\t*
r4\t0\tchr2\t11\t60\t10M\t*\t0\t0\tACGTACGTAC\t*
"""
CONTIGS = [("chr1", 5000), ("chr2", 900)]


def lines_of(spark, path):
    return [r.value for part in ("header", "records") for r in spark.read.text(f"{path}/{part}").collect()]


def test_writer_hands_on_what_it_got(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    rows = out.stripped(src.read_sam(spark, str(tmp_path / "x.sam")))
    kept = src.header_lines(spark, str(tmp_path / "x.sam"))
    assert kept == ["@RG\tID:a\tSM:one", "@PG\tID:mapper\tPN:mapper", "@CO\ta note"]
    out.write_sam(rows, str(tmp_path / "s"), CONTIGS, "a b", kept)
    got = lines_of(spark, str(tmp_path / "s"))
    assert got[3:6] == kept and "PP:mapper" in got[6] and "CL:a b" in got[6]
    fields = {x.split("\t")[0]: x.split("\t") for x in got if not x.startswith("@")}
    for line in SAM.splitlines()[6:]:
        want = line.split("\t")
        assert fields[want[0]][:11] == want[:11]
        assert sorted(fields[want[0]][11:]) == sorted(t for t in want[11:] if not t.startswith("HP:"))
    # The same through BAM.
    out.write_bam(rows.coalesce(1), str(tmp_path / "b"), CONTIGS, "a b", kept)
    bam = str(next((tmp_path / "b").glob("*.bam")))
    assert src.header_lines(spark, bam)[:3] == kept
    again = src.read_bam(spark, bam)
    columns = ["qname", "flag", "chrom", "pos", "cigar", "seq", "mate_chrom", "mate_pos", "tlen", "nm"]
    assert sorted(map(tuple, again.select(columns).collect()), key=str) == sorted(map(tuple, rows.select(columns).collect()), key=str)
    assert {r.qname: sorted(r.tags.split("\t")) for r in again.collect()} == {r.qname: sorted((r.tags or "").split("\t")) for r in rows.collect()}


def test_ranges_hold_reads_that_overlap(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    out.write_bam(out.stripped(src.read_sam(spark, str(tmp_path / "x.sam"))).coalesce(1), str(tmp_path / "b"), CONTIGS)
    bam = str(next((tmp_path / "b").glob("*.bam")))
    src.register(spark)

    def names(**o):
        reader = spark.read.format("bam")
        for k, v in o.items():
            reader = reader.option(k, v)
        return sorted(r.qname for r in reader.load(bam).collect())

    assert names() == ["r1", "r2", "r3", "r4"]
    assert names(tid=0, beg=962, fin=1001) == ["r2", "r3"]  # r2 covers 950 to 962 (0-based)
    assert names(tid=0, beg=963, fin=1000) == []
    assert names(tid=0, beg=110, fin=951) == ["r2"] and names(tid=0, beg=109, fin=950) == ["r1"]
    assert names(tid=1) == ["r4"]


def test_records_come_block_by_block(spark, tmp_path):
    """A header and records that go over block borders, read with a block and a record at once."""
    contigs = [(f"contig{i:05d}", 1000 + i) for i in range(6000)]
    row = {"tid": 5, "pos": 10, "mapq": 9, "cigar": "70000S10M", "flag": 0, "seq": "ACGTA" * 14002, "qual": None, "qname": "long"}
    data = out.bam_bytes(contigs) + b"".join(out.record_bytes(row | {"qname": f"q{i}"}) for i in range(7))
    path = tmp_path / "many.bam"
    path.write_bytes(out.bgzf(data) + out.END)
    parts = src.bam_parts(src.blocks(path.read_bytes()))
    assert next(parts)[1] == contigs
    records = list(parts)
    assert len(records) == 7 and src.reference_end(records[0]) == 20
    with open(path, "rb") as f:
        assert [x for _, x in src.blocks_of(f)] == [x for _, x in src.blocks(path.read_bytes())]
    with pytest.raises(ValueError):
        list(src.blocks_of(open(__file__, "rb")))
    with pytest.raises((ValueError, struct.error)):
        list(src.bam_parts(iter([(0, b"BAM\x01\x05")])))


def test_ids_of_many_inputs_are_apart(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    rows = src.read_inputs(spark, [str(tmp_path / "x.sam")] * 70)
    assert rows.select("read_id").distinct().count() == rows.count() == 280


def test_autosomes_are_named_one_by_one(spark):
    contigs = spark.createDataFrame([(i, n, 10 + i) for i, n in enumerate(["1", "chr2", "2", "chrX", "22", "chr23", "chr7"])], "tid int, name string, len long")
    got = sorted((r.chrom, r.beg, r.fin) for r in text.autosomes(contigs).collect())
    assert got == [("1", 1, 10), ("22", 1, 14), ("chr2", 1, 11), ("chr7", 1, 16)]
    others = spark.createDataFrame([("2",), ("22",)], "name string")
    assert sorted(r.chrom for r in text.autosomes(contigs, others).collect()) == ["2", "22"]


def test_regions_are_united(spark, tmp_path):
    ref = simulate.genome(6000)
    reads = spark.createDataFrame([tuple(a.values()) for a in simulate.alignments(ref, simulate.variants(ref, 400))], "read_id bigint, qname string, flag int, tid int, chrom string, pos bigint, mapq int, cigar string, seq string, qual binary, nm int, md string, cs string, sa string, hs array<bigint>, input_idx int")
    reference = spark.createDataFrame(simulate.reference_rows(ref), "chrom string, tile long, beg long, seq string")
    contigs = spark.createDataFrame([(0, "chr1", len(ref))], "tid int, name string, len long")
    (tmp_path / "r.bed").write_text("chr1\t1000\t2000\n")
    o = Options(regions=("chr1:3001-3500",), region_file=str(tmp_path / "r.bed"))
    result = collect_variation(spark, reads, reference, contigs, o)
    assert sorted((r.beg, r.fin) for r in result.grid.collect()) == [(1001, 2000), (3001, 3500)]
    everything = collect_variation(spark, reads, reference, contigs, Options(autosome=True, regions=("chr1:1-50",)))
    assert sorted((r.beg, r.fin) for r in everything.grid.collect()) == [(1, 50), (1, 6000)]
    rows = tables.read_rows(result.reads, contigs, result.grid)
    assert rows.columns == tables.READ_COLUMNS and rows.count() == result.reads.count()


@pytest.mark.parametrize("site, flagged", [
    ({"type": "DEL", "pos": 5, "ref_len": 2, "alt": ""}, True), ({"type": "DEL", "pos": 8, "ref_len": 2, "alt": ""}, False), ({"type": "DEL", "pos": 5, "ref_len": 7, "alt": ""}, False),
    ({"type": "INS", "pos": 5, "ref_len": 0, "alt": "AA"}, False), ({"type": "SNP", "pos": 5, "ref_len": 1, "alt": "C"}, False), ({"type": "DEL", "pos": 2, "ref_len": 1, "alt": ""}, False),
])
def test_homopolymer_deletions(site, flagged):
    assert homopolymer_indel(site, Window("CTGGAAAAAACGT", 1)) == flagged
