"""Sources and sinks, there and back."""
import struct

import pytest
from pyspark.sql import functions as F

from haploweave.options import Options
from haploweave.plans import simulate
from haploweave.plans.collect import collect_variation, with_bases
from haploweave.schemas import ALIGNMENT
from haploweave.sinks import alignments as out
from haploweave.sinks import tables, vcf
from haploweave.sources import alignments as src
from haploweave.sources import sidecar, text


def test_regions(spark, tmp_path):
    assert text.parse_region("chr1:1,000-2,000") == ("chr1", 1000, 2000)
    assert text.parse_region("chr1:5") == ("chr1", 5, -1) and text.parse_region("chr1") == ("chr1", 1, -1)
    for bad in ("chr1:x", "chr1:9-5", ":4"):
        with pytest.raises(ValueError):
            text.parse_region(bad)
    (tmp_path / "a.bed").write_text("# x\n\nchr1\t0\t10\tname\nchr2 5 7\n")
    assert sorted(map(tuple, text.bed(spark, str(tmp_path / "a.bed")).collect())) == [("chr1", 1, 10), ("chr2", 6, 7)]
    (tmp_path / "b.bed").write_text("chr1\t10\t3\n")
    with pytest.raises(Exception, match="bad BED row"):
        text.bed(spark, str(tmp_path / "b.bed")).collect()
    (tmp_path / "l").write_text("# c\n a.bam \n\nb.bam\n")
    assert text.path_list(spark, str(tmp_path / "l")) == ["a.bam", "b.bam"]
    (tmp_path / "m").write_text("#\n")
    with pytest.raises(ValueError):
        text.path_list(spark, str(tmp_path / "m"))


def test_fasta(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">chr1 x\nACGTN\nrACGT\n>chr2\nAAAA\n")
    tiles = text.fasta_tiles(spark, str(tmp_path / "r.fa"), 4)
    assert sorted(map(tuple, tiles.collect())) == [("chr1", 0, 1, "ACGT"), ("chr1", 1, 5, "NNAC"), ("chr1", 2, 9, "GT"), ("chr2", 0, 1, "AAAA")]
    spans = spark.createDataFrame([(1, "chr1", 3, 9), (2, "chr2", 2, 9)], "k int, chrom string, beg long, fin long")
    assert sorted(map(tuple, text.slices(spans, tiles, ["k"], 4).collect())) == [(1, 3, "GTNNACG"), (2, 2, "AAA")]
    points = spark.createDataFrame([(1, "chr1", 10), (2, "chr1", 11)], "k int, chrom string, pos long")
    assert sorted(map(tuple, text.bases_at(points, tiles, ["k"], 4).collect())) == [(1, "T"), (2, "N")]
    (tmp_path / "r.fai").write_text("chr1\t10\t8\t5\t6\nchr2\t4\t30\t4\t5\n")
    contigs = text.fasta_index(spark, str(tmp_path / "r.fai"))
    assert sorted(map(tuple, contigs.collect())) == [(0, "chr1", 10), (1, "chr2", 4)]
    assert sorted(r.chrom for r in text.autosomes(contigs).collect()) == ["chr1", "chr2"]


def test_sidecar(spark, tmp_path):
    good = sidecar.encode([(7, [1, 2]), (9, [])], b"fp")
    assert sidecar.decode(good) == [(7, [1, 2]), (9, [])]
    (tmp_path / "s.pgbam").write_bytes(good)
    assert sorted(map(tuple, sidecar.read(spark, str(tmp_path / "s.pgbam")).collect())) == [(7, 1), (7, 2)]
    for bad in (b"XXXX" + good[4:], good[:4] + struct.pack("<I", 2) + good[8:], good[:-3], sidecar.encode([(7, [1]), (7, [2])])):
        with pytest.raises(ValueError):
            sidecar.decode(bad)


@pytest.fixture(scope="module")
def run(spark):
    ref = simulate.genome(20_000)
    rows = [tuple(a.values()) for a in simulate.alignments(ref, simulate.variants(ref, 400))]
    reads = spark.createDataFrame(rows, ALIGNMENT)
    tiles = spark.createDataFrame(simulate.reference_rows(ref), "chrom string, tile long, beg long, seq string")
    contigs = spark.createDataFrame([(0, "chr1", len(ref))], "tid int, name string, len long")
    return reads, collect_variation(spark, reads, tiles, contigs, Options(read_support=True)), [("chr1", len(ref))]


def test_tables(run, tmp_path):
    _, result, _ = run
    rows = tables.candidate_rows(with_bases(result))
    assert rows.columns == tables.CANDIDATE_COLUMNS and rows.filter("REF = '' OR (TYPE = 'INS') <> (REF = '.')").count() == 0
    tables.write(rows, str(tmp_path / "tsv"), ["CHROM", "POS"])
    assert result.candidates.count() == result.tiles.sparkSession.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv")).count()
    assert tables.support_rows(result.support, result.contigs).columns == tables.SUPPORT_COLUMNS
    assert tables.read_rows(result.reads, result.contigs).columns == tables.READ_COLUMNS


def test_vcf(spark, run, tmp_path):
    _, result, contigs = run
    vcf.write(vcf.phased_records(with_bases(result), result.options), str(tmp_path / "v"), contigs, phased=True)
    lines = [r.value for r in spark.read.text(str(tmp_path / "v/records")).collect()]
    head = [r.value for r in spark.read.text(str(tmp_path / "v/header")).collect()]
    assert head[0] == "##fileformat=VCFv4.2" and head[-1].split("\t")[-2:] == ["FORMAT", "SAMPLE"]
    first = min((x.split("\t") for x in lines), key=lambda x: int(x[1]))
    assert len(first) == 10 and first[7].startswith("END=") and first[8] == "GT:PS" and first[9].split(":")[0] in ("0|1", "1|0", "1|1")


def test_sam_and_bam_round_trip(spark, run, tmp_path):
    reads, result, contigs = run
    tagged = out.tagged(reads, result.reads)
    assert tagged.filter("hp IS NOT NULL").count() == result.reads.filter("hap > 0").select("read_id").distinct().count()
    out.write_sam(tagged, str(tmp_path / "s"), contigs)
    text_ = "\n".join(r.value for part in ("header", "records") for r in spark.read.text(str(tmp_path / "s" / part)).collect())
    (tmp_path / "x.sam").write_text(text_ + "\n")
    back = src.read_sam(spark, str(tmp_path / "x.sam"))
    columns = ["qname", "flag", "tid", "pos", "mapq", "cigar", "seq", "qual"]
    want = sorted(map(tuple, reads.select(columns).collect()))
    assert sorted(map(tuple, back.select(columns).collect())) == want
    out.write_bam(tagged.limit(50), str(tmp_path / "b"), contigs)
    again = src.read_bam(spark, str(tmp_path / "b/*.bam"))
    assert again.select(columns).exceptAll(reads.select(columns)).count() == 0 and again.count() == 50
    src.register(spark)
    one = next((tmp_path / "b").glob("*.bam"))
    assert spark.read.format("bam").load(str(one)).count() > 0
    assert sorted(map(tuple, src.bam_contigs(spark, str(one)).collect())) == [(0, "chr1", 20_000)]
    with pytest.raises(ValueError):
        src.read_bam(spark, "x.cram")
    assert out.stripped(tagged).filter("hp IS NOT NULL").count() == 0


def test_stream_of_alignments(spark, run, tmp_path):
    from haploweave.plans import tiles
    from haploweave.streaming.tiles import stream

    reads, result, _ = run
    reads.coalesce(1).write.parquet(str(tmp_path / "in"))
    grid = tiles.number(tiles.cut(spark.createDataFrame([(0, 1, 20_000)], "tid int, beg long, fin long"), 5000))
    seen = []
    q = stream(spark, str(tmp_path / "in"), grid, Options(), lambda rows, touched, n: seen.append((rows.count(), touched.count())), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert sum(n for n, _ in seen) == reads.count() and max(t for _, t in seen) == 4


def test_refined_alignments(spark, run):
    from haploweave.plans.refine import refine

    reads, result, _ = run
    with_tags = reads.withColumn("nm", F.lit(0)).withColumn("md", F.lit("x"))
    before = {r.read_id: r for r in with_tags.collect()}
    for r in refine(with_tags, result).collect():
        a = before[r.read_id]
        assert (r.pos, r.seq) == (a.pos, a.seq) and set(r.cigar) <= set("0123456789=XID")
        if r.cigar != a.cigar:
            assert r.nm == sum(int(n) for n, op in src_ops(r.cigar) if op in "XID") and r.md != "x"
        assert sum(int(n) for n, op in src_ops(r.cigar) if op in "=XI") == len(a.seq)


def src_ops(cigar):
    import re

    return re.findall(r"(\d+)([MIDNSHP=X])", cigar)


def test_command_line(spark, run, tmp_path):
    from haploweave.cli import run as command

    reads, result, contigs = run
    ref = simulate.genome(20_000)
    (tmp_path / "r.fa").write_text(">chr1\n" + "\n".join(ref[i : i + 60] for i in range(0, len(ref), 60)) + "\n")
    tagged = out.stripped(reads)
    out.write_bam(tagged.coalesce(1), str(tmp_path / "b"), contigs)
    bam = sorted((tmp_path / "b").glob("*.bam"))
    arguments = [str(tmp_path / "r.fa"), str(bam[0]), *[x for b in bam[1:] for x in ("-X", str(b))], "-o", str(tmp_path / "tsv"), "--phased-vcf-output", str(tmp_path / "v"), "-S", str(tmp_path / "s"), "--refine-aln", "--phase-read-tsv", str(tmp_path / "p"), "--read-support", str(tmp_path / "rs")]
    numbers = command(arguments, spark)
    assert numbers["reads"] == reads.count() and numbers["CLEAN_HET_SNP"] > 10
    want = sorted((r.POS, r.TYPE, r.ALT) for r in tables.candidate_rows(with_bases(result)).collect())
    got = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv"))
    assert sorted((int(r.POS), r.TYPE, r.ALT) for r in got.collect()) == want
    assert spark.read.text(str(tmp_path / "s/records")).filter("value LIKE '%HP:i:%'").count() > 0
    assert spark.read.text(str(tmp_path / "v/records")).count() > 10
