"""One sorted BAM file with its index: written whole or not at all, read in parts and by range."""
import random

import pytest

from haploweave.plans import simulate
from haploweave.schemas import ALIGNMENT
from haploweave.sinks import alignments as out
from haploweave.sources import alignments as src
from haploweave.sources.bam_index import WINDOW, Index, bin_of, bins_over, cut

CONTIGS = [("chr1", 400_000), ("chr2", 90_000), ("empty", 5000)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    found = []
    for tid, (name, size) in enumerate(CONTIGS[:2]):
        for k in range(600 if tid == 0 else 80):
            length = rng.choice([50, 900, 4000])
            found.append({"tid": tid, "chrom": name, "pos": rng.randrange(size - 45_000 if k % 50 else 10), "cigar": f"{length}M" if k % 40 else f"20M{rng.randrange(1, 40_000)}N{length - 20}M", "seq": "".join(rng.choice("ACGT") for _ in range(length))})
    found += [{"tid": -1, "chrom": None, "pos": -1, "cigar": "", "seq": "ACGT"}] * 3
    return [r | {"read_id": k, "qname": f"r{k}", "flag": 0 if r["tid"] >= 0 else 4, "mapq": 60, "qual": None, "nm": None, "md": None, "cs": None, "sa": None, "hs": [], "input_idx": 0} for k, r in enumerate(found)]


@pytest.fixture(scope="module")
def bam(spark, rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bam")
    names = [c.split()[0] for c in ALIGNMENT.split(", ")]
    table = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ALIGNMENT).repartition(7)
    out.write_bam(out.stripped(table), str(folder / "all.bam"), CONTIGS, one_file=True)
    assert sorted(p.name for p in folder.iterdir() if not p.name.endswith(".crc")) == ["all.bam", "all.bam.bai"]
    return str(folder / "all.bam")


def reads(options, path):
    """Reads of all parts, and how many parts there are and blocks were inflated."""
    reader, count = src.BamReader({"path": path} | options), [0]
    plain = src.zlib.decompress

    def counted(*a):
        count[0] += 1
        return plain(*a)

    src.zlib = type("z", (), {"decompress": staticmethod(counted)})
    try:
        parts = reader.partitions()
        found = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    finally:
        import zlib

        src.zlib = zlib
    return found, len(parts), count[0]


def test_whole_file_in_parts(bam, rows):
    one, parts, blocks = reads({"split": str(1 << 40)}, bam)
    many, more, _ = reads({"split": "20000"}, bam)
    assert parts == 1 and more > 5 and blocks > 20
    assert [r["read_id"] for r in one] == [r["read_id"] for r in many] and len({r["read_id"] for r in one}) == len(rows)
    assert sorted(r["qname"] for r in one) == sorted(r["qname"] for r in rows)
    assert [(r["tid"], r["pos"]) for r in one if r["tid"] >= 0] == sorted((r["tid"], r["pos"]) for r in rows if r["tid"] >= 0)
    by_name = {r["qname"]: r for r in rows}
    assert all(r["seq"] == by_name[r["qname"]]["seq"] and r["cigar"] == by_name[r["qname"]]["cigar"] for r in one)


def test_ranges_inflate_only_their_blocks(bam, rows):
    rng = random.Random(2)
    _, _, all_blocks = reads({}, bam)
    end = lambda r: r["pos"] + sum(n for op, n in out.cigar_ops(r["cigar"]) if op in "MDN")
    few = 0
    for _ in range(25):
        tid = rng.choice([0, 0, 1, 2])
        beg = rng.randrange(0, CONTIGS[tid][1])
        fin = beg + rng.choice([1, 500, 20_000])
        found, _, blocks = reads({"tid": str(tid), "beg": str(beg), "fin": str(fin), "split": "30000"}, bam)
        want = [r["qname"] for r in rows if r["tid"] == tid and r["pos"] < fin and end(r) > beg]
        assert sorted(r["qname"] for r in found) == sorted(want)
        few += blocks < all_blocks / 3
    assert few > 15
    assert reads({"tid": "2"}, bam)[:2] == ([], 0)


def test_filters_reach_the_index(spark, bam, rows):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = src.read_bam(spark, bam, split=20_000)
        ids = {r.qname: r.read_id for r in found.select("qname", "read_id").collect()}
        some = found.filter("tid = 0 AND pos >= 100000 AND pos < 120000").select("qname", "read_id").collect()
        assert {r.qname for r in some} == {r["qname"] for r in rows if r["tid"] == 0 and 100_000 <= r["pos"] < 120_000} and some
        assert all(ids[r.qname] == r.read_id for r in some)
        assert found.filter("pos < 0").count() == 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    reader = src.FilteringBamReader({"path": bam, "split": "20000"})
    whole = len(reader.partitions())
    asked = [EqualTo(("tid",), 0), GreaterThanOrEqual(("pos",), 100_000), LessThan(("pos",), 101_000)]
    assert list(reader.pushFilters(asked)) == asked and 0 < len(reader.partitions()) < whole


def test_a_failed_job_leaves_nothing(spark, rows, tmp_path):
    from pyspark.sql import functions as F

    names = [c.split()[0] for c in ALIGNMENT.split(", ")]
    table = out.stripped(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ALIGNMENT).repartition(4))
    bad = table.withColumn("hp", F.when(F.col("qname") == "r300", F.raise_error(F.lit("no"))).otherwise(F.col("hp")).cast("int"))
    for one in (True, False):
        with pytest.raises(Exception):
            out.write_bam(bad, str(tmp_path / f"x{one}"), CONTIGS, one_file=one)
        assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
    out.write_bam(table.limit(0), str(tmp_path / "none.bam"), CONTIGS, one_file=True)
    assert src.read_bam(spark, str(tmp_path / "none.bam")).count() == 0


def test_files_without_an_index_and_whole_files_give_the_same_ids(spark, bam, tmp_path):
    import shutil

    shutil.copy(bam, tmp_path / "bare.bam")
    want = sorted((r.qname, r.read_id) for r in src.read_bam(spark, bam).select("qname", "read_id").collect())
    assert sorted((r.qname, r.read_id) for r in src.read_bam(spark, str(tmp_path / "bare.bam")).select("qname", "read_id").collect()) == want
    assert sorted((r.qname, r.read_id) for r in src._read_whole(spark, bam, 0, 64).select("qname", "read_id").collect()) == want
    assert src.index_of(str(tmp_path / "bare.bam")) is None


def test_bins():
    rng = random.Random(3)
    for _ in range(200):
        beg = rng.randrange(1 << 28)
        fin = beg + rng.choice([1, 100, 1 << 15, 1 << 22])
        b = bin_of(beg, fin)
        assert b in bins_over(beg, fin) and b in bins_over(max(0, beg - 5), fin + 5) and 0 <= b < 37449
    assert bin_of(0, 1) == 4681 and bin_of(0, 1 << 14) == 4681 and bin_of(0, (1 << 14) + 1) == 585


def test_index_bytes_and_parts():
    a, b = Index(2), Index(2)
    a.add(0, 5, 50, 1 << 16, 2 << 16)
    a.add(0, 20, 3 << WINDOW, 2 << 16, 3 << 16 | 7)
    b.add(1, 9, 10, 1 << 16, 1 << 16 | 90)
    whole = Index.parse(a.bytes())
    assert [c.bins for c in whole.contigs] == [c.bins for c in a.contigs] and whole.contigs[0].windows == [1 << 16, 2 << 16, 2 << 16]
    whole.append(Index.parse(b.bytes()), 99)
    assert whole.stretches(1, 0, 100) == [(100 << 16, 100 << 16 | 90)] and whole.stretches(0, 1 << WINDOW, (1 << WINDOW) + 1) == [(2 << 16, 3 << 16 | 7)]
    assert whole.stretches(7, 0, 1) == [] and whole.cuts() == [1 << 16, 2 << 16, 100 << 16]
    assert cut((None, None), whole.cuts(), 50) == [(None, 100 << 16), (100 << 16, None)] and cut((1 << 16, 2 << 16), whole.cuts(), 1) == [(1 << 16, 2 << 16)]
    with pytest.raises(ValueError):
        Index.parse(b"BAM\x01....")


def test_simulated_reads_survive(spark, tmp_path):
    ref = simulate.genome(20_000)
    table = spark.createDataFrame([tuple(a.values()) for a in simulate.alignments(ref, simulate.variants(ref, 400))], ALIGNMENT)
    out.write_bam(out.stripped(table), str(tmp_path / "s.bam"), [("chr1", 20_000)], one_file=True)
    columns = ["qname", "flag", "tid", "pos", "mapq", "cigar", "seq"]
    again = src.read_bam(spark, str(tmp_path / "s.bam"), split=5000)
    assert sorted(map(tuple, again.select(columns).collect())) == sorted(map(tuple, table.select(columns).collect()))
