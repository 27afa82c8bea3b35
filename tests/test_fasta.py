"""FASTA index and tiles over splits, against a plain reading of the file."""
import random

import pytest

from haploweave.sources import fasta, text


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def made(path, ending="\n", last=True):
    rng = random.Random(4)
    contigs = [("chr1 a long one", 6000, 60), ("chr2", 59, 60), ("tiny", 1, 60), ("none", 0, 60), ("chr3", 1201, 80)]
    body, index, truth = b"", [], {}
    for name, size, width in contigs:
        seq = "".join(rng.choice("ACGTacgtNRY") for _ in range(size))
        body += f">{name}{ending}".encode()
        lines = [seq[i : i + width] for i in range(0, size, width)]
        index.append((name.split()[0], size, len(body), len(lines[0]) if lines else 0, len(lines[0]) + len(ending) if lines else 0))
        body += "".join(x + ending for x in lines).encode()
        truth[name.split()[0]] = "".join(c if c in "ACGT" else "N" for c in seq.upper())
    path.write_bytes(body if last else body[: -len(ending)])
    return index, truth


@pytest.mark.parametrize("ending, last", [("\n", True), ("\r\n", True), ("\n", False)])
def test_index_is_as_made_by_hand(spark, small_splits, tmp_path, ending, last):
    want, _ = made(tmp_path / "x.fa", ending, last)
    found = fasta.stretches(spark, str(tmp_path / "x.fa"))
    assert found.select("split").distinct().count() > 8  # a contig is in many splits
    lines = [r.value for r in fasta.index_lines(spark, str(tmp_path / "x.fa")).collect()]
    assert lines == ["\t".join(map(str, r)) for r in want]
    (tmp_path / "x.fa.fai").write_text("\n".join(lines))
    loaded = text.fasta_index(spark, str(tmp_path / "x.fa.fai"))
    built = text.fasta_index(spark, str(tmp_path / "y.fa.fai")) if (tmp_path / "x.fa").rename(tmp_path / "y.fa") else None
    assert sorted(map(tuple, loaded.collect())) == sorted(map(tuple, built.collect())) == [(i, r[0], r[1]) for i, r in enumerate(want)]


@pytest.mark.parametrize("tile", [100, 64, 10_000])
def test_tiles_hold_all_bases_once(spark, small_splits, tmp_path, tile):
    _, truth = made(tmp_path / "x.fa")
    rows = text.fasta_tiles(spark, str(tmp_path / "x.fa"), tile).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.chrom, r.tile)):
        assert r.beg == r.tile * tile + 1 and len(r.seq) <= tile
        got[r.chrom] = got.get(r.chrom, "") + r.seq
    assert got == {k: v for k, v in truth.items() if v}
    assert len({(r.chrom, r.tile) for r in rows}) == len(rows)


def test_lines_before_the_first_header_are_none(spark, tmp_path):
    (tmp_path / "x.fa").write_text("ACGT\n\n>a\nAC\n\nGT\n>b\n")
    assert [tuple(r) for r in text.fasta_tiles(spark, str(tmp_path / "x.fa"), 3).orderBy("tile").select("chrom", "tile", "seq").collect()] == [("a", 0, "ACG"), ("a", 1, "T")]
    assert [r.value for r in fasta.index_lines(spark, str(tmp_path / "x.fa")).collect()] == ["a\t4\t9\t2\t3", "b\t0\t19\t0\t0"]
    (tmp_path / "none.fa").write_text("")
    assert text.fasta_tiles(spark, str(tmp_path / "none.fa")).count() == 0
