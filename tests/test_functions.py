import random

import pytest

from haploweave.functions import dust, fisher, repeats, scalar
from haploweave.operators.ranges import cluster
from haploweave.options import Options, parse_arguments


def test_fisher():
    assert fisher.fisher_two_tailed(0, 0, 0, 0) == 1.0
    assert fisher.fisher_two_tailed(3, 1, 1, 3) == pytest.approx(34 / 70)
    assert fisher.strand_pvalue(1, 0) == 1.0
    assert fisher.strand_pvalue(10, 0) == pytest.approx(0.0325077, abs=1e-6)


@pytest.mark.parametrize(
    "kind, pos, ref_len, alt, seq, expected",
    [
        ("DEL", 5, 1, "", "GCTAAAAAAAGC", True),
        ("INS", 5, 0, "CA", "GGTGCACACACAGT", True),
        ("INS", 6, 0, "G", "ACGTTGCATGCCGATTAC", False),
        ("DEL", 4, 6, "", "ACGAAAAAAAAAAAAAAAAAAA", False),  # longer than five bases
        ("SNP", 5, 1, "T", "AAAAAAAAAAAA", False),
        ("DEL", 5, 2, "", "GCGTATATATATATGC", True),
    ],
)
def test_repeats(kind, pos, ref_len, alt, seq, expected):
    assert repeats.is_repeat_indel(kind, pos, ref_len, alt, repeats.Window(seq, 1), 5) is expected


def brute_dust(seq, threshold, window):
    """Every interval whose score is above the threshold and that of none inside."""
    words = [seq[i : i + 3] for i in range(len(seq) - 2)]

    def score(a, b):
        counts = {}
        for w in words[a : b + 1]:
            counts[w] = counts.get(w, 0) + 1
        return sum(n * (n - 1) // 2 for n in counts.values()) / (b - a) if b > a else 0.0

    masked = set()
    for a in range(len(words)):
        for b in range(a + 1, min(len(words), a + window - 2)):
            s = score(a, b)
            if 10 * s > threshold and all(score(x, y) <= s + 1e-12 for x in range(a, b + 1) for y in range(x + 1, b + 1)):
                masked |= set(range(a, b + 3))
    return masked


def test_dust_against_definition():
    r = random.Random(5)
    for _ in range(25):
        seq = "".join(r.choice("ACGT") for _ in range(30))
        at = r.randrange(30)
        seq = seq[:at] + r.choice(["A" * 9, "CA" * 6, "ACT" * 5]) + seq[at:]
        found = dust.low_complexity(seq, 5, 20)
        assert {i - 1 for b, e in found for i in range(b, e + 1)} == brute_dust(seq, 5, 20)
    assert dust.low_complexity("ACGTNNNNACGT") == []


def test_cluster_fixpoint():
    assert cluster([(0, 10, 5), (14, 20, 9), (40, 50, 1)]) == [(0, 20, 9), (40, 50, 1)]
    assert cluster([(0, 10, 5), (16, 20, 9)]) == [(0, 10, 5), (16, 20, 9)]
    # The first merge makes a label that reaches further in the next pass.
    assert cluster([(0, 10, 2), (11, 12, 30), (40, 45, 29)]) == [(0, 45, 30)]
    assert cluster([(5, 9, 1), (9, 12, 1)], window=0) == [(5, 12, 1)]
    assert cluster([]) == []


def test_six_digits(spark):
    from pyspark.sql import functions as F

    values = [0.0, 1.0, 1 / 3, 0.8, 2 / 7, 1 / 30, 0.123456789, 5 / 11, 0.05]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", scalar.six_digits_column(F.col("x")).alias("s")).collect()
    assert [(r.x, r.s) for r in rows] == [(v, scalar.six_digits(v)) for v in values]
    assert scalar.six_digits(1 / 3) == "0.333333"


def test_options():
    assert Options().noise_window == 100 and Options(technology="ont").noise_window == 25
    for bad in ({"min_af": 0.9}, {"chunk_size": 0}, {"technology": "sanger"}, {"min_mapq": -1}, {"refine_aln": True}):
        with pytest.raises(ValueError):
            Options(**bad)
    o, paths = parse_arguments(["ref.fa", "in.bam", "chr1:1-5", "--ont", "-q", "20", "--min-af", "0.1", "-r", "chr2", "-o", "x.tsv", "-S", "x.sam"])
    assert (o.technology, o.min_mapq, o.min_af, o.regions, o.output_alignment, paths["output"]) == ("ont", 20, 0.1, ("chr1:1-5", "chr2"), True, "x.tsv")
    o, _ = parse_arguments(["r", "i", "--pgbam-file", "x", "--pgbam-cleanup-margin", "3", "--no-pgbam-relaxed-cleanup-pass"])
    assert (o.sidecar_file, o.thread_cleanup_margin, o.thread_relaxed_cleanup_pass) == ("x", 3, False)
    with pytest.raises(SystemExit):
        parse_arguments(["ref.fa", "in.bam", "--ont", "--hifi"])
