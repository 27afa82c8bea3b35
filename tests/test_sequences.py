"""Events, sites, noise, phase, stitching and recall on hand-made reads."""
import pytest

from haploweave.functions.repeats import Window
from haploweave.operators import classify, digars, phase, recall, sites, stitch
from haploweave.operators.align import align, gapped
from haploweave.operators.poa import consensus
from haploweave.options import Options
from haploweave.plans import simulate
from haploweave.plans.collect import process_tile
from haploweave.sinks import alignments as out

O = Options()
REF = "ACGTACGTTGCAGGATCCATTACGGATTACA"


def aln(cigar, seq, pos=0, **more):
    base = {"read_id": 1, "qname": "r", "flag": 0, "tid": 0, "chrom": "c", "pos": pos, "mapq": 60, "cigar": cigar, "seq": seq, "qual": bytes([30] * len(seq)), "nm": None, "md": None, "cs": None, "sa": None, "hs": [], "input_idx": 0}
    return base | more


def brief(p):
    return [(d["type"], d["pos"], d["len"], d["qi"], d["alt"]) for d in p["digars"]]


def test_four_encodings_give_the_same_events():
    # Mismatch at 5, insertion of TT before 10, deletion of 14-15.
    seq = REF[:4] + "G" + REF[5:9] + "TT" + REF[9:13] + REF[15:25]
    window = Window(REF, 1)
    eqx = digars.parse(aln("4=1X4=2I4=2D10=", seq), 100, None, O)
    cs = digars.parse(aln("9M2I4M2D10M", seq, cs=f":4*ag:4+tt:4-{REF[13:15].lower()}:10"), 100, None, O)
    md = digars.parse(aln("9M2I4M2D10M", seq, md=f"4A8^{REF[13:15]}10"), 100, None, O)
    ref = digars.parse(aln("9M2I4M2D10M", seq), 100, window, O)
    want = [("SNP", 5, 1, 4, "G"), ("INS", 10, 2, 9, "TT"), ("DEL", 14, 2, 15, "")]
    for p in (eqx, cs, md, ref):
        assert [(t, a, b, c, x.upper()) for t, a, b, c, x in brief(p) if t != "EQ"] == want
        assert p["events"] == 3 and p["fin"] == 25
    assert [x for x in brief(cs) if x[0] == "INS"][0][4] == "tt"  # the tag's letter case stays


def test_malformed_tag_falls_back_and_keeps_its_count():
    seq = REF[:4] + "G" + REF[5:20]
    p = digars.parse(aln("20M", seq, cs=":4*ag:4?"), 100, Window(REF, 1), O)
    assert [x[:2] for x in brief(p) if x[0] != "EQ"] == [("SNP", 5)] and p["events"] == 2


def test_low_quality_rules():
    seq = REF[:10] + "TT" + REF[10:20]
    q = bytes([30] * 10 + [5, 30] + [30] * 10)
    low = lambda cigar, seq, qual: [d["low_quality"] for d in digars.parse(aln(cigar, seq, qual=qual), 100, None, O)["digars"] if d["type"] not in ("EQ",)]
    assert low("10=2I10=", seq, q) == [False]  # one good base is enough
    assert low("10=2I10=", seq, bytes([30] * 10 + [5, 5] + [30] * 10)) == [True]
    assert low("10=2D8=", REF[:10] + REF[12:20], bytes([30] * 9 + [5] + [30] * 8)) == [True]  # either side


def test_noise_window():
    n = digars.Noise(100, 5)
    for e in ((100, 1, 1), (120, 0, 2), (150, 3, 3)):
        n.observe(*e)
    n.close()
    assert n.found == [(100, 153, 54)]
    n = digars.Noise(100, 5)
    for e in ((100, 1, 1), (120, 0, 2), (450, 3, 3)):
        n.observe(*e)
    n.close()
    assert n.found == []


def test_clips_and_palindromes():
    p = digars.parse(aln("40S10=", "A" * 50, pos=500), 10_000, None, O)
    assert p["noisy"] == [(501, 601, 0)] and p["events"] == 1
    assert digars.parse(aln("40S10=", "A" * 50, pos=5), 10_000, None, O)["noisy"] == []
    ont = Options(technology="ont")
    a = aln("40S10=", "A" * 50, pos=500, sa="c,495,+,20M30S,60,0;", flag=16)
    p = digars.parse(a, 10_000, None, ont)
    assert p["palindrome"] and p["noisy"] == []
    assert not digars.is_palindrome("c", 501, 510, "d,495,+,20M,60,0;")


def site(pos, kind="SNP", ref_len=1, alt="A", **more):
    return {"pos": pos, "type": kind, "ref_len": ref_len, "alt": alt} | more


def test_order_and_fuzzy_insertions():
    ins = lambda n: site(50, "INS", 0, "A" * n)
    assert sites.compare_fuzzy(ins(52), ins(55), 30) == 0
    assert sites.compare_fuzzy(ins(1), site(50, "INS", 0, "T"), 30) < 0
    assert sites.compare_fuzzy(ins(40), ins(60), 30) != 0
    found = sites.collapse([ins(55), ins(52), site(49), site(50, "DEL", 2, ""), ins(90)], 30)
    assert [(s["type"], len(s["alt"])) for s in found] == [("INS", 52), ("INS", 90), ("DEL", 0), ("SNP", 1)]


def made(events, beg=1, fin=200, **more):
    """A read with the given events on a background of matches."""
    q = bytes([30] * 400)
    ds = [{"pos": p, "type": t, "len": n, "qi": p, "low_quality": False, "alt": a} for p, t, n, a in events]
    return {"read_id": 0, "qname": "r", "beg": beg, "fin": fin, "rev": False, "mapq": 60, "nm": 0, "qual": q, "digars": ds, "noisy": [], "events": 0, "palindrome": False, "skipped": False, "input_idx": 0, "seq": "A" * 400} | more


def test_counts():
    reads = [made([(50, "SNP", 1, "A")]), made([(50, "SNP", 1, "C")], rev=True), made([], fin=60), made([(50, "SNP", 1, "A")], qual=bytes([3] * 400))]
    table = [site(50), site(80)]
    log = sites.count(reads, table, O)
    assert (table[0]["total_cov"], table[0]["alt_cov"], table[0]["low_qual_cov"], table[0]["reverse_ref"]) == (3, 1, 1, 1)
    assert table[1]["total_cov"] == 3 and len(log) == 7  # the third read ends before the second site


def test_post_process_chain():
    table = [site(p, category="CLEAN_HET_SNP") for p in (1110, 1119, 1128, 1135, 1157)]
    assert classify.post_process([(999, 1100, 5)], table, O) == [(990, 1145, 5)]
    assert classify.post_process([(999, 1100, 5)], [], O) == [(990, 1110, 5)]


def test_containment():
    table = [site(100, category="CLEAN_HET_SNP"), site(101, "DEL", 30, "", category="CLEAN_HOM"), site(115, "INS", 0, "T", category="CLEAN_HET_INDEL")]
    classify.contain(table, [(99, 120, 1)])
    assert [s["category"] for s in table] == ["NON_VAR", "CLEAN_HOM", "NON_VAR"]


def two_haplotypes():
    table = [site(p, category="CLEAN_HET_SNP", ref_cov=3, alt_cov=3, total_cov=6) for p in (50, 90, 130)]
    reads = [made([(50, "SNP", 1, "A"), (130, "SNP", 1, "A")], qname=f"a{i}") for i in range(3)] + [made([(90, "SNP", 1, "A")], qname=f"b{i}") for i in range(3)]
    return table, reads


def test_phasing():
    table, reads = two_haplotypes()
    p = phase.phase(table, phase.read_order(reads), O)
    assert len(set(p.hap[:3])) == 1 and len(set(p.hap[3:])) == 1 and set(p.hap) == {1, 2}
    assert {s["phase_set"] for s in table} == {50} == set(p.phase_set)
    assert table[0]["hap_alt"] == table[2]["hap_alt"] == 3 - table[1]["hap_alt"]


def test_phase_set_breaks_without_links():
    table, reads = two_haplotypes()
    for r in reads:
        r["digars"] = [d for d in r["digars"] if d["pos"] < 120]
        r["fin"] = 100
    far = [made([(130, "SNP", 1, "A")] * (i % 2), beg=110, fin=200, qname=f"c{i}") for i in range(6)]
    phase.phase(table, phase.read_order(reads + far), O)
    assert [s["phase_set"] for s in table] == [50, 50, 130]


def tile(phase_sets, hap, ps, up=(), down=(), skipped=()):
    return stitch.Tile([{"phase_set": x, "cons": [0, 1, 0]} for x in phase_sets], [{"skipped": i in skipped} for i in range(len(hap))], hap, ps, up, down)


def test_stitching_flips_and_renames():
    a, b = tile([10], [1, 2], [10, 10], down=[0, 1]), tile([20], [2, 1], [20, 20], up=[0, 1])
    assert stitch.stitch_pair(a, b, True)
    assert b.sites[0] == {"phase_set": 10, "cons": [0, 0, 1]} and b.hap == [1, 2] and b.phase_set == [10, 10]


def test_stitching_tie_changes_nothing():
    a, b = tile([10], [1, 2], [10, 10], down=[0, 1]), tile([20], [2, 2], [20, 20], up=[0, 1])
    assert not stitch.stitch_pair(a, b, True)
    assert b.sites[0] == {"phase_set": 20, "cons": [0, 1, 0]}


def test_stitching_ignores_skipped_reads():
    a, b = tile([10], [1, 1], [10, 10], down=[0, 1], skipped={1}), tile([20], [1, 2], [20, 20], up=[0, 1])
    assert stitch.stitch_pair(a, b, True)
    assert b.sites[0] == {"phase_set": 10, "cons": [0, 1, 0]}
    with pytest.raises(RuntimeError):
        stitch.stitch_pair(tile([10], [1], [10], down=[0]), tile([20], [1, 1], [20, 20], up=[0, 1]), True)


def test_thread_fold():
    blocks = [(10, {1: [3, 0], 2: [0, 3]}), (20, {1: [0, 4], 2: [5, 0]}), (30, {9: [4, 0]})]
    assert stitch.fold_blocks(blocks, 2, 2) == {20: (10, True)}
    assert stitch.decide({1: [3, 0]}, {1: [3, 0]}, 2, 2) is None  # too few threads


def test_alignment_and_consensus():
    assert gapped("ACGTACGTTTTACG", "ACGTACGTTACG") == ("ACGTACGTTTTACG", "ACGTACG--TTACG")
    assert align("", "AC") == [(-1, 0), (-1, 1)]
    truth = simulate.genome(120, 9)
    reads = [truth[:k] + "ACGT"[(k * 7) % 4] + truth[k + 1 :] for k in range(10, 100, 10)]
    assert consensus(reads) == truth


def test_recall_in_a_noisy_region():
    """Dense differences on one haplotype become noise, and come back as sites of the region."""
    ref = simulate.genome(4000, 4)
    calls = [(1000, ref[999], "ACGT"[("ACGT".index(ref[999]) + 1) % 4], 1), (3000, ref[2999], "ACGT"[("ACGT".index(ref[2999]) + 1) % 4], 2)]
    calls += [(p, ref[p - 1], "ACGT"[("ACGT".index(ref[p - 1]) + 2) % 4], 1) for p in range(2000, 2048, 6)]
    reads = []
    for a in simulate.alignments(ref, calls, size=3000, depth=30):
        p = digars.parse(a, len(ref), None, O)
        p["noisy"] = [{"beg": b, "fin": f, "label": n} for b, f, n in p["noisy"]]
        reads.append({k: a[k] for k in ("read_id", "qname", "mapq", "nm", "input_idx", "seq", "qual", "hs")} | p | {"rev": False, "in_prev": False, "in_next": False})
    made_ = process_tile(reads, Window(ref, 1), 1, len(ref), O)
    found = {(s["pos"], s["alt"]): s for s in made_["sites"]}
    assert {(p, b) for p, _, b, _ in calls} <= set(found)
    noisy = [found[(p, b)] for p, _, b, _ in calls if 2000 <= p < 2048]
    assert {s["category"] for s in noisy} == {"NOISY_CAND_HET"} and {s["init_category"] for s in noisy} == {"LOW_COV"}
    assert len({tuple(s["cons"][1:]) for s in noisy}) == 1 and made_["noisy"]
    assert found[(1000, calls[0][2])]["cons"] == noisy[0]["cons"] or found[(1000, calls[0][2])]["cons"][1:] == noisy[0]["cons"][1:]


def test_read_alleles():
    s = site(5, "DEL", 3, "")
    assert recall.read_allele("AACCGGTTAA", "AACCTAA", 1, s, O) == 1
    assert recall.read_allele("AACCGGTTAA", "AACCGGTTAA", 1, s, O) == 0
    assert recall.read_allele("AACCGG", "AACTGG", 1, site(4, alt="T"), O) == 1
    assert recall.read_allele("AACCGG", "AACCTTGG", 1, site(5, "INS", 0, "TT"), O) == 1
    assert recall.read_allele("AACCGG", "AACCGG", 1, site(5, "INS", 0, "TT"), O) == 0


def test_tags_of_refined_alignments():
    seq = REF[:4] + "G" + REF[5:9] + "TT" + REF[9:13] + REF[15:25]
    a = aln("5H9M2I4M2D10M", seq, md="x", nm=0, cs=None)
    p = digars.parse(aln("4=1X4=2I4=2D10=", seq), 100, None, O)
    made_ = out.refined(a, p["digars"], Window(REF, 1))
    assert made_["cigar"] == "4=1X4=2I4=2D10=" and made_["nm"] == 5 and made_["md"] == f"4A8^{REF[13:15]}10" and made_["cs"] is None and made_["pos"] == 0
    assert out.cs_tag(p["digars"], Window(REF, 1), seq) == f":4*ag:4+tt:4-{REF[13:15].lower()}:10"
    read = p | {"seq": seq}
    # Aligned anew the insertion stands leftmost, two bases before.
    assert [(d["type"], d["pos"], d["len"]) for d in out.rewrite(read, [(3, 12)], Window(REF, 1), O) if d["type"] != "EQ"] == [("SNP", 5, 1), ("INS", 8, 2), ("DEL", 14, 2)]


def test_multi_tile_stitching_follows_reads(spark):
    from haploweave.plans.collect import collect_variation
    from haploweave.plans.queries import simulated

    found = collect_variation(spark, *simulated(spark), Options(chunk_size=10_000, output_alignment=True)).candidates
    assert found.filter("category like '%HET%' and total_cov >= 10").select("phase_set").distinct().count() == 1


def test_threads_join_phase_sets_that_no_read_links(spark):
    from haploweave.plans.collect import collect_variation
    from haploweave.schemas import ALIGNMENT

    ref = simulate.genome(20_000)
    rows = [a | {"hs": [a["read_id"] % 2, 7]} for a in simulate.alignments(ref, simulate.variants(ref, 400)) if a["pos"] + 3000 < 9000 or a["pos"] > 9000]
    reads = spark.createDataFrame([tuple(a.values()) for a in rows], ALIGNMENT)
    tiles = spark.createDataFrame(simulate.reference_rows(ref), "chrom string, tile long, beg long, seq string")
    contigs = spark.createDataFrame([(0, "chr1", len(ref))], "tid int, name string, len long")
    threads = spark.createDataFrame([(0, 100), (0, 101), (1, 200), (1, 201), (1, 100)], "set_id long, thread long")
    sets = lambda **more: {r[0] for r in collect_variation(spark, reads, tiles, contigs, Options(**more.pop("o", {})), **more).candidates.filter("category like '%HET%'").select("phase_set").distinct().collect()}
    apart, joined = sets(), sets(sidecar=threads)
    assert len(apart) == 2 and joined == {min(apart)}
    far = sets(sidecar=threads, o={"chunk_size": 9000})
    assert far == {min(apart)}


def test_long_alignments_are_cut_at_shared_words():
    a = simulate.genome(3000, 12)
    b = a[:700] + a[760:1500] + "ACGTT" * 4 + a[1500:2000] + ("A" if a[2000] != "A" else "C") + a[2001:]
    x, y = gapped(a, b)
    assert x.replace("-", "") == a and y.replace("-", "") == b
    assert (y.count("-"), x.count("-"), sum(p != q for p, q in zip(x, y) if "-" not in (p, q))) == (60, 20, 1)
