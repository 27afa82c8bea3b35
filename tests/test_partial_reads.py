"""Reads that reach only one end of a noisy region: alignment, consensus, alleles and coverage."""
from types import SimpleNamespace

import pytest

from haploweave.functions.repeats import Window
from haploweave.operators import recall
from haploweave.operators.align import prefix_reached, suffix_reached
from haploweave.operators.poa import consensus
from haploweave.options import Options
from haploweave.plans import simulate

O = Options()
REF = simulate.genome(400, 21)
OTHER = {b: "ACGT"["ACGT".index(b) - 1] for b in "ACGT"}


def test_parts_reached():
    assert prefix_reached(REF, REF[:90]) == 90 and suffix_reached(REF, REF[-70:]) == 70
    assert prefix_reached(REF, REF[:40] + REF[46:90]) == 90 and prefix_reached(REF, REF[:40] + "ACGT" + REF[40:90]) == 90
    assert prefix_reached(REF, "") == 0 and prefix_reached("", "ACGT") == 0
    long = simulate.genome(3000, 5)
    assert prefix_reached(long, long[:500] + long[560:1800]) == 1800 and suffix_reached(long, long[1200:]) == 1800


def test_partial_reads_outvote_the_errors_of_a_spanning_one():
    bad = REF[:50] + OTHER[REF[50]] + REF[51:300] + "TTT" + REF[300:]
    assert consensus([bad]) == bad
    assert consensus([bad], left=[REF[:120]] * 3, right=[REF[200:]] * 3) == REF


def made(seq, first, fin):
    """A read of one run of bases from first to fin (counted from 1)."""
    return {"beg": first, "fin": fin, "skipped": False, "seq": seq, "digars": [{"type": "EQ", "pos": first, "len": fin - first + 1, "qi": 0}]}


@pytest.mark.parametrize("middle, all_", [(REF[100:200], True), (REF[100:120] + "A" * 12 + REF[132:150], False)])
def test_coverage_counts_partial_reads(middle, all_):
    ref = REF[:100] + middle + REF[200:]
    beg, fin = 101, 100 + len(middle)
    at = beg + 14  # within the reach of left reads, out of that of right ones
    alt = ref[: at - 1] + OTHER[ref[at - 1]] + ref[at:]
    reads = []
    for hap in (ref, alt):
        # Two over the whole region: shorter reads do not count towards the reads that a phase set needs.
        reads += [made(hap, 1, len(ref))] * 2 + [made(hap[: at + 15], 1, at + 15)] * 3 + [made(hap[at + 5 :], at + 6, len(ref))] * 2
    phaser = SimpleNamespace(hap=[1] * 7 + [2] * 7, phase_set=[7] * 14)
    sites, shown = recall.call_region((beg, fin, 0), reads, phaser, Window(ref, 1), O)
    assert [(s["pos"], s["alt"], s["category"]) for s in sites] == [(at, alt[at - 1], "NOISY_CAND_HET")]
    assert sites[0]["allele_covs"] == ([5, 5] if all_ else [2, 2])
    assert [x is not None and x.get(0) for x in shown[2:5]] == ([0] * 3 if all_ else [False] * 3)
