"""Wavefronts, edit distance, partial-order alignment and its groups against plain dynamic programs."""
import itertools
import random
from types import SimpleNamespace

import pytest

from haploweave.functions.repeats import Window
from haploweave.operators import recall
from haploweave.operators.align import align, alike, differences, edit_steps, gap_cost, one_sided
from haploweave.operators.poa import GAP, Graph, joined, trimmed
from haploweave.options import Options
from haploweave.plans import simulate

O = Options()
PIECES = ((O.gap_open1, O.gap_ext1), (O.gap_open2, O.gap_ext2))


def altered(s, rate, rng):
    out = []
    for c in s:
        u = rng.random()
        if u < rate / 3:
            out.append(rng.choice("ACGT"))
        elif u >= 2 * rate / 3:
            out.append(c if u >= rate else c + "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 40) if rng.random() < 0.1 else 1)))
    return "".join(out)


def plain_penalty(a, b):
    """Least penalty of a global alignment by the full table."""
    far = 10**9
    best = [[far] * (len(b) + 1) for _ in range(len(a) + 1)]
    gaps = [[[[far] * (len(b) + 1) for _ in range(len(a) + 1)] for _ in range(2)] for _ in PIECES]
    best[0][0] = 0
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        for (opening, ext), (down, across) in zip(PIECES, gaps):
            if i:
                down[i][j] = min(best[i - 1][j] + opening, down[i - 1][j]) + ext
            if j:
                across[i][j] = min(best[i][j - 1] + opening, across[i][j - 1]) + ext
            best[i][j] = min(best[i][j], down[i][j], across[i][j])
        if i and j:
            best[i][j] = min(best[i][j], best[i - 1][j - 1] + O.mismatch * (a[i - 1] != b[j - 1]))
    return best[-1][-1]


def penalty(pairs, a, b):
    kinds = ["D" if j < 0 else "I" if i < 0 else "M" for i, j in pairs]
    total = sum(O.mismatch for i, j in pairs if i >= 0 and j >= 0 and a[i] != b[j])
    return total + sum(gap_cost(len(list(run)), O) for kind, run in itertools.groupby(kinds) if kind != "M")


@pytest.mark.parametrize("seed", range(6))
def test_wavefronts_find_the_least_penalty(seed):
    rng = random.Random(seed)
    for _ in range(12):
        a = "".join(rng.choice("ACGT"[: rng.choice([2, 4])]) for _ in range(rng.randint(1, 60)))
        b = altered(a, rng.choice([0, 0.05, 0.2, 0.6]), rng) or "A"
        want = plain_penalty(a, b)
        for left in (True, False):
            pairs = align(a, b, O, left)
            assert [i for i, _ in pairs if i >= 0] == list(range(len(a))) and [j for _, j in pairs if j >= 0] == list(range(len(b)))
            assert penalty(pairs, a, b) == want


def test_gaps_stand_left_or_right():
    assert [i for i, j in align("CAAAAG", "CAAG", O) if j < 0] == [1, 2] and [i for i, j in align("CAAAAG", "CAAG", O, gaps_left=False) if j < 0] == [3, 4]
    assert align("ACGT", "ACGT") == [(k, k) for k in range(4)]


def test_long_sequences_need_no_cuts():
    a = simulate.genome(30_000, 8)
    b = a[:9000] + simulate.genome(3000, 9) + a[9000:20_000] + a[20_400:]
    pairs = align(a, b)
    assert penalty(pairs, a, b) == gap_cost(3000, O) + gap_cost(400, O)


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(200):
        a = "".join(rng.choice("ACGT"[: rng.choice([2, 4])]) for _ in range(rng.randint(0, 50)))
        b = altered(a, rng.choice([0, 0.1, 0.5]), rng)
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        steps = edit_steps(a, b)
        assert len(steps) - steps.count("=") == row[-1] and len(steps) - steps.count("I") == len(a) and len(steps) - steps.count("D") == len(b)
        i = j = 0
        for s in steps:
            assert s in "DI" or (a[i] == b[j]) == (s == "=")
            i, j = i + (s != "I"), j + (s != "D")
    assert differences("ACGTACGTAA", "ACGTTTTACGTAA") == 1 and differences("AAAA", "ATAT") == 2 and differences("", "") == 0


def test_gates_of_sequences_that_reach_one_end():
    ref = simulate.genome(300, 31)
    assert one_sided(ref, ref[:120], True) == (0, 120, 0, 120) and one_sided(ref, ref[-120:], False) == (180, 300, 0, 120)
    # The other sequence may be longer by a tenth and no more: what lies beyond is cut before it is aligned.
    assert one_sided(ref, ref[:100] + ref[120:200], True)[1] <= int(180 * O.partial_ratio)
    # A tenth of differences passes, more does not.
    other = {b: "ACGT"["ACGT".index(b) - 1] for b in "ACGT"}
    few = "".join(other[c] if k % 11 == 5 else c for k, c in enumerate(ref[:110]))
    many = "".join(other[c] if k % 8 == 5 else c for k, c in enumerate(ref[:110]))
    assert differences(ref[:110], few) == 10 and one_sided(ref, few, True) is not None
    assert not alike(ref[:110], many) and one_sided(ref, many, True) is None
    # The parts end with the last match.
    assert one_sided(ref[:101], ref[:100] + other[ref[100]], True) == (0, 100, 0, 100)
    assert one_sided(ref[199:], other[ref[199]] + ref[200:], False) == (1, 101, 1, 101)
    assert one_sided("", "ACGT", True) is None and one_sided(ref, "", True) is None


def paths_of(graph):
    """All sequences that the graph spells from end to end."""
    begin, end = {p[0] for p in graph.paths}, {p[-1] for p in graph.paths}
    todo, found = [(v, graph.nodes[v].base) for v in begin], set()
    while todo:
        v, s = todo.pop()
        if v in end:
            found.add(s)
        todo += [(u, s + graph.nodes[u].base) for u in graph.nodes[v].out]
    return found


def plain_score(a, b):
    """Most that a global alignment scores: matches pay."""
    low = -(10**9)
    best = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    gaps = [[[[low] * (len(b) + 1) for _ in range(len(a) + 1)] for _ in range(2)] for _ in PIECES]
    best[0][0] = 0
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        for (opening, ext), (down, across) in zip(PIECES, gaps):
            if i:
                down[i][j] = max(best[i - 1][j] - opening, down[i - 1][j]) - ext
            if j:
                across[i][j] = max(best[i][j - 1] - opening, across[i][j - 1]) - ext
            best[i][j] = max(best[i][j], down[i][j], across[i][j])
        if i and j:
            best[i][j] = max(best[i][j], best[i - 1][j - 1] + (O.match if a[i - 1] == b[j - 1] else -O.mismatch))
    return best[-1][-1]


def score_of(pairs, graph, seq):
    kinds = ["D" if j < 0 else "I" if v < 0 else "M" for v, j in pairs]
    total = sum(O.match if graph.nodes[v].base == seq[j] else -O.mismatch for v, j in pairs if v >= 0 and j >= 0)
    return total - sum(gap_cost(len(list(run)), O) for kind, run in itertools.groupby(kinds) if kind != "M")


@pytest.mark.parametrize("seed", range(8))
def test_alignment_to_a_graph_is_that_to_its_best_path(seed):
    rng = random.Random(seed)
    truth = "".join(rng.choice("ACGT") for _ in range(rng.randint(4, 40)))
    graph = Graph(O)
    for k in range(5):
        seq = altered(truth, 0.15, rng) or "A"
        if k:
            pairs = graph._align(seq, 0, None)
            assert [j for _, j in pairs if j >= 0] == list(range(len(seq)))
            chain = [v for v, _ in pairs if v >= 0]
            assert all(v in graph.nodes[u].out for u, v in zip(chain, chain[1:]))
            assert score_of(pairs, graph, seq) == max(plain_score(p, seq) for p in paths_of(graph))
        graph.add(seq)
        assert [r.replace(GAP, "") for r in graph.rows()][-1] == seq
    assert all(len({graph.nodes[v].base for v in c}) == len(c) for c in graph.columns)
    place = {c: k for k, c in enumerate(graph.order)}
    assert all(place[graph.nodes[u].column] > place[n.column] for n in graph.nodes for u in n.out)


def test_the_band_loses_nothing():
    rng = random.Random(4)
    for _ in range(4):
        a = "".join(rng.choice("ACGT") for _ in range(300))
        cut = rng.randint(0, 200)
        b = altered(a[:cut] + a[cut + 90 :] + "".join(rng.choice("ACGT") for _ in range(80)), 0.05, rng)
        graph = Graph(O)
        graph.add(a)
        assert score_of(graph._align(b, 0, None), graph, b) == plain_score(a, b)


def test_consensus_is_the_majority_of_what_covers():
    ref = simulate.genome(200, 6)
    other = {b: "ACGT"["ACGT".index(b) - 1] for b in "ACGT"}
    reads = [ref[:k] + other[ref[k]] + ref[k + 1 :] for k in (20, 60, 100)] + [ref[:150] + "TT" + ref[150:], ref[:40] + ref[45:]]
    graph = joined([(r, True, True) for r in reads], O)
    assert graph.consensus().replace(GAP, "") == ref
    left = joined([(reads[0], True, True)] + [(ref[:90], True, False)] * 3, O)
    assert left.consensus().replace(GAP, "") == ref  # two thirds of the columns have one read, and keep it
    noise = simulate.genome(90, 77)
    out = joined([(ref, True, True), (noise, True, False)], O)
    assert out.paths[1] == [] and out.consensus() == ref
    assert joined([(ref, True, True), (simulate.genome(200, 78), True, True)], O, sampling=True).paths[1] == []


@pytest.mark.parametrize("seed", range(5))
def test_two_haplotypes_come_apart(seed):
    """Several differences of small share each would be told by none of them alone: reads have errors there too."""
    rng = random.Random(seed)
    one = simulate.genome(240, 50 + seed)
    other = {b: "ACGT"["ACGT".index(b) - 1] for b in "ACGT"}
    two = "".join(other[c] if k % 40 == 20 else c for k, c in enumerate(one))
    two = two[:130] + two[136:]
    truth, reads = [], []
    for k in range(18):
        hap = k % 2
        s = one if hap == 0 else two
        # At one place in six a read shows the other haplotype's base.
        s = "".join(other[c] if rng.random() < 0.01 else c for c in s)
        truth.append(hap)
        reads.append((s, True, True))
    order = sorted(range(18), key=lambda k: -len(reads[k][0]))
    graph = joined([reads[k] for k in order], O)
    groups = graph.clusters(O.min_af)
    assert sorted(sorted(order[k] for k in g) for g in groups) == [[k for k in range(18) if truth[k] == h] for h in (0, 1)]
    assert {graph.consensus(g).replace(GAP, "") for g in groups} == {one, two}


def test_no_groups_without_enough_reads():
    one = simulate.genome(100, 3)
    two = one[:50] + ("A" if one[50] != "A" else "C") + one[51:]
    assert joined([(one, True, True)] * 8 + [(two, True, True)], O).clusters(O.min_af) == [list(range(9))]
    assert joined([(one, True, True)] * 6, O).clusters(O.min_af) == [list(range(6))]
    assert len(joined([(one, True, True)] * 6 + [(two, True, True)] * 2, O).clusters(O.min_af)) == 2


def test_rows_of_partial_reads_are_trimmed():
    assert trimmed("ACG-T", "ACG-T", True, True) == ("ACGT", "ACGT", 0, 4)
    assert trimmed("ACGTT", "ACA--", True, False) == ("ACGTT", "AC---", 0, 2)
    assert trimmed("ACGTT", "-AGTT", False, True) == ("ACGTT", "--GTT", 2, 5)
    assert trimmed("AC", "GT", True, False)[2:] == (0, 0)


def test_order_of_reads_is_that_of_the_exchanges():
    clips = [recall.Clip(k, "A" * n, left, right, qual=bytes([q] * n)) for k, (n, left, right, q) in enumerate([(5, True, False, 30), (9, True, True, 10), (9, True, True, 30), (4, False, True, 40), (9, True, True, 30), (12, False, False, 9), (9, True, True, 10)])]
    # Of equal reads an exchange sort does not keep the input's order.
    assert [c.read for c in recall.clip_order(clips, sampling=False)] == [1, 2, 4, 6, 0, 3, 5]
    assert [c.read for c in recall.clip_order(clips, sampling=True)] == [2, 4, 1, 6, 0, 3, 5]
    rows = [(3, "a"), (1, "b"), (3, "c"), (0, "d")]
    assert recall.exchanged(rows, lambda x, y: x[0] > y[0]) == [(0, "d"), (1, "b"), (3, "c"), (3, "a")]
    assert recall.region_order([(1, 9, 2), (4, 5, 2), (0, 90, 1)]) == [(0, 90, 1), (4, 5, 2), (1, 9, 2)]


def clips_of(*rows):
    return [recall.Clip(k, "A" * n, left, right) for k, (n, left, right, *_) in enumerate(rows)], SimpleNamespace(hap=[r[3] for r in rows], phase_set=[r[4] for r in rows])


def test_short_partial_reads_do_not_vote_for_a_phase_set():
    whole = [(50, True, True, h, 7) for h in (1, 2)]
    assert recall.best_phase_set(*clips_of(*whole, (50, True, False, 1, 7), (60, False, True, 2, 7)), O) == 7
    assert recall.best_phase_set(*clips_of(*whole, (49, True, False, 1, 7), (60, False, True, 2, 7)), O) is None
    # A read before the first over the whole region never counts, and the shortest so far is what counts.
    assert recall.best_phase_set(*clips_of((50, True, False, 1, 7), *whole, (60, False, True, 2, 7)), O) is None
    assert recall.best_phase_set(*clips_of(*whole, (40, True, True, 1, 7), (45, True, False, 1, 7), (60, False, True, 2, 7)), O) == 7
    # Most full reads on the poorer haplotype, then on the richer; the first of equals, though it fall short.
    more = [(50, True, True, h, 9) for h in (1, 2, 2)]
    assert recall.best_phase_set(*clips_of(*whole, *more), O) is None and recall.best_phase_set(*clips_of(*whole, *whole, *more), O) == 7
    assert recall.best_phase_set([], SimpleNamespace(hap=[], phase_set=[]), O) is None


def test_a_deletion_over_the_border_is_a_gap_not_a_cover():
    read = {"beg": 1, "fin": 200, "seq": "A" * 180, "qual": b"", "digars": [{"type": "EQ", "pos": 1, "len": 90, "qi": 0}, {"type": "DEL", "pos": 91, "len": 20, "qi": 90}, {"type": "EQ", "pos": 111, "len": 90, "qi": 90}]}
    c = recall.clip(read, 0, 100, 150)
    assert (c.left, c.left_gap, c.right, c.right_gap, c.whole, c.full, len(c.seq)) == (False, True, True, False, True, False, 40)
    read["digars"][1]["len"] = 10
    assert recall.clip(read, 0, 100, 150).full


@pytest.mark.parametrize("seed", range(4))
def test_regions_without_a_phase_set_give_both_haplotypes(seed):
    """Planted differences on two haplotypes come back as sites, with the reads' alleles."""
    ref = simulate.genome(400, 200 + seed)
    other = {b: "ACGT"["ACGT".index(b) - 1] for b in "ACGT"}
    beg, fin = 101, 300
    at = [140, 165, 190, 230, 260]
    alt = "".join(other[c] if k + 1 in at else c for k, c in enumerate(ref))
    both = 275
    haps = [h[: both - 1] + other[ref[both - 1]] + h[both:] for h in (ref, alt)]
    reads = [{"beg": 1, "fin": 400, "skipped": False, "seq": haps[k % 2], "qual": b"", "digars": [{"type": "EQ", "pos": 1, "len": 400, "qi": 0}]} for k in range(12)]
    phaser = SimpleNamespace(hap=[0] * 12, phase_set=[-1] * 12)
    sites, shown = recall.call_region((beg, fin, 0), reads, phaser, Window(ref, 1), O)
    assert [(s["pos"], s["category"]) for s in sites] == [(p, "NOISY_CAND_HET") for p in at] + [(both, "NOISY_CAND_HOM")]
    assert [s["allele_covs"] for s in sites] == [[6, 6]] * 5 + [[0, 12]]
    assert [[p.get(i) for i in range(6)] for p in shown] == [[k % 2] * 5 + [1] for k in range(12)]


def test_alleles_are_read_off_rows():
    row = recall.Row("ACGTACGTACGTAA", "ACGTACGTACGTAA", 0, 14)
    ins = {"pos": 5, "type": "INS", "ref_len": 0, "alt": "ACGTACGTAC"}
    assert recall.allele(ins, row, 2, [], 1) == 1
    assert recall.allele(ins, recall.Row(row.cons, "ACTTACGTACGTAA", 0, 14), 2, [], 1) == 1  # nine in ten
    assert recall.allele(ins, recall.Row(row.cons, "ACTTTCGTACGTAA", 0, 14), 2, [], 1) == 0
    assert recall.allele(ins, recall.Row(row.cons, row.read, 0, 8), 2, [], 1) is None
    snp = {"pos": 3, "type": "SNP", "ref_len": 1, "alt": "G"}
    assert recall.allele(snp, row, 2, [], 1) == 1 and recall.allele(snp, recall.Row("ACG-T", "ACGAT", 0, 5), 2, [], 1) == 0
    gone = {"pos": 3, "type": "DEL", "ref_len": 2, "alt": ""}
    assert recall.allele(gone, recall.Row("AC--GT", "ACTTGT", 0, 6), 2, [], 1) == 0 and recall.allele(gone, recall.Row("ACGT", "ACGT", 0, 4), 2, [], 1) == 1
    # On the other haplotype: the reference, where the read goes over all of it.
    assert recall.allele(gone, recall.Row("ACTTGT", "ACTTGT", 0, 6), None, [0, 1, 2, 3, 4, 5], 1) == 0
    assert recall.allele(gone, recall.Row("ACTTGT", "ACTTGT", 0, 4), None, [0, 1, 2, 3, 4, 5], 1) is None


def test_reads_over_a_range_of_sites():
    from haploweave.operators.phase import Phaser, Profile

    rng = random.Random(6)
    profiles, reads = [], []
    for _ in range(200):
        p = Profile()
        for i in range(first := rng.randrange(60), first + rng.choice([0, 1, 3, 30])):
            p.put(i, 0)
        profiles.append(p)
        reads.append({"skipped": rng.random() < 0.1})
    phaser = Phaser([], reads, profiles, O, 0)
    for _ in range(200):
        low = rng.randrange(70)
        high = low + rng.choice([0, 0, 1, 5])
        want = [r for r, p in enumerate(profiles) if 0 <= p.first <= high and p.last >= low and not reads[r]["skipped"]]
        assert phaser.covering(low, high) == sorted(want, key=lambda r: profiles[r].first)
