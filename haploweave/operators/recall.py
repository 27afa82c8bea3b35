"""Calling again inside noisy regions by alignment of consensus sequences.

Reads are clipped to a region; those of the two haplotypes of a phase set (or, if
there is none, all reads over the region, in the two groups that their alignment
tells apart) give one or two consensus sequences by partial-order alignment; what
these differ in from the reference are the region's sites: on both sequences
homozygous, on one heterozygous. A read's alleles are read off its row against its
consensus. New sites and the reads' alleles are merged into the tile, and the tile
is phased again. Reads of the haplotypes that reach only one end of a region have
a say in what they cover, unless it is a homopolymer.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..functions.repeats import Window
from ..functions.scalar import error_rate
from ..options import Options
from ..schemas import GERMLINE
from .align import gapped
from .phase import Phaser, Profile, phase
from .poa import GAP, joined, trimmed
from .sites import COUNTERS, site_key


def exchanged(rows: list, behind: Callable) -> list:
    """Rows in the order of an exchange sort: each place in turn takes what stands behind it and should not.

    Where rows are equal the order is that of the exchanges, not that of the input."""
    rows = list(rows)
    for i in range(len(rows) - 1):
        for j in range(i + 1, len(rows)):
            if behind(rows[i], rows[j]):
                rows[i], rows[j] = rows[j], rows[i]
    return rows


@dataclass
class Clip:
    """The part of a read in a region. It covers an end that it reaches, unless with a deletion longer than the flank."""

    read: int
    seq: str
    left: bool
    right: bool
    left_gap: bool = False
    right_gap: bool = False
    qual: bytes = b""

    @property
    def full(self) -> bool:
        return self.left and self.right

    @property
    def whole(self) -> bool:
        """Whether it goes from end to end, be it with a gap at one."""
        return (self.left or self.left_gap) and (self.right or self.right_gap)

    @property
    def rank(self) -> int:
        """Reads that cover both ends come first, then those of the left end, of the right, and of none."""
        return 3 if self.full else 2 if self.left else 1 if self.right else 0


def clip(read: dict, number: int, beg: int, fin: int, flank: int = Options.noisy_flank) -> Clip:
    """The part of a read between two reference positions, by its events; whether it covers either end."""
    lo = hi = None
    gap = [False, False]
    for d in read["digars"]:
        n_ref = d["len"] if d["type"] in ("EQ", "SNP", "DEL") else 0
        if d["type"] in ("SOFT", "HARD") or d["pos"] > fin + (d["type"] == "INS") or d["pos"] + max(n_ref, 1) - 1 < beg:
            continue
        if d["type"] == "DEL":
            a = b = d["qi"]
            gap = [g or (d["len"] > flank and d["pos"] <= x <= d["pos"] + d["len"] - 1) for g, x in zip(gap, (beg, fin))]
        elif d["type"] == "INS":
            a, b = d["qi"], d["qi"] + d["len"]
        else:
            a = d["qi"] + max(0, beg - d["pos"])
            b = d["qi"] + min(d["len"], fin - d["pos"] + 1)
        lo = a if lo is None else min(lo, a)
        hi = b if hi is None else max(hi, b)
    seq = (read.get("seq") or "")[lo:hi].upper() if lo is not None else ""
    reaches = read["beg"] <= beg, read["fin"] >= fin
    return Clip(number, seq, *[r and not g for r, g in zip(reaches, gap)], *[r and g for r, g in zip(reaches, gap)], (read.get("qual") or b"")[lo:hi] if seq else b"")


def region_order(regions):
    """Regions by label, then length."""
    return exchanged(regions, lambda a, b: (a[2], a[1] - a[0]) > (b[2], b[1] - b[0]))


def clip_order(clips: list[Clip], sampling: bool) -> list[Clip]:
    """Clips by what they cover, in sampling mode then by error rate, then the longest first."""
    rate = {c.read: error_rate(c.qual) if sampling else 0.0 for c in clips}

    def behind(a: Clip, b: Clip) -> bool:
        return (-a.rank, rate[a.read], -len(a.seq)) > (-b.rank, rate[b.read], -len(b.seq))

    return exchanged(clips, behind)


def placed_sites(x: str, y: str, beg: int) -> list[tuple[dict, int]]:
    """Sites where a consensus (row y) differs from the reference (row x), left-aligned, each with its place in the consensus; a
    mismatch before a gap belongs to the gap."""
    out, pos, at, i = [], beg, 0, 0
    while i < len(x):
        if x[i] == GAP:
            k = i
            while k < len(x) and x[k] == GAP:
                k += 1
            out.append(({"pos": pos, "type": "INS", "ref_len": 0, "alt": y[i:k]}, at))
            at, i = at + k - i, k
        elif y[i] == GAP:
            k = i
            while k < len(y) and y[k] == GAP:
                k += 1
            out.append(({"pos": pos, "type": "DEL", "ref_len": k - i, "alt": ""}, at))
            pos, i = pos + k - i, k
        else:
            if x[i] != y[i] and not (i + 1 < len(x) and GAP in (x[i + 1], y[i + 1])):
                out.append(({"pos": pos, "type": "SNP", "ref_len": 1, "alt": y[i]}, at))
            pos, at, i = pos + 1, at + 1, i + 1
    return out


def sites_of(ref: str, cons: str, beg: int, o: Options) -> list[dict]:
    """Sites where a consensus differs from the reference."""
    return [s for s, _ in placed_sites(*gapped(ref, cons, o), beg)]


def read_allele(ref: str, seq: str, beg: int, site: dict, o: Options) -> int:
    """Whether a clipped read shows a site's alternate (1), the reference (0) or neither (-1)."""
    x, y = gapped(ref, seq, o)
    pos = beg
    seen = ""
    here = False
    if site["type"] == "INS":
        for p, q in zip(x, y):
            if p == "-" and pos == site["pos"]:
                seen += q
            elif p != "-":
                here |= pos == site["pos"]
                pos += 1
        if not seen:
            return 0 if here or pos == site["pos"] else -1
        if len(site["alt"]) >= 10:
            same = sum(a == b for a, b in zip(seen, site["alt"]))
            return 1 if same >= 0.9 * max(len(seen), len(site["alt"])) else -1
        return 1 if seen == site["alt"] else -1
    for p, q in zip(x, y):
        if p == "-":
            continue
        if site["pos"] <= pos < site["pos"] + site["ref_len"]:
            seen += q
        pos += 1
    original = ref[site["pos"] - beg : site["pos"] - beg + site["ref_len"]]
    if site["type"] == "SNP":
        return 1 if seen == site["alt"] else 0 if seen == original else -1
    gaps = seen.count("-")
    if gaps == 0:
        return 0
    limit = 0.9 if site["ref_len"] >= 10 else 1.0
    return 1 if gaps >= limit * site["ref_len"] else -1


def homopolymer_indel(site: dict, window: Window) -> bool:
    """Whether a deletion lies in a homopolymer: all bases that go, and five from its first, are alike. Insertions never do."""
    return site["type"] == "DEL" and len({window.base(site["pos"] + k) for k in range(max(5, site["ref_len"]))}) == 1


def homopolymer_region(ref: str, flank: int) -> bool:
    """Whether a short region has a base five times and more on end between its flanks."""
    if not 2 * flank <= len(ref) <= 2 * flank + 50:
        return False
    run = 0
    for i in range(max(1, flank - 1), min(len(ref), len(ref) - flank + 1)):
        run = run + 1 if ref[i] == ref[i - 1] else 0
        if run >= 5:
            return True
    return False


class Row:
    """A read's row against its consensus: alleles are told by columns, each consensus base's own and the insertions behind it."""

    def __init__(self, cons: str, read: str, first: int, last: int):
        self.cons, self.read, self.first, self.last = cons, read, first, last
        self.column = [k for k, c in enumerate(cons) if c != GAP] + [len(cons)]

    def covers(self, beg: int, fin: int) -> bool:
        """Whether the read counts at both of two places of the consensus."""
        beg = max(beg, 0)
        return 0 <= fin < len(self.column) - 1 and beg < len(self.column) - 1 and all(self.column[p] < self.last and self.column[p + 1] > self.first for p in (beg, fin))

    def shows(self, at: int, size: int) -> bool:
        """Whether the read has the bases of the consensus from a place on: all of a few, nine in ten of ten and more."""
        here = range(max(self.first, self.column[at]), min(self.last, self.column[at + size]))
        same = sum(self.cons[k] == self.read[k] for k in here)
        return same >= 0.9 * size if size >= 10 else same == size == len(here)

    def joins(self, at: int) -> bool:
        """Whether the read has nothing between the base before a place and the place."""
        return all(self.read[k] == GAP for k in range(self.column[at - 1] + 1 if at else 0, self.column[at]))


def allele(site: dict, row: Row, own: int | None, places: list[int], beg: int) -> int | None:
    """Allele of a read at a site: 1 if the site is its consensus's own (at the place ``own``) and the read shows it, else 0; None
    where it does not count. places: of each base of the reference, the consensus base that it stands over or before."""
    if own is not None:
        if site["type"] == "DEL":
            return int(row.joins(own)) if row.covers(own - 1, own) else None
        size = len(site["alt"])
        return int(row.shows(own, size)) if row.covers(own, own + size - 1) else None
    at = site["pos"] - beg
    if site["type"] != "DEL":
        return 0 if at < len(places) and row.covers(places[at], places[at]) else None
    after = at + site["ref_len"]
    return 0 if after < len(places) and row.covers(places[at - 1] if at else 0, places[after]) else None


def best_phase_set(clips: list[Clip], p: Phaser, o: Options) -> int | None:
    """Phase set with most reads over the whole region on its poorer haplotype, then on the richer; the first of equals. None if
    it has too few, or too few in all on either: reads that cover one end count if they are as long as the shortest over
    the whole region before them."""
    full: dict[int, list[int]] = {}
    count: dict[int, list[int]] = {}
    shortest: dict[int, list[float]] = {}
    for c in clips:
        hap, ps = p.hap[c.read], p.phase_set[c.read]
        if hap not in (1, 2):
            continue
        n, m, least = full.setdefault(ps, [0, 0]), count.setdefault(ps, [0, 0]), shortest.setdefault(ps, [float("inf")] * 2)
        if c.full:
            n[hap - 1] += 1
            m[hap - 1] += 1
            least[hap - 1] = min(least[hap - 1], len(c.seq))
        elif c.rank:
            m[hap - 1] += len(c.seq) >= least[hap - 1]
    if not full:
        return None
    best = max(full, key=lambda ps: (min(full[ps]), max(full[ps])))  # the first of equals
    return best if best > 0 and min(full[best]) >= o.min_hap_full_reads and min(count[best]) >= o.min_hap_reads else None


def call_region(region: tuple[int, int, int], reads: list[dict], p: Phaser, window: Window, o: Options) -> tuple[list[dict], list[Profile | None]] | None:
    """Sites of a region with the alleles of its reads; None if the reads don't suffice (yet)."""
    beg, fin = max(region[0], window.beg), min(region[1], window.fin)
    if fin - beg + 1 > o.max_noisy_reg_len or fin < beg:
        return None
    over = [r for r, x in enumerate(reads) if not x["skipped"] and x["beg"] <= fin and x["fin"] > beg]
    if not over or len(over) > o.max_noisy_reg_reads:
        return None
    sampling = fin - beg + 1 >= o.sampling_reg_len
    clips = clip_order([c for c in (clip(reads[r], r, beg, fin, o.noisy_flank) for r in over) if c.seq], sampling)
    ref = "".join(window.base(i) for i in range(beg, fin + 1))
    ps = best_phase_set(clips, p, o)
    full = [c for c in clips if c.full]
    if ps is not None:
        only_full = homopolymer_region(ref, o.noisy_flank)
        groups = [[c for c in clips if p.phase_set[c.read] == ps and p.hap[c.read] == h and (c.full or c.rank and not only_full)] for h in (1, 2)]
        if any(not g or not g[0].full for g in groups):
            return None
        graphs = [joined([(c.seq, c.left or c.whole, c.right or c.whole) for c in g], o, sampling) for g in groups]
        parts = [(g, graph, list(range(len(g)))) for g, graph in zip(groups, graphs)]
    elif len(full) >= o.min_depth:
        graph = joined([(c.seq, True, True) for c in full], o)
        parts = [(full, graph, which) for which in graph.clusters(o.min_af)]
    else:
        return None
    rows = [graph.consensus(which) for _, graph, which in parts]
    against = [gapped(ref, row.replace(GAP, ""), o) for row in rows]
    found = [{site_key(s): (s, at) for s, at in placed_sites(x, y, beg)} for x, y in against]
    keys = sorted({k for f in found for k in f})
    sites = []
    for key in keys:
        s = dict(next(f[key][0] for f in found if key in f))
        s |= dict.fromkeys(COUNTERS, 0) | {"category": "NOISY_CAND_HOM" if all(key in f for f in found) else "NOISY_CAND_HET", "init_category": "LOW_COV", "alt_ref_base": 4, "homopolymer": homopolymer_indel(s, window)}
        sites.append(s)
    shown: list[Profile | None] = [None] * len(reads)
    for (clips_, graph, which), cons, own, (x, y) in zip(parts, rows, found, against):
        places, at = [], 0
        for a, b in zip(x, y):
            if a != GAP:
                places.append(at)
            at += b != GAP
        shapes = graph.rows()
        for k in which:
            c, profile = clips_[k], Profile()
            if graph.paths[k]:
                row = Row(*trimmed(cons, shapes[k], c.left or c.whole, c.right or c.whole))
                for i, (key, s) in enumerate(zip(keys, sites)):
                    a = allele(s, row, own[key][1] if key in own else None, places, beg)
                    if a is not None:
                        profile.put(i, a)
                        s["total_cov"] += 1
                        s["ref_cov"] += a == 0
                        s["alt_cov"] += a == 1
            shown[c.read] = profile
    for s in sites:
        s["allele_covs"] = [s["ref_cov"], s["alt_cov"]]
        s["af"] = s["alt_cov"] / s["total_cov"] if s["total_cov"] else 0.0
    return sites, shown


def merge_sites(old: list[dict], old_profiles: list[Profile], new: list[dict], new_profiles: list[Profile | None]) -> tuple[list[dict], list[Profile]]:
    """Both tables in order, the old row where both have a site; profiles renumbered."""
    rows = {site_key(s): ("new", i, s) for i, s in enumerate(new)} | {site_key(s): ("old", i, s) for i, s in enumerate(old)}
    order = sorted(rows)
    place = {k: n for n, k in enumerate(order)}
    merged = [rows[k][2] for k in order]
    to_old, to_new = [place[site_key(s)] for s in old], [place[site_key(s)] for s in new]
    out = []
    for a, b in zip(old_profiles, new_profiles):
        alleles: dict[int, tuple[int, int]] = {}
        if b is not None:
            for (i, x), q in zip(b.items(), b.at):
                alleles[to_new[i]] = (x, q)
        for (i, x), q in zip(a.items(), a.at):
            alleles[to_old[i]] = (x, q)
        p = Profile()
        for i in sorted(alleles):
            p.put(i, *alleles[i])
        out.append(p)
    return merged, out


def recall(sites: list[dict], reads: list[dict], p: Phaser, noisy, window: Window, o: Options) -> Phaser:
    """Works through noisy regions, small ones first; those that can't be called yet are tried again after each pass that called any."""
    todo = region_order(noisy)
    while todo:
        left, called = [], False
        for region in todo:
            found = call_region(region, reads, p, window, o)
            if found is None:
                left.append(region)
                continue
            called = True
            if found[0]:
                sites, profiles = merge_sites(p.sites, p.profiles, *found)
                p = _again(p, sites, profiles, o)
        if not called:
            break
        if p.sites:
            p = phase(p.sites, reads, o, GERMLINE, p.profiles)
        todo = left
    return p


def _again(p: Phaser, sites: list[dict], profiles: list[Profile], o: Options) -> Phaser:
    """The phaser over a merged table, with reads as they are until the next phasing."""
    new = Phaser(sites, p.reads, profiles, o, GERMLINE)
    new.hap, new.phase_set = p.hap, p.phase_set
    return new
