"""Phasing: reads to haplotypes and sites to phase sets, tile by tile.

The steps that depend on the order of reads and sites run on one tile's lists;
what is relational about them (which allele a haplotype holds, links between
neighbouring het sites, anchors carried along) has DataFrame forms below.
"""
from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import mean_quality
from ..options import Options
from ..schemas import CATEGORY_BIT, CLEAN
from .ranges import STRETCH, beside, numbered, stretched
from .sites import first_site, site_key, site_of

HET_SNP, HET_INDEL, HOM = (CATEGORY_BIT[c] for c in ("CLEAN_HET_SNP", "CLEAN_HET_INDEL", "CLEAN_HOM"))
NOISY_HET, NOISY_HOM = CATEGORY_BIT["NOISY_CAND_HET"], CATEGORY_BIT["NOISY_CAND_HOM"]
ROUNDS = 10


@dataclass
class Profile:
    """Alleles that a read shows at a run of sites: 0 reference, 1 alternate, -1 neither, -2 alternate of low quality."""

    first: int = -1
    alleles: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)

    def put(self, i: int, allele: int, query: int = -1) -> None:
        if self.first < 0:
            self.first = i
        gap = i - self.first - len(self.alleles)
        self.alleles += [-1] * gap + [allele]
        self.at += [-1] * gap + [query]

    @property
    def last(self) -> int:
        return self.first + len(self.alleles) - 1

    def get(self, i: int) -> int:
        return self.alleles[i - self.first] if self.first >= 0 and self.first <= i <= self.last else -1

    def items(self):
        return ((self.first + k, a) for k, a in enumerate(self.alleles)) if self.first >= 0 else iter(())


def touches(a: dict, b: dict) -> bool:
    """Whether two sites overlap; one without reference bases only strictly inside another, or at the same place."""
    (x0, x1), (y0, y1) = (a["pos"], a["pos"] + a["ref_len"]), (b["pos"], b["pos"] + b["ref_len"])
    if a["ref_len"] == 0 and b["ref_len"] == 0:
        return x0 == y0
    if a["ref_len"] == 0:
        return y0 < x0 and x1 < y1
    if b["ref_len"] == 0:
        return x0 < y0 and y1 < x1
    return x0 < y1 and y0 < x1


def exact_key(site: dict) -> tuple:
    return (*site_key(site)[:4], site["alt"] if site["type"] in ("SNP", "INS") else "")


def profile(read: dict, sites: list[dict], keys: list[tuple], options: Options) -> Profile:
    """Profile of a read over sorted sites; NON_VAR sites are passed over."""
    out = Profile()
    i, j = first_site([k[0] for k in keys], read["beg"]), 0
    events = [d for d in read["digars"] if d["type"] != "EQ"]
    while i < len(sites) and j < len(events):
        if sites[i]["category"] == "NON_VAR":
            i += 1
            continue
        event = site_of(events[j])
        order = exact_key(event)
        if events[j]["type"] in ("SOFT", "HARD"):
            order = (*order[:3], events[j]["len"], "")
        if touches(sites[i], event):
            if keys[i] == order:
                low = mean_quality(events[j], read["qual"]) < options.min_bq
                out.put(i, -2 if low else 1, events[j]["qi"])
            else:
                out.put(i, -1)
            i += 1
        elif keys[i] < order:
            out.put(i, 0)
            i += 1
        else:
            j += 1
            i += keys[i] == order
    for k in range(i, len(sites)):
        if sites[k]["pos"] > read["fin"]:
            break
        if not any(x["beg"] - 1 < sites[k]["pos"] + 1 and sites[k]["pos"] < x["fin"] for x in read["noisy"] if x["beg"] <= x["fin"]):
            out.put(k, 0)
    return out


def profiles(reads: list[dict], sites: list[dict], options: Options) -> list[Profile]:
    keys = [exact_key(s) for s in sites]
    return [Profile() if r["skipped"] else profile(r, sites, keys, options) for r in reads]


def read_order(reads: list[dict]) -> list[dict]:
    """Order in which reads are visited; ties keep the input's order."""
    return sorted(reads, key=lambda r: (r["beg"], -r["fin"], r.get("nm") or 0, r["qname"]))


class Phaser:
    """State of one tile: per site a profile of alleles by haplotype and their consensus, per read a haplotype."""

    def __init__(self, sites: list[dict], reads: list[dict], read_profiles: list[Profile], options: Options, mask: int):
        self.sites, self.reads, self.profiles, self.o, self.mask = sites, reads, read_profiles, options, mask
        self.bits = [CATEGORY_BIT[s["category"]] for s in sites]
        self.valid = [i for i, b in enumerate(self.bits) if b & mask]
        self.hap = [0] * len(reads)
        self.phase_set = [-1] * len(reads)
        for s in sites:
            s.setdefault("cons", [-1, -1, -1])
            s.setdefault("homopolymer", False)
            s.setdefault("phase_set", -1)
        self.counts = [None] * len(sites)
        # Reads by the first site of their profile, those sites, and the furthest last site up to each.
        self.by_first = sorted((r for r, p in enumerate(read_profiles) if p.first >= 0 and not reads[r]["skipped"]), key=lambda r: read_profiles[r].first)
        self.firsts = [read_profiles[r].first for r in self.by_first]
        self.furthest = list(accumulate((read_profiles[r].last for r in self.by_first), max))

    def slots(self, i: int) -> int:
        return max(2, len(self.sites[i].get("allele_covs") or ()))

    def reset(self, consensus: bool) -> None:
        for i in self.valid:
            s = self.sites[i]
            self.counts[i] = [[0] * self.slots(i) for _ in range(3)]
            if consensus:
                covs = s.get("allele_covs") or [s["ref_cov"], s["alt_cov"]]
                best = max(covs)
                first = covs.index(best) if best > 0 else -1
                s["cons"] = [-1 if self.o.is_ont and s["homopolymer"] else first, *([1, 1] if self.bits[i] in (HOM, NOISY_HOM) else [-1, -1])]

    def pivot(self) -> int | None:
        """Deepest site of the best class there is; the first of equal ones. Index into valid."""

        def rank(v):
            i = self.valid[v]
            b, s = self.bits[i], self.sites[i]
            if b == HET_SNP:
                return 0
            if b == HET_INDEL:
                return 1
            if b == NOISY_HET:
                return 2 if s["type"] == "SNP" else None if s["homopolymer"] else 3
            return None

        ranked = [(rank(v), -self.sites[self.valid[v]]["total_cov"], v) for v in range(len(self.valid)) if rank(v) is not None]
        return min(ranked)[2] if ranked else None

    def refresh(self, i: int, hap: int) -> None:
        """Consensus of a haplotype: the allele seen most, the lowest of equals."""
        counts, s = self.counts[i][hap], self.sites[i]
        best = max(counts)
        allele = counts.index(best) if best > 0 else -1
        if self.o.is_ont and s["homopolymer"] and best < sum(counts) * 0.67:
            allele = -1
        s["cons"][hap] = allele

    def score(self, r: int) -> int:
        """Haplotype of a read by its alleles: 1, 2, 0 if they don't tell, -1 if there is none to go by.

        Where only one haplotype of a site has a consensus, the other is given the opposite allele on the way."""
        points, used = [0, 0, 0], False
        for i, allele in self.profiles[r].items():
            b, s = self.bits[i], self.sites[i]
            if not b & self.mask or s["homopolymer"] or b == NOISY_HOM or allele < 0:
                continue
            cons = s["cons"]
            weight = 2 if b in (HET_SNP, HET_INDEL) else 1
            for hap in (1, 2):
                other = 3 - hap
                if cons[hap] == -1 and cons[other] == -1:
                    continue
                if cons[hap] == -1:
                    cons[hap] = 1 - cons[other]
                if cons[other] == -1:
                    cons[other] = 1 - cons[hap]
                if cons[hap] == -1 and cons[hap] != allele:
                    continue
                if b != HOM:
                    used = True
                    points[hap] += weight if cons[hap] == allele else -weight
        if not used:
            return -1
        best = max(points[1:])
        if best > 0:
            return points.index(best, 1)
        worst = min(points[1:])
        return 0 if worst == 0 else 3 - points.index(worst, 1)

    def add(self, r: int, hap: int, refresh: bool) -> None:
        for i, allele in self.profiles[r].items():
            if self.bits[i] & self.mask and allele >= 0:
                for h in (hap,) if hap else (1, 2):
                    self.counts[i][h][allele] += 1
                    if refresh:
                        self.refresh(i, h)

    def covering(self, low: int, high: int) -> list[int]:
        """Reads whose profile meets the sites from low to high, by the first site of their profile. Looks back from the last
        that begins in time, as far as any read before it reaches."""
        found = []
        for k in range(bisect_right(self.firsts, high) - 1, -1, -1):
            if self.furthest[k] < low:
                break
            if self.profiles[self.by_first[k]].last >= low:
                found.append(self.by_first[k])
        return found[::-1]

    def sweep(self) -> None:
        """First assignment, from the pivot to the left end, then to the right."""
        start = self.pivot()
        if start is None:
            return
        for v in [start, *range(start - 1, -1, -1), *range(start + 1, len(self.valid))]:
            i = self.valid[v]
            if self.bits[i] in (HOM, NOISY_HOM):
                continue
            for r in self.covering(i, i):
                if self.hap[r] == 0:
                    hap = self.score(r)
                    self.hap[r] = 1 if hap == -1 else hap
                    self.add(r, self.hap[r], refresh=True)

    def het(self, i: int) -> bool:
        c = self.sites[i]["cons"]
        return -1 not in c[1:] and c[1] != c[2]

    def link(self, r: int, a: int, b: int) -> int | None:
        """Whether a read's alleles at two sites are on its haplotype (1) or cross over (0)."""
        p, hap = self.profiles[r], self.hap[r]
        if hap == 0 or p.first > a or p.last < b:
            return None
        x, y = p.get(a), p.get(b)
        if x < 0 or y < 0 or self.sites[a]["cons"][hap] != x:
            return None
        cons = self.sites[b]["cons"]
        return 1 if cons[hap] == y else 0 if cons[3 - hap] == y else None

    def set_phase_sets(self) -> bool:
        """Phase sets along the sites: a het that fewer than two reads link to the one before starts its own.

        Returns whether the majority of links crosses over somewhere: then another round is due. Consensus alleles are
        not swapped; the next round of assignment settles them."""
        hets = [i for i in self.valid if self.het(i) and not self.sites[i]["homopolymer"]]
        votes = {}
        for a, b in zip(hets, hets[1:]):
            seen = [self.link(r, a, b) for r in self.covering(a, b)]
            votes[b] = seen.count(1), seen.count(0)
        changed = flipped = False
        anchor, known = -1, set(hets)
        for n, i in enumerate(self.valid):
            s = self.sites[i]
            at = s["pos"] - (s["type"] != "SNP")
            if n == 0:
                anchor = at
            elif i in known:
                agree, cross = votes.get(i, (0, 0))
                if agree < 2 and cross < 2:
                    anchor = at
                elif cross > agree:
                    flipped = not flipped
                changed |= flipped
            s["phase_set"] = anchor
        return changed

    def reassign(self) -> bool:
        """Assigns all reads again, in order, and recounts; whether any consensus changed."""
        before = [list(self.sites[i]["cons"][1:]) for i in self.valid]
        self.reset(consensus=False)
        for r, read in enumerate(self.reads):
            if not read["skipped"]:
                hap = self.score(r)
                self.hap[r] = max(0, hap)
                self.add(r, self.hap[r], refresh=False)
        for i in self.valid:
            self.refresh(i, 1)
            self.refresh(i, 2)
        return before != [self.sites[i]["cons"][1:] for i in self.valid]

    def run(self) -> Phaser:
        if not self.valid:
            return self
        self.reset(consensus=True)
        self.sweep()
        for _ in range(ROUNDS):
            crossed = self.set_phase_sets()
            if not self.reassign() and not crossed:
                break
        known = set(self.valid)
        for r, p in enumerate(self.profiles):
            if not self.reads[r]["skipped"]:
                self.phase_set[r] = next((self.sites[i]["phase_set"] for i, _ in p.items() if i in known and self.het(i) and self.sites[i]["phase_set"] != -1), -1)
        for s in self.sites:
            s["hap_alt"], s["hap_ref"] = genotype_of(s["cons"])
        return self


def phase(sites: list[dict], reads: list[dict], options: Options, mask: int = CLEAN, read_profiles: list[Profile] | None = None) -> Phaser:
    """Phases a tile. Reads must be in read_order."""
    return Phaser(sites, reads, read_profiles if read_profiles is not None else profiles(reads, sites, options), options, mask).run()


def genotype_of(cons: list[int]) -> tuple[int, int]:
    """(haplotype of the alternate: 1, 2, 3 for both or 0 for none; haplotype of the reference)."""
    one, two = cons[1], cons[2]
    if one == -1 and two == -1:
        one = two = cons[0]
    alt = (one not in (-1, 0)) + 2 * (two not in (-1, 0))
    return alt, {0: 0, 1: 2, 2: 1, 3: 0}[alt]


# --- DataFrame forms ---


def genotype(cons0="cons0", cons1="cons1", cons2="cons2"):
    """Columns hap_alt and hap_ref as a struct."""
    c0, c1, c2 = F.col(cons0), F.col(cons1), F.col(cons2)
    neither = (c1 == -1) & (c2 == -1)
    one, two = F.when(neither, c0).otherwise(c1), F.when(neither, c0).otherwise(c2)
    alt = F.when(~one.isin(-1, 0), 1).otherwise(0) + F.when(~two.isin(-1, 0), 2).otherwise(0)
    return F.struct(alt.alias("hap_alt"), F.when(alt == 1, 2).when(alt == 2, 1).otherwise(0).alias("hap_ref"))


def hap_alleles(observations: DataFrame, key: list[str], hap: str = "hap", allele: str = "allele") -> DataFrame:
    """Consensus allele of each site and haplotype: the most seen, the lowest of equals, with its count."""
    counted = observations.filter(F.col(allele) >= 0).groupBy(*key, hap, allele).agg(F.count("*").alias("n"))
    return counted.groupBy(*key, hap).agg(F.min_by(allele, F.struct(-F.col("n"), F.col(allele))).alias("cons"), F.max("n").alias("n_cons"), F.sum("n").alias("n_all"))


def neighbour_links(observations: DataFrame, consensus: DataFrame, order: list[str], site: str = "site_id", on: str = "tid") -> DataFrame:
    """Agreeing and crossing reads between each het site and the het site before it.

    observations: read_id, hap, site, tid, the order columns and allele; consensus: site, cons1, cons2 (het sites only).
    A read's neighbours come from one window over its own sites."""
    obs = observations.join(consensus, site)
    sites = obs.select(on, site, *[c for c in order if c not in (on, site)]).distinct()
    ranked = numbered(sites, [on], order, "k")
    obs = obs.join(ranked.select(site, "k"), site)
    own = lambda h, a, b: F.when(F.col(h) == 1, F.col(a)).otherwise(F.col(b))
    obs = obs.withColumn("mine", own("hap", "cons1", "cons2")).withColumn("other", own("hap", "cons2", "cons1"))
    w = Window.partitionBy("read_id", on).orderBy("k")
    linked = obs.withColumn("pk", F.lag("k").over(w)).withColumn("ok", F.lag(F.col("allele") == F.col("mine")).over(w)).filter((F.col("pk") == F.col("k") - 1) & F.col("ok"))
    return linked.groupBy(site).agg(F.count_if(F.col("allele") == F.col("mine")).alias("n_agree"), F.count_if(F.col("allele") == F.col("other")).alias("n_conflict"))


def carry_anchors(sites: DataFrame, on: str, order: list[str], anchor, starts, name: str = "phase_set") -> DataFrame:
    """Anchor of the last site that starts a phase set, carried along the order, which begins with the place on the contig.

    In two levels, within stretches of a contig and from stretch to stretch, so that no task holds a contig."""
    rows = stretched(sites.withColumn("__start", F.when(starts, anchor)), [on], F.col(order[0]), STRETCH)
    keys = [on, "__stretch", "__part"]
    ends = rows.groupBy(*keys).agg(F.max_by("__start", F.when(F.col("__start").isNotNull(), F.struct(*order))).alias("__last")).select(*[F.col(c).alias(f"__of_{c}") for c in keys], "__last")
    carried = ends.withColumn("__carried", F.last("__last", ignorenulls=True).over(Window.partitionBy(f"__of_{on}").orderBy("__of___stretch").rowsBetween(Window.unboundedPreceding, -1))).drop("__last")
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = rows.repartition("__part").withColumn("__here", F.last("__start", ignorenulls=True).over(within))
    return beside(here, carried, [on]).select(*sites.columns, F.coalesce("__here", "__carried").alias(name))


def read_phase_sets(observations: DataFrame, order: list[str]) -> DataFrame:
    """Phase set of each read: that of the first het site it covers. observations: read_id, phase_set, het and the order columns."""
    return observations.filter("het").groupBy("read_id").agg(F.min_by("phase_set", F.struct(*order)).alias("phase_set"))


def pivots(sites: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """The pivot of each group: best class, deepest, first. As an aggregation: one row a group leaves each task."""
    rank = F.when(F.col("category") == "CLEAN_HET_SNP", 0).when(F.col("category") == "CLEAN_HET_INDEL", 1)
    rank = rank.when((F.col("category") == "NOISY_CAND_HET") & (F.col("type") == "SNP"), 2).when(F.col("category") == "NOISY_CAND_HET", 3)
    ranked = sites.withColumn("class", rank).filter(F.col("class").isNotNull())
    rest = [c for c in ranked.columns if c not in on]
    best = F.min_by(F.struct(*rest), F.struct(F.col("class"), -F.col("total_cov"), *order)).alias("best")
    return ranked.groupBy(*on).agg(best).select(*on, "best.*")
