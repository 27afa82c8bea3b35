"""Candidate sites and their allele counts.

The order of sites is that of ``site_order``; large insertions of about the same
length count as one site. ``count_alleles`` is the relational form over read and
site observations; ``collect_sites`` and ``walk`` are the exact forms for the
reads of one tile, where an event may match several nearly equal insertions.
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import allele_fraction, base_code, base_codes, mean_quality, sort_pos, type_code
from ..options import Options
from ..schemas import TYPE_CODE
from .ranges import numbered

#: Order codes of clips and equal runs among event types, as in alignment operation numbers.
EVENT_CODE = TYPE_CODE | {"SOFT": 4, "HARD": 5, "EQ": 7}

COUNTERS = ("total_cov", "ref_cov", "alt_cov", "low_qual_cov", "forward_ref", "reverse_ref", "forward_alt", "reverse_alt")


def site_order():
    """Sort columns of the total order of sites."""
    return [F.col("tid"), sort_pos(), type_code(F.col("type")), F.col("ref_len"), F.length("alt"), base_code(F.col("alt"))]


def site_of(op: dict) -> dict:
    """Site of an event: an insertion spans no reference, a deletion has no alternate bases."""
    kind = op["type"]
    return {"pos": op["pos"], "type": kind, "ref_len": {"SNP": 1, "INS": 0}.get(kind, op["len"] if kind == "DEL" else 1), "alt": "" if kind not in ("SNP", "INS") else op["alt"]}


def site_key(site: dict) -> tuple:
    """Sort key of a site within a contig; also of clips, which sort by type only."""
    at = site["pos"] - (site["type"] != "SNP")
    return at, EVENT_CODE[site["type"]], site["ref_len"], len(site["alt"]), tuple(base_codes(site["alt"]))


def compare_fuzzy(a: dict, b: dict, min_sv_len: int) -> int:
    """Order of two sites where insertions of min_sv_len bases or more (tested on the first) are equal if the shorter has 80 % of the longer's length."""
    x, y = site_key(a), site_key(b)
    if x[:3] != y[:3]:
        return -1 if x[:3] < y[:3] else 1
    if a["type"] == "INS" and x[3] >= min_sv_len:
        return 0 if min(x[3], y[3]) >= 0.8 * max(x[3], y[3]) else x[3] - y[3]
    if a["type"] in ("SNP", "INS") and x[3:] != y[3:]:
        return -1 if x[3:] < y[3:] else 1
    return 0


def collapse(sites: list[dict], min_sv_len: int) -> list[dict]:
    """Sorted sites, the first of each run of equal ones."""
    out: list[dict] = []
    for s in sorted(sites, key=site_key):
        if not out or compare_fuzzy(out[-1], s, min_sv_len) != 0:
            out.append(s)
    return out


def collect_sites(reads: list[dict], beg: int, fin: int, min_sv_len: int) -> list[dict]:
    """Candidate sites of a tile's reads: events of good quality that start in the tile."""
    found = [site_of(d) for r in reads if not r["skipped"] for d in r["digars"] if d["type"] in TYPE_CODE and not d["low_quality"] and beg <= d["pos"] <= fin]
    return collapse(found, min_sv_len)


def first_site(keys: list[int], beg: int) -> int:
    """First site that a read from beg on can meet; keys are the sites' sort positions."""
    return bisect_left(keys, beg - 1 if beg > 0 else beg)


def walk(reads: list[dict], sites: list[dict], options: Options, observed: Callable[[dict, int, bool, bool], None]) -> None:
    """Calls observed(read, site number, alternate, low quality) for each site that a read covers.

    Both lists are sorted and merged: an event matches any sites that are (nearly) equal to it, sites that are passed
    over are reference, and so are those after the last event up to the read's end."""
    starts = [site_key(s)[0] for s in sites]
    for r in reads:
        if r["skipped"]:
            continue
        i = first_site(starts, r["beg"])
        events = [d for d in r["digars"] if d["type"] != "EQ"]
        j = 0
        while i < len(sites) and j < len(events):
            order = compare_fuzzy(sites[i], site_of(events[j]), options.min_sv_len)
            if order > 0:
                j += 1
                continue
            if order < 0:
                observed(r, i, False, False)
            else:
                observed(r, i, True, events[j]["low_quality"] or mean_quality(events[j], r["qual"]) < options.min_bq)
            i += 1
        while i < len(sites) and sites[i]["pos"] <= r["fin"]:
            observed(r, i, False, False)
            i += 1


def count(reads: list[dict], sites: list[dict], options: Options) -> list[tuple[dict, int, bool, bool]]:
    """Adds counters to the sites; returns the observations."""
    log: list[tuple[dict, int, bool, bool]] = []
    for s in sites:
        s |= dict.fromkeys(COUNTERS, 0)

    def observed(read, i, alt, low):
        s = sites[i]
        log.append((read, i, alt, low))
        if low:
            s["low_qual_cov"] += 1
            return
        side = "alt" if alt else "ref"
        s["total_cov"] += 1
        s[f"{side}_cov"] += 1
        if not read["palindrome"]:
            s[f"{'reverse' if read['rev'] else 'forward'}_{side}"] += 1

    walk(reads, sites, options, observed)
    return log


def count_alleles(observations: DataFrame, key: list[str], alt="alt_seen", low="low_quality", rev="rev") -> DataFrame:
    """Counters of sites from rows of a read at a site. Partial aggregation: one row a site leaves each task.

    ``alt``, ``low`` and ``rev`` are boolean columns; rows of low quality count in low_qual_cov only."""
    a, q, r = F.col(alt), F.col(low), F.col(rev)
    n = lambda c: F.count_if(c).cast("int")
    return observations.groupBy(*key).agg(
        n(~q).alias("total_cov"), n(~q & ~a).alias("ref_cov"), n(~q & a).alias("alt_cov"), n(q).alias("low_qual_cov"),
        n(~q & ~a & ~r).alias("forward_ref"), n(~q & ~a & r).alias("reverse_ref"), n(~q & a & ~r).alias("forward_alt"), n(~q & a & r).alias("reverse_alt"),
    ).withColumn("af", allele_fraction())


def order_candidates(sites: DataFrame, name: str = "ord") -> DataFrame:
    """Numbers sites within their contig in the total order, ties by site_id where there is one."""
    ties = [F.col("site_id")] if "site_id" in sites.columns else []
    return numbered(sites, ["tid"], [*site_order()[1:], *ties], name)


def distinct_sites(sites: DataFrame, key: list[str], chunk: str = "chunk_id", ord_col: str = "ord", passes: str = "region_pass") -> DataFrame:
    """One row a site across tiles: one that passes its region rather than another, then the first; the flag is that of any."""
    order = Window.partitionBy(*key).orderBy(F.col(passes).desc(), chunk, ord_col)
    whole = Window.partitionBy(*key)
    return sites.withColumn("__any", F.max(F.col(passes)).over(whole)).withColumn("__n", F.row_number().over(order)).filter("__n = 1").withColumn(passes, F.col("__any")).drop("__n", "__any")
