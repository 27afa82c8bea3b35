"""Categories of candidate sites."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fisher import strand_pvalue, strand_pvalue_column
from ..functions.repeats import Window, is_repeat_indel
from ..options import Options
from ..schemas import DROPPED_CATEGORIES
from .ranges import cluster, containment_semi_join, overlap_counts, overlap_join


def initial_category(sites: DataFrame, options: Options, repeat: str | None = None, name: str = "category") -> DataFrame:
    """First category by depth, strand, allele fraction and repeat context, in this order. ``repeat``: a boolean column."""
    depth = F.col("total_cov") + F.col("low_qual_cov")
    out = F.when((depth < options.min_depth) | (F.col("alt_cov") < options.min_alt_depth), "LOW_COV")
    if options.is_ont:
        out = out.when(strand_pvalue_column(F.col("forward_alt"), F.col("reverse_alt")) < options.strand_bias_pval, "STRAND_BIAS")
    out = out.when(F.col("af") < options.min_af, "LOW_AF").when(F.col("af") > options.max_af, "CLEAN_HOM")
    if repeat:
        out = out.when((F.col("type") != "SNP") & F.col(repeat), "REP_HET_INDEL")
    return sites.withColumn(name, out.when(F.col("type") == "SNP", "CLEAN_HET_SNP").otherwise("CLEAN_HET_INDEL"))


def initial_category_of(site: dict, window: Window, options: Options) -> str:
    """initial_category for one site beside its reference; sets its allele fraction."""
    site["af"] = site["alt_cov"] / site["total_cov"] if site["total_cov"] else 0.0
    if site["total_cov"] + site["low_qual_cov"] < options.min_depth or site["alt_cov"] < options.min_alt_depth:
        return "LOW_COV"
    if options.is_ont and strand_pvalue(site["forward_alt"], site["reverse_alt"]) < options.strand_bias_pval:
        return "STRAND_BIAS"
    if site["af"] < options.min_af:
        return "LOW_AF"
    if site["af"] > options.max_af:
        return "CLEAN_HOM"
    if is_repeat_indel(site["type"], site["pos"], site["ref_len"], site["alt"], window, options.noisy_max_xgaps):
        return "REP_HET_INDEL"
    return "CLEAN_HET_SNP" if site["type"] == "SNP" else "CLEAN_HET_INDEL"


def with_span(sites: DataFrame, beg: str = "beg", fin: str = "fin") -> DataFrame:
    """Reference span of a site: an insertion stands at its position."""
    return sites.withColumn(beg, F.col("pos")).withColumn(fin, F.when(F.col("type") == "DEL", F.col("pos") + F.col("ref_len") - 1).otherwise(F.col("pos")))


def density(sites: DataFrame, key: Sequence[str], on: Sequence[str] = ("tid",)) -> DataFrame:
    """key columns and n_ov, how many sites (itself too) a site's span overlaps."""
    return overlap_counts(sites, sites, key, on)


def mask_overlapping(sites: DataFrame, noisy: DataFrame, on: Sequence[str] = ("tid",), name: str = "category") -> DataFrame:
    """Sites (with beg, fin) that overlap a noisy interval become NON_VAR."""
    keyed = overlap_join(sites.select(*on, "beg", "fin").distinct(), noisy.select(*on, "beg", "fin"), on, prefix="n_").select(*[F.col(c).alias(f"__{c}") for c in (*on, "beg", "fin")]).distinct()
    match = None
    for c in (*on, "beg", "fin"):
        x = F.col(c) == F.col(f"__{c}")
        match = x if match is None else match & x
    return sites.join(keyed, match, "left").withColumn(name, F.when(F.col("__beg").isNotNull(), "NON_VAR").otherwise(F.col(name))).select(*sites.columns)


def contained(sites: DataFrame, noisy: DataFrame, on: Sequence[str] = ("tid",)) -> DataFrame:
    """Sites whose span lies within a noisy interval."""
    return containment_semi_join(sites, noisy, on)


def prune(sites: DataFrame, name: str = "category") -> DataFrame:
    return sites.filter(~F.col(name).isin(*DROPPED_CATEGORIES))


def noisy_support(noisy: DataFrame, reads: DataFrame, read_noisy: DataFrame, options: Options, key: Sequence[str], on: Sequence[str] = ("tid",)) -> DataFrame:
    """Noisy intervals with n_total (reads over them), n_noisy (those that are noisy there) and kept."""
    total = overlap_counts(noisy, reads, key, on, name="n_total").distinct()
    own = overlap_join(noisy.select(*key, *[c for c in (*on, "beg", "fin") if c not in key]), read_noisy.select(*on, "read_id", "beg", "fin"), on)
    bad = own.select(*key, "r_read_id").distinct().groupBy(*key).agg(F.count("*").alias("n_noisy"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    counted = noisy.join(total, list(key), "left").join(bad, list(key), "left").select(*noisy.columns, zero("n_total"), zero("n_noisy"))
    return counted.withColumn("kept", support_is_enough(F.col("n_total"), F.col("n_noisy"), options))


def support_is_enough(total, noisy, options: Options):
    """Enough reads are noisy, and a large enough share in single precision."""
    enough = (noisy >= options.min_alt_depth) & ((total == 0) | ((noisy.cast("float") / total.cast("float")).cast("float") >= F.lit(options.min_af).cast("float")))
    return enough & (total >= options.min_noisy_reg_total_depth) if options.min_noisy_reg_total_depth > 0 else enough


def support_is_enough_of(total: int, noisy: int, options: Options) -> bool:
    if options.min_noisy_reg_total_depth > 0 and total < options.min_noisy_reg_total_depth or noisy < options.min_alt_depth:
        return False
    return total == 0 or np.float32(noisy) / np.float32(total) >= np.float32(options.min_af)


# --- One tile, exactly: intervals are (start, end, label), 0-based and half-open. ---


def overlapping(intervals: list[tuple[int, int, int]], beg: int, end: int) -> list[tuple[int, int, int]]:
    return [x for x in intervals if x[0] < end and beg < x[1]]


def grown(beg: int, end: int, low_complexity: list[tuple[int, int, int]]) -> tuple[int, int]:
    over = overlapping(low_complexity, beg, end)
    return min([beg, *(x[0] for x in over)]), max([end, *(x[1] for x in over)])


def pre_process(noisy: list[tuple[int, int, int]], low_complexity, reads: list[dict], options: Options) -> list[tuple[int, int, int]]:
    """Noisy intervals of reads, grown over low complexity, clustered twice, with enough reads behind them."""
    regions = cluster(cluster([(*grown(b, e, low_complexity), n) for b, e, n in noisy]))
    out = []
    for b, e, n in regions:
        over = [r for r in reads if not r["skipped"] and r["beg"] - 1 < e and b < r["fin"]]
        bad = sum(any(x["beg"] - 1 < e and b < x["fin"] for x in r["noisy"] if x["beg"] <= x["fin"]) for r in over)
        if support_is_enough_of(len(over), bad, options):
            out.append((b, e, n))
    return out


def span_of(site: dict) -> tuple[int, int]:
    """0-based half-open span for overlaps."""
    return site["pos"] - 1, site["pos"] - 1 + (site["ref_len"] if site["type"] != "INS" else 1)


def event_spans(read: dict) -> list[tuple[int, int]]:
    """Spans of a read's events, those that overlap merged."""
    out: list[list[int]] = []
    for d in read["digars"]:
        if d["type"] not in ("SNP", "INS", "DEL"):
            continue
        b, e = d["pos"] - 1, d["pos"] + (d["len"] - 1 if d["type"] != "INS" else 0)
        if out and b < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def noisy_ratio(reads: list[dict], beg: int, end: int) -> float:
    """Share of the reads over a span that have an event in it."""
    over = [r for r in reads if not r["skipped"] and r["beg"] <= r["fin"] and r["beg"] - 1 < end and beg < r["fin"]]
    return sum(any(b < end and beg < e for b, e in event_spans(r)) for r in over) / len(over) if over else 0.0


def classify(sites: list[dict], reads: list[dict], noisy, low_complexity, window: Window, beg: int, fin: int, options: Options) -> list[tuple[int, int, int]]:
    """Sets category and init_category of a tile's sites; returns its noisy intervals.

    After the first category, sites in noise are NON_VAR; repeat indels and places where several sites crowd (with
    enough reads that differ there) become noise themselves; a low allele fraction counts as low coverage."""
    for s in sites:
        s["init_category"] = s["category"] = initial_category_of(s, window, options)
    crowd = [span_of(s) for s in sites if s["category"] != "LOW_COV" and not (options.is_ont and s["category"] == "STRAND_BIAS")]
    more = []
    for s in sites:
        if s["category"] == "STRAND_BIAS":
            continue
        b, e = span_of(s)
        if overlapping(noisy, b, e):
            s["category"] = "NON_VAR"
            continue
        if s["category"] == "LOW_COV":
            continue
        repeat = s["category"] == "REP_HET_INDEL"
        if beg <= s["pos"] <= fin and (repeat or sum(x < e and b < y for x, y in crowd) > 1):
            gb, ge = grown(b, e, low_complexity)
            if repeat or noisy_ratio(reads, gb, ge) >= options.min_af:
                more.append((gb, ge, 1))
        if s["category"] == "LOW_AF":
            s["category"] = "LOW_COV"
    return cluster(list(noisy) + more) if more else list(noisy)


def post_process(noisy, sites: list[dict], options: Options) -> list[tuple[int, int, int]]:
    """Noisy intervals grown by a flank and over sites that chain on to them, then merged where they touch.

    Ends are kept as they are here: start is the first base, 1-based."""
    usable = lambda s: s["category"] not in DROPPED_CATEGORIES
    last_base = lambda s: s["pos"] + s["ref_len"] - 1
    flank, out, before = options.noisy_flank, [], None
    for b, e, n in sorted(noisy):
        first, last = b + 1, e
        lo, hi = first - flank, last + flank
        # The chain to the left starts at the nearest site between this interval and the one before, that to the right
        # at the nearest after it; where there is none, at the tile's first or last site.
        between = [i for i, s in enumerate(sites) if usable(s) and last_base(s) < first and (before is None or s["pos"] > before)]
        after = [i for i, s in enumerate(sites) if usable(s) and s["pos"] > last]
        for s in reversed(sites[: (between[-1] if between else 0) + 1]):
            if usable(s):
                if last_base(s) < lo - 1:
                    break
                lo = min(lo, s["pos"] - flank)
        for s in sites[after[0] if after else max(0, len(sites) - 1) :]:
            if usable(s):
                if s["pos"] > hi + 1:
                    break
                hi = max(hi, last_base(s) + flank)
        out.append((lo, hi, n))
        before = last
    return cluster(out, window=0)


def contain(sites: list[dict], noisy) -> None:
    """Sites within a noisy interval (as post_process gives them) become NON_VAR."""
    for s in sites:
        b, e = s["pos"] - 1, s["pos"] + (s["ref_len"] if s["type"] != "INS" else 0)
        if s["category"] not in DROPPED_CATEGORIES and any(x <= b and e <= y for x, y, _ in noisy):
            s["category"] = "NON_VAR"
