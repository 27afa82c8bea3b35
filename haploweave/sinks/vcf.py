"""VCF records and files.

Record columns: chrom, pos, type, ref_len, alt, the counters, af, category,
region_pass, cons0..cons2, ref_seq (reference bases from the anchor on for
indels), anchor, and optionally alt_ref_base (the alternate's own anchor code) and
phase_set. Gates are plain predicates, so they go down to the scan.
"""
from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_acgt, six_digits_column
from ..operators.phase import genotype
from ..options import Options
from ..schemas import OUTPUT_CATEGORIES

#: Header lines of the format.
FILTERS = (("PASS", "All filters passed"), ("LowQual", "Low quality variant"), ("RefCall", "Reference call candidate"), ("NoCall", "Site has depth=0 resulting in no call"))
INFOS = (
    ("END", "1", "Integer", "End position of the variant described in this record"),
    ("CLEAN", "0", "Flag", "Clean-region variant (SNP or simple indel in non-repetitive region)"),
    ("SVTYPE", "1", "String", "Type of structural variant"),
    ("SVLEN", "A", "Integer", "Difference in length between REF and ALT alleles"),
    ("DP", "1", "Integer", "Total depth"),
    ("REFC", "1", "Integer", "Reference allele count"),
    ("ALTC", "1", "Integer", "Alternate allele count"),
    ("LQC", "1", "Integer", "Low-quality observation count"),
    ("AF", "1", "Float", "Alternate allele fraction"),
    ("CAT", "1", "String", "Candidate category"),
)
FORMATS = (("GT", "1", "String", "Genotype"), ("PS", "1", "Integer", "Phase set anchor coordinate"))


def header(contigs: Sequence[tuple[str, int]], phased: bool = False, today: date | None = None, source: str = "collect-variation") -> str:
    lines = ["##fileformat=VCFv4.2", f"##fileDate={(today or date.today()):%Y%m%d}", f"##source={source}"]
    lines += [f'##FILTER=<ID={i},Description="{d}">' for i, d in FILTERS]
    lines += [f'##INFO=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in INFOS]
    lines += [f'##FORMAT=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in FORMATS] * phased
    lines += [f"##contig=<ID={c},length={n}>" for c, n in contigs]
    return "\n".join([*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"] + ["FORMAT", "SAMPLE"] * phased)]) + "\n"


def gates(options: Options):
    """Predicate of sites that are written: category, depth, an alternate genotype, region."""
    alt = genotype()["hap_alt"]
    return F.col("category").isin(*OUTPUT_CATEGORIES) & (F.col("total_cov") >= options.min_depth) & (F.col("alt_cov") >= options.min_alt_depth) & (alt > 0) & F.col("region_pass")


def records(sites: DataFrame, options: Options) -> DataFrame:
    """sites with chrom, pos (of the anchor for indels), ref, alt, filter, info; only those that are written."""
    rows = sites.filter(gates(options))
    own = F.col("anchor")
    if "alt_ref_base" in sites.columns:
        code = F.col("alt_ref_base")
        rows = rows.filter((F.col("type") == "SNP") | (code == 4) | (code <= 3))
        own = F.when(code == 4, F.col("anchor")).otherwise(F.substring(F.lit("ACGTN"), code + 1, F.lit(1)))
    snp, ins = F.col("type") == "SNP", F.col("type") == "INS"
    alt = F.when(snp, F.col("alt")).when(ins, F.concat(own, "alt")).otherwise(own)
    at = F.when(snp, F.col("pos")).otherwise(F.greatest(F.col("pos") - 1, F.lit(1)))
    kind = F.when(F.col("total_cov") == 0, "NoCall").when(F.col("category") == "NON_VAR", "RefCall").when(F.col("category").isin("LOW_COV", "LOW_AF", "STRAND_BIAS"), "LowQual").otherwise("PASS")
    size = F.when(ins, F.length("alt")).otherwise(-F.col("ref_len"))
    large = ~snp & (F.abs(size) >= options.min_sv_len)
    field = lambda name, c: F.concat(F.lit(f"{name}="), c.cast("string"))
    info = F.concat_ws(
        ";", field("END", at + F.length("ref_seq") - 1), F.when(F.col("category").startswith("CLEAN"), "CLEAN"), F.when(large, field("SVTYPE", F.when(size > 0, "INS").otherwise("DEL"))), F.when(large, field("SVLEN", size)),
        field("DP", F.col("total_cov")), field("REFC", F.col("ref_cov")), field("ALTC", F.col("alt_cov")), field("LQC", F.col("low_qual_cov")), field("AF", six_digits_column(F.col("af"))), field("CAT", F.col("category")),
    )
    out = rows.select("*", alt.alias("__alt"), at.alias("__pos"), kind.alias("filter"), info.alias("info"))
    if not options.amb_base:
        out = out.filter(is_acgt(F.col("ref_seq")) & is_acgt(F.col("__alt")))
    return out.withColumn("alt", F.col("__alt")).withColumn("pos", F.col("__pos")).withColumn("ref", F.col("ref_seq")).drop("__alt", "__pos")


def phased_records(sites: DataFrame, options: Options) -> DataFrame:
    """records with gt and ps: a phase set is given for heterozygous sites that have one."""
    rows = records(sites, options)
    alt = genotype()["hap_alt"]
    gt = F.when(alt == 1, "1|0").when(alt == 2, "0|1").when(alt == 3, "1|1").otherwise("./.")
    return rows.withColumn("gt", gt).withColumn("ps", F.when(alt.isin(1, 2) & (F.col("phase_set") > 0), F.col("phase_set").cast("string")).otherwise("."))


def lines(rows: DataFrame, phased: bool = False) -> DataFrame:
    """One text column, in order of contig and position."""
    dot = F.lit(".")
    cells = [F.col("chrom"), F.col("pos").cast("string"), dot, F.col("ref"), F.col("alt"), dot, F.col("filter"), F.col("info")]
    if phased:
        cells += [F.lit("GT:PS"), F.concat_ws(":", "gt", "ps")]
    return rows.orderBy("tid", "pos").select(F.concat_ws("\t", *cells).alias("value"))


def write(rows: DataFrame, path: str, contigs: Sequence[tuple[str, int]], phased: bool = False) -> None:
    """Part files in order (range-sorted, so many tasks write) beside a file with the header; joined they are one VCF."""
    spark = rows.sparkSession
    spark.createDataFrame([(header(contigs, phased).rstrip("\n"),)], "value string").coalesce(1).write.text(f"{path}/header")
    lines(rows, phased).write.text(f"{path}/records")
