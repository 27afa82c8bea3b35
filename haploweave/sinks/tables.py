"""Tab-separated outputs: candidates, read support, phased reads."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import six_digits_column

CANDIDATE_COLUMNS = "CHROM POS TYPE REF ALT DP REF_COUNT ALT_COUNT LOW_QUAL_COUNT FORWARD_REF REVERSE_REF FORWARD_ALT REVERSE_ALT AF CATEGORY INIT_CAT PHASE_SET HAP_ALT HAP_REF".split()
SUPPORT_COLUMNS = "CHROM POS TYPE REF_LEN ALT QNAME IS_ALT LOW_QUAL REVERSE MAPQ CHUNK_BEG CHUNK_END".split()
READ_COLUMNS = "CHUNK_ID REG_CHUNK_I CHROM CHUNK_BEG CHUNK_END QNAME READ_CHROM INPUT_IDX READ_BEG READ_END MAPQ REVERSE SKIPPED HAP PHASE_SET".split()


def _named(columns: list[str], values: list) -> list:
    return [v.alias(c) for c, v in zip(columns, values)]


def dot(col):
    return F.when(col.isNull() | (col == ""), ".").otherwise(col)


def candidate_rows(sites: DataFrame) -> DataFrame:
    """sites with chrom and ref_seq (see plans.collect.with_bases). Reference bases of a SNP or deletion; none of an insertion."""
    ref = F.when(F.col("type") == "SNP", F.col("ref_seq")).when(F.col("type") == "DEL", F.substring("ref_seq", F.lit(2), F.col("ref_len"))).otherwise(".")
    c = F.col
    counters = [c(x) for x in ("total_cov", "ref_cov", "alt_cov", "low_qual_cov", "forward_ref", "reverse_ref", "forward_alt", "reverse_alt")]
    return sites.select(*_named(CANDIDATE_COLUMNS, [c("chrom"), c("pos"), c("type"), ref, dot(c("alt")), *counters, six_digits_column(c("af")), c("category"), c("init_category"), c("phase_set"), c("hap_alt"), c("hap_ref")]))


def support_rows(support: DataFrame, contigs: DataFrame) -> DataFrame:
    c = F.col
    rows = support.join(F.broadcast(contigs.select(c("tid"), c("name"))), "tid")
    return rows.select(*_named(SUPPORT_COLUMNS, [c("name"), c("pos"), c("type"), c("ref_len"), dot(c("alt")), c("qname"), c("is_alt"), c("low_qual"), c("rev").cast("int"), c("mapq"), c("chunk_beg"), c("chunk_fin")]))


def read_rows(reads: DataFrame, contigs: DataFrame, tiles: DataFrame | None = None) -> DataFrame:
    """A row for each read of each tile. tiles: chunk_id and reg_chunk_i; without it contigs are numbered by tid."""
    c = F.col
    rows = reads.join(F.broadcast(contigs.select("tid", "name")), "tid")
    if tiles is not None:
        rows = rows.join(tiles.select("chunk_id", "reg_chunk_i"), "chunk_id")
    number = c("reg_chunk_i") if tiles is not None else c("tid")
    values = [c("chunk_id"), number, c("name"), c("chunk_beg"), c("chunk_fin"), c("qname"), c("name"), c("input_idx"), c("beg"), c("fin"), c("mapq"), c("rev").cast("int"), c("skipped").cast("int"), c("hap"), c("phase_set")]
    return rows.select(*_named(READ_COLUMNS, values))


def write(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Part files in order with a header each; range-sorted, so many tasks write."""
    out = rows.orderBy(*order) if order else rows
    out.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)
