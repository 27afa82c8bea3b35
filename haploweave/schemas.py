"""Schemas of the relations, and the fixed codes of types and categories.

Coordinates are 1-based and closed unless a name says otherwise.
"""
from __future__ import annotations

#: Codes of variant types; their order is the order of sites at one place.
TYPE_CODE = {"INS": 1, "DEL": 2, "SNP": 8}

#: Bits of categories, used in masks.
CATEGORY_BIT = {
    "LOW_COV": 0x001,
    "STRAND_BIAS": 0x002,
    "CLEAN_HET_SNP": 0x004,
    "CLEAN_HET_INDEL": 0x008,
    "REP_HET_INDEL": 0x010,
    "CLEAN_HOM": 0x080,
    "NOISY_CAND_HET": 0x100,
    "NOISY_CAND_HOM": 0x200,
    "LOW_AF": 0x400,
    "NON_VAR": 0x800,
    "NOISY_RESOLVED": 0x000,
}
CLEAN = CATEGORY_BIT["CLEAN_HET_SNP"] | CATEGORY_BIT["CLEAN_HET_INDEL"] | CATEGORY_BIT["CLEAN_HOM"]
GERMLINE = CLEAN | CATEGORY_BIT["NOISY_CAND_HET"] | CATEGORY_BIT["NOISY_CAND_HOM"]
OUTPUT_CATEGORIES = ("CLEAN_HET_SNP", "CLEAN_HET_INDEL", "CLEAN_HOM", "NOISY_CAND_HET", "NOISY_CAND_HOM")
DROPPED_CATEGORIES = ("NON_VAR", "LOW_COV", "STRAND_BIAS")

DIGAR = "struct<pos:bigint,type:string,len:int,qi:int,low_quality:boolean,alt:string>"
INTERVAL = "struct<beg:bigint,fin:bigint,label:int>"

ALIGNMENT = (
    "read_id bigint, qname string, flag int, tid int, chrom string, pos bigint, mapq int, cigar string, seq string, qual binary, "
    "nm int, md string, cs string, sa string, hs array<bigint>, input_idx int"
)
#: What readers give besides: the mate's contig (null: none) and place, template length, and all other tags as SAM writes them.
MATE = "mate_chrom string, mate_pos bigint, tlen int, tags string"
READ = (
    "read_id bigint, qname string, tid int, beg bigint, fin bigint, rev boolean, mapq int, flag int, nm int, input_idx int, seq string, qual binary, hs array<bigint>, "
    f"digars array<{DIGAR}>, noisy array<{INTERVAL}>, events int, palindrome boolean, skipped boolean"
)
COUNTS = "total_cov int, ref_cov int, alt_cov int, low_qual_cov int, forward_ref int, reverse_ref int, forward_alt int, reverse_alt int"
CANDIDATE = (
    f"chunk_id bigint, var_idx int, tid int, pos bigint, type string, ref_len int, alt string, {COUNTS}, af double, category string, init_category string, "
    "phase_set bigint, hap_alt int, hap_ref int, cons0 int, cons1 int, cons2 int, alt_ref_base int, region_pass boolean"
)
