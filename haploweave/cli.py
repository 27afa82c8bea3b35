"""Command line: reference, inputs and regions in; tables, VCF and alignments out.

    python -m haploweave.cli ref.fa reads.bam chr11:1-2000000 --hifi -o sites.tsv --phased-vcf-output phased

Outputs are folders of part files in order; a header, where the format has one,
lies beside them. BAM is one sorted file with its index.
"""
from __future__ import annotations

import sys

from .options import parse_arguments


def run(argv: list[str], spark=None) -> dict[str, int]:
    """A whole run; returns its summary."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans.collect import collect_variation, summary, with_bases
    from .plans.refine import refine
    from .sinks import alignments as out
    from .sinks import tables, vcf
    from .sources import alignments as src
    from .sources import sidecar, text

    options, paths = parse_arguments(argv)
    spark = spark or SparkSession.builder.appName("collect-variation").getOrCreate()
    inputs = [*(text.path_list(spark, paths["input"]) if paths["input_is_list"] else [paths["input"]]), *paths["extra"]]
    reads = src.read_inputs(spark, inputs)
    first = inputs[0]
    contigs = src.sam_contigs(spark, first) if first.endswith((".sam", ".sam.gz")) else text.fasta_index(spark, paths["reference"] + ".fai") if first.endswith(".parquet") else src.bam_contigs(spark, first)
    contigs = contigs.persist()
    reference = text.fasta_tiles(spark, paths["reference"]).persist()
    threads = sidecar.read(spark, options.sidecar_file) if options.sidecar_file else None
    result = collect_variation(spark, reads, reference, contigs, options, sidecar=threads)
    sizes = [(r["name"], r["len"]) for r in contigs.orderBy("tid").collect()]
    based = with_bases(result)
    if paths["output"]:
        tables.write(tables.candidate_rows(based.orderBy("tid", "pos")), paths["output"])
    if paths["vcf_output"]:
        vcf.write(vcf.records(based, options), paths["vcf_output"], sizes)
    if paths["phased_vcf_output"]:
        vcf.write(vcf.phased_records(based, options), paths["phased_vcf_output"], sizes, phased=True)
    if paths["read_support"]:
        tables.write(tables.support_rows(result.support, contigs), paths["read_support"], ["CHROM", "POS", "QNAME"])
    if paths["phase_read_tsv"]:
        tables.write(tables.read_rows(result.reads, contigs, result.grid), paths["phase_read_tsv"], ["CHUNK_ID", "READ_BEG", "QNAME"])
    if paths["out_cram"]:
        raise ValueError("CRAM is not supported")
    if paths["out_sam"] or paths["out_bam"]:
        tagged = out.tagged(refine(reads, result) if options.refine_aln else reads, result.reads).filter(F.col("tid") >= 0)
        lines = src.header_lines(spark, first)
        if paths["out_sam"]:
            out.write_sam(tagged, paths["out_sam"], sizes, " ".join(argv), lines)
        if paths["out_bam"]:
            out.write_bam(tagged, paths["out_bam"], sizes, " ".join(argv), lines, one_file=True)
    return summary(result)


def main() -> int:
    try:
        numbers = run(sys.argv[1:])
    except (ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    for name, n in numbers.items():
        print(f"{name}\t{n}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
